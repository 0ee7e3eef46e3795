"""Near-duplicate documents by ProbMinHash.

A document is the set of its five-word shingles (a text of fewer words is one shingle). Every shingle is the source of a
Poisson process whose rate is its weight; each arrival falls on one of SIZE registers, and a register keeps its earliest
arrival. A shingle's process ends as soon as its next arrival is later than every register's (early termination). The share
of equal registers estimates the probability Jaccard similarity of two documents. All weights are 1, however often a shingle
occurs in a document, so this is the set Jaccard similarity that links are judged on: BANDS bands of equal registers give
candidates, and each link is verified on the documents' whole shingle sets.

Texts with the same words (by 128 bits of BLAKE2) are one node, so copies never meet in a bucket. In each bucket all nodes are first compared with
the bucket's head; components of verified links follow. In buckets that still hold several components, all pairs of nodes are
verified on their whole sets, as products of matrices, and only links that join components are returned. So each candidate pair is verified or
already in one component, and no row is made for a pair that isn't a link. The time of that
last look does grow with the square of the nodes of one bucket; it is spread over tasks by parts of the bucket.

Defined results: a null text counts as empty; texts without words have equal (empty) word sequences and form one class;
rows that share an id are one document, with the text of the smallest hash of them; a row without an id has no class and is kept; columns other than the two named are
not read; an empty table gives an empty result; ties do not matter since the class id is the smallest doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
BANDS, ROWS = 16, 4
SIZE = BANDS * ROWS
#: Nodes of a bucket that one task compares with as many others.
PART = 256
#: Shingles of such nodes, and shingles of a matrix of zeros and ones.
SHINGLES, TOGETHER = 1 << 19, 4096
_INF = np.inf


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a piece: (text index, shingle hash) of the distinct shingles, sorted by both, and 128 bits of BLAKE2 of each text's words."""
    data, offsets = C.raw(texts)
    starts, ends, first = C.words(data, offsets)
    w = C.word_hashes(data, starts, ends)
    doc, _, at = C.spans(first, WIDTH)
    h = C.grams(w, WIDTH)[at] if len(at) else np.zeros(0, np.uint64)
    key, more = C.digests(*C.spaced(data, starts, ends), first[:-1], first[1:])
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    doc, h = np.concatenate([doc, short]), np.concatenate([h, key[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], key, more


def registers(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash of n weighted sets: for each set the shingle hash whose arrival is the earliest of each register."""
    earliest = np.full(n * size, _INF)
    owner = np.zeros(n * size, np.uint64)
    time = np.zeros(len(h))
    scale = 1.0 / weight.astype(np.float64)
    k = 0
    while len(h):
        r = C.mix(h + np.uint64((0xD1B54A32D192ED03 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) * scale
        at = doc * size + (r % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        owner[at[won]] = h[won]
        latest = earliest.reshape(n, size).max(axis=1)
        go = time < latest[doc]
        doc, h, time, scale = doc[go], h[go], time[go], scale[go]
        k += 1
    return owner.reshape(n, size)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1, k2 (the digest of the words), n (distinct shingles), bands (a hash for each band; none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in C.pieces(batch.column(0), batch.column(1)):
                doc, h, k1, k2 = shingles(texts)
                n = np.bincount(doc, minlength=len(texts))
                regs = registers(doc, h, np.ones(len(h)), len(texts)).reshape(len(texts), BANDS, ROWS)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS))
                for r in range(ROWS):
                    band = C.mix(band * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
                has = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n, pa.int32()), bands], ["id", "k1", "k2", "n", "bands"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, k1 long, k2 long, n int, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, s (array of long: the distinct shingle hashes) of each text of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in C.pieces(batch.column(0), batch.column(1)):
                doc, h, _, _ = shingles(texts)
                offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], ["id", "s"])

    return docs.mapInArrow(run, f"id {docs.dtypes[0][1]}, s array<long>")


#: A Jaccard similarity of 0.8 or more, from the sizes and what both share.
_LINKED = "5 * both >= 4 * (na + nb - both)"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb and both: sizes of the shingle sets of each pair and of their intersection."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return x.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of the component, for every id of the edges (a, b). Smallest labels spread to neighbours,
    then labels take their own label's label; rounds go on until nothing changes."""
    both = C.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = C.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = C.written(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = C.written(step.join(up, "label", "left").select("id", "old", F.coalesce(F.least("label", "up"), "label").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The ids that several rows of (id, text) share."""
    return C.written(docs.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")


def one_text(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, text) with one row for each id: of rows that share an id the one of the smallest text hash, then text."""
    some = docs.where("id IS NOT NULL")
    if repeated.isEmpty():
        return some
    ids = repeated.hint("shuffle_hash")
    order = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")))
    again = some.join(ids, "id", "left_semi").groupBy("id").agg(F.min(order).alias("x")).select("id", F.col("x.col2").alias("text"))
    return some.join(ids, "id", "left_anti").unionByName(again)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int | None = None) -> DataFrame:
    """id, class_id (smallest id of the class) and kept (true for that one document), a row for each row of docs.

    most_bits: no longer read, since all pairs of a bucket are verified.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = repeated_ids(docs)
    texts = one_text(docs, repeated)
    sig = C.written(signatures(texts, "id", "text"), "signatures")
    nodes = C.written(sig.groupBy("k1", "k2").agg(F.min("id").alias("node")), "nodes")
    own = C.written(sig.join(nodes, ["k1", "k2"]).select("id", "node", "n", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")), "own")
    nodes = own.where("id = node")
    members = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = C.written(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    hot = C.hot_keys(sizes.select("bucket", F.col("size").alias("n")), "bucket")
    members = C.written(C.spread_join(members, sizes, "bucket", hot), "members")
    # The head of a bucket is its node of the largest buckets: in a group of copies that is the one most are close to.
    weight = C.written(members.groupBy("id").agg(F.sum("size").alias("weight"), F.max("n").alias("n")), "weight")
    heads = members.select("bucket", "id").join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("x"))
    heads = C.written(heads.select("bucket", F.col("x.id").alias("head")), "heads")
    members = C.written(C.spread_join(members.select("bucket", "id", "n", "size"), heads, "bucket", hot), "members")

    sets = C.written(shingle_sets(texts.join(weight.select("id").hint("shuffle_hash"), "id", "left_semi")), "sets")
    pairs = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    tests = C.written(compared(pairs, sets), "tests")
    labels = components(tests.where(_LINKED))

    # Buckets that still hold several components: first against the node nearest to the head, which is closer to the middle of
    # a group, then all pairs across components, as arrays.
    named = members.join(labels, "id", "left").select("bucket", "id", "n", "size", "head", F.coalesce("label", "id").alias("label"))
    mixed = C.written(named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("n").alias("shingles")).where("x <> y").select("bucket", "shingles"), "mixed")
    shared = tests.select(F.col("a").alias("id"), F.col("b").alias("head"), (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("j"))
    named = C.written(C.spread_join(named, mixed, "bucket", hot).join(shared, ["id", "head"], "left"), "named")
    middle = named.where("id <> head").groupBy("bucket").agg(F.max(F.struct("j", "id")).alias("x")).select("bucket", F.col("x.id").alias("middle"))
    again = C.spread_join(named, middle, "bucket", hot).where("id <> middle").select(F.col("id").alias("a"), F.col("middle").alias("b")).distinct()
    again = C.written(compared(again, sets), "tests")
    links = tests.where(_LINKED).unionByName(again.where(_LINKED))
    labels = components(links)
    named = C.written(named.select("bucket", "id", "size", "shingles").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    more = C.written(_unlike(named, sets, hot), "more")
    if not more.isEmpty():
        labels = components(links.select("a", "b").unionByName(more))

    found = own.select("id", "node").join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("id", F.coalesce("label", "node").alias("class_id"))
    if not repeated.isEmpty():
        found = docs.where("id IS NOT NULL").select("id").join(found, "id")
    none = docs.where("id IS NULL").select("id", F.lit(None).cast(docs.schema["id"].dataType).alias("class_id"))
    out = found.unionByName(none).withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)


def _unlike(named: DataFrame, sets: DataFrame, hot: dict[int, list]) -> DataFrame:
    """a, b: links that join the components of each bucket. A bucket's nodes are dealt to parts of about PART nodes and SHINGLES shingles, and
    each two parts meet by themselves, so the looks at a large bucket are spread over many tasks. A block returns at most one link for each
    component that it holds. Of three nodes all pairs have met the head or the middle."""
    still = named.where("size > 3").groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    parts = F.ceil(F.greatest(F.col("size") / PART, F.least(F.col("shingles") / SHINGLES, F.col("size").cast("double")))).cast("int")
    named = C.spread_join(named, still, "bucket", hot, "left_semi").withColumn("_p", parts).withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_p").cast("long")).cast("int"))
    named = named.join(sets, "id").select("bucket", "_p", "_k", "id", "label", "s")
    x = named.select("bucket", F.col("_k").alias("i"), F.explode(F.sequence(F.col("_k"), F.col("_p") - 1)).alias("j"), "id", "label", "s")
    y = named.select("bucket", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("i"), F.col("_k").alias("j"), "id", "label", "s")
    x, y = (t.select([F.col(c).alias(c) for c in t.columns]) for t in (x, y))  # both come from one table
    kind = dict(named.dtypes)["id"]

    def find(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table([x["id"].slice(0, 0), x["id"].slice(0, 0)], ["a", "b"])
        names = {v: k for k, v in enumerate(dict.fromkeys(x["label"].to_pylist() + y["label"].to_pylist()))}
        lx, ly = (np.array([names[v] for v in t["label"].to_pylist()]) for t in (x, y))
        p, q = linked(x, y) if len(names) > 1 else (np.zeros(0, np.int64),) * 2
        p, q = p[lx[p] != ly[q]], q[lx[p] != ly[q]]
        up = list(range(len(names)))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        chosen = []
        for k, (i, j) in enumerate(zip(lx[p].tolist(), ly[q].tolist())):
            r, s = top(i), top(j)
            if r != s:
                up[r] = s
                chosen.append(k)
        return pa.table([x["id"].take(pa.array(p[np.array(chosen, int)])), y["id"].take(pa.array(q[np.array(chosen, int)]))], ["a", "b"])

    groups = x.groupBy("bucket", "i", "j").cogroup(y.groupBy("bucket", "i", "j"))
    return groups.applyInArrow(find, f"a {kind}, b {kind}").distinct()


def linked(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of both tables that are links, judged on their whole sets: of the shingles that both
    tables hold some at a time are a matrix of zeros and ones for each, whose product counts what two rows share."""
    sets = [(np.diff(t["s"].combine_chunks().offsets.to_numpy()), t["s"].combine_chunks().flatten().to_numpy()) for t in (x, y)]
    (n, h), (m, g) = sets
    common = np.intersect1d(h, g)
    both = np.zeros((len(n), len(m)))
    cells = []
    for size, v in sets:
        at = np.searchsorted(common, v)
        at[at == len(common)] = 0
        here = np.flatnonzero(common[at] == v) if len(common) else np.zeros(0, np.int64)
        at, row = at[here], np.repeat(np.arange(len(size)), size)[here]
        order = np.argsort(at, kind="stable")
        cells.append((at[order], row[order]))
    for k in range(0, len(common), TOGETHER):
        ones = []
        for (at, row), rows in zip(cells, both.shape):
            own = slice(*np.searchsorted(at, (k, k + TOGETHER)))
            ones.append(np.zeros((rows, min(TOGETHER, len(common) - k)), np.float32))
            ones[-1][row[own], at[own] - k] = 1
        both += ones[0] @ ones[1].T
    near = 5 * both >= 4 * (n[:, None] + m - both)
    return np.nonzero(near)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class, all columns as they are; rows without an id stay. Of rows that share an id the one
    whose text stands for it is kept, the smallest row (as JSON) of those that have it."""
    keep = classes(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_keep")).where("_keep IS NOT NULL").distinct().hint("shuffle_hash")
    some = docs.where(F.col(id_col).isNotNull())
    repeated = repeated_ids(docs.select(F.col(id_col).alias("id")))
    if not repeated.isEmpty():
        ids = repeated.select(F.col("id").alias("_again")).hint("shuffle_hash")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        again = some.join(ids, some[id_col] == ids["_again"], "left_semi")
        best = again.groupBy(F.col(id_col).alias("_again")).agg(F.min_by(F.struct("*"), F.struct(F.xxhash64(text), text, F.to_json(F.struct("*")))).alias("_row")).select("_row.*")
        some = some.join(ids, some[id_col] == ids["_again"], "left_anti").unionByName(best)
    return some.join(keep, some[id_col] == keep["_keep"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
