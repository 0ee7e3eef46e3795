"""Removal of repeated byte strings by external induced sorting of suffixes.

A byte goes if any string of `length` bytes that covers it starts anywhere else too, in another document or the same one.

1. Passages: of each window of `length` bytes the substring of GRAM bytes with the least hash is its anchor. Windows of one
   document that share an anchor are a run; equal windows have equal anchors, so windows can only repeat in runs whose
   anchors have the same hash. A hash that occurs once carries its own place, and its run stays: no text travels for that.
2. The bytes of all other runs, equal ones once for each task, meet by the hash. Runs that are equal in whole (128-bit BLAKE2) are one
   passage with a count; more than one are repeated whole.
3. Unlike passages of one anchor go to a shard, whose suffixes are sorted by external induction with common prefixes (induced.py);
   a window is repeated if a neighbour shares `length` bytes. Shards are cut between anchors at about SHARD bytes.
4. An anchor with more than FEW unlike passages (a phrase in many contexts) is split: windows with the anchor in their first
   or second half, which all hold the same longer core, meet by that core, and so on, until few unlike passages are left or
   windows are the core. So no shard grows with the corpus, and nothing is dropped.
5. What is left of each document is put together from its text and the runs that stay, or stay in part.

Defined results: a null text is empty; rows that repeat an id with the same text repeat each other's strings, and all get the
same result; texts under one id are told apart by xxhash64; a null id is an id like others; removal may split a character, so what is
kept is bytes; an empty table gives an empty result; other columns are not read. A document's text and runs are held by one task, in proportion to that document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import induced

LENGTH, GRAM = 200, 64
#: Bytes of a shard, and of its queues that stay in memory; unlike passages of an anchor that go to one shard.
SHARD, MEMORY, FEW = 4 << 20, 64 << 20, 10_000
#: Windows of a text that are looked at together, and passages that a task remembers to have sent.
CHUNK, SEEN = 1 << 20, 200_000
_PLACE = np.uint64((1 << 21) - 1)


def gram_of(length: int) -> int:
    return max(1, min(GRAM, (length + 2) // 3))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of at most CHUNK + length bytes in all: text, first window (from the start of the text), anchor's distance from it and hash of each run."""
    gram, n = gram_of(length), len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C._BYTE[data] * C._power("up", len(data)), out=sums[1:])
    h = C.mix((sums[gram:] - sums[:-gram]) * C._power("down", len(data))[: len(data) - gram + 1])
    least, size, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & _PLACE).astype(np.int64)
    many = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    window = offsets[text] + at
    new = np.ones(len(window), bool)
    new[1:] = anchor[window[1:]] != anchor[window[:-1]]
    k = np.flatnonzero(new)
    a = anchor[window[k]]
    return text[k], at[k], a - window[k], h[a]


def run_table(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """id, tag, n (windows) and for each run s (its first window), o (distance of the anchor) and h; texts shorter than a window have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(2)):
                if not len(which):
                    continue
                data, offsets = C.raw(texts)
                if len(texts) > 1 or len(data) <= CHUNK + length:
                    text, s, o, h = runs(data, offsets, length)
                else:  # a long text by itself
                    parts = [(a, *runs(data[a : a + CHUNK + length - 1], np.array([0, min(len(data) - a, CHUNK + length - 1)]), length)) for a in range(0, len(data) - length + 1, CHUNK)]
                    text, s, o, h = (np.concatenate(x) for x in zip(*[(t, s + a, o, h) for a, t, s, o, h in parts]))
                ends = np.searchsorted(text, np.arange(len(texts) + 1))
                some = np.flatnonzero(np.diff(ends))
                lists = pa.array(np.append(ends[some], len(text)).astype(np.int32))
                take = pa.array(some + which[0].as_py())
                size = np.diff(offsets)[some] - length + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(size.astype(np.int64)), *[pa.ListArray.from_arrays(lists, pa.array(x)) for x in (s.astype(np.int32), o.astype(np.int16), h.view(np.int64))]], ["id", "tag", "n", "s", "o", "h"])

    rows = _rows(docs, id_col, text_col)
    return C.written(rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, tag long, n long, s array<int>, o array<short>, h array<long>"), "runs")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right, a row for each document."""
    r = right.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    return left.join(r, left["id"].eqNullSafe(r["_id"]) & (left["tag"] == r["_tag"]), how).drop("_id", "_tag")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, null as empty."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def passages(texts: DataFrame, length: int) -> DataFrame:
    """h, p (digest of the passage), id, tag, s, o, m (windows) and bytes (null if this task has sent the passage before) of the runs of
    texts (id, tag, text, n, s, o, h, once) whose hash is not single."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            s, o, h, once = (_lists(batch.column(c)) for c in ("s", "o", "h", "once"))
            n = batch.column("n").to_numpy()
            where: list[int] = []
            out: list[list] = [[] for _ in range(6)]
            for k, text in enumerate(batch.column("text")):
                again = np.flatnonzero(~np.isin(s[k], once[k]))
                if not len(again):
                    continue
                data = text.as_py().encode()
                ends = np.append(s[k][1:], n[k])
                for r, a, b in zip(again.tolist(), s[k][again].tolist(), ends[again].tolist()):
                    part = data[a : b + length - 1]
                    p = hashlib.blake2b(part, digest_size=16).digest()
                    for x, v in zip(out, (h[k][r], p, a, o[k][r], b - a, None if p in seen else part)):
                        x.append(v)
                    seen.add(p)
                where += [k] * len(again)
                if len(seen) > SEEN:
                    seen.clear()
            if where:
                take, kinds = pa.array(where), (pa.int64(), pa.binary(), pa.int32(), pa.int16(), pa.int32(), pa.binary())
                x = [pa.array(v, t) for v, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([x[0], x[1], batch.column("id").take(take), batch.column("tag").take(take), *x[2:]], ["h", "p", "id", "tag", "s", "o", "m", "bytes"])

    return texts.mapInArrow(run, f"h long, p binary, id {texts.schema['id'].dataType.simpleString()}, tag long, s int, o short, m int, bytes binary")


def sorted_shards(items: DataFrame, length: int) -> DataFrame:
    """h, p and lists a, b of the repeated windows, from a to before b, of items (g, h, p, w, m, many, bytes): passages of m windows from
    window w of passage (h, p). Those that are `many` repeat in whole; they are sorted with the others and have no row."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        parts, at, place = [], [], 0
        for _, _, _, _, _, _, data in rows:
            parts += [data, b"\xff"]
            at.append(place)
            place += len(data) + 1
        again = induced.repeats(np.frombuffer(b"".join(parts), np.uint8), length, MEMORY)
        for (_, h, p, w, m, many, _), a in zip(rows, at):
            if not many and (own := again[a : a + m]).any():
                edges = np.flatnonzero(np.diff(np.r_[False, own, False])) + w
                yield h, p, edges[::2].tolist(), edges[1::2].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if out := list(shard(rows)):
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["h", "p", "a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield from found()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        yield from found()

    items = items.select("g", "h", "p", "w", "m", "many", "bytes").repartition("g").sortWithinPartitions("g")
    return items.mapInArrow(run, "h long, p binary, a array<int>, b array<int>")


def halves(items: DataFrame, length: int) -> DataFrame:
    """Items (h, p, n, w, m, o, low, high, bytes) whose windows have their anchor between low and high bytes from their start, in two: g is the
    core that all windows of an item hold, q the item's bytes, both as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, p, n, w, m, o, low, high, data in zip(*[c.to_pylist() for c in batch.columns]):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    a, b = max(0, o - hi), min(m, o - lo + 1)
                    if lo > hi or a >= b:
                        continue
                    core = b"%d %d %d " % (h, lo, hi) + data[o - lo : o - hi + length]
                    part = data[a : b + length - 1]
                    out.append((hashlib.blake2b(core, digest_size=16).digest(), hashlib.blake2b(part, digest_size=16).digest(), h, p, n, w + a, b - a, o - a, lo, hi, part))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), *[pa.int32()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["g", "q", "h", "p", "n", "w", "m", "o", "low", "high", "bytes"])

    names = ["h", "p", "n", "w", "m", "o", "low", "high", "bytes"]
    return items.select(*names).mapInArrow(run, "g binary, q binary, h long, p binary, n long, w int, m int, o int, low int, high int, bytes binary")


def split(items: DataFrame, length: int) -> DataFrame:
    """h, p, a, b as sorted_shards() gives, of anchors with many unlike passages: items (h, p, n, w, m, o, low, high, bytes)."""
    found = None
    while True:
        items = C.written(halves(items, length).withColumn("gq", F.concat("g", "q")), "halves")
        each = C.written(items.groupBy("gq", "g").agg(F.sum("n").alias("times"), F.count("*").alias("n")), "each")
        kinds = C.written(each.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")), "kinds")
        each = C.written(C.spread_join(each, kinds.select("g", "kinds"), "g", C.hot_keys(kinds, "g")), "each")
        items = C.written(C.spread_join(items.drop("g"), each.select("gq", "g", "times", "kinds"), "gq", C.hot_keys(each, "gq")), "items")
        whole = items.where("times > 1").select("h", "p", F.array("w").alias("a"), F.array(F.col("w") + F.col("m")).alias("b"))
        few = items.where(f"kinds > 1 AND kinds <= {FEW}").withColumn("many", F.col("times") > 1).dropDuplicates(["gq"])
        both = C.written(whole.unionByName(sorted_shards(few, length)), "found")
        found = both if found is None else found.unionByName(both)
        items = items.where(f"kinds > {FEW}").drop("g", "q", "gq", "times", "kinds")
        if items.isEmpty():
            return found


def marks(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """id, tag, n, s, once (first windows of runs that stay) and parts (s, and lists a, b: of runs that stay but for windows a to b)."""
    table = run_table(docs, id_col, text_col, length)
    each = table.select("id", "tag", F.explode(F.arrays_zip("s", "h")).alias("x")).select("id", "tag", "x.*")
    single = each.groupBy("h").agg(F.count("*").alias("k"), F.min("id").alias("id"), F.min("tag").alias("tag"), F.min("s").alias("s")).where("k = 1")  # minima of one row are that row
    once = single.groupBy("id", "tag").agg(F.collect_list("s").alias("once"))
    table = C.written(_with(table.dropDuplicates(["id", "tag"]), once, "left"), "runs")

    again = table.where("once IS NULL OR size(once) < size(s)").hint("shuffle_hash")
    sent = C.written(passages(_with(_rows(docs, id_col, text_col), again, "inner"), length), "passages")
    counts = C.written(sent.groupBy("h", "p").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("tag").alias("tag"), F.min("s").alias("s")), "counts")
    anchors = C.written(counts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors")
    hot = C.hot_keys(anchors.select("h", F.col("kinds").alias("n")), "h")
    counts = C.written(C.spread_join(counts, anchors, "h", hot), "counts")
    data = C.spread_join(sent.where("bytes IS NOT NULL").select("h", "p", "o", "m", "bytes"), anchors.select("h"), "h", hot, "left_semi")
    data = data.groupBy("h", "p").agg(F.first("o").alias("o"), F.first("m").alias("m"), F.first("bytes").alias("bytes")).join(counts.select("h", "p", "n", "kinds"), ["h", "p"])
    data = C.written(data.withColumn("w", F.lit(0)), "data")
    found = C.written(sorted_shards(data.where(f"kinds <= {FEW}").withColumns({"g": F.col("h"), "many": F.col("n") > 1}), length), "found")
    large = data.where(f"kinds > {FEW}").withColumns({"low": F.lit(0), "high": F.lit(length - gram_of(length)), "o": F.col("o").cast("int")})
    if not large.isEmpty():
        found = found.unionByName(split(large, length))
        found = found.groupBy("h", "p").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    part = counts.where("n = 1").join(found, ["h", "p"], "left").select("id", "tag", F.struct("s", F.coalesce("a", F.array().cast("array<int>")).alias("a"), F.coalesce("b", F.array().cast("array<int>")).alias("b")).alias("x"))
    parts = part.groupBy("id", "tag").agg(F.collect_list("x").alias("parts"))
    return C.written(_with(table.select("id", "tag", "n", "s", "once"), parts, "left"), "marks")


def covered(size: int, length: int, windows: int, s: np.ndarray, once: np.ndarray, parts: list[dict] | None) -> np.ndarray:
    """Which bytes of a text of `size` bytes go, from its row of marks()."""
    ends = np.append(s[1:], windows)
    stay = np.isin(s, once) | np.isin(s, [x["s"] for x in parts or ()])
    a, b = [s[~stay].astype(np.int64)], [ends[~stay].astype(np.int64)]
    for x in parts or ():
        a.append(np.array(x["a"], np.int64) + x["s"])
        b.append(np.array(x["b"], np.int64) + x["s"])
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, np.concatenate(a), 1)
    np.subtract.at(cover, np.concatenate(b) + length - 1, 1)
    return np.cumsum(cover[:-1]) > 0


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, last: str, make) -> DataFrame:
    if not 1 <= length < induced.CAP:
        raise ValueError(f"a length from 1 to {induced.CAP - 1} is needed, not {length}")
    rows = _with(_rows(docs, id_col, text_col), marks(docs, id_col, text_col, length).hint("shuffle_hash"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, once, parts, n = _lists(batch.column("s")), _lists(batch.column("once")), batch.column("parts"), batch.column("n").to_pylist()
            out = []
            for k, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                gone = covered(len(data), length, n[k], s[k], once[k], parts[k].as_py()) if n[k] else np.zeros(len(data), bool)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data
                out.append((len(data), int(gone.sum()), len(edges) // 2, make(kept)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x) for x in zip(*out)]], ["id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (removed runs of bytes) and kept (the other bytes), a row for each row of docs."""
    return _apply(docs, id_col, text_col, length, "kept binary", lambda kept: kept)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of the same bytes as deduplicated() gives."""
    return _apply(docs, id_col, text_col, length, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())
