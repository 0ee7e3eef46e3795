"""A content-addressed store of token ids.

Documents are encoded and cut into chunks where a hash over the last WINDOW ids, rolling along the document, is small; so
cuts depend on the ids near them alone, and documents that share a passage share its chunks. A chunk's name is the digest of
its bytes. The store is a folder of Parquet tables:

* `chunks`: name, n, data: every different chunk once, as unsigned little-endian integers of the least width that fits the vocabulary;
* `recipes`: part, at, id, local, n_tokens, names, sizes, root: a row for each document in ascending order of id, parts being
  ranges of ids; names in order are its chunks, root is the root of the Merkle tree over them;
* `manifest`: part, n_docs, n_tokens, start, root: for each part its place in the whole and the root of a Merkle tree over its
  documents' roots, of FAN children a node;
* `root`: n_docs, n_tokens, root of the whole, over the manifest.

Reading checks every chunk against its name, every recipe against its root, every part against the manifest (so recipes that are
lost or swapped as a whole show) and the manifest against the store's root; `audit` reports the parts. A checksum of a document is combined from its
chunks' checksums (CRCs of parts shift and add up), so it needs the names and sizes to travel but not the ids; `documents`
brings the ids themselves together.

Defined results: a null text counts as empty and has the end id alone; ids of documents sort nulls first; rows that repeat an
id are documents of their own, ordered by their roots; other columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .chunk_table import ChunkTable, flattened

WINDOW = 16
#: A cut in so many ids on average, no two closer than LEAST or farther than MOST.
AVERAGE, LEAST, MOST = 512, 128, 4096
FAN = 1024

_made: dict[tuple, tuple] = {}
#: Chunks that are one pre-token for sure: Latin letters, perhaps after a space.
_PLAIN = re.compile("[ A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def byte_characters() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies write their tokens: visible Latin-1 characters stand for
    themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Library:
    """Ids of chunks by the tokenizers library: chunks of letters go to its model as they are, being one pre-token, others through
    all its steps."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = special_as_text
        self.size = self.t.get_vocab_size()
        made = json.loads(self.t.to_str())
        byte, pre = byte_characters(), made["pre_tokenizer"] or {}
        self.special = [x["content"] for x in made["added_tokens"] if not (special_as_text and x["special"])]
        # Cuts hold for byte-level vocabularies with the usual pattern; any other encodes whole texts.
        self.cut = made["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and made["model"]["type"] == "BPE"
        vocab = self.t.get_vocab(with_added_tokens=True)
        back = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            back[i] = bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode()
        for x in made["added_tokens"]:
            back[x["id"]] = x["content"].encode()
        character = {b: c for c, b in byte.items()}
        self.characters = [character[b] for b in range(256)]
        self.table = ChunkTable(back, self.ids_of, self.cut, [x.encode() for x in self.special])

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = _PLAIN.fullmatch if self.cut and not any(map(_PLAIN.fullmatch, self.special)) else lambda c: None
        easy = [k for k, c in enumerate(chunks) if plain(c)]
        hard = sorted(set(range(len(chunks))).difference(easy))
        out: list[list[int]] = [None] * len(chunks)
        written = "|".join([chunks[k] for k in easy]).encode().decode("latin-1").translate(self.characters).split("|")
        tokens = self.t.model.tokenize
        for k, w in zip(easy, written):
            out[k] = [t.id for t in tokens(w)]
        for k, e in zip(hard, self.t.encode_batch_fast([chunks[k] for k in hard], add_special_tokens=False)):
            out[k] = e.ids
        return flattened(out)


def _library(path: str, special_as_text: bool) -> Library:
    if (path, special_as_text) not in _made:
        _made[path, special_as_text] = Library(path, special_as_text)
    return _made[path, special_as_text]


def cuts(ids: np.ndarray, offsets: np.ndarray | None = None) -> list[list[int]]:
    """For each document, whose ids start at the offsets, the ends of its chunks, counted from its first id."""
    offsets = np.array([0, len(ids)]) if offsets is None else offsets
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))])
    rolling = C.mix(sums[WINDOW:] - sums[:-WINDOW])
    small = np.flatnonzero(rolling < np.uint64(2**64 // AVERAGE)) + WINDOW
    first = np.searchsorted(small, offsets[:-1] + LEAST)
    last = np.searchsorted(small, offsets[1:])
    out = []
    for at, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist()):
        n, own, before = end - at, [], 0
        for e in (small[a:b] - at).tolist() if b > a else ():
            while e - before > MOST:
                before += MOST
                own.append(before)
            if e - before >= LEAST:
                own.append(e)
                before = e
        while n - before > MOST:
            before += MOST
            own.append(before)
        out.append([*own, n])
    return out


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


def merkle_root(names: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + x).digest() for x in names]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


@dataclass
class Store:
    path: str
    dtype: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> Store:
    """Encode docs and write the store to a new folder. dtype must hold the vocabulary's ids and end_id. Special tokens inside
    texts get their own ids, as the library does by default, or with special_as_text those of their characters."""
    spark = docs.sparkSession
    kind = docs.select(id_col).dtypes[0][1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, width = _library(tokenizer, special_as_text), np.dtype(dtype).itemsize
        if max(lib.size - 1, end_id) >= 1 << 8 * width:
            raise ValueError(f"{dtype} can't hold {lib.size} ids and {end_id}")
        for batch in batches:
            for key, texts in C.pieces(batch.column(0), batch.column(1)):
                ids, offsets = lib.table.encode(texts)
                ids = np.insert(ids.astype(dtype), offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                raw, names, sizes, data, roots = ids.tobytes(), [], [], [], []
                for at, ends in zip(offsets.tolist(), cuts(ids, offsets)):
                    parts = [raw[width * (at + a) : width * (at + b)] for a, b in zip([0, *ends], ends)]
                    own = [name_of(p) for p in parts]
                    names.append(own)
                    sizes.append([b - a for a, b in zip([0, *ends], ends)])
                    data.append(parts)
                    roots.append(merkle_root(own))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(offsets)), pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.list_(pa.binary())), pa.array(roots, pa.binary())], ["id", "n_tokens", "names", "sizes", "data", "root"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.mapInArrow(encode, f"id {kind}, n_tokens long, names array<binary>, sizes array<int>, data array<binary>, root binary")
    packs = C.written(rows.withColumn("row", F.monotonically_increasing_id()), "packs")

    # The first place of each chunk stores it.
    first = packs.select("row", F.posexplode("names").alias("k", "name")).groupBy("name").agg(F.min(F.struct("row", "k")).alias("first"))
    first = C.written(first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list("first.k").alias("ks")), "first")
    own = packs.select("row", F.arrays_zip("names", "sizes", "data").alias("z")).join(first.hint("shuffle_hash"), "row")
    own = own.select(F.explode(F.transform("ks", lambda k: F.get("z", k))).alias("c")).select(F.col("c.names").alias("name"), F.col("c.sizes").alias("n"), F.col("c.data").alias("data"))
    own.write.option("compression", "zstd").parquet(f"{path}/chunks")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = at = 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            before = local + np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(np.arange(at, at + len(n))), b.column("id"), pa.array(before[:-1].astype(np.int64)), *[b.column(c) for c in ("n_tokens", "names", "sizes", "root")]], ["part", "at", "id", "local", "n_tokens", "names", "sizes", "root"])
            local, at = int(before[-1]), at + len(n)

    light = packs.select("id", "n_tokens", "names", "sizes", "root")
    light = light.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("id").asc_nulls_first(), "root").sortWithinPartitions(F.col("id").asc_nulls_first(), "root")
    light = light.select(F.spark_partition_id().alias("part"), "*").mapInArrow(starts, f"part int, at long, id {kind}, local long, n_tokens long, names array<binary>, sizes array<int>, root binary")
    light.write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = _parts(spark.read.parquet(f"{path}/recipes"))
    # One row for each part: a running sum over them in one task.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")
    _whole(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")
    return Store(path, dtype)


def _parts(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens and root: of a Merkle tree of FAN children a node over the roots of the part's documents."""
    sums = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    most = sums.agg(F.max("n_docs").alias("n")).first()["n"] or 0
    nodes, size = recipes.select("part", "at", F.hex("root").alias("node")), 1
    while size < max(most, 2):
        nodes = nodes.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("x"))
        nodes = nodes.select("part", "at", F.sha2(F.array_join(F.transform("x", lambda e: F.concat(e["at"].cast("string"), F.lit(":"), e["node"])), " "), 256).alias("node"))
        size *= FAN
    return sums.join(nodes.select("part", F.col("node").alias("root")), "part")


def _whole(manifest: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens and a digest over the rows of the manifest, of which there is one for each part."""
    rows = F.array_join(F.sort_array(F.collect_list(F.struct("part", "n_docs", "n_tokens", "start", "root"))).cast("array<string>"), " ")
    return manifest.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.sha2(rows, 256).alias("root"))


def audit(store: Store, spark: SparkSession) -> DataFrame:
    """part, n_docs (of the manifest), n_found and ok for each part: the recipes that are there have the number, the tokens and the
    root that the manifest has, and the manifest has the store's root. Recipes of unknown parts have a null n_docs."""
    manifest, whole = store.table(spark, "manifest"), store.table(spark, "root")
    intact = whole.exceptAll(_whole(manifest)).isEmpty()  # one row each
    found = _parts(store.table(spark, "recipes")).select("part", F.col("n_docs").alias("n_found"), F.col("n_tokens").alias("_n"), F.col("root").alias("_root"))
    x = manifest.join(found, "part", "full")
    ok = F.coalesce((F.col("n_docs") == F.col("n_found")) & (F.col("n_tokens") == F.col("_n")) & (F.col("root") == F.col("_root")), F.lit(False))
    return x.select("part", "n_docs", F.coalesce("n_found", F.lit(0)).alias("n_found"), (ok & F.lit(intact)).alias("ok"))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for j in range(32):
        out ^= np.where(x >> np.uint32(j) & np.uint32(1), columns[j], np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What CRCs (uint32) of parts add to the CRC of a whole in which so many bytes come after each part."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    op = (unit >> np.uint32(8)) ^ _byte_table()[unit & np.uint32(255)]
    out, left = crc.astype(np.uint32), after.astype(np.int64)
    while left.any():
        out = np.where(left & 1, _apply(op, out), out)
        op = _apply(op, op)
        left = left >> 1
    return out


def checked_chunks(store: Store, spark: SparkSession) -> DataFrame:
    """name, n, crc (of the ids as 32-bit integers) and ok (the data has that name and size), from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("data").to_pylist()
            names, n = b.column("name").to_pylist(), b.column("n").to_pylist()
            ids = [np.frombuffer(d, store.dtype) for d in data]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([len(x) for x in ids], pa.int32()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([name_of(d) == k and len(x) == m for d, k, x, m in zip(data, names, ids, n)])], ["name", "n", "crc", "ok"])

    return store.table(spark, "chunks").select("name", "n", "data").mapInArrow(run, "name binary, n int, crc long, ok boolean")


def _occurrences(store: Store, spark: SparkSession) -> DataFrame:
    """A row for each chunk of each recipe: part, at, k, name, after (bytes of 32-bit ids that follow), root_ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes = b.column("names").to_pylist(), b.column("sizes").to_pylist()
            row, k, after, ok = [], [], [], []
            for r, (ns, ss, root) in enumerate(zip(names, sizes, b.column("root").to_pylist())):
                good = merkle_root(ns) == root
                left = sum(ss)
                for j, s in enumerate(ss):
                    left -= s
                    row.append(r)
                    k.append(j)
                    after.append(4 * left)
                    ok.append(good)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("part").take(take), b.column("at").take(take), pa.array(k, pa.int32()), pa.array([x for ns in names for x in ns], pa.binary()), pa.array(after, pa.int64()), pa.array(ok, pa.bool_())], ["part", "at", "k", "name", "after", "root_ok"])

    return store.table(spark, "recipes").select("part", "at", "names", "sizes", "root").mapInArrow(run, "part int, at long, k int, name binary, after long, root_ok boolean")


def checksums(store: Store, spark: SparkSession, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32, verified: for each document, from the stored files alone.

    verified: every chunk is there, has the bytes of its name, and the recipe has its root and size.
    """

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = shift_crc(b.column("crc").to_numpy(), b.column("after").to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("at"), b.column("n"), b.column("good"), pa.array(crc)], ["part", "at", "n", "good", "crc"])

    x = C.spread_join(_occurrences(store, spark), checked_chunks(store, spark), "name", _hot_chunks(store, spark))
    x = x.select("part", "at", "n", (F.col("ok") & F.col("root_ok")).alias("good"), "crc", "after").mapInArrow(shift, "part int, at long, n int, good boolean, crc long")
    x = x.groupBy("part", "at").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.count("*").alias("k"), F.bool_and("good").alias("good"))
    parts = store.table(spark, "manifest").select("part", "start").join(audit(store, spark).select("part", F.col("ok").alias("part_ok")), "part")
    r = store.table(spark, "recipes").select("part", "at", "id", "local", "n_tokens", F.size("names").alias("m")).join(F.broadcast(parts), "part")  # a row for each part
    r = r.join(x, ["part", "at"], "left")
    ok = F.coalesce(F.col("part_ok") & F.col("good") & (F.col("n") == F.col("n_tokens")) & (F.col("k") == F.col("m")), F.lit(False))
    return r.select(F.col("id").alias(id_col), (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", ok.alias("verified"))


def _hot_chunks(store: Store, spark: SparkSession) -> DataFrame:
    names = store.table(spark, "recipes").select(F.explode("names").alias("name"))
    return C.hot_keys(names.groupBy("name").agg(F.count("*").alias("n")), "name")


def documents(store: Store, spark: SparkSession, id_col: str = "doc_id") -> DataFrame:
    """id and ids (array of long, the end id last) of every document, brought together from its chunks. Every chunk is checked
    against its name and the names against the root; a document that fails has null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts, names, root in zip(b.column("parts").to_pylist(), b.column("names").to_pylist(), b.column("root").to_pylist()):
                data = [p["data"] for p in parts or ()]
                whole = [name_of(d) for d in data] == names and merkle_root(names) == root
                out.append(np.frombuffer(b"".join(data), store.dtype).astype(np.int64) if whole else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "ids"])

    x = C.spread_join(_occurrences(store, spark).select("part", "at", "k", "name"), store.table(spark, "chunks").select("name", "data"), "name", _hot_chunks(store, spark))
    x = x.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("parts"))
    x = store.table(spark, "recipes").select("part", "at", "id", "names", "root").join(x, ["part", "at"], "left").select("id", "names", "root", "parts")
    return x.mapInArrow(run, f"id {x.dtypes[0][1]}, ids array<long>").withColumnRenamed("id", id_col)
