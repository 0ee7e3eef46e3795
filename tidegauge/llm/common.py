"""Helpers shared by the text operators: joins on hot keys, samples, word boundaries and hashes in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.shared import shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The same as a regular expression for Java, DuckDB and Python.
SPACES_RE = r"[\x20\x09-\x0D]+"
#: Text of a batch is handled in pieces of about so many bytes, which bounds a worker's memory; a longer text is one piece.
PIECE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
#: A key is hot if it has more than 1 / HOT of the rows that are counted, so there are at most HOT hot keys.
HOT = 10_000
#: Rows of one key that any task can hold.
FEW = 1_000


def hot_keys(counts: DataFrame, key: str) -> dict[int, list]:
    """{parts: keys}: over how many parts, a power of two, the rows of the hot keys of counts (key, n) are dealt. At most HOT keys
    come to the driver."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out: dict[int, list] = {}
    for r in counts.where((F.col("n") * HOT > total) & (F.col("n") > FEW)).select(key, "n").collect():
        out.setdefault(1 << (-(-r["n"] * HOT // total) - 1).bit_length(), []).append(r[key])
    return out


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: dict[int, list], how: str = "inner") -> DataFrame:
    """many.join(one, key) where `one` has each key once and hot keys of `many` are dealt over several tasks: their rows of `many`
    get a part by a hash of the row, their row of `one` goes to each part. The hot keys, at most HOT, are part of the plan."""
    if not hot:
        return many.join(one, key, how)
    parts = F.lit(1)
    for n, keys in sorted(hot.items()):
        parts = F.when(F.col(key).isin(keys), n).otherwise(parts)
    a = many.withColumn("_part", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(*many.columns), parts.cast("long"))).cast("int"))
    b = one.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return a.join(b, [key, "_part"], how).drop("_part")


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows of the n smallest distinct hashes of a key, one row for each: a sample of at most n rows that does not depend
    on how rows are dealt out. Only hashes travel to find the largest of them."""
    h = F.xxhash64(key)
    most = df.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    return df.where(h <= most if most is not None else F.lit(False)).withColumn("_h", h).dropDuplicates(["_h"]).drop("_h")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 from a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_BASE))


_BYTE = stream(256, 7)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base, or of its inverse modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE_BYTES)
        base = np.uint64(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64))
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 8 * PIECE_BYTES:
            _powers[kind] = have
    return have[:n]


def pieces(ids: pa.Array, texts: pa.Array):
    """Slices of a batch of about PIECE_BYTES of text: (ids, texts as large strings without nulls)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + lengths[to] <= PIECE_BYTES):
            size += lengths[to]
            to += 1
        yield ids.slice(at, to - at), texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string array and the n+1 offsets of its values in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def separators(chars: bytes) -> np.ndarray:
    """A table of 256 booleans: which bytes separate words."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = separators(SPACES)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (byte positions in data) and for each text the index of its first word, n+1 values."""
    inside = ~table[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = inside[:-1].copy(), inside[1:].copy()
        before[cuts - 1] = False
        after[cuts - 1] = False
        first[1:] &= ~before
        last[:-1] &= ~after
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Words above so many bytes are hashed one by one.
LANES = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands; another one for each seed.

    Bytes are taken by eight, and each eight are mixed by a bijection, so words of one length of up to eight bytes never share a
    hash; words above LANES bytes are hashed by BLAKE2. With seeds drawn at random no two words can be chosen to share hashes.
    """
    n = ends - starts
    h = mix(n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(n <= LANES)
    for k in range(0, LANES, 8):
        live = live[n[live] > k]
        if not len(live):
            break
        over = np.maximum(k + 8 - n[live], 0).astype(np.uint64) * np.uint64(8)
        h[live] = mix(h[live] ^ (eight[starts[live] + k] << over)) + np.uint64(_BASE)
    for k in np.flatnonzero(n > LANES).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words one after the other, each followed by a space, and where each starts in that: n+1 places."""
    n = ends - starts
    places = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(places[-1], 0x20, np.uint8)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(places[:-1], n) + inside] = data[np.repeat(starts, n) + inside]
    return out.tobytes(), places


def digests(words: bytes, places: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2, as two arrays, of the words from first to before last, joined by one space."""
    out = [hashlib.blake2b(words[a : max(a, b - 1)], digest_size=16).digest() for a, b in zip(places[first].tolist(), places[last].tolist())]
    both = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def spans(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` words inside each text: index of the text, position in the text, index of the first word."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, pos, first[:-1][doc] + pos


def grams(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive values, built by doubling; windows over text ends are included."""
    if len(w) < width:
        return np.zeros(0, np.uint64)
    out, size = w, 1
    for bit in bin(width)[3:]:
        out = mix(out[: len(out) - size] * np.uint64(_BASE) + out[size:])
        size *= 2
        if bit == "1":
            out = mix(out[:-1] * np.uint64(_BASE) + w[size : size + len(out) - 1])
            size += 1
    return out


def per_text(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the whole sequence of word hashes of each text."""
    n = np.diff(first)
    sums = np.zeros(len(h) + 1, np.uint64)
    if len(h):
        pos = np.arange(len(h)) - np.repeat(first[:-1], n)
        np.cumsum(mix(h + pos.astype(np.uint64) * np.uint64(_BASE)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
