"""Removal of repeated word sequences by level-wise doubling.

A window of `length` consecutive words goes if the same words also start anywhere else, in another document or the same one.
Levels are `length` halved until it is at most FIRST. On the first level only minimisers count: of the short windows inside
each window of the next level the one of the smallest hash, so that equal windows have equal minimisers. Windows that occur
once at a level are marked; on the next level, of (about) twice the length, only windows whose parts all repeat are
candidates, and so on, until the last level or until a level has no repeated window.

A level is one aggregation by hash, combined before its shuffle: a group of one window carries its own place, which is all
that the next level has to know. So a sequence that occurs a million times costs a row per task, and no join is by hash. On the
levels before the last equal hashes only make candidates; on the last, which decides, windows are equal if two hashes of 64 bits are, whose seeds
are drawn at random for each run: unlike windows are taken for equal with a probability of 2**-128 a pair, whatever they are.
Texts travel to their marks once for each level after the first and once at the end.

Defined results: a null text has no words; texts shorter than a window keep all words; rows that repeat an id with the same
text repeat each other's windows, and all get the same result; a null id is an id like others; other columns are not
read. A document's text and its marks are held by one task, in proportion to that document.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 35
FIRST = 10


def levels(length: int) -> list[int]:
    out = [length]
    while out[0] > FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Piece:
    """The windows of a piece of texts, level by level. Positions count words from the start of the piece."""

    def __init__(self, texts: pa.Array, sizes: list[int]):
        self.data, offsets = C.raw(texts)
        self.starts, self.ends, self.first = C.words(self.data, offsets)
        self.w = C.word_hashes(self.data, self.starts, self.ends)
        self.sizes = sizes
        self.n = np.diff(self.first)

    def inside(self, size: int) -> np.ndarray:
        """Which positions start a window that lies in one text."""
        out = np.zeros(len(self.w), bool)
        out[C.spans(self.first, size)[2]] = True
        return out

    def anchors(self) -> np.ndarray:
        """For each position the minimiser of the second-level window that starts there, -1 if there is none; with one level, itself."""
        out = np.full(len(self.w), -1)
        size = self.sizes[0]
        if len(self.sizes) == 1:
            ok = self.inside(size)
            out[ok] = np.flatnonzero(ok)
            return out
        width = self.sizes[1] - size + 1
        h = C.grams(self.w, size)
        if len(h) >= width:
            best = sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1)
            ok = self.inside(self.sizes[1])[: len(best)]
            out[: len(best)][ok] = best[ok]
        return out

    def candidates(self, level: int, once: list[np.ndarray]) -> np.ndarray:
        """Positions whose windows are candidates on a level; `once` has the positions of single windows of the levels before."""
        anchor = self.anchors()
        if level == 0:
            return np.unique(anchor[anchor >= 0])
        single = np.zeros(len(self.w) + 1, bool)
        single[once[0]] = True
        now = (anchor >= 0) & ~single[anchor]
        for k in range(1, level):
            now[once[k]] = False
            step = self.sizes[k + 1] - self.sizes[k]
            both = np.zeros_like(now)
            if step < len(now):
                both[: len(now) - step] = now[: len(now) - step] & now[step:]
            now = both & self.inside(self.sizes[k + 1])
        return np.flatnonzero(now)

    def repeated(self, once: list[np.ndarray]) -> np.ndarray:
        """Positions of the windows of full length that repeat."""
        at = self.candidates(len(self.sizes) - 1, once[:-1])
        return np.setdiff1d(at, once[-1], assume_unique=True)

    def placed(self, marks: pa.Array) -> np.ndarray:
        """Positions in the piece from a list of positions for each text."""
        values = marks.flatten().to_numpy(zero_copy_only=False)
        lengths = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return (values + np.repeat(self.first[:-1], lengths)).astype(np.int64)


def _windows(rows: DataFrame, level: int, sizes: list[int]) -> DataFrame:
    """id, tag, pos, h of the candidates on a level, from rows (id, tag, text, s0, s1, ...); g, a second hash, on the last."""
    seeds = [secrets.randbits(63), secrets.randbits(63)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(2)):
                if not len(ids):
                    continue
                lo = ids[0].as_py()
                p = Piece(texts, sizes)
                at = p.candidates(level, [p.placed(batch.column(3 + k).slice(lo, len(ids))) for k in range(level)])
                if not len(at):
                    continue
                doc = np.searchsorted(p.first, at, side="right") - 1
                take = pa.array(doc + lo)
                words = [C.word_hashes(p.data, p.starts, p.ends, s) for s in seeds] if level == len(sizes) - 1 else [p.w]
                hashes = [C.grams(w, sizes[level])[at] for w in words]
                for a in range(0, len(at), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take[s]), batch.column(1).take(take[s]), pa.array((at[s] - p.first[doc[s]]).astype(np.int32)), *[pa.array(h[s].view(np.int64)) for h in hashes]], ["id", "tag", "pos", "h", "g"][: 3 + len(hashes)])

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, tag int, pos int, h long" + (", g long" if level == len(sizes) - 1 else ""))


def _once(rows: DataFrame, level: int, sizes: list[int]) -> tuple[DataFrame, int]:
    """id, tag, s<level>: positions in each text of the windows that occur once; and how many windows occur more often. Minima of
    one row are that row."""
    w = _windows(rows, level, sizes)
    groups = w.groupBy(*w.columns[3:]).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("tag").alias("tag"), F.min("pos").alias("pos"))
    # Other groups are counted with the text of their minima, whatever it is.
    once = groups.groupBy("id", "tag").agg(F.collect_list(F.when(F.col("n") == 1, F.col("pos"))).alias(f"s{level}"), F.count_if(F.col("n") > 1).alias("again"))
    once = C.written(once, "once")
    return once.drop("again"), once.agg(F.sum("again").alias("n")).first()["n"] or 0


def _marked(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, list[int] | None]:
    """id, tag, text and the positions of single windows of each level; the sizes of the levels, None if a level has no repeated
    window, so that nothing of the last length can repeat."""
    sizes = levels(length)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    for level in range(len(sizes)):
        once, repeated = _once(rows, level, sizes)
        if not repeated:
            return rows, None
        o = once.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), f"s{level}")
        rows = rows.join(o, rows["id"].eqNullSafe(o["_id"]) & (rows["tag"] == o["_tag"]), "left").drop("_id", "_tag")
    return rows, sizes


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, schema: str, make) -> DataFrame:
    rows, sizes = _marked(docs, id_col, text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(2)):
                if not len(ids):
                    continue
                lo = ids[0].as_py()
                p = Piece(texts, sizes or [length])
                again = p.repeated([p.placed(batch.column(3 + k).slice(lo, len(ids))) for k in range(len(sizes))]) if sizes else np.zeros(0, np.int64)
                cover = np.zeros(len(p.w) + 1, np.int32)
                cover[again] += 1
                np.subtract.at(cover, again + length, 1)
                keep = np.cumsum(cover[:-1]) == 0
                yield make(batch.column(0).slice(lo, len(ids)), p, keep)

    return rows.mapInArrow(run, schema.format(kind=rows.dtypes[0][1])).withColumnRenamed("id", id_col)


def _kept_bytes(p: Piece, keep: np.ndarray) -> list[bytes]:
    """For each text its kept words joined by one space."""
    k = np.flatnonzero(keep)
    doc = np.searchsorted(p.first, k, side="right") - 1
    later = np.zeros(len(k), bool)
    later[1:] = doc[1:] == doc[:-1]
    length = p.ends[k] - p.starts[k] + later
    sums = np.concatenate([[0], np.cumsum(length)])
    out = p.data.copy()
    gaps = p.starts[k[later]] - 1  # a byte between two words of the text
    out[gaps] = 0x20
    flags = np.zeros(len(out) + 1, np.int8)
    np.add.at(flags, p.starts[k] - later, 1)
    np.subtract.at(flags, p.ends[k], 1)
    body = out[np.cumsum(flags[:-1]) > 0].tobytes()
    at = sums[np.searchsorted(doc, np.arange(len(p.n) + 1))]
    return [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _counts(p: Piece, keep: np.ndarray) -> tuple[pa.Array, pa.Array]:
    sums = np.concatenate([[0], np.cumsum(~keep)])
    return pa.array(p.n.astype(np.int64)), pa.array((sums[p.first[1:]] - sums[p.first[:-1]]).astype(np.int64))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_words, n_removed, text (kept words joined by one space), a row for each row of docs."""

    def make(ids: pa.Array, p: Piece, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *_counts(p, keep), pa.array([b.decode() for b in _kept_bytes(p, keep)], pa.string())], ["id", "n_words", "n_removed", "text"])

    return _apply(docs, id_col, text_col, length, "id {kind}, n_words long, n_removed long, text string", make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_words, n_removed, kept_sha256: of the same texts as deduplicated() gives, taken in the worker."""

    def make(ids: pa.Array, p: Piece, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *_counts(p, keep), pa.array([hashlib.sha256(b).hexdigest() for b in _kept_bytes(p, keep)], pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, id_col, text_col, length, "id {kind}, n_words long, n_removed long, kept_sha256 string", make)
