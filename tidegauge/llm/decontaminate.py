"""Documents that hold passages of a benchmark, found by spaced seeds.

Words are compared in lower case without ASCII punctuation. A seed is SPAN consecutive words of which a fixed mask ignores
some; each of MASKS ignores others, so a passage with words replaced still shares a seed under one of them. The masks leave no
gap: whichever MATCHES words of a window are equal, and whichever word of 10 to 12 is replaced, one of them gives a seed; so
they do for the inner words of 9, and a passage of SPAN words is also found by its first or last SPAN - 1. Seeds of the
benchmark and of the documents meet by hash. Around each hit the passage is laid along the document on the hit's diagonal,
and the hit counts if in some window of WINDOW words at least MATCHES are equal (for shorter passages: all but one word in
seven of the whole passage).

The benchmark is taken in blocks of about BLOCK_WORDS words, each broadcast by itself and given up before the next; documents
never travel. The size of a block does not depend on the corpus; a larger benchmark means more blocks and more reads of the corpus.

Defined results: null texts count as empty and match nothing; a passage shorter than SPAN words is filled up to a seed of all
its words and is found where it stands word by word; repeated rows give a result each; rows without an id are read and
reported under a null id; ids of passages may have any type that can be sorted; only the named columns are read; with an empty benchmark nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import common as C

SPAN = 9
#: 1: the word counts, 0: it is ignored.
MASKS = ("111101101", "110111011", "101011111", "001111111", "111100101")
WINDOW, MATCHES = 13, 11
BLOCK_WORDS = 1_000_000
_TABLE = C.separators(bytes(b for b in range(128) if not chr(b).isalnum()))


class Tokens:
    """Word hashes w of a piece, the n+1 first indices of its texts, and a second hash of any range of words."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = C.raw(pc.utf8_lower(texts))
        self.starts, self.ends, self.first = C.words(self.data, offsets, _TABLE)
        self.w = C.word_hashes(self.data, self.starts, self.ends, 0)

    def second(self, a: int, b: int) -> np.ndarray:
        return C.word_hashes(self.data, self.starts[a:b], self.ends[a:b], 1)


def seeds(w: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash for each start of a span, over the words that the mask keeps."""
    n = len(w) - len(mask) + 1
    out = np.full(max(n, 0), number + 1, np.uint64)
    for k, bit in enumerate(mask if n > 0 else ""):
        if bit == "1":
            out = (out + w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return C.mix(out)


class Block:
    """Seeds of some passages, sorted, with the passage and position of each."""

    def __init__(self, items: list, texts: list[str | None]):
        self.items = items
        t = Tokens(pa.array(texts, pa.large_string()).fill_null(""))
        self.words, self.second = ([x[a:b] for a, b in zip(t.first[:-1], t.first[1:])] for x in (t.w, t.second(0, len(t.w))))
        hashes, item, at = [], [], []
        for i, x in enumerate(self.words):
            for k, mask in enumerate(MASKS):
                h = seeds(x, mask, k)
                hashes.append(h)
                item.append(np.full(len(h), i))
                at.append(np.arange(len(h)))
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.concatenate([np.zeros(0, np.int64), *item]).astype(np.int64)
        order = np.lexsort((item, h))
        self.h, self.item = h[order], item[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *at])[order].astype(np.int64)
        # Runs of seeds of one hash and one passage.
        new = np.ones(len(order), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.item[1:] != self.item[:-1])
        self.run = np.flatnonzero(new)
        self.run_h, self.run_n = self.h[self.run], np.diff(np.append(self.run, len(order)))
        self.bits = 22
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.h >> np.uint64(64 - self.bits)] = True
        # Passages below a span: by the hash of all their words, per length. Of a span: by all but the first or last word.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(self.words):
            size = min(len(x), SPAN - 1)
            for h in C.grams(x, size).tolist() if 0 < len(x) <= SPAN else ():
                self.short.setdefault(size, {}).setdefault(h, []).append(i)

    def hits(self, w: np.ndarray) -> dict[int, range | list[int]]:
        """For each passage with a hit in one run of words the diagonals to look at, a diagonal being where the passage's first word
        would stand. If hits outnumber the diagonals that there are, as in texts that repeat themselves, all of them."""
        seen, total = [], np.zeros(len(self.words), np.int64)
        for k, mask in enumerate(MASKS):
            h = seeds(w, mask, k)
            pos = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
            values, which, n = np.unique(h[pos], return_inverse=True, return_counts=True)
            a, b = np.searchsorted(self.run_h, values), np.searchsorted(self.run_h, values, side="right")
            runs = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
            of = np.repeat(np.arange(len(values)), b - a)
            np.add.at(total, self.item[self.run[runs]], self.run_n[runs] * n[of])
            seen.append((pos[np.argsort(which, kind="stable")], np.cumsum(n) - n, n, runs, of))
        out: dict[int, range | list[int]] = {}
        many = total > len(w) + np.array([len(x) for x in self.words], np.int64)
        for i in np.flatnonzero(many).tolist():
            out[i] = range(1 - len(self.words[i]), len(w))
        found: set[tuple[int, int]] = set()
        for pos, start, n, runs, of in seen:
            few = ~many[self.item[self.run[runs]]]
            for r, v in zip(runs[few].tolist(), of[few].tolist()):
                item, at = int(self.item[self.run[r]]), self.at[self.run[r] : self.run[r] + self.run_n[r]]
                found.update((item, d) for d in np.subtract.outer(pos[start[v] : start[v] + n[v]], at).ravel().tolist())
        for item, d in sorted(found):
            out.setdefault(item, []).append(d)
        return out

    def matched(self, w: np.ndarray, item: int, start: int, v: np.ndarray | None = None) -> int:
        """Equal words of the passage laid at `start`, by their hashes w and second hashes v, or 0 if they are too few anywhere."""
        x = self.words[item]
        lo, hi = max(0, -start), min(len(x), len(w) - start)
        same = x[lo:hi] == w[start + lo : start + hi]
        if v is not None:
            same &= self.second[item][lo:hi] == v[start + lo : start + hi]
        size = min(WINDOW, len(x))
        need = MATCHES if len(x) >= WINDOW else len(x) - len(x) // 7
        sums = np.cumsum(np.concatenate([[0], same]))
        best = (sums[size:] - sums[:-size]).max() if len(same) >= size else sums[-1]
        return int(sums[-1]) if best >= need else 0

    def overlaps(self, w: np.ndarray, v: np.ndarray | None = None) -> dict[int, int]:
        """For each passage that overlaps the words (hashes w, second hashes v) enough: the most words matched along one diagonal."""
        out: dict[int, int] = {}
        for item, starts in self.hits(w).items():
            if n := max(self.matched(w, item, start, v) for start in starts):
                out[item] = n
        for size, table in self.short.items():
            both = zip(*[C.grams(x, size).tolist() for x in (w, w if v is None else v)]) if len(w) >= size else ()
            for h, g in {x for x in both if x[0] in table}:
                for item in table[h]:
                    if g in C.grams((self.words if v is None else self.second)[item], size):
                        out[item] = max(out.get(item, 0), size)
        return out


def _block_matches(docs: DataFrame, shared, item_type: DataType) -> DataFrame:
    arrow = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for ids, texts in C.pieces(batch.column(0), batch.column(1)):
                t = Tokens(texts)
                w, first = t.w, t.first
                # All texts of the piece at once; only texts with a hit (across borders too) are looked at one by one.
                maybe: set[int] = set()
                for k, mask in enumerate(MASKS):
                    h = seeds(w, mask, k)
                    pos = np.flatnonzero(block.table[h >> np.uint64(64 - block.bits)])
                    at = np.searchsorted(block.h, h[pos])
                    at[at == len(block.h)] = 0
                    if len(block.h):
                        maybe.update((np.searchsorted(first, pos[block.h[at] == h[pos]], side="right") - 1).tolist())
                for size, table in block.short.items():
                    pos = np.flatnonzero(np.isin(C.grams(w, size), np.array(list(table), np.uint64)))
                    maybe.update((np.searchsorted(first, pos, side="right") - 1).tolist())
                rows = [(d, i, n) for d in sorted(maybe) for i, n in sorted(block.overlaps(w[first[d] : first[d + 1]], t.second(first[d], first[d + 1])).items())]
                if rows:
                    d, i, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([block.items[x] for x in i], arrow), pa.array(n, pa.int64())], ["id", "item_id", "n_matched"])

    return docs.mapInArrow(run, f"id {docs.dtypes[0][1]}, item_id {item_type.simpleString()}, n_matched long")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, item_id, n_matched (long): a row for each document and passage that overlap enough."""
    d = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    b = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text].cast("string").alias("text"))
    item_type = b.schema["item_id"].dataType
    words = b.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 5
    n_blocks = 1 + int(words) // block_words
    out = None
    for k in range(n_blocks):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Block([r["item_id"] for r in part], [r["text"] for r in part]))
        one = _block_matches(d, shared, item_type)
        if n_blocks > 1:  # one block at a time is held anywhere
            one = C.written(one, "matches")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each contaminated document: id, items (sorted distinct item ids), n_matched (most words of one passage)."""
    m = matches(docs, benchmark, id_col, text_col, item_col, item_text)
    return m.groupBy(id_col).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("n_matched").alias("n_matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = C.written(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_bad")).distinct(), "bad").hint("shuffle_hash")
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
