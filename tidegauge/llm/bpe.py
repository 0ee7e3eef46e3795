"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

Pairs of neighbouring tokens wait in buckets, one per merge rank; a bucket holds the list positions where such a pair
starts, smallest first. Three levels of bitmaps say which buckets have entries, and find-first-set on each level gives the
next rank in constant time. A merge changes its neighbours' pairs by pushing new entries; old ones are recognised as stale
when they are taken, since the rank noted at their position has changed. A pre-token of n bytes costs O(n) queue steps
and sorts of its buckets. If a merge makes a pair of lower rank than its own, the rest of the bucket goes back and waits.

Texts are cut into pre-tokens by the pattern of the vocabulary. Each worker keeps a bounded table of results (chunk_table), so
the queue runs once for each distinct pre-token of the chunks that are new to it. A block's ids are decoded and compared with
its bytes.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows are encoded
one by one; only the named columns are read; an empty table gives an empty one. Ids and bytes of a text are held by one
task, in proportion to that text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C
from .chunk_table import PATTERN, ChunkTable, flattened


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and their rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions, one per rank, below three levels of bitmaps."""

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (n_ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank that has entries and all its positions; (-1, []) if there is none."""
        top = self.top
        if not top:
            return -1, []
        b = (top & -top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) + (m & -m).bit_length() - 1
        w = self.low[a]
        rank = (a << 6) + (w & -w).bit_length() - 1
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = m = m & (m - 1)
            if not m:
                self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


class Merger:
    """Merges pre-tokens by rank. Many pre-tokens share one linked list and one queue: a pair never crosses from one to
    the next, and the smallest rank of all is also the smallest of each pre-token that has it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pairs = np.full(1 << 16, -1, np.int64)  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def __call__(self, pretokens: list[bytes]) -> list[list[int]]:
        ranks = self.ranks
        out: list[list[int] | None] = [None if (r := ranks.get(p)) is None else [r] for p in pretokens]
        todo = [k for k, x in enumerate(out) if x is None]
        buf = b"".join([pretokens[k] for k in todo])
        if not buf:
            return [x or [] for x in out]
        n = len(buf)
        heads = np.zeros(n + 1, np.uint8)
        starts = np.cumsum([0, *(len(pretokens[k]) for k in todo)])
        heads[starts] = 1
        after = self._merged(buf, n, heads)
        for k, i, end in zip(todo, starts[:-1].tolist(), starts[1:].tolist()):
            ids = []
            while i < end:
                j = after[i]
                ids.append(ranks[buf[i:j]])
                i = j
            out[k] = ids
        return out

    def _merged(self, buf: bytes, n: int, heads: np.ndarray) -> list[int]:
        """For each start of a token where the next one starts."""
        get, queue, push = self.ranks.get, self.queue, self.queue.push
        data = np.frombuffer(buf, np.uint8).astype(np.int64)
        first = np.full(n, -1, np.int64)
        first[:-1] = np.where(heads[1:-1] == 1, -1, self.pairs[data[:-1] << 8 | data[1:]])
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[at])) + 1
        for group in np.split(at, cuts) if len(at) else []:
            push(int(first[group[0]]), group.tolist())
        noted = first.tolist()  # rank of the pair that starts here, -1 for none
        head = heads.tobytes()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            rank, bucket = queue.pop()
            if rank < 0:
                return after
            if len(bucket) > 1:
                bucket.sort()
            for k, i in enumerate(bucket):
                if noted[i] != rank:
                    continue  # stale
                gone = after[i]
                j = after[gone]
                after[i] = j
                noted[gone] = -1
                lower = False
                if head[j]:
                    noted[i] = -1
                else:
                    before[j] = i
                    noted[i] = r = get(buf[i : after[j]], -1)
                    if r >= 0:
                        push(r, [i])
                        lower = r < rank
                if not head[i]:
                    h = before[i]
                    noted[h] = r = get(buf[h:j], -1)
                    if r >= 0:
                        push(r, [h])
                        lower = lower or r < rank
                if lower:  # that pair comes before the rest of this bucket
                    if rest := bucket[k + 1 :]:
                        push(rank, rest)
                    break


_made: dict[tuple, ChunkTable] = {}


def codec(path: str, pattern: str) -> ChunkTable:
    """The table of this worker for a vocabulary."""
    if (path, pattern) not in _made:
        ranks = load_ranks(path)
        merger, cut, known = Merger(ranks), regex.compile(pattern).findall, pattern == PATTERN
        back = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            back[rank] = token

        def ids_of(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            own = [[c] if known and c[:1] == " " and c[1:].isalpha() else cut(c) for c in chunks]
            new = list(dict.fromkeys(p for parts in own for p in parts))
            ids = dict(zip(new, merger([p.encode() for p in new])))
            return flattened([ids[parts[0]] if len(parts) == 1 else [i for p in parts for i in ids[p]] for parts in own])

        _made[path, pattern] = ChunkTable(back, ids_of, known)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and decoded (binary: the bytes of those ids)."""
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(path, pattern)
        for batch in batches:
            for key, texts in C.pieces(batch.column(0), batch.column(1)):
                ids, offsets = table.encode(texts)
                bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(table.byte_offsets(ids, offsets)), pa.py_buffer(table.decode(ids))])
                yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))), bytes_.cast(pa.binary())], ["id", "ids", "decoded"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256: of the same ids and bytes as
    encode_documents gives, taken in the worker so that ids need not travel."""
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(path, pattern)
        decimal = [str(i) for i in range(len(table.lengths))]
        for batch in batches:
            for key, texts in C.pieces(batch.column(0), batch.column(1)):
                ids, offsets = table.encode(texts)
                back, places = table.decode(ids).tobytes(), table.byte_offsets(ids, offsets).tolist()
                words, at = list(map(decimal.__getitem__, ids.tolist())), offsets.tolist()
                a = [hashlib.sha256(" ".join(words[x:y]).encode()).hexdigest() for x, y in zip(at, at[1:])]
                b = [hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(places, places[1:])]
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(offsets)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
