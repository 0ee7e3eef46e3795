"""Ids of many texts through one bounded table of chunks, in array operations.

Texts are cut at places where the pattern PATTERN always ends a pre-token, whatever stands around them:

* before a space, if the character before it is no white space;
* between an ASCII letter and an ASCII character that is no letter;
* after one of \\t \\n \\v \\f \\r between two visible ASCII characters.

The pattern never looks back, and it looks ahead only from white space, so the ids of a text are the ids of its chunks one after
the other. A chunk met before is found in the table by a 64-bit hash of its bytes; new ones are encoded, each once, by
`ids_of`. The ids of every block are decoded and compared with its bytes, so a hash that two chunks share can't do harm: such a
block is encoded without the table. For other patterns a text is one chunk.

The table holds at most MOST chunks of at most LONGEST bytes each and is emptied when full; longer chunks are encoded where
they stand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import common as C

#: The pattern for which texts are cut. Fixed value: vocabularies name it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOTS = 22
MOST, LONGEST = 2_000_000, 64
#: Chunks looked up at once.
BLOCK = 200_000
_VISIBLE = range(0x21, 0x7F)
_LETTERS = [b for b in range(0x80) if chr(b).isalpha()]
_WHITE = range(0x09, 0x0E)


def _bits(*sets) -> np.ndarray:
    """For each byte the bits of the sets that hold it."""
    out = np.zeros(256, np.uint8)
    for k, bytes_ in enumerate(sets):
        out[list(bytes_)] |= 1 << k
    return out


#: What must stand before and after a cut by the rules (bits) above; the third rule looks at the byte before both too.
_BEFORE = _bits([*_VISIBLE, *range(0x80, 0x100)], _LETTERS, _WHITE)
_AFTER = _bits([0x20], [b for b in range(0x80) if b not in _LETTERS and b != 0x20], _VISIBLE)
_EARLIER = _bits((), (), _VISIBLE)
#: First two bytes of three-byte sequences among which there is white space, as one number.
_WHITE_BLOCKS = np.array([0xE19A, 0xE280, 0xE281, 0xE380])


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """For each byte whether a chunk may start there; the first byte of a text is not looked at."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    rules = _BEFORE[data[:-1]] & _AFTER[data[1:]]
    rules[1:] &= _EARLIER[data[:-2]] | 3
    rules[0] &= 3
    out[1:] = rules != 0
    # A space after a character outside ASCII: not if that may be white space.
    at = np.flatnonzero(out[1:] & (data[:-1] >= 0x80))
    if len(at):
        a, b, c = data[np.maximum(at - 2, 0)].astype(np.int64), data[np.maximum(at - 1, 0)].astype(np.int64), data[at]
        white = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | np.isin(a << 8 | b, _WHITE_BLOCKS)
        out[at[white] + 1] = False
    return out


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and their lengths."""
    return np.array([x for one in lists for x in one], np.int64), np.array([len(x) for x in lists], np.int64)


class ChunkTable:
    """back: the bytes of each id; ids_of: ids (flat) and their numbers for a list of chunks; whole: strings that forbid to cut a
    text in which they occur."""

    def __init__(self, back: list[bytes], ids_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: bool, whole: list[bytes] = ()):
        self.ids_of, self.cut, self.whole = ids_of, cut, [w for w in whole if w]
        self.dtype = "<u2" if len(back) <= 1 << 16 else "<u4"
        self.lengths = np.array([len(b) for b in back], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(back), np.uint8)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.entry = np.zeros(1 << SLOTS, np.int32)
        self.n = self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.dtype)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.entry[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << SLOTS) - 1)
            s = slot[left]
            key = self.keys[s]
            same = key == h[left]
            out[left[same]] = self.entry[s[same]]
            left = left[~same & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            won = self.keys[s] == h[left]
            self.entry[s[won]] = entries[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << SLOTS) - 1)

    def _add(self, chunks: list[str]) -> np.ndarray:
        """New entries, in order."""
        ids, counts = self.ids_of(chunks)
        n, used = self.n + len(chunks), self.used + len(ids)
        if n > len(self.start):
            size = 2 * n
            self.start = np.concatenate([self.start[: self.n], np.zeros(size - self.n, np.int64)])
            self.count = np.concatenate([self.count[: self.n], np.zeros(size - self.n, np.int32)])
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * used - self.used, self.dtype)])
        self.start[self.n : n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        self.ids[self.used : used] = ids
        out = np.arange(self.n, n)
        self.n, self.used = n, used
        return out

    def _block(self, buf: bytes, data: np.ndarray, h: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of the chunks at:ends of data."""
        if self.n > MOST:
            self._empty()
        long = ends - at > LONGEST
        e = self._find(h)
        e[long] = -1
        miss = np.flatnonzero((e < 0) & ~long)
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            firsts = miss[first]
            entries = self._add([buf[a:b].decode() for a, b in zip(at[firsts].tolist(), ends[firsts].tolist())])
            self._insert(new, entries)
            e[miss] = entries[which]
        n, used = self.n, self.used
        if long.any():
            e[long] = self._add([buf[a:b].decode() for a, b in zip(at[long].tolist(), ends[long].tolist())])
        counts = self.count[e].astype(np.int64)
        ids = self.ids[np.repeat(self.start[e] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        self.n, self.used = n, used
        if not np.array_equal(self.decode(ids), data[at[0] : ends[-1]]):
            ids, counts = self.ids_of([buf[a:b].decode() for a, b in zip(at.tolist(), ends.tolist())])
            ids = ids.astype(self.dtype)
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a large string array without nulls, and the n+1 offsets of each text's ids in them."""
        data, offsets = C.raw(texts)
        buf = data.tobytes()
        starts = chunk_starts(data) if self.cut else np.zeros(len(data), bool)
        for w in self.whole:
            p = buf.find(w)
            while p >= 0:
                k = np.searchsorted(offsets, p, side="right") - 1
                starts[offsets[k] : offsets[k + 1]] = False
                p = buf.find(w, max(p + 1, int(offsets[k + 1])))
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(data))
        h = C.word_hashes(data, at, ends)
        h[h == 0] = 1
        parts, counts = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for k in range(0, len(at), BLOCK):
            s = slice(k, k + BLOCK)
            ids, n = self._block(buf, data, h[s], at[s], ends[s])
            parts.append(ids)
            counts.append(n)
        sums = np.cumsum(np.concatenate(counts))
        return np.concatenate(parts), sums[np.searchsorted(at, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        n = self.lengths[ids]
        return self.bytes[np.repeat(self.places[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def byte_offsets(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the texts whose ids start at the offsets start in the decoded bytes."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[ids])])[offsets]
