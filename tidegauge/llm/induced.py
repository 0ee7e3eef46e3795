"""External induced sorting of the suffixes of one shard, with the lengths of their common prefixes.

Suffixes whose next suffix is larger are of type S, others of type L; an S after an L is a seed. Seeds are named by the substrings up to
the next seed, and the string of names is sorted by recursion. From the sorted seeds all L suffixes are induced in
ascending, then all S suffixes in descending order: popping the least suffix of the queue pushes the one before it, if of
the type. The queue's priority is the first character, and what is pushed for one character comes in order, so the queue is a first-in,
first-out list of tuples (place, common prefix with the one before) for each character; lists beyond `memory` bytes are written to a scratch file
that has no name and goes with the task. The common prefix of two neighbours that are pushed is one more than the least among
those of the suffixes popped between them; it is kept up to 255.

Text is bytes without 0xFF (as UTF-8 is); 0xFF separates passages. What follows a separator has no part in any comparison
that counts: callers take common prefixes up to the end of a passage only.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

#: Tuples that are popped at once.
BLOCK = 1 << 18
CAP = 255


class Queues:
    """A list of (place, common prefix) for each character, beyond `memory` bytes on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.parts: list[list] = [[] for _ in range(256)]

    def push(self, c: int, place: np.ndarray, common: np.ndarray) -> None:
        self.parts[c].append((place, common))
        self.held += place.nbytes + common.nbytes
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            for parts in self.parts:
                for k, (x, y) in enumerate(parts):
                    if isinstance(x, np.ndarray):
                        self.file.seek(self.end)
                        self.file.write(x.tobytes() + y.tobytes())
                        parts[k] = (self.end, len(x))
                        self.end += 9 * len(x)
            self.held = 0

    def _read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        x, y = part
        if isinstance(x, np.ndarray):
            self.held -= x.nbytes + y.nbytes
            return x, y
        self.file.seek(x)
        data = self.file.read(9 * y)
        return np.frombuffer(data, np.int64, y), np.frombuffer(data, np.uint8, y, 8 * y)

    def pop(self, c: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a character in the order of their pushes, or the last first (each block in the order of pushes), BLOCK or more at once."""
        parts, self.parts[c] = self.parts[c], []
        parts = parts if backwards else parts[::-1]
        while parts:
            some, n = [], 0
            while parts and n < BLOCK:
                some.append(self._read(parts.pop()))
                n += len(some[-1][0])
            some = some[::-1] if backwards else some
            yield tuple(np.concatenate(x) for x in zip(*some))


def types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last is larger than the empty suffix."""
    cut = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(len(t), bool)
    if len(cut):
        out[: cut[-1] + 1] = np.repeat(t[cut] < t[cut + 1], np.diff(cut, prepend=-1))
    return out


def seeds_of(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def named(t: np.ndarray, small: np.ndarray, at: np.ndarray, single: np.ndarray | None = None) -> np.ndarray:
    """For each seed the rank of its substring, up to the next seed, among all: how many are less. Characters are compared with
    their types. Seeds marked `single` are unlike all others."""
    symbol = 2 * t.astype(np.int64) + small
    bits = max(2, int(symbol.max(initial=0) + 1).bit_length())
    many = 62 // bits
    size = np.diff(at, append=len(t) - 1) + 1
    symbol = np.concatenate([symbol + 1, np.zeros(many, np.int64)])

    def word(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for j in range(k * many, (k + 1) * many):
            out = (out << bits) | np.where(j < size[which], symbol[np.minimum(at[which] + j, len(symbol) - 1)], 0)
        return out

    rank, which, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(which):
        w = word(which, k)
        order = np.lexsort((w, rank[which])) if k else np.argsort(w, kind="stable")
        o, r, w = which[order], rank[which[order]], w[order]
        new = np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])]
        group = np.r_[True, r[1:] != r[:-1]]
        here = np.arange(len(o))
        first = np.maximum.accumulate(np.where(group, here, 0))
        rank[o] = r + np.maximum.accumulate(np.where(new, here, 0)) - first
        starts = np.flatnonzero(new)
        many_of = np.repeat(np.diff(starts, append=len(o)), np.diff(starts, append=len(o)))
        k += 1
        which = o[(many_of > 1) & (size[o] > k * many)]
    if single is not None and single.any():
        order = np.lexsort((np.arange(len(at)), single, rank))
        r, s = rank[order], single[order]
        new = np.r_[True, (r[1:] != r[:-1]) | s[1:]]
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return rank


def _in_order(t: np.ndarray, small: np.ndarray, single: np.ndarray | None) -> np.ndarray:
    """The seeds in the order of their suffixes."""
    at = seeds_of(small)
    if len(at) < 2:
        return at
    rank = named(t, small, at, None if single is None else single[at])
    used = np.bincount(rank, minlength=len(at)) > 0
    if used.all():
        order = np.empty(len(at), np.int64)
        order[rank] = at
        return order
    return at[suffixes((np.cumsum(used) - 1)[rank])]


def suffixes(t: np.ndarray) -> np.ndarray:
    """All suffixes of a string of names 0, 1, ... in order: recursion, then induction with a list for each name, laid out one after
    the other."""
    n = len(t)
    small = types(t)
    seeds = _in_order(t, small, None)
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    out = np.zeros(n, np.int64)  # 0 also where nothing stands yet: nothing comes before the first suffix
    char = t[seeds]
    # Seeds stand at the ends of their lists, in order.
    later = np.bincount(char, minlength=len(counts))
    out[ends[char] - later[char] + np.arange(len(seeds)) - (np.cumsum(later) - later)[char]] = seeds
    flat = lambda x: array("i", x.astype(np.int32).tobytes())
    large_char, small_char = flat(np.append(np.where(small, -1, t), -1)), flat(np.append(np.where(small, t, -1), -1))  # the last is before the first suffix
    sa, starts, lasts = flat(out), flat(ends - counts), flat(ends - 1)
    c = large_char[n - 1]
    sa[starts[c]] = n - 1
    starts[c] += 1
    for i in sa:  # which fills up ahead
        c = large_char[i - 1]
        if c >= 0:
            k = starts[c]
            sa[k] = i - 1
            starts[c] = k + 1
    for i in reversed(sa):
        c = small_char[i - 1]
        if c >= 0:
            k = lasts[c]
            sa[k] = i - 1
            lasts[c] = k - 1
    return np.frombuffer(sa, np.int32).astype(np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in an order with the one before it, up to CAP, by eight bytes at a time."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([t, np.zeros(CAP + 16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    live = np.arange(1, len(order))
    for k in range(0, CAP + 1, 8):
        a, b = order[live - 1] + k, order[live] + k
        x = eight[np.minimum(a, len(eight) - 1)] ^ eight[np.minimum(b, len(eight) - 1)]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live] += same
        live = live[x == 0]
        if not len(live):
            break
    return np.minimum(out, CAP).astype(np.uint8)


class _Least:
    """Least values of ranges of an array of small numbers."""

    def __init__(self, v: np.ndarray, longest: int):
        self.rows = [v]
        while 2 << (len(self.rows) - 1) <= longest:
            step = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the ranges from a to b, both included."""
        level = np.log2(b - a + 1).astype(np.int64)
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][a[m]], self.rows[k][b[m] - (1 << int(k)) + 1])
        return out


class _Bucket:
    """What the suffixes of one character push, popped in blocks in ascending (up) or descending order."""

    def __init__(self, t: np.ndarray, c: int, up: bool, to: Queues):
        self.t, self.c, self.up, self.to = t, c, up, to
        self.since = np.zeros(256, np.uint8)  # the least common prefix since the last push for a character

    def pushed(self, place: np.ndarray, common: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Pushes for other characters; returns what is pushed for the bucket's own, if `own`."""
        before = place - 1
        d = self.t[before]  # of place 0 it's the last character; left out below
        ok = (d > self.c) if self.up else (d < self.c)
        if own:
            ok |= d == self.c
        ok &= before >= 0
        idx = np.flatnonzero(ok)
        least, out = common.min(), None
        since = np.minimum(self.since, least)
        if len(idx):
            order = np.argsort(d[idx], kind="stable")
            idx = idx[order]
            dd = d[idx]
            first = np.r_[True, dd[1:] != dd[:-1]]
            gap = np.r_[1, idx[1:] - idx[:-1]]
            value = np.empty(len(idx), np.uint8)
            f = np.flatnonzero(first)
            value[f] = np.minimum(self.since[dd[f]], np.minimum.accumulate(common)[idx[f]])
            rest = np.flatnonzero(~first)
            if len(rest):
                value[rest] = _Least(common, int(gap[rest].max())).of(idx[rest - 1] + 1, idx[rest])
            value = np.minimum(value, CAP - 1) + np.uint8(1)
            ends = np.r_[f[1:], len(idx)]
            after = np.r_[np.minimum.accumulate(common[::-1])[::-1], CAP].astype(np.uint8)
            since[dd[f]] = after[idx[ends - 1] + 1]
            for a, b in zip(f.tolist(), ends.tolist()):
                part = before[idx[a:b]], value[a:b]
                if dd[a] == self.c:
                    out = part
                else:
                    self.to.push(int(dd[a]), *part)
        self.since = since
        return out


def _run(t: np.ndarray, place: int, c: int) -> int:
    """How often c stands from a place on, up to CAP."""
    part = t[place : place + CAP]
    other = np.flatnonzero(part != c)
    return int(other[0]) if len(other) else len(part)


def sorted_suffixes(text: np.ndarray, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of bytes in descending order, in blocks: places and common prefixes, up to CAP, with the suffix given before. Longer common
    prefixes than the distance to the next separator mean nothing."""
    if not len(text):
        return
    t = text + np.uint8(1)  # separators are 0
    small = types(t)
    # A substring of a seed that holds a separator is unlike all others, so that nothing behind one is compared.
    at = seeds_of(small)
    single = np.zeros(len(t), bool)
    holds = np.concatenate([[0], np.cumsum(t == 0)])
    single[at] = holds[np.minimum(np.append(at[1:], len(t) - 1) + 1, len(t))] > holds[at]
    seeds = _in_order(t, small, single)
    # Seeds of one character stand together but for separators, whose order does not matter: a stable sort keeps all others.
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    shared, cut = common_prefixes(t, seeds), np.searchsorted(t[seeds], np.arange(257))

    large, queue = Queues(memory), Queues(memory)
    queue.push(int(t[-1]), np.array([len(t) - 1]), np.zeros(1, np.uint8))
    last = -1
    for c in range(256):
        bucket, last, now, k = _Bucket(t, c, True, queue), -1, queue.pop(c), 1
        while now:
            more = []
            for place, common in now:
                if last < 0:
                    common[0] = 0
                last = int(place[-1])
                large.push(c, place, common)
                if (own := bucket.pushed(place, common, True)) is not None:
                    more.append(own)
            if more:  # each of these has one more of the character than those before
                more[0][1][0] = min(k, CAP)
            now, k = more, k + 1
        for a in range(cut[c], cut[c + 1], BLOCK):
            b = min(a + BLOCK, cut[c + 1])
            common = shared[a:b].copy()
            if a == cut[c]:
                common[0] = min(_run(t, last, c), _run(t, int(seeds[a]), c)) if last >= 0 else 0
            bucket.pushed(seeds[a:b], common, False)

    queue = Queues(memory)
    for c in range(255, -1, -1):
        bucket, last, now, k = _Bucket(t, c, False, queue), -1, queue.pop(c), 1
        while now:
            more = []
            for place, common in now:
                if last < 0:
                    common[0] = 0
                last = int(place[-1])
                if (own := bucket.pushed(place, common, True)) is not None:
                    more.append(own)
                yield place, common
            if more:
                more[0][1][0] = min(k, CAP)
            now, k = more, k + 1
        follow = -1
        for place, common in large.pop(c, backwards=True):
            if follow < 0:
                follow = min(_run(t, last, c), _run(t, int(place[-1]), c)) if last >= 0 else 0
            own = np.r_[follow, common[:0:-1]].astype(np.uint8)
            follow = int(common[0])
            bucket.pushed(place[::-1], own, False)
            yield place[::-1], own


def repeats(text: np.ndarray, length: int, memory: int) -> np.ndarray:
    """For each place whether the `length` bytes from it start elsewhere too; places nearer to a separator than that mean nothing."""
    out = np.zeros(len(text), bool)
    before = -1
    for place, common in sorted_suffixes(text, memory):
        at = np.flatnonzero(common >= length)
        out[place[at]] = True
        out[place[at[at > 0] - 1]] = True
        if len(at) and at[0] == 0:
            out[before] = True
        before = int(place[-1])
    return out
