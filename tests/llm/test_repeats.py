"""Induced sorting and removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import common, induced, repeats


def test_suffixes_of_names_are_in_order():
    rng = random.Random(1)
    for _ in range(150):
        t = np.unique([rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randint(1, 60))], return_inverse=True)[1]
        assert induced.suffixes(t).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


@pytest.mark.parametrize("memory", [0, 60, 1 << 20])  # the queues go to disk at once, soon, never
@pytest.mark.parametrize("block", [3, 1 << 18])
def test_repeats_of_a_shard_equal_brute_force(monkeypatch, memory, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = random.Random(memory + block)
    for _ in range(60):
        base, passages = bytes(rng.choice(b"abcd" if rng.random() < 0.5 else b"ab") for _ in range(rng.randint(5, 80))), []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(len(base))
            passages.append(b"a" * rng.choice((0, 0, 30)) + base[a : rng.randint(a, len(base))] + bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 10))))
        text, length = b"\xff".join(passages) + b"\xff" * rng.randint(0, 2), rng.randint(1, 8)
        windows = [text[i : i + length] for i in range(len(text) - length + 1)]
        n, got = Counter(windows), induced.repeats(np.frombuffer(text, np.uint8), length, memory)
        assert [bool(got[i]) for i, w in enumerate(windows) if 255 not in w] == [n[w] > 1 for w in windows if 255 not in w]


def test_common_prefixes_of_neighbours_are_exact():
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(300)) * 2
    order, common_to = zip(*[(p, c) for place, common in induced.sorted_suffixes(np.frombuffer(text, np.uint8), 100) for p, c in zip(place.tolist(), common.tolist())])
    assert list(order) == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    for i, j, c in zip(order, order[1:], common_to[1:]):
        same = next((k for k, (x, y) in enumerate(zip(text[i:], text[j:])) if x != y), min(len(text) - i, len(text) - j))
        assert c == min(same, 255)


def removed(texts, length):
    """For each text the bytes that go."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((d, gone))
    return out


def compare(df, texts, length):
    want = Counter()
    for i, (d, gone) in zip(range(len(texts)), removed([t for _, t in texts], length)):
        spans = int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum())
        want[texts[i][0], len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.deduplicated(df, length=length).collect())
    assert got == want
    digest = Counter((r.doc_id, r.kept_sha256) for r in repeats.digests(df, length=length).collect())
    assert digest == Counter({(k[0], hashlib.sha256(k[4]).hexdigest()): v for k, v in want.items()})


SCHEMA = "doc_id long, text string, tag int, s string, n int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "s", 2) for i, t in texts], SCHEMA).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_removal_equals_brute_force(spark, monkeypatch, small):
    if small:  # anchors of more than 3 passages are split, shards and pieces are small, long texts go in parts
        for where, name, value in ((repeats, "FEW", 3), (repeats, "SHARD", 500), (repeats, "SEEN", 2), (common, "FEW", 2), (repeats, "MEMORY", 100)):
            monkeypatch.setattr(where, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    phrase, core = prose(9)[:40], prose(5)[:27]
    base = [prose(n) for n in (60, 200, 30, 300)]
    texts = [*base, None, "", "ab", base[0], base[0], base[1][:300] + "é😀" + base[1][301:], base[2] + base[2], "x" * 3000, "xy" * 200, base[3][100:900] + base[0]]
    texts += [prose(6) + phrase + prose(6) for _ in range(25)] + [prose(3) + core + prose(3) for _ in range(12)] + ["é" * 60 + prose(4), "漢字" * 30]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, base[2]), (3, base[2]), (None, base[0]), (None, prose(40))]
    for length in (24, 31):
        compare(frame(spark, rows), rows, length)


def test_long_texts_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(9)
    part = "".join(rng.choice("abcd") for _ in range(900))
    text = part + "".join(rng.choice("abcd") for _ in range(3000)) + part[100:500] + "e"
    compare(frame(spark, [(1, text)]), [(1, text)], 40)


def test_removal_of_small_tables(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert repeats.digests(empty).collect() == []
    compare(frame(spark, [(1, "abc" * 100), (2, "")]), [(1, "abc" * 100), (2, "")], 200)
    compare(frame(spark, [(1, "a b"), (2, None)]), [(1, "a b"), (2, None)], 200)
    for wrong in (0, 255):
        with pytest.raises(ValueError, match="length"):
            repeats.digests(empty, length=wrong)


def test_windows_in_runs_of_one_anchor(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 10, 700, 700, 3000])
    text, s, o, h = repeats.runs(data, offsets, 50)
    seen = {}
    for k in range(4):
        own = np.flatnonzero(text == k)
        n = max(0, offsets[k + 1] - offsets[k] - 49)
        assert (s[own][0] == 0 if n else not len(own))
        for r, e in zip(own, np.append(s[own][1:], n)):
            for w in range(s[r], e):  # equal windows have the same anchor at the same place
                window = bytes(data[offsets[k] + w : offsets[k] + w + 50])
                assert seen.setdefault(window, (h[r], s[r] + o[r] - w)) == (h[r], s[r] + o[r] - w)
    assert len(seen) > 2000
