"""Nearest rows and closest pairs by Hamming distance against brute force, and how many comparisons they make."""

import itertools

import numpy as np
import pytest

from tidegauge.operators import duplicates, hamming

NAMES = ("a", "d", "p")


def halves(v):
    return [v & 0xFFFFFFFF, v >> 32]


def near_copies(rng, n, flips, splits):
    """(split, id, hash): every third is new, the others are the one before with some bits flipped."""
    rows = []
    for i in range(n):
        v = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2)) if i % 3 == 0 else rows[-1][2] ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, flips + 1), replace=False))
        rows.append((i % splits, i, v))
    return rows


def brute_nearest(rows):
    out, splits = {}, {s for s, _, _ in rows}
    for s, i, v in rows:
        for t in splits:
            d = [(v ^ w).bit_count() for u, j, w in rows if u == t and j != i]
            out[s, i, t] = min(d) if d else None
    return out


def found_nearest(spark, rows, **more):
    h = spark.createDataFrame([(s, i, *halves(v)) for s, i, v in rows], "split int, id int, p_lo long, p_hi long")
    return {(r.split_a, r.id_a, r.split_b): r.d for r in hamming.nearest(h, "p", **more).collect()}


@pytest.mark.parametrize("lookup", [0.01, 1, 1000])  # by keys alone as far as they go, by both, by the grid alone
def test_nearest_equals_brute_force(spark, monkeypatch, lookup):
    monkeypatch.setattr(hamming, "LOOKUP", lookup)
    monkeypatch.setattr(hamming, "PART", 16)
    monkeypatch.setattr(hamming, "WORDS", 50)
    rows = near_copies(np.random.default_rng(5), 120, 12, 4) + [(0, 1000, 0), (0, 1001, 0), (1, 1002, 0), (9, 1003, 5)]
    work = []
    assert found_nearest(spark, rows, work=work) == brute_nearest(rows)
    assert (work[0] > 0) == (lookup < 1000)


def test_nearest_meets_each_two_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PART", 5)
    rows = near_copies(np.random.default_rng(15), 90, 12, 3) + [(0, 1000, 0), (0, 1001, 0), (9, 1003, 5)]
    seen, keep = [], hamming.written
    monkeypatch.setattr(hamming, "written", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    work = []
    assert found_nearest(spark, rows, work=work) == brute_nearest(rows)
    assert work[0] == 0 and hamming.rounds(100_000) == 0 and dict(seen)["packs"].count() > 3


def test_many_equal_keys_go_to_the_grid(spark, monkeypatch):
    monkeypatch.setattr(hamming, "LOOKUP", 0.1)
    rows = [(k % 2, k, (0xFFFFFFFFFF << 24 | k * 40503 & 0xFFFFFF)) for k in range(200)]  # one value in most bands
    work = []
    assert found_nearest(spark, rows, work=work) == brute_nearest(rows)
    nodes = 2 * 100 * 200
    assert sum(work) <= 2 * nodes and work[1] > 0.5 * nodes


def test_comparisons_of_nearest_grow_slower_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(hamming, "LOOKUP", 1)
    rng = np.random.default_rng(8)
    done = []
    for n in (500, 4000):
        v = [int(x) for x in rng.integers(0, 2**63, n // 2)]  # far from each other, each with a copy some bits away
        v += [x ^ sum(1 << int(k) for k in rng.choice(63, 4, replace=False)) for x in v]
        h = spark.createDataFrame([(0, i, *halves(x)) for i, x in enumerate(v)], "split int, id int, p_lo long, p_hi long")
        work = []
        assert {r.d for r in hamming.nearest(h, "p", work).collect()} <= {0, 1, 2, 3, 4}
        done.append(sum(work))
    assert done[1] < 20 * done[0] and done[1] < 0.15 * 4000**2  # the square would be 64 times


def brute_closest(rows, k):
    out = set()
    splits = sorted({r[0] for r in rows})
    for s, t in itertools.combinations(splits, 2):
        pairs = []
        for x in rows:
            for y in rows:
                if x[0] == s and y[0] == t:
                    d = [(a ^ b).bit_count() for a, b in zip(x[2], y[2])]
                    pairs.append((sum(d), x[1], y[1], *d))
        out |= {(s, t, place + 1, *p) for place, p in enumerate(sorted(pairs)[:k])}
    return out


def found_closest(spark, rows, k, **more):
    h = spark.createDataFrame([(s, i, *[x for v in hs for x in halves(v)]) for s, i, hs in rows], "split int, id int, " + ", ".join(f"{n}_{p} long" for n in NAMES for p in ("lo", "hi")))
    df = hamming.closest(h, NAMES, k, **more)
    return df, {(r.split_a, r.split_b, r.place, r.d_sum, r.id_a, r.id_b, r.d_a, r.d_d, r.d_p) for r in df.collect()}


def three(rng, n, splits, flips):
    return [(i % splits, i, [a, b, c]) for (_, i, a), (_, _, b), (_, _, c) in zip(*[near_copies(rng, n, flips, splits) for _ in range(3)])]


@pytest.mark.parametrize("lookup", [0.001, 1000])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_closest_equals_brute_force(spark, monkeypatch, lookup, k):
    monkeypatch.setattr(hamming, "LOOKUP", lookup)
    monkeypatch.setattr(hamming, "PART", 16)
    monkeypatch.setattr(hamming, "WORDS", 50)
    rows = three(np.random.default_rng(6), 90, 3, 3)
    rows += [(0, 1000 + i, rows[0][2]) for i in range(12)] + [(1, 2000 + i, rows[0][2]) for i in range(12)] + [(7, 3000, rows[3][2])]  # copies: ties by ids
    work = []
    df, got = found_closest(spark, rows, k, work=work)
    assert got == brute_closest(rows, k)
    if lookup == 1000:
        assert work[0] == 0
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


def test_closest_looks_at_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(hamming, "LOOKUP", 0.1)
    rng = np.random.default_rng(9)
    n = 3000
    bits = [[int(x) for x in rng.integers(0, 2**63, 3)] for _ in range(n)]
    for k in range(0, 60, 2):
        bits[k + 1] = [v ^ sum(1 << int(x) for x in rng.choice(63, 2, replace=False)) for v in bits[k]]
    rows = [(k % 2, k, b) for k, b in enumerate(bits)]
    work = []
    _, got = found_closest(spark, rows, 30, work=work)
    assert {g[4:6] for g in got} == {(k, k + 1) for k in range(0, 60, 2)}
    assert work[1] == 0 and work[0] < 0.1 * (n // 2) ** 2


def test_keys_have_as_many_bits_as_there_are_hashes():
    for n in (1, 100, 10_000, 10**6, 10**8):
        agree = duplicates.agreeing(n, 8)
        assert 64 * agree / (8 + agree) >= min(np.log2(n), 27) and (agree == 1 or 64 * (agree - 1) / (7 + agree) < np.log2(n))


@pytest.mark.parametrize("few", [4, 512])
@pytest.mark.parametrize("agree", [None, 1, 3])
def test_flagged_pairs_of_keys_that_many_share(spark, monkeypatch, few, agree):
    monkeypatch.setattr(duplicates, "FEW", few)
    monkeypatch.setattr(hamming, "PART", 16)
    rng = np.random.default_rng(12)
    rows = three(rng, 60, 2, 5)
    tone = [int(x) for x in rng.integers(0, 2**63, 3)]  # many images of one tone: close to each other in some bits
    rows += [(k % 2, 100 + k, [v ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for v in tone]) for k in range(60)]
    h = spark.createDataFrame([(s, i, *[x for v in hs for x in halves(v)]) for s, i, hs in rows], "split int, id int, " + ", ".join(f"{n}_{p} long" for n in NAMES for p in ("lo", "hi")))
    a, b = (sorted(map(tuple, df.collect())) for df in (duplicates.flagged(h, 8, agree), duplicates.flagged_all_pairs(h, 8)))
    assert a == b and len(a) > 500


def test_flagged_pairs_write_few_keys(spark, monkeypatch):
    rng, sizes = np.random.default_rng(3), []
    h = spark.createDataFrame([(0, i, *[int(x) for x in rng.integers(0, 2**32, 6)]) for i in range(300)], "split int, id int, " + ", ".join(f"{n}_{p} long" for n in NAMES for p in ("lo", "hi")))
    write = duplicates.written

    def counted(*more):
        sizes.append(write(*more))
        return sizes[-1]

    monkeypatch.setattr(duplicates, "written", counted)
    duplicates.flagged(h, 8)
    assert max(df.count() for df in sizes) <= 20 * 300 and duplicates.agreeing(2 * 10**6 // duplicates.FEW, 8) == 1


def test_audit_uses_the_searches(spark):
    assert duplicates.HASHES == NAMES
    h = spark.createDataFrame([], "split int, id int, " + ", ".join(f"{n}_{p} long" for n in NAMES for p in ("lo", "hi")))
    assert duplicates.nearest(h, "p").collect() == [] and duplicates.closest(h).collect() == []
