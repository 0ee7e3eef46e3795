"""The audit of filters and the hard negatives against brute force: nulls, repeats, ties, empty tables, clashing columns."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import filter_audit, negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """By part: the failures of each row, and the counts of every step of every order."""
    fails, out = [], {}
    for i, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        bad = "".join(f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)) if x)
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((part or "", bad, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    for part in {f[0] for f in fails}:
        rows, shapley = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                early = lambda bad: any(x in bad for x in order[:k])  # noqa: B023, E731
                gone = [r for r in rows if f in r[1] and not early(r[1])]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not early(r[1]) and f not in r[1] for r in rows), len(gone), sum(f in r[1] and early(r[1]) for r in rows), sum(r[1] == f for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for part_, order, k in list(out):
            if part_ == part:
                out[part, order, k].append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_equals_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (2, long + " other", "en"), (None, long, "de"), (None, None, None), (3, None, "de"), (4, "", "de"),
        (5, " \t\n", "en"), (6, "a " * 400, "en"), (7, "WORDS IN CAPITALS # 1", "en"), (8, "é \U0001f600 \x1c 　" * 90, None), (9, long.upper(), "en"), (10, long + " | x", "de"),
        (11, long, "de"), (12, "w " * 199 + "w", "en"), (13, "Z" * 3 + "z" * 97, "en"), (14, "Z" * 4 + "z" * 96, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, 1, 1), (10, None, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(i, t, p, 1, "s", 2) for i, t, p in docs], "doc_id long, text string, lang string, bits int, digest string, n int").repartition(3)
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(df, tags).collect()}
    assert got == audited(docs, labels)
    assert filter_audit.audit(df.limit(0), tags).collect() == []
    only = filter_audit.audit(df.where("doc_id = 1"), tags.limit(0)).where("step = 1 AND filter_order = 'ABCDE'").first()
    assert (only.part, only.kept, only.good_lost) == ("en", 1, 0)


def test_filter_audit_gives_common_texts_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("tidegauge.llm.common.FEW", 5)
    docs = [(k, "same text" if k % 3 else f"text {k}", "en") for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == audited(docs, [])


def mined(rows):
    """rows (id, label, v): the negatives of each anchor, an id divisible by 10."""
    ok = [(i, x, v) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, x, [int(np.floor(256 * float(c))) for c in v] + [0] * (width - len(v))) for i, x, v in ok]
    out = Counter()
    for i, x, q in {(i, x, tuple(v)) for i, x, v in ok if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, y) for j, y, v in ok if j != i)
        for s, j, _ in [t for t in scored if t[2] == x][:5]:
            for rank, (n, other, _) in enumerate([t for t in scored if t[2] != x and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]):
                out[i, j, rank + 1, other, -s, -n] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in negatives.mine(negatives.vectors(df, F.col("vec_id") % 10 == 0)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, embedding array<float>, label int, cell int, d double"


@pytest.mark.parametrize("kind", ["clusters", "far", "ties"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    for name, value in (("PART", 40), ("BATCH", 7), ("BLOCK", 8), ("PIVOTS", 6)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 8))
    rows = []
    for k in range(300):
        v = {"clusters": middle[k % 5] + rng.normal(size=8) / 20, "far": rng.normal(size=8), "ties": rng.integers(-1, 2, 8) / 4.0}[kind]
        rows.append((k, [float(np.float32(c)) for c in v], k % 3 if kind != "ties" else int(rng.integers(0, 4))))
    rows += [(k, rows[0][1], 1) for k in range(400, 500)]  # one vector for a quarter of the rows
    rows += [(None, rows[0][1], 1), (10, None, 1), (20, rows[1][1], None), (30, [1.0, None, 2.0], 1), (40, [float("nan")] * 8, 1), (50, [float("inf")] + [0.0] * 7, 2), (60, rows[3][1], 0), (60, rows[3][1], 0), (60, rows[4][1], 2), (70, [], 1), (80, [0.5], 2), (91, [0.0] * 8, 2)]
    df = spark.createDataFrame([(i, v, x, 1, 0.5) for i, v, x in rows], SCHEMA).repartition(3)
    want = mined([(i, x, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, x in rows])
    assert want
    assert found(df) == want


def test_hard_negatives_of_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not found(empty)
    one = spark.createDataFrame([(10, [1.0, 2.0], 1, 0, 0.0)], SCHEMA)
    assert not found(one)
    none = spark.createDataFrame([(k, [float(k)], k % 2, 0, 0.0) for k in range(1, 9)], SCHEMA)
    assert not found(none)


def test_scores_are_exact_beyond_double_precision():
    q = np.array([[2**29 + 1, 3], [-(2**29), 1]])
    assert negatives.scores(q, q).tolist() == [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in q.tolist()] for x in q.tolist()]
    with pytest.raises(ValueError, match="fit a long"):
        negatives.scores(q * 2**20, q * 2**20)


def test_brackets_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(8, 16)) * 200
    v = np.floor(middle[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    p = negatives.Pivots(v[:500], float((v.astype(float) ** 2).sum(1).max()))
    d, q = p.distances(v), v[::100]
    dq, s = p.distances(q, True), negatives.scores(q, v)
    skipped = 0
    for c in np.unique(d.argmin(1)):
        own = d.argmin(1) == c
        least, most = p.bracket(q, dq, d[own].min(0), d[own].max(0))
        assert (s[:, own] >= least[:, None]).all() and (s[:, own] <= most[:, None]).all()
        skipped += own.sum() * (most < np.sort(s, 1)[:, -5]).sum()
    assert skipped > 0.5 * s.size  # most pairs need no exact score
