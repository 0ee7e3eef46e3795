import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import numeric
from tidegauge.operators import duplicates, grid, manifest, order, paired, tail


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_t_quantiles_match_tables():
    assert numeric.t_quantile_value(0.975, 2) == pytest.approx(4.302652729911275, abs=1e-9)
    assert numeric.t_quantile_value(0.975, 3) == pytest.approx(3.18245, abs=1e-5)
    assert numeric.t_quantile_value(0.975, 9) == pytest.approx(2.26216, abs=1e-5)


def test_t_p_value_inverts_the_quantile(spark):
    for df in (1, 2, 3, 8, 9):
        q = numeric.t_quantile_value(0.975, df)
        assert value(spark, numeric.t_two_sided_p(F.lit(q), F.lit(df))) == pytest.approx(0.05, abs=1e-8)


def test_gain_series_meets_closed_form(spark):
    for x in (1e-3, 9.9e-3, 1.01e-2, 2e-2, -5e-3):
        assert value(spark, numeric.expm1_ratio(F.lit(x))) == pytest.approx(math.expm1(x) / x, rel=1e-11)
        assert value(spark, numeric.expm1_ratio_slope(F.lit(x))) == pytest.approx(((x - 1) * math.exp(x) + 1) / x**2, rel=1e-8)


def boxes(spark, pred, gt):
    f = lambda m: [bool(v) for v in np.asarray(m).ravel()]
    return grid.binary_scores(grid.confusion(spark.createDataFrame([(f(pred), f(gt))], "pred array<boolean>, gt array<boolean>")))


def test_shifted_boxes(spark):
    a, b = np.zeros((64, 64)), np.zeros((64, 64))
    a[10:30, 10:30] = 1
    b[12:32, 12:32] = 1
    r = boxes(spark, a, b).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (324, 76, 76, 64 * 64 - 476)
    assert r.dice == pytest.approx(2 * 324 / 800)


def test_empty_masks(spark):
    z, o = np.zeros((4, 4)), np.ones((4, 4))
    r = boxes(spark, z, z).first()
    assert r.dice == r.iou == 1 and r.recall is None and r.precision is None
    r = boxes(spark, o, z).first()
    assert r.dice == 0 and r.recall is None and r.precision == 0 and r.gt_empty


def test_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    p, g = rng.random(144), rng.random(144) < 0.4
    q = np.rint((p - p.min()) / (p.max() - p.min() + 1e-8) * 255)
    dice = np.mean([2 * ((q >= k) & g).sum() / max(1, (q >= k).sum() + g.sum()) for k in range(256)])
    df = spark.createDataFrame([(p.tolist(), g.tolist())], "prob array<double>, gt array<boolean>")
    assert grid.threshold_sweep(df).first()["dice_sweep"] == pytest.approx(dice, abs=1e-9)


def test_hd95_of_empty_and_equal(spark):
    z, o = [False] * 16, [True] * 6 + [False] * 10
    rows = spark.createDataFrame([(1, z, z), (2, o, z), (3, o, o)], "id int, pred array<boolean>, gt array<boolean>")
    got = {r.id: r.hd95 for r in grid.hd95(rows, 4, 4).collect()}
    assert got == {1: 0.0, 2: pytest.approx(math.hypot(4, 4)), 3: 0.0}


def test_fit_recovers_parameters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, (xi, beta) in enumerate([(0.0, 1.0), (0.3, 2.0), (-0.3, 1.5)]):
        u = rng.random(20_000)
        e = -beta * np.log(u) if xi == 0 else beta * (u**-xi - 1) / xi
        rows += [(g, float(x)) for x in e]
    got = {r.g: r for r in tail.fit(tail.moments(spark.createDataFrame(rows, "g int, e double"), "g")).collect()}
    for g, (xi, beta) in enumerate([(0.0, 1.0), (0.3, 2.0), (-0.3, 1.5)]):
        assert got[g]["shape"] == pytest.approx(xi, abs=0.05) and got[g]["scale"] == pytest.approx(beta, rel=0.06)


def test_moments_with_ties_and_degenerate(spark):
    e = [0.0, 1.0, 1.0, 1.0, 2.0, 5.0]
    n = len(e)
    t = [(n - i) / (n - 1) for i in range(1, n + 1)]
    df = spark.createDataFrame([("a", x) for x in e] + [("z", 0.0)] * 20, "g string, e double")
    got = {r.g: r for r in tail.fit(tail.moments(df, "g")).collect()}
    assert got["a"].a1 == pytest.approx(sum(a * b for a, b in zip(t, e)) / n)
    assert got["z"].degenerate and got["z"]["shape"] == 0.0


def test_weights_are_the_derivative(spark):
    rng = np.random.default_rng(5)
    e = np.sort(-np.log(rng.random(60)))
    p, alpha = 0.15, 0.02

    def level(x):
        df = spark.createDataFrame([("g", float(v)) for v in x], "g string, e double")
        return tail.fit(tail.moments(df, "g")).select(tail.return_level(F.lit(0.0), p, alpha).alias("q")).first()["q"]

    df = spark.createDataFrame([("g", float(v)) for v in e], "g string, e double")
    r = tail.ranked(df, "g").join(tail.fit(tail.moments(df, "g")).drop("n"), "g")
    w = {x.i: x.w for x in r.select("i", tail.sensitivity(p, alpha, floor=None).alias("w")).collect()}
    for i in (5, 40, 60):
        up = e.copy()
        up[i - 1] += 1e-5
        assert w[i] == pytest.approx((level(up) - level(e)) / 1e-5, rel=1e-3, abs=1e-6)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.5), ("e", None)], "dataset string, p double")
    got = {r.dataset: r.p_holm for r in paired.holm(df).collect()}
    assert got["a"] == pytest.approx(0.004) and got["b"] == pytest.approx(0.06) and got["c"] == pytest.approx(0.08) and got["d"] == 0.5 and got["e"] is None


def test_t_interval_degenerate_never_significant(spark):
    means = spark.createDataFrame([("same", s, 0.5, 0.51) for s in range(3)] + [("one", 0, 0.1, 0.2)], "dataset string, seed int, a double, b double")
    got = {r.dataset: r for r in paired.t_intervals(means).collect()}
    assert got["same"].degenerate and got["same"].p is None and got["same"].lo == got["same"].hi
    assert got["one"].degenerate and got["one"].hi == math.inf


def test_bands_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(1)
    base = rng.random((5, 64))
    rows = [(k % 3, k, [float(x) for x in base[k % 5] + rng.normal(0, 0.03 * (k % 7), 64)]) for k in range(60)]
    h = spark.createDataFrame(duplicates.grid_hashes(spark.createDataFrame(rows, "split int, id int, values array<double>")).drop("values").collect())
    a, b = (sorted(map(tuple, f(h, 8).collect())) for f in (duplicates.flagged, duplicates.flagged_all_pairs))
    assert a == b and a


def test_bands_meet_fewer_than_all_pairs(spark):
    rng = np.random.default_rng(4)
    n = 1500
    bits = rng.integers(0, 2**32, (n, 6), dtype=np.uint64)
    for k in range(0, 60, 2):  # a near copy: eight bits of each hash
        for j in range(0, 6, 2):
            flip = rng.choice(64, 8, replace=False)
            lo, hi = (sum(1 << int(x) % 32 for x in flip if (x >= 32) == high) for high in (False, True))
            bits[k + 1, j], bits[k + 1, j + 1] = bits[k, j] ^ np.uint64(lo), bits[k, j + 1] ^ np.uint64(hi)
    names = [f"{h}_{p}" for h in duplicates.HASHES for p in ("lo", "hi")]
    h = spark.createDataFrame([(0, i, *map(int, row)) for i, row in enumerate(bits)], "split int, id int, " + ", ".join(f"{c} long" for c in names))
    cut, chosen = duplicates.bands(8)
    assert sum(size for _, size in cut) == 64 and len(cut) == 11 and len(chosen) == 165
    met = duplicates.candidates(h.withColumn("_n", F.col("id").cast("long")), 8).count()
    assert met < 0.01 * n * (n - 1) / 2
    assert {(r.id_a, r.id_b) for r in duplicates.flagged(h, 8).collect()} == {(k, k + 1) for k in range(0, 60, 2)}


def test_hashes_of_a_larger_image_and_of_its_resized_copy(spark):
    rng = np.random.default_rng(7)
    image, other = (np.kron(255 * rng.random((6, 6)), np.ones((8, 10))) for _ in "ab")
    small = image.reshape(24, 2, 30, 2).mean((1, 3))
    f = lambda m: [float(v) for v in m.ravel()]
    a = duplicates.grid_hashes(spark.createDataFrame([(0, f(image)), (1, f(other))], "id int, values array<double>"), h=48, w=60).drop("values")
    b = duplicates.grid_hashes(spark.createDataFrame([(2, f(small))], "id int, values array<double>"), h=24, w=30).drop("values")
    v = {r.id: [r[f"{h}_{p}"] for h in "adp" for p in ("lo", "hi")] for r in a.unionByName(b).collect()}
    d = lambda i, j: [sum((v[i][k] ^ v[j][k]).bit_count() for k in (2 * h, 2 * h + 1)) for h in range(3)]
    assert max(d(0, 2)) <= 8 and min(d(0, 1)) > 8
    assert all(abs(sum(row) - 1) < 1e-12 for row in duplicates.resampling(60, 9)) and duplicates.resampling(8, 8) == [[float(i == k) for k in range(8)] for i in range(8)]


def test_numbers_and_running_values_of_large_groups(spark, monkeypatch):
    rows = [("a", 37 * k % 1000) for k in range(1000)] + [("b", k) for k in range(3)] + [(None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = sorted(((r.g or "", r.k, r.i, r.n) for r in order.numbered(df, "g", ["k"]).collect()))
    assert got == sorted([("a", k, k + 1, 1000) for k in range(1000)] + [("b", k, k + 1, 3) for k in range(3)] + [("", 4, 1, 2), ("", 5, 2, 2)])
    monkeypatch.setattr(order, "SIZE", 7)
    rng = np.random.default_rng(6)
    a, b = rng.random(400), rng.random(400)
    x, want = 0.0, []
    for p, q in zip(a, b):
        x = p * x + q
        want.append(x)
    df = spark.createDataFrame([("g", k, float(a[k]), float(b[k])) for k in range(400)], "g string, k long, a double, b double").repartition(4)
    assert [r.x for r in order.affine_scan(df, "g", "k", "a", "b").orderBy("at").collect()] == pytest.approx(want, rel=1e-12)
    keys = spark.createDataFrame([(k,) for k in range(3000)], "k int").withColumn("d", F.md5(F.col("k").cast("string").cast("binary")))
    some = [r.k for r in order.smallest(keys, 700, [F.col("d"), F.col("k")]).collect()]
    assert sorted(some) == sorted(r.k for r in keys.orderBy("d", "k").limit(700).collect()) and order.smallest(keys, 5000, [F.col("d")]).count() == 3000


def test_runs_that_do_not_match_are_errors(spark):
    r = lambda rows: spark.createDataFrame(rows, "dataset string, arm string, seed int, stem string, value double")
    good = [("d", a, s, x, 0.5) for a in "ab" for s in (0, 1) for x in "pq"]
    paired.validate(r(good))
    with pytest.raises(ValueError, match="same seeds"):
        paired.validate(r([x for x in good if not (x[1] == "b" and x[2] == 1)]))
    with pytest.raises(ValueError, match="no stem in common"):
        paired.validate(r([x for x in good if (x[3] == "p") == (x[1] == "a")]))
    with pytest.raises(ValueError):
        paired.said(paired.compare(r(good)), "odd")


def comparison(spark, **values):
    rows = [(d, 3, m, lo, hi, m + 0.5, 0.5, False, lo - 0.1, hi + 0.1) for d, (m, lo, hi) in values.items()]
    return spark.createDataFrame(rows, "dataset string, n long, mean double, lo double, hi double, b_mean double, a_mean double, degenerate boolean, image_bootstrap_lo double, image_bootstrap_hi double")


def test_verdict_by_interval(spark):
    first = comparison(spark, etis=(-0.01, -0.05, 0.03), other=(-0.05, -0.08, -0.02), third=(0.2, 0.1, 0.3))
    second = comparison(spark, other=(0.1, 0.05, 0.15), third=(0.0, -0.1, 0.1))
    tails = spark.createDataFrame([("etis", 0.01)], "dataset string, drop double")
    got = {r.criterion: (r.triggered, r.evaluated) for r in paired.verdict(first, tails, "etis", ["other", "third"], second).collect()}
    assert got == {"no_target_gain": (True, True), "no_external_difference": (False, True), "falls_while_pool_rises": (True, True), "rejected": (True, True)}
    got = {r.criterion: r for r in paired.verdict(first, tails, "etis", ["other", "third"], second, interval="image_bootstrap").collect()}
    assert got["no_external_difference"].triggered and not got["falls_while_pool_rises"].triggered and got["rejected"].detail == "read at image_bootstrap"
    assert got["no_target_gain"].detail == "-0.0100 [-0.1500, +0.1300]; drop +0.0100"
    enough = spark.createDataFrame([("etis", 0.05)], "dataset string, drop double")
    got = {r.criterion: (r.triggered, r.evaluated) for r in paired.verdict(first, enough, "etis", ["none"], second).collect()}
    assert got["no_target_gain"] == (False, True) and got["no_external_difference"] == (False, False) and not got["rejected"][1]
    said = [r.note for r in paired.notes(first.withColumn("degenerate", F.col("dataset") == "other"), "absent", ["none"], second).collect()]
    assert len(said) == 4 and "other" in said[0] and any("absent" in x for x in said)


def test_all_metrics_check_the_shape(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.4, 0.1], [True, True, False, False])], "prob array<double>, gt array<boolean>")
    r = grid.all_metrics(df, 2, 2).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.dice, r.hd95) == (2, 0, 0, 2, 1.0, 0.0) and r.dice_sweep > 0.5
    with pytest.raises(Exception, match="maps of 4 and 4 cells"):
        grid.all_metrics(df, 3, 2).collect()


def test_gaps(spark):
    rows = [("a", k) for k in (1, 2, 5, 6, 9)] + [("b", 7)] + [("c", k) for k in (1, 2, 3, None)] + [("d", k) for k in (0, 200_000)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {r.g: (r.lo, r.hi, r.n_missing, r.n_runs, r.contiguous) for r in manifest.numeric_gaps(df, "g", "k").collect()}
    assert got == {"a": (1, 9, 4, 2, False), "b": (7, 7, 0, 0, True), "c": (1, 3, 0, 0, True), "d": (0, 200_000, 199_999, 1, True)}
    assert sorted((r.g, r.missing) for r in manifest.missing_numbers(df, "g", "k").collect()) == [("a", 3), ("a", 4), ("a", 7), ("a", 8)]


def test_manifest_verify(spark):
    old = spark.createDataFrame([("s", "a", "x"), ("s", "b", "y"), ("s", "c", "z z")], "split string, stem string, text string")
    new = spark.createDataFrame([("s", "b", "Y"), ("s", "c", "q"), ("s", "d", "n")], "split string, stem string, text string")
    got = {r.stem: r.status for r in manifest.verify(manifest.build(old, "split", "stem", "text"), manifest.build(new, "split", "stem", "text")).collect()}
    assert got == {"a": "missing", "b": "bytes", "c": "content", "d": "extra"}


def test_reconcile_resplit(spark):
    counts = spark.createDataFrame([("train", 80), ("held", 20), ("odd", 3)], "split string, n long")
    expected = spark.createDataFrame([("train", 100), ("gone", 5)], "split string, expected long")
    got = {r.split: r.status for r in manifest.reconcile(counts, expected, "train", "held").collect()}
    assert got == {"train": "re-split", "held": "held_out", "odd": "held_out", "gone": "missing"}


def brute_percentile(a, b):
    """The 95th percentile of the pooled surface distances by all pairs of surface cells."""
    edge = lambda m: [(y, x) for y, x in np.argwhere(m) if any(0 <= i < m.shape[0] and 0 <= j < m.shape[1] and not m[i, j] for i, j in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)))]
    if not a.any() or not b.any():
        return 0.0 if not a.any() and not b.any() else math.hypot(*a.shape)
    p, q = np.array(edge(a)).reshape(-1, 2), np.array(edge(b)).reshape(-1, 2)
    if not len(p) or not len(q):
        return None
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    return float(np.quantile(np.concatenate([d.min(1), d.min(0)]), 0.95))


def test_hd95_equals_all_pairs_of_surface_cells(spark):
    rng = np.random.default_rng(11)
    for h, w in ((1, 1), (1, 9), (7, 1), (9, 12), (16, 5)):
        maps = [rng.random((h, w)) < p for p in (0.0, 0.03, 0.1, 0.5, 0.9, 1.0) for _ in range(4)]
        pairs = [(a, b) for a in maps[::2] for b in maps[1::2]]
        flat = lambda m: [bool(v) for v in m.ravel()]
        df = spark.createDataFrame([(k, flat(a), flat(b)) for k, (a, b) in enumerate(pairs)], "id int, pred array<boolean>, gt array<boolean>").repartition(3)
        got = {r.id: r.hd95 for r in grid.hd95(df, h, w).collect()}
        for k, (a, b) in enumerate(pairs):
            want = brute_percentile(a, b)
            assert got[k] == (want if want is None else pytest.approx(want, abs=1e-9)), (h, w, k)
    odd = spark.createDataFrame([(0, None, [True]), (1, [True, False], [True]), (2, [False], [False])], "id int, pred array<boolean>, gt array<boolean>")
    assert {r.id: r.hd95 for r in grid.hd95(odd, 1, 1).collect()} == {0: None, 1: None, 2: 0.0}


def test_distances_of_a_full_size_map_take_linear_work():
    y, x = np.mgrid[:352, :352]
    a = ((y - 150) / 90) ** 2 + ((x - 170) / 60) ** 2 <= 1
    noise = np.random.default_rng(2).random((352, 352)) < 0.3
    for cells in (a, grid.surface(a[None])[0], noise, np.eye(352, dtype=bool), np.zeros((352, 352), bool), (y == 0) & (x == 351)):
        steps = []
        got = grid.squared_distances(cells[None], steps)[0]
        assert steps[0] <= 6 * cells.size
        for i, j in ((0, 0), (351, 351), (17, 300), (200, 200), (351, 0)):
            p = np.argwhere(cells)
            assert (got[i, j] == ((p - (i, j)) ** 2).sum(1).min()) if len(p) else got[i, j] >= 2**40
    small = grid.squared_distances(noise[None, :32, :32])[0]
    p = np.argwhere(noise[:32, :32])
    assert all(small[i, j] == ((p - (i, j)) ** 2).sum(1).min() for i in range(32) for j in range(32))


def test_hd95_of_full_size_maps(spark):
    y, x = np.mgrid[:352, :352]
    ball = lambda cy, cx, r: (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    pairs = [(ball(100, 100, 40), ball(110, 105, 44)), (ball(60, 300, 20) | ball(200, 50, 30), ball(60, 300, 25)), (ball(5, 5, 9), ball(340, 340, 9))]
    flat = lambda m: [bool(v) for v in m.ravel()]
    df = spark.createDataFrame([(k, flat(a), flat(b)) for k, (a, b) in enumerate(pairs)], "id int, pred array<boolean>, gt array<boolean>")
    got = {r.id: r.hd95 for r in grid.hd95(df, 352, 352).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == pytest.approx(brute_percentile(a, b), abs=1e-9)


def test_boundary_weights_of_full_size_maps(spark):
    y, x = np.mgrid[:352, :352]
    gt = ((y - 100) ** 2 + (x - 30) ** 2 <= 60**2) | (y > 340)
    for m, size in ((gt, 31), (gt[:9, :14], 5), (gt[:2, :3], 31)):
        h, w = m.shape
        df = spark.createDataFrame([(0, [bool(v) for v in m.ravel()]), (1, None), (2, [True])], "id int, gt array<boolean>")
        got = {r.id: r.bw for r in grid.boundary_weights(df, h, w, size=size).collect()}
        wide = np.pad(m.astype(float), size // 2)
        box = np.lib.stride_tricks.sliding_window_view(wide, (size, size)).mean((2, 3))
        assert np.allclose(np.array(got[0]).reshape(h, w), 1 + 5 * np.abs(box - m), atol=1e-12)
        assert got[1] is None and got[2] is None
    with pytest.raises(ValueError, match="odd"):
        grid.boundary_weights(df, 2, 3, size=4)
