"""Extreme-value fits over exceedances, weights, thresholds and the pooled tail value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import clamp, gain, gain_slope
from tidegauge.sources.shared import written

from .order import affine_scan, numbered

#: Batches whose buffers one task looks up; it reads `keep` more.
SPAN = 4096
SHAPE_MIN, SHAPE_MAX, EPS = -1.5, 0.7, 1e-8


def exceedances(df: DataFrame, value: str, threshold: Column | float, cap: float | None = None) -> DataFrame:
    """e: how far values lie above a threshold, strictly, with an optional cap."""
    e = F.col(value) - threshold
    return df.withColumn("e", clamp(e, hi=cap)).where(e > 0)


def ranked(df: DataFrame, by: str, e: str = "e", ties: tuple[str, ...] = ()) -> DataFrame:
    """i (1 is the smallest), n and t = (n - i) / (n - 1) within each group; rows of a group may span many tasks."""
    df = numbered(df, by, [e, *ties])
    return df.withColumn("t", F.try_divide((F.col("n") - F.col("i")).cast("double"), (F.col("n") - 1).cast("double")))


def moments(df: DataFrame, by: str, e: str = "e") -> DataFrame:
    """n, a0 = mean(e), a1 = mean(t * e): probability weighted moments for groups of two or more.

    Values are first reduced to their counts. For the j-th distinct value v with c copies and b smaller values, the sum of t
    over its copies is c * (n - b - (c + 1) / 2) / (n - 1); so ties are summed without ranking rows. Distinct values are dealt by ranges of
    (group, value), so a group spans many tasks: a task sums with the b that it knows of itself, and what lies below it is corrected
    afterwards from three sums for each task and group.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(by, F.col(e).cast("double").alias("v")).agg(F.count("*").alias("c"))
    x = counts.repartitionByRange(tasks, by, "v").withColumn("_task", F.spark_partition_id())
    below = F.coalesce(F.sum("c").over(Window.partitionBy(by, "_task").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("b", below + (F.col("c") + 1) / 2.0).groupBy(by, "_task").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.col("c") * F.col("v") * F.col("b")).alias("p"))
    w = Window.partitionBy(by)  # a row for each task
    ahead = F.coalesce(F.sum("k").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("n", F.sum("k").over(w)).withColumn("q", (F.col("n") - ahead) * F.col("s") - F.col("p"))
    out = x.groupBy(by).agg(F.max("n").alias("n"), (F.sum("s") / F.max("n")).alias("a0"), (F.sum("q") / F.max(F.when(F.col("n") > 1, F.col("n") - 1)) / F.max("n")).alias("a1"))
    return out.where("n >= 2")


def fit(m: DataFrame, shape_min: float = SHAPE_MIN, shape_max: float = SHAPE_MAX) -> DataFrame:
    """shape, scale, shape_raw, degenerate, clamped in closed form from n, a0, a1. The scale is not fitted again after clamping."""
    d = F.col("a0") - 2.0 * F.col("a1")
    m = m.withColumn("_d", d)
    raw = 2.0 - F.try_divide("a0", "_d")
    scale = F.try_divide(2.0 * F.col("a0") * F.col("a1"), F.col("_d"))
    bad = (F.col("_d") <= EPS * F.greatest("a0", F.lit(1.0))) | (F.col("a0") <= EPS) | (F.coalesce(scale, F.lit(0.0)) <= 0)
    m = m.withColumn("degenerate", bad).withColumn("shape_raw", F.when(~bad, raw))
    m = m.withColumn("shape", F.when(bad, 0.0).otherwise(clamp(raw, shape_min, shape_max)))
    m = m.withColumn("scale", F.when(bad, F.col("a0")).otherwise(scale))
    return m.withColumn("clamped", F.coalesce(F.col("shape") != F.col("shape_raw"), F.lit(False))).drop("_d")


def _log_ratio(p: float, alpha: float) -> float:
    if alpha <= 0 or alpha >= p or p > 1:
        raise ValueError(f"the level's probability {alpha} must lie between 0 and the threshold's, {p}, which is 1 at most")
    return math.log(p / alpha)


def return_level(threshold: Column, p: float, alpha: float) -> Column:
    """The level exceeded with probability alpha, for a threshold exceeded with probability p, from columns shape and scale."""
    return threshold + F.col("scale") * gain("shape", _log_ratio(p, alpha))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sensitivity(p: float, alpha: float, shape_path: bool = True, floor: float | None = 0.0, t: Column | str = "t") -> Column:
    """Derivative of the return level by each ordered exceedance, from t, the column n and a fit."""
    r = _log_ratio(p, alpha)
    a0, a1, t, n = F.col("a0"), F.col("a1"), _col(t), F.col("n")
    d = a0 - 2.0 * a1
    front = F.try_divide(F.lit(2.0), n * d * d)
    w = gain("shape", r) * front * (a0 * a0 * t - 2.0 * a1 * a1)
    if shape_path:
        w = w + F.when(F.col("clamped"), 0.0).otherwise(F.col("scale") * gain_slope("shape", r) * front * (a1 - a0 * t))
    w = F.when(F.col("degenerate"), F.lit(r) / n).otherwise(w)
    return clamp(w, lo=floor)


def top_share(p: float, alpha: float, i: Column | str = "i") -> Column:
    """1 / m on the m largest exceedances, m = max(1, round half-even of n * alpha / p); from i and the column n."""
    m = F.greatest(F.lit(1.0), F.rint(F.col("n") * F.lit(alpha / p)))
    return F.when(_col(i) > F.col("n") - m, 1.0 / m).otherwise(0.0)


def uniform() -> Column:
    return F.lit(1.0) / F.col("n")


def weight(mode: str, p: float, alpha: float, i: Column | str = "i", t: Column | str = "t") -> Column:
    """The weight of an exceedance by mode: gpd, cvar or ohem."""
    if mode not in ("gpd", "cvar", "ohem"):
        raise ValueError(f"no weights for mode {mode!r}")
    return {"gpd": lambda: sensitivity(p, alpha, t=t), "cvar": lambda: top_share(p, alpha, i), "ohem": uniform}[mode]()


def normalised(df: DataFrame, by: str, w: str = "w") -> DataFrame:
    """Weights that sum to 1 in each group; NULL where their sum is not positive."""
    total = df.groupBy(F.col(by).alias("_by")).agg(F.sum(w).alias("_total"))
    x = df.join(total, df[by].eqNullSafe(total["_by"]))
    return x.withColumn(w, F.when(F.col("_total") > 0, F.col(w) / F.col("_total"))).drop("_by", "_total")


def batches(df: DataFrame, by: str, order: list[str], size: int = 16) -> DataFrame:
    """batch: number of the batch of `size` rows, in order, within each group."""
    return numbered(df, by, order).withColumn("batch", F.floor((F.col("i") - 1) / size).cast("long")).drop("i", "n")


def sliding_threshold(df: DataFrame, by: str, value: str = "d", p: float = 0.15, keep: int = 32, least: int = 128) -> DataFrame:
    """by, batch, n_buffer, q: quantile 1 - p of the last `keep` batches before each batch, NULL with fewer than `least` values.

    A batch is one row with its values, so a frame is at most `keep` rows and no value of the batch itself is in it. Windows run
    over SPAN batches, each with the `keep` before it, so a group's batches spread over tasks.
    """
    if keep > SPAN:
        raise ValueError(f"keep is above {SPAN}")
    rows = df.groupBy(by, "batch").agg(F.collect_list(value).alias("v"))
    span = lambda k: F.floor(k / SPAN).cast("long")
    rows = rows.withColumn("_span", F.explode(F.array_distinct(F.array(span(F.col("batch")), span(F.col("batch") + keep)))))
    w = Window.partitionBy(by, "_span").orderBy("batch").rangeBetween(-keep, -1)
    rows = rows.withColumn("_before", F.collect_list("v").over(w)).where(F.col("_span") == span(F.col("batch")))
    rows = rows.select(by, "batch", F.sort_array(F.flatten("_before")).alias("buf"))
    at = (F.size("buf") - 1) * F.lit(1 - p)
    lo, hi = F.get("buf", F.floor(at).cast("int")), F.get("buf", F.ceil(at).cast("int"))
    q = F.when(F.size("buf") >= least, lo + (hi - lo) * (at - F.floor(at)))
    return rows.select(by, "batch", F.size("buf").cast("long").alias("n_buffer"), q.alias("q"), "buf")


def smoothed(df: DataFrame, by: str, momentum: float = 0.05) -> DataFrame:
    """by, batch, q, u: u is q the first time q is there, then (1 - momentum) * u + momentum * q, along the batches 0, 1, ... of
    each group. A batch is the map u -> a * u + b, and the maps are scanned in blocks."""
    rows = written(df.select(by, "batch", "q"), "quantiles")
    first = rows.where("q IS NOT NULL").groupBy(F.col(by).alias("_by")).agg(F.min("batch").alias("_first"))
    x = rows.join(first, rows[by].eqNullSafe(first["_by"]))
    begins, there = F.col("batch") == F.col("_first"), F.col("q").isNotNull()
    x = x.select(by, "batch", F.when(begins, 0.0).when(there, 1 - momentum).otherwise(1.0).alias("a"), F.when(begins, F.col("q")).when(there, momentum * F.col("q")).otherwise(0.0).alias("b"))
    u = affine_scan(x, by, "batch", "a", "b").select(F.col(by).alias("_by"), F.col("at").alias("_at"), F.col("x").alias("u"))
    some = rows.where("q IS NOT NULL")
    return some.join(u, some[by].eqNullSafe(u["_by"]) & (some["batch"] == u["_at"])).select(by, "batch", "q", "u")


def warm_up(step: Column | str, total: int, lam: float = 0.3, fraction: float = 0.2, active: bool = True) -> Column:
    s = F.col(step) if isinstance(step, str) else step
    if not active:
        return F.lit(0.0)
    return F.lit(lam) if fraction * total <= 0 else F.lit(lam) * F.least(F.lit(1.0), s / F.lit(fraction * total))


def step_rate(epoch: Column | str, rate: float, decay: float, every: int) -> Column:
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.lit(rate) * F.pow(F.lit(decay), F.floor(e / every))
