"""The pooled tail value of each batch: its own exceedances with those of the batches before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.numeric import let

from . import tail


def pool_values(df: DataFrame, by: str, value: str = "d", p: float = 0.15, alpha: float = 0.02, keep: int = 32, least: int = 128, min_exceedances: int = 8, momentum: float = 0.05, mode: str = "gpd", cap: float | None = None, lam: float = 0.3, warmup_batches: float = 0.0, rescale_live: bool = True) -> DataFrame:
    """by, batch, u, n_live, n_pool, active, shape, scale, level, value, lam, loss, live_weight, n_live_active.

    The threshold of a batch is the smoothed quantile known before it. The pool is the exceedances of the batch and of the
    `keep` batches before it; value is the normalised sum of weights times exceedances, NULL unless there are enough of them, at
    least one of the batch itself, positive weights, and a positive lam. loss is lam * value. live_weight is the weight of the
    batch's own exceedances after normalising, times n_pool / n_live if they are rescaled; n_live_active of them have one. A pool
    is an array in its row, so fits and weights need no shuffle.
    """
    q = tail.sliding_threshold(df, by, value, p, keep, least)
    u = tail.smoothed(q, by, momentum).select(by, "batch", "u")
    live = df.groupBy(by, "batch").agg(F.collect_list(value).alias("live"))
    x = q.join(u, [by, "batch"]).join(live, [by, "batch"])

    def over(c: str, own: int) -> Column:
        e = F.transform(F.filter(c, lambda v: v > F.col("u")), lambda v: v - F.col("u"))
        return F.transform(e if cap is None else F.transform(e, lambda v: F.least(v, F.lit(float(cap)))), lambda v: F.struct(v.alias("e"), F.lit(own).alias("own")))

    x = x.select(by, "batch", "u", F.sort_array(F.concat(over("live", 1), over("buf", 0))).alias("pool"))
    x = x.withColumn("n", F.size("pool").cast("long")).withColumn("n_live", F.size(F.filter("pool", lambda v: v["own"] == 1)).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.col("n").cast("double")
    t = lambda k: F.coalesce(F.try_divide(n - k - 1, n - 1), F.lit(0.0))
    x = x.withColumn("a0", F.try_divide(total(F.transform("pool", lambda v: v["e"])), n))
    x = x.withColumn("a1", F.try_divide(total(F.transform("pool", lambda v, k: v["e"] * t(k))), n))
    x = tail.fit(x)
    weights = F.transform("pool", lambda v, k: F.struct(tail.weight(mode, p, alpha, k + 1, t(k)).alias("w"), v["e"].alias("e"), v["own"].alias("own")))
    own = lambda a: F.filter(a, lambda v: v["own"] == 1)
    sums = let(weights, lambda a: F.struct(total(F.transform(a, lambda v: v["w"])).alias("w"), total(F.transform(a, lambda v: v["w"] * v["e"])).alias("we"), total(F.transform(own(a), lambda v: v["w"])).alias("live"), F.size(F.filter(own(a), lambda v: v["w"] > 0)).cast("long").alias("used")))
    rate = F.lit(float(lam)) * (F.least(F.lit(1.0), F.col("batch") / F.lit(float(warmup_batches))) if warmup_batches > 0 else F.lit(1.0))
    x = x.withColumn("_s", sums).withColumn("lam", rate)
    ok = (F.col("n") >= min_exceedances) & (F.col("n_live") > 0) & (F.col("lam") > 0)
    active = F.coalesce(ok & (F.col("_s.w") > 0), F.lit(False))
    fitted = lambda c: F.when(ok, c) if mode == "gpd" else F.lit(None).cast("double")
    result = F.when(active, F.col("_s.we") / F.col("_s.w"))
    share = F.col("_s.live") / F.col("_s.w") * (F.col("n") / F.col("n_live") if rescale_live else F.lit(1.0))
    return x.select(
        by, "batch", "u", "n_live", F.col("n").alias("n_pool"), active.alias("active"), fitted(F.col("shape")).alias("shape"), fitted(F.col("scale")).alias("scale"),
        fitted(tail.return_level(F.col("u"), p, alpha)).alias("level"), result.alias("value"), "lam", F.when(active, F.col("lam") * result).otherwise(0.0).alias("loss"),
        F.when(active, share).alias("live_weight"), F.when(active, F.col("_s.used")).alias("n_live_active"),
    )
