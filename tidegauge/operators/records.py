"""Records on their way in and out: splits, batches, fixtures, heads, flushed metrics, best checkpoints, checks of stored scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.sources.shared import written

from .order import numbered


def select_splits(df: DataFrame, splits: list[str], split: str = "split") -> DataFrame:
    """The rows of the splits; a split without rows is an error that lists those there are."""
    some = df.where(F.col(split).isin(*splits))
    have = {r[0] for r in some.select(split).distinct().collect()}  # at most the splits asked for
    if lost := [s for s in splits if s not in have]:
        known = sorted(str(r[0]) for r in df.select(split).distinct().limit(100).collect())
        raise KeyError(f"no split {lost}; there are {known}")
    return some


def with_extra(train: DataFrame, extra: DataFrame, splits: list[str], split: str = "split") -> DataFrame:
    """Training rows with those of further splits."""
    return train.unionByName(select_splits(extra, splits, split))


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """idx: 0-based place of each row by the order, which must be total."""
    x = numbered(df.withColumn("_all", F.lit(0)), "_all", order)
    return x.withColumn("idx", F.col("i") - 1).drop("_all", "i", "n")


def record_batches(df: DataFrame, order: list[str], size: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """batch and place (0-based): rows in order, or shuffled by seed and epoch; the last batch may be short."""
    if seed is not None:
        df = df.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), *[F.col(c).cast("string") for c in order]).cast("binary")))
        order = ["_key", *order]
    x = indexed(df, order)
    return x.withColumn("batch", F.floor(F.col("idx") / size).cast("long")).withColumn("place", (F.col("idx") % size).cast("int")).drop("idx", "_key")


def uniform(*keys) -> Column:
    """A number in [0, 1) that depends on the keys only: 52 bits of their MD5."""
    text = F.concat_ws("|", *[F.lit(k) if not isinstance(k, Column) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def normal(*keys) -> Column:
    """A standard normal number that depends on the keys only, from two uniform ones."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*keys, "r"))) * F.cos(F.lit(2 * math.pi) * uniform(*keys, "a"))


def fixture(spark: SparkSession, n: int, prefix: str, seed: int = 0, hard_frac: float = 0.25, side: int = 16) -> DataFrame:
    """stem, hard, values (side x side in [0, 255]) and gt: an ellipse on a noisy ground; a share of hard ones has low contrast.
    Rows depend on seed, prefix and place only; prefixes keep stems of several splits apart."""
    k = F.col("id")
    key = lambda name: (seed, prefix, k, name)
    mid = lambda name: F.lit(side) * (0.3 + 0.4 * uniform(*key(name)))
    wide = lambda name: F.lit(side) * (0.1 + 0.2 * uniform(*key(name)))
    x = spark.range(n).select("id", F.concat(F.lit(prefix), F.lpad(k.cast("string"), 5, "0")).alias("stem"), (uniform(*key("hard")) < hard_frac).alias("hard"), mid("y").alias("y"), mid("x").alias("x"), wide("h").alias("h"), wide("w").alias("w"))
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    inside = lambda c: F.pow((F.floor(c / side) - F.col("y")) / F.col("h"), 2) + F.pow((c % side - F.col("x")) / F.col("w"), 2) <= 1
    x = x.withColumn("gt", F.transform(cells, inside))
    level = F.when(F.col("hard"), 15.0).otherwise(80.0)
    noise = lambda c: 12.0 * normal(seed, prefix, F.col("id"), "noise", c)
    value = F.transform("gt", lambda g, c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 90.0 + F.when(g, level).otherwise(0.0) + noise(c))))
    return x.select("stem", "hard", value.alias("values"), "gt")


def combined_heads(heads: Column | str, how: str = "sum") -> Column:
    """One map of the maps of several heads (array of arrays of equal length): their sum, mean, or the last."""
    h = F.col(heads) if isinstance(heads, str) else heads
    if how == "last":
        return F.element_at(h, -1)
    total = F.aggregate(F.slice(h, F.lit(2), F.size(h)), F.get(h, F.lit(0)), lambda s, m: F.zip_with(s, m, lambda a, b: a + b))
    if how == "sum":
        return total
    if how == "mean":
        return F.transform(total, lambda v: v / F.size(h))
    raise ValueError(f"heads are combined by sum, mean or last, not {how!r}")


def standardised(values: Column | str, mean: list[float], std: list[float]) -> Column:
    """(x / 255 - mean) / std of values that hold the channels of each cell in turn."""
    m, s, n = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)), len(mean)
    return F.transform(values, lambda x, k: (x / 255.0 - F.get(m, k % n)) / F.get(s, k % n))


def _means() -> list[Column]:
    over = [F.avg(c).alias(c) for c in ("u", "shape", "shape_raw", "scale", "level")] + [F.avg(F.col(c).cast("double")).alias(c) for c in ("clamped", "degenerate")]
    return [F.count("*").alias("n"), F.avg(F.col("active").cast("double")).alias("active"), *over]


def _warned(g: DataFrame, warmup_epochs: int, least_active: float, most_clamped: float, lam: float) -> DataFrame:
    late = F.col("epoch") > max(1, warmup_epochs)
    return g.withColumns({"effective_lam": F.col("active") * lam, "rarely_active": late & (F.col("active") < least_active), "often_clamped": F.coalesce(F.col("clamped") > most_clamped, F.lit(False))})


def epoch_flush(calls: DataFrame, warmup_epochs: int = 1, least_active: float = 0.5, most_clamped: float = 0.2, lam: float = 0.3) -> DataFrame:
    """epoch, n, active, u, shape, shape_raw, scale, level, clamped, degenerate: means of the calls (epoch, active, ...) of each epoch,
    over calls that have the value; effective_lam = lam * active; rarely_active and often_clamped: whether to warn."""
    return _warned(calls.groupBy("epoch").agg(*_means()), warmup_epochs, least_active, most_clamped, lam)


def epoch_flush_stream(calls: DataFrame, seconds: int, lateness: str, warmup_epochs: int = 1, least_active: float = 0.5, most_clamped: float = 0.2, lam: float = 0.3) -> DataFrame:
    """epoch_flush() of a stream of calls (ts, active, ...), an epoch being `seconds` of event time, numbered from 1970 (see epoch_of()). An epoch is
    flushed once, when the watermark, `lateness` behind the latest call, has passed its end; later calls of it are left out."""
    g = calls.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(*_means())
    return _warned(g.withColumn("epoch", epoch_of("w.start", seconds)).drop("w"), warmup_epochs, least_active, most_clamped, lam)


def epoch_of(ts: str, seconds: int) -> Column:
    """The number of the epoch of so many seconds that a time falls in."""
    return F.floor(F.unix_seconds(F.col(ts)) / seconds).cast("long")


def best_so_far(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """selected: whether a row's value is above all values before it in its group, so the first of equal ones wins; NULLs never are. The order must be total.

    Rows are dealt by ranges of (group, order), so a run of any length spans many tasks; what a task has to know of those before it is their
    largest value, one row for each task and group.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(df.repartitionByRange(tasks, by, *order).select("*", F.spark_partition_id().alias("_task")), "ranges")
    per = x.groupBy(F.col(by).alias("_by"), F.col("_task").alias("_of")).agg(F.max(value).alias("_most"))
    ahead = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_by", "_of", F.max("_most").over(ahead).alias("_ahead"))
    x = x.join(per, x[by].eqNullSafe(per["_by"]) & (x["_task"] == per["_of"]))
    own = F.max(value).over(Window.partitionBy(by, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(own, F.col("_ahead"))
    return x.withColumn("selected", F.coalesce(F.col(value) > F.coalesce(before, F.lit(float("-inf"))), F.lit(False))).select(*df.columns, "selected")


def rescored(stored: DataFrame, again: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-6) -> DataFrame:
    """keys, stored, recomputed, ok: scores of both sides that differ by at most the tolerance."""
    a, b = stored.select(*keys, F.col(value).alias("stored")), again.select(*keys, F.col(value).alias("recomputed"))
    x = a.join(b, keys)
    same = (F.abs(F.col("stored") - F.col("recomputed")) <= tolerance) | (F.col("stored").isNull() & F.col("recomputed").isNull())
    return x.withColumn("ok", F.coalesce(same, F.lit(False)))


def environment(spark: SparkSession, root: str = ".") -> DataFrame:
    """name, value: versions, settings that matter for results, and the commit of a folder, as text."""
    import platform
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    commit, state = git("rev-parse", "HEAD"), git("status", "--porcelain")
    rows = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master}
    rows |= {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    rows |= {"commit": commit.stdout.strip() if not commit.returncode else "", "changed": str(bool(state.stdout.strip())) if not state.returncode else ""}
    return spark.createDataFrame(sorted(rows.items()), "name string, value string")


def sweep(jobs: list[tuple[str, int]], done, run, stop: bool = False) -> list[tuple[str, int, str]]:
    """Runs run(config, seed) one after the other for jobs that are not done(config, seed): (config, seed, status) with status done,
    skipped or the error's text; with stop the first error ends it."""
    out = []
    for config, seed in jobs:
        status = "skipped"
        if not done(config, seed):
            try:
                run(config, seed)
                status = "done"
            except Exception as e:  # noqa: BLE001  a failed run must not end the sweep
                status = f"{type(e).__name__}: {e}"
        out.append((config, seed, status))
        if stop and status not in ("done", "skipped"):
            break
    return out
