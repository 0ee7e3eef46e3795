"""Paired comparisons of two arms of runs: t intervals, bootstraps, step-down adjustment, mechanical verdict.

Runs are rows (arm, seed, dataset, stem, value); arms are called a and b, differences are b - a.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import md5_first, t_quantile, t_two_sided_p
from tidegauge.sources.shared import written

from .order import numbered


INTERVALS = ("seed_t", "image_bootstrap", "hierarchical")


def validate(runs: DataFrame) -> None:
    """Raises ValueError for a dataset of which the arms have different seeds, or runs without a stem in common."""
    seeds = runs.select("dataset", "arm", "seed").distinct()  # a row for each run
    sides = seeds.groupBy("dataset").agg(F.sort_array(F.collect_set(F.when(F.col("arm") == "a", F.col("seed")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("arm") == "b", F.col("seed")))).alias("b"))
    both = "size(a) > 0 AND size(b) > 0"
    if odd := sides.where(f"{both} AND a <> b").limit(5).collect():
        raise ValueError("arms need the same seeds: " + ", ".join(f"{r.dataset} has {r.a} and {r.b}" for r in odd))
    common = matched(runs).select("dataset").distinct()
    if lost := sides.where(both).join(common, "dataset", "left_anti").limit(5).collect():
        raise ValueError("no stem in common on " + ", ".join(r.dataset for r in lost))


def matched(runs: DataFrame) -> DataFrame:
    """Rows of the stems that every run of both arms has."""
    n = runs.groupBy("dataset").agg(F.countDistinct("arm", "seed").alias("n_runs"))
    full = runs.groupBy("dataset", "stem").agg(F.countDistinct("arm", "seed").alias("k")).join(n, "dataset").where("k = n_runs")
    return runs.join(full.select("dataset", "stem"), ["dataset", "stem"], "left_semi")


def seed_means(runs: DataFrame) -> DataFrame:
    """dataset, seed, a, b for the datasets and seeds that both arms have."""
    m = runs.groupBy("dataset", "seed").agg(F.avg(F.when(F.col("arm") == "a", F.col("value"))).alias("a"), F.avg(F.when(F.col("arm") == "b", F.col("value"))).alias("b"))
    return m.where("a IS NOT NULL AND b IS NOT NULL")


def t_intervals(means: DataFrame, confidence: float = 0.95, digits: int = 12) -> DataFrame:
    """dataset, n, a_mean, b_mean, mean, sd, lo, hi, degenerate, p.

    With one seed the interval is unbounded, with equal differences it is a point; both are degenerate and have no p.
    Differences are rounded to `digits` places so that equal ones are equal in spite of rounding in the last place.
    """
    d = means.withColumn("d", F.round(F.col("b") - F.col("a"), digits))
    g = d.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    bad = (F.col("n") < 2) | (F.col("sd") <= 1e-15)
    half = t_quantile((1 + confidence) / 2, F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    side = lambda s: F.when(F.col("n") < 2, F.lit(s * float("inf"))).when(bad, F.col("mean")).otherwise(F.col("mean") + s * half)
    t = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return g.select("dataset", "n", "a_mean", "b_mean", "mean", "sd", side(-1).alias("lo"), side(1).alias("hi"), bad.alias("degenerate"), F.when(~bad, t_two_sided_p(t, F.col("n") - 1)).alias("p"))


def holm(df: DataFrame, p: str = "p", key: str = "dataset") -> DataFrame:
    """p_holm: step-down adjusted p-values of all rows with one; others keep NULL. The family is one row each, so one task."""
    have = df.where(F.col(p).isNotNull())
    w = Window.orderBy(p, key)
    m = have.agg(F.count("*").alias("m"))
    x = have.select(key, F.col(p).alias("_p"), F.row_number().over(w).alias("_i")).join(F.broadcast(m))  # one row
    x = x.withColumn("_q", F.least(F.lit(1.0), (F.col("m") - F.col("_i") + 1) * F.col("_p")))
    x = x.select(key, F.max("_q").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)).alias("p_holm"))
    return df.join(x, key, "left")


def stem_differences(runs: DataFrame) -> DataFrame:
    """dataset, stem, k (0-based place by stem), n, d (mean over seeds of b - a)."""
    d = matched(runs).groupBy("dataset", "stem").agg((F.avg(F.when(F.col("arm") == "b", F.col("value"))) - F.avg(F.when(F.col("arm") == "a", F.col("value")))).alias("d"))
    return numbered(d, "dataset", ["stem"]).select("dataset", "stem", (F.col("i") - 1).alias("k"), "n", "d")


#: Stems of a block, and draws and replicates that a task makes together.
STEMS, DRAWS, REPS = 1024, 16384, 64


def _draws(sizes: DataFrame, n_boot: int, key: tuple) -> DataFrame:
    """dataset, block, first, counts and places: of the draws of each dataset (dataset, n) those that fall in a block of STEMS places, packed: how many
    fall to each replicate from `first` on, then where. A task makes the draws of some replicates; see numeric.draw() for what they are."""
    up = lambda to, step: F.explode(F.sequence(F.lit(0).cast("long"), to, F.lit(step).cast("long")))
    work = sizes.select("dataset", F.col("dataset").cast("string").alias("name"), "n").withColumn("j", up(F.col("n") - 1, DRAWS)).withColumn("r", up(F.lit(n_boot - 1).cast("long"), REPS))
    stems, draws, reps = STEMS, DRAWS, REPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (name, n, j, r) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("name", "n", "j", "r")])):
                js, rs = np.arange(j, min(j + draws, n)), range(r, min(r + reps, n_boot))
                ks = np.empty((len(rs), len(js)), np.int64)
                for i, rep in enumerate(rs):
                    before = "|".join(map(str, (*key, name, rep, ""))).encode()
                    ks[i] = md5_first(before, js)
                ks %= n
                k, rep = ks.reshape(-1), np.repeat(np.arange(len(rs)), len(js))
                order = np.argsort(k // stems, kind="stable")  # so replicates are in order within a block
                blocks, first, own = np.unique(k[order] // stems, return_index=True, return_inverse=True)
                counts = np.bincount(own * len(rs) + rep[order], minlength=len(blocks) * len(rs))
                lists = [(np.arange(len(blocks) + 1) * len(rs), counts), (np.append(first, len(k)), (k % stems)[order])]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int16))) for at, x in lists]
                yield pa.RecordBatch.from_arrays([batch.column("dataset").take(pa.array([at] * len(blocks))), pa.array(blocks), pa.array(np.full(len(blocks), r)), *lists], ["dataset", "block", "first", "counts", "places"])

    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = sizes.schema["dataset"].dataType.simpleString()
    return work.repartition(tasks, "dataset", "j", "r").mapInArrow(run, f"dataset {kind}, block long, first long, counts array<smallint>, places array<smallint>")


def _replicates(cells: DataFrame, n_boot: int, key: tuple, seed_key: tuple | None = None) -> DataFrame:
    """dataset, r: the mean of each replicate of cells (dataset, k, s, n, m, v): k of n stems, s of m seeds.

    A product of matrices: how often each stem was drawn in each replicate, times the values, times how often each seed was drawn. A block of
    stems meets its draws, about n_boot * STEMS of them however many stems there are, and gives a sum for each replicate; only those are
    added up over blocks. Without a seed_key there is one seed.
    """
    sizes = cells.groupBy("dataset").agg(F.max("n").alias("n"))
    values = cells.select("dataset", F.floor(F.col("k") / STEMS).cast("long").alias("block"), (F.col("k") % STEMS).cast("int").alias("k"), F.col("s").cast("int").alias("s"), F.col("m").cast("int").alias("m"), "n", "v", F.col("dataset").cast("string").alias("name"))
    kind = cells.schema["dataset"].dataType.simpleString()

    def run(drawn: pa.Table, block: pa.Table) -> pa.Table:
        if not drawn.num_rows or not block.num_rows:
            return pa.table([drawn["dataset"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], ["dataset", "rep", "r"])
        n, m, name = block["n"][0].as_py(), block["m"][0].as_py(), block["name"][0].as_py()
        v = np.zeros((STEMS, m))
        v[block["k"].to_numpy(), block["s"].to_numpy()] = block["v"].to_numpy()
        counts, place = (drawn[c].combine_chunks() for c in ("counts", "places"))
        each = np.diff(counts.offsets.to_numpy())
        rep = np.repeat(drawn["first"].to_numpy() - np.cumsum(each) + each, each) + np.arange(each.sum())  # of each count
        rep, place = np.repeat(rep, counts.flatten().to_numpy()), place.flatten().to_numpy()
        total = np.zeros(n_boot)
        times = np.ones((n_boot, m), np.int64)
        if seed_key is not None:
            for r in range(n_boot):
                before = "|".join(map(str, (*seed_key, name, r, ""))).encode()
                times[r] = np.bincount([int.from_bytes(hashlib.md5(before + b"%d" % j).digest()[:4], "big") % m for j in range(m)], minlength=m)
        for s in range(m):
            total += times[:, s] * np.bincount(rep, weights=v[place, s], minlength=n_boot)
        return pa.table([block["dataset"].take(pa.array([0] * n_boot)), pa.array(np.arange(n_boot)), pa.array(total / (n * m))], ["dataset", "rep", "r"])

    draws = _draws(sizes, n_boot, key)
    both = draws.groupBy("dataset", "block").cogroup(values.groupBy("dataset", "block"))
    return both.applyInArrow(run, f"dataset {kind}, rep long, r double").groupBy("dataset", "rep").agg(F.sum("r").alias("r"))


def _limits(reps: DataFrame, point: DataFrame, confidence: float) -> DataFrame:
    """Percentile limits of the replicates r around the point estimates."""
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    g = reps.groupBy("dataset").agg(F.percentile("r", F.lit(lo)).alias("lo"), F.percentile("r", F.lit(hi)).alias("hi"))
    return point.join(g, "dataset").select("dataset", "n", "mean", "lo", "hi")


def image_bootstrap(runs: DataFrame, n_boot: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """dataset, n, mean, lo, hi over resamples of stems."""
    d = written(stem_differences(runs), "differences")
    point = d.groupBy("dataset").agg(F.max("n").alias("n"), F.avg("d").alias("mean"))
    cells = d.select("dataset", "k", F.lit(0).alias("s"), "n", F.lit(1).alias("m"), F.col("d").alias("v"))
    return _limits(_replicates(cells, n_boot, (seed,)), point, confidence)


def hierarchical_bootstrap(runs: DataFrame, n_boot: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """dataset, n, mean, lo, hi over resamples of seeds and of stems, one draw of stems for all seeds drawn; the mean is that of the data."""
    d = written(stem_differences(runs), "differences")
    point = d.groupBy("dataset").agg(F.max("n").alias("n"), F.avg("d").alias("mean"))
    cell = matched(runs).groupBy("dataset", "stem", "seed").agg((F.sum(F.when(F.col("arm") == "b", F.col("value")).otherwise(-F.col("value")))).alias("v"))
    seeds = cell.select("dataset", "seed").distinct()  # a row for each run
    w = Window.partitionBy("dataset")
    seeds = seeds.withColumn("s", (F.row_number().over(w.orderBy("seed")) - 1).cast("long")).withColumn("m", F.count("*").over(w))
    cells = written(cell.join(d.select("dataset", "stem", "k", "n"), ["dataset", "stem"]).join(seeds, ["dataset", "seed"]), "cells")
    return _limits(_replicates(cells, n_boot, (seed, "stem"), (seed, "seed")), point, confidence)


def compare(runs: DataFrame, confidence: float = 0.95, n_boot: int | None = None, seed: int = 0, metric: str | None = None) -> DataFrame:
    """t_intervals with adjusted p-values and what the intervals say; degenerate ones are never significant.

    With n_boot also image_bootstrap_lo, _hi, hierarchical_lo and _hi. metric: of runs with a column metric, which one to compare. Arms of
    different seeds, or without a stem in common, are errors; see validate().
    """
    if metric is not None:
        runs = runs.where(F.col("metric") == metric).drop("metric")
    validate(runs)
    t = holm(t_intervals(seed_means(runs), confidence))
    if n_boot:
        for name, f in (("image_bootstrap", image_bootstrap), ("hierarchical", hierarchical_bootstrap)):
            t = t.join(f(runs, n_boot, confidence, seed).select("dataset", F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi")), "dataset", "left")
    return said(t)


def said(t: DataFrame, interval: str = "seed_t") -> DataFrame:
    """excludes_zero, significantly_positive and significantly_negative by one of INTERVALS."""
    lo, hi, sure = _limits_of(interval)
    return t.withColumns({"excludes_zero": sure & ((lo > 0) | (hi < 0)), "significantly_positive": sure & (lo > 0), "significantly_negative": sure & (hi < 0)})


def _limits_of(interval: str):
    if interval not in INTERVALS:
        raise ValueError(f"intervals are {', '.join(INTERVALS)}, not {interval!r}")
    if interval == "seed_t":
        return F.col("lo"), F.col("hi"), ~F.col("degenerate")
    return F.col(f"{interval}_lo"), F.col(f"{interval}_hi"), F.col(f"{interval}_lo").isNotNull()


def verdict(comparison: DataFrame, tails: DataFrame, target: str, external: list[str], second: DataFrame | None = None, required_drop: float = 0.03, degradation: float = 0.010, interval: str = "seed_t") -> DataFrame:
    """criterion, triggered, evaluated, detail: the three rules read against one of INTERVALS, and `rejected`, true if any is triggered.

    comparison: compare(); tails: dataset, drop (mean tail mass of a less that of b); second: compare() of another pair of arms.
    """
    lo, hi, _ = _limits_of(interval)
    comparison = said(comparison, interval)
    line = lambda df, name: df.select(F.lit(name).alias("criterion"), F.coalesce("triggered", F.lit(False)).alias("triggered"), "evaluated", F.coalesce("detail", F.lit("not evaluated")).alias("detail"))
    limits = F.format_string("%+.4f [%+.4f, %+.4f]", "mean", lo, hi)
    t = comparison.where(F.col("dataset") == target).join(tails, "dataset", "left")
    no_gain = (F.col("mean") <= 0) & (lo <= 0) & (hi >= 0) & ~F.coalesce(F.col("drop") >= required_drop, F.lit(False))
    one = line(t.agg(F.bool_or(no_gain).alias("triggered"), (F.count("*") > 0).alias("evaluated"), F.max(F.concat(limits, F.lit("; drop "), F.coalesce(F.format_string("%+.4f", "drop"), F.lit("unknown")))).alias("detail")), "no_target_gain")
    src = comparison.limit(0) if second is None else said(second, interval)
    listed = F.array_join(F.sort_array(F.collect_list(F.concat("dataset", F.lit(" "), limits))), "; ")
    two = src.where(F.col("dataset").isin(external)).agg(F.bool_and(~F.col("excludes_zero")).alias("triggered"), (F.count("*") > 0).alias("evaluated"), F.when(F.count("*") > 0, listed).alias("detail"))
    fall = (F.col("mean") < -degradation) & F.col("significantly_negative")
    fallers = F.array_join(F.sort_array(F.collect_list(F.when(fall, F.col("dataset")))), ", ")
    rise = F.avg(F.col("b_mean") - F.col("a_mean"))
    three = comparison.agg((F.bool_or(fall) & (rise > 0)).alias("triggered"), (F.count("*") > 0).alias("evaluated"), F.concat(F.format_string("pooled %+.4f; falling: ", rise), fallers).alias("detail"))
    rules = one.unionByName(line(two, "no_external_difference")).unionByName(line(three, "falls_while_pool_rises"))
    return rules.unionByName(rules.agg(F.lit("rejected").alias("criterion"), F.bool_or("triggered").alias("triggered"), F.bool_and("evaluated").alias("evaluated"), F.lit(f"read at {interval}").alias("detail")))


def notes(comparison: DataFrame, target: str, external: list[str], second: DataFrame | None = None, interval: str = "seed_t") -> DataFrame:
    """note: what to know before reading a verdict: datasets without spread, rules that could not be evaluated, the interval read."""
    spark = comparison.sparkSession
    every = comparison.select("dataset", "degenerate")
    every = every if second is None else every.unionByName(second.select("dataset", "degenerate"))
    flat = every.where("degenerate" if interval == "seed_t" else "false").agg(F.array_join(F.sort_array(F.collect_set("dataset")), ", ").alias("d"))
    out = flat.where("d <> ''").select(F.concat(F.lit("no spread between seeds, never significant: "), "d").alias("note"))
    src = comparison.limit(0) if second is None else second
    for df, text in ((src.where(F.col("dataset").isin(external)), "no_external_difference was not evaluated: no second comparison on external datasets"), (comparison.where(F.col("dataset") == target), f"no_target_gain was not evaluated: no comparison on {target}")):
        out = out.unionByName(df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(text).alias("note")))
    return out.unionByName(spark.createDataFrame([(f"read at {interval}, two-sided, not adjusted for the number of datasets",)], "note string"))
