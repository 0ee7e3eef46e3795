"""Tail-aware aggregates of record scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.numeric import finite

METRICS = ("dice", "iou", "recall", "precision", "specificity", "hd95", "dice_sweep", "iou_sweep")


def tail_columns(value: str = "dice", levels: tuple[float, ...] = (0.5, 0.75)) -> list[Column]:
    """Shares at or below each level, 5th and 10th percentiles, sample standard deviation (0 for one row)."""
    v = F.col(value)
    return [
        *[F.avg((v <= x).cast("double")).alias(f"{value}_le_{x:g}".replace(".", "")) for x in levels],
        F.percentile(v, F.lit(0.05)).alias(f"{value}_p05"),
        F.percentile(v, F.lit(0.10)).alias(f"{value}_p10"),
        F.when(F.count("*") > 1, F.stddev_samp(v)).otherwise(0.0).alias(f"{value}_sd"),
    ]


def mean_columns(metrics: tuple[str, ...]) -> list[Column]:
    """Means over finite values and how many there are, for each metric."""
    return [c for m in metrics for c in (F.avg(finite(m)).alias(m), F.count(finite(m)).alias(f"{m}_n_defined"))]


def tail_report(scores: DataFrame, by: str = "split") -> DataFrame:
    """One row for each split: n, mean Dice and the left tail."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg("dice").alias("dice_mean"), *tail_columns())


def metric_means(scores: DataFrame, metrics: tuple[str, ...], by: str = "split") -> DataFrame:
    extra = [F.count_if("pred_empty").alias("n_pred_empty"), F.count_if(F.col("pred_empty") | F.col("gt_empty")).alias("n_hd95_undefined")]
    return scores.groupBy(by).agg(F.count("*").alias("n"), *mean_columns(metrics), *extra)


def pooled(scores: DataFrame, metric: str = "dice", by: str = "split") -> DataFrame:
    """micro: mean over rows; macro: mean over the splits' means that are finite; n_splits, n. One row."""
    per = scores.groupBy(by).agg(F.sum(finite(metric)).alias("s"), F.count(finite(metric)).alias("k"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_splits"), F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("k")).alias("micro"), F.avg(F.try_divide("s", "k")).alias("macro"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
