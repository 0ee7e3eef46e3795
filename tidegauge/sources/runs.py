"""Runs of a method: for each arm and seed a summary and the scores of each record, as JSON documents in folders.

`<arm>/seed<k>/results.json` holds at least per_split: {split: {metric: value}}; `per_image_metrics.json` beside it, which may be
absent, {split: [{stem, metric: value, ...}]}. Folders named arm=<arm>/seed=<k>, as the writers make, are read too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metrics of a record.
METRICS = ("dice", "iou", "recall", "precision", "specificity", "hd95", "dice_sweep", "iou_sweep")
_PLACE = r"/(?:arm=)?([^/]+)/seed=?(\d+)/[^/]*$"
_META = "run string, model string, params long, wall_clock_seconds double, selected string"


def _documents(spark: SparkSession, path: str, name: str) -> DataFrame:
    """arm, seed and the text of every document of a name, one row each."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("p"))
    x = x.where(F.col("p").contains(f"/{name}"))
    # Numbers that JSON does not know count as missing.
    known = F.regexp_replace("value", r":\s*(NaN|-?Infinity)\b", ": null").alias("value")
    return x.select(F.regexp_extract("p", _PLACE, 1).alias("arm"), F.regexp_extract("p", _PLACE, 2).cast("int").alias("seed"), known)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """arm, seed, dataset, metric, value: the summary of each split; values that are no finite number are NULL."""
    kind = "struct<per_split: map<string, map<string, string>>>"
    x = _documents(spark, path, "results.json").select("arm", "seed", F.from_json("value", kind).alias("d"))
    x = x.select("arm", "seed", F.explode("d.per_split").alias("dataset", "m")).select("arm", "seed", "dataset", F.explode("m").alias("metric", "text"))
    v = F.expr("try_cast(text AS double)")
    return x.select("arm", "seed", "dataset", "metric", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """arm, seed, run, model, params, wall_clock_seconds, selected."""
    return _documents(spark, path, "results.json").select("arm", "seed", F.from_json("value", _META).alias("d")).select("arm", "seed", "d.*")


def read_records(spark: SparkSession, path: str, metric: str = "dice") -> DataFrame:
    """arm, seed, dataset, stem, value: one metric of every record, as paired.compare() takes it."""
    kind = "map<string, array<map<string, string>>>"
    x = _documents(spark, path, "per_image_metrics.json").select("arm", "seed", F.explode(F.from_json("value", kind)).alias("dataset", "rows"))
    x = x.select("arm", "seed", "dataset", F.explode("rows").alias("r"))
    v = F.expr(f"try_cast(r['{metric}'] AS double)")
    return x.select("arm", "seed", "dataset", F.col("r")["stem"].alias("stem"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"))


def load_arms(spark: SparkSession, path: str, arms: tuple[str, str], seeds: list[int], metric: str = "dice") -> DataFrame:
    """Records of two arms under the names a and b; a run of them that is not there is an error."""
    have = {(r.arm, r.seed) for r in _documents(spark, path, "results.json").where(F.col("arm").isin(*arms)).select("arm", "seed").collect()}  # a row for each run
    if lost := [f"{a}/seed{s}" for a in arms for s in seeds if (a, s) not in have]:
        raise FileNotFoundError(f"missing runs: {lost}")
    x = read_records(spark, path, metric).where(F.col("arm").isin(*arms) & F.col("seed").isin(*seeds))
    return x.withColumn("arm", F.when(F.col("arm") == arms[0], "a").otherwise("b"))


def write_summaries(rows: DataFrame, path: str) -> None:
    """results.json folders of (arm, seed, dataset, metric, value): a document for each run, whose size is that of its summary."""
    per = rows.groupBy("arm", "seed", "dataset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    doc = per.groupBy("arm", "seed").agg(F.map_from_arrays(F.collect_list("dataset"), F.collect_list("m")).alias("per_split"))
    doc.select("arm", "seed", F.to_json(F.struct("per_split")).alias("value")).write.partitionBy("arm", "seed").text(f"{path}/results.json")


def write_records(rows: DataFrame, path: str) -> None:
    """Records as Parquet in folders arm=/seed=, for runs of any size."""
    rows.write.partitionBy("arm", "seed").parquet(path)
