"""Row numbers and running values along an order, for groups of any size: no group is ever gathered in one task.

Rows are dealt over the tasks by ranges of (group, order), so a large group spans many tasks; what one task has to know of those
before it is one row for each task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.shared import written

#: Rows that are folded in one row by affine_scan.
SIZE = 256


def numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with i (1 is the first row of its group, long) and n (rows of the group). The order must be total; nulls come first."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    x = df.repartitionByRange(tasks, by, *order).sortWithinPartitions(by, *order)
    # The ids of a task's rows go up by one, in the order of the sort.
    x = written(x.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")), "ordered")
    per = x.groupBy(F.col(by).alias("_by"), "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    w = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_k").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_by", F.col("_task").alias("_of"), "_first", before.alias("_before"), F.sum("_k").over(w).alias("n"))
    x = x.join(per, x[by].eqNullSafe(per["_by"]) & (x["_task"] == per["_of"]))
    return x.select(*names, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("i"), "n")


def affine_scan(df: DataFrame, by: str, at: str, a: str, b: str) -> DataFrame:
    """by, at, x: x = a * (x of the row before) + b, starting from 0, along at = 0, 1, ... without gaps in each group.

    Blocks of SIZE rows are folded to maps of what comes before them; the last maps of the blocks are scanned the same way, so the
    rows of any task are SIZE, and there are log(rows) / log(SIZE) levels.
    """
    fold = """aggregate(_rows, cast(array() AS array<struct<at: bigint, p: double, q: double>>), (s, r) -> concat(s, array(named_struct('at', r.at,
        'p', r.a * coalesce(element_at(s, -1).p, 1D), 'q', r.a * coalesce(element_at(s, -1).q, 0D) + r.b))))"""
    fold = fold.replace("element_at(s, -1)", "get(s, size(s) - 1)")
    rows = df.select(by, F.col(at).cast("long").alias("at"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    blocks = rows.groupBy(by, F.floor(F.col("at") / SIZE).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("_rows"))
    blocks = written(blocks.select(by, "_block", F.expr(fold).alias("_maps")), "blocks")
    if blocks.where("_block > 0").isEmpty():
        blocks = blocks.withColumn("_in", F.lit(0.0))
    else:
        ends = blocks.select(by, "_block", F.element_at("_maps", -1)["p"].alias("p"), F.element_at("_maps", -1)["q"].alias("q"))
        ends = affine_scan(ends, by, "_block", "p", "q").select(F.col(by).alias("_by"), (F.col("at") + 1).alias("_next"), F.col("x").alias("_in"))
        blocks = blocks.join(ends, blocks[by].eqNullSafe(ends["_by"]) & (blocks["_block"] == ends["_next"]), "left")
    z = blocks.select(by, F.coalesce("_in", F.lit(0.0)).alias("_in"), F.explode("_maps").alias("m"))
    return z.select(by, F.col("m.at").alias("at"), (F.col("m.p") * F.col("_in") + F.col("m.q")).alias("x"))


def smallest(df: DataFrame, n: Column | int, order: list[Column]) -> DataFrame:
    """The n smallest rows in the order of the columns, of which the first is a hexadecimal digest: rows are counted by the first
    four digits, whole counts are taken by a filter, and only rows of the border's digits are sorted."""
    key = F.substring(order[0], 1, 4)
    counts = sorted((r["k"], r["c"]) for r in df.groupBy(key.alias("k")).agg(F.count("*").alias("c")).collect())  # at most 65,536 rows
    left, border = int(n), None
    for k, c in counts:
        if c > left:
            border = k
            break
        left -= c
    if border is None:
        return df
    return df.where(key < border).unionByName(df.where(key == border).orderBy(*order).limit(left))
