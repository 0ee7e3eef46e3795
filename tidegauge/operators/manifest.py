"""Content-addressed manifests: build, verify, pair, reconcile, gaps and name shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import smallest


def normalised_text(c: Column | str) -> Column:
    """Lower case, runs of white space as one space, trimmed: what the content hash is over."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " "))


def build(items: DataFrame, split: str, stem: str, content: str) -> DataFrame:
    """split, stem, byte_sha256, content_sha256."""
    return items.select(F.col(split).alias("split"), F.col(stem).alias("stem"), F.sha2(F.col(content).cast("binary"), 256).alias("byte_sha256"), F.sha2(normalised_text(content).cast("binary"), 256).alias("content_sha256"))


def totals(manifest: DataFrame) -> DataFrame:
    """split, n: counts of each split and of all (split NULL)."""
    return manifest.rollup("split").agg(F.count("*").alias("n"))


def verify(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """split, stem, status (missing, bytes, content, extra) of items that differ; none means the data is as recorded.

    bytes: other bytes of the same content. Split and stem together are a key on both sides.
    """
    m, d = manifest.alias("m"), disk.alias("d")
    x = m.join(d, ["split", "stem"], "full_outer")
    status = (
        F.when(F.col("d.byte_sha256").isNull(), "missing")
        .when(F.col("m.byte_sha256").isNull(), "extra")
        .when(F.col("m.content_sha256") != F.col("d.content_sha256"), "content")
        .when(F.col("m.byte_sha256") != F.col("d.byte_sha256"), "bytes")
    )
    return x.select("split", "stem", status.alias("status")).where("status IS NOT NULL")


def pair(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by key, never by position."""
    return left.join(right, keys)


def unpaired(left: DataFrame, right: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """side (left, right), n, examples: distinct keys that the other side lacks, with the smallest few."""
    l, r = left.select(key).distinct(), right.select(key).distinct()

    def one(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        gone = a.join(b, key, "left_anti")
        few = gone.orderBy(key).limit(examples).agg(F.sort_array(F.collect_list(key)).alias("examples"))
        return gone.agg(F.count("*").alias("n")).join(few).select(F.lit(name).alias("side"), "n", "examples")

    return one(l, r, "left").unionByName(one(r, l, "right"))


def reconcile(counts: DataFrame, expected: DataFrame, partition_of: str | None = None, held_out: str | None = None) -> DataFrame:
    """split, n, expected, delta, status (ok, mismatch, held_out, re-split, missing).

    A split short of what is expected by exactly the held-out split is re-split, not a mismatch.
    """
    held = counts.where(F.col("split") == held_out).agg(F.coalesce(F.max("n"), F.lit(0)).alias("held"))
    x = counts.join(expected, "split", "full_outer").join(F.broadcast(held))  # one row
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("expected").isNull(), "held_out" if held_out else "mismatch")
        .when(n == F.col("expected"), "ok")
        .when((F.col("split") == (partition_of or "")) & (n + F.col("held") == F.col("expected")), "re-split")
        .otherwise("mismatch")
    )
    return x.select("split", n.alias("n"), "expected", (n - F.col("expected")).alias("delta"), status.alias("status"))


def partition_check(members: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """n_pool, n_parts, n_lost, n_twice, n_foreign: do parts (part, key) add up to the pool they come from?"""
    seen = members.groupBy(key).agg(F.count("*").alias("k"))
    x = pool.select(key, F.lit(1).alias("in_pool")).join(seen, key, "full_outer")
    return x.agg(F.count("in_pool").alias("n_pool"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_parts"), F.count_if(F.col("k").isNull()).alias("n_lost"), F.count_if(F.col("k") > 1).alias("n_twice"), F.count_if(F.col("in_pool").isNull()).alias("n_foreign"))


def numeric_gaps(df: DataFrame, by: str, key: str) -> DataFrame:
    """by, lo, hi, n_missing, n_runs, contiguous: gaps between the distinct whole-number keys of each group.

    A gap ends at a key, above the smallest, whose predecessor is not there, so gaps are counted by an anti-join of keys with keys
    and no group is sorted in one task.
    """
    keys = df.select(by, key).where(F.col(key).isNotNull()).distinct()
    after = keys.select(by, (F.col(key) + 1).alias(key))
    runs = keys.join(after, [by, key], "left_anti").groupBy(by).agg((F.count("*") - 1).alias("n_runs"))
    g = keys.groupBy(by).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("_n")).join(runs, by)
    return g.select(by, "lo", "hi", (F.col("hi") - F.col("lo") + 1 - F.col("_n")).alias("n_missing"), "n_runs", (F.col("n_runs") <= 1).alias("contiguous"))


#: Spans of numbers above this are no numbering.
SPAN = 100_000


def missing_numbers(df: DataFrame, by: str, key: str, span: int = SPAN) -> DataFrame:
    """by, missing: the numbers between the smallest and the largest key of a group that are not there, a row each; groups of a
    single key or of a larger span have none."""
    keys = df.select(by, F.col(key).cast("long").alias("missing")).where("missing IS NOT NULL").distinct()
    ends = keys.groupBy(by).agg(F.min("missing").alias("lo"), F.max("missing").alias("hi")).where(F.col("hi") - F.col("lo") <= span)
    return ends.select(by, F.explode(F.sequence("lo", "hi")).alias("missing")).join(keys, [by, "missing"], "left_anti")


def name_shape(c: Column | str) -> Column:
    """numeric (digits only), alphanumeric (16 or more lower-case letters and digits, with a letter), other."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9]+$"), "numeric").when(c.rlike("^[a-z0-9]{16,}$") & c.rlike("[a-z]"), "alphanumeric").otherwise("other")


def collisions(df: DataFrame, by: str, stem: str) -> DataFrame:
    return df.groupBy(by, stem).agg(F.count("*").alias("n")).where("n > 1")


def holdout(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The rows held out: the max(1, round half-even of fraction * n) smallest by MD5 of seed and key."""
    n = df.agg(F.greatest(F.lit(1), F.rint(F.count("*") * F.lit(fraction)).cast("long")).alias("n")).first()["n"]
    digest = F.coalesce(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), F.lit(""))
    return smallest(df.withColumn("order", digest), n, [F.col("order"), F.col(key)]).drop("order")


def carve(df: DataFrame, key: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and what is held out; keys are unique."""
    held = holdout(df, key, fraction, seed)
    return df.join(held.select(key), key, "left_anti"), held


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")
