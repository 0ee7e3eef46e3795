"""How filters of documents interact: for every order of the filters, what each step keeps, removes and would have removed.

Words are exploded and counted by (document, word), then by document, which gives totals and distinct words; which texts stand
under a smaller id, and the labels, are joined to that. A document's failures are five bits, so all orders follow from 32
conditional counts of each part: the orders are expanded from those counts, never from documents.

Texts are shuffled once, to the task of their document, and words never are: both counts are made there. Texts are equal if
their SHA-256 digests are; texts under one id are told apart by xxhash64.

Defined results: a null text is empty, a null part the empty string; rows are documents of their own, also those that share
an id (of the same id and text none stands under a smaller id); a null id is no smaller id and has none; labels of a repeated id
count if any of them says so, and a document without labels has none; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The filters, by the bit of their failure from 1 on: few words, few distinct words, many capitals, symbols, a copy.
FILTERS = "ABCDE"
#: What is counted of each part: documents, those of good quality, those that are toxic.
MEASURES = ("docs", "good", "toxic")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, bits (the failures, A is bit 1) and n (how many rows are such), written."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("tag", F.xxhash64("text"))
    # A null before the words counts the rows of a document, and keeps those without words.
    words = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", C.SPACES_RE)))
    words = rows.select("doc_id", "tag", "text").repartition("doc_id", "tag").select("doc_id", "tag", words.alias("word")).where("word IS NULL OR word <> ''")
    per_word = words.groupBy("doc_id", "tag", "word").agg(F.count("*").alias("c"))
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))), F.lit(0))
    per_text = per_word.groupBy("doc_id", "tag").agg(F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("times"), total.alias("total"), F.count("word").alias("n_distinct"))
    n_words = F.expr("total div times")
    counted = per_text.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.when(n_words < 200, 1).otherwise(0).alias("few"), F.when(100 * F.col("n_distinct") < 50 * n_words, 2).otherwise(0).alias("alike"))

    capitals = F.when(100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text"), 4).otherwise(0)
    style = (capitals + F.when(F.col("text").rlike("[#$%&*|]"), 8).otherwise(0)).alias("style")
    flags = rows.groupBy("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("digest"), "part", style).agg(F.count("*").alias("n"))
    per_doc = flags.join(counted, flags["doc_id"].eqNullSafe(counted["_id"]) & (flags["tag"] == counted["_tag"]), "left")
    per_doc = C.written(per_doc.select("doc_id", "digest", "part", (F.col("style") + F.col("few") + F.col("alike")).alias("bits"), "n"), "failures")

    texts = C.written(per_doc.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "texts")
    hot = C.hot_keys(texts.select("digest", "n"), "digest")
    out = C.spread_join(per_doc, texts.where("n > 1").select("digest", "first"), "digest", hot, "left")
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 16).otherwise(0)
    return out.select("doc_id", "part", (F.col("bits") + copy).alias("bits"), "n")


def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part and b0 to b31 for each of MEASURES: the rows whose failures are exactly those bits."""
    said = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    x = found.join(said, "doc_id", "left")
    of = F.array_compact(F.array(F.lit("docs"), *[F.when(F.col(m), F.lit(m)) for m in MEASURES[1:]]))
    x = x.select("part", "bits", "n", F.explode(of).alias("measure"))
    return x.groupBy("part", "measure").agg(*[F.coalesce(F.sum(F.when(F.col("bits") == k, F.col("n"))), F.lit(0)).alias(f"b{k}") for k in range(1 << len(FILTERS))])


def _steps() -> list[dict]:
    """Of each order each step: its number from 1, the bits of the filters before and the bit of its own."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "before": before, "bit": 1 << f})
            before |= 1 << f
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, from cells()."""
    every = F.array(*[F.col(f"b{k}") for k in range(1 << len(FILTERS))])
    x = counts.groupBy("part").pivot("measure", list(MEASURES)).agg(F.first(every))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << len(FILTERS))
    x = x.select("part", *[F.coalesce(m, none).alias(m) for m in MEASURES])
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    x = x.select("*", F.explode(steps).alias("_s")).select("part", *MEASURES, "_s.*")

    def total(measure: str, which) -> Column:
        """The sum of the counts whose bits satisfy a condition."""
        return F.aggregate(F.transform(measure, lambda v, k: F.when(which(k), v).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)

    early, here = (lambda k: k.bitwiseAND(F.col("before")) != 0), (lambda k: k.bitwiseAND(F.col("bit")) != 0)
    gone = lambda k: ~early(k) & here(k)
    x = x.select(
        "part", "filter_order", "step", "bit",
        total("docs", lambda k: ~early(k) & ~here(k)).alias("kept"),
        total("docs", gone).alias("removed"),
        total("docs", lambda k: early(k) & here(k)).alias("redundant"),
        F.get("docs", F.col("bit")).alias("unique_fails"),
        total("good", gone).alias("good_lost"),
        total("toxic", gone).alias("toxic_lost"),
    )
    shapley = x.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return x.join(shapley, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    return interactions(C.written(cells(failures(docs, id_col, text_col, part_col), labels), "cells"))
