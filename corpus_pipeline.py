"""From raw documents to token ids: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows of the stage before it. All but the last
return the columns of documents. SQL can't express the classifier, the sketches or the merges, so ORACLE_SQL is None and
tests/llm/test_pipeline.py tests every stage against a brute-force version: what it keeps, and the very texts.

In every stage a null text counts as empty, an empty table gives an empty one, other columns pass through whatever their names and
nulls, and texts of any length are read whole. What repeated rows and ids mean is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from tidegauge.llm.queries import toxicity_chain
from tidegauge.sources import shared


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; each row is judged by itself, repeated ones alike."""
    return toxicity.clean(docs, toxicity_chain(spark, docs, sf_dir), "toxic")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of two or more lines; no document goes. Rows whose id is null or repeated stay as they are."""
    return line_dedup.without_repeats(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest id; of rows that share an id one, and all rows without an id."""
    return near_dedup.deduplicated(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark; an id goes with all its rows, rows without an id stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated ones alike."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage itself writes is deleted once its result is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared.shared_dir(spark)}/{name}"
        with shared.scope(spark):
            docs = shared.written_to(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
