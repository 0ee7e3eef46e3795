"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a folder of this machine if all executors run on it
    (a local master, as in tests), otherwise an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", top)
    _made.append(f"{top.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def scope(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Deletes the tables that are written inside once it ends: what is made from them has to be read or written inside too. Folders listed in
    `keep`, which may be filled inside, stay."""
    first = len(_made)
    try:
        yield
    finally:
        gone, _made[first:] = _made[first:], []
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in gone:
            if name not in keep:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: lineage ends here and every executor sees it."""
    spark = df.sparkSession
    return written_to(df, f"{shared_dir(spark)}/{name}", partition_by)


def written_to(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
