"""Files as tables, and tables as files.

Spark's file sources skip names that start with `.` or `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def index(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, split (folder), stem, ext, sha256, content of the files with one of the extensions, lower case; a missing folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    x = files.withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", ""))
    x = x.where(F.col("ext").isin(*extensions)).withColumn("split", F.element_at(F.split("path", "/"), -2))
    return x.select("path", "split", "stem", "ext", F.sha2("content", 256).alias("sha256"), "content")


def path_parts(path: Column | str, root: str) -> dict[str, Column]:
    """relative (to the root, with slashes), base, stem and ext (lower case, with its dot) of paths of either separator."""
    c = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    top = root.replace("\\", "/").rstrip("/") + "/"
    base = F.substring_index(c, "/", -1)
    return {"relative": F.when(F.startswith(c, F.lit(top)), F.substr(c, F.lit(len(top) + 1))).otherwise(c), "base": base, "stem": F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""), "ext": F.lower(F.regexp_extract(base, r".(\.[^.]+)$", 1))}


def layout_files(spark: SparkSession, root: str) -> DataFrame:
    """split, side, stem, ext, w, h (NULL) of the files two folders below a root or deeper: the input of layout.report()."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    at = F.split("path", "/")
    return x.select(F.element_at(at, -3).alias("split"), F.element_at(at, -2).alias("side"), *[path_parts("path", root)[c].alias(c) for c in ("stem", "ext")], F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"))


def duplicate_stems(files: DataFrame) -> DataFrame:
    return files.groupBy("split", "stem").agg(F.count("*").alias("n")).where("n > 1")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, split, stem, w, h, mode (L, RGB or RGBA), pixel_sha256 (of the decoded bytes) and data (those bytes)."""
    x = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    return x.select(F.col("origin").alias("path"), F.element_at(F.split("origin", "/"), -2).alias("split"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("width").alias("w"), F.col("height").alias("h"), F.try_element_at(F.create_map(*[F.lit(x) for x in (1, "L", 3, "RGB", 4, "RGBA")]), F.col("nChannels")).alias("mode"), F.sha2("data", 256).alias("pixel_sha256"), "data")


def mask_folder(files: DataFrame, names: tuple[str, ...] = ("masks", "gt", "gts")) -> DataFrame:
    """base, folder, status: which of several mask folders counts (path, base, folder, stem given): the first by name order.

    status: ok, note (several with the same stems), ambiguous (several with different stems).
    """
    some = files.where(F.col("folder").isin(*names)).groupBy("base", "folder").agg(F.sort_array(F.collect_set("stem")).alias("stems"))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("folder"))
    g = some.groupBy("base").agg(F.min_by("folder", order).alias("folder"), F.count("*").alias("n"), F.countDistinct("stems").alias("k"))
    return g.select("base", "folder", F.when(F.col("n") == 1, "ok").when(F.col("k") == 1, "note").otherwise("ambiguous").alias("status"))


def write_checksums(items: DataFrame, path: str) -> None:
    """`sha256  path` lines, sorted by path."""
    items.select(F.concat("sha256", F.lit("  "), "path").alias("value"), "path").orderBy("path").select("value").write.text(path)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", "  ", 2)
    return spark.read.text(path).select(F.get(part, F.lit(0)).alias("sha256"), F.get(part, F.lit(1)).alias("path"))


def write_manifest(items: DataFrame, path: str, root_name: str) -> None:
    """One JSON document: the items of each split by stem. Its size is that of the manifest, held by one task."""
    fields = [c for c in items.columns if c != "split"]
    per = items.groupBy("split").agg(F.sort_array(F.collect_list(F.struct("stem", *[c for c in fields if c != "stem"]))).alias("items"), F.count("*").alias("n_pairs"))
    doc = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct("n_pairs", "items"))))).alias("splits"), F.sum("n_pairs").alias("total_pairs"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc.select(F.lit(schemas.MANIFEST_VERSION).alias("schema"), now.alias("created_utc"), F.lit(root_name).alias("root_name"), "splits", "total_pairs").coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The items of a manifest, a row each; another version is an error."""
    doc = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    if doc.where(~F.col("schema").eqNullSafe(schemas.MANIFEST_VERSION)).count():
        raise ValueError(f"not a manifest of version {schemas.MANIFEST_VERSION}: {path}")
    x = doc.select(F.explode("splits").alias("split", "s")).select("split", F.explode("s.items").alias("i"))
    return x.select("split", "i.*").select(*schemas.MANIFEST_ITEM.names)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of arm=/seed= folders."""
    return spark.read.schema(schemas.RUNS).parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.partitionBy("arm", "seed").parquet(path)


def missing_runs(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """The (arm, seed) of expected that have no rows."""
    return expected.join(runs.select("arm", "seed").distinct(), ["arm", "seed"], "left_anti")


def append_metrics(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("append").json(path)


def append_once(path: str):
    """A function for foreachBatch that appends JSON lines so that a batch that is replayed adds nothing: each batch has a folder of its own,
    named by its id, which is written anew."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch_id={batch}")

    return write


def write_deficits(rows: DataFrame, path: str) -> None:
    """CSV: epoch, dataset_index, stem, deficit with six places, by epoch and index."""
    rows.select("epoch", "dataset_index", "stem", F.format_string("%.6f", "deficit").alias("deficit")).orderBy("epoch", "dataset_index").write.csv(path, header=True)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.csv(path, header=True)


def write_report(rows: DataFrame, path: str) -> None:
    """A JSON object for each row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def quantised(prob: str) -> Column:
    """A map of values in [0, 1] in 8 bits, not normalised."""
    return F.transform(prob, lambda p: F.rint(p * 255).cast("short"))


def markdown(rows: DataFrame, title: str) -> str:
    """A table for people, of a report whose rows fit on the driver; see write_markdown() for others."""
    names = rows.columns
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows.toLocalIterator():
        lines.append("| " + " | ".join(f"{v:+.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def write_markdown(rows: DataFrame, path: str) -> None:
    """The lines of such a table as text files, without a header."""
    cells = [F.format_string("%+.4f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in rows.dtypes]
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("None")) for c in cells]), F.lit(" |")).alias("value")).write.text(path)


def write_maps(rows: DataFrame, path: str, prob: str = "prob") -> None:
    """split, stem and the map in 8 bits (a byte for each cell, in row order), as Parquet by split."""
    cells = F.transform(quantised(prob), lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))
    rows.select("split", "stem", F.unhex(F.array_join(cells, "")).alias("map")).write.partitionBy("split").parquet(path)
