"""Is a tree of images and masks laid out as expected? A table of findings, of counts, and of what explains a wrong count.

Files are rows (split, side, stem, ext, w, h), side being the folder below the split; sizes may be NULL, and are -1 for files that
can't be read. Nothing is written.
Severities: error (pairs can't be trusted), warn (may be legitimate), note.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import manifest

#: Folder names under which splits travel, in lower case without spaces, and the name they should have.
ALIASES = {
    "cvc-t": "CVC-300", "cvct": "CVC-300", "endoscene": "CVC-300", "cvc300": "CVC-300", "cvc_300": "CVC-300",
    "cvc-clinicdb": "CVC-ClinicDB", "cvc612": "CVC-ClinicDB", "cvc-612": "CVC-ClinicDB", "cvc-colondb": "CVC-ColonDB",
    "etis": "ETIS-LaribPolypDB", "etis-larib": "ETIS-LaribPolypDB", "etislaribpolypdb": "ETIS-LaribPolypDB", "kvasir-seg": "Kvasir", "kvasir_seg": "Kvasir",
}
#: Folders of masks in order of preference, and extensions that loaders take.
MASKS = ("masks", "gt", "gts")
IMAGE_EXTENSIONS, TRAIN_MASK_EXTENSIONS, TEST_MASK_EXTENSIONS = (".jpg", ".png"), (".png",), (".tif", ".png")


@dataclass(frozen=True)
class Expected:
    """counts: pairs of each split; training: the split whose masks have fewer extensions; held_out: the split that may have been
    taken out of it; composition: for a split the sizes of the corpora it is made of."""

    counts: dict[str, int]
    training: str | None = None
    held_out: str | None = None
    composition: dict[str, dict[str, int]] = field(default_factory=dict)


def alias(name: Column | str, table: dict[str, str] | None = None) -> Column:
    """The name that a folder should have: lower case, without spaces, looked up; NULL if unknown."""
    c = F.col(name) if isinstance(name, str) else name
    pairs = sorted((ALIASES if table is None else table).items())
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(known, F.replace(F.lower(c), F.lit(" "), F.lit("")))


def accepted(side: Column, ext: Column, training: Column) -> Column:
    """Whether a loader that goes by extension takes a file."""
    e = F.lower(ext)
    return F.when(side == "images", e.isin(*IMAGE_EXTENSIONS)).when(training, e.isin(*TRAIN_MASK_EXTENSIONS)).otherwise(e.isin(*TEST_MASK_EXTENSIONS))


def sides(files: DataFrame) -> DataFrame:
    """files of images and of the mask folder that counts, with role (image, mask)."""
    order = F.array_position(F.array(*[F.lit(m) for m in MASKS]), F.col("side"))
    chosen = files.where(F.col("side").isin(*MASKS)).groupBy("split").agg(F.min_by("side", order).alias("_mask"))
    x = files.join(chosen, "split", "left")
    return x.where((F.col("side") == "images") | (F.col("side") == F.col("_mask"))).withColumn("role", F.when(F.col("side") == "images", "image").otherwise("mask")).drop("_mask")


def pairs(files: DataFrame) -> DataFrame:
    """split, stem, images, masks (files on each side) and same_size (NULL where a size is unknown), of every stem."""
    size = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    g = sides(files).groupBy("split", "stem").agg(
        F.count_if(F.col("role") == "image").alias("images"), F.count_if(F.col("role") == "mask").alias("masks"),
        size("image", "w").alias("wi"), size("image", "h").alias("hi"), size("mask", "w").alias("wm"), size("mask", "h").alias("hm"),
    )
    known = (F.col("wi") >= 0) & (F.col("wm") >= 0)
    return g.withColumn("same_size", F.when(known, (F.col("wi") == F.col("wm")) & (F.col("hi") == F.col("hm")))).drop("wi", "hi", "wm", "hm")


def counts(files: DataFrame, expected: Expected) -> DataFrame:
    """split, n, expected, delta, status of manifest.reconcile(): ok, missing, re-split, held_out or mismatch."""
    have = pairs(files).where("images > 0 AND masks > 0").groupBy("split").agg(F.count("*").alias("n"))
    want = files.sparkSession.createDataFrame(sorted(expected.counts.items()), "split string, expected long")
    return manifest.reconcile(have, want, expected.training, expected.held_out)


def _finding(df: DataFrame, severity: str, kind: str, examples: int = 4) -> DataFrame:
    """One row for each split of (split, stem): how many stems, and the smallest few. Only the few are gathered."""
    few = F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("_k") <= examples, F.col("stem")))), 1, examples), ",")
    from pyspark.sql import Window

    ranked = df.select("split", "stem").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("split").orderBy("stem")))
    n = df.select("split", "stem").distinct().groupBy("split").agg(F.count("*").alias("n"))
    first = ranked.where(F.col("_k") <= examples).groupBy("split").agg(few.alias("examples"))
    return n.join(first, "split").select(F.lit(severity).alias("severity"), "split", F.lit(kind).alias("kind"), "n", "examples")


def report(files: DataFrame, expected: Expected) -> DataFrame:
    """severity, split, kind, n, examples: what is wrong, suspicious or worth a note; no error means that pairs can be used.

    error: missing_split, renamed (examples has the folder to rename), missing_side, ambiguous_masks, duplicate_stem, no_mask,
    no_image, unreadable, size. warn: extension, count, partition, unknown_split. note: mask_folder, re_split.
    """
    spark = files.sparkSession
    p = pairs(files)
    both = "images > 0 AND masks > 0"
    role = sides(files)
    training = F.col("split").eqNullSafe(F.lit(expected.training))
    rows = [
        _finding(p.where("images > 1 OR masks > 1"), "error", "duplicate_stem"),
        _finding(p.where("images > 0 AND masks = 0"), "error", "no_mask"),
        _finding(p.where("images = 0 AND masks > 0"), "error", "no_image"),
        _finding(role.where("w < 0"), "error", "unreadable"),
        _finding(p.where(f"{both} AND NOT same_size"), "error", "size"),
        _finding(role.where(~accepted(F.col("side"), F.col("ext"), training)).select("split", F.concat("stem", "ext").alias("stem")), "warn", "extension"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    line = lambda df, severity, kind, n, examples: df.select(F.lit(severity).alias("severity"), "split", F.lit(kind).alias("kind"), n.cast("long").alias("n"), examples.alias("examples"))
    present = files.groupBy("split").agg(F.count_if(F.col("side") == "images").alias("i"), F.count_if(F.col("side").isin(*MASKS)).alias("m"))
    want = spark.createDataFrame([(s,) for s in sorted(expected.counts)], "split string")
    gone = want.join(present, "split", "left_anti")
    out = out.unionByName(line(gone, "error", "missing_split", F.lit(1), F.lit("")))
    other = files.select(F.col("split").alias("found")).distinct().withColumn("split", alias("found")).where("split IS NOT NULL AND split <> found")
    out = out.unionByName(line(other.join(gone, "split"), "error", "renamed", F.lit(1), F.col("found")))
    out = out.unionByName(line(present.where("i = 0 OR m = 0"), "error", "missing_side", F.lit(1), F.when(F.col("i") == 0, "images").otherwise("masks")))
    several = files.where(F.col("side").isin(*MASKS)).groupBy("split", "side").agg(F.countDistinct("stem").alias("k"), F.sum(F.xxhash64("stem").cast("decimal(38,0)")).alias("h")).groupBy("split").agg(F.array_join(F.sort_array(F.collect_set("side")), ",").alias("s"), F.countDistinct("k", "h").alias("different"), F.count("*").alias("n"))
    out = out.unionByName(line(several.where("different > 1"), "error", "ambiguous_masks", F.col("n"), F.col("s")))
    out = out.unionByName(line(several.where(f"different = 1 AND s <> '{MASKS[0]}'"), "note", "mask_folder", F.col("n"), F.col("s")))
    c = counts(files, expected)
    text = F.format_string("%d of %d", F.col("n"), F.col("expected"))
    out = out.unionByName(line(c.where("status = 'mismatch'"), "warn", "count", F.abs("delta"), text))
    out = out.unionByName(line(c.where("status = 're-split'"), "note", "re_split", F.abs("delta"), text))
    if expected.training and expected.held_out:
        total = c.where(F.col("split").isin(expected.training, expected.held_out)).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k"))
        off = total.where((F.col("k") == 2) & (F.col("n") != expected.counts[expected.training])).withColumn("split", F.lit(expected.training))
        out = out.unionByName(line(off, "warn", "partition", F.abs(F.col("n") - expected.counts[expected.training]), F.col("n").cast("string")))
    known = [*expected.counts, *([expected.held_out] if expected.held_out else [])]
    return out.unionByName(line(present.where(~F.col("split").isin(*known)), "warn", "unknown_split", F.col("i"), F.lit("")))


def usable(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()


def explain(files: DataFrame, expected: Expected) -> DataFrame:
    """split, kind, n, detail for the splits whose count is not the expected one: files on each side, paired stems by shape of name
    (detail: the corpus that has just so many), and what the numbers among the names say: unbroken, block or scattered."""
    wrong = counts(files, expected).where("status = 'mismatch'").select("split")
    p = pairs(files).join(F.broadcast(wrong), "split")  # a row for each expected split
    both = p.where("images > 0 AND masks > 0").withColumn("shape", manifest.name_shape("stem"))
    line = lambda df, kind, n, detail: df.select("split", kind.alias("kind"), n.cast("long").alias("n"), detail.alias("detail"))
    out = line(p.groupBy("split").agg(F.sum("images").alias("i")), F.lit("images"), F.col("i"), F.lit(""))
    out = out.unionByName(line(p.groupBy("split").agg(F.sum("masks").alias("m")), F.lit("masks"), F.col("m"), F.lit("")))
    rows = [(s, k, n) for s, parts in expected.composition.items() for k, n in parts.items()]
    known = files.sparkSession.createDataFrame(rows or [("", "", -1)], "split string, corpus string, n long")
    shapes = both.groupBy("split", "shape").agg(F.count("*").alias("n")).join(F.broadcast(known), ["split", "n"], "left")
    out = out.unionByName(line(shapes, F.concat(F.lit("names: "), "shape"), F.col("n"), F.coalesce("corpus", F.lit(""))))
    numbers = both.where("shape = 'numeric'").select("split", F.col("stem").cast("long").alias("k"))
    gaps = manifest.numeric_gaps(numbers, "split", "k").where(f"hi > lo AND hi - lo <= {manifest.SPAN}")
    kind = F.when(F.col("n_missing") == 0, "unbroken").when(F.col("contiguous"), "block").otherwise("scattered")
    return out.unionByName(line(gaps, F.concat(F.lit("numbers: "), kind), F.col("n_missing"), F.format_string("%d-%d", F.col("lo"), F.col("hi"))))
