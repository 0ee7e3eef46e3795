"""Trees of images: decoding, manifests of image and mask pairs, hashes, and the duplicate audit from files to one report.

A tree is <split>/<side>/<file>, a split being one folder or several. Spark's image source decodes (PNG, JPEG, BMP, GIF) and gives a row for files that
can't be read too; its bytes come as blue, green, red. Here they become the bytes that are hashed: red, green, blue for
images, one channel of luma for masks and for the hashes of likeness, whatever channels a file has (of four the last is dropped). What is done to the
pixels of one image is one step of arrays in its task; pixels are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import duplicates, layout
from tidegauge.sources.shared import written

from . import schemas
from .files import path_parts

EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".gif")
MODES = {1: "L", 3: "RGB", 4: "RGBA"}
#: Weights of red, green and blue in luma, in 16 bits; fixed values.
LUMA = (19595, 38470, 7471)
#: Bits after the point of the weights of a resize.
PRECISION = 22


def decoded(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, relative, split, side, stem, ext, ok, w, h, mode, channels and data (as decoded) of the images of a tree. ok is false,
    and the rest of the image null, for files that can't be read."""
    x = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root).select("image.*")
    top = F.lit(root.rstrip("/") + "/")
    plain = F.regexp_replace("origin", "^file:/+", "/") if "://" not in root else F.col("origin")
    x = x.withColumn("path", F.col("origin")).withColumn("relative", F.when(F.startswith(plain, top), F.substr(plain, F.length(top) + 1)).otherwise(plain))
    parts, at = path_parts("relative", ""), F.split("relative", "/")
    folders = F.array_join(F.slice(at, F.lit(1), F.greatest(F.size(at) - 2, F.lit(0))), "/")
    x = x.withColumns({"ok": F.col("width") > 0, "split": folders, "side": F.try_element_at(at, F.lit(-2)), "stem": parts["stem"], "ext": parts["ext"]}).where(F.col("ext").isin(*extensions))
    real = lambda c: F.when(F.col("ok"), F.col(c))
    mode = F.try_element_at(F.create_map(*[F.lit(v) for pair in MODES.items() for v in pair]), F.col("nChannels"))
    return x.select("path", "relative", "split", "side", "stem", "ext", "ok", real("width").alias("w"), real("height").alias("h"), mode.alias("mode"), real("nChannels").alias("channels"), real("data").alias("data"))


def layout_files(spark: SparkSession, root: str) -> DataFrame:
    """The input of layout.report(), with the sizes of images; files that can't be read have a width of -1."""
    return decoded(spark, root).select("split", "side", "stem", "ext", F.coalesce("w", F.lit(-1)).alias("w"), F.coalesce("h", F.lit(-1)).alias("h"))


def _pixels(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, channels)


def rgb(x: np.ndarray) -> np.ndarray:
    """h x w x 3 in red, green, blue from pixels as decoded."""
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, 2::-1]


def luma(x: np.ndarray) -> np.ndarray:
    """h x w in one channel from pixels as decoded."""
    if x.shape[2] == 1:
        return x[:, :, 0]
    r, g, b = (x[:, :, k].astype(np.int64) for k in (2, 1, 0))
    return ((r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0x8000) >> 16).astype(np.uint8)


def resized(grid: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """One channel in another size by the Lanczos kernel: rows of pixels first, then columns, each in whole numbers with eight bits as the result."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        if x.shape[1] == n:
            return x
        weights = np.array(duplicates.resampling(x.shape[1], n)) * (1 << PRECISION)
        whole = np.trunc(weights + np.where(weights < 0, -0.5, 0.5)).astype(np.int64)
        return np.clip((x.astype(np.int64) @ whole.T + (1 << (PRECISION - 1))) >> PRECISION, 0, 255).astype(np.uint8)

    return along(along(grid, columns).T, rows).T


def hash_bits(grid: np.ndarray) -> list[np.ndarray]:
    """64 booleans of each of duplicates.HASHES: values above the mean of 8 x 8; above their left neighbour in 8 rows of 9; coefficients of
    32 x 32 above the median of all but the first, whose bit is 0."""
    a, d, p = (resized(grid, *size).astype(np.float64) for size in ((8, 8), (8, 9), (32, 32)))
    basis = np.array(duplicates.cosine_rows(32, 8))
    c = (basis @ p @ basis.T).reshape(-1)
    low = c > np.median(c[1:])
    low[0] = False
    return [(a > a.mean()).reshape(-1), (d[:, 1:] > d[:, :-1]).reshape(-1), low]


_NEEDED = ("data", "h", "w", "channels")


def _each(f, kind: str):
    """A function of columns _NEEDED that is f(pixels) of each row, null where the image is."""

    @F.arrow_udf(kind)
    def run(data: pa.Array, h: pa.Array, w: pa.Array, channels: pa.Array) -> pa.Array:
        rows = zip(data, h.to_pylist(), w.to_pylist(), channels.to_pylist())
        return pa.array([None if n is None else f(_pixels(d.as_py(), y, x, n)) for d, y, x, n in rows], arrow)

    arrow = {"string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[kind]
    return run(*_NEEDED)


def pixel_sha256(as_mask: bool):
    """The digest of the pixels of an image, or of a mask in one channel."""
    import hashlib

    return _each(lambda x: hashlib.sha256(np.ascontiguousarray(luma(x) if as_mask else rgb(x)).tobytes()).hexdigest(), "string")


def positive_fraction():
    """The share of set pixels of a mask: above 127 if the largest value is above 1, else above 0."""

    def share(x: np.ndarray) -> float:
        g = luma(x)
        return float((g > (127 if g.max(initial=0) > 1 else 0)).mean()) if g.size else 0.0

    return _each(share, "double")


def hashes(images: DataFrame) -> DataFrame:
    """split, id (relative path) and <hash>_lo, <hash>_hi of decoded images; those that can't be read have none and are left out."""
    weights = 1 << np.arange(32, dtype=np.int64)
    both = lambda bits: [int(bits[:32] @ weights), int(bits[32:] @ weights)]
    packed = _each(lambda x: [v for bits in hash_bits(luma(x)) for v in both(bits)], "array<long>")
    names = [f"{h}_{part}" for h in duplicates.HASHES for part in ("lo", "hi")]
    x = images.where("ok").withColumn("_h", packed)
    return x.select("split", F.col("relative").alias("id"), *[F.get("_h", F.lit(k)).alias(n) for k, n in enumerate(names)])


def manifest_items(spark: SparkSession, root: str, splits: list[str], strict_sizes: bool = True) -> DataFrame:
    """The items of a manifest (schemas.MANIFEST_ITEM): each image of the splits with its mask. Written, since errors are looked for first.

    Errors, each with up to five examples: a split without masks, several mask folders that differ, a stem twice on one side, an image or a mask
    without its counterpart, a file that can't be read and, with strict_sizes, sizes that differ.
    """
    x = decoded(spark, root).where(F.col("split").isin(*splits) & F.col("side").isin("images", *layout.MASKS))
    mask = F.col("side") != "images"
    common = ["split", "side", "stem", "relative", "path", "ok", "w", "h", "mode"]
    pixels = x.where(~mask).select(*common, pixel_sha256(False).alias("pixel_sha256"), F.lit(None).cast("double").alias("share"))
    masks = x.where(mask).select(*common, pixel_sha256(True).alias("pixel_sha256"), positive_fraction().alias("share"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    same_path = lambda c: F.regexp_replace(c, "^file:/+", "/")
    raw = raw.select(same_path("path").alias("_path"), F.sha2("content", 256).alias("sha256"))
    described = pixels.unionByName(masks).withColumn("_path", same_path("path")).join(raw, "_path").drop("_path", "path")
    described = written(described, "described")

    def complain(bad: DataFrame, what: str) -> None:
        rows = bad.select("split", "stem").distinct().orderBy("split", "stem").limit(5).collect()
        if rows:
            raise ValueError(f"{what}: " + ", ".join(f"{r['split']}/{r['stem']}" for r in rows))

    folders = described.where("side <> 'images'").groupBy("split", "side").agg(F.countDistinct("stem").alias("k"), F.sum(F.xxhash64("stem").cast("decimal(38,0)")).alias("sum"))
    order = F.array_position(F.array(*[F.lit(n) for n in layout.MASKS]), F.col("side"))
    chosen = folders.groupBy("split").agg(F.min_by("side", order).alias("side"), F.countDistinct("k", "sum").alias("kinds"))
    have = {r["split"]: r["kinds"] for r in chosen.collect()}  # a row for each split asked for
    if lost := [s for s in splits if s not in have]:
        raise FileNotFoundError(f"no folder of masks in {lost}")
    if odd := [s for s, kinds in have.items() if kinds > 1]:
        raise ValueError(f"several folders of masks that differ in {odd}")
    side_a = described.where("side = 'images'")
    side_b = described.join(F.broadcast(chosen.select("split", "side")), ["split", "side"])
    for side, name in ((side_a, "images"), (side_b, "masks")):
        complain(side.groupBy("split", "stem").agg(F.count("*").alias("n")).where("n > 1"), f"stems twice among {name}")
        complain(side.where("NOT ok"), f"{name} that can't be read")
    complain(side_a.join(side_b.select("split", "stem"), ["split", "stem"], "left_anti"), "images without a mask")
    complain(side_b.join(side_a.select("split", "stem"), ["split", "stem"], "left_anti"), "masks without an image")
    own = lambda df, name: df.select("split", "stem", F.col("relative").alias(name), F.col("sha256").alias(f"{name}_sha256"), F.col("pixel_sha256").alias(f"{name}_pixel_sha256"), F.struct("w", "h").alias(f"{name}_size"), F.col("mode").alias(f"{name}_mode"), F.col("share").alias(f"{name}_share"))
    pairs = own(side_a, "image").join(own(side_b, "mask"), ["split", "stem"])
    if strict_sizes:
        complain(pairs.where("image_size <> mask_size"), "image and mask of different sizes")
    return pairs.withColumn("mask_positive_frac", F.col("mask_share")).select(*schemas.MANIFEST_ITEM.names)


def audit(spark: SparkSession, root: str, items: DataFrame, most: int = 8, k: int = 50) -> dict[str, DataFrame]:
    """The duplicate audit of the images of a manifest: counts, pairs (flagged), matrix, nearest (for each hash and two splits), closest, exact
    groups, and findings."""
    images = decoded(spark, root).join(items.select(F.col("image").alias("relative")), "relative", "left_semi")
    h = written(hashes(images), "hashes")
    pairs = written(duplicates.flagged(h, most), "pairs")
    exact = duplicates.exact_groups(items.select("split", F.col("stem").alias("id"), F.col("image_pixel_sha256").alias("content_hash")))
    near = None
    for name in duplicates.HASHES:
        one = duplicates.nearest_summary(duplicates.nearest(h, name)).withColumn("hash", F.lit(name))
        near = one if near is None else near.unionByName(one)
    near = written(near, "nearest")
    found = duplicates.findings(duplicates.by_location(exact), near.where("hash = 'p'").drop("hash"))
    return {"counts": items.groupBy("split").agg(F.count("*").alias("n")), "matrix": duplicates.collision_matrix(pairs), "pairs": pairs, "exact": exact, "nearest": near, "closest": duplicates.closest(h, k), "findings": found}


def write_audit(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON document with a list for each part of the audit, rows in order of all their columns. Its size is that of the report, held by one task."""
    out = None
    for name, df in parts.items():
        rows = F.sort_array(F.collect_list(F.struct(*df.columns)))
        one = df.agg(rows.alias(name))
        out = one if out is None else out.join(one)  # one row each
    out.coalesce(1).write.json(path)
