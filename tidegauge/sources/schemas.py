"""Explicit schemas: nothing is inferred."""

from pyspark.sql import types as T

MANIFEST_VERSION = "tidegauge/manifest/1"

_SIZE = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())])
MANIFEST_ITEM = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("mask", T.StringType()),
    T.StructField("image_sha256", T.StringType()),
    T.StructField("mask_sha256", T.StringType()),
    T.StructField("image_pixel_sha256", T.StringType()),
    T.StructField("mask_pixel_sha256", T.StringType()),
    T.StructField("image_size", _SIZE),
    T.StructField("mask_size", _SIZE),
    T.StructField("image_mode", T.StringType()),
    T.StructField("mask_mode", T.StringType()),
    T.StructField("mask_positive_frac", T.DoubleType()),
])
_ITEM = T.StructType([f for f in MANIFEST_ITEM if f.name != "split"])
MANIFEST = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("created_utc", T.StringType()),
    T.StructField("root_name", T.StringType()),
    T.StructField("splits", T.MapType(T.StringType(), T.StructType([T.StructField("n_pairs", T.LongType()), T.StructField("items", T.ArrayType(_ITEM))]))),
    T.StructField("total_pairs", T.LongType()),
])
RUNS = T.StructType([T.StructField("arm", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("dataset", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("value", T.DoubleType())])
