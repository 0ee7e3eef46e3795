"""More queries of the registry: layout reports, records on their way in and out, names, draws, checks of stored scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import numeric
from tidegauge.operators import aggregate, duplicates, grid, layout, manifest, records
from tidegauge.sources import files

from .catalog import _CELLS, _ITEMS, grids, items, rounded, scores, table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- maps -----------------------------------------------------------------------------------------------------------------


@query(_CELLS + ", p AS (SELECT vec_id, label, gt, 1 / (1 + exp(-val)) >= 0.5 AS pred FROM both_) SELECT vec_id, label, count(*) FILTER (pred AND gt) AS tp, count(*) FILTER (pred AND NOT gt) AS fp, count(*) FILTER (NOT pred AND gt) AS fn, count(*) FILTER (NOT pred AND NOT gt) AS tn FROM p GROUP BY vec_id, label")
def threshold_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grids(spark, sf_dir).withColumn("pred", grid.threshold(F.transform("values", numeric.sigmoid), 0.5))
    return grid.confusion(g).select("vec_id", "label", "tp", "fp", "fn", "tn")


@query(_CELLS + ", s AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN val * 1000 ELSE least(val, 1) END AS v FROM cells), m AS (SELECT vec_id, v, max(v) OVER (PARTITION BY vec_id) AS top FROM s) SELECT vec_id, count(*) FILTER (CASE WHEN top > 1 THEN v > 127 ELSE v > 0 END) AS n_set FROM m GROUP BY vec_id")
def binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.when(F.col("vec_id") % 2 == 0, v.cast("double") * 1000).otherwise(F.least(v.cast("double"), F.lit(1.0)))).alias("v"))
    return e.select("vec_id", F.size(F.filter(grid.binarise(F.col("v")), lambda x: x)).cast("long").alias("n_set"))


@query(_CELLS + "SELECT label, round(avg(gt::INT), 6) AS positive FROM truth GROUP BY label")
def positive_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("values"))
    return rounded(grid.truth_masks(e, "label").select("label", grid.positive_fraction("gt").alias("positive")))


@query(_CELLS + "SELECT vec_id, CAST(pos AS INT) AS pos, round(4 * val, 6) + 0 AS h_sum, round(4 * val / 3, 6) + 0 AS h_mean, round(val * val, 6) + 0 AS h_last FROM cells")
def head_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grids(spark, sf_dir).select("vec_id", F.array("values", F.transform("values", lambda v: 3 * v - v * v), F.transform("values", lambda v: v * v)).alias("heads"))
    parts = [records.combined_heads("heads", how) for how in ("sum", "mean", "last")]
    x = e.select("vec_id", F.posexplode(F.arrays_zip(*[p.alias(f"h{k}") for k, p in enumerate(parts)])).alias("pos", "h"))
    return rounded(x.select("vec_id", "pos", F.col("h.h0").alias("h_sum"), F.col("h.h1").alias("h_mean"), F.col("h.h2").alias("h_last")))


@query(_CELLS + "SELECT vec_id, pos % 2 AS channel, round(sum((val * 1000 / 255 - CASE WHEN pos % 2 = 0 THEN 0.485 ELSE 0.456 END) / CASE WHEN pos % 2 = 0 THEN 0.229 ELSE 0.224 END), 6) + 0 AS total FROM cells GROUP BY vec_id, pos % 2")
def standardised_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grids(spark, sf_dir).select("vec_id", F.transform("values", lambda v: v * 1000).alias("v"))
    x = e.select("vec_id", F.posexplode(records.standardised("v", [0.485, 0.456], [0.229, 0.224])).alias("pos", "s"))
    return rounded(x.groupBy("vec_id", (F.col("pos") % 2).cast("long").alias("channel")).agg(F.sum("s").alias("total")))


_FOUR = ", ".join(f"({i}, {k}, {c!r}::DOUBLE)" for i, row in enumerate(duplicates.resampling(8, 4)) for k, c in enumerate(row))


@query(_CELLS + f", m4 AS (SELECT * FROM (VALUES {_FOUR}) AS v(i, k, c)) SELECT vec_id, a.i * 4 + b.i AS pos, round(sum(val * a.c * b.c), 6) + 0 AS v FROM cells JOIN m4 a ON y = a.k JOIN m4 b ON x = b.k GROUP BY vec_id, a.i, b.i")
def resized_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grids(spark, sf_dir).select("vec_id", F.posexplode(duplicates.resized(F.col("values"), 8, 8, 4, 4)).alias("pos", "v"))
    return rounded(e)


_Q8 = "CAST(round_even(255.0::DOUBLE / (1 + exp(-val)), 0) AS INT)"


@query(_CELLS + f"SELECT vec_id, CAST(sum({_Q8}) AS BIGINT) AS total, CAST(max({_Q8}) AS INT) AS top FROM cells GROUP BY vec_id")
def quantised_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grids(spark, sf_dir).select("vec_id", F.transform("values", numeric.sigmoid).alias("p"))
    return e.select("vec_id", files.quantised("p").alias("q")).select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("q").cast("int").alias("top"))


@query(_CELLS + f", q AS (SELECT label, {_Q8} AS bin FROM cells), c AS (SELECT label, bin, count(*) AS n FROM q GROUP BY label, bin) SELECT l.label, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM cells) l CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN c ON c.label = l.label AND c.bin = b.bin")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grids(spark, sf_dir).select("label", files.quantised(F.transform("values", numeric.sigmoid)).alias("q"))
    return grid.bincount(e.withColumn("q", F.transform("q", lambda v: v.cast("int"))), "label", "q")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY l_returnflag")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(aggregate.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("price"))


# ---- records ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 64 AS INT) AS place FROM documents")
def ordered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64)


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|2|' || doc_id), doc_id) - 1 AS k FROM documents) SELECT doc_id, k // 64 AS batch, CAST(k % 64 AS INT) AS place FROM o")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64, seed=5, epoch=2)


@query("WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents) SELECT o_custkey % 100 AS idx, count(*) AS n, any_value(doc_id) AS doc_id FROM orders JOIN o ON o.idx = o_custkey % 100 GROUP BY o_custkey % 100")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = records.indexed(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"])
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    return asked.join(stems, "idx").select("idx", "n", "doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return records.with_extra(records.select_splits(d, ["en"], "lang"), d, ["fr", "de"], "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k > greatest(1, round_even(n * 0.1::DOUBLE, 0))")
def training_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.carve(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 7)[0]


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def overlap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return manifest.overlap(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey").distinct()


@query("SELECT c_custkey, round(('0x' || substr(md5('3|' || c_custkey || '|u'), 1, 13))::BIGINT * pow(2::DOUBLE, -52), 6) AS u, round(sqrt(-2 * ln(1 - ('0x' || substr(md5('3|' || c_custkey || '|r'), 1, 13))::BIGINT * pow(2::DOUBLE, -52))) * cos(2 * pi() * ('0x' || substr(md5('3|' || c_custkey || '|a'), 1, 13))::BIGINT * pow(2::DOUBLE, -52)), 6) + 0 AS z FROM customer")
def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", records.uniform(3, k, "u").alias("u"), records.normal(3, k).alias("z")))


@query("WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS v, max(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM o WHERE b IS NULL OR v > b")
def best_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return records.best_so_far(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_extendedprice").where("selected").select("l_suppkey", "l_orderkey", "l_linenumber")


@query(_CELLS + "SELECT label, round(avg(dice), 6) AS stored, round(avg(dice) + CASE WHEN label % 3 = 0 THEN 0.001 ELSE 0 END, 6) AS recomputed, label % 3 <> 0 AS ok FROM scores GROUP BY label")
def rescore_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).groupBy("label").agg(F.avg("dice").alias("value"))
    again = s.withColumn("value", F.col("value") + F.when(F.col("label") % 3 == 0, 0.001).otherwise(0.0))
    return rounded(records.rescored(s, again, ["label"]))


_CALLS = "SELECT year(l_shipdate) - 1991 AS epoch, l_discount > 0.04 AS active, l_quantity / 50.0::DOUBLE AS u, l_tax AS shape, l_tax * 1.5::DOUBLE AS shape_raw, l_extendedprice / 1000.0::DOUBLE AS scale, l_quantity AS level, l_tax > 0.06 AS clamped, l_linenumber = 7 AS degenerate FROM lineitem"


@query(f"SELECT epoch, count(*) AS n, round(avg(active::INT), 6) AS active, round(avg(u), 6) AS u, round(avg(shape), 6) AS shape, round(avg(shape_raw), 6) AS shape_raw, round(avg(scale), 6) AS scale, round(avg(level), 6) AS level, round(avg(clamped::INT), 6) AS clamped, round(avg(degenerate::INT), 6) AS degenerate, round(avg(active::INT) * 0.3, 6) AS effective_lam, epoch > 2 AND avg(active::INT) < 0.54 AS rarely_active, avg(clamped::INT) > 0.2 AS often_clamped FROM ({_CALLS}) GROUP BY epoch")
def epoch_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    calls = table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") - 1991).cast("long").alias("epoch"), (c("l_discount") > 0.04).alias("active"), (c("l_quantity") / 50.0).alias("u"), c("l_tax").alias("shape"), (c("l_tax") * 1.5).alias("shape_raw"),
        (c("l_extendedprice") / 1000.0).alias("scale"), c("l_quantity").alias("level"), (c("l_tax") > 0.06).alias("clamped"), (c("l_linenumber") == 7).alias("degenerate"),
    )
    return rounded(records.epoch_flush(calls, 2, 0.54))


# ---- names and members ---------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'data/top/' END || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '\\' END || c_name || CASE c_custkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.a.jpg' ELSE '' END AS path FROM customer), n AS (SELECT c_custkey, replace(path, '\\', '/') AS q FROM p), b AS (SELECT *, regexp_replace(q, '^.*/', '') AS base FROM n)
SELECT c_custkey, CASE WHEN starts_with(q, 'data/top/') THEN substr(q, 10) ELSE q END AS relative, base, CASE WHEN base LIKE '_%.%' THEN regexp_replace(base, '\\.[^.]+$', '') ELSE base END AS stem, lower(regexp_extract(base, '(\\.[^.]+)$', 1)) AS ext, contains(q, 'BUILD') AS building, starts_with(base, 'Customer#00000000') AS low FROM b""".replace("\\\\", "\\"))
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ext = F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".a.jpg").otherwise("")
    path = F.concat(F.when(k % 5 == 0, "").otherwise("data/top/"), "c_mktsegment", F.when(k % 2 == 0, "/").otherwise("\\"), "c_name", ext)
    parts = files.path_parts("path", "data\\top")
    x = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return x.select("c_custkey", *[v.alias(n) for n, v in parts.items()], F.contains(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("BUILD")).alias("building"), F.startswith(parts["base"], F.lit("Customer#00000000")).alias("low"))


_NAMES = ("CVC-T", "etis larib", "ETIS", "Kvasir SEG", "kvasir-seg", "CVC 612", "cvc612", "masks")
_WANT = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if (t := layout.ALIASES.get(n.lower().replace(' ', ''))) is None else repr(t)}" for i, n in enumerate(_NAMES)) + " END"


@query(f"SELECT c_custkey, {_WANT} AS split FROM customer")
def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", layout.alias(name).alias("split"))


@query("WITH k AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k FROM orders), e AS (SELECT s, min(k) AS lo, max(k) AS hi FROM k GROUP BY s HAVING max(k) - min(k) <= 100000), r AS (SELECT s, unnest(range(lo, hi + 1)) AS missing FROM e) SELECT r.s, r.missing FROM r LEFT JOIN k ON k.s = r.s AND k.k = r.missing WHERE k.k IS NULL")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("k"))
    return manifest.missing_numbers(o, "s", "k")


@query(_ITEMS + "SELECT items.content_hash, items.split, items.id FROM items JOIN groups ON items.content_hash = groups.content_hash")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return duplicates.members(i, duplicates.exact_groups(i))


@query(_ITEMS + "SELECT location, n_groups, row_number() OVER (ORDER BY n_groups DESC, location) AS place FROM loc")
def locations_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = duplicates.by_location(duplicates.exact_groups(items(spark, sf_dir)))
    return records.indexed(x.withColumn("_down", -F.col("n_groups")), ["_down", "location"]).select("location", "n_groups", (F.col("idx") + 1).alias("place"))


# ---- layout -----------------------------------------------------------------------------------------------------------------------

EXPECTED = layout.Expected({"en": 700, "fr": 100, "it": 50}, training="en", held_out="es", composition={"fr": {"all": 100}})


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images and masks of splits (languages), with lost, doubled and resized ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"), (F.col("n_chars") % 7).cast("int").alias("w"))
    k, stem = F.col("doc_id"), F.col("doc_id").cast("string")
    one = lambda rows, side, ext, w: rows.select("split", side.alias("side"), stem.alias("stem"), ext.alias("ext"), w.alias("w"), F.lit(1).alias("h"))
    images = one(d.where(k % 17 != 0), F.lit("images"), F.when(k % 23 == 0, ".bmp").otherwise(".PNG"), F.col("w"))
    masks = one(d.where(k % 19 != 0), F.when(F.col("split") == "fr", "gt").otherwise("masks"), F.when(k % 29 == 0, ".tif").otherwise(".png"), F.when(k % 31 == 0, F.col("w") + 1).otherwise(F.col("w")))
    twice = one(d.where(k % 37 == 0), F.lit("images"), F.lit(".jpg"), F.col("w"))
    return images.unionByName(masks).unionByName(twice)


_TREE = """WITH d AS (SELECT doc_id AS k, lang AS split, doc_id::VARCHAR AS stem, CAST(n_chars % 7 AS INT) AS w FROM documents
), f AS (SELECT split, stem, 'image' AS role, 'images' AS side, CASE WHEN k % 23 = 0 THEN '.bmp' ELSE '.PNG' END AS ext, w FROM d WHERE k % 17 <> 0
  UNION ALL SELECT split, stem, 'mask', CASE WHEN split = 'fr' THEN 'gt' ELSE 'masks' END, CASE WHEN k % 29 = 0 THEN '.tif' ELSE '.png' END, CASE WHEN k % 31 = 0 THEN w + 1 ELSE w END FROM d WHERE k % 19 <> 0
  UNION ALL SELECT split, stem, 'image', 'images', '.jpg', w FROM d WHERE k % 37 = 0
), p AS (SELECT split, stem, count(*) FILTER (role = 'image') AS images, count(*) FILTER (role = 'mask') AS masks, max(w) FILTER (role = 'image') = max(w) FILTER (role = 'mask') AS same FROM f GROUP BY split, stem
), n AS (SELECT split, count(*) AS n FROM p WHERE images > 0 AND masks > 0 GROUP BY split), e AS (SELECT * FROM (VALUES ('en', 700), ('fr', 100), ('it', 50)) AS v(split, expected)), h AS (SELECT coalesce(max(n), 0) AS held FROM n WHERE split = 'es'
), c AS (SELECT coalesce(n.split, e.split) AS split, coalesce(n, 0) AS n, CAST(expected AS BIGINT) AS expected, CAST(coalesce(n, 0) - expected AS BIGINT) AS delta,
  CASE WHEN n IS NULL THEN 'missing' WHEN expected IS NULL THEN 'held_out' WHEN n = expected THEN 'ok' WHEN coalesce(n.split, e.split) = 'en' AND n + held = expected THEN 're-split' ELSE 'mismatch' END AS status FROM n FULL JOIN e ON n.split = e.split CROSS JOIN h
), b AS (SELECT 'error' AS severity, split, 'duplicate_stem' AS kind, stem FROM p WHERE images > 1 OR masks > 1 UNION ALL SELECT 'error', split, 'no_mask', stem FROM p WHERE images > 0 AND masks = 0 UNION ALL SELECT 'error', split, 'no_image', stem FROM p WHERE images = 0 AND masks > 0
  UNION ALL SELECT 'error', split, 'size', stem FROM p WHERE images > 0 AND masks > 0 AND NOT same
  UNION ALL SELECT DISTINCT 'warn', split, 'extension', stem || ext FROM f WHERE CASE WHEN role = 'image' THEN lower(ext) NOT IN ('.jpg', '.png') WHEN split = 'en' THEN lower(ext) <> '.png' ELSE lower(ext) NOT IN ('.tif', '.png') END
), r AS (SELECT severity, split, kind, stem, row_number() OVER (PARTITION BY severity, split, kind ORDER BY stem) AS i, count(*) OVER (PARTITION BY severity, split, kind) AS n FROM b)
"""


@query(_TREE + """SELECT severity, split, kind, max(n) AS n, string_agg(stem, ',' ORDER BY stem) AS examples FROM r WHERE i <= 4 GROUP BY severity, split, kind
UNION ALL SELECT 'error', split, 'missing_split', 1, '' FROM e WHERE split NOT IN (SELECT split FROM f)
UNION ALL SELECT 'note', split, 'mask_folder', 1, 'gt' FROM (SELECT DISTINCT split FROM f WHERE side = 'gt')
UNION ALL SELECT 'warn', split, 'count', abs(delta), n || ' of ' || expected FROM c WHERE status = 'mismatch' UNION ALL SELECT 'note', split, 're_split', abs(delta), n || ' of ' || expected FROM c WHERE status = 're-split'
UNION ALL SELECT 'warn', 'en', 'partition', abs(s - 700), s::VARCHAR FROM (SELECT CAST(sum(n) AS BIGINT) AS s, count(*) AS k FROM n WHERE split IN ('en', 'es')) WHERE k = 2 AND s <> 700
UNION ALL SELECT 'warn', split, 'unknown_split', count(*) FILTER (side = 'images'), '' FROM f WHERE split NOT IN ('en', 'fr', 'it', 'es') GROUP BY split""")
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.report(tree(spark, sf_dir), EXPECTED)


@query(_TREE + "SELECT * FROM c")
def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.counts(tree(spark, sf_dir), EXPECTED)


@query(_TREE + """, x AS (SELECT p.* FROM p JOIN c ON p.split = c.split WHERE status = 'mismatch'), y AS (SELECT split, CAST(stem AS BIGINT) AS k FROM x WHERE images > 0 AND masks > 0), z AS (SELECT split, k, lead(k) OVER (PARTITION BY split ORDER BY k) - k - 1 AS gap FROM y), g AS (SELECT split, min(k) AS lo, max(k) AS hi, CAST(coalesce(sum(gap), 0) AS BIGINT) AS m, count(*) FILTER (gap > 0) AS runs FROM z GROUP BY split)
SELECT split, 'images' AS kind, CAST(sum(images) AS BIGINT) AS n, '' AS detail FROM x GROUP BY split UNION ALL SELECT split, 'masks', CAST(sum(masks) AS BIGINT), '' FROM x GROUP BY split
UNION ALL SELECT split, 'names: numeric', count(*), CASE WHEN split = 'fr' AND count(*) = 100 THEN 'all' ELSE '' END FROM y GROUP BY split
UNION ALL SELECT split, 'numbers: ' || CASE WHEN m = 0 THEN 'unbroken' WHEN runs <= 1 THEN 'block' ELSE 'scattered' END, m, lo || '-' || hi FROM g WHERE hi > lo AND hi - lo <= 100000""")
def layout_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.explain(tree(spark, sf_dir), EXPECTED)
