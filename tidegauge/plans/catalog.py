"""The registry of queries over the driver tables, with the DuckDB statement of each.

Grids: embeddings as 8 x 8 maps, label as split; truth is where a split's mean is positive, prediction where a value is.
Streams: events in order of (ts, event_id) for each event_type, d = least(1, value / 500), batches of 16. Samples: l_quantity /
50 by l_returnflag. Arms: dice of predictions at three thresholds for each of two arms. Floats are rounded to six places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import aggregate, duplicates, grid, manifest, paired, pool, tail
from tidegauge.sources.shared import shared_dir, written, written_to
from tidegauge.streaming import tail_state

P, ALPHA = 0.15, 0.02
RATIO = math.log(P / ALPHA)
TAUS = {"a": (-0.02, 0.0, 0.02), "b": (-0.01, 0.01, 0.03)}
#: Another arm against the same second arm.
SECOND = {"a": (-0.03, 0.01, 0.04), "b": TAUS["b"]}
N_BOOT = 10_000
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to six places, those of `more` to nine."""
    return df.select(*[(F.round(c.name, 9 if c.name in more else 6) + 0.0).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


# ---- grids ------------------------------------------------------------------------------------------------------------


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, values, gt, pred."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("values"))
    return e.join(grid.truth_masks(e, "label"), "label").withColumn("pred", F.transform("values", lambda v: v > 0))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.binary_scores(grid.confusion(grids(spark, sf_dir)))


_CELLS = """WITH cells AS (
  SELECT vec_id, label, p - 1 AS pos, (p - 1) // 8 AS y, (p - 1) % 8 AS x, CAST(embedding[p] AS DOUBLE) AS val
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS p FROM embeddings)
), truth AS (SELECT label, pos, avg(val) > 0 AS gt FROM cells GROUP BY label, pos
), both_ AS (SELECT c.vec_id, c.label, c.pos, c.y, c.x, c.val, c.val > 0 AS pred, t.gt FROM cells c JOIN truth t ON c.label = t.label AND c.pos = t.pos
), counts AS (
  SELECT vec_id, label, count(*) FILTER (pred AND gt) AS tp, count(*) FILTER (pred AND NOT gt) AS fp, count(*) FILTER (NOT pred AND gt) AS fn, count(*) FILTER (NOT pred AND NOT gt) AS tn
  FROM both_ GROUP BY vec_id, label
), scores AS (
  SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) END AS dice,
    CASE WHEN tp + fp + fn = 0 THEN 1 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END AS iou,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
    CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS specificity, tp + fp = 0 AS pred_empty, tp + fn = 0 AS gt_empty
  FROM counts
)
"""
_TAIL = "round(avg(CASE WHEN dice <= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dice_le_05, round(avg(CASE WHEN dice <= 0.75 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dice_le_075, round(quantile_cont(dice, 0.05), 6) AS dice_p05, round(quantile_cont(dice, 0.1), 6) AS dice_p10, round(CASE WHEN count(*) > 1 THEN stddev_samp(dice) ELSE 0 END, 6) AS dice_sd"


@query(_CELLS + f"SELECT label, count(*) AS n, round(avg(dice), 6) AS dice_mean, {_TAIL} FROM scores GROUP BY label")
def tail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.tail_report(scores(spark, sf_dir), "label"))


@query(_CELLS + "SELECT vec_id, label, tp, fp, fn, tn FROM counts")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.confusion(grids(spark, sf_dir)).select("vec_id", "label", "tp", "fp", "fn", "tn")


_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in ("dice", "iou", "recall", "precision", "specificity"))


@query(_CELLS + f"SELECT vec_id, label, {_SCORES}, pred_empty, gt_empty FROM scores")
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir).select("vec_id", "label", "dice", "iou", "recall", "precision", "specificity", "pred_empty", "gt_empty"))


def _emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with every seventh prediction and every eleventh truth empty, so undefined metrics occur."""
    g = grids(spark, sf_dir)
    none = F.transform("pred", lambda _: F.lit(False))
    g = g.withColumn("pred", F.when(F.col("vec_id") % 7 == 0, none).otherwise(F.col("pred"))).withColumn("gt", F.when(F.col("vec_id") % 11 == 0, none).otherwise(F.col("gt")))
    return grid.binary_scores(grid.confusion(g))


_EMPTIED = _CELLS.replace("c.val > 0 AS pred, t.gt FROM", "c.val > 0 AND c.vec_id % 7 <> 0 AS pred, t.gt AND c.vec_id % 11 <> 0 AS gt FROM")
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}, count({c}) AS {c}_n_defined" for c in ("dice", "iou", "recall", "precision", "specificity"))


@query(_EMPTIED + f"SELECT label, count(*) AS n, {_MEANS}, count(*) FILTER (pred_empty) AS n_pred_empty, count(*) FILTER (pred_empty OR gt_empty) AS n_hd95_undefined FROM scores GROUP BY label")
def metric_nan_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.metric_means(_emptied(spark, sf_dir), ("dice", "iou", "recall", "precision", "specificity"), "label"))


@query(
    _CELLS
    + """, pr AS (SELECT vec_id, label, gt, 1 / (1 + exp(-val)) AS p FROM both_
), qu AS (SELECT vec_id, label, gt, CAST(round_even(greatest(0, least(1, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w + 1e-8))) * 255.0::DOUBLE, 0) AS INT) AS q FROM pr WINDOW w AS (PARTITION BY vec_id)
), h AS (SELECT vec_id, label, q, count(*) FILTER (gt) AS hp, count(*) FILTER (NOT gt) AS hn FROM qu GROUP BY vec_id, label, q
), d AS (SELECT v.vec_id, v.label, k.k, coalesce(h.hp, 0) AS hp, coalesce(h.hn, 0) AS hn FROM (SELECT DISTINCT vec_id, label FROM h) v CROSS JOIN (SELECT unnest(range(256)) AS k) k LEFT JOIN h ON h.vec_id = v.vec_id AND h.q = k.k
), c AS (SELECT vec_id, label, sum(hp) OVER w AS tp, sum(hn) OVER w AS fp, sum(hp) OVER (PARTITION BY vec_id) AS np FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT vec_id, label, round(avg(CASE WHEN tp + fp + np > 0 THEN 2 * CAST(tp AS DOUBLE) / (tp + fp + np) ELSE 1 END), 6) AS dice_sweep, round(avg(CASE WHEN fp + np > 0 THEN CAST(tp AS DOUBLE) / (fp + np) ELSE 1 END), 6) AS iou_sweep FROM c GROUP BY vec_id, label"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grids(spark, sf_dir).withColumn("prob", F.transform("values", lambda v: 1.0 / (1.0 + F.exp(-v))))
    return rounded(grid.threshold_sweep(g).select("vec_id", "label", "dice_sweep", "iou_sweep"))


@query(
    _CELLS
    + """, s AS (
  SELECT *, pred AND NOT (coalesce(lag(pred) OVER r, true) AND coalesce(lead(pred) OVER r, true) AND coalesce(lag(pred) OVER c, true) AND coalesce(lead(pred) OVER c, true)) AS sp,
    gt AND NOT (coalesce(lag(gt) OVER r, true) AND coalesce(lead(gt) OVER r, true) AND coalesce(lag(gt) OVER c, true) AND coalesce(lead(gt) OVER c, true)) AS sg
  FROM both_ WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)
), d AS (
  SELECT a.vec_id, a.pos, 0 AS k, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id WHERE a.sp AND b.sg GROUP BY a.vec_id, a.pos
  UNION ALL
  SELECT a.vec_id, a.pos, 1, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) FROM s a JOIN s b ON a.vec_id = b.vec_id WHERE a.sg AND b.sp GROUP BY a.vec_id, a.pos
), q AS (SELECT vec_id, quantile_cont(d, 0.95) AS v FROM d GROUP BY vec_id
), f AS (SELECT vec_id, label, bool_or(pred) AS ap, bool_or(gt) AS ag FROM both_ GROUP BY vec_id, label)
SELECT f.vec_id, label, round(CASE WHEN NOT ap AND NOT ag THEN 0 WHEN NOT ap OR NOT ag THEN sqrt(128) ELSE v END, 6) AS hd95 FROM f LEFT JOIN q ON f.vec_id = q.vec_id"""
)
def hd95_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.hd95(grids(spark, sf_dir), 8, 8).select("vec_id", "label", "hd95"))


@query(
    _EMPTIED
    + """, per AS (SELECT label, sum(recall) AS s, count(recall) AS k, count(*) AS n FROM scores GROUP BY label)
SELECT count(*) AS n_splits, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(k), 6) AS micro, round(avg(CASE WHEN k > 0 THEN s / k END), 6) AS macro FROM per"""
)
def pooled_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.pooled(_emptied(spark, sf_dir), "recall", "label"))


@query(
    _CELLS
    + """, t AS (SELECT vec_id, label, sum(CASE WHEN gt THEN 1 / (1 + exp(-val)) ELSE 0 END) AS i, sum(1 / (1 + exp(-val)) + gt::INT) AS s FROM both_ GROUP BY vec_id, label)
SELECT vec_id, label, round(greatest(0, least(1, 1 - (2 * i + 1) / (s + 1))), 6) AS deficit FROM t"""
)
def soft_dice_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.soft_dice_deficit(grids(spark, sf_dir), "values").select("vec_id", "label", "deficit"))


@query(
    _CELLS
    + """SELECT a.label, a.pos AS pos, round(1 + 5 * abs(coalesce(sum(b.gt::INT), 0) / 9.0::DOUBLE - any_value(a.gt::INT)), 6) AS bw
FROM (SELECT label, pos, pos // 8 AS y, pos % 8 AS x, gt FROM truth) a JOIN (SELECT label, pos // 8 AS y, pos % 8 AS x, gt FROM truth) b ON a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.label, a.pos"""
)
def boundary_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("values"))
    bw = grid.boundary_weights(grid.truth_masks(e, "label"), 8, 8, size=3)
    return rounded(bw.select("label", F.posexplode("bw").alias("pos", "bw")).withColumn("pos", F.col("pos").cast("long")))


@query(
    _CELLS
    + """, w AS (SELECT a.label, a.pos, 1 + 5 * abs(sum(b.gt::INT) / 961.0::DOUBLE - any_value(a.gt::INT)) AS bw
  FROM truth a JOIN truth b ON a.label = b.label GROUP BY a.label, a.pos
), t AS (SELECT vec_id, both_.label, avg(greatest(val, 0) - val * gt::INT + ln(1 + exp(-abs(val)))) AS ce, sum(bw * gt::INT / (1 + exp(-val))) AS i, sum(bw * (gt::INT + 1 / (1 + exp(-val)))) AS u FROM both_ JOIN w ON both_.label = w.label AND both_.pos = w.pos GROUP BY vec_id, both_.label)
SELECT vec_id, label, round(ce + 1 - (i + 1) / (u - i + 1), 6) AS structure FROM t"""
)
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.structure_score(grids(spark, sf_dir), 8, 8, "values").select("vec_id", "label", "structure"))


# ---- tails of samples ---------------------------------------------------------------------------------------------------


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 50.0).alias("e"), "l_orderkey", "l_linenumber")


def _series(x: str, terms: list[float]) -> str:
    out = repr(terms[-1])
    for t in reversed(terms[:-1]):
        out = f"({out} * {x} + {t!r}::DOUBLE)"
    return out


def _gain(s: str) -> str:
    x = f"({s} * {RATIO!r}::DOUBLE)"
    return f"({RATIO!r}::DOUBLE * CASE WHEN abs{x} < 1e-2 THEN {_series(x, [1 / math.factorial(k + 1) for k in range(7)])} ELSE (exp({x}) - 1) / {x} END)"


def _slope(s: str) -> str:
    x = f"({s} * {RATIO!r}::DOUBLE)"
    return f"({RATIO * RATIO!r}::DOUBLE * CASE WHEN abs{x} < 1e-2 THEN {_series(x, [(k + 1) / math.factorial(k + 2) for k in range(7)])} ELSE (({x} - 1) * exp{x} + 1) / ({x} * {x}) END)"


def _fit(source: str, also: str = "") -> str:
    """CTEs ending in fits: g, n, a0, a1, bad, raw, shape, scale."""
    return f"""{source}, ranked AS (SELECT g, e{also}, row_number() OVER (PARTITION BY g ORDER BY e{also}) AS i, count(*) OVER (PARTITION BY g) AS n FROM src
), tt AS (SELECT *, (n - i) / CAST(n - 1 AS DOUBLE) AS t FROM ranked WHERE n > 1
), mom AS (SELECT g, max(n) AS n, avg(e) AS a0, avg(t * e) AS a1 FROM tt GROUP BY g
), f0 AS (SELECT *, a0 - 2 * a1 AS d, coalesce(a0 - 2 * a1 <= 1e-8 * greatest(a0, 1) OR a0 <= 1e-8 OR 2 * a0 * a1 / nullif(a0 - 2 * a1, 0) <= 0, true) AS bad FROM mom
), fits AS (SELECT g, n, a0, a1, d, bad, CASE WHEN NOT bad THEN 2 - a0 / d END AS raw, CASE WHEN bad THEN 0 ELSE greatest(-1.5, least(0.7, 2 - a0 / d)) END AS shape, CASE WHEN bad THEN a0 ELSE 2 * a0 * a1 / d END AS scale FROM f0)
"""


_LINE = _fit("WITH src AS (SELECT l_returnflag AS g, l_quantity / 50.0::DOUBLE AS e FROM lineitem)")


@query(_LINE + "SELECT g, n, round(a0, 6) AS a0, round(a1, 6) AS a1 FROM mom")
def pwm_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tail.moments(sample(spark, sf_dir), "g"))


@query(_LINE + "SELECT g, n, round(shape, 6) AS shape, round(scale, 6) AS scale, round(raw, 6) AS shape_raw, bad AS degenerate, coalesce(raw <> shape, false) AS clamped FROM fits")
def gpd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tail.fit(tail.moments(sample(spark, sf_dir), "g")).select("g", "n", "shape", "scale", "shape_raw", "degenerate", "clamped"))


@query(_LINE + f"SELECT g, round(0.5 + scale * {_gain('shape')}, 6) AS level FROM fits")
def return_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tail.fit(tail.moments(sample(spark, sf_dir), "g"))
    return rounded(f.select("g", tail.return_level(F.lit(0.5), P, ALPHA).alias("level")))


_PREF = "2 / (n * d * d)"
_SENS = f"CASE WHEN bad THEN {RATIO!r}::DOUBLE / n ELSE {_gain('shape')} * {_PREF} * (a0 * a0 * t - 2 * a1 * a1) + CASE WHEN raw <> shape THEN 0 ELSE scale * {_slope('shape')} * {_PREF} * (a1 - a0 * t) END END"
_WEIGHTS = "SELECT g, i, round({w} * 1000, 6) AS w FROM (SELECT tt.g, tt.i, tt.t, tt.e, f.* EXCLUDE (g) FROM tt JOIN fits f ON tt.g = f.g)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sample(spark, sf_dir)
    return tail.ranked(s, "g", ties=("l_orderkey", "l_linenumber")).select("g", "i", "n", "t", "e").join(F.broadcast(tail.fit(tail.moments(s, "g")).drop("n")), "g")  # a row for each group


@query(_LINE + _WEIGHTS.format(w=f"greatest(0, {_SENS})"))
def sensitivity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).select("g", "i", (tail.sensitivity(P, ALPHA) * 1000).alias("w")))


@query(_LINE + f"SELECT g, i, round(CASE WHEN i > n - m THEN 1000 / m ELSE 0 END, 6) AS w FROM (SELECT g, i, n, greatest(1, round_even(n * {ALPHA / P!r}::DOUBLE, 0)) AS m FROM tt)")
def cvar_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).select("g", "i", (tail.top_share(P, ALPHA) * 1000).alias("w")))


@query(_LINE + "SELECT g, i, round(1000.0::DOUBLE / n, 6) AS w FROM tt")
def ohem_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).select("g", "i", (tail.uniform() * 1000).alias("w")))


@query(_LINE + f"SELECT g, round(sum(w * e) / sum(w), 6) AS value FROM (SELECT tt.g, tt.e, greatest(0, {_SENS}) AS w FROM (SELECT g, i, t, e FROM tt) tt JOIN fits f ON tt.g = f.g) GROUP BY g")
def normalised_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tail.normalised(_ranked(spark, sf_dir).withColumn("w", tail.sensitivity(P, ALPHA)), "g")
    return rounded(w.groupBy("g").agg(F.sum(F.col("w") * F.col("e")).alias("value")))


@query(
    """WITH r AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS epoch, l_suppkey AS stem, l_quantity / 50.0::DOUBLE AS d, row_number() OVER (PARTITION BY year(l_shipdate) * 12 + month(l_shipdate) ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT stem, count(*) AS n FROM r WHERE k <= 20 GROUP BY stem ORDER BY n DESC, stem LIMIT 15"""
)
def worst20_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").withColumn("epoch", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    w = Window.partitionBy("epoch").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    worst = li.withColumn("k", F.row_number().over(w)).where("k <= 20")
    return worst.groupBy(F.col("l_suppkey").alias("stem")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stem").limit(15)


# ---- streams of deficits ------------------------------------------------------------------------------------------------


def deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 500.0).alias("d"))
    return tail.batches(e, "event_type", ["ts", "event_id"]).select("event_type", "event_id", "batch", "d")


_EVENTS = """WITH b AS (
  SELECT event_type, event_id, least(1, value / 500.0::DOUBLE) AS d, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 16 AS batch FROM events
), sl AS (
  SELECT DISTINCT event_type, batch, count(d) OVER w AS n_buffer, quantile_cont(d, 0.85) OVER w AS q0
  FROM b WINDOW w AS (PARTITION BY event_type ORDER BY batch RANGE BETWEEN 32 PRECEDING AND 1 PRECEDING)
), sq AS (SELECT event_type, batch, n_buffer, CASE WHEN n_buffer >= 128 THEN q0 END AS q FROM sl
), ls AS (SELECT event_type, list(q ORDER BY batch) AS qs, list(batch ORDER BY batch) AS bs FROM sq WHERE q IS NOT NULL GROUP BY event_type
), em AS (SELECT event_type, bs[i] AS batch, qs[i] AS q, list_reduce(qs[1:i], lambda a, x: 0.95::DOUBLE * a + 0.05::DOUBLE * x) AS u FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM ls))
"""


@query(_EVENTS + "SELECT event_type, batch, n_buffer, round(q, 6) AS q FROM sq")
def sliding_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tail.sliding_threshold(deficits(spark, sf_dir), "event_type").drop("buf"))


@query(_EVENTS + "SELECT event_type, batch, round(q, 6) AS q, round(u, 6) AS u FROM em")
def ema_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tail.smoothed(tail.sliding_threshold(deficits(spark, sf_dir), "event_type"), "event_type"))


@query("SELECT event_type, event_id, round(value / 500.0::DOUBLE - 0.5, 6) AS raw, round(least(0.25, value / 500.0::DOUBLE - 0.5), 6) AS e FROM events WHERE value / 500.0::DOUBLE - 0.5 > 0")
def exceedance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.col("value") / 500.0)
    x = tail.exceedances(e, "d", F.lit(0.5), cap=0.25)
    return rounded(x.select("event_type", "event_id", (F.col("d") - 0.5).alias("raw"), "e"))


_POOL = (
    _fit(
        _EVENTS
        + """, po AS (
  SELECT b.event_type, b.batch, em.u, b.d - em.u AS e, 1 AS live FROM b JOIN em ON b.event_type = em.event_type AND b.batch = em.batch WHERE b.d > em.u
  UNION ALL
  SELECT em.event_type, em.batch, em.u, b.d - em.u, 0 FROM em JOIN b ON b.event_type = em.event_type AND b.batch BETWEEN em.batch - 32 AND em.batch - 1 WHERE b.d > em.u
), src AS (SELECT event_type || '|' || batch AS g, e, live FROM po)""",
        ", live",
    )
    + f""", val AS (SELECT g, sum(w) AS sw, sum(w * e) / nullif(sum(w), 0) AS v, sum(w * live) / nullif(sum(w), 0) AS lw, count(*) FILTER (live = 1 AND w > 0) AS used FROM (SELECT tt.g, e, live, greatest(0, {_SENS}) AS w FROM (SELECT g, i, t, e, live FROM tt) tt JOIN fits f ON tt.g = f.g) GROUP BY g
), n AS (SELECT em.event_type, em.batch, any_value(em.u) AS u, count(po.e) AS n_pool, coalesce(sum(po.live), 0) AS n_live FROM em LEFT JOIN po ON em.event_type = po.event_type AND em.batch = po.batch GROUP BY em.event_type, em.batch
), j AS (SELECT n.*, n_pool >= 8 AND n_live > 0 AS ok, f.shape, f.scale, val.v, val.lw, val.used, coalesce(val.sw, 0) AS sw FROM n LEFT JOIN fits f ON f.g = n.event_type || '|' || n.batch LEFT JOIN val ON val.g = f.g)
SELECT event_type, batch, round(u, 6) AS u, CAST(n_live AS BIGINT) AS n_live, n_pool, ok AND sw > 0 AS active, round(CASE WHEN ok THEN shape END, 6) AS shape, round(CASE WHEN ok THEN scale END, 6) AS scale,
  round(CASE WHEN ok THEN u + scale * {_gain('shape')} END, 6) AS level, round(CASE WHEN ok AND sw > 0 THEN v END, 6) AS value,
  0.3::DOUBLE AS lam, round(CASE WHEN ok AND sw > 0 THEN 0.3::DOUBLE * v ELSE 0 END, 6) AS loss, round(CASE WHEN ok AND sw > 0 THEN lw * n_pool / n_live END, 6) AS live_weight, CASE WHEN ok AND sw > 0 THEN used END AS n_live_active FROM j"""
)


@query(_POOL)
def tail_pool_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pool.pool_values(deficits(spark, sf_dir), "event_type"))


@query("SELECT step, round(0.3 * least(1, step / 20.0::DOUBLE), 6) AS lam FROM (SELECT unnest(range(100)) AS step)")
def warmup_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(100).select(F.col("id").alias("step"), tail.warm_up("id", 100).alias("lam")))


@query("SELECT epoch, round(0.0001 * pow(0.1::DOUBLE, epoch // 30), 10) * 1000000 AS rate FROM (SELECT unnest(range(100)) AS epoch)")
def step_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("epoch"), (F.round(tail.step_rate("id", 1e-4, 0.1, 30), 10) * 1000000).alias("rate"))


# ---- paired runs --------------------------------------------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str, taus: dict[str, tuple[float, ...]] = TAUS) -> DataFrame:
    """arm, seed, dataset, stem, value: dice at each arm's thresholds."""
    g = grids(spark, sf_dir)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(t).alias("tau")) for a, ts in taus.items() for s, t in enumerate(ts)])
    g = g.select("label", "vec_id", "values", "gt", F.explode(arms).alias("x")).withColumn("pred", F.expr("transform(values, v -> v > x.tau)"))
    s = grid.binary_scores(grid.confusion(g))
    return s.select("x.arm", "x.seed", F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("stem"), F.col("dice").alias("value"))


def _runs(taus: dict[str, tuple[float, ...]], tag: str = "") -> str:
    """CTEs of the runs and of the t intervals of two arms; tag is added to their names."""
    rows = ", ".join(f"('{a}', {s}, {t!r}::DOUBLE)" for a, ts in taus.items() for s, t in enumerate(ts))
    return f""", taus{tag} AS (SELECT * FROM (VALUES {rows}) AS v(arm, seed, tau)
), rc{tag} AS (SELECT arm, seed, label::VARCHAR AS dataset, vec_id AS stem, count(*) FILTER (val > tau AND gt) AS tp, count(*) FILTER (val > tau OR gt) AS un, count(*) FILTER (val > tau) AS a, count(*) FILTER (gt) AS b FROM both_ CROSS JOIN taus{tag} GROUP BY ALL
), runs{tag} AS (SELECT arm, seed, dataset, stem, CASE WHEN un = 0 THEN 1 ELSE 2 * CAST(tp AS DOUBLE) / (a + b) END AS value FROM rc{tag}
), sm{tag} AS (SELECT dataset, seed, avg(value) FILTER (arm = 'a') AS a, avg(value) FILTER (arm = 'b') AS b FROM runs{tag} GROUP BY dataset, seed
), st{tag} AS (SELECT dataset, count(*) AS n, avg(a) AS a_mean, avg(b) AS b_mean, avg(round(b - a, 12)) AS mean, coalesce(stddev_samp(round(b - a, 12)), 0) AS sd FROM sm{tag} GROUP BY dataset
), ti{tag} AS (SELECT *, sd <= 1e-15 AS degenerate, mean - 4.302652729749464::DOUBLE * sd / sqrt(n) AS lo, mean + 4.302652729749464::DOUBLE * sd / sqrt(n) AS hi, abs(mean) / (sd / sqrt(n)) AS t FROM st{tag}
)"""


_RUNS = (
    _CELLS
    + _runs(TAUS)
    + """, tp AS (SELECT *, CASE WHEN NOT degenerate THEN 1 - t / sqrt(t * t + 2) END AS p FROM ti
), ho AS (SELECT dataset, max(least(1, q)) OVER (ORDER BY p, dataset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM (SELECT dataset, p, (count(*) OVER () - row_number() OVER (ORDER BY p, dataset) + 1) * p AS q FROM tp WHERE p IS NOT NULL))
"""
)


@query(_RUNS + "SELECT dataset, n, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean, round(mean, 6) + 0 AS mean, round(sd, 6) AS sd, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, degenerate FROM ti")
def paired_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.t_intervals(paired.seed_means(runs(spark, sf_dir))).drop("p"))


@query(_RUNS + "SELECT dataset, round(p, 6) AS p FROM tp")
def paired_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.t_intervals(paired.seed_means(runs(spark, sf_dir))).select("dataset", "p"))


@query(_RUNS + "SELECT tp.dataset, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM tp LEFT JOIN ho ON tp.dataset = ho.dataset")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.holm(paired.t_intervals(paired.seed_means(runs(spark, sf_dir))).select("dataset", "p")))


_COMPARE = "SELECT tp.*, p_holm, NOT degenerate AND (lo > 0 OR hi < 0) AS excludes_zero, NOT degenerate AND lo > 0 AS significantly_positive, NOT degenerate AND hi < 0 AS significantly_negative FROM tp LEFT JOIN ho ON tp.dataset = ho.dataset"


@query(_RUNS + f"SELECT dataset, n, round(mean, 6) + 0 AS mean, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, round(p, 6) AS p, round(p_holm, 6) AS p_holm, degenerate, excludes_zero, significantly_positive, significantly_negative FROM ({_COMPARE})")
def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paired.compare(runs(spark, sf_dir))
    return rounded(c.select("dataset", "n", "mean", "lo", "hi", "p", "p_holm", "degenerate", "excludes_zero", "significantly_positive", "significantly_negative"))


@query(
    _RUNS
    + _runs(SECOND, "2")
    + f""", cmp AS ({_COMPARE}), dr AS (SELECT dataset, avg((value <= 0.5)::INT) FILTER (arm = 'a') - avg((value <= 0.5)::INT) FILTER (arm = 'b') AS drop_ FROM runs GROUP BY dataset
), rules AS (
  SELECT 'no_target_gain' AS criterion, coalesce(bool_or(mean <= 0 AND lo <= 0 AND hi >= 0 AND NOT coalesce(drop_ >= 0.03, false)), false) AS triggered, count(*) > 0 AS evaluated FROM cmp LEFT JOIN dr ON cmp.dataset = dr.dataset WHERE cmp.dataset = '0'
  UNION ALL SELECT 'no_external_difference', coalesce(bool_and(NOT (NOT degenerate AND (lo > 0 OR hi < 0))), false), count(*) > 0 FROM ti2 WHERE dataset IN ('1', '2', '3')
  UNION ALL SELECT 'falls_while_pool_rises', coalesce(bool_or(mean < -0.01 AND significantly_negative), false) AND coalesce(avg(b_mean - a_mean) > 0, false), count(*) > 0 FROM cmp)
SELECT * FROM rules UNION ALL SELECT 'rejected', bool_or(triggered), bool_and(evaluated) FROM rules"""
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    low = (F.col("value") <= 0.5).cast("double")
    drop = r.groupBy("dataset").agg((F.avg(F.when(F.col("arm") == "a", low)) - F.avg(F.when(F.col("arm") == "b", low))).alias("drop"))
    return paired.verdict(paired.compare(r), drop, "0", ["1", "2", "3"], paired.compare(runs(spark, sf_dir, SECOND))).drop("detail")


@query(_RUNS + "SELECT dataset, stem FROM runs GROUP BY dataset, stem HAVING count(DISTINCT arm || seed) = 6")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.matched(runs(spark, sf_dir)).select("dataset", "stem").distinct()


_DIFF = ", df AS (SELECT dataset, stem, avg(value) FILTER (arm = 'b') - avg(value) FILTER (arm = 'a') AS d FROM runs GROUP BY dataset, stem), dk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY stem) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS n FROM df)"
_LIMITS = "SELECT p.dataset, n, round(mean, 6) + 0 AS mean, round(quantile_cont(r, 0.025), 6) + 0 AS lo, round(quantile_cont(r, 0.975), 6) + 0 AS hi FROM (SELECT dataset, max(n) AS n, avg(d) AS mean FROM dk GROUP BY dataset) p JOIN reps ON p.dataset = reps.dataset GROUP BY p.dataset, n, mean"
_DRAW = "('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT % {n}"


@query(
    _RUNS
    + _DIFF
    + f""", dw AS (SELECT dataset, rep, {_DRAW.format(key="0, dataset, rep, k", n="n")} AS k FROM dk CROSS JOIN (SELECT unnest(range({N_BOOT})) AS rep)
), reps AS (SELECT dw.dataset, rep, avg(d) AS r FROM dw JOIN dk ON dw.dataset = dk.dataset AND dw.k = dk.k GROUP BY dw.dataset, rep)
"""
    + _LIMITS
)
def image_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.image_bootstrap(runs(spark, sf_dir), N_BOOT))


@query(
    _RUNS
    + _DIFF
    + f""", rp AS (SELECT unnest(range({N_BOOT})) AS rep
), kw AS (SELECT dataset, rep, {_DRAW.format(key="0, 'stem', dataset, rep, k", n="n")} AS k FROM dk CROSS JOIN rp
), sd AS (SELECT dataset, seed, row_number() OVER (PARTITION BY dataset ORDER BY seed) - 1 AS s, count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT DISTINCT dataset, seed FROM runs)
), sw AS (SELECT dataset, rep, {_DRAW.format(key="0, 'seed', dataset, rep, s", n="m")} AS s FROM sd CROSS JOIN rp
), cl AS (SELECT r.dataset, r.stem, sd.s, dk.k, sum(CASE WHEN arm = 'b' THEN value ELSE -value END) AS v FROM runs r JOIN sd ON r.dataset = sd.dataset AND r.seed = sd.seed JOIN dk ON dk.dataset = r.dataset AND dk.stem = r.stem GROUP BY ALL
), reps AS (SELECT kw.dataset, kw.rep, avg(v) AS r FROM kw JOIN sw ON kw.dataset = sw.dataset AND kw.rep = sw.rep JOIN cl ON cl.dataset = kw.dataset AND cl.k = kw.k AND cl.s = sw.s GROUP BY kw.dataset, kw.rep)
"""
    + _LIMITS
)
def hierarchical_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired.hierarchical_bootstrap(runs(spark, sf_dir), N_BOOT))


@query("SELECT base_epochs, CAST(round_even(base_epochs * 105.0::DOUBLE / 100.0::DOUBLE, 0) AS BIGINT) AS epochs FROM (SELECT unnest(range(1, 121)) AS base_epochs)")
def budget_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 121).select(F.col("id").alias("base_epochs"), F.rint(F.col("id") * 105.0 / 100.0).cast("long").alias("epochs"))


# ---- duplicates ---------------------------------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest.build(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return m.select("split", F.col("stem").alias("id"), F.col("content_sha256").alias("content_hash"))


_NORM = r"trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'))"
_ITEMS = f"WITH items AS (SELECT source AS split, doc_id AS id, sha256({_NORM}) AS content_hash FROM documents), groups AS (SELECT content_hash, count(*) AS n, list_sort(list(DISTINCT split)) AS splits, min(id) AS first_id FROM items GROUP BY content_hash HAVING count(*) > 1), loc AS (SELECT CASE WHEN len(splits) = 1 THEN 'within ' || splits[1] ELSE array_to_string(splits, ' <-> ') END AS location, count(*) AS n_groups FROM groups GROUP BY 1)\n"


@query(_ITEMS + "SELECT content_hash, n, array_to_string(splits, ',') AS splits, first_id FROM groups")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(items(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(_ITEMS + "SELECT location, n_groups FROM loc")
def dup_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.by_location(duplicates.exact_groups(items(spark, sf_dir)))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all grids, and in split -1 of a near copy of each grid, in which one cell differs."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("split"), F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    moved = F.transform("values", lambda v, k: v.cast("double") + F.when(k == F.col("id") % 64, 0.05).otherwise(0.0))
    both = e.withColumn("values", F.transform("values", lambda v: v.cast("double"))).unionByName(e.select(F.lit(-1).alias("split"), "id", moved.alias("values")))
    return duplicates.grid_hashes(both).drop("values")


def _half(bit: str, k: str, lo: int) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {bit} AND {k} BETWEEN {lo} AND {lo + 31} THEN pow(2::DOUBLE, {k} - {lo}) ELSE 0 END), 0) AS BIGINT)"


def _matrix(name: str, rows: list[list[float]]) -> str:
    values = ", ".join(f"({i}, {k}, {c!r}::DOUBLE)" for i, row in enumerate(rows) for k, c in enumerate(row))
    return f"{name} AS (SELECT * FROM (VALUES {values}) AS v(i, k, c))"


_MAPS = duplicates.hash_maps(8, 8)
_HASHES = f"""WITH cells AS (
  SELECT split, id, p - 1 AS pos, (p - 1) // 8 AS y, (p - 1) % 8 AS x, CAST(v[p] AS DOUBLE) + CASE WHEN split = -1 AND p - 1 = id % 64 THEN 0.05::DOUBLE ELSE 0 END AS val
  FROM (SELECT *, unnest(range(1, 65)) AS p FROM (SELECT label AS split, vec_id AS id, embedding AS v FROM embeddings UNION ALL SELECT -1, vec_id, embedding FROM embeddings))
), {_matrix("m9", _MAPS["d"][1])}, {_matrix("mp", _MAPS["p"][1])}
, ah AS (SELECT split, id, pos, val > avg(val) OVER (PARTITION BY split, id) AS ba FROM cells
), wa AS (SELECT split, id, {_half('ba', 'pos', 0)} AS a_lo, {_half('ba', 'pos', 32)} AS a_hi FROM ah GROUP BY split, id
), nine AS (SELECT split, id, y, i AS j, sum(val * c) AS v FROM cells JOIN m9 ON x = k GROUP BY split, id, y, i
), dh AS (SELECT split, id, y * 8 + j AS pos, j < 8 AND lead(v) OVER (PARTITION BY split, id, y ORDER BY j) > v AS bd FROM nine
), wd AS (SELECT split, id, {_half('bd', 'pos', 0)} AS d_lo, {_half('bd', 'pos', 32)} AS d_hi FROM dh GROUP BY split, id
), r1 AS (SELECT split, id, y, i AS u, sum(val * c) AS r FROM cells JOIN mp ON x = k GROUP BY split, id, y, i
), t1 AS (SELECT split, id, i * 8 + u AS pos, sum(r * c) AS t FROM r1 JOIN mp ON y = k GROUP BY split, id, i, u
), md AS (SELECT split, id, quantile_cont(t, 0.5) AS m FROM t1 WHERE pos > 0 GROUP BY split, id
), wp AS (SELECT split, id, {_half('pos > 0 AND t > m', 'pos', 0)} AS p_lo, {_half('pos > 0 AND t > m', 'pos', 32)} AS p_hi FROM t1 JOIN md USING (split, id) GROUP BY split, id
), hs AS (SELECT * FROM wa JOIN wd USING (split, id) JOIN wp USING (split, id))
"""
_DIST = ", ".join(f"CAST(bit_count(xor(l.{h}_lo, r.{h}_lo)) + bit_count(xor(l.{h}_hi, r.{h}_hi)) AS INT) AS d_{h}" for h in "adp")
_PAIRS = _HASHES + f", pairs AS (SELECT l.split AS split_a, l.id AS id_a, r.split AS split_b, r.id AS id_b, {_DIST} FROM hs l JOIN hs r ON l.split < r.split OR (l.split = r.split AND l.id < r.id))\n"
MOST = 8


@query(_HASHES + "SELECT * FROM hs")
def grid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir)


_FLAGGED = f"SELECT * FROM pairs WHERE (d_a <= {MOST})::INT + (d_d <= {MOST})::INT + (d_p <= {MOST})::INT >= 2"


@query(_PAIRS + _FLAGGED)
def flagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.flagged(written(hashes(spark, sf_dir), "hashes"), MOST)


_MATRIX = f"SELECT split_a, split_b, count(*) AS n FROM (SELECT DISTINCT split_a, id_a, split_b FROM (SELECT split_a, id_a, split_b FROM ({_FLAGGED}) UNION ALL SELECT split_b, id_b, split_a FROM ({_FLAGGED}))) GROUP BY split_a, split_b"


@query(_PAIRS + _MATRIX)
def collision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.collision_matrix(duplicates.flagged(written(hashes(spark, sf_dir), "hashes"), MOST))


_NEAR = ", near AS (SELECT h, split_a, id_a, split_b, min(d) AS d FROM (" + " UNION ALL ".join(f"SELECT '{h}' AS h, split_a, id_a, split_b, d_{h} AS d FROM pairs UNION ALL SELECT '{h}', split_b, id_b, split_a, d_{h} FROM pairs" for h in "adp") + """) GROUP BY ALL
), every AS (SELECT h, split_a, split_b, CAST(min(d) AS DOUBLE) AS min, round(quantile_cont(d, 0.01), 6) AS p01, round(quantile_cont(d, 0.05), 6) AS p05, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median,
  count(*) FILTER (d <= 2) AS n_le_2, count(*) FILTER (d <= 6) AS n_le_6, count(*) FILTER (d <= 10) AS n_le_10 FROM near GROUP BY h, split_a, split_b
), summary AS (SELECT * EXCLUDE (h) FROM every WHERE h = 'p')
"""


@query(_PAIRS + _NEAR + "SELECT * FROM every")
def nn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = written(hashes(spark, sf_dir), "hashes")
    parts = [duplicates.nearest_summary(duplicates.nearest(h, x)).withColumn("h", F.lit(x)) for x in duplicates.HASHES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(_PAIRS + "SELECT * FROM (SELECT *, d_a + d_d + d_p AS d_sum, CAST(row_number() OVER (PARTITION BY split_a, split_b ORDER BY d_a + d_d + d_p, id_a, id_b) AS INT) AS place FROM pairs WHERE split_a < split_b) WHERE place <= 50")
def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.closest(hashes(spark, sf_dir), 50)


@query(_PAIRS.replace("WITH cells", _ITEMS.rstrip() + ", cells", 1) + _NEAR + "SELECT 'exact' AS kind, location AS place, CAST(n_groups AS DOUBLE) AS value FROM loc UNION ALL SELECT CASE WHEN median <= 2 THEN 'subset' ELSE 'overlap' END, split_a || ' -> ' || split_b, median FROM summary WHERE split_a <> split_b AND median <= 10")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = duplicates.by_location(duplicates.exact_groups(items(spark, sf_dir)))
    return duplicates.findings(loc, duplicates.nearest_summary(duplicates.nearest(written(hashes(spark, sf_dir), "hashes"), "p")))


_LEAK = """, me AS (SELECT max(median) FILTER (split_a = 1) AS median, min(median) FILTER (split_a <> 1) AS lowest_other FROM summary WHERE split_b = 0 AND split_a <> 0
), ex AS (SELECT count(*) AS n_exact FROM (SELECT p_lo, p_hi, a_lo, a_hi, d_lo, d_hi, list(DISTINCT split) AS s FROM hs GROUP BY ALL HAVING count(*) > 1) WHERE list_contains(s, 0) AND list_contains(s, 1))
SELECT CASE WHEN n_exact > 0 THEN 'blocking' ELSE 'report' END AS status, n_exact, median, lowest_other, median < lowest_other AS closest FROM ex, me"""


@query(_PAIRS + _NEAR + _LEAK.replace("HAVING", "HAVING").replace("GROUP BY ALL HAVING", "GROUP BY p_lo, p_hi, a_lo, a_hi, d_lo, d_hi HAVING"))
def selection_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = written(hashes(spark, sf_dir), "hashes")
    content = F.concat_ws("|", *[f"{x}_{p}" for x in duplicates.HASHES for p in ("lo", "hi")])
    groups = duplicates.exact_groups(h.select("split", "id", content.alias("content_hash")))
    return duplicates.selection_leakage(groups, duplicates.nearest_summary(duplicates.nearest(h, "p")), h, 0, 1)


# ---- manifests ----------------------------------------------------------------------------------------------------------


@query(f"SELECT source AS split, doc_id AS stem, sha256(text) AS byte_sha256, sha256({_NORM}) AS content_sha256 FROM documents")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.build(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("SELECT source AS split, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.totals(manifest_build(spark, sf_dir))


@query(
    """SELECT source AS split, doc_id AS stem, CASE WHEN doc_id % 50 = 0 THEN 'missing' WHEN doc_id % 50 = 1 THEN 'bytes' WHEN doc_id % 50 = 2 THEN 'content' ELSE 'extra' END AS status FROM documents WHERE doc_id % 50 IN (0, 1, 2)
UNION ALL SELECT source, -1 - doc_id, 'extra' FROM documents WHERE doc_id % 50 = 3"""
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a copy that lost, re-spaced, changed and gained some documents."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    k = F.col("doc_id") % 50
    changed = F.when(k == 1, F.concat("text", F.lit("  "))).when(k == 2, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    copy = d.where(k != 0).withColumn("text", changed).unionByName(d.where(k == 3).withColumn("doc_id", -1 - F.col("doc_id")))
    return manifest.verify(manifest.build(d, "source", "doc_id", "text"), manifest.build(copy, "source", "doc_id", "text"))


@query("SELECT l_orderkey AS k, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pairing_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return manifest.pair(li, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), ["k"])


@query(
    """WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer), r AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT k FROM l ANTI JOIN r USING (k)), b AS (SELECT k FROM r ANTI JOIN l USING (k))
SELECT 'left' AS side, (SELECT count(*) FROM a) AS n, coalesce((SELECT array_to_string(list_sort(list(k)), ',') FROM (SELECT k FROM a ORDER BY k LIMIT 5)), '') AS examples
UNION ALL SELECT 'right', (SELECT count(*) FROM b), coalesce((SELECT array_to_string(list_sort(list(k)), ',') FROM (SELECT k FROM b ORDER BY k LIMIT 5)), '')"""
)
def unpaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = manifest.unpaired(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")
    return u.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(
    """WITH c AS (SELECT lang AS split, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT * FROM (VALUES ('en', 600), ('fr', 150), ('xx', 10)) AS v(split, expected)), h AS (SELECT coalesce(max(n), 0) AS held FROM c WHERE split = 'es')
SELECT coalesce(c.split, e.split) AS split, coalesce(n, 0) AS n, CAST(expected AS BIGINT) AS expected, CAST(coalesce(n, 0) - expected AS BIGINT) AS delta,
  CASE WHEN n IS NULL THEN 'missing' WHEN expected IS NULL THEN 'held_out' WHEN n = expected THEN 'ok' WHEN coalesce(c.split, e.split) = 'en' AND n + held = expected THEN 're-split' ELSE 'mismatch' END AS status FROM c FULL JOIN e ON c.split = e.split CROSS JOIN h"""
)
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("split")).agg(F.count("*").alias("n"))
    expected = spark.createDataFrame([("en", 600), ("fr", 150), ("xx", 10)], "split string, expected long")
    return manifest.reconcile(counts, expected, "en", "es")


@query("SELECT count(*) AS n_pool, CAST(count(*) FILTER (doc_id % 10 <> 9) + count(*) FILTER (doc_id % 10 = 8) + 0 AS BIGINT) AS n_parts, count(*) FILTER (doc_id % 10 = 9) AS n_lost, count(*) FILTER (doc_id % 10 = 8) AS n_twice, 0::BIGINT AS n_foreign FROM documents")
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 10
    parts = d.where(k < 8).select(F.lit("train").alias("part"), "doc_id").unionByName(d.where(k == 8).select(F.lit("held").alias("part"), "doc_id")).unionByName(d.where(k == 8).select(F.lit("train").alias("part"), "doc_id"))
    return manifest.partition_check(parts, d, "doc_id")


@query(
    """WITH k AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k FROM orders), g AS (SELECT s, k, lead(k) OVER (PARTITION BY s ORDER BY k) - k - 1 AS gap FROM k)
SELECT s, min(k) AS lo, max(k) AS hi, CAST(coalesce(sum(gap), 0) AS BIGINT) AS n_missing, count(*) FILTER (gap > 0) AS n_runs, count(*) FILTER (gap > 0) <= 1 AS contiguous FROM g GROUP BY s"""
)
def numeric_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("k"))
    return manifest.numeric_gaps(o, "s", "k")


@query(
    """WITH n AS (SELECT CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN md5(c_name) ELSE c_name END AS stem FROM customer)
SELECT CASE WHEN regexp_full_match(stem, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(stem, '[a-z0-9]{16,}') AND regexp_matches(stem, '[a-z]') THEN 'alphanumeric' ELSE 'other' END AS shape, count(*) AS n FROM n GROUP BY 1"""
)
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    stem = F.when(k == 0, F.col("c_custkey").cast("string")).when(k == 1, F.md5(F.col("c_name").cast("binary"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").groupBy(manifest.name_shape(stem).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS g, o_custkey AS stem, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def stem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("stem"))
    return manifest.collisions(o, "g", "stem")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= greatest(1, round_even(n * 0.1::DOUBLE, 0))")
def seeded_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 7)


_STREAM = f""", fl AS (SELECT event_type, batch, avg(d) AS dm, max(d) AS dx FROM b GROUP BY event_type, batch HAVING count(*) = 16), pv AS ({{pool}})
SELECT fl.event_type AS key, fl.batch, pv.u, coalesce(n_live, 0) AS n_live, coalesce(n_pool, 0) AS n_pool, coalesce(active, false) AS active, shape, scale, value, round(dm, 9) AS deficit_mean, round(dx, 6) AS deficit_max, 0.3::DOUBLE AS lam
FROM fl LEFT JOIN pv ON pv.event_type = fl.event_type AND pv.batch = fl.batch"""


#: Events of a trigger.
TRIGGER = 1_000_000


@query(_POOL[: (_cut := _POOL.rindex("SELECT event_type, batch, round(u, 6)"))] + _STREAM.format(pool=_POOL[_cut:]))
def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail estimator over events as a stream, run to its end; results and checkpoint go to the shared folder.

    Events arrive in spans of time of about TRIGGER rows, each of which is a trigger, since a task sorts the rows that a trigger has of its group.
    """
    base = shared_dir(spark)
    path = f"{sf_dir}/events.parquet"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # Sorted by text: time to the microsecond, then the id.
        time = F.date_format("ts", "yyyyMMddHHmmssSSSSSS")
        place = F.concat(time, F.lpad(F.col("event_id").cast("string"), 20, "0"))
        rows = spark.read.parquet(path).select("event_type", place.alias("place"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("d"), time.cast("double").alias("time"))
        n = max(1, math.ceil(rows.count() / TRIGGER))
        bounds = rows.agg(F.percentile_approx("time", [k / n for k in range(1, n)], 100 * n).alias("b")).first()["b"] if n > 1 else []
        above = sum(((F.col("time") > b).cast("int") for b in bounds or []), F.lit(0))
        spans = written_to(rows.select("event_type", "place", "d", F.when(F.col("time").isNull(), n - 1).otherwise(above).alias("span")), f"{base}/spans", ["span"])
        for k in range(n):
            spans.where(F.col("span") == k).drop("span").write.mode("append").parquet(f"{base}/in")
            events = spark.readStream.schema(spans.drop("span").schema).parquet(f"{base}/in")
            out = tail_state.tail_stream(events, "event_type", "place", "d")
            out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return rounded(spark.read.parquet(f"{base}/rows"), ("deficit_mean",))  # six places would be a tie for many
