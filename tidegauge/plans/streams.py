"""Queries that run over events as streams: state handed from one stream to the next, exported state, flushes of epochs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import records
from tidegauge.sources import files
from tidegauge.sources.shared import shared_dir
from tidegauge.streaming import tail_state

from . import catalog
from .catalog import rounded

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Seconds of an epoch of the flush, and how late events may come.
EPOCH, LATE = 6 * 3600, 3600


def query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps state of any size outside the heap, for as long as a stream runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; a pattern, since a stream takes no plain file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def _deficits(rows: DataFrame) -> DataFrame:
    """event_type, place (time to the microsecond, then the id, as text) and d."""
    place = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return rows.select("event_type", place.alias("place"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("d"))


def _run(df: DataFrame, base: str) -> DataFrame:
    df.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{base}/rows")


#: Microseconds since 1970 of a time without a zone, whatever the session's zone is.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """Whether an event comes before, or from, the middle of the time that events span."""
    ts = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.expr(_MICROS.format("min(ts)")).alias("a"), F.expr(_MICROS.format("max(ts)")).alias("b")).first()
    middle = ((ts["a"] or 0) + (ts["b"] or 0)) // 2
    return F.expr(_MICROS.format("ts")) < middle, F.expr(_MICROS.format("ts")) >= middle


@query(catalog.oracle_sql()["tail_stream"])
def tail_stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimator over the first half of the events as one stream, and over the rest as another that goes on from the state of the first."""
    one, two = shared_dir(spark), shared_dir(spark)
    early, late = _halves(spark, sf_dir)
    with _rocksdb(spark):
        first = _run(tail_state.tail_stream(_deficits(_events(spark, sf_dir).where(early)), "event_type", "place", "d"), one)
        state = tail_state.exported(spark, f"{one}/state")
        rest = _run(tail_state.tail_stream(_deficits(_events(spark, sf_dir).where(late)), "event_type", "place", "d", initial=state), two)
    return rounded(first.unionByName(rest), ("deficit_mean",))


@query("""WITH m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS middle FROM events
), e AS (SELECT event_type, least(1.0, value / 500.0::DOUBLE) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events, m WHERE epoch_us(ts) < middle
), n AS (SELECT event_type, count(*) // 16 AS step FROM e GROUP BY event_type)
SELECT e.event_type AS key, step, CAST(count(*) FILTER (k < 16 * step AND k >= 16 * step - 512) AS INT) AS n_buffer, CAST(count(*) FILTER (k >= 16 * step) AS INT) AS n_rest,
  round(coalesce(sum(d) FILTER (k < 16 * step AND k >= 16 * step - 512), 0), 6) AS buffer_sum, round(coalesce(sum(d) FILTER (k >= 16 * step), 0), 6) AS rest_sum
FROM e JOIN n ON e.event_type = n.event_type GROUP BY e.event_type, step""")
def tail_state_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the estimator after the first half of the events, read from the stream's checkpoint as a table."""
    base = shared_dir(spark)
    with _rocksdb(spark):
        _run(tail_state.tail_stream(_deficits(_events(spark, sf_dir).where(_halves(spark, sf_dir)[0])), "event_type", "place", "d"), base)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        state = tail_state.exported(spark, f"{base}/state")
        return rounded(state.select("key", "step", F.size("buffer").alias("n_buffer"), F.size("rest").alias("n_rest"), total("buffer").alias("buffer_sum"), total("rest").alias("rest_sum")))


@query(f"""WITH c AS (SELECT CAST(floor(epoch_us(ts) / 1000000 / {EPOCH}) AS BIGINT) AS epoch, value > 100 AS active, value / 100.0::DOUBLE AS u, value / 1000.0::DOUBLE AS shape, value / 500.0::DOUBLE AS shape_raw, value AS scale, event_id / 100.0::DOUBLE AS level, value > 300 AS clamped, event_id % 7 = 0 AS degenerate FROM events
), m AS (SELECT epoch_us(max(ts)) / 1000000 - {LATE} AS mark FROM events)
SELECT epoch, count(*) AS n, round(avg(active::INT), 6) AS active, round(avg(u), 6) AS u, round(avg(shape), 6) AS shape, round(avg(shape_raw), 6) AS shape_raw, round(avg(scale), 6) AS scale, round(avg(level), 6) AS level, round(avg(clamped::INT), 6) AS clamped, round(avg(degenerate::INT), 6) AS degenerate,
  round(avg(active::INT) * 0.3, 6) AS effective_lam, epoch > 1 AND avg(active::INT) < 0.5 AS rarely_active, avg(clamped::INT) > 0.2 AS often_clamped
FROM c, m GROUP BY epoch, mark HAVING (epoch + 1) * {EPOCH} <= floor(mark * 1000) / 1000""")
def flush_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the calls of each epoch, flushed by a stream of events once the watermark has passed the epoch's end, through a sink that a replayed
    batch adds nothing to."""
    base, c = shared_dir(spark), F.col
    calls = _events(spark, sf_dir).select(
        F.timestamp_micros(F.expr(_MICROS.format("ts"))).alias("ts"), (c("value") > 100).alias("active"), (c("value") / 100.0).alias("u"), (c("value") / 1000.0).alias("shape"), (c("value") / 500.0).alias("shape_raw"), c("value").alias("scale"),
        (c("event_id") / 100.0).alias("level"), (c("value") > 300).alias("clamped"), (c("event_id") % 7 == 0).alias("degenerate"),
    )
    out = records.epoch_flush_stream(calls, EPOCH, f"{LATE} seconds")
    out.writeStream.foreachBatch(files.append_once(f"{base}/rows")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(out.schema).json(f"{base}/rows/batch_id=*"))
