"""The tail estimator as a stateful stream: a bounded buffer, a smoothed threshold and a step count for each group.

Rows are taken in order of `order_col` within a trigger and cut into batches of `size` rows; a batch that is not full waits in
the state for the next trigger, so results do not depend on how rows fall into triggers, as long as triggers are in order. The
threshold and the buffer of a batch are those before it. State is at most `keep` + `size` values for each group.

What a task holds: `bounded()` reads so many files a trigger, which bounds the rows of a trigger, and `reorder` bounds what is sorted: rows
wait in a heap of that many, and the least goes on when one more comes. So rows may come up to `reorder` rows late; a row that comes later still is
taken when it comes. At the end of a trigger the heap is emptied. With `reorder` of None a trigger is sorted as a whole.

The state can be read from a checkpoint as a table (`exported`) and handed to another stream (`initial`), which goes on from there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, batch long, u double, n_live long, n_pool long, active boolean, shape double, scale double, value double, deficit_mean double, deficit_max double, lam double"


@dataclass(frozen=True)
class TailSettings:
    p: float = 0.15
    alpha: float = 0.02
    lam: float = 0.3
    warmup_batches: float = 0.0
    size: int = 16
    keep: int = 512
    least: int = 128
    min_exceedances: int = 8
    momentum: float = 0.05
    shape_min: float = -1.5
    shape_max: float = 0.7
    mode: str = "gpd"
    cap: float | None = None


def _gain(x: float, r: float) -> float:
    z = x * r
    return r * (sum(z**k / math.factorial(k + 1) for k in range(7)) if abs(z) < 1e-2 else math.expm1(z) / z)


def _slope(x: float, r: float) -> float:
    z = x * r
    return r * r * (sum((k + 1) * z**k / math.factorial(k + 2) for k in range(7)) if abs(z) < 1e-2 else ((z - 1) * math.exp(z) + 1) / z**2)


def pool_value(pool: np.ndarray, s: TailSettings) -> tuple[float | None, float | None, float | None]:
    """shape, scale (by mode gpd only) and the weighted value of sorted exceedances."""
    n = len(pool)
    shape = scale = None
    if s.mode == "ohem":
        w = np.full(n, 1 / n)
    elif s.mode == "cvar":
        m = max(1, int(np.rint(n * (s.alpha / s.p))))
        w = np.where(np.arange(n) >= n - m, 1 / m, 0.0)
    elif s.mode == "gpd":
        shape, scale, w = _fitted(pool, s)
    else:
        raise ValueError(f"no weights for mode {s.mode!r}")
    return shape, scale, float((w * pool).sum() / w.sum()) if w.sum() > 0 else None


def _fitted(pool: np.ndarray, s: TailSettings) -> tuple[float, float, np.ndarray]:
    """What tail.fit() and tail.sensitivity() give, for the values of one pool: the state lives in a Python worker."""
    n = len(pool)
    t = (n - np.arange(1, n + 1)) / (n - 1) if n > 1 else np.zeros(n)
    a0, a1 = pool.mean(), (t * pool).mean()
    d = a0 - 2 * a1
    r = math.log(s.p / s.alpha)
    if d <= 1e-8 * max(a0, 1.0) or a0 <= 1e-8 or 2 * a0 * a1 / d <= 0:
        return 0.0, float(a0), np.full(n, r / n)
    raw, scale = 2 - a0 / d, float(2 * a0 * a1 / d)
    shape = float(min(max(raw, s.shape_min), s.shape_max))
    front = 2 / (n * d * d)
    w = _gain(shape, r) * front * (a0 * a0 * t - 2 * a1 * a1)
    if shape == raw:
        w = w + scale * _slope(shape, r) * front * (a1 - a0 * t)
    return shape, scale, np.maximum(w, 0.0)


STATE = "step long, u double, buffer array<double>, rest array<double>"


class TailProcessor(StatefulProcessor):
    def __init__(self, settings: TailSettings, order_col: str, value_col: str, reorder: int | None = None):
        self.s, self.order_col, self.value_col, self.reorder = settings, order_col, value_col, reorder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            u = None if row.u is None or math.isnan(row.u) else float(row.u)
            self.state.update((int(row.step), u, [float(v) for v in row.buffer], [float(v) for v in row.rest]))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The values of a trigger in order, in pieces."""
        if self.reorder is None:
            yield pd.concat(list(rows)).sort_values(self.order_col, kind="stable")[self.value_col].to_numpy(float)
            return
        waiting: list[tuple] = []
        n = 0
        for piece in rows:
            out = []
            for place, v in zip(piece[self.order_col].tolist(), piece[self.value_col].astype(float).tolist()):
                n += 1  # of equal places the first to come goes first
                if len(waiting) < self.reorder:
                    heapq.heappush(waiting, (place, n, v))
                else:
                    out.append(heapq.heappushpop(waiting, (place, n, v))[2])
            yield np.array(out, float)
        yield np.array([heapq.heappop(waiting)[2] for _ in range(len(waiting))], float)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, u, buffer, rest = self.state.get() if self.state.exists() else (0, None, [], [])
        buffer, rest = np.array(buffer, float), np.array(rest, float)
        empty = True
        for piece in self._in_order(rows):
            values = np.concatenate([rest, piece])
            full = len(values) - len(values) % self.s.size
            out = []
            for at in range(0, full, self.s.size):
                row, u, buffer = self._batch(key[0], step, u, buffer, values[at : at + self.s.size])
                out.append(row)
                step += 1
            rest = values[full:]
            if out:
                empty = False
                yield self._frame(out)
        self.state.update((step, u, buffer.tolist(), rest.tolist()))
        if empty:
            yield self._frame([])

    def _frame(self, out: list[list]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"batch": "int64", "n_live": "int64", "n_pool": "int64", "active": "bool"})

    def _batch(self, key: str, step: int, u: float | None, buffer: np.ndarray, live: np.ndarray) -> tuple[list, float | None, np.ndarray]:
        """The row of a batch, and threshold and buffer after it."""
        s = self.s
        lam = s.lam * (min(1.0, step / s.warmup_batches) if s.warmup_batches > 0 else 1.0)
        row = [key, step, u, 0, 0, False, None, None, None, float(live.mean()), float(live.max()), lam]
        if u is not None:
            e, old = live[live > u] - u, buffer[buffer > u] - u
            if s.cap is not None:
                e, old = np.minimum(e, s.cap), np.minimum(old, s.cap)
            row[3], row[4] = len(e), len(e) + len(old)
            if row[4] >= s.min_exceedances and len(e) and lam > 0:
                row[6], row[7], row[8] = pool_value(np.sort(np.concatenate([e, old])), s)
                row[5] = row[8] is not None
        buffer = np.concatenate([buffer, live])[-s.keep :]
        if len(buffer) >= s.least:
            q = float(np.quantile(buffer, 1 - s.p))
            u = q if u is None else (1 - s.momentum) * u + s.momentum * q
        return row, u, buffer

    def close(self) -> None:
        pass


def bounded(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder tree as a stream of so many files a trigger."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(path)


def exported(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, step, u, buffer, rest: the state of a stream from its checkpoint, a row for each group."""
    state = spark.read.format("statestore").option("stateVarName", "tail").load(checkpoint)
    return state.select("key.key", "value.*")


def tail_stream(rows: DataFrame, key: str, order_col: str, value_col: str, settings: TailSettings | None = None, reorder: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """A row of OUTPUT for each full batch. Needs the RocksDB state store provider. initial: exported() state to go on from."""
    rows = rows.select(rows[key].cast("string").alias("key"), rows[order_col].alias("place"), rows[value_col].cast("double").alias("value"))
    first = None if initial is None else initial.select("key", "step", "u", "buffer", "rest").groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(TailProcessor(settings or TailSettings(), "place", "value", reorder), outputStructType=OUTPUT, outputMode="Append", timeMode="None", initialState=first)
