"""Scores of a predicted against a true grid, one row per record: grids are arrays in row order, so nothing is shuffled.

Distance transforms and summed-area tables, whose steps depend on each other, are array operations on Arrow batches; all else are expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.numeric import logit_loss, sigmoid


def binarise(values: Column) -> Column:
    """Array of booleans: above 127 if the largest value is above 1, else above 0."""
    return F.transform(values, lambda v: F.when(F.array_max(values) > 1, v > 127).otherwise(v > 0))


def threshold(prob: Column | str, t: float) -> Column:
    """Array of booleans: values of at least t."""
    return F.transform(prob, lambda p: p >= F.lit(t))


def positive_fraction(mask: Column | str) -> Column:
    """Share of set cells."""
    return F.try_divide(F.size(F.filter(mask, lambda x: x)), F.size(mask))


def bincount(df: DataFrame, by: str, values: str, n: int = 256) -> DataFrame:
    """by, bin, n: how often each whole number from 0 to n - 1 stands in the arrays of a group, also those that never do."""
    seen = df.select(by, F.explode(values).alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))
    every = df.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return every.join(seen, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def all_metrics(df: DataFrame, h: int, w: int, prob: str = "prob", t: float = 0.5) -> DataFrame:
    """Counts, scores, hd95 and threshold sweeps of prob against gt, both arrays of h * w; another size is an error."""
    wrong = (F.size(prob) != h * w) | (F.size("gt") != h * w)
    df = df.withColumn("pred", F.when(wrong, F.raise_error(F.format_string("maps of %d and %d cells for a grid of %d", F.size(prob), F.size("gt"), F.lit(h * w)))).otherwise(threshold(prob, t)))
    return threshold_sweep(hd95(binary_scores(confusion(df)), h, w), prob)


def truth_masks(records: DataFrame, split: str = "split", values: str = "values") -> DataFrame:
    """split, gt: where the mean of a split's grids is positive."""
    cells = records.select(split, F.posexplode(values).alias("pos", "v"))
    mean = cells.groupBy(split, "pos").agg((F.avg(F.col("v").cast("double")) > 0).alias("g"))
    return mean.groupBy(split).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "g"))), lambda x: x["g"]).alias("gt"))


def confusion(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn from arrays pred and gt."""
    code = F.zip_with("pred", "gt", lambda p, g: p.cast("int") * 2 + g.cast("int"))
    df = df.withColumn("_code", code)
    count = lambda v: F.size(F.filter("_code", lambda c: c == v)).cast("long")
    return df.withColumns({"tp": count(3), "fp": count(2), "fn": count(1), "tn": count(0)}).drop("_code")


def binary_scores(df: DataFrame) -> DataFrame:
    """dice, iou, recall, precision, specificity, pred_empty, gt_empty from the four counts; undefined scores are NULL."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    empty = (tp + fp + fn) == 0
    return df.withColumns({
        "dice": F.when(empty, 1.0).otherwise(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "iou": F.when(empty, 1.0).otherwise(F.try_divide(tp, tp + fp + fn)),
        "recall": F.try_divide(tp, tp + fn),
        "precision": F.try_divide(tp, tp + fp),
        "specificity": F.try_divide(tn, tn + fp),
        "pred_empty": (tp + fp) == 0,
        "gt_empty": (tp + fn) == 0,
    })


def threshold_sweep(df: DataFrame, prob: str = "prob") -> DataFrame:
    """dice_sweep and iou_sweep: means over the 256 thresholds k/255 of the min-max normalised map in 8 bits.

    The values in descending order are walked once: between two neighbouring values all thresholds give the same counts, so
    each step adds its score times the number of thresholds in it.
    """
    lo, hi = F.array_min(prob), F.array_max(prob)
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    q = F.zip_with(prob, "gt", lambda v, g: F.struct(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8))) * 255.0).cast("int").alias("q"), g.cast("int").alias("g")))
    df = df.withColumn("_s", F.sort_array(q, asc=False)).withColumn("_np", F.size(F.filter("gt", lambda g: g)).cast("double"))
    d = "CASE WHEN {k} + _np > 0 THEN 2 * {t} / ({k} + _np) ELSE 1D END"
    i = "CASE WHEN {k} + _np - {t} > 0 THEN {t} / ({k} + _np - {t}) ELSE 1D END"
    step = lambda f: f.format(k="a.k", t="a.t")
    walk = f"""aggregate(_s, named_struct('q', 255, 'k', 0D, 't', 0D, 'd', 0D, 'i', 0D),
        (a, e) -> named_struct('q', e.q, 'k', a.k + 1D, 't', a.t + e.g, 'd', a.d + (a.q - e.q) * ({step(d)}), 'i', a.i + (a.q - e.q) * ({step(i)})))"""
    df = df.withColumn("_a", F.expr(walk))
    last = lambda f, s: F.expr(f"(_a.{s} + (_a.q + 1) * ({f.format(k='_a.k', t='_a.t')})) / 256")
    return df.withColumn("dice_sweep", last(d, "d")).withColumn("iou_sweep", last(i, "i")).drop("_lo", "_hi", "_s", "_np", "_a")


#: Cells of the maps that are worked on together in a task.
CELLS = 1 << 21
_FAR = 1 << 20  # farther than any two cells of a map


def _maps(column: pa.Array, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The maps of h * w cells in a list column, and which rows have one; others are nulls or of another size."""
    n = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    return column.filter(pa.array(n == h * w)).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w), n == h * w


def surface(mask: np.ndarray) -> np.ndarray:
    """Set cells with an unset neighbour (up, down, left, right) inside the map, of n maps."""
    inner = mask.copy()
    inner[:, 1:] &= mask[:, :-1]
    inner[:, :-1] &= mask[:, 1:]
    inner[:, :, 1:] &= mask[:, :, :-1]
    inner[:, :, :-1] &= mask[:, :, 1:]
    return mask & ~inner


def squared_distances(cells: np.ndarray, steps: list[int] | None = None) -> np.ndarray:
    """Squared Euclidean distance of each cell to the nearest set cell of its map, of n maps; exact, in whole numbers.

    First along columns, by two scans. Then along rows: each cell is the foot of a parabola, and a scan keeps the lower envelope of those
    so far as a stack of feet and of the places from which each is the lowest; a second scan reads it off. A foot is
    pushed and popped once at most, so work is linear in cells; steps gets what was done, in cells.
    """
    n, h, w = cells.shape
    g = np.where(cells, 0, _FAR).astype(np.int64)
    for y in range(1, h):
        np.minimum(g[:, y], g[:, y - 1] + 1, out=g[:, y])
    for y in range(h - 2, -1, -1):
        np.minimum(g[:, y], g[:, y + 1] + 1, out=g[:, y])
    f = (np.minimum(g, _FAR) ** 2).reshape(n * h, w)
    line = np.arange(n * h)
    foot, start, top = np.zeros((n * h, w), np.int64), np.zeros((n * h, w), np.int64), np.zeros(n * h, np.int64)
    worked = 2 * f.size
    for u in range(1, w):
        live = line
        while len(live):
            k = top[live]
            x, s = start[live, k], foot[live, k]
            worked += len(live)
            live = live[(x - s) ** 2 + f[live, s] > (x - u) ** 2 + f[live, u]]
            top[live] -= 1
            live = live[top[live] >= 0]
        none = top < 0
        s = foot[line, np.maximum(top, 0)]
        from_ = 1 + (u * u - s * s + f[:, u] - f[line, s]) // (2 * np.maximum(u - s, 1))
        push = none | (from_ < w)
        at = np.where(none, 0, top + 1)[push]
        foot[line[push], at] = u
        start[line[push], at] = np.where(none, 0, from_)[push]
        top[push] = at
    out = np.empty((n * h, w), np.int64)
    for u in range(w - 1, -1, -1):
        s = foot[line, top]
        out[:, u] = (u - s) ** 2 + f[line, s]
        top -= start[line, top] == u
    if steps is not None:
        steps.append(worked + out.size)
    return out.reshape(n, h, w)


def surface_percentiles(pred: np.ndarray, gt: np.ndarray, p: float) -> list[float]:
    """The linear interpolated percentile of the distances between both surfaces, pooled, of n pairs of maps; 0 if both
    maps are empty, the diagonal if one is."""
    a, b = surface(pred), surface(gt)
    to_b, to_a = squared_distances(b), squared_distances(a)
    out = []
    for k in range(len(pred)):
        if not pred[k].any() or not gt[k].any():
            out.append(math.hypot(*pred.shape[1:]) if pred[k].any() or gt[k].any() else 0.0)
            continue
        d = np.sort(np.concatenate([to_b[k][a[k]], to_a[k][b[k]]]))
        if not len(d) or d[-1] >= _FAR:  # a map without a surface is full: no cell has an unset neighbour
            out.append(None)
            continue
        at = (len(d) - 1) * p
        lo, hi = math.sqrt(d[math.floor(at)]), math.sqrt(d[math.ceil(at)])
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def array_percentile(values: str, p: float) -> Column:
    """Linear interpolated percentile of a sorted array column."""
    at = (F.size(values) - 1) * F.lit(p)
    lo, hi = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def hd95(df: DataFrame, h: int, w: int) -> DataFrame:
    """hd95: 95th percentile of the pooled distances between both surfaces; 0 if both are empty, the diagonal if one is; NULL if a map is
    null, of another size, or has no surface. Work per record is linear in its cells, see squared_distances()."""

    @F.arrow_udf("double")
    def distance(pred: pa.Array, gt: pa.Array) -> pa.Array:
        step, out = max(1, CELLS // (h * w)), []
        for k in range(0, len(pred), step):
            p, g = pred.slice(k, step), gt.slice(k, step)
            ok = pa.array(_maps(p, h, w)[1] & _maps(g, h, w)[1])
            found = iter(surface_percentiles(_maps(p.filter(ok), h, w)[0], _maps(g.filter(ok), h, w)[0], 0.95))
            out += [next(found) if x else None for x in ok.to_pylist()]
        return pa.array(out, pa.float64())

    return df.withColumn("hd95", distance("pred", "gt"))


def soft_dice_deficit(df: DataFrame, logits: str = "logits", smooth: float = 1.0) -> DataFrame:
    """deficit: 1 minus the soft Dice of sigmoid(logits) and gt, in [0, 1]."""
    df = df.withColumn("_p", F.transform(logits, sigmoid))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    inter = total(F.zip_with("_p", "gt", lambda p, g: p * g.cast("double")))
    both = total("_p") + total(F.transform("gt", lambda g: g.cast("double")))
    value = 1.0 - (2.0 * inter + smooth) / (both + smooth)
    return df.withColumn("deficit", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop("_p")


def box_means(cells: np.ndarray, size: int) -> np.ndarray:
    """Sums of the size x size boxes around each cell of n maps over size * size, cells outside counting as 0. A summed-area table makes a
    box four reads, whatever its size."""
    n, h, w = cells.shape
    table = np.zeros((n, h + 1, w + 1))
    np.cumsum(np.cumsum(cells, axis=1), axis=2, out=table[:, 1:, 1:])
    half = size // 2
    ends = lambda k: (np.maximum(np.arange(k) - half, 0), np.minimum(np.arange(k) + half + 1, k))
    (top, bottom), (left, right) = ends(h), ends(w)
    box = lambda y, x: table[:, y[:, None], x]
    return (box(bottom, right) - box(top, right) - box(bottom, left) + box(top, left)) / (size * size)


def boundary_weights(df: DataFrame, h: int, w: int, size: int = 31, gain: float = 5.0) -> DataFrame:
    """bw: 1 + gain * |mean of the size x size box around - gt|, cells outside counting as 0 in the mean; NULL if gt is null or of
    another size. The sides of a box are odd."""
    if size % 2 == 0:
        raise ValueError(f"the side of a box is odd, not {size}")

    @F.arrow_udf("array<double>")
    def weights(gt: pa.Array) -> pa.Array:
        step, out = max(1, CELLS // (h * w)), []
        for k in range(0, len(gt), step):
            cells, ok = _maps(gt.slice(k, step), h, w)
            cells = cells.astype(np.float64)
            found = 1.0 + gain * np.abs(box_means(cells, size) - cells)
            offsets = np.r_[0, np.cumsum(np.where(ok, h * w, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)), mask=pa.array(~ok))
            out.append(lists)
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return df.withColumn("bw", weights("gt"))


def structure_score(df: DataFrame, h: int, w: int, logits: str = "logits", variant: str = "plain", eps: float = 1.0) -> DataFrame:
    """structure: cross-entropy (plain mean, or weighted) plus one minus the weighted IoU, boundary weights of boundary_weights()."""
    df = boundary_weights(df, h, w)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    y = F.transform("gt", lambda g: g.cast("double"))
    df = df.withColumn("_y", y).withColumn("_b", F.zip_with(logits, y, logit_loss)).withColumn("_p", F.transform(logits, sigmoid))
    ce = total("_b") / F.size("_b") if variant == "plain" else total(F.zip_with("bw", "_b", lambda a, b: a * b)) / total("bw")
    inter = total(F.zip_with(F.zip_with("_p", "_y", lambda p, t: p * t), "bw", lambda a, b: a * b))
    union = total(F.zip_with(F.zip_with("_p", "_y", lambda p, t: p + t), "bw", lambda a, b: a * b))
    return df.withColumn("structure", ce + 1.0 - (inter + eps) / (union - inter + eps)).drop("_y", "_b", "_p")
