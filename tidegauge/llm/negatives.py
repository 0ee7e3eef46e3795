"""Hard negatives by a table of pivot distances.

Vectors are of whole numbers, scores are inner products. A vector y gets one more component sqrt(M - |y|^2), M the largest
squared length, an anchor q a zero; the squared distance of both is then |q|^2 + M - 2 * score, so high scores are short
distances. The table stores of every row its distances to PIVOTS pivots, which are chosen far apart from a sample of SAMPLE rows, and
its cell, the nearest pivot. By the triangle inequality the distances of an anchor to the pivots and the least and largest
stored distances of a cell, or of a block of rows, bracket all scores there. An anchor goes only to the cells, and is compared only with
the blocks, whose bracket reaches the scores that it looks for; what survives is scored exactly, in whole numbers.

Positives are looked for in the anchor's own cell first; the score of the last of them bounds the search elsewhere. Cells are
dealt in parts of about PART rows, and anchors in batches of about BATCH, so a task holds one part and one batch whatever the sizes
of cells are, and no row or anchor passes through the driver. Each task returns the few best of each anchor.

Defined results: labels are whole numbers; rows with a null id or label, a null vector or a component that is null or not finite take no part; a shorter
vector ends in zeros; rows that share an id are rows of their own, but no partners of an anchor of that id; equal rows are one anchor; ties go
to the smaller id; scores have to fit a long, else an error; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PIVOTS, SAMPLE = 32, 2048
#: Rows of a cell and anchors that one task holds; rows that are bracketed together.
PART, BATCH, BLOCK = 8192, 16_384, 512
#: Brackets are widened by so much of |q|^2 + M, far above what distances in double precision are off.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def vectors(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (floor(256 x) of each component) and anchor of the rows that take part."""
    finite = F.forall("_v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    x = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("_v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull()).where(finite)
    return x.select("id", "label", F.transform("_v", lambda c: F.floor(256 * c.cast("double"))).alias("v"), "anchor")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column of whole numbers as rows of `width` int64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in int64, exact. Products of doubles are whole as long as no sum can reach 2**53."""
    most = math.prod(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, v)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("scores do not fit a long")
    return q @ v.T


class Pivots:
    """Pivots (augmented rows), the largest squared length and, once known, the least and largest distance of each cell to each."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most, self.width = most, sample.shape[1]
        y = self.augmented(sample)
        chosen = [int(np.argmax((y**2).sum(1)))]
        near = ((y - y[chosen[0]]) ** 2).sum(1)
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, ((y - y[chosen[-1]]) ** 2).sum(1))
        self.points = y[chosen]
        self.low = self.high = np.zeros((0, len(chosen)))

    def augmented(self, v: np.ndarray, anchor: bool = False) -> np.ndarray:
        v = v.astype(np.float64)
        return np.column_stack([v, np.zeros(len(v)) if anchor else np.sqrt(np.maximum(self.most - (v**2).sum(1), 0))])

    def distances(self, v: np.ndarray, anchor: bool = False) -> np.ndarray:
        y = self.augmented(v, anchor)
        square = (y**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * y @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def bracket(self, q: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor (q, its distances dq) with rows whose distances lie between low and high. A distance
        near zero is a difference of large squares, so distances count with their own slack."""
        total = (q.astype(np.float64) ** 2).sum(1) + self.most
        off = np.sqrt(SLACK * total)[:, None]
        near = np.maximum(np.maximum(low - dq, dq - high) - off, 0).max(1)
        far = (dq + high + off).min(1)
        return (total - far**2) / 2 - SLACK * total, (total - near**2) / 2 + SLACK * total


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Pivots, list[int]]:
    """id, label, v, anchor, cell and d (distances to the pivots) of vectors(), written; the pivots with the extent of each cell; rows
    of each cell. At most PIVOTS cells come to the driver."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    all_rows = rows.agg(F.max(square).alias("most"), F.max(F.size("v")).alias("width")).first()
    sample = pa.array([r["v"] for r in C.hash_sample(rows, F.struct("id", "v"), SAMPLE).select("v").collect()], pa.list_(pa.int64()))
    pivots = Pivots(matrix(sample, all_rows["width"] or 0), all_rows["most"] or 0.0) if len(sample) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.distances(matrix(batch.column("v"), pivots.width))
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1)))], [*batch.schema.names, "cell", "d"])

    table = C.written(rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, label long, v array<long>, anchor boolean, cell int, d array<double>"), "pivots")
    if pivots is None:
        return table, None, []

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots.points)
        n, low, high = np.zeros(k, np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            cell, d = batch.column("cell").to_numpy(), batch.column("d").flatten().to_numpy().reshape(-1, k)
            n += np.bincount(cell, minlength=k)
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        at = np.repeat(np.flatnonzero(n), k)
        j = np.tile(np.arange(k), len(at) // k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, j, n[at], low[at, j], high[at, j])], ["cell", "j", "n", "low", "high"])

    found = table.select("cell", "d").mapInArrow(extent, "cell long, j long, n long, low double, high double")
    found = found.groupBy("cell", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    k, sizes = len(pivots.points), [0] * len(pivots.points)
    pivots.low, pivots.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for r in found:
        sizes[r["cell"]], pivots.low[r["cell"], r["j"]], pivots.high[r["cell"], r["j"]] = r["n"], r["low"], r["high"]
    return table, pivots, sizes


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k of the highest scores, then smallest ids, of their group; in that order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[place < k]


class Best:
    """The k best of each of n searches, and the score that another has to reach."""

    def __init__(self, n: int, k: int, need: np.ndarray):
        self.k, self.need = k, need.copy()
        self.group, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, s: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Scores s of the searches `group` with rows of `ids`, where ok."""
        s = np.where(ok, s, _NONE)
        least = np.maximum(self.need[group], np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else _NONE)
        r, c = np.nonzero(ok & (s >= least[:, None]))
        if not len(r):
            return
        g, x, i = np.r_[self.group, group[r]], np.r_[self.score, s[r, c]], np.r_[self.ids, ids[c]]
        top = _first(g, x, i, self.k)
        self.group, self.score, self.ids = g[top], x[top], i[top]
        n = np.bincount(self.group, minlength=len(self.need))
        last = np.cumsum(n)[n == self.k] - 1
        at = self.group[last]
        self.need[at] = np.maximum(self.need[at], self.score[last])


def _blocks(d: np.ndarray, cell: int) -> list[np.ndarray]:
    """Rows in blocks of BLOCK, the nearest to the cell's pivot first."""
    order = np.argsort(d[:, cell], kind="stable")
    return [order[a : a + BLOCK] for a in range(0, len(order), BLOCK)]


def _meet(table: DataFrame, anchors: DataFrame, pivots: Pivots, sizes: list[int], n_anchors: int, find, schema: str) -> DataFrame:
    """find(rows, anchors) for each part of a cell and each batch of the anchors that have the cell in their column `cells`."""
    batches = max(1, -(-n_anchors // BATCH))
    parts = F.array(*[F.lit(max(1, -(-n // PART))) for n in sizes])
    at = F.pmod(F.xxhash64("id", "v"), F.get(parts, F.col("cell")).cast("long")).cast("int")
    left = table.select("cell", at.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "id", "label", "v", "d")
    right = anchors.withColumn("batch", F.pmod(F.xxhash64("a"), F.lit(batches).cast("long")).cast("int")).withColumn("cell", F.explode("cells")).drop("cells")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
    keys = ["cell", "part", "batch"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, schema)


def positives(table: DataFrame, anchors: DataFrame, pivots: Pivots, sizes: list[int], n_anchors: int, k: int) -> DataFrame:
    """a, k (place from 0), positive_id and positive_score: the k best other rows of each anchor's label."""
    kind = table.schema["id"].dataType.simpleString()
    schema = f"a long, id {kind}, score long"

    def find(rows: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and some.num_rows:
            v, d, ids, label = matrix(rows["v"], pivots.width), rows["d"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows["id"].to_numpy(), rows["label"].to_numpy()
            q, mine, own = matrix(some["v"], pivots.width), some["id"].to_numpy(), some["label"].to_numpy()
            dq, best = pivots.distances(q, True), Best(len(q), k, some["need"].to_numpy())
            cell = rows["cell"][0].as_py()
            for value in np.unique(own):
                at, who = np.flatnonzero(label == value), np.flatnonzero(own == value)
                for block in _blocks(d[at], cell):
                    b = at[block]
                    most = pivots.bracket(q[who], dq[who], d[b].min(0), d[b].max(0))[1]
                    w = who[most >= best.need[who]]
                    if len(w):
                        best.add(w, scores(q[w], v[b]), ids[b] != mine[w, None], ids[b])
            out = [some["a"].to_numpy()[best.group], best.ids, best.score]
        return pa.table([pa.array(x, t) for x, t in zip(out or ([], [], []), (pa.int64(), rows.schema.field("id").type, pa.int64()))], ["a", "id", "score"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells besides its own whose bracket reaches what an anchor needs."""
        for batch in batches:
            q = matrix(batch.column("v"), pivots.width)
            dq, need, own = pivots.distances(q, True), batch.column("need").to_numpy(), batch.column("cell").to_numpy()
            ok = np.column_stack([(pivots.bracket(q, dq, pivots.low[c], pivots.high[c])[1] >= need) & (own != c) if sizes[c] else np.zeros(len(q), bool) for c in range(len(sizes))])
            yield _with_cells(batch, ok)

    w = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    first = lambda x: x.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < k)
    own = anchors.select("a", "id", "label", "v", F.lit(_NONE).alias("need"), F.array("cell").alias("cells"))
    near = C.written(first(_meet(table, own, pivots, sizes, n_anchors, find, schema)), "near")
    need = near.where(F.col("k") == k - 1).select("a", F.col("score").alias("need"))
    rest = anchors.join(need, "a", "left").select("a", "id", "label", "v", "cell", F.coalesce("need", F.lit(_NONE)).alias("need"))
    rest = rest.mapInArrow(reached, f"a long, id {kind}, label long, v array<long>, need long, cells array<int>")
    found = near.drop("k").unionByName(_meet(table, rest, pivots, sizes, n_anchors, find, schema))
    return first(found).select("a", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def _with_cells(batch: pa.RecordBatch, ok: np.ndarray) -> pa.RecordBatch:
    """A batch without the column cell and with cells, the true columns of each row of ok."""
    offsets = pa.array(np.r_[0, np.cumsum(ok.sum(1))].astype(np.int32))
    names = [n for n in batch.schema.names if n != "cell"]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(ok)[1].astype(np.int32)))], [*names, "cells"])


def mine(rows: DataFrame, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(): for each anchor and each of its first
    positives the first rows of other labels whose score is at most the positive's and at least that share of it."""
    table, pivots, sizes = pivot_table(rows)
    kind = table.schema["id"].dataType.simpleString()
    if pivots is None:
        return table.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    anchors = table.where("anchor").select("id", "label", "v", "cell").dropDuplicates(["id", "label", "v"])
    anchors = C.written(anchors.select(F.monotonically_increasing_id().alias("a"), "*"), "anchors")
    n_anchors = anchors.count()
    found = C.written(positives(table, anchors, pivots, sizes, n_anchors, n_positives), "positives")

    def limits(s: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and place the least and largest score looked for; places without a positive look for none."""
        top = np.full((len(s), n_positives), _NONE)
        s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
        n = s.value_lengths().to_numpy(zero_copy_only=False)
        top[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = s.flatten().to_numpy()
        whole, part = np.divmod(top, share[1])
        return np.where(top == _NONE, np.iinfo(np.int64).max, share[0] * whole - (-share[0] * part) // share[1]), top

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), pivots.width)
            dq, (low, top) = pivots.distances(q, True), limits(batch.column("s"))
            cells = [np.zeros(len(q), bool)] * len(sizes)
            for c in np.flatnonzero(sizes):
                least, most = pivots.bracket(q, dq, pivots.low[c], pivots.high[c])
                cells[c] = ((low <= most[:, None]) & (top >= least[:, None]) & (low <= top)).any(1)
            yield _with_cells(batch, np.column_stack(cells))

    def find(rows: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and some.num_rows:
            v, d, ids, label = matrix(rows["v"], pivots.width), rows["d"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows["id"].to_numpy(), rows["label"].to_numpy()
            q, mine, own = matrix(some["v"], pivots.width), some["id"].to_numpy(), some["label"].to_numpy()
            dq, (low, top) = pivots.distances(q, True), limits(some["s"])
            best = Best(low.size, n_negatives, low.reshape(-1))
            for b in _blocks(d, rows["cell"][0].as_py()):
                least, most = pivots.bracket(q, dq, d[b].min(0), d[b].max(0))
                wanted = (best.need.reshape(low.shape) <= most[:, None]) & (top >= least[:, None])
                w = np.flatnonzero(wanted.any(1))
                if not len(w):
                    continue
                s = scores(q[w], v[b])
                other = (label[b] != own[w, None]) & (ids[b] != mine[w, None])
                for k in range(n_positives):
                    x = np.flatnonzero(wanted[w, k])
                    if len(x):
                        g = w[x] * n_positives + k
                        best.add(g, s[x], other[x] & (s[x] <= top[w[x], k, None]) & (s[x] >= low[w[x], k, None]), ids[b])
            out = [some["a"].to_numpy()[best.group // n_positives], best.group % n_positives, best.ids, best.score]
        kinds = (pa.int64(), pa.int32(), rows.schema.field("id").type, pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(out or ([], [], [], []), kinds)], ["a", "k", "id", "score"])

    lists = found.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "positive_score"))), lambda x: x["positive_score"]).alias("s"))
    asked = anchors.join(lists, "a").select("a", "id", "label", "v", "s").mapInArrow(reached, f"a long, id {kind}, label long, v array<long>, s array<long>, cells array<int>")
    some = _meet(table, asked, pivots, sizes, n_anchors, find, f"a long, k int, id {kind}, score long")
    w = Window.partitionBy("a", "k").orderBy(F.desc("score"), "id")
    some = some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives)
    some = some.select("a", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = some.join(found, ["a", "k"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
