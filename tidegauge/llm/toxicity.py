"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. The model of each category is a logistic regression over the words of a document
and over the probabilities of the categories before it. For training those probabilities are out-of-fold: each comes from
a model that has not seen the document, as at prediction time. The last step of `fit` sets each category's threshold, the
one of the best F1 on out-of-fold probabilities.

Training takes at most `max_rows` labelled documents (the smallest hashes of doc_id), so its cost on the driver is bounded;
everything else reads all documents. Features are presences of words, lower case, hashed to 2**BITS places; each category
uses the FEATURES places that differ most between its classes. A document is scored by one look at its whole text.

Defined results: a null text counts as empty and gets the probabilities of no words; null labels and repeated label ids are
left out (of rows that repeat an id with different labels the largest labels count); a category of which the sample has one
class only gets its share in the sample as probability and never fires; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
FEATURES = 1500
FOLDS = 5
MAX_ROWS = 20_000
_TABLE = C.separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place) of the words of a piece, repeats included, and a hash of each text's words."""
    data, offsets = C.raw(pc.utf8_lower(texts))
    starts, ends, first = C.words(data, offsets, _TABLE)
    h = C.word_hashes(data, starts, ends)
    return np.repeat(np.arange(len(texts)), np.diff(first)), (h >> np.uint64(64 - BITS)).astype(np.int64), C.per_text(h, first)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """weights: for the chosen places, then for the categories before, then the intercept."""

    places: np.ndarray
    weights: np.ndarray

    def predict(self, row: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probabilities for len(before) documents from their distinct (row, place) and the earlier probabilities."""
        k = np.minimum(np.searchsorted(self.places, place), max(len(self.places) - 1, 0))
        hit = self.places[k] == place if len(self.places) else np.zeros(len(place), bool)
        words = np.bincount(row[hit], self.weights[k[hit]], minlength=len(before))
        n = len(self.places)
        return _sigmoid(words + before @ self.weights[n:-1] + self.weights[-1])


def fit_linear(row: np.ndarray, place: np.ndarray, before: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-3, rate: float = 0.1) -> Linear:
    """Logistic regression by Adam over the places that tell the classes apart."""
    n = len(y)
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Linear(np.zeros(0, np.int64), np.concatenate([np.zeros(before.shape[1]), [np.log(p / (1 - p))]]))
    size = 1 << BITS
    seen = np.bincount(place, minlength=size)
    pos = np.bincount(place, y[row], minlength=size)
    z = np.abs(pos - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    z[seen < 3] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    best = best[z[best] > 2].astype(place.dtype)
    k = np.minimum(np.searchsorted(best, place), max(len(best) - 1, 0))
    hit = best[k] == place if len(best) else np.zeros(len(place), bool)
    row, k = row[hit], k[hit]
    w = np.zeros(len(best) + before.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(row, w[k], minlength=n) + before @ w[len(best) : -1] + w[-1])
        e = (p - y) / n
        g = np.concatenate([np.bincount(k, e[row], minlength=len(best)), before.T @ e, [e.sum()]])
        g[:-1] += ridge * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Linear(best, w)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; above 1 if nothing is positive."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """n x categories probabilities from distinct (row, place)."""
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, m.predict(row, place, out)])
        return out


def fit_chain(row: np.ndarray, place: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: list[str]) -> Chain:
    """A chain over documents 0..n-1 from their distinct (row, place), 0/1 labels (n x categories) and folds."""
    n = len(labels)
    oof = np.zeros((n, 0))
    models, thresholds = [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        p = np.full(n, y.mean() if n else 0.0)
        for f in np.unique(fold):
            out = fold == f
            if out.all():
                continue
            new = (np.cumsum(~out) - 1).astype(np.int32)
            use = ~out[row]
            part = fit_linear(new[row[use]], place[use], oof[~out], y[~out])
            new = (np.cumsum(out) - 1).astype(np.int32)
            use = out[row]
            p[out] = part.predict(new[row[use]], place[use], oof[out])
        models.append(fit_linear(row, place, oof, y))
        thresholds.append(best_threshold(p, y) if 0 < y.sum() < n else 2.0)
        oof = np.column_stack([oof, p])
    return Chain(list(categories), models, thresholds)


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, max_rows: int) -> tuple:
    """Distinct (row, place), labels and folds of the training documents, ordered by id. Folds are dealt by a hash of a text's
    words, so copies of one text share a fold."""
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    known = known.groupBy("id").agg(*[F.max(c).alias(c) for c in categories])
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # the documented bound of the broadcast
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    # One text stands for an id, the smallest, so no more than max_rows come to the driver.
    d = d.groupBy("id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in categories])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                if not len(at):
                    continue
                row, place, key = word_places(texts)
                both = np.unique(row << BITS | place)
                offsets = np.searchsorted(both >> BITS, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                rest = [batch.column(k).slice(at[0].as_py(), len(at)) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at[0].as_py(), len(at)), lists, pa.array((key % np.uint64(FOLDS)).astype(np.int32)), *rest], ["id", "places", "_fold", *categories])

    kind = d.dtypes[0][1]
    t = d.select("id", "text", *categories).mapInArrow(run, f"id {kind}, places array<int>, _fold int, {', '.join(f'{c} int' for c in categories)}").toArrow()
    t = t.sort_by("id").combine_chunks()
    places = t.column("places").combine_chunks()
    n = t.num_rows
    row = np.repeat(np.arange(n, dtype=np.int32), places.value_lengths().to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int32)
    place = places.flatten().to_numpy(zero_copy_only=False)
    y = np.column_stack([t.column(c).to_numpy() for c in categories]) if n else np.zeros((0, len(categories)), int)
    return row, place, y, t.column("_fold").to_numpy().astype(np.int64) if n else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    return fit_chain(*sample(docs, labels, categories, id_col, text_col, max_rows), categories)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, p_<category> (double) and <category> (boolean) for each; with keep, all columns of docs come first, under their names."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    cats = chain.categories
    names = docs.columns if keep else [id_col]
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text_col).cast("string").alias("text"))
    # The columns of docs pass through as one struct, so their names can't clash with the new ones.
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for at, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                if not len(at):
                    continue
                row, place, _ = word_places(texts)
                both = np.unique(row << BITS | place)
                p = chain.predict(both >> BITS, both & ((1 << BITS) - 1), len(texts))
                cols = [pa.array(p[:, c]) for c in range(len(cats))] + [pa.array(p[:, c] >= chain.thresholds[c]) for c in range(len(cats))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at[0].as_py(), len(at)), *cols], ["row", *[f"p{c}" for c in range(len(cats))], *[f"y{c}" for c in range(len(cats))]])

    out = rows.mapInArrow(run, f"row {kind}, {', '.join(f'p{c} double' for c in range(len(cats)))}, {', '.join(f'y{c} boolean' for c in range(len(cats)))}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[x for c, k in enumerate(cats) for x in (F.col(f"p{c}").alias(f"p_{k}"), F.col(f"y{c}").alias(k))])


def clean(docs: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The documents for which the category does not fire, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    c, at_text = chain.categories.index(category), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for at, texts in C.pieces(pa.array(np.arange(batch.num_rows)), batch.column(at_text)):
                if not len(at):
                    continue
                row, place, _ = word_places(texts)
                both = np.unique(row << BITS | place)
                p = chain.predict(both >> BITS, both & ((1 << BITS) - 1), len(texts))
                yield batch.slice(at[0].as_py(), len(at)).filter(pa.array(p[:, c] < chain.thresholds[c]))

    return docs.mapInArrow(run, docs.schema)
