"""Exact and near-duplicate audit of grids: hashes, distances, flags, nearest neighbours, findings.

A hash is 64 bits in two longs of 32 (lo, hi). Rows are (split, id, ...).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.numeric import let
from tidegauge.sources.shared import written

from . import hamming

HASHES = ("a", "d", "p")


def pack(bits: str) -> dict[str, Column]:
    """lo and hi of an array of up to 64 booleans, first bit lowest."""

    def half(start: int) -> Column:
        part = F.slice(bits, start + 1, 32)
        return F.aggregate(F.transform(part, lambda b, k: F.when(b, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), k).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)

    return {"lo": half(0), "hi": half(32)}


def resampling(n: int, m: int) -> list[list[float]]:
    """m x n matrix that resizes n samples to m by the Lanczos kernel of order 3, widened where it makes smaller."""
    scale = n / m
    wide = max(scale, 1.0)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    out = []
    for i in range(m):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        row = [0.0] * n
        for k in range(first, last):
            x = (k + 0.5 - centre) / wide
            row[k] = sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0
        total = sum(row)
        out.append([round(v / total, 15) for v in row])
    return out


def cosine_rows(n: int, m: int) -> list[list[float]]:
    """The first m rows of the orthonormal cosine transform of n samples."""
    return [[math.sqrt((1 if u == 0 else 2) / n) * math.cos((2 * x + 1) * u * math.pi / (2 * n)) for x in range(n)] for u in range(m)]


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(row, col)) for col in zip(*b)] for row in a]


def sandwich(v: Column, left: list[list[float]], right: list[list[float]], h: int, w: int) -> Column:
    """left * grid * right' of a grid of h rows of w, as an array in row order."""
    m, n = len(left), len(right)
    tables = F.array(*[F.lit(c) for row in left for c in row]), F.array(*[F.lit(c) for row in right for c in row])
    total = lambda size, f: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda s, x: s + f(x))
    at = lambda a, k: F.get(a, k.cast("int"))
    cells = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    # Along rows first (place y * n + j), then along columns (place i * n + j).
    rows = lambda c: F.transform(cells(h * n), lambda k: total(w, lambda x: at(v, F.floor(k / n) * w + x) * at(c, (k % n) * w + x)))
    whole = lambda r: let(tables[0], lambda c: F.transform(cells(m * n), lambda k: total(h, lambda y: at(r, y * n + k % n) * at(c, F.floor(k / n) * h + y))))
    return let(let(tables[1], rows), whole)


def resized(v: Column, h: int, w: int, rows: int, columns: int) -> Column:
    """A grid of h rows of w in another size, by the Lanczos kernel."""
    return sandwich(v, resampling(h, rows), resampling(w, columns), h, w)


def hash_maps(h: int, w: int) -> dict[str, tuple[list[list[float]], list[list[float]]]]:
    """For each hash the matrices L and R for which L * grid * R' holds what its bits are made of: the grid in 8 x 8 (a), in 8
    rows of 9 (d), and the first 8 x 8 coefficients of the cosine transform of the grid in 32 x 32 (p)."""
    low = lambda n: product(cosine_rows(32, 8), resampling(n, 32))
    return {"a": (resampling(h, 8), resampling(w, 8)), "d": (resampling(h, 8), resampling(w, 9)), "p": (low(h), low(w))}


def grid_hashes(records: DataFrame, values: str = "values", h: int = 8, w: int = 8) -> DataFrame:
    """Adds <hash>_lo and <hash>_hi of grids of h rows of w. a: value above the mean; d: value above its left neighbour; p:
    coefficient above the median of all but the first, whose bit is 0. See hash_maps() for the sizes."""

    mapped = lambda v, left, right: sandwich(v, left, right, h, w)
    maps = hash_maps(h, w)
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x) / 64
    rising = F.array(*[F.lit(9 * y + x) for y in range(8) for x in range(8)])
    middle = lambda t: F.get(F.sort_array(F.slice(t, 2, 63)), F.lit(31))

    def bits(v: Column) -> Column:
        a = let(mapped(v, *maps["a"]), lambda g: let(mean(g), lambda m: F.transform(g, lambda x: x > m)))
        d = let(mapped(v, *maps["d"]), lambda g: F.transform(rising, lambda k: F.get(g, k + 1) > F.get(g, k)))
        p = let(mapped(v, *maps["p"]), lambda g: let(middle(g), lambda m: F.transform(g, lambda x, k: (k > 0) & (x > m))))
        return F.struct(a.alias("a"), d.alias("d"), p.alias("p"))

    df = records.withColumn("_bits", let(F.transform(values, lambda x: x.cast("double")), bits))
    out = {f"{x}_{part}": c for x in HASHES for part, c in pack(f"_bits.{x}").items()}
    return df.withColumns(out).drop("_bits")


def distance(h: str, a: str = "l", b: str = "r") -> Column:
    return (F.bit_count(F.col(f"{a}.{h}_lo").bitwiseXOR(F.col(f"{b}.{h}_lo"))) + F.bit_count(F.col(f"{a}.{h}_hi").bitwiseXOR(F.col(f"{b}.{h}_hi")))).cast("int")


_PAIR = "(l.split < r.split OR (l.split = r.split AND l.id < r.id))"


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("l.split").alias("split_a"), F.col("l.id").alias("id_a"), F.col("r.split").alias("split_b"), F.col("r.id").alias("id_b"), *[distance(h).alias(f"d_{h}") for h in HASHES])


#: Bands that must agree for two hashes to meet.
AGREE = 3


def bands(most: int, agree: int = AGREE) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(first bit, bits) of the most + agree bands of a hash, and all choices of `agree` of them. Hashes that differ in `most` bits
    differ in at most so many bands, so at least one choice has all its bands equal."""
    n = most + agree
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], [list(c) for c in itertools.combinations(range(n), agree)]


#: Nodes that a key has on average at most when pairs are compared as arrays, and choices of bands at most.
FEW, MOST_AGREE = 1 << 14, 6
#: The two hashes whose bands are keys: of two rows with two close hashes one of these is close.
KEYED = ("a", "p")


def agreeing(n: int, most: int) -> int:
    """How many bands have to agree for a key to have about log2(n) bits, so that it has about one of n hashes."""
    agree = 1
    while agree < MOST_AGREE and 64 * agree / (most + agree) < math.log2(max(n, 2)):
        agree += 1
    return agree


def keyed(hashes: DataFrame, most: int, agree: int) -> DataFrame:
    """_n, key: the keys of the first and the second hash, see bands(). Only row numbers travel with the keys."""
    cut, chosen = bands(most, agree)
    parts = hashes.select("_n", *[F.array(*[hamming.bits_of(F.col(f"{h}_lo"), F.col(f"{h}_hi"), *band) for band in cut]).alias(h) for h in ("a", "d")])

    def keys(h: str) -> Column:
        return F.transform(F.array(*[F.lit(c) for c in chosen]), lambda c, k: F.xxhash64(F.lit(h), k, F.transform(c, lambda x: F.get(F.col(h), x))))

    return parts.select("_n", F.explode(F.concat(keys("a"), keys("d"))).alias("key"))


def _met(rows: DataFrame) -> DataFrame:
    l, r = rows.select(F.col("_n").alias("id_l"), "key"), rows.select(F.col("_n").alias("id_r"), "key")
    return l.join(r, "key").where("id_l < id_r").select("id_l", "id_r").distinct()


def candidates(hashes: DataFrame, most: int, agree: int = AGREE) -> DataFrame:
    """id_l, id_r (row numbers within `hashes`, with id_l before id_r) of the rows that share a key in the first or the second
    hash, each pair once."""
    return _met(keyed(hashes, most, agree))


def flagged(hashes: DataFrame, most: int = 8, agree: int | None = None) -> DataFrame:
    """Pairs of which at least two of three distances are at most `most`, found exactly by bands.

    Of such a pair one of two KEYED hashes is close, and of most + agree bands of a close hash `agree` are equal; by default as few as leave
    FEW nodes for a key, since many choices of bands make many keys and keys are what travels. Rows with equal hashes are one node, so
    copies meet no one: they are paired where pairs are returned. The nodes of a key are compared as arrays, in blocks, and only close ones are returned.
    """
    columns = [f"{h}_{part}" for h in HASHES for part in ("lo", "hi")]
    nodes = written(hashes.select(*columns).distinct().withColumn("_n", F.monotonically_increasing_id()), "nodes")
    rows = hashes.join(nodes, columns).select("split", "id", *columns, "_n")
    if agree is None:
        agree = agreeing(nodes.count() // FEW, most)
    links = written(_close(nodes, most, agree), "links")
    both = links.union(links.select("id_r", "id_l")).union(nodes.select(F.col("_n"), F.col("_n")))
    l, r = rows.alias("l"), rows.alias("r")
    return _named(l.join(both, F.col("l._n") == F.col("id_l")).join(r, (F.col("id_r") == F.col("r._n")) & F.expr(_PAIR)))


#: Bits of a key that its bands take; its choice of bands stands above them.
_SHIFT = 40


def _close(nodes: DataFrame, most: int, agree: int) -> DataFrame:
    """id_l, id_r of the close nodes, each pair once: by the first key that it shares."""
    cut, chosen = bands(most, agree)
    word = lambda h: F.shiftleft(f"{h}_hi", 32).bitwiseOR(F.col(f"{h}_lo"))
    first = [[0, *itertools.accumulate(cut[b][1] for b in c)] for c in chosen]

    def key(h: str, k: int) -> Column:
        parts = [F.shiftleft(hamming.bits_of(F.col(f"{h}_lo"), F.col(f"{h}_hi"), *cut[b]), at) for b, at in zip(chosen[k % len(chosen)], first[k % len(chosen)])]
        return sum(parts, F.lit(k << _SHIFT).cast("long"))

    keys = F.array(*[key(h, k + n * len(chosen)) for n, h in enumerate(KEYED) for k in range(len(chosen))])
    keyed = nodes.select("_n", *[word(h).alias(h) for h in HASHES], F.explode(keys).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
    parts = F.ceil(F.col("_m") / hamming.PART).cast("int")
    x = keyed.join(counts, "key").withColumn("_p", parts).withColumn("_k", F.pmod(F.xxhash64("_n"), F.col("_p").cast("long")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    x = x.select("key", F.least("_k", "_o").alias("i"), F.greatest("_k", "_o").alias("j"), "_k", "_n", *HASHES)

    def find(t: pa.Table) -> pa.Table:
        k, same = t["key"][0].as_py() >> _SHIFT, t["i"][0].as_py() == t["j"][0].as_py()
        h, c = KEYED[k // len(chosen)], chosen[k % len(chosen)]
        left = t["_k"].to_numpy() == t["i"][0].as_py()
        u, v = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        n, w = t["_n"].to_numpy(), {x: t[x].to_numpy().view(np.uint64) for x in HASHES}
        near = lambda x, p, q: np.bitwise_count(w[x][p] ^ w[x][q]) <= most
        out, step = [np.zeros((2, 0), np.int64)], max(1, hamming.WORDS // max(1, len(v)))
        for at in range(0, len(u) if len(v) else 0, step):
            r, o = np.nonzero(near(h, u[at : at + step, None], v))
            p, q = u[r + at], v[o]
            p, q = (z[n[p] < n[q]] for z in (p, q)) if same else (p, q)
            good = np.sum([near(x, p, q) for x in HASHES], axis=0) >= 2
            if h != KEYED[0]:
                good &= ~near(KEYED[0], p, q)
            p, q = p[good], q[good]
            unlike = w[h][p] ^ w[h][q]
            equal = [(unlike >> np.uint64(b)) & np.uint64((1 << size) - 1) == 0 for b, size in cut[: c[-1] + 1]]
            once = np.sum(equal, axis=0) == agree  # no choice before this one agrees
            out.append(np.stack([n[p[once]], n[q[once]]]))
        found = np.sort(np.concatenate(out, axis=1), axis=0)
        return pa.table([pa.array(found[0]), pa.array(found[1])], ["id_l", "id_r"])

    return x.groupBy("key", "i", "j").applyInArrow(find, "id_l long, id_r long")


def flagged_all_pairs(hashes: DataFrame, most: int = 8) -> DataFrame:
    """The same by comparing all pairs: the definition, for small audits."""
    l, r = hashes.alias("l"), hashes.alias("r")
    close = sum(((distance(h) <= most).cast("int") for h in HASHES[1:]), (distance("a") <= most).cast("int")) >= 2
    return _named(l.join(r, F.expr(_PAIR) & close))


def nearest(hashes: DataFrame, h: str) -> DataFrame:
    """split_a, id_a, split_b, d: the least distance of each row to rows of each split, itself excluded; see hamming.py."""
    return hamming.nearest(hashes, h)


def nearest_summary(near: DataFrame) -> DataFrame:
    """min, p01, p05, median and counts within 2, 6, 10 for each ordered pair of splits."""
    v = F.col("d").cast("double")
    return near.where("d IS NOT NULL").groupBy("split_a", "split_b").agg(F.min(v).alias("min"), F.percentile(v, F.lit(0.01)).alias("p01"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.5)).alias("median"), *[F.count_if(F.col("d") <= k).alias(f"n_le_{k}") for k in (2, 6, 10)])


def closest(hashes: DataFrame, k: int = 50) -> DataFrame:
    """The k pairs of least summed distance of each two different splits; ties by ids; see hamming.py."""
    return hamming.closest(hashes, HASHES, k)


def collision_matrix(pairs: DataFrame) -> DataFrame:
    """split_a, split_b, n: rows of a with at least one flagged partner in b, both ways."""
    one = pairs.select("split_a", "id_a", "split_b")
    two = pairs.select(F.col("split_b").alias("split_a"), F.col("id_b").alias("id_a"), F.col("split_a").alias("split_b"))
    return one.unionByName(two).distinct().groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def exact_groups(items: DataFrame, content: str = "content_hash") -> DataFrame:
    """content, n, splits (sorted distinct), first_id: groups of two or more items of the same content; members() has the items."""
    g = items.groupBy(content).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("split")).alias("splits"), F.min("id").alias("first_id"))
    return g.where("n > 1")


def members(items: DataFrame, groups: DataFrame, content: str = "content_hash") -> DataFrame:
    """content, split, id: the items of the groups, a row each, so that no group is gathered in one row."""
    return items.join(groups.select(content), content).select(content, "split", "id")


def by_location(groups: DataFrame) -> DataFrame:
    """location ("within A", or "A <-> B"), n_groups, most groups first; a row for each set of splits."""
    where = F.when(F.size("splits") == 1, F.concat(F.lit("within "), F.get("splits", F.lit(0)))).otherwise(F.array_join("splits", " <-> "))
    return groups.groupBy(where.alias("location")).agg(F.count("*").alias("n_groups")).orderBy(F.desc("n_groups"), "location")


def findings(locations: DataFrame, summary: DataFrame) -> DataFrame:
    """kind (exact, subset, overlap), place, value: only what needs no threshold of likeness."""
    exact = locations.select(F.lit("exact").alias("kind"), F.col("location").alias("place"), F.col("n_groups").cast("double").alias("value"))
    near = summary.where("split_a <> split_b AND median <= 10").select(F.when(F.col("median") <= 2, "subset").otherwise("overlap").alias("kind"), F.concat("split_a", F.lit(" -> "), "split_b").alias("place"), F.col("median").alias("value"))
    return exact.unionByName(near)


def selection_leakage(groups: DataFrame, summary: DataFrame, splits: DataFrame, train: str, held: str) -> DataFrame:
    """status (absent, blocking, report), n_exact, median, lowest_other, closest: whether the held-out split shares content with training."""
    here = splits.select("split").distinct().agg((F.count_if(F.col("split") == train) > 0).alias("t"), (F.count_if(F.col("split") == held) > 0).alias("h"))
    exact = groups.where(F.array_contains("splits", train) & F.array_contains("splits", held)).agg(F.count("*").alias("n_exact"))
    to = summary.where((F.col("split_b") == train) & (F.col("split_a") != train))
    med = to.agg(F.max(F.when(F.col("split_a") == held, F.col("median"))).alias("median"), F.min(F.when(F.col("split_a") != held, F.col("median"))).alias("lowest_other"))
    x = here.join(exact).join(med)  # one row each
    status = F.when(~(F.col("t") & F.col("h")), "absent").when(F.col("n_exact") > 0, "blocking").otherwise("report")
    return x.select(status.alias("status"), "n_exact", "median", "lowest_other", (F.col("median") < F.col("lowest_other")).alias("closest"))
