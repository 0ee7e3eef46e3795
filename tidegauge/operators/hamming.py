"""Exact searches by the Hamming distance of 64-bit hashes: nearest rows in each split, closest pairs of each two splits.

Both searches look up keys where keys are cheaper than looking at everything, and look at everything in a grid of blocks elsewhere.

Keys: a hash is cut in m bands of about log2(n) bits, n the nodes of the split that is searched, so that a key has about one node however many
there are. In round k the bands are looked up with k of their bits flipped; after it all hashes within m * (k + 1) - 1 bits are known.
Before pairs are made the nodes of the keys are counted, so a key that many hashes share sends its rows to the grid, and
no search costs more than the grid.

Where keys pay for no split, nearest rows come from blocks of all nodes, each two blocks compared once for both sides, see _blocks().

Grid: blocks of at most PART nodes of both sides meet in one task each and are compared as arrays; of a block only what can still count is
returned. Tables with a row for each split, or for each two of them, are broadcast or come to the driver; their size is that of the number of splits.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.shared import written

#: Nodes of a block, and how many comparisons in the grid cost as much as one lookup.
PART, LOOKUP = 4096, 1 << 18
WORDS = 1 << 17  # comparisons that a task makes at once: they stay in a processor's cache
LEAST_BITS = 4


def bits_of(lo: Column, hi: Column, first: int, size: int) -> Column:
    """`size` bits, at most 32, of the hash (lo, hi) from the bit `first` on."""
    if first >= 32:
        out = F.shiftrightunsigned(hi, first - 32)
    else:
        out = F.shiftrightunsigned(lo, first)
        if first + size > 32:
            out = out.bitwiseOR(F.shiftleft(hi, 32 - first))
    return out.bitwiseAND((1 << size) - 1)


def cut(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of the bands of hashes of so many bits that are looked up among n nodes; no band crosses a multiple of 64."""
    words = bits // 64
    per = max(2, round(64 / max(LEAST_BITS, math.log2(max(n, 2)))))
    edges = [64 * k // per for k in range(per + 1)]
    return [(64 * w + a, b - a) for w in range(words) for a, b in zip(edges, edges[1:])]


def lookups(bands: list[tuple[int, int]], k: int) -> int:
    """Keys of one node with k flipped bits in one band each."""
    return sum(math.comb(size, k) for _, size in bands)


def rounds(n: int, bits: int = 64) -> int:
    """Rounds that cost less than n comparisons, all together."""
    bands, k, total = cut(n, bits), 0, 0
    while (more := lookups(bands, k)) and LOOKUP * (total + more) <= n:
        k, total = k + 1, total + more
    return k


def _flips(size: Column, sizes: set[int], k: int) -> Column:
    """All values of `size` bits of which k are set, as an array of longs."""
    out = F.array().cast("array<bigint>")
    for s in sorted(sizes):
        values = [sum(1 << x for x in chosen) for chosen in itertools.combinations(range(s), k)]
        out = F.when(size == s, F.from_json(F.lit(json.dumps(values)), "array<bigint>")).otherwise(out)
    return out


def _banded(layout: Column, layouts: dict[int, list[tuple[int, int]]], words: list[tuple[Column, Column]]) -> Column:
    """An array of structs band, size, bits of a hash of several words, by the layout of its split."""
    out = None
    for name, bands in layouts.items():
        x = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(size).alias("size"), bits_of(*words[first // 64], first % 64, size).alias("bits")) for k, (first, size) in enumerate(bands)])
        out = x if out is None else F.when(layout == name, x).otherwise(out)
    return out


def grid(left: DataFrame, right: DataFrame, key: str, find, schema: str) -> DataFrame:
    """find(left rows, right rows) for each block of both sides that share the key. Both sides come with a column `h` that deals
    their rows."""
    parts = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    sizes = parts(left, "_pl").join(parts(right, "_pr"), key)
    own = lambda n: F.pmod(F.col("h"), F.col(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = left.join(sizes, key).withColumn("_l", own("_pl")).withColumn("_r", all_of("_pr")).drop("_pl", "_pr", "h")
    r = right.join(sizes, key).withColumn("_r", own("_pr")).withColumn("_l", all_of("_pl")).drop("_pl", "_pr", "h")
    l, r = (x.select([F.col(c).alias(c) for c in x.columns]) for x in (l, r))  # both may come from one table
    return l.groupBy(key, "_l", "_r").cogroup(r.groupBy(key, "_l", "_r")).applyInArrow(find, schema)


def words(t: pa.Table, name: str) -> np.ndarray:
    """64-bit hashes from columns <name>_lo and <name>_hi."""
    return t[f"{name}_lo"].to_numpy().astype(np.uint64) | (t[f"{name}_hi"].to_numpy().astype(np.uint64) << np.uint64(32))


def nearest(hashes: DataFrame, h: str, work: list[int] | None = None) -> DataFrame:
    """split_a, id_a, split_b, d: the least distance of each row of (split, id, <h>_lo, <h>_hi) to rows of each split, itself excluded;
    NULL if there are none. work: gets the comparisons made by keys and by the grid.

    Rows with equal hashes of one split are one node.
    """
    lo, hi = f"{h}_lo", f"{h}_hi"
    nodes = written(hashes.groupBy("split", F.col(lo).alias("h_lo"), F.col(hi).alias("h_hi")).agg(F.count("*").alias("n")), "nodes")
    splits = {r["split"]: r["k"] for r in nodes.groupBy("split").agg(F.count("*").alias("k")).collect()}  # a row for each split
    sizes = nodes.sparkSession.createDataFrame([(s, k, len(cut(k)), rounds(k)) for s, k in splits.items()], f"split_b {nodes.schema['split'].dataType.simpleString()}, k long, layout int, rounds int")
    own = ["split_a", "h_lo", "h_hi", "split_b"]
    rows = hashes.select(F.col("split").alias("split_a"), F.col("id").alias("id_a"), F.col(lo).alias("h_lo"), F.col(hi).alias("h_hi"))
    if not any(rounds(k) for k in splits.values()):
        if work is not None:
            work += [0, sum(splits.values()) ** 2]
        return rows.join(_blocks(nodes, splits), ["split_a", "h_lo", "h_hi"]).select("split_a", "id_a", "split_b", "d")
    todo = nodes.withColumnRenamed("split", "split_a").crossJoin(F.broadcast(sizes))  # a row for each split
    done = None
    layouts = {len(cut(k)): cut(k) for k in splits.values()}
    band_sizes = {size for bands in layouts.values() for _, size in bands}
    top = max((rounds(k) for k in splits.values()), default=0)
    if top:
        target = nodes.withColumnRenamed("split", "split_b").join(F.broadcast(sizes), "split_b")
        keyed = target.select("split_b", F.col("h_lo").alias("lo_b"), F.col("h_hi").alias("hi_b"), F.explode(_banded(F.col("layout"), layouts, [(F.col("h_lo"), F.col("h_hi"))])).alias("x"))
        keyed = keyed.select("split_b", "lo_b", "hi_b", "x.band", "x.bits")
        keyed = written(keyed, "keys")
        counts = written(keyed.groupBy("split_b", "band", "bits").agg(F.count("*").alias("c")), "counts")
    compared, best = 0, None
    for k in range(top):
        some = todo.where(F.col("rounds") > k)
        asked = some.select(*own, "n", "k", F.explode(_banded(F.col("layout"), layouts, [(F.col("h_lo"), F.col("h_hi"))])).alias("x"))
        asked = asked.select(*own, "n", "k", "x.band", F.explode(F.transform(_flips(F.col("x.size"), band_sizes, k), lambda m: F.col("x.bits").bitwiseXOR(m))).alias("bits"))
        asked = written(asked.join(counts, ["split_b", "band", "bits"]), "asked")
        cheap = written(asked.groupBy(*own).agg(F.sum("c").alias("c"), F.first("k").alias("k")).select(*own, "c", (F.col("c") <= F.col("k")).alias("cheap")), "cheap")
        compared += cheap.where("cheap").agg(F.sum("c").alias("c")).first()["c"] or 0
        pairs = asked.join(cheap.where("cheap").select(*own), own).drop("c", "k").join(keyed, ["split_b", "band", "bits"])
        pairs = pairs.where("NOT (split_a = split_b AND h_lo = lo_b AND h_hi = hi_b AND n = 1)")
        found = pairs.groupBy(*own).agg(F.min(F.expr("bit_count(h_lo ^ lo_b) + bit_count(h_hi ^ hi_b)")).cast("int").alias("d"))
        best = written(found if best is None else found.unionByName(best).groupBy(*own).agg(F.min("d").alias("d")), "best")
        # Rows of expensive keys go to the grid; of the others those are done whose best is within what the rounds cover.
        todo = todo.join(cheap.where("NOT cheap").select(*own, F.lit(0).alias("_stop")), own, "left").withColumn("rounds", F.coalesce("_stop", "rounds")).drop("_stop")
        todo = written(todo.join(best, own, "left").where(F.expr(f"d IS NULL OR rounds <= {k} OR d >= layout * {k + 1}")).drop("d"), "todo")
        done = best.join(todo.select(*own), own, "left_anti")

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = words(a, "h"), words(b, "h")
        alone = a["alone"].to_numpy() if len(x) else np.zeros(0, bool)
        d = np.full(len(x), 255, np.uint8)
        step = max(1, WORDS // max(1, len(y)))
        for k in range(0, len(x) if len(y) else 0, step):
            z = x[k : k + step, None] ^ y
            c = np.bitwise_count(z)
            c[(z == 0) & alone[k : k + step, None]] = 255
            d[k : k + step] = c.min(1)
        return pa.table([*[a[c] for c in own], pa.array(d.astype(np.int32), mask=d == 255)], [*own, "d"])

    left = todo.select(*own, ((F.col("split_a") == F.col("split_b")) & (F.col("n") == 1)).alias("alone"), F.xxhash64("split_a", "h_lo", "h_hi").alias("h"))
    right = nodes.select(F.col("split").alias("split_b"), "h_lo", "h_hi", F.xxhash64("h_lo", "h_hi").alias("h"))
    kind = nodes.schema["split"].dataType.simpleString()
    rest = grid(left, right, "split_b", find, f"split_a {kind}, h_lo long, h_hi long, split_b {kind}, d int").groupBy(*own).agg(F.min("d").alias("d"))
    if work is not None:
        work += [compared, todo.agg(F.sum("k").alias("c")).first()["c"] or 0]
    rest = rest if done is None else rest.unionByName(done)
    return rows.join(rest, ["split_a", "h_lo", "h_hi"]).select("split_a", "id_a", "split_b", "d")


def _least(x: np.ndarray, s: np.ndarray, y: np.ndarray, t: np.ndarray, n: int, alone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The least distances of hashes x to those of y of each of n splits, and of y to x. s and t are the splits, in order. alone: x and
    y are the same, and these hashes don't count themselves."""
    to_y, to_x = np.full((len(x), n), 255, np.uint8), np.full((n, len(y)), 255, np.uint8)
    (names, first), (own, starts) = np.unique(t, return_index=True), np.unique(s, return_index=True)
    step = max(1, WORDS // max(1, len(y)))
    for k, a, b in zip(own, starts, [*starts[1:], len(x)]):
        for at in range(a, b, step):
            c = np.bitwise_count(x[at : min(at + step, b), None] ^ y)
            if alone is not None:
                z = np.flatnonzero(alone[at : at + len(c)])
                c[z, z + at] = 255
            to_y[at : at + len(c), names] = np.minimum.reduceat(c, first, axis=1)
            np.minimum(to_x[k], c.min(axis=0), out=to_x[k])
    return to_y, to_x.T


def _blocks(nodes: DataFrame, splits: dict) -> DataFrame:
    """split_a, h_lo, h_hi, split_b, d of all nodes by looking at all pairs. Nodes are dealt to parts of about 4 * PART, a row of bytes each, and
    each two parts meet once, in a task of their own, which returns a byte for each node and split."""
    names = [s for s in splits if s is not None]
    kind, n = nodes.schema["split"].dataType.simpleString(), len(names)
    codes = nodes.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], f"split {kind}, code int")  # a row for each split
    parts = max(1, -(-sum(splits[s] for s in names) // (4 * PART)))
    dealt = nodes.join(F.broadcast(codes), "split").select(F.pmod(F.xxhash64("code", "h_lo", "h_hi"), F.lit(parts).cast("long")).cast("int").alias("part"), "code", "h_lo", "h_hi", (F.col("n") == 1).alias("alone"))

    def pack(t: pa.Table) -> pa.Table:
        code = t["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        row = [code[order].astype(np.int32), words(t, "h")[order], t["alone"].to_numpy()[order]]
        return pa.table([t["part"].slice(0, 1), *[pa.array([v.tobytes()], pa.binary()) for v in row]], ["part", "code", "word", "alone"])

    packs = written(dealt.groupBy("part").applyInArrow(pack, "part int, code binary, word binary, alone binary"), "packs")
    read = lambda t, name, kind: np.frombuffer(t[name][0].as_py(), kind)

    def find(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["part", "d"])
        i, j = x["i"][0].as_py(), x["j"][0].as_py()
        both = _least(read(x, "word", np.uint64), read(x, "code", np.int32), read(y, "word", np.uint64), read(y, "code", np.int32), n, read(x, "alone", bool) if i == j else None)
        both = both[:1] if i == j else both
        return pa.table([pa.array([i, j][: len(both)], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in both], pa.binary())], ["part", "d"])

    def spread(x: pa.Table, y: pa.Table) -> pa.Table:
        code, word = read(x, "code", np.int32), read(x, "word", np.uint64)
        d = np.full(len(code) * n, 255, np.uint8)
        for v in y["d"]:
            np.minimum(d, np.frombuffer(v.as_buffer(), np.uint8), out=d)
        each = lambda v: pa.array(np.repeat(v, n))
        low, high = (word & np.uint64(0xFFFFFFFF)).astype(np.int64), (word >> np.uint64(32)).astype(np.int64)
        return pa.table([each(code), each(low), each(high), pa.array(np.tile(np.arange(n, dtype=np.int32), len(code))), pa.array(d.astype(np.int32), mask=d == 255)], ["a", "h_lo", "h_hi", "b", "d"])

    x = packs.select(F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.lit(parts - 1))).alias("j"), "code", "word", "alone")
    y = packs.select(F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), "code", "word", "alone")
    x, y = (t.select([F.col(c).alias(c) for c in t.columns]) for t in (x, y))  # both come from one table
    met = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(find, "part int, d binary")
    out = packs.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(spread, "a int, h_lo long, h_hi long, b int, d int")
    for side in ("a", "b"):
        out = out.join(F.broadcast(codes.select(F.col("code").alias(side), F.col("split").alias(f"split_{side}"))), side)
    return out.select("split_a", "h_lo", "h_hi", "split_b", "d")


def _first_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of nodes of each two splits that can hold the k closest pairs of rows: the least distance, then first ids."""
    w = Window.partitionBy("split_a", "split_b").orderBy("d_sum", F.get("ids_a", F.lit(0)), F.get("ids_b", F.lit(0)))
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def closest(hashes: DataFrame, names: tuple[str, ...], k: int, work: list[int] | None = None) -> DataFrame:
    """split_a, id_a, split_b, id_b, d_<name> of each hash and d_sum: the k pairs of rows of least summed distance of each two different
    splits; ties by ids. work: gets the comparisons made by keys and by the grid.

    Rows with equal hashes of one split are one node, of which the k smallest ids can count. Nodes that share a band give some pairs of
    each two splits, the k-th distance of which bounds the search: only keys, or pairs of the grid, that reach it are looked at, and a task
    of the grid lowers the bound as it finds closer pairs.
    """
    columns = [f"{n}_{part}" for n in names for part in ("lo", "hi")]
    w = Window.partitionBy("split", *columns).orderBy("id")
    few = hashes.select("split", "id", *columns).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    nodes = written(few.groupBy("split", *columns).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64(*columns)), "nodes")
    splits = {r["split"]: r["n"] for r in nodes.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row for each split
    bits = 64 * len(names)
    bands = cut(max(splits.values(), default=0), bits)
    side = lambda s: [F.col("split").alias(f"split_{s}"), "h", *[F.col(c).alias(f"{c}_{s}") for c in columns], F.col("ids").alias(f"ids_{s}")]
    a, b = nodes.select(*side("a")).withColumnRenamed("h", "h_a"), nodes.select(*side("b")).withColumnRenamed("h", "h_b")
    distances = {n: F.expr(f"bit_count({n}_lo_a ^ {n}_lo_b) + bit_count({n}_hi_a ^ {n}_hi_b)").cast("int") for n in names}

    def measured(pairs: DataFrame) -> DataFrame:
        x = pairs.withColumns({f"d_{n}": d for n, d in distances.items()})
        return x.select("split_a", "split_b", "ids_a", "ids_b", *[f"d_{n}" for n in names], sum((F.col(f"d_{n}") for n in names[1:]), F.col(f"d_{names[0]}")).alias("d_sum"))

    # Some pairs: of each band's value the nodes of the smallest hashes of each split, a few of each.
    pairs_of = [(F.col(f"{n}_lo"), F.col(f"{n}_hi")) for n in names]
    keyed = nodes.select("*", F.explode(_banded(F.lit(0), {0: bands}, pairs_of)).alias("x")).select("split", "h", *columns, "ids", "x.band", "x.bits")
    low = Window.partitionBy("band", "bits", "split").orderBy("h")
    some = written(keyed.withColumn("_k", F.row_number().over(low)).where("_k <= 3").drop("_k"), "some")
    near = some.select(*side("a"), "band", "bits").drop("h").join(some.select(*side("b"), "band", "bits").drop("h"), ["band", "bits"]).where("split_a < split_b")
    near = measured(near).dropDuplicates(["split_a", "split_b", "ids_a", "ids_b"])
    near = near.withColumn("m", F.size("ids_a") * F.size("ids_b"))
    order = Window.partitionBy("split_a", "split_b").orderBy("d_sum", F.get("ids_a", F.lit(0)), F.get("ids_b", F.lit(0)))
    near = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).withColumn("sum", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bound = near.groupBy("split_a", "split_b").agg(F.min(F.when(F.col("sum") >= k, F.col("d_sum"))).alias("bound"))
    known = {(r["split_a"], r["split_b"]): r["bound"] for r in bound.collect()}  # a row for each two splits
    plan = []
    for s, t in itertools.combinations(sorted(splits), 2):
        most = known.get((s, t))
        most = bits if most is None else most
        flips = most // len(bands)  # of the bands of two such hashes one differs in so many bits at most
        cost = sum(lookups(bands, j) for j in range(flips + 1)) if flips <= 8 else math.inf
        plan.append((s, t, int(most), flips if min(LOOKUP, 256) * cost <= splits[t] else -1))  # a grid of three hashes with rows made is slower
    kind = nodes.schema["split"].dataType.simpleString()
    plan = nodes.sparkSession.createDataFrame(plan, f"split_a {kind}, split_b {kind}, bound int, flips int")
    compared, found, dealt = 0, [], F.broadcast(plan.where("flips < 0").select("split_a", "split_b", "bound"))
    top = max((r["flips"] for r in plan.select("flips").distinct().collect()), default=-1)
    if top >= 0:
        target = written(keyed.select(F.col("split").alias("split_b"), "band", "bits", F.col("h").alias("h_b")), "keys")
        counts = written(target.groupBy("split_b", "band", "bits").agg(F.count("*").alias("c")), "counts")
        asked = keyed.select(F.col("split").alias("split_a"), "band", "bits", F.col("h").alias("h_a")).join(F.broadcast(plan.where("flips >= 0")), "split_a")
        size = F.get(F.array(*[F.lit(n) for _, n in bands]), F.col("band"))
        flips = F.flatten(F.array(*[F.when(F.col("flips") >= j, _flips(size, {n for _, n in bands}, j)).otherwise(F.array().cast("array<bigint>")) for j in range(top + 1)]))
        asked = asked.withColumn("flip", F.explode(flips)).select("split_a", "split_b", "bound", "h_a", "band", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
        asked = written(asked.join(counts, ["split_b", "band", "bits"]), "asked")
        # Two splits whose keys hold more pairs than the grid has go to the grid.
        each = written(asked.groupBy("split_a", "split_b").agg(F.sum("c").alias("c")), "each")
        dear = [(r["split_a"], r["split_b"]) for r in each.collect() if r["c"] > splits[r["split_a"]] * splits[r["split_b"]]]  # a row for each two splits
        dear = plan.join(nodes.sparkSession.createDataFrame(dear, f"split_a {kind}, split_b {kind}"), ["split_a", "split_b"]).select("split_a", "split_b", "bound")
        dealt = F.broadcast(plan.where("flips < 0").select("split_a", "split_b", "bound").unionByName(dear))
        asked = asked.join(F.broadcast(dear.select("split_a", "split_b")), ["split_a", "split_b"], "left_anti")
        compared = asked.agg(F.sum("c").alias("c")).first()["c"] or 0
        pairs = asked.drop("c").join(target, ["split_b", "band", "bits"]).select("split_a", "split_b", "bound", "h_a", "h_b").distinct()
        pairs = measured(pairs.join(a, ["split_a", "h_a"]).join(b, ["split_b", "h_b"]).withColumn("_bound", F.col("bound")))
        found.append(pairs)

    def find(x: pa.Table, y: pa.Table) -> pa.Table:
        names_out = ["split_a", "split_b", "ids_a", "ids_b", *[f"d_{n}" for n in names], "d_sum"]
        p, q = [words(x, n) for n in names], [words(y, n) for n in names]
        rank = lambda t: np.unique(np.array([v[0] for v in t["ids"].to_pylist()]), return_inverse=True)[1] if t.num_rows else np.zeros(0, np.int64)
        first_x, first_y = rank(x), rank(y)
        most = x["bound"][0].as_py() if x.num_rows else 0
        i, j, d = (np.zeros(0, np.int64) for _ in range(3))
        step = max(1, WORDS // max(1, len(first_y)))
        for s in range(0, len(first_x) if len(first_y) else 0, step):
            total = sum(np.bitwise_count(u[s : s + step, None] ^ v).astype(np.int16) for u, v in zip(p, q))
            r, c = np.nonzero(total <= most)
            i, j, d = np.r_[i, r + s], np.r_[j, c], np.r_[d, total[r, c]]
            order = np.lexsort((first_y[j], first_x[i], d))[:k]
            i, j, d = i[order], j[order], d[order]
            if len(d) == k:
                most = min(most, int(d[-1]))
        each = [np.bitwise_count(u[i] ^ v[j]).astype(np.int32) for u, v in zip(p, q)]
        columns = [x["split_a"].take(pa.array(i)), x["split_b"].take(pa.array(i)), x["ids"].take(pa.array(i)), y["ids"].take(pa.array(j))]
        return pa.table([*columns, *[pa.array(e) for e in each], pa.array(d.astype(np.int32))], names_out)

    id_kind = nodes.schema["ids"].dataType.simpleString()
    left = nodes.withColumnRenamed("split", "split_a").join(dealt, "split_a").withColumn("pair", F.to_json(F.struct("split_a", "split_b")))
    right = nodes.withColumnRenamed("split", "split_b").join(dealt, "split_b").withColumn("pair", F.to_json(F.struct("split_a", "split_b"))).drop("split_a", "split_b", "bound")
    schema = f"split_a {kind}, split_b {kind}, ids_a {id_kind}, ids_b {id_kind}, {', '.join(f'd_{n} int' for n in names)}, d_sum int"
    found.append(grid(left, right, "pair", find, schema))
    if work is not None:
        work += [compared, sum(splits[r["split_a"]] * splits[r["split_b"]] for r in dealt.collect())]
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    pairs = _first_pairs(pairs, k).withColumn("id_a", F.explode("ids_a")).withColumn("id_b", F.explode("ids_b"))
    place = Window.partitionBy("split_a", "split_b").orderBy("d_sum", "id_a", "id_b")
    out = pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return out.select("split_a", "id_a", "split_b", "id_b", *[f"d_{n}" for n in names], "d_sum", "place")
