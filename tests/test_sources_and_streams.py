import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import pool
from tidegauge.operators import layout, paired, records
from tidegauge.sources import config, files, runs, schemas
from tidegauge.streaming.tail_state import TailSettings, tail_stream


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    d = np.clip(rng.normal(0.3, 0.15, 16 * 60), 0, 1)
    rows = [("k", i, float(x)) for i, x in enumerate(d)]
    for part in range(3):
        spark.createDataFrame(rows[part * 320 : part * 320 + 320], "g string, i long, d double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    s = TailSettings(keep=512, least=128)

    def run():
        stream = spark.readStream.schema("g string, i long, d double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = tail_stream(stream, "g", "i", "d", s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    run()
    more = np.clip(rng.normal(0.3, 0.15, 320), 0, 1)
    spark.createDataFrame([("k", 960 + i, float(x)) for i, x in enumerate(more)], "g string, i long, d double").coalesce(1).write.parquet(str(tmp_path / "in" / "p3"))
    run()
    got = {r.batch: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = [("k", i // 16, float(x)) for i, x in enumerate(np.concatenate([d, more]))]
    want = {r.batch: r for r in pool.pool_values(spark.createDataFrame(every, "g string, batch long, d double"), "g").collect()}
    assert len(got) == 80
    for b, w in want.items():
        assert got[b].u == pytest.approx(w.u) and (got[b].n_live, got[b].n_pool, got[b].active) == (w.n_live, w.n_pool, w.active)
        assert got[b].value == pytest.approx(w.value) if w.value is not None else got[b].value is None


def test_manifest_round_trip(spark, tmp_path):
    rows = [("s", f"x{k}", "i", "m", "1", "2", "3", "4", (4, 3), (4, 3), "RGB", "L", 0.5) for k in range(3)]
    df = spark.createDataFrame(rows, schemas.MANIFEST_ITEM)
    files.write_manifest(df, str(tmp_path / "m"), "root")
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, df.collect()))


def test_file_index_and_checksums(spark, tmp_path):
    (tmp_path / "t" / "a").mkdir(parents=True)
    for name in ("x.PNG", "y.png", "x.jpg", "z.txt"):
        (tmp_path / "t" / "a" / name).write_bytes(name.encode())
    f = files.index(spark, str(tmp_path / "t"), (".png", ".jpg"))
    assert sorted(r.stem for r in f.collect()) == ["x", "x", "y"]
    assert files.duplicate_stems(f).first()["stem"] == "x"
    files.write_checksums(f, str(tmp_path / "sums"))
    assert files.read_checksums(spark, str(tmp_path / "sums")).count() == 3


def test_runs_and_missing(spark, tmp_path):
    r = spark.createDataFrame([("a", 0, "d", "s", 0.5), ("b", 1, "d", "s", 0.6)], schemas.RUNS)
    files.write_runs(r, str(tmp_path / "runs"))
    back = files.read_runs(spark, str(tmp_path / "runs"))
    assert back.count() == 2
    want = spark.createDataFrame([("a", 0), ("a", 1)], "arm string, seed int")
    assert [tuple(x) for x in files.missing_runs(back, want).collect()] == [("a", 1)]


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("tail: {p: 0.2}\nseed: 3\n")
    (tmp_path / "top.yaml").write_text("_base: base.yaml\ntail: {alpha: 0.05}\n")
    c = config.load(str(tmp_path / "top.yaml"))
    assert (c.tail.p, c.tail.alpha, c.seed) == (0.2, 0.05, 3)
    c = config.override(c, ["tail.cap=0.5", "seed=4"])
    assert c.tail.cap == 0.5 and config.override(c, ["tail.cap=null"]).tail.cap is None
    with pytest.raises(KeyError):
        config.override(c, ["tail.nothing=1"])
    with pytest.raises(ValueError):
        config.override(c, ["tail.mode=odd"])


@pytest.mark.parametrize("mode, cap", [("cvar", None), ("ohem", None), ("gpd", 0.05)])
def test_stream_modes_equal_batch(spark, tmp_path, mode, cap):
    rng = np.random.default_rng(3)
    d = np.clip(rng.normal(0.3, 0.15, 16 * 40), 0, 1)
    spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(d)], "g string, i long, d double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, i long, d double").parquet(str(tmp_path / "in"))
    tail_stream(stream, "g", "i", "d", TailSettings(mode=mode, cap=cap)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.batch: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = spark.createDataFrame([("k", i // 16, float(x)) for i, x in enumerate(d)], "g string, batch long, d double")
    want = {r.batch: r for r in pool.pool_values(rows, "g", mode=mode, cap=cap).collect()}
    assert len(got) == 40 and sum(r.active for r in want.values()) > 10
    for b, w in want.items():
        assert got[b].active == w.active and (got[b].value == pytest.approx(w.value) if w.value is not None else got[b].value is None)


def test_stream_needs_a_known_mode(spark):
    from tidegauge.streaming.tail_state import pool_value

    with pytest.raises(ValueError):
        pool_value(np.array([0.1, 0.2]), TailSettings(mode="odd"))
    with pytest.raises(ValueError):
        pool.pool_values(spark.createDataFrame([("k", 0, 0.1)], "g string, batch long, d double"), "g", mode="odd")


def summary(dice):
    return {"run": "x", "seed": 0, "model": "m", "params": 5, "wall_clock_seconds": 1.5, "selected": "last", "per_split": {"T/one": {"dice": dice, "hd95": float("nan"), "n": 2}}, "pooled_external": None}


def test_runs_from_json_documents(spark, tmp_path):
    for arm, base in (("a0", 0.5), ("a1", 0.6)):
        for seed in (0, 1, 2):
            folder = tmp_path / "runs" / arm / f"seed{seed}"
            folder.mkdir(parents=True)
            (folder / "results.json").write_text(json.dumps(summary(base + seed / 100), indent=2))
            (folder / "per_image_metrics.json").write_text(json.dumps({"T/one": [{"stem": f"s{k}", "dice": base + seed / 100 + k / 10, "hd95": float("nan"), "tp": 3} for k in range(3)]}))
    path = str(tmp_path / "runs")
    got = {(r.arm, r.seed, r.metric): r.value for r in runs.read_summaries(spark, path).collect()}
    assert len(got) == 18 and got["a1", 2, "dice"] == 0.62 and got["a0", 0, "hd95"] is None
    assert {(r.arm, r.params) for r in runs.read_meta(spark, path).collect()} == {("a0", 5), ("a1", 5)}
    both = runs.load_arms(spark, path, ("a0", "a1"), [0, 1, 2])
    assert both.count() == 18 and both.where("arm = 'b' AND seed = 1 AND stem = 's2'").first().value == pytest.approx(0.81)
    c = paired.compare(both, n_boot=200).first()
    assert c["mean"] == pytest.approx(0.1) and c.degenerate and not c.excludes_zero
    assert c.image_bootstrap_lo == pytest.approx(0.1) and c.hierarchical_hi == pytest.approx(0.1)
    with pytest.raises(FileNotFoundError):
        runs.load_arms(spark, path, ("a0", "a1"), [0, 3])
    runs.write_summaries(runs.read_summaries(spark, path), str(tmp_path / "again"))
    back = {(r.arm, r.seed, r.metric): r.value for r in runs.read_summaries(spark, str(tmp_path / "again")).where("value IS NOT NULL").collect()}
    assert back == {k: v for k, v in got.items() if v is not None}
    checked = records.rescored(runs.read_summaries(spark, path), runs.read_summaries(spark, path).withColumn("value", F.col("value") + F.when(F.col("arm") == "a1", 1e-3).otherwise(1e-9)), ["arm", "seed", "dataset", "metric"])
    assert {(r.arm, r.ok) for r in checked.where("metric = 'dice'").collect()} == {("a0", True), ("a1", False)}


def test_layout_of_a_tree(spark, tmp_path):
    def put(split, side, *names):
        (tmp_path / split / side).mkdir(parents=True, exist_ok=True)
        for n in names:
            (tmp_path / split / side / n).write_bytes(b"x")

    put("Train", "images", *[f"{k}.png" for k in range(1, 21) if not 5 <= k <= 7], "30.jpg")
    put("Train", "masks", *[f"{k}.png" for k in range(1, 21) if not 5 <= k <= 7], "31.png")
    put("One", "images", "a.png", "a.jpg", "b.bmp", ".hidden")
    put("One", "gt", "a.png", "b.png")
    put("Two", "images", "a.png")
    put("Two", "masks", "a.png")
    put("Two", "gt", "b.png")
    put("Three", "images", "a.png")
    put("Kvasir-SEG", "images", "k.png")
    put("Kvasir-SEG", "masks", "k.png")
    files_ = files.layout_files(spark, str(tmp_path))
    expected = layout.Expected({"Train": 20, "One": 2, "Two": 1, "Three": 1, "Kvasir": 1}, training="Train", composition={"Train": {"numbers": 17}})
    got = {(r.severity, r.split, r.kind): (r.n, r.examples) for r in layout.report(files_, expected).collect()}
    assert got[("error", "Train", "no_mask")] == (1, "30") and got[("error", "Train", "no_image")] == (1, "31")
    assert got[("error", "One", "duplicate_stem")] == (1, "a") and got[("warn", "One", "extension")] == (1, "b.bmp")
    assert got[("note", "One", "mask_folder")] == (1, "gt") and got[("error", "Two", "ambiguous_masks")] == (2, "gt,masks")
    assert got[("error", "Three", "missing_side")] == (1, "masks") and got[("error", "Kvasir", "renamed")] == (1, "Kvasir-SEG")
    assert got[("error", "Kvasir", "missing_split")][0] == 1 and got[("warn", "Train", "count")] == (3, "17 of 20") and ("warn", "Kvasir-SEG", "unknown_split") in got
    assert not layout.usable(layout.report(files_, expected))
    why = {(r.split, r.kind): (r.n, r.detail) for r in layout.explain(files_, expected).collect()}
    assert why["Train", "numbers: block"] == (3, "1-20") and why["Train", "names: numeric"] == (17, "numbers") and why["Train", "images"][0] == 18
    sized = spark.createDataFrame([("Two", "images", "a", ".png", 4, 3), ("Two", "masks", "a", ".png", 4, 4)], files_.schema)
    only = layout.Expected({"Two": 1})
    assert [(r.kind, r.examples) for r in layout.report(sized, only).collect()] == [("size", "a")]
    good = sized.withColumn("h", F.lit(3))
    assert layout.report(good, only).count() == 0 and layout.usable(layout.report(good, only))
    resplit = good.unionByName(good.withColumn("split", F.lit("Held")))
    parts = layout.Expected({"Two": 2}, training="Two", held_out="Held")
    assert {(r.severity, r.kind) for r in layout.report(resplit, parts).collect()} == {("note", "re_split")}
    more = layout.Expected({"Two": 5}, training="Two", held_out="Held")
    assert {(r.severity, r.kind, r.n) for r in layout.report(resplit, more).collect()} == {("warn", "count", 4), ("warn", "partition", 3)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "b", 0.25), (1, 0, "a", 0.1234567), (0, 5, "c", 1.0)], "epoch int, dataset_index int, stem string, deficit double")
    files.write_deficits(rows, str(tmp_path / "d"))
    lines = [x for f in sorted((tmp_path / "d").glob("*.csv")) for x in f.read_text().splitlines() if not x.startswith("epoch")]
    assert lines == ["0,5,c,1.000000", "1,0,a,0.123457", "1,1,b,0.250000"]
    for _ in range(2):
        files.append_metrics(rows.limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    files.write_pairs(rows, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 3
    files.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).columns == ["dataset_index", "deficit", "epoch", "stem"]
    assert files.markdown(rows.where("epoch = 0"), "t") == "## t\n\n| epoch | dataset_index | stem | deficit |\n|---|---|---|---|\n| 0 | 5 | c | +1.0000 |\n"
    files.write_markdown(rows.where("epoch = 0"), str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| 0 | 5 | c | +1.0000 |"]
    maps = spark.createDataFrame([("s", "a", [0.0, 0.5, 1.0])], "split string, stem string, prob array<double>")
    files.write_maps(maps, str(tmp_path / "maps"))
    assert bytes(spark.read.parquet(str(tmp_path / "maps")).first()["map"]) == bytes([0, 128, 255])


def test_images_and_mask_folders(spark, tmp_path):
    import struct
    import zlib

    def png(path, w, h, channels, data):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + data[y * w * channels : (y + 1) * w * channels] for y in range(h))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    (tmp_path / "t" / "s").mkdir(parents=True)
    png(tmp_path / "t" / "s" / "a.png", 3, 2, 3, bytes(range(18)))
    png(tmp_path / "t" / "s" / "b.png", 4, 4, 1, bytes(16))
    got = {r.stem: (r.split, r.w, r.h, r["mode"], len(r.pixel_sha256)) for r in files.images(spark, str(tmp_path / "t")).collect()}
    assert got == {"a": ("s", 3, 2, "RGB", 64), "b": ("s", 4, 4, "L", 64)}
    rows = [("p", "x", "masks", "1"), ("p", "x", "gt", "1"), ("q", "y", "gt", "1"), ("q", "y", "gts", "2"), ("r", "z", "gts", "1"), ("r", "z", "other", "1")]
    f = spark.createDataFrame(rows, "path string, base string, folder string, stem string")
    assert {r.base: (r.folder, r.status) for r in files.mask_folder(f).collect()} == {"x": ("masks", "note"), "y": ("gt", "ambiguous"), "z": ("gts", "ok")}


def test_records(spark):
    d = spark.createDataFrame([("x", k) for k in range(10)] + [("y", k) for k in range(3)], "split string, id long")
    with pytest.raises(KeyError, match="x.*y"):
        records.select_splits(d, ["x", "z"])
    b = records.record_batches(d.where("split = 'x'").select("id"), ["id"], 4).orderBy("batch", "place").collect()
    assert [(r.id, r.batch, r.place) for r in b] == [(k, k // 4, k % 4) for k in range(10)]
    one, two = ([r.id for r in records.record_batches(d.where("split = 'x'").select("id"), ["id"], 4, seed=1, epoch=e).orderBy("batch", "place").collect()] for e in (0, 1))
    assert sorted(one) == sorted(two) == list(range(10)) and one != two
    with pytest.raises(ValueError):
        records.combined_heads("h", "median")
    f = records.fixture(spark, 200, "v", seed=3, hard_frac=0.3, side=8)
    rows = f.collect()
    assert 35 < sum(r.hard for r in rows) < 85 and all(r.stem.startswith("v") and len(r["values"]) == 64 and 0 <= min(r["values"]) and max(r["values"]) <= 255 for r in rows)
    gap = lambda r: np.mean([v for v, g in zip(r["values"], r.gt) if g]) - np.mean([v for v, g in zip(r["values"], r.gt) if not g]) if any(r.gt) else None
    easy, hard = ([x for r in rows if r.hard == h and (x := gap(r)) is not None] for h in (False, True))
    assert np.mean(easy) > 60 and np.mean(hard) < 30 and f.orderBy("stem").collect() == records.fixture(spark, 200, "v", seed=3, hard_frac=0.3, side=8).orderBy("stem").collect()
    z = [r.z for r in spark.range(4000).select(records.normal(1, F.col("id")).alias("z")).collect()]
    assert abs(np.mean(z)) < 0.06 and abs(np.std(z) - 1) < 0.05
    names = {r.name: r.value for r in records.environment(spark, "/").collect()}
    assert names["spark"] == spark.version and names["commit"] == ""
    done, ran = {("a", 0)}, []

    def run(config, seed):
        ran.append((config, seed))
        if config == "bad":
            raise RuntimeError("no")

    jobs = [("a", 0), ("bad", 0), ("b", 1)]
    assert records.sweep(jobs, lambda *j: j in done, run) == [("a", 0, "skipped"), ("bad", 0, "RuntimeError: no"), ("b", 1, "done")]
    assert len(records.sweep(jobs, lambda *j: j in done, run, stop=True)) == 2
