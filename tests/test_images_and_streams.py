"""Trees of images to manifests and audits; the estimator's stream: bounded triggers, state out and in, flushes."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import duplicates, layout, pool, records
from tidegauge.sources import files, images, schemas
from tidegauge.streaming.tail_state import TailProcessor, TailSettings, bounded, exported, tail_stream


def png(path, pixels):
    """Writes h x w (gray), h x w x 3 or h x w x 4 pixels."""
    path.parent.mkdir(parents=True, exist_ok=True)
    h, w = pixels.shape[:2]
    kind = {2: 0, 3: 2 if pixels.shape[-1] == 3 else 6}[pixels.ndim]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def gray(x):
    return x if x.ndim == 2 else ((x[..., 0].astype(int) * 19595 + x[..., 1].astype(int) * 38470 + x[..., 2].astype(int) * 7471 + 32768) >> 16).astype(np.uint8)


@pytest.fixture
def tree(tmp_path):
    """Two splits, one two folders deep; gray, RGB and RGBA images, masks of 0/255, 0/1 and in colour; a copy across splits."""
    rng = np.random.default_rng(4)
    made = {}
    for split, n in (("Train", 4), ("Test/Fake", 3)):
        for k in range(n):
            h, w = 40 + k, 50 - k
            image = rng.integers(0, 256, (h, w) if k == 1 else (h, w, 4 if k == 2 else 3)).astype(np.uint8)
            if split == "Test/Fake" and k == 0:
                image = made["Train", "x0"][0]
            mask = (rng.random((h, w)) < 0.3).astype(np.uint8) * (1 if k == 1 else 255)
            if k == 2:
                mask = np.repeat(mask[..., None], 3, axis=2)
            made[split, f"x{k}"] = image, mask
            png(tmp_path / "root" / split / "images" / f"x{k}.png", image)
            png(tmp_path / "root" / split / ("masks" if split == "Train" else "gt") / f"x{k}.png", mask)
    return tmp_path / "root", made


def test_manifest_of_a_tree_has_the_digests_of_its_pixels(spark, tree):
    root, made = tree
    items = images.manifest_items(spark, str(root), ["Train", "Test/Fake"])
    assert items.schema.names == schemas.MANIFEST_ITEM.names
    got = {(r.split, r.stem): r for r in items.collect()}
    assert set(got) == set(made)
    for (split, stem), (image, mask) in made.items():
        r = got[split, stem]
        colour = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]
        assert r.image_pixel_sha256 == hashlib.sha256(np.ascontiguousarray(colour).tobytes()).hexdigest()
        assert r.mask_pixel_sha256 == hashlib.sha256(gray(mask).tobytes()).hexdigest()
        assert r.image == f"{split}/images/{stem}.png" and r.mask == f"{split}/{'masks' if split == 'Train' else 'gt'}/{stem}.png"
        assert r.image_sha256 == hashlib.sha256((root / r.image).read_bytes()).hexdigest() and r.mask_sha256 == hashlib.sha256((root / r.mask).read_bytes()).hexdigest()
        assert tuple(r.image_size) == tuple(r.mask_size) == image.shape[1::-1] and (r.image_mode, r.mask_mode) == tuple({2: "L", 3: "RGB"}.get(x.ndim + (x.ndim == 3 and x.shape[-1] == 4), "RGBA") for x in (image, mask))
        assert r.mask_positive_frac == pytest.approx((gray(mask) > 0).mean())


def test_errors_of_a_manifest(spark, tree, tmp_path):
    root, made = tree
    build = lambda **k: images.manifest_items(spark, str(root), ["Train"], **k)
    mask = root / "Train" / "masks" / "x0.png"
    good = mask.read_bytes()
    mask.write_bytes(b"not an image")
    with pytest.raises(ValueError, match="can't be read: Train/x0"):
        build()
    png(mask, np.zeros((3, 3), np.uint8))
    with pytest.raises(ValueError, match="different sizes: Train/x0"):
        build()
    assert build(strict_sizes=False).count() == 4
    mask.unlink()
    with pytest.raises(ValueError, match="without a mask: Train/x0"):
        build()
    mask.write_bytes(good)
    (root / "Train" / "masks" / "x9.png").write_bytes(good)
    with pytest.raises(ValueError, match="without an image: Train/x9"):
        build()
    (root / "Train" / "masks" / "x9.png").unlink()
    (root / "Train" / "images" / "x1.bmp").write_bytes(good)
    with pytest.raises(ValueError, match="twice among images: Train/x1"):
        build()
    (root / "Train" / "images" / "x1.bmp").unlink()
    png(root / "Train" / "gts" / "other.png", np.zeros((3, 3), np.uint8))
    with pytest.raises(ValueError, match="differ"):
        build()
    with pytest.raises(FileNotFoundError, match="Nowhere"):
        images.manifest_items(spark, str(root), ["Test/Fake", "Nowhere"])


def test_layout_reports_files_that_cannot_be_read(spark, tree):
    root, _ = tree
    (root / "Train" / "images" / "x3.png").write_bytes(b"broken")
    png(root / "Train" / "masks" / "x2.png", np.zeros((3, 3), np.uint8))
    rows = images.layout_files(spark, str(root)).where("split = 'Train'")
    got = {(r.severity, r.kind): (r.n, r.examples) for r in layout.report(rows, layout.Expected({"Train": 4})).collect()}
    assert got == {("error", "unreadable"): (1, "x3"), ("error", "size"): (1, "x2")}


def test_resize_and_hashes_of_one_channel(spark, tree):
    flat = np.full((37, 53), 91, np.uint8)
    assert (images.resized(flat, 8, 9) == 91).all() and (images.resized(flat, 37, 53) == flat).all()
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (16, 1))
    small = images.resized(ramp, 8, 8)
    assert (np.diff(small.astype(int), axis=1) > 20).all() and (small == small[0]).all()
    up = images.resized(np.array([[0, 255], [255, 0]], np.uint8), 8, 8)
    assert up[0, 0] == 0 and up[0, 7] == 255
    x = np.random.default_rng(3).integers(0, 256, (48, 60)).astype(np.uint8)
    exact = np.array(duplicates.resampling(48, 8)) @ (x @ np.array(duplicates.resampling(60, 8)).T)
    assert np.abs(images.resized(x, 8, 8) - exact).max() < 1.5
    a, d, p = images.hash_bits(ramp)
    assert a.reshape(8, 8)[:, 4:].all() and not a.reshape(8, 8)[:, :4].any() and d.all() and not p[0] and p.sum() <= 32


def test_audit_from_a_tree_to_one_report(spark, tree, tmp_path):
    root, made = tree
    lighter = np.clip(made["Train", "x3"][0].astype(int) + 3, 0, 255).astype(np.uint8)  # a near copy within a split
    png(root / "Train" / "images" / "x8.png", lighter)
    png(root / "Train" / "masks" / "x8.png", made["Train", "x3"][1])
    items = images.manifest_items(spark, str(root), ["Train", "Test/Fake"])
    parts = images.audit(spark, str(root), items, k=3)
    pairs = {(r.split_a, r.id_a.split("/")[-1], r.split_b, r.id_b.split("/")[-1]) for r in parts["pairs"].collect()}
    assert pairs == {("Test/Fake", "x0.png", "Train", "x0.png"), ("Train", "x3.png", "Train", "x8.png")}
    assert [(r.n, r.splits) for r in parts["exact"].collect()] == [(2, ["Test/Fake", "Train"])]
    assert {(r.split_a, r.split_b): r.n for r in parts["matrix"].collect()} == {("Test/Fake", "Train"): 1, ("Train", "Test/Fake"): 1, ("Train", "Train"): 2}
    near = {(r.hash, r.split_a, r.split_b): r["min"] for r in parts["nearest"].collect()}
    assert len(near) == 12 and all(near[h, "Test/Fake", "Train"] == 0 for h in "adp")
    assert {r.split: r.n for r in parts["counts"].collect()} == {"Train": 5, "Test/Fake": 3} and parts["closest"].count() == 3
    images.write_audit(parts, str(tmp_path / "report"))
    (doc,) = [json.loads(line) for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()]
    assert set(doc) == set(parts) and len(doc["pairs"]) == 2 and doc["counts"] == [{"split": "Test/Fake", "n": 3}, {"split": "Train", "n": 5}]
    for name in duplicates.HASHES:  # the same bits as by hand
        row = images.hashes(images.decoded(spark, str(root))).where("split = 'Train' AND id LIKE '%images/x1.png'").first()
        bits = dict(zip(duplicates.HASHES, images.hash_bits(made["Train", "x1"][0])))[name]
        assert row[f"{name}_lo"] == sum(int(b) << k for k, b in enumerate(bits[:32])) and row[f"{name}_hi"] == sum(int(b) << k for k, b in enumerate(bits[32:]))


def fed(spark, folder, d, parts, key="k"):
    for part, rows in enumerate(np.array_split(np.arange(len(d)), parts)):
        spark.createDataFrame([(key, int(i), float(d[i])) for i in rows], "g string, i long, d double").coalesce(1).write.parquet(str(folder / f"p{part}"))


def ran(df, folder):
    df.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    return {r.batch: r for r in df.sparkSession.read.parquet(str(folder / "out")).collect()}


SCHEMA = "g string, i long, d double"


def test_a_stream_goes_on_from_exported_state(spark, tmp_path):
    d = np.clip(np.random.default_rng(6).normal(0.3, 0.15, 16 * 50 + 5), 0, 1)
    cut = 16 * 28 + 7  # within a batch
    for name, part in (("all", d), ("one", d[:cut]), ("two", d[cut:])):
        fed(spark, tmp_path / name / "in", part, 4)
    stream = lambda name: bounded(spark, str(tmp_path / name / "in"), SCHEMA)
    whole = ran(tail_stream(stream("all"), "g", "i", "d"), tmp_path / "all")
    first = ran(tail_stream(stream("one"), "g", "i", "d"), tmp_path / "one")
    state = exported(spark, str(tmp_path / "one" / "ck"))
    (row,) = state.collect()
    assert row.key == "k" and row.step == 28 and len(row.rest) == 7 and row.buffer == pytest.approx(d[: 16 * 28].tolist()[-512:])
    state.write.parquet(str(tmp_path / "state"))
    rest = ran(tail_stream(stream("two"), "g", "i", "d", initial=spark.read.parquet(str(tmp_path / "state"))), tmp_path / "two")
    assert sorted(first) == list(range(28)) and sorted(rest) == list(range(28, 50))
    for b, w in whole.items():
        got = (first | rest)[b]
        assert all((x is None and y is None) or x == pytest.approx(y) for x, y in zip(got, w)), b


class Held:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_trigger_is_held_in_pieces(spark):
    rng = np.random.default_rng(7)
    n, most = 40_000, 64
    d = np.clip(rng.normal(0.3, 0.15, n), 0, 1)
    order = np.argsort(np.arange(n) + rng.uniform(0, most / 2, n))  # rows come a little late
    whole, pieces = (TailProcessor(TailSettings(), "place", "value", r) for r in (None, most))
    whole.state, pieces.state = Held(), Held()
    alive, peak = [0], [0]

    class Counted(pd.DataFrame):
        def __del__(self):
            alive[0] -= 1

    def rows(size):
        for k in range(0, n, size):
            alive[0] += 1
            peak[0] = max(peak[0], alive[0])
            yield Counted({"place": order[k : k + size], "value": d[order[k : k + size]]})

    got = []
    for frame in pieces.handleInputRows(("k",), rows(500), None):
        assert len(frame) <= 500 // 16 + 5
        got.append(frame)
    assert peak[0] <= 3  # of 80 pieces
    want = pd.concat(whole.handleInputRows(("k",), iter([pd.DataFrame({"place": order, "value": d[order]})]), None))
    pd.testing.assert_frame_equal(pd.concat(got).reset_index(drop=True), want.reset_index(drop=True))
    assert pieces.state.value[:2] == whole.state.value[:2] and len(want) == n // 16


def test_bounded_triggers_give_the_same_results(spark, tmp_path):
    d = np.clip(np.random.default_rng(8).normal(0.3, 0.15, 16 * 60), 0, 1)
    fed(spark, tmp_path / "in", d, 6)
    q = tail_stream(bounded(spark, str(tmp_path / "in"), SCHEMA, 1), "g", "i", "d", reorder=200)
    got = ran(q, tmp_path)
    rows = spark.createDataFrame([("k", i // 16, float(x)) for i, x in enumerate(d)], "g string, batch long, d double")
    want = {r.batch: r for r in pool.pool_values(rows, "g").collect()}
    assert len(got) == 60 and len(list((tmp_path / "ck" / "commits").glob("[0-9]*"))) >= 6
    for b, w in want.items():
        assert (got[b].active, got[b].n_pool) == (w.active, w.n_pool) and (got[b].value is None if w.value is None else got[b].value == pytest.approx(w.value))


def test_flush_as_a_stream_equals_the_batch_and_survives_a_replay(spark, tmp_path):
    rng = np.random.default_rng(9)
    schema = "ts timestamp, active boolean, u double, shape double, shape_raw double, scale double, level double, clamped boolean, degenerate boolean"
    maybe = lambda: None if rng.random() < 0.2 else float(rng.random())
    calls = [(pd.Timestamp(1_700_000_000 + 7 * k, unit="s").to_pydatetime(), bool(rng.random() < 0.6), *[maybe() for _ in range(5)], bool(rng.random() < 0.3), False) for k in range(120)]
    for part in range(4):
        spark.createDataFrame(calls[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    df = spark.createDataFrame(calls, schema).withColumn("epoch", records.epoch_of("ts", 100))
    want = {r.epoch: r for r in records.epoch_flush(df, warmup_epochs=17_000_003, most_clamped=0.25).collect()}
    stream = records.epoch_flush_stream(bounded(spark, str(tmp_path / "in"), schema), 100, "30 seconds", warmup_epochs=17_000_003, most_clamped=0.25)
    write, seen = files.append_once(str(tmp_path / "out")), []

    def twice(rows, batch):  # every batch is replayed
        write(rows, batch)
        write(rows, batch)
        seen.append(batch)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.schema(stream.schema).json(str(tmp_path / "out")).collect()
    last = max(want)
    assert len(seen) > 3 and sorted(r.epoch for r in got) == sorted(e for e in want if (e + 1) * 100 <= 1_700_000_000 + 7 * 119 - 30) and last not in {r.epoch for r in got}
    for r in got:
        w = want[r.epoch].asDict()
        assert all(v == w[k] if v is None or isinstance(v, bool) else v == pytest.approx(w[k]) for k, v in r.asDict().items() if k != "batch_id")
    assert {r.rarely_active for r in got} <= {True, False}


def test_best_of_long_runs(spark):
    rng = np.random.default_rng(10)
    rows = [(r, k, None if rng.random() < 0.1 else float(rng.integers(0, 40))) for r in ("a", "b", None) for k in range(300)]
    df = spark.createDataFrame(rows, "run string, epoch int, score double").repartition(5)
    got = {(r.run, r.epoch): r.selected for r in records.best_so_far(df, "run", ["epoch"], "score").collect()}
    best = {}
    for run, k, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert got[run, k] == (v is not None and v > best.get(run, float("-inf")))
        best[run] = max(best.get(run, float("-inf")), float("-inf") if v is None else v)
    assert df.columns + ["selected"] == records.best_so_far(df, "run", ["epoch"], "score").columns
