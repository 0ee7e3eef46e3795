"""Every query that has a statement gives the same rows on DuckDB; the driver's tables at the smallest size."""

import hashlib
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from tidegauge.functions import numeric
from tidegauge.operators import paired
from tidegauge.plans import catalog, extras, streams

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


QUERIES, STATEMENTS = catalog.queries() | extras.queries() | streams.queries(), catalog.oracle_sql() | extras.oracle_sql() | streams.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - {"image_bootstrap", "hierarchical_bootstrap"}))  # those against brute force below
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    q = duck.execute(STATEMENTS[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda r: tuple(str(v) for v in r)
    assert sorted(text(r[n] for n in names) for r in df.collect()) == sorted(text(r) for r in q.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/orders.parquet").where("o_totalprice > 1000 * 2 AND o_orderstatus = 'P'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,2000.0)" in plan and "o_orderpriority" not in plan


def test_scores_need_no_shuffle_of_cells(spark):
    plan = catalog.scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1  # the truth masks only


def test_entry_works_from_any_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; assert 'tail_report' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_works_without_the_text_operators(tmp_path):
    for gone in (("tidegauge/llm", "tests/llm"), ("tidegauge/llm", "tests/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
        for name in gone:
            shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'tail_report' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')] and set(e.oracle_sql()) <= set(q)"
        env = os.environ | {"PYTHONPATH": str(copy)}
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
        subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=env, check=True, timeout=120, stdout=subprocess.DEVNULL)


def test_entry_works_where_a_library_of_the_text_operators_is_missing(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tail_report' in q and 'pipeline' not in q and 'op1_near_dedup' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, check=True, timeout=120)


def test_bootstraps_equal_brute_force_over_10000_replicates(spark, monkeypatch):
    cells = {(d, a, s, f"x{k}"): (17 * k * k + 5 * s + (3 * k + 2) * (a == "b") + len(d)) % 23 / 23 for d in ("p", "qq") for a in "ab" for s in range(3) for k in range(5)}
    small = spark.createDataFrame([(*c, v) for c, v in cells.items()], "dataset string, arm string, seed int, stem string, value double")
    monkeypatch.setattr(catalog, "runs", lambda spark, sf_dir: small)

    def draws(n, *key):
        return [int(hashlib.md5("|".join(map(str, (0, *key, j))).encode()).hexdigest()[:8], 16) % n for j in range(n)]

    image, nested = {}, {}
    for d in ("p", "qq"):
        v = np.array([[cells[d, "b", s, f"x{k}"] - cells[d, "a", s, f"x{k}"] for k in range(5)] for s in range(3)])
        for out, reps in ((image, [v.mean(0)[draws(5, d, r)].mean() for r in range(10_000)]), (nested, [v[np.ix_(draws(3, "seed", d, r), draws(5, "stem", d, r))].mean() for r in range(10_000)])):
            out[d] = (5, *(pytest.approx(x, abs=2e-6) for x in (v.mean(), *np.quantile(reps, (0.025, 0.975)))))
    for stems, draws, reps in ((paired.STEMS, paired.DRAWS, paired.REPS), (2, 3, 700)):  # one block, and several
        for constant, value in (("STEMS", stems), ("DRAWS", draws), ("REPS", reps)):
            monkeypatch.setattr(paired, constant, value)
        for name, want in (("image_bootstrap", image), ("hierarchical_bootstrap", nested)):
            assert {r.dataset: (r.n, r["mean"], r.lo, r.hi) for r in catalog.queries()[name](spark, SF).collect()} == want


def test_md5_of_numbers_equals_the_library():
    for before in (b"", b"0|a|7|", b"x" * 50, b"y" * 63, b"z" * 120):
        n = np.array([0, 5, 9, 10, 99, 100, 4095, 123456, 10**12] * 60)
        assert numeric.md5_first(before, n).tolist() == [int.from_bytes(hashlib.md5(before + b"%d" % k).digest()[:4], "big") for k in n.tolist()]


def test_weights_do_not_gather_a_group_in_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["sensitivity_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [g" in plan and "SortMergeJoin [g" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_of_several_spans_gives_the_same_rows(spark, monkeypatch):
    whole = sorted(map(str, QUERIES["tail_stream"](spark, SF).collect()))
    monkeypatch.setattr(catalog, "TRIGGER", 400)
    df = QUERIES["tail_stream"](spark, SF)
    assert sorted(map(str, df.collect())) == whole and len(whole) > 20
    base = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert len([n for n in os.listdir(os.path.join(base, "_spark_metadata")) if n.isdigit()]) == 3
