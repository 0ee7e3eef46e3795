"""Every text query that has a statement gives the same rows on DuckDB."""

import duckdb
import pytest

from tidegauge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    q = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda r: tuple(str(v) for v in r)
    assert sorted(text(r[n] for n in names) for r in df.collect()) == sorted(text(r) for r in q.fetchall())
