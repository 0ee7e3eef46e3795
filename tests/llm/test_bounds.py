"""Bounds of what reaches the driver or one task."""

from tidegauge.llm import chat, toxicity
from tidegauge.sources import shared


def test_one_text_stands_for_an_id_in_the_training_sample(spark):
    docs = spark.createDataFrame([(k % 5, f"word{k} text") for k in range(100)] + [(7, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    row, place, y, fold = toxicity.sample(docs, labels, ["toxic"], "doc_id", "text", 4)
    assert len(y) <= 4 and len(fold) == len(y)
    row, place, y, fold = toxicity.sample(docs, labels, ["toxic"], "doc_id", "text", 100)
    assert len(y) == 6 and set(row) <= set(range(6))


def test_rows_without_a_conversation_belong_to_no_tree(spark):
    rows = spark.createDataFrame([(None, k, "user", "x") for k in range(50)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    got = chat.from_turns(rows)
    assert sorted((r.tree, r.node, r.parent) for r in got.collect()) == [(1, 1, None), (1, 2, 1)] or got.count() == 2
    assert {r.tree for r in chat.conversations(got).collect()} == {1}


def test_a_scope_deletes_what_is_written_inside(spark, tmp_path):
    import os

    local = lambda p: p.removeprefix("file://")
    kept = shared.shared_dir(spark)
    with shared.scope(spark):
        inside = shared.shared_dir(spark)
        shared.written_to(spark.range(3), f"{inside}/x")
        out = shared.written_to(spark.read.parquet(f"{inside}/x"), f"{kept}/y")
        named = shared.shared_dir(spark)
        assert os.path.exists(local(inside))
    assert not os.path.exists(local(inside)) and out.count() == 3
    with shared.scope(spark, keep=(kept,)):
        again = shared.shared_dir(spark)
    assert out.count() == 3 and named not in shared._made and again not in shared._made
