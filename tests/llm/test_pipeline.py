"""Every stage of the pipeline against a brute-force version, on the smallest tables and on rows with nulls, repeats and long texts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import bpe, toxicity
from tidegauge.llm.queries import toxicity_chain

from .test_ops import RANKS, decontaminate_brute, prose, shingle_set, without_repeats_brute

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def classes_brute(texts):
    """{id: smallest id of its class}: all pairs of texts that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label, of = {i: i for i in texts}, {}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in sets.items():
        for g in x:
            of.setdefault(g, []).append(i)
    for ids in of.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                if root(a) != root(b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: root(i) for i in texts}


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.schema, [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark, rows, benchmark):
    schema, all_ = rows
    docs = spark.createDataFrame(all_, schema)
    chain = toxicity_chain(spark, docs, SF)
    toxic = {r.doc_id: r.toxic for r in toxicity.predict(docs, chain).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(toxic[i] == bool(y) for i, y in labels.items()) >= 0.95 * len(labels)  # of 87 labelled documents only

    def step(name, docs, want):
        out = STAGE[name](spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want.items()), name
        before = {r.doc_id: r for r in docs.collect()}
        assert all(r.source == before[r.doc_id].source and r.n_chars == before[r.doc_id].n_chars for r in got), name
        return spark.createDataFrame(got, docs.schema), want

    texts = {i: t for i, t in ((r[0], r[1]) for r in all_)}
    docs, texts = step("toxicity", docs, {i: t for i, t in texts.items() if not toxic[i]})
    docs, texts = step("line_dedup", docs, without_repeats_brute(texts))
    class_of = classes_brute(texts)
    docs, texts = step("near_dedup", docs, {i: t for i, t in texts.items() if class_of[i] == i})
    bad = decontaminate_brute(texts, benchmark)
    assert bad
    docs, texts = step("decontamination", docs, {i: t for i, t in texts.items() if i not in bad})
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in STAGE["byte_bpe"](spark, docs, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: enc.encode_ordinary(t or "") for i, t in texts.items()}
    assert got == {i: (len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha((t or "").encode())) for i, t in texts.items()}


def test_stages_on_unusual_rows(spark, rows, benchmark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, ties, and columns with clashing names."""
    rng = random.Random(21)
    item = max((t for t in benchmark.values() if t), key=len)
    long = "\n".join(prose(rng, 12) for _ in range(14_000))
    base = [prose(rng, 40) for _ in range(3)]
    texts = [None, "", " \n\t", base[0], base[0], long, base[1] + "\n" + base[2], "start\n" + base[1] + "\n" + base[2] + "\nend", f"{base[2]} {item} {base[0]}", "x" * 1_000_000]
    made = [(i, t, None if i % 2 else "xx", None, i, None, i, "s", 0.5) for i, t in enumerate(texts)]
    made += [(None, base[1], None, None, None, None, None, None, None), (3, base[0], "xx", None, 3, None, 3, "s", 0.5), (20, base[2], "a", "b", 1, 1, 1, "t", 0.1), (20, base[2], "a", "b", 1, 1, 1, "t", 0.1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, node long, id string, p0 double"
    docs = spark.createDataFrame(made, schema).repartition(3)
    assert len(long) > 500_000
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == docs.columns, name
        if name in ("toxicity", "line_dedup"):
            assert len(got) == len(made), name
        elif name == "near_dedup":
            assert sorted((r.doc_id is not None, r.doc_id) for r in got if r.doc_id not in (6, 7)) == [(False, None)] + [(True, i) for i in (0, 3, 5, 8, 9, 20)]
        else:
            assert [r.doc_id for r in got if r.doc_id == 8] == [] and len(got) == len(made) - 1
        kept = {(r.doc_id, r.text) for r in got}
        assert name == "line_dedup" or kept <= {(r[0], r[1]) for r in made}
        assert (5, long) in kept
    last = STAGE["byte_bpe"](spark, docs, SF)
    assert last.count() == len(made) and last.where("n_tokens IS NULL").isEmpty() and STAGE["byte_bpe"](spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_in_order(spark, monkeypatch):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    seen = []

    def stage(name):
        return name, lambda spark, docs, sf_dir: seen.append((name, docs.count())) or docs.where(F.col("doc_id") % 7 != len(seen))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in "abc"])
    n = corpus_pipeline.run(spark, SF).count()
    assert [x for x, _ in seen] == ["a", "b", "c"] and seen[0][1] > seen[1][1] > seen[2][1] > n
