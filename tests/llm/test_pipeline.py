import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from echolot.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def sf_dir(spark, tmp_path):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text, toxic = say(40), int(i % 4 == 0)
        rows.append((i, f"{text} moronic {say(9)}" if toxic else text))
        labels.append((i, 0, toxic))
    leak = say(30)
    rows += [(400, rows[1][1]), (401, rows[1][1] + " more"), (402, f"{say(5)} {leak.upper()} {say(5)}"), (403, f"{say(9)} call me.two@mail.example.com {say(9)}"), (404, say(60) + " moronic"), (405, ""), (406, None)]
    rows += [(405, ""), (None, say(12)), (None, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    assert 4 <= len(pipeline.STAGES) <= 5 and pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    gone = [{i for i in range(0, 300, 4)} | {404}, {400, 401}, {402}, set()]
    for (name, stage), lost in zip(pipeline.STAGES, gone):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
        assert docs.where("doc_id is null").count() == 2 and docs.where("doc_id = 405").count() == 2, name
        assert before.keys() - kept.keys() == lost, name
        if name == "pii":
            assert "<EMAIL>" in kept.pop(403) and before.pop(403) and kept == before
        before = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    assert {r.doc_id: r.n_chars for r in docs.where("doc_id is not null").collect()} == {i: None if t is None else len(t) for i, t in before.items()}
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    size = Counter()
    for x in packed:
        size[x.doc_id] += x.words
    assert size.pop(None) == 12 and size == {i: len(t.split()) for i, t in before.items() if t}


def test_run(spark, sf_dir):
    got = pipeline.run(spark, sf_dir).collect()
    assert {x.doc_id for x in got} == {i for i in range(300) if i % 4} | {403, None} and all(x.certified for x in got)


def test_stages_with_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as lost", "'x' as Score", "array(2) as bands", "3 as class_id", "4 as start", "cast(null as string) as none").limit(40)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and {(r.lost, r.Score, r.none) for r in kept.collect()} == {(1, "x", None)}, name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_on_no_documents(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = spark.createDataFrame([], SCHEMA)
    assert pii.masked("abc", [(0, 1, "X"), (0, 2, "Y")]) == "<X>bc"
