"""Every stage of the pipeline on awkward rows and on an empty table."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_corpus import SCHEMA, awkward, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(awkward(), SCHEMA).repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(36)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, name, step):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = step(spark, docs, sf_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert set(out.columns) == set(corpus_pipeline.COLUMNS)
    assert out.count() <= 2 * docs.count()
    assert step(spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "ids"} <= set(out.columns)


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    texts = [
        (5, a), (None, a + " end"), (None, a),  # a null id gives way to a number
        (None, b), (None, b + " end"), (None, b),  # null ids alone: one stays
        (7, c), (7, c + " end"), (7, c),  # near texts of one id
        (8, d + " end"), (5, d),  # the id leads a class with another text too
        (None, None), (None, None), (9, ""), (10, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0, "") for i, t in texts], SCHEMA).repartition(4)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(i for i, t in out if t and i) == [5, 5, 7]
    assert (5, a) in out and (5, d) in out and (8, d + " end") not in out
    assert sum(i is None and bool(t) for i, t in out) == 1
    assert sorted(str(i) for i, t in out if not t) == ["10", "9", "None"]
