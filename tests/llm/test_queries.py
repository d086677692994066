"""The registered queries: the SQL twins, the digest columns, and the pipeline."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from alleleloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark, docs, labels, tmp_path):
    docs.filter("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = rows
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, str(tmp_path))
        stage.write.parquet(f"{tmp_path}/stage{k}")
        stage = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert stage.dtypes == rows.dtypes
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, stage.collect()), key=str)


def test_stages_take_any_rows(spark, docs, labels, rows, tmp_path):
    """Null ids, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = {"row": "size", "__id": "doc_id", "__kept_text": "text", "n_bytes": "hash", "k1": "hash", "w1": "size", "score": "hash", "kept_text": "size", "part": "hash", "of": "size"}
    some = docs.select("doc_id", "text", "lang", "source", "n_chars", *[docs[c].alias(n) for n, c in odd.items()])
    stage = some
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, str(tmp_path))
        out.write.parquet(f"{tmp_path}/odd{k}")
        stage = spark.read.parquet(f"{tmp_path}/odd{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert stage.dtypes == some.dtypes
        assert stage.count()


def test_stages_take_no_rows(spark, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, stage, str(tmp_path)).count() == 0
