"""The registered text queries against their SQL, and the pipeline against its own rules."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from glucoframe.llm import queries
from glucoframe.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"



@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    engine.execute(f"CREATE TABLE wanted AS {SQL[name]}")
    got = queries.QUERIES[name](spark, FOLDER).toArrow()
    engine.register("got", got)
    columns = ", ".join(c[0] for c in engine.execute("DESCRIBE wanted").fetchall())
    assert sorted(got.column_names) == sorted(c[0] for c in engine.execute("DESCRIBE wanted").fetchall())
    for left, right in (("wanted", "got"), ("got", "wanted")):
        assert engine.execute(f"SELECT {columns} FROM {left} EXCEPT ALL SELECT {columns} FROM {right} LIMIT 3").fetchall() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, kept = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == names
    pieces = corpus_pipeline.run(spark, FOLDER)
    ids = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids and len(ids) < docs.count()
    assert corpus_pipeline.ORACLE_SQL is None
