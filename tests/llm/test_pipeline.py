"""The queries and the pipeline on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from airloom.llm import queries

from ..compare import rows_of_duckdb, rows_of_spark, tables
from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLES:
        assert rows_of_spark(out) == rows_of_duckdb(tables(SMALL), queries.ORACLES[name])
    else:
        table = "pages" if name.startswith("op7") else "documents"
        assert out.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == columns
            rows = corpus_pipeline.common.written(rows, "test")
            assert 0 < rows.count() <= before
            before = rows.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.count() == rows.count() and whole.exceptAll(rows).isEmpty()
