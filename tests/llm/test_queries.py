"""Queries of the text operators against their SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from tickloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])


@pytest.mark.parametrize("name", ["op4_toxicity", "op6_licence_scan", "op8_imatch", "op10_ngram_join"])
def test_one_row_a_document(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    assert rows.select("doc_id").distinct().count() == rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
