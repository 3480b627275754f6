"""The operators' queries with SQL, and whole-table shapes of the others, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from intervalis.llm import queries
from tests.test_oracle import SF, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = entry.queries()[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op1_url_filters", "pages"), ("op3_mixing", "documents"), ("op5_pii", "documents"), ("op6_language_id", "documents"), ("op8_ngram_jaccard_join", "documents"), ("op10_lm_scoring", "documents")])
def test_one_row_for_each_row(spark, name, table):
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{k}" for k in range(1, 14))
