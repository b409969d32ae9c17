"""The registered queries of the training-data operators against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canon
from rillgrid.llm.queries import SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_held_out_accuracy(spark):
    got = entry_points.queries()["op1_language_id"](spark, FOLDER)
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right, n = got.join(lang, "doc_id").where("held_out AND lang_pred <> 'und'").selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 20 and right >= 0.97 * n
