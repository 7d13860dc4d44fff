"""Each registered query against its SQL, as unordered rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    got = sorted(tuple(map(shown, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got == sorted(tuple(shown(r[k]) for k in order) for r in want.fetchall())


def test_sizes_of_odd_texts(spark, tmp_path):
    """fn_strings_size against its SQL: no text, an empty one, characters beyond two bytes, negative keys and none."""
    texts = ["", None, "\U0001f600x", "e\u0301", "\0ab", "\ufeffb", " ", "\r\n", "\u00e9" * 1000, "\U0010ffff"]
    docs = [(i, x, "en", "web") for i, x in enumerate(texts)] + [(-1 - i, x, "de", None) for i, x in enumerate(texts)] + [(None, "x", "en", "web"), (2**63 - 1, "x", None, "web"), (-(2**63), "", "fr", "web")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["fn_strings_size"])
    df = catalog.queries()["fn_strings_size"](spark, str(tmp_path))
    assert df.columns == want.columns
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(map(shown, r)) for r in want.fetchall())


def test_all_have_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"sample_rows"}


def test_whole_tables(spark):
    """Rows of whole tables, the order that row sets don't show, and a month-end."""
    run = lambda name: catalog.queries()[name](spark, SF)
    size = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "customer")}
    assert run("sort_by").count() == run("fn_months").count() == size["orders"]
    assert run("agg_first_last").count() == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()
    got = [r["k"] for r in run("sort_nulls").collect()]
    assert len(got) == 5 and got == sorted(got[:4], reverse=True) + [None]
    for part in run("sort_by").rdd.glom().collect():
        assert [r["o_totalprice"] for r in part] == sorted((r["o_totalprice"] for r in part), reverse=True)
    ends = spark.sql("select months_between(timestamp '1996-02-29 00:00:00', timestamp '1996-01-31 00:00:00') as m").first()["m"]
    assert ends == 1 and any(float(r["mb"]).is_integer() for r in run("fn_months").collect())
