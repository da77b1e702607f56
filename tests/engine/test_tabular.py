"""The table queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.plans import sources, tabular

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order)) for r in found)


QUERIES, ORACLE_SQL = tabular.QUERIES | sources.QUERIES, tabular.ORACLE_SQL | sources.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.collect(), df.columns)
    assert got == rows(want.fetchall(), want.columns) and (got or name in {"find_kind_language", "find_exact", "sequential_resolution", "first_match", "call_resolution"})


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "kind", "file_path", "start_line"] and 0 < df.count() <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(tabular.QUERIES) <= set(entry.queries())


def test_wildcards_stay_literal(spark):
    from codeloom.operators import search

    frame = spark.createDataFrame([("a%b",), ("a_b",), ("axb",), ("A*B",), (None,)], "name string")
    got = lambda p: sorted(r.name for r in frame.where(search.matches(frame.name, p)).collect())
    assert got("*%*") == ["a%b"] and got("a_b") == ["a_b"] and got("a*b") == ["A*B"] and got("*B") == ["A*B", "a%b", "a_b", "axb"]


def test_text_columns(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import text
    from codeloom.plans import render

    frame = spark.createDataFrame([("def f(a): {x}\n more",), ("class A {\r\nb",), ("héllo wörld wide",)], "t string")
    one = lambda c: [r[0] for r in frame.select(c).collect()]
    t = F.col("t")
    assert one(text.signature_to_brace(t)) == ["def f(a):", "class A", "héllo wörld wide"] and one(text.signature_of_class(t))[1] == "class A"
    assert one(text.line_count(t)) == [2, 2, 1] and one(text.truncate(t, 8))[2] == "héllo..." and one(text.truncate(t, 2))[2] == "hé"
    assert one(text.pad(F.lit("ab"), 4))[0] == "ab  " and one(text.indent(F.lit(3)))[0] == "    "
    assert text.escaped("a'b\n\\") == "a\\'b\\n\\\\" and render.truncate("héllo wörld", 8) == "héllo..." and render.truncate("abc", -1) == ""
