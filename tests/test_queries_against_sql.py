"""Every query of the library that has SQL, against DuckDB over the smallest tables."""

import math
import os
import re

import duckdb
import pyarrow.parquet as pq
import pytest

from typeloom.plans import more_queries, queries  # noqa: F401
from typeloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def same_on(spark, tmp_path, name, **tables):
    """Whether a query and its SQL agree on tables that SQL makes."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})")
    got = sorted(repr([plain(x) for x in r]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in rel.fetchall())
    return got


@pytest.mark.parametrize("name, n", [("cache_ttl", 2), ("cache_refetch", 2)])
def test_ages_to_the_microsecond(spark, tmp_path, name, n):
    times = "('2024-01-16 23:59:59.999999'), ('2024-01-17 00:00:00'), ('2024-01-17 00:00:00.000001'), ('2024-01-17 00:00:00.9')"
    events = f"SELECT row_number() OVER () AS event_id, 1::BIGINT AS user_id, t::TIMESTAMP AS ts, 'view' AS event_type FROM (VALUES {times}) v(t)"
    assert len(same_on(spark, tmp_path, name, events=events)) == n


def test_word_edges_of_units(spark, tmp_path):
    texts = ["212.161 in\u00dflichver", "3 g\u00e4", "\u00e45 mm", "5\u000bmm", "4 \u212ag", "2 lb\u017f", "2 lbs", "9 mm_", "7\u00a0cm", "1x2", "5 m\u0131n", "6 \u0130n"]
    docs = "SELECT row_number() OVER () AS doc_id, t AS text FROM (VALUES " + ", ".join(f"('{t}')" for t in texts) + ", (NULL)) v(t)"
    same_on(spark, tmp_path, "completeness", documents=docs)


def test_upper_case_keeps_letters_single(spark, tmp_path):
    keys = ["gr\u00fc\u00dfe", "grusse", "\ufb01x", "FIX", "a\u000bb", "a b", "\u1fb3", "\u1e9e"]
    docs = [*keys, "GR\u00dcSSE", "gr\u00fcsse", "GRU\u00dfE", "\u1fbc", "\u0391\u0399", "AB", "stra\u00dfe"]
    tables = {"benchmark": ("item_id", keys), "documents": ("doc_id", docs)}
    same_on(spark, tmp_path, "mentions_pn", **{t: f"SELECT row_number() OVER () AS {i}, t AS text FROM (VALUES " + ", ".join(f"('{x}')" for x in v) + ") v(t)" for t, (i, v) in tables.items()})


def test_names_that_differ_by_case_are_written(spark, duck, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        df = QUERIES["cluster_source_pivot"](spark, SF)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    df.write.parquet(f"{tmp_path}/out")
    rel = duck.sql(SQL["cluster_source_pivot"])
    got = pq.read_table(f"{tmp_path}/out")
    assert got.column_names == rel.columns
    got = sorted(repr([plain(x) for x in r]) for r in zip(*[c.to_pylist() for c in got.columns]))
    assert got == sorted(repr([plain(x) for x in r]) for r in rel.fetchall())
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    assert spark.sparkContext.parallelize([(1, 2)]).toDF(["n", "m"]).sparkSession is spark


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_candidate_pages_of_every_benchmark_part(spark, duck):
    bare = lambda t: re.sub(r"[\s\-_.]", "", t).upper()
    texts = [bare(t) for (t,) in duck.sql("SELECT text FROM documents WHERE length(text) > 0").fetchall()]
    parts = {re.search("[^ ]+", t)[0] for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()}
    named = {pn for pn in parts if bare(pn) and any(bare(pn) in t for t in texts)}
    assert {r.pn for r in QUERIES["candidate_pages"](spark, SF).collect()} == named
    assert len(named) > 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
