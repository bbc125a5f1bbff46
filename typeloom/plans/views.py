"""Stand-ins for part master data over the test tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ATTACHMENT_WORDS, DIMENSION_LINE, build_description, type_phrase
from ..functions.units import cosine
from ..operators.features import centroids
from .registry import load


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """One row a part; every tenth label is tbd."""
    label = F.when(F.col("p_partkey") % 10 == 0, "tbd").otherwise(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))))
    two = F.concat(F.upper("p_name"), F.lit("; "), F.col("p_brand"))
    return load(spark, sf, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("pn"), "p_name", build_description(F.col("p_name"), two).alias("matdesc"), label.alias("label"), "p_brand", "p_type", "p_size", "p_retailprice")


PARTS = """parts AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS pn, p_name,
    p_name || ' | ' || upper(p_name) || '; ' || p_brand AS matdesc,
    CASE WHEN p_partkey % 10 = 0 THEN 'tbd' ELSE upper(split_part(p_name, ' ', 2)) END AS label,
    p_brand, p_type, p_size, p_retailprice FROM part)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of shipments with what they say about their part."""
    line = load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("row_id"))
    return line.join(parts(spark, sf), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")


RECORDS = PARTS + """, records AS (SELECT l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, parts.* FROM lineitem JOIN parts ON l_partkey = p_partkey)"""


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).withColumn("phrase", type_phrase(F.col("matdesc")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the label whose centroid is nearest, and the margin to the second.
    There are as many centroids as labels; one row carries them all."""
    v = vectors(spark, sf)
    c = centroids(v, "label", "v").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("l"), "centroid"))).alias("cs"))
    scored = v.crossJoin(F.broadcast(c)).withColumn("s", F.reverse(F.array_sort(F.transform("cs", lambda x: F.struct(F.round(cosine(F.col("v"), x["centroid"]), 9).alias("s"), x["l"].alias("l"))))))
    return scored.select("vec_id", "label", F.expr("s[0].l").alias("cluster"), F.expr("s[0].s").alias("similarity"), (F.expr("s[0].s") - F.expr("s[1].s")).alias("margin"))


CENTROIDS = """vecs AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS v FROM embeddings),
    coords AS (SELECT label, i, avg(v[i]) AS x FROM vecs, range(1, 65) t(i) GROUP BY label, i),
    means AS (SELECT label, list(x ORDER BY i) AS m FROM coords GROUP BY label)"""
NEAREST = CENTROIDS + """, sims AS (SELECT vec_id, vecs.label AS label, means.label AS l, round(list_cosine_similarity(v, m), 9) AS s FROM vecs, means),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, l DESC) AS r, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, l DESC) AS s2 FROM sims),
    nearest AS (SELECT vec_id, label, l AS cluster, s AS similarity, s - s2 AS margin FROM ranked WHERE r = 1)"""

# Lines of the documents, and tests of a line for size words and for one part's number.
WORDS_SQL = " OR ".join(f"contains(lower(line), '{w}')" for w in ATTACHMENT_WORDS)
LINES_SQL = "SELECT doc_id, unnest(string_split(regexp_replace(text, '[.,] ', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '[.,] ', chr(10), 'g'), chr(10)), 1) - 1 AS pos FROM documents"
NAMED_SQL = r"contains(upper(regexp_replace(line, '[\s\-_.]', '', 'g')), '0265005303')"
# DuckDB knows word boundaries between ASCII letters only, so others are spelled out.
EDGE_SQL = re.sub(r"(?<=[|(])\\b", r"(^|[^\\p{L}\\p{N}_])", DIMENSION_LINE).replace(r"\b", r"($|[^\p{L}\p{N}_])")
