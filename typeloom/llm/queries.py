"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, license_scan, mixing, packing, pitman_yor, token_counts, topk_search, toxicity, url_filter, vector_dedup
from .common import load

TOKENIZER = "byte_bpe_50k.json"


def held_out(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == 0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), limit=1024)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(load(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(load(spark, sf_dir, "documents", "doc_id", "text"), license_scan.known_licenses(spark))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(load(spark, sf_dir, "pages", "page_id", "url"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(load(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"), threshold=0.98)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(load(spark, sf_dir, "documents", "doc_id", "text"), words=5, percent=75)


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(load(spark, sf_dir, "documents", "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), capacity=1024, end_id=0)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_source_mix, op3_license_scan, op4_url_filter, op5_toxicity, op6_vector_dedup, op7_jaccard_join, op8_pitman_yor, op9_packing, op10_topk_search)}


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """Canonical forms by the same rules, written for DuckDB."""
    az = f"translate({{0}}, '{license_scan.UPPER_AZ}', '{license_scan.LOWER_AZ}')"

    def form(t: str) -> str:
        lower = az.format(f"coalesce({t}, '')")
        clean = f"regexp_replace({lower}, {sql_text(license_scan.COPYRIGHT_LINE)}, '', 'g')"
        spaced = f"' ' || trim(regexp_replace({clean}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
        for one, other in license_scan.SPELLINGS:
            spaced = f"replace(replace({spaced}, ' {one} ', ' {other} '), ' {one} ', ' {other} ')"
        return f"sha256(trim({spaced}))"

    known = ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in license_scan.KNOWN_TEXTS.items())
    return f"""
        WITH known AS (SELECT {form('t')} AS digest, min(k) AS license_id FROM (VALUES {known}) v(k, t) GROUP BY 1),
        mine AS (SELECT doc_id, {form('text')} AS digest FROM documents)
        SELECT doc_id, mine.digest AS digest, license_id, license_id IS NOT NULL AS is_license
        FROM mine LEFT JOIN known ON mine.digest = known.digest"""


def url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return f"""
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{license_scan.UPPER_AZ}', '{license_scan.LOWER_AZ}'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(v, h, p) AS (VALUES {rules})
        SELECT page_id, any_value(host) AS host, any_value(path) AS path,
               arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
        FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id"""


TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

DEDUP_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
    FROM embeddings LEFT JOIN n ON a = vec_id JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) ON node = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op10_topk_search": TOPK_SQL, "op6_vector_dedup": DEDUP_SQL, "op3_license_scan": license_sql(), "op4_url_filter": url_sql()}
