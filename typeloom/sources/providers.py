"""Where datasheets come from. A provider turns queries (pn, title, category) into sheets
(pn, title, text, source_url, has_data, source_type); live ones plug in behind the same call."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pages import page_text
from ..functions.text import bare_upper, pn_clean, pn_variants, title_score, upper_each
from ..operators.dimensions import TTL_SECONDS, cache_hits, sample_sheets, to_fetch
from .tables import read_cache, stored

SHEET = ["pn", "title", "text", "source_url", "has_data", "source_type"]
FAMILY_PAGES = 3


class Provider(Protocol):
    def sheets(self, queries: DataFrame) -> DataFrame: ...


class Samples:
    """A table of known sheets; others get a text that says it is synthetic, or none."""

    def __init__(self, known: DataFrame, fallback: bool = True):
        self.known, self.fallback = known, fallback

    def sheets(self, queries: DataFrame) -> DataFrame:
        out = sample_sheets(queries, self.known, self.fallback)
        return out.withColumn("source_url", F.lit("")).select(SHEET)


class PageTable:
    """A table of pages (url, title, html or text) searched in full: pages that name the part in
    any spelling, as mentions_pn tests it, the best titles first, the first `most` read as one
    text. Every stretch of a page without separators that is as long as a queried number is joined
    to the numbers by equality, so the search is a hash join and no page meets every query; texts
    are read again for the pages found only.

    `families` are pairs of patterns, of a part (its number and title) and of a page's title. A part
    of a family with fewer than `pool` pages of its own also gets FAMILY_PAGES of the family's."""

    def __init__(self, pages: DataFrame, kind: str = "wiki", most: int = 3, is_html: bool = True, families: list[tuple[str, str]] | None = None, pool: int | None = None):
        self.pages = pages.withColumn("text", page_text("html")) if is_html else pages
        self.kind, self.most, self.families, self.pool = kind, most, families or [], pool or max(3 * most, 8)

    def of_families(self, queries: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
        """(pn, _id, url, title) of family pages, a few a family, for parts that found too little."""
        title = F.col("title") if "title" in queries.columns else F.lit("")
        own = found.groupBy("pn").agg(F.count_distinct("_id").alias("n"))
        few = queries.select("pn", F.concat_ws(" ", "pn", title).alias("about")).join(own, "pn", "left").filter(F.coalesce("n", F.lit(0)) < self.pool)
        out = None
        for part, page in self.families:
            some = pages.select("_id", "url", "title").distinct().filter(F.col("title").rlike(page)).orderBy("url", "_id").limit(FAMILY_PAGES)
            met = few.filter(F.col("about").rlike(part)).select("pn").distinct().crossJoin(F.broadcast(some))
            out = met if out is None else out.unionByName(met)
        return out.distinct().join(found.select("pn", "_id"), ["pn", "_id"], "left_anti")

    def sheets(self, queries: DataFrame) -> DataFrame:
        keys = queries.select("pn").distinct().withColumn("_k", upper_each(pn_clean(F.col("pn")))).filter("_k != ''")
        # a row for each length of number; where all of a length are digits, so must be the stretches
        sizes = keys.groupBy(F.length("_k").alias("n")).agg(F.min(F.when(F.col("_k").rlike("^[0-9]+$"), 2).when(F.col("_k").rlike("^[A-Z0-9]+$"), 1).otherwise(0)).alias("kind")).collect()
        bare = bare_upper(F.col("text"))
        windows = [F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?s)(?=({('.', '[A-Z0-9]', '[0-9]')[s.kind]}{{{s.n}}}))"), F.lit(1))) for s in sizes]
        pages = self.pages.select("url", "title", "text").withColumn("_id", F.sha2(F.to_json(F.struct("url", "title", "text")), 256))
        found = pages.select("_id", "url", "title", F.explode(F.concat(*windows) if windows else F.array().cast("array<string>")).alias("_k"))
        met = keys.join(found, "_k").select("pn", "_id", "url", "title", F.lit(0).alias("far"))
        if self.families:
            met = stored(met)
            met = met.unionByName(self.of_families(queries, pages, met).withColumn("far", F.lit(1)))
        met = met.withColumn("score", title_score(F.col("title"), pn_variants(F.col("pn"))))
        top = met.withColumn("r", F.row_number().over(Window.partitionBy("pn").orderBy(F.desc("score"), "far", "url"))).filter(F.col("r") <= self.most)
        top = top.join(pages.select("_id", "text").dropDuplicates(["_id"]), "_id")
        one = top.groupBy("pn").agg(F.min_by("title", "r").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min_by("url", "r").alias("source_url"))
        return queries.select("pn").distinct().join(one, "pn", "left").select("pn", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.col("text").isNotNull().alias("has_data"), F.lit(self.kind).alias("source_type"))


class Cached:
    """A provider whose sheets are kept in a table with the time they were fetched. Only what the
    table cannot answer is asked for; sheets without data count for `negative_ttl` seconds, if given."""

    def __init__(self, provider: Provider, path: str, ttl: int | None = TTL_SECONDS, negative_ttl: int | None = None, refresh: bool = False):
        self.provider, self.path, self.refresh = provider, path, refresh
        self.ages = {"ttl": ttl, "negative_ttl": negative_ttl}

    def sheets(self, queries: DataFrame) -> DataFrame:
        now = F.current_timestamp()
        kept = read_cache(queries.sparkSession, self.path, "pn string, title string, text string, source_url string, has_data boolean, source_type string, fetched_at timestamp")
        newest = kept.groupBy("pn").agg(F.max_by(F.struct(*SHEET[1:], "fetched_at"), "fetched_at").alias("s")).select("pn", "s.*")
        missing = to_fetch(queries, newest, "pn", now, self.refresh, **self.ages)
        new = stored(self.provider.sheets(missing).select(SHEET))
        known = cache_hits(newest, now, **self.ages).join(queries.select("pn").distinct(), "pn").select(SHEET)
        out = new if self.refresh else stored(known.unionByName(new))
        new.withColumn("fetched_at", now).write.mode("append").parquet(self.path)
        return out


class Search:
    """Web search by functions (query, most) -> [{title, link, snippet}], the next one asked where
    one fails or finds nothing; run in batches on the executors."""

    def __init__(self, engines: list[Callable[[str, int], list[dict]]], most: int = 10):
        self.engines, self.most = engines, most

    def ask(self, query: str) -> list[dict]:
        for engine in self.engines:
            try:
                if got := engine(query, self.most):
                    return got[: self.most]
            except Exception:  # noqa: BLE001, S112  a dead engine must not end the search
                continue
        return []

    def results(self, queries: DataFrame, text: str) -> DataFrame:
        """queries with a row (rank, title, link, snippet) for each result."""

        def run(batches):
            for b in batches:
                out = [(q, i, r.get("title", ""), r.get("link", ""), r.get("snippet", "")) for q in b[text] for i, r in enumerate(self.ask(q), 1)]
                yield pd.DataFrame(out, columns=[text, "rank", "title", "link", "snippet"])

        found = queries.select(text).distinct().mapInPandas(run, f"{text} string, rank int, title string, link string, snippet string")
        return queries.join(found, text)


def cascade(providers: list[Provider], queries: DataFrame) -> DataFrame:
    """Sheets of all providers with their rank; what is read of them is decided by evidence."""
    out = None
    for rank, p in enumerate(providers):
        part = p.sheets(queries).withColumn("provider_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out
