"""Datasheets to dimensions: caches, candidate pages, cascades of sources and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ATTACHMENT_WORDS, bare_upper, has_dimensions, has_weight, is_complete, mentions_pn, pn_clean, upper_each
from ..functions.units import metric_record, raw_dimensions

FIELDS = ["raw_length", "raw_width", "raw_height", "raw_diameter", "raw_weight"]
TTL_SECONDS = 14 * 24 * 3600
NO_DATA = ["No mock datasheet", "No documentation found", "No online specifications"]


def real_data(text: Column, has_data: Column) -> Column:
    none = F.lit(False)
    for p in NO_DATA:
        none = none | text.contains(p)
    return F.coalesce(has_data & ~none, F.lit(False))


def fresh(fetched: Column, now: Column, ttl: int | None) -> Column:
    """Whether less than ttl seconds have passed, to the microsecond."""
    return F.lit(True) if ttl is None else (F.unix_micros(now) - F.unix_micros(fetched)) < ttl * 1_000_000


def cache_hits(cache: DataFrame, now: Column, ttl: int | None = TTL_SECONDS, negative_ttl: int | None = None) -> DataFrame:
    """Entries of a cache that may be used: real data that is fresh, and, if a time is given for
    them, fresh entries without data."""
    real = real_data(F.col("text"), F.col("has_data"))
    usable = real & fresh(F.col("fetched_at"), now, ttl)
    if negative_ttl is not None:
        usable = usable | (~real & fresh(F.col("fetched_at"), now, negative_ttl))
    return cache.filter(usable)


def to_fetch(queries: DataFrame, cache: DataFrame, key: str, now: Column, refresh: bool = False, **ttl) -> DataFrame:
    """Queries that the cache cannot answer; all of them if a refresh is asked for."""
    return queries if refresh else queries.join(cache_hits(cache, now, **ttl).select(key), key, "left_anti")


def page_facts(pages: DataFrame, text: str) -> DataFrame:
    """What scoring needs of a page, worked out once a page before it meets any part number."""
    bare = bare_upper(F.col(text))
    return pages.withColumns({"_bare": bare, "_facts": has_weight(F.col(text)).cast("int") + has_dimensions(F.col(text)).cast("int")}).drop(text)


def score_candidates(met: DataFrame, pn: str) -> DataFrame:
    """Page facts beside a part number: two for naming the part, one for a weight, one for sizes."""
    key = upper_each(pn_clean(F.col(pn)))
    relevant = F.coalesce((key != "") & F.col("_bare").contains(key), F.lit(False))
    return met.withColumn("relevant", relevant).withColumn("score", F.col("relevant").cast("int") * 2 + F.col("_facts")).drop("_bare", "_facts")


def score_all(facts: DataFrame, keys: DataFrame, pn: str) -> DataFrame:
    """score_candidates for every page and part number. The numbers meet a page as one array, so
    each is made bare once and no text is copied beside it."""
    bare = keys.select(F.struct(F.col(pn), upper_each(pn_clean(F.col(pn))).alias("k")).alias("key")).agg(F.collect_list("key").alias("_keys"))
    tested = F.transform("_keys", lambda x: F.struct(x[pn].alias(pn), F.coalesce((x["k"] != "") & F.col("_bare").contains(x["k"]), F.lit(False)).alias("relevant")))
    met = facts.crossJoin(F.broadcast(bare)).withColumn("_met", tested).drop("_bare", "_keys").select("*", F.inline("_met")).drop("_met")
    return met.withColumn("score", F.col("relevant").cast("int") * 2 + F.col("_facts")).drop("_facts")


def best_pages(scored: DataFrame, pn: str, order: str, most: int = 2) -> DataFrame:
    """The best `most` pages of a part; none if no page names it."""
    w = Window.partitionBy(pn)
    rank = F.row_number().over(w.orderBy(F.desc("score"), order))
    return scored.withColumn("_any", F.max("relevant").over(w)).withColumn("rank", rank).filter(F.col("_any") & (F.col("rank") <= most)).drop("_any")


def allowed(url: Column, blocked: list[str], only: list[str] | None = None) -> Column:
    hit = lambda ds: F.exists(F.array(*[F.lit(d) for d in ds]), lambda d: F.contains(F.lower(url), d)) if ds else F.lit(False)
    return ~hit(blocked) & (hit(only) if only is not None else F.lit(True))


def attachment_lines(docs: DataFrame, key: str, text: str, pn: str, most: int = 150) -> DataFrame:
    """Lines of an attachment that name the part or a size word, each once, in order."""
    lines = docs.select(key, pn, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    word = F.exists(F.array(*[F.lit(w) for w in ATTACHMENT_WORDS]), lambda w: F.contains(F.lower("line"), w))
    kept = lines.filter((F.length("line") >= 3) & (word | mentions_pn(F.col("line"), F.col(pn))))
    once = kept.groupBy(key, "line").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "rank", "line")


def attachment_rows(cells: DataFrame, key: str, pn: str, most: int = 50, sheets: int = 5, per_sheet: int = 1000, wide: int = 12, cut: int = 200) -> DataFrame:
    """Rows of a workbook, (key, pn, sheet, sheet_no, row_no, cells) numbered from 1, that name the
    part, or a size word among few cells: the first `most`, each as a line that says where it is."""
    filled = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    rows = cells.filter((F.col("sheet_no") <= sheets) & (F.col("row_no") <= per_sheet)).withColumn("_c", filled).withColumn("line", F.array_join("_c", " | "))
    word = F.exists(F.array(*[F.lit(w) for w in ATTACHMENT_WORDS]), lambda w: F.contains(F.lower("line"), w))
    kept = rows.filter((F.size("_c") > 0) & (mentions_pn(F.col("line"), F.col(pn)) | (word & (F.size("_c") <= wide))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("sheet_no", "row_no"))
    shown = F.concat(F.lit("["), F.col("sheet"), F.lit(":R"), F.col("row_no").cast("string"), F.lit("] "), F.substring("line", 1, cut))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "rank", shown.alias("line"))


def method_of(method: Column, confidence: Column) -> Column:
    """extracted or estimated as given; anything else by confidence."""
    return F.when(method.isin("extracted", "estimated"), method).otherwise(F.when(F.coalesce(confidence, F.lit(0.0)) < 0.6, "estimated").otherwise("extracted"))


def extract(docs: DataFrame, text: str) -> DataFrame:
    """Raw dimensions of each text by patterns alone, which never count as extracted."""
    return docs.withColumn("raw", raw_dimensions(F.col(text))).withColumn("method", F.lit("regex_fallback"))


def with_fallback(answers: DataFrame, fields: list[str]) -> DataFrame:
    """Answers of an extractor, or what patterns found where it failed (answer is null)."""
    return answers.withColumns({f: F.when(F.col("answer").isNotNull(), F.col("answer")[f]).otherwise(F.col("fallback")[f]) for f in fields})


def complete_record(c: dict[str, Column]) -> Column:
    there = {f: F.coalesce(c[f] != "", F.lit(False)) for f in FIELDS}
    length, width, height, diameter = (there[f] for f in FIELDS[:4])
    return there["raw_weight"] & ((length & (width | height | diameter)) | (diameter & (height | length)))


def fuse(extractions: DataFrame, pn: str = "pn", rank: str = "provider_rank") -> DataFrame:
    """Evidence of ranked sources for each part, (pn, provider_rank, method, confidence, source_type,
    source_url, raw_*), as one record.

    Extracted evidence counts before guesses. Fields come from the first source that has them;
    confidence and type from the first; the urls of all that were read are kept. Sources after
    the first at which weight and sizes are complete, at 0.7 or more, are not read. Without
    extracted evidence the most confident guess stands, of equal ones the first.
    """
    e = extractions.withColumns({f: F.nullif(F.col(f), F.lit("")) for f in FIELDS})
    sure = F.col("method") == "extracted"
    w = Window.partitionBy(pn).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(F.when(sure, F.col(c)), ignorenulls=True).over(w)
    e = e.withColumns({f"f_{f}": first(f) for f in FIELDS}).withColumn("f_confidence", first("confidence"))
    full = complete_record({f: F.col(f"f_{f}") for f in FIELDS}) & (F.col("f_confidence") >= 0.7)
    e = e.withColumn("done", F.coalesce(full, F.lit(False)).cast("int"))
    e = e.withColumn("stopped", F.coalesce(F.max("done").over(Window.partitionBy(pn).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("stopped = 0")
    at = lambda c, ok: F.min(F.when(ok & F.col(c).isNotNull(), F.struct(F.col(rank), F.col(c).alias("v"))))["v"]
    urls = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(sure & (F.col("source_url") != ""), F.struct(F.col(rank), F.col("source_url").alias("u"))))), lambda x: x["u"]))
    guess = F.max(F.when(~sure, F.struct("confidence", (-F.col(rank)).alias("r"), *FIELDS, "method", "source_type", "source_url")))
    agg = e.groupBy(pn).agg(F.max(sure).alias("any"), *[at(f, sure).alias(f"s_{f}") for f in [*FIELDS, "confidence", "source_type"]], urls.alias("urls"), guess.alias("g"))
    pick = lambda f: F.when(F.col("any"), F.col(f"s_{f}")).otherwise(F.col(f"g.{f}")).alias(f)
    return agg.select(pn, F.when(F.col("any"), F.lit("extracted")).otherwise(F.col("g.method")).alias("method"), *[pick(f) for f in ["confidence", "source_type", *FIELDS]], F.when(F.col("any"), F.array_join("urls", ", ")).otherwise(F.col("g.source_url")).alias("source_url"))


def normalised(fused: DataFrame) -> DataFrame:
    return fused.withColumn("metric", metric_record(*[F.col(f) for f in ("raw_length", "raw_width", "raw_height", "raw_diameter", "raw_weight")]))


def merge_texts(sheets: DataFrame, pn: str = "pn", rank: str = "provider_rank") -> DataFrame:
    """Texts of ranked sources under headings, up to the first at which weight and sizes are
    complete; a single source's text stands alone."""
    have = sheets.filter("has_data")
    w = Window.partitionBy(pn).orderBy(rank)
    so_far = F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, 0)), "\n")
    have = have.withColumn("full", is_complete(so_far).cast("int"))
    have = have.withColumn("before", F.coalesce(F.max("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("before = 0")
    titled = F.concat(F.lit("=== SOURCE: "), F.upper("source_type"), F.lit(" ("), F.coalesce("source_url", F.lit("")), F.lit(") ===\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank), titled.alias("t"))))
    text = F.when(F.count("*") == 1, F.min("text")).otherwise(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n"))
    return have.groupBy(pn).agg(text.alias("text"), F.count("*").alias("n_sources"))


def sample_sheets(queries: DataFrame, known: DataFrame, fallback: bool = True) -> DataFrame:
    """Datasheets of a table of samples, matched on the whole bare number; else a text that says
    it is synthetic, or, without a fallback, none."""
    q = queries.withColumn("_k", F.upper(F.regexp_replace("pn", r"[\s\-_]", "")))
    met = q.join(known.select(F.upper(pn_clean(F.col("pn"))).alias("_k"), F.col("title").alias("_title"), F.col("text").alias("_text")), "_k", "left")
    made = F.concat(F.lit("SYNTHETIC MOCK DATA (not a real datasheet)\nDesignation: "), F.upper(F.coalesce("category", F.lit("PART"))), F.lit("\nStandard dimensions:\nLength: 110 mm\nWidth: 45 mm\nHeight: 35 mm\nWeight: 215 g\n"))
    found = F.col("_text").isNotNull()
    none = F.concat(F.lit("No mock datasheet defined for part number "), F.col("pn"), F.lit("."))
    text = F.when(found, F.col("_text")).otherwise(made if fallback else none)
    title = F.when(found, F.col("_title")).otherwise(F.concat(F.lit("[MOCK] Datasheet for "), F.col("pn")))
    kept = [c for c in queries.columns if c not in ("title", "text")]
    return met.select(*kept, title.alias("title"), text.alias("text"), (found | F.lit(fallback)).alias("has_data"), F.lit("mock").alias("source_type"))


def enrich(items: DataFrame, results: DataFrame, pn: str) -> DataFrame:
    """Items with their dimensions, in the items' order; those without a result stay."""
    return items.join(results, pn, "left")


def find_columns(columns: list[str]) -> dict[str, str | None]:
    """Which columns of a table hold the number, brand, title and category, by parts of names."""
    wanted = {"pn": ("part", "pn", "number"), "brand": ("brand", "manufacturer"), "title": ("title", "description", "name"), "category": ("category", "type")}
    return {k: next((c for c in columns if any(w in c.lower() for w in ws)), None) for k, ws in wanted.items()}


def process_batch(spark: SparkSession, queries: DataFrame, known: DataFrame) -> DataFrame:
    """Queries to metric records with the sample source and patterns."""
    sheets = extract(sample_sheets(queries, known), "text")
    fields = [F.col(f"raw.{f}").alias(f) for f in [*FIELDS, "confidence"]]
    rows = sheets.select("pn", F.lit(0).alias("provider_rank"), "method", "source_type", F.lit("").alias("source_url"), *fields)
    return normalised(fuse(rows))
