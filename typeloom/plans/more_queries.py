"""Queries for the smaller operators, and for those that only rows can be checked of."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pages, text, units
from ..operators import clustering, dimensions, encoders, entities, evaluation, features, gateway, hybrid, linear, ranking, readers
from ..sources import providers
from ..sources.tables import result_document, stored
from . import views
from .registry import load, query
from .views import LINES_SQL, NAMED_SQL, NEAREST, PARTS, RECORDS, WORDS_SQL

R6 = lambda c: F.round(c, 6)


@query(f"WITH {PARTS} SELECT pn, matdesc, '' AS \"BU\", '' AS statgroup FROM parts")
def column_fill(spark, sf):
    df = entities.ensure_columns(views.parts(spark, sf), ["matdesc", "BU", "statgroup"])
    return entities.present_columns(df, ["pn", "matdesc", "BU", "statgroup", "absent"])


@query(f"WITH {PARTS} SELECT pn, label FROM parts WHERE lower(label) <> 'tbd'")
def labelled_only(spark, sf):
    return views.parts(spark, sf).filter(~text.is_unlabelled(F.col("label"), "equals")).select("pn", "label")


@query(f"""WITH {PARTS}, g AS (SELECT 'NEW_' || row_number() OVER (ORDER BY count(*) DESC, p_brand) AS g FROM parts GROUP BY p_brand) SELECT g AS name, substr(g, 5) AS number FROM g WHERE starts_with(g, 'NEW_1')""")
def prefix_filter(spark, sf):
    names = ranking.new_group_names(views.parts(spark, sf), "p_brand")
    return names.filter(F.col("name").startswith("NEW_1")).select("name", F.substring("name", 5, 9).alias("number"))


@query(f"WITH {NEAREST} SELECT vec_id, round(margin, 6) AS margin FROM nearest")
def top2_margins(spark, sf):
    v, c = views.vectors(spark, sf), features.centroids(views.vectors(spark, sf), "label", "v").agg(F.collect_list("centroid").alias("cs"))
    scores = F.transform("cs", lambda m: F.round(units.cosine(F.col("v"), m), 9))
    return v.crossJoin(F.broadcast(c)).select("vec_id", R6(ranking.top2_margin(scores)).alias("margin"))


@query(f"WITH {PARTS} SELECT pn FROM parts ORDER BY md5(pn || '-42'), pn LIMIT 180")
def sampled_parts(spark, sf):
    return ranking.sample_rows(views.parts(spark, sf), "pn", 180).select("pn")


@query(f"""WITH {PARTS}, l AS (SELECT pn, ('0x' || substr(md5(pn || '-0'), 1, 8))::UBIGINT::BIGINT % (SELECT greatest(1, ceil(count(*) / 1600))::BIGINT FROM parts) AS lane FROM parts),
    b AS (SELECT lane, (row_number() OVER (PARTITION BY lane ORDER BY pn) - 1) // 25 AS b FROM l) SELECT lane || '-' || b AS batch, count(*) AS n FROM b GROUP BY ALL""")
def lane_batches(spark, sf):
    return ranking.batches(views.parts(spark, sf), "pn", 25).groupBy("batch").agg(F.count("*").alias("n"))


@query("""SELECT c, list_distinct_kept AS names FROM (VALUES (1, ['BALL', 'SEAL']), (2, ['PIN']), (3, []::VARCHAR[])) t(c, list_distinct_kept)""")
def clean_lists(spark, sf):
    rows = [(1, [" ball ", '"Seal"', "BALL"]), (2, ["", "'pin'", None]), (3, [" "])]
    return spark.createDataFrame(rows, "c int, l array<string>").select("c", F.filter(text.clean_list("l"), lambda x: x.isNotNull()).alias("names"))


@query(f"""WITH {PARTS} SELECT pn, regexp_replace(matdesc, '[^A-Za-z0-9_]', '', 'g') AS k, p_brand || ' ' || pn || ' ' || p_name AS q FROM parts""")
def search_strings(spark, sf):
    return views.parts(spark, sf).select("pn", text.file_key(F.col("matdesc")).alias("k"), text.search_text(F.col("p_brand"), F.col("pn"), F.col("p_name"), F.lit(" ")).alias("q"))


@query("SELECT s, v FROM (VALUES ('NEW: BALL PIN', 'BALL PIN'), ('new:  x', 'x'), ('SEAL', 'SEAL'), ('NEWT', 'NEWT')) t(s, v)")
def stripped_names(spark, sf):
    return spark.createDataFrame([(s,) for s in ("NEW: BALL PIN", "new:  x", "SEAL", "NEWT")], "s string").select("s", text.strip_new(F.col("s")).alias("v"))


@query("SELECT s, v FROM (VALUES ('1,234.5', 1234.5::DOUBLE), ('1,200', 1200.0), ('12,5', 12.5), ('3/8', 0.375), ('1 1/2', 1.5), ('1/0 3', 1.0), ('2 to 4', 3.0), ('5..7', 6.0), ('abc', NULL), ('-3', 3.0)) t(s, v)")
def numeric_values(spark, sf):
    rows = [(s,) for s in ("1,234.5", "1,200", "12,5", "3/8", "1 1/2", "1/0 3", "2 to 4", "5..7", "abc", "-3")]
    return spark.createDataFrame(rows, "s string").select("s", units.numeric_value(F.col("s")).alias("v"))


@query(f"""WITH {RECORDS} SELECT row_id, round(log10(greatest(l_quantity - 25, 1e-4)), 6) AS l, least(greatest(l_quantity / 30 - 0.2, 0.0), 1.0)::DOUBLE AS c, CASE WHEN l_quantity > 25 THEN l_quantity * 1000 END AS g FROM records""")
def log_and_clamp(spark, sf):
    q = F.col("l_quantity")
    g = units.grams(q, F.when(q > 25, " kg ").otherwise("box"))
    return views.records(spark, sf).select("row_id", R6(units.log_size(q - 25)).alias("l"), units.clamp01(q / 30 - 0.2).alias("c"), g.alias("g"))


@query(f"""WITH {PARTS}, s AS (SELECT p_name AS g, arg_min(p_brand, (length(p_brand), p_brand)) AS name FROM parts GROUP BY 1) SELECT g, name FROM s""")
def shortest_names(spark, sf):
    return clustering.shortest_name(views.parts(spark, sf).withColumnRenamed("p_name", "g"), "g", "p_brand")


@query("SELECT m, c, r FROM (VALUES ('extracted', 0.1::DOUBLE, 'extracted'), ('odd', 0.5, 'estimated'), (NULL, 0.7, 'extracted'), ('estimated', 0.9, 'estimated')) t(m, c, r)")
def method_labels(spark, sf):
    d = spark.createDataFrame([("extracted", 0.1), ("odd", 0.5), (None, 0.7), ("estimated", 0.9)], "m string, c double")
    return d.select("m", "c", dimensions.method_of(F.col("m"), F.col("c")).alias("r"))


@query("SELECT n, a FROM (VALUES (1, 10.0::DOUBLE), (2, 0.5)) t(n, a)")
def extractor_fallback(spark, sf):
    d = spark.createDataFrame([(1, (10.0,), (0.5,)), (2, None, (0.5,))], "n int, answer struct<a:double>, fallback struct<a:double>")
    return dimensions.with_fallback(d, ["a"]).select("n", "a")


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'error' AND epoch(TIMESTAMP '2024-01-31') - epoch(ts) < 1209600)""")
def cache_refetch(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("fetched_at"), F.lit("text").alias("text"), (F.col("event_type") != "error").alias("has_data"))
    return dimensions.to_fetch(e.select("event_id"), e, "event_id", F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query(f"""WITH {NEAREST} SELECT round(avg((label = cluster)::INTEGER), 6) AS all_accuracy, round(avg((label = cluster)::INTEGER) FILTER (margin >= (SELECT quantile_cont(margin, 0.25) FROM nearest)), 6) AS confident_accuracy FROM nearest""")
def both_views(spark, sf):
    n = stored(views.nearest(spark, sf))
    cut = hybrid.threshold_for_coverage(n, "margin", 0.75)
    right = (F.col("label") == F.col("cluster")).cast("double")
    return n.crossJoin(F.broadcast(cut)).agg(R6(F.avg(right)).alias("all_accuracy"), R6(F.avg(F.when(F.col("margin") >= F.col("threshold"), right))).alias("confident_accuracy"))


@query(f"WITH {PARTS}, t AS (SELECT label, p_brand, count(*) AS n FROM parts GROUP BY ALL) SELECT label, p_brand, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM t")
def source_shares(spark, sf):
    t = evaluation.contingency(views.parts(spark, sf), "label", "p_brand")
    return t.select(F.col("y").alias("label"), F.col("c").alias("p_brand"), "n", R6(F.col("n") / F.sum("n").over(Window.partitionBy("y"))).alias("share"))


@query()
def result_documents(spark, sf):
    p = views.parts(spark, sf).select("pn", F.col("label").alias("cluster_name"))
    return result_document(p, ranking.cluster_letters(p, "cluster_name"), {"ari": 0.123456}, "2024-01-01T00:00:00")


@query()
def linear_out_of_fold(spark, sf):
    oof = hybrid.out_of_fold(views.vectors(spark, sf), "vec_id", "v", "label", hybrid.Settings(folds=2))
    return oof.select("vec_id", "label", "predicted", "margin")


@query()
def linear_scores(spark, sf):
    v = stored(views.vectors(spark, sf))
    return linear.predict(linear.fit(v, "v", "label"), v, "v").select("vec_id", "predicted", "margin")


@query()
def hidden_type_simulation(spark, sf):
    return hybrid.simulate_new_types(stored(views.vectors(spark, sf)), "vec_id", "v", "label", 0.25, hybrid.Settings(folds=2, target=0.5))


@query()
def hashed_texts(spark, sf):
    return encoders.encoder("hash", dim=32)(views.parts(spark, sf), "pn", "matdesc")


@query()
def page_texts(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.length(pages.page_text("html")).alias("n"))


@query()
def wiki_search(spark, sf):
    p = load(spark, sf, "pages").select("url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "html")
    q = load(spark, sf, "pages").select(F.regexp_extract("url", r"/(\d+)", 1).alias("pn")).filter("pn != ''").distinct()
    return providers.PageTable(p).sheets(q).select("pn", "title", "source_url", "has_data")


@query()
def taxonomy_names(spark, sf):
    cards = views.parts(spark, sf).select("pn", text.part_card({"desc": F.col("matdesc")}, ("desc",)).alias("card"))
    return spark.createDataFrame([(n,) for n in gateway.discover_taxonomy(cards, "pn", "card", gateway.KeywordModel())], "name string")


GOODS = text.UNRELATED_GOODS


@query(f"""WITH {PARTS}, v AS (SELECT pn, p_brand AS b, p_name AS t, '"' || pn || '"' AS q FROM parts)
    SELECT pn, [b || ' ' || pn || ' ' || t || ' dimensions', b || ' ' || q || ' ' || t || ' dimensions weight', q || ' ' || t || ' dimensions', b || ' ' || pn || ' dimensions weight', q || ' dimensions weight',
        b || ' ' || q || ' dimensions weight {GOODS}', q || ' ' || t, q || ' datasheet specifications'] AS searches FROM v""")
def web_queries(spark, sf):
    return views.parts(spark, sf).select("pn", text.web_queries(F.col("p_brand"), F.col("pn"), F.concat(F.lit(" "), "p_name", F.lit("! "))).alias("searches"))


DOMAINS = ["a.example", "b.example", "c.example", "d.example"]


@query(f"""WITH {PARTS}, v AS (SELECT pn, unnest([pn, substr(pn, 1, 1) || ' ' || substr(pn, 2, 3) || ' ' || substr(pn, 5, 3) || ' ' || substr(pn, 8)]) AS v, unnest([1, 2]) AS i FROM parts)
    SELECT pn, flatten(list(['"' || v || '" (site:a.example OR site:b.example OR site:c.example)', '"' || v || '" (site:d.example)'] ORDER BY i)) AS searches FROM v GROUP BY pn""")
def catalog_queries(spark, sf):
    return views.parts(spark, sf).select("pn", text.catalog_queries(text.pn_variants(F.col("pn")), DOMAINS).alias("searches"))


@query(f"""WITH {PARTS}, k AS (SELECT pn, CASE {' '.join(f"WHEN contains(lower(matdesc), '{w}') THEN '{k}'" for w, k in gateway.KEYWORDS)} ELSE 'OTHER' END AS cluster FROM parts)
    SELECT pn, cluster, CASE WHEN cluster = 'OTHER' THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN cluster = 'OTHER' THEN 'description too generic/only a code' ELSE '' END AS missing FROM k""")
def confident_types(spark, sf):
    cards = views.parts(spark, sf).select("pn", text.part_card({"desc": F.col("matdesc")}, ("desc",)).alias("card"))
    return gateway.classify_with_confidence(cards, "pn", "card", gateway.KeywordModel())


@query(f"""WITH l AS ({LINES_SQL}), c AS (SELECT doc_id, 'S' || (pos % 7 + 1) AS sheet, pos % 7 + 1 AS s, pos // 7 + 1 AS r, list_filter(list_transform(string_split(line, ' '), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l),
    k AS (SELECT *, array_to_string(cells, ' | ') AS line FROM c WHERE s <= 5 AND r <= 1000 AND len(cells) > 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, r) AS rank FROM k WHERE {NAMED_SQL} OR (({WORDS_SQL}) AND len(cells) <= 12))
    SELECT doc_id, rank::INTEGER AS rank, '[' || sheet || ':R' || r || '] ' || substr(line, 1, 200) AS line FROM w WHERE rank <= 50""")
def attachment_rows(spark, sf):
    """Each document as a workbook of seven sheets, dealt line by line."""
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"[.,] ", "\n"), "\n")).alias("pos", "line"))
    no = F.col("pos") % 7 + 1
    cells = lines.select("doc_id", F.lit("0265005303").alias("pn"), F.concat(F.lit("S"), no.cast("string")).alias("sheet"), no.alias("sheet_no"), (F.floor(F.col("pos") / 7) + 1).alias("row_no"), F.split("line", " ").alias("cells"))
    return dimensions.attachment_rows(cells, "doc_id", "pn")


class StandIn:
    """A reader by simple rules: fails on texts without a letter q, is sure of those with an x, and of any picture."""

    def read(self, question: str, images: list[bytes]) -> dict:
        body = question.split("DATASHEET\n", 1)[1]
        if images:
            return {"raw_weight": f"{len(images)} kg", "confidence": 0.9, "method": "seen"}
        if "q" not in body:
            raise ValueError("no q")
        return {"raw_length": "10 mm", "confidence": 0.8 if "x" in body else 0.4}


@query("""WITH s AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 2 = 1 AS pics FROM documents), a AS (SELECT *, CASE WHEN NOT contains(t, 'q') THEN 'patterns' WHEN contains(t, 'x') OR NOT pics THEN 'text' ELSE 'images' END AS seen FROM s)
    SELECT doc_id, seen, CASE WHEN seen = 'patterns' THEN 'regex_fallback' WHEN seen = 'images' OR contains(t, 'x') THEN 'extracted' ELSE 'estimated' END AS method,
        CASE WHEN seen = 'text' THEN '10 mm' END AS raw_length, CASE WHEN seen = 'images' THEN '1 kg' END AS raw_weight, CASE WHEN seen = 'patterns' THEN 'ValueError: no q' END AS error FROM a""")
def escalated_reading(spark, sf):
    picture = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(b"x"))).otherwise(F.array().cast("array<binary>"))
    sheets = load(spark, sf, "documents").select("doc_id", "text", picture.alias("images"))
    own = lambda c: F.when(F.col("seen") != "patterns", F.col(c)).alias(c)  # noqa: E731  patterns have queries of their own
    return readers.read_sheets(sheets, StandIn(), images="images").select("doc_id", "seen", "method", own("raw_length"), own("raw_weight"), "error")
