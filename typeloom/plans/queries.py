"""One query for each operator, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as html
from ..functions import salvage, text, units
from ..operators import clustering, dimensions, entities, evaluation, features, gateway, hybrid, ranking
from ..sources.tables import case_sensitive, stored
from . import views
from .registry import SQL, load, query
from .views import CENTROIDS, EDGE_SQL, LINES_SQL, NAMED_SQL, NEAREST, PARTS, RECORDS, WORDS_SQL

R6 = lambda c: F.round(c, 6)
PHRASE_SQL = (
    "coalesce(nullif(upper(trim(regexp_replace(regexp_replace(regexp_replace(split_part(string_split({0}, '|')[-1], ';', 1), "
    + "'" + text.INSTANCE_NOISE.replace("'", "''") + "', ' ', 'g'), '[^A-Za-z\\- ]', ' ', 'g'), '\\s+', ' ', 'g'))), ''), 'UNKNOWN')"
)
PHRASES = PARTS + ", phrases AS (SELECT *, " + PHRASE_SQL.replace("{0}", "matdesc") + " AS phrase FROM parts)"


# Entities


@query(f"""WITH {RECORDS}, modes AS (SELECT pn, l_returnflag AS v, count(*) AS n FROM records GROUP BY ALL),
    supp AS (SELECT pn, CAST(l_suppkey AS VARCHAR) AS v, count(*) AS n FROM records GROUP BY ALL),
    best AS (SELECT pn, v, row_number() OVER (PARTITION BY pn ORDER BY n DESC, v) AS r FROM modes),
    best2 AS (SELECT pn, v, row_number() OVER (PARTITION BY pn ORDER BY n DESC, v) AS r FROM supp),
    base AS (SELECT pn, left(string_agg(DISTINCT matdesc, ' ; ' ORDER BY matdesc), 400) AS "MATDESC", count(*) AS n_rows FROM records GROUP BY pn)
    SELECT base.*, best.v AS flag, best2.v AS supplier FROM base JOIN best ON base.pn = best.pn AND best.r = 1 JOIN best2 ON base.pn = best2.pn AND best2.r = 1""")
def pn_dedup(spark: SparkSession, sf: str) -> DataFrame:
    r = views.records(spark, sf).withColumn("l_suppkey", F.col("l_suppkey").cast("string"))
    return entities.dedup_to_parts(r, "pn", "matdesc", {"l_returnflag": "flag", "l_suppkey": "supplier"})


@query(f"""WITH {RECORDS}, m AS (SELECT pn, median(p_size::DOUBLE * 1000.0::DOUBLE) AS w, median(l_quantity / nullif(l_quantity + 1, 0) * 1e6) AS v,
    median(l_extendedprice / l_quantity) AS e FROM records GROUP BY pn)
    SELECT pn, round(w::DOUBLE, 6) AS weight_g, round(v, 6) AS volume_cm3, round(e, 6) AS value_eur, round(w::DOUBLE / v, 9) AS density FROM m""")
def physics_per_pn(spark, sf):
    r = views.records(spark, sf)
    weight = units.grams(F.col("p_size").cast("double"), F.lit("kg"))
    out = entities.physics(r, "pn", weight, units.per_piece_cm3(F.col("l_quantity"), F.col("l_quantity") + 1), F.col("l_extendedprice") / F.col("l_quantity"))
    return out.select("pn", *[R6(F.col(c)).alias(c) for c in ("weight_g", "volume_cm3", "value_eur")], F.round("density", 9).alias("density"))


@query(f"WITH {PARTS} SELECT pn, coalesce(CASE WHEN p_partkey % 97 = 0 THEN 'FIXED ' || CAST(p_partkey % 3 AS VARCHAR) END, label) AS cluster FROM parts")
def override_lookup(spark, sf):
    p = views.parts(spark, sf)
    fixed = p.filter(F.col("p_partkey") % 97 == 0).select("pn", F.concat(F.lit("FIXED "), (F.col("p_partkey") % 3).cast("string")).alias("c"))
    return entities.lookup(p, fixed, "pn", "c", "cluster", F.col("label")).select("pn", "cluster")


@query(f"WITH {PARTS} SELECT pn, matdesc FROM parts WHERE pn NOT IN (SELECT pn FROM parts WHERE p_size % 3 = 0)")
def cache_miss(spark, sf):
    p = views.parts(spark, sf)
    return entities.keep_missing(p, p.filter("p_size % 3 = 0"), "pn").select("pn", "matdesc")


@query(f"WITH {RECORDS} SELECT row_id, pn, l_quantity FROM records WHERE pn IN (SELECT pn FROM parts WHERE p_size < 10)")
def subset_rows(spark, sf):
    p = views.parts(spark, sf).filter("p_size < 10")
    return entities.keep_matching(views.records(spark, sf), p, "pn").select("row_id", "pn", "l_quantity")


@query("""WITH own AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, 1.5 AS weight FROM labels WHERE doc_id % 2 = 0)
    SELECT doc_id, label, CAST(weight AS DOUBLE) AS weight FROM own
    UNION ALL SELECT doc_id, source, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM own)""")
def labelled_union(spark, sf):
    own = load(spark, sf, "labels").filter("doc_id % 2 = 0").select("doc_id", F.col("quality").cast("string").alias("label"), F.lit(1.5).alias("weight"))
    return entities.labelled_union(own, load(spark, sf, "documents").select("doc_id", F.col("source").alias("label")), "doc_id")


@query("""WITH l AS (SELECT conv_id, CASE WHEN role = 'system' THEN 'TBD' ELSE role END AS role FROM conversations),
    n AS (SELECT conv_id, role, count(*) AS n FROM l WHERE lower(role) <> 'tbd' GROUP BY ALL),
    b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM n)
    SELECT c.conv_id, coalesce(b.role, 'tbd') AS label FROM (SELECT DISTINCT conv_id FROM l) c LEFT JOIN b ON b.conv_id = c.conv_id AND r = 1""")
def label_mode(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "system", "TBD").otherwise(F.col("role")).alias("role"))
    return entities.label_mode(c, "conv_id", "role")


@query(f"WITH {PARTS} SELECT DISTINCT trim(label) AS label FROM parts WHERE label <> 'tbd'")
def label_list(spark, sf):
    return entities.label_list(views.parts(spark, sf), "label")


@query(f"""WITH {PARTS}, k AS (SELECT pn, p_name || p_brand || p_type AS y, p_partkey % 97 = 0 AS o FROM parts)
    SELECT pn, y FROM (SELECT *, count(*) OVER (PARTITION BY y) AS n, max(o) OVER (PARTITION BY y) AS any_o FROM k) WHERE n >= 2 OR any_o""")
def min_class_size(spark, sf):
    p = views.parts(spark, sf).select("pn", F.concat("p_name", "p_brand", "p_type").alias("y"), (F.col("p_partkey") % 97 == 0).alias("o"))
    return entities.min_class_size(p, "y", F.col("o")).select("pn", "y")


@query(f"""WITH {PARTS}, o AS (SELECT pn, 'OLD' AS c FROM parts WHERE p_partkey % 5 = 0), n AS (SELECT pn, 'NEW' AS c FROM parts WHERE p_partkey % 15 = 0 OR p_partkey % 7 = 0)
    SELECT coalesce(n.pn, o.pn) AS pn, coalesce(n.c, o.c) AS cluster FROM o FULL JOIN n ON o.pn = n.pn""")
def override_upsert(spark, sf):
    p = views.parts(spark, sf)
    old = p.filter("p_partkey % 5 = 0").select("pn", F.lit("OLD").alias("cluster"))
    return entities.upsert_overrides(old, p.filter("p_partkey % 15 = 0 OR p_partkey % 7 = 0").select("pn", F.lit("NEW").alias("cluster")))


@query(f"""WITH {PHRASES}, o AS (SELECT pn, CASE WHEN p_size % 20 = 0 THEN 'ODD' ELSE label END AS g FROM parts WHERE p_partkey % 9 = 0)
    SELECT phrase, min(g) AS "group" FROM phrases JOIN o USING (pn) GROUP BY phrase HAVING count(DISTINCT g) = 1""")
def phrase_corrections(spark, sf):
    p = views.phrases(spark, sf)
    fixes = p.filter("p_partkey % 9 = 0").select("pn", F.when(F.col("p_size") % 20 == 0, "ODD").otherwise(F.col("label")).alias("group"))
    return entities.phrase_corrections(p, fixes, "pn", "phrase", "group")


@query(f"""WITH {RECORDS} SELECT row_id, pn, coalesce(CASE WHEN p_size > 5 THEN label END, 'NEEDS_REVIEW') AS cluster FROM records""")
def spread_to_records(spark, sf):
    p = views.parts(spark, sf).filter("p_size > 5").select("pn", F.col("label").alias("cluster"))
    return entities.spread_to_records(views.records(spark, sf).select("row_id", "pn"), p, "pn", "cluster")


# Texts


@query(f"WITH {PHRASES} SELECT pn, matdesc, phrase FROM phrases")
def type_phrase(spark, sf):
    return views.phrases(spark, sf).select("pn", "matdesc", "phrase")


PHRASE_CASES = ["helical spring | SPRING; IBO2", "valve body | VALVE BODY; A-V/T/42/TG11", "rubber gasket | SEPARATING SEAL; D 25.4", "x | O-RING 12.5X1.5", "NUT ASSY_x000D_", "12345", "", "PISTON L=24,5MM STD"]
VALUES = lambda cases: ", ".join("('" + c.replace("'", "''") + "')" for c in cases)


@query(f"SELECT s, {PHRASE_SQL.replace('{0}', 's')} AS phrase FROM (VALUES {VALUES(PHRASE_CASES)}) t(s)")
def type_phrase_cases(spark, sf):
    return spark.createDataFrame([(s,) for s in PHRASE_CASES], "s string").select("s", text.type_phrase(F.col("s")).alias("phrase"))


@query(f"WITH {PARTS} SELECT pn, p_name AS readable FROM parts")
def readable_description(spark, sf):
    return views.parts(spark, sf).select("pn", text.readable_description(F.concat(F.col("pn"), F.lit(" - "), F.col("matdesc")), F.col("pn")).alias("readable"))


@query(f"""WITH {PARTS} SELECT pn, 'desc="' || matdesc || '" | hs6=' || CAST(p_size AS VARCHAR) || ' (' || left(p_type, 40) || ') | material_field="' || p_brand || '" | bu=' || p_type AS card FROM parts""")
def part_card(spark, sf):
    row = {"desc": F.col("matdesc"), "hs6": F.col("p_size").cast("string"), "hs6_text": F.col("p_type"), "material_field": F.col("p_brand"), "bu": F.col("p_type")}
    return views.parts(spark, sf).select("pn", text.part_card(row).alias("card"))


@query(f"""WITH {PARTS} SELECT pn, concat_ws(' | ', matdesc, CASE WHEN p_size % 2 = 0 THEN p_brand END) AS t FROM parts""")
def embedding_text(spark, sf):
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("NaN")
    return views.parts(spark, sf).select("pn", text.embedding_text(F.col("matdesc"), brand).alias("t"))


@query(f"""WITH {PARTS} SELECT pn, sha256('tfidf' || chr(1) || matdesc) AS cache_key, left(md5(list_aggregate(list_sort([p_brand, p_type]), 'string_agg', '-')), 8) AS feature_hash FROM parts""")
def cache_keys(spark, sf):
    return views.parts(spark, sf).select("pn", features.text_cache_key("tfidf", F.col("matdesc")).alias("cache_key"), text.feature_hash(F.array("p_brand", "p_type")).alias("feature_hash"))


@query(f"""WITH {PARTS}, c AS (SELECT pn, substr(pn,1,1) AS a, substr(pn,2,3) AS b, substr(pn,5,3) AS c, substr(pn,8) AS d FROM parts)
    SELECT pn, concat_ws('/', pn, concat_ws(' ',a,b,c,d), concat_ws('.',a,b,c,d), concat_ws('.',a||b,c,d), concat_ws(' ',a||b,c,d)) AS variants FROM c""")
def pn_variants(spark, sf):
    return views.parts(spark, sf).select("pn", F.array_join(text.pn_variants(F.col("pn")), "/").alias("variants"))


@query("""SELECT item_id, doc_id FROM (SELECT item_id, upper(regexp_replace(text, '[\\s\\-_.]', '', 'g')) AS k FROM benchmark) b
    JOIN (SELECT doc_id, upper(regexp_replace(text, '[\\s\\-_.]', '', 'g')) AS t FROM documents) d ON contains(t, k)""")
def mentions_pn(spark, sf):
    """A theta join by containment of whole texts; Spark broadcasts the side that its size allows."""
    keys = load(spark, sf, "benchmark").select("item_id", text.bare_upper(F.col("text")).alias("k"))
    docs = load(spark, sf, "documents").select("doc_id", text.bare_upper(F.col("text")).alias("t"))
    return docs.join(keys, F.contains("t", "k")).select("item_id", "doc_id")


@query(f"""WITH {PARTS} SELECT pn, (CASE WHEN p_size % 2 = 0 THEN 10 ELSE 0 END + 3 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 0 END)::INTEGER AS score FROM parts""")
def title_score(spark, sf):
    shown = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", F.substring("pn", 1, 4), F.substring("pn", 5, 3), F.substring("pn", 8, 3))).otherwise("none")
    title = F.concat(F.lit("Datasheet of "), shown, F.when(F.col("p_size") % 3 == 0, F.lit(" DRAWING")).otherwise(""))
    return views.parts(spark, sf).select("pn", text.title_score(title, text.pn_variants(F.col("pn"))).alias("score"))


@query("""WITH n AS (SELECT (range - 1)::BIGINT AS n FROM range(1, 20001)) SELECT n, CASE WHEN n < 26 THEN chr((65 + n)::INTEGER)
    WHEN n < 702 THEN chr((65 + (n - 26) // 26)::INTEGER) || chr((65 + (n - 26) % 26)::INTEGER)
    WHEN n < 18278 THEN chr((65 + (n - 702) // 676)::INTEGER) || chr((65 + ((n - 702) // 26) % 26)::INTEGER) || chr((65 + (n - 702) % 26)::INTEGER)
    ELSE chr((65 + (n - 18278) // 17576)::INTEGER) || chr((65 + ((n - 18278) // 676) % 26)::INTEGER) || chr((65 + ((n - 18278) // 26) % 26)::INTEGER) || chr((65 + (n - 18278) % 26)::INTEGER) END AS letter FROM n""")
def spreadsheet_letters(spark, sf):
    return spark.range(0, 20000).select(F.col("id").alias("n"), text.letters(F.col("id")).alias("letter"))


@query("""SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}'), lambda t: lower(t) NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """)), lambda t: lower(t)) AS tokens FROM documents""")
def name_tokens(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.name_tokens(F.col("text")).alias("tokens"))


NAME_CASES = [("BALL BEARING", "BALL"), ("GASKET SEAL", "SEAL"), ("NEW: SEALING RING", "SEAL"), ("VALVE", "PUMP"), ("THE SET", "SET")]


@query("SELECT p, t, h FROM (VALUES ('BALL BEARING','BALL',true), ('GASKET SEAL','SEAL',true), ('NEW: SEALING RING','SEAL',true), ('VALVE','PUMP',false), ('THE SET','SET',false)) x(p, t, h)")
def name_hits(spark, sf):
    return spark.createDataFrame(NAME_CASES, "p string, t string").select("p", "t", text.name_hit(F.col("p"), F.col("t")).alias("h"))


@query(f"""SELECT doc_id, regexp_matches(text, '{text.HAS_WEIGHT}') AS w, regexp_matches(text, '{text.HAS_DIMENSIONS}') AS d FROM documents""")
def completeness(spark, sf):
    there = F.col("text").isNotNull()
    return load(spark, sf, "documents").select("doc_id", F.when(there, text.has_weight(F.col("text"))).alias("w"), F.when(there, text.has_dimensions(F.col("text"))).alias("d"))


# Numbers and units

LENGTH_CASES = ["120 mm", "12.5mm", "15 cm", "1.2 m", "1 in", '4"', "3.5 inches", "1 1/2 in", "3/8 in", "1/4 in", "2 ft", "10cm", "8.5in", "65mm", "10 - 12 mm", "1,200 mm", "12,5 cm", "0 mm", "none", "", "5 minutes", "3/0 in", "7 yd", "50 µm"]
LENGTH_WANT = [120, 12.5, 150, 1200, 25.4, 101.6, 88.9, 38.1, 9.53, 6.35, 609.6, 100, 215.9, 65, 11, 1200, 125, None, None, None, 5, 76.2, 6400.8, 0.05]
WEIGHT_CASES = ["350 g", "2.5 kg", "500 mg", "1 lb", "10 oz", "2 lbs 4 oz", "2kg", "78g", "1 t", "12,5 kg", "no", "3 pounds"]


def unit_sql(column: str, table: dict) -> str:
    """The longest spelling without letters beside it, in SQL without look-around."""
    whens = []
    for u, f in units.spellings(table):
        test = f"contains({column}, '{u.replace(chr(39), chr(39) * 2)}')" if u in "\"'" else f"regexp_matches({column}, '(^|[^a-zA-Z]){u}([^a-zA-Z]|$)')"
        whens.append(f"WHEN {test} THEN {f!r}::DOUBLE")
    return f"CASE {' '.join(whens)} ELSE 1.0::DOUBLE END"


POINT_SQL = r"CASE WHEN contains(c, ',') AND (contains(c, '.') OR (length(c) - length(replace(c, ',', '')) = 1 AND regexp_matches(c, '\d[^,]*,\d{3}(\D|$)'))) THEN replace(c, ',', '') ELSE replace(c, ',', '.') END"
NUMBER_SQL = r"""coalesce(
    CASE WHEN regexp_matches(f, '^\d+\s+\d+/\d+$') THEN regexp_extract(f, '^(\d+)', 1)::DOUBLE + regexp_extract(f, '\s(\d+)/', 1)::DOUBLE / nullif(regexp_extract(f, '/(\d+)$', 1)::DOUBLE, 0) END,
    CASE WHEN regexp_matches(f, '^\d+/\d+$') THEN regexp_extract(f, '^(\d+)', 1)::DOUBLE / nullif(regexp_extract(f, '/(\d+)$', 1)::DOUBLE, 0) END,
    CASE WHEN regexp_matches(p, '\d\s*(-|–|to|\.\.)\s*\d') THEN (regexp_extract(p, '(\d+(\.\d+)?)\s*(-|–|to|\.\.)\s*(\d+(\.\d+)?)', 1)::DOUBLE + regexp_extract(p, '(\d+(\.\d+)?)\s*(-|–|to|\.\.)\s*(\d+(\.\d+)?)', 4)::DOUBLE) / 2 END,
    try_cast(nullif(regexp_extract(p, '\d+(\.\d+)?'), '') AS DOUBLE))"""


def measured_sql(cases: list[str], table: dict, out: str, first: str = "NULL") -> str:
    return f"""WITH t AS (SELECT s, lower(trim(s)) AS c FROM (VALUES {VALUES(cases)}) x(s)), d AS (SELECT *, {POINT_SQL} AS p FROM t),
        e AS (SELECT *, trim(regexp_replace(p, '[a-zA-Z"''µ]+', '', 'g')) AS f FROM d), n AS (SELECT *, {NUMBER_SQL} AS n, {unit_sql('c', table)} AS u FROM e)
        SELECT s, coalesce({first}, CASE WHEN n > 0 THEN round(n * u, 2) END) AS {out} FROM n"""


@query(measured_sql(LENGTH_CASES, units.LENGTHS, "mm"))
def unit_length(spark, sf):
    return spark.createDataFrame([(s,) for s in LENGTH_CASES], "s string").select("s", units.length_mm(F.col("s")).alias("mm"))


BOTH = r"CASE WHEN regexp_matches(c, '\d\s*(lbs?|pounds?)\s*\d+(\.\d+)?\s*(oz|ounces?)') THEN round(regexp_extract(c, '(\d+(\.\d+)?)\s*(lbs?|pounds?)', 1)::DOUBLE * 453.59237 + regexp_extract(c, '(\d+(\.\d+)?)\s*(oz|ounces?)', 1)::DOUBLE * 28.349523, 2) END"


@query(measured_sql(WEIGHT_CASES, units.WEIGHTS, "g", BOTH))
def unit_weight(spark, sf):
    return spark.createDataFrame([(s,) for s in WEIGHT_CASES], "s string").select("s", units.weight_g(F.col("s")).alias("g"))


@query(f"""WITH {RECORDS}, s AS (SELECT row_id, CAST(l_quantity AS BIGINT) AS q, p_size, [' mm', ' cm', 'in', ' kg'][1 + p_size % 4] AS u FROM records)
    SELECT row_id, round(q * CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 WHEN 2 THEN 25.4 ELSE 1.0 END::DOUBLE, 2) AS mm,
    round(q * CASE p_size % 4 WHEN 3 THEN 1000.0 ELSE 1.0 END::DOUBLE, 2) AS g FROM s""")
def unit_columns(spark, sf):
    """The normaliser over a whole table of texts."""
    u = F.element_at(F.array(*[F.lit(x) for x in (" mm", " cm", "in", " kg")]), (F.col("p_size") % 4 + 1).cast("int"))
    s = F.concat(F.col("l_quantity").cast("long").cast("string"), u)
    return views.records(spark, sf).select("row_id", units.length_mm(s).alias("mm"), units.weight_g(s).alias("g"))


TRIPLES = ["182 x 35 x 30 mm", "10 x 5 x 2 in", "182x35x30mm", "1.5*2*3 cm", "no sizes", "7 x 8", "4×5×6"]


@query("SELECT * FROM (VALUES ('182 x 35 x 30 mm',182.0::DOUBLE,35.0::DOUBLE,30.0::DOUBLE), ('10 x 5 x 2 in',254.0,127.0,50.8), ('182x35x30mm',182.0,35.0,30.0), ('1.5*2*3 cm',15.0,20.0,30.0), ('no sizes',NULL,NULL,NULL), ('7 x 8',NULL,NULL,NULL), ('4×5×6',4.0,5.0,6.0)) t(s, length, width, height)")
def triple_dims(spark, sf):
    t = units.triple_mm(F.col("s"))
    return spark.createDataFrame([(s,) for s in TRIPLES], "s string").select("s", *[t[n].alias(n) for n in ("length", "width", "height")])


SHEETS = {
    "sensor": "Technical Data\nLength of sensor head: 65 mm\nDiameter of sensor pole: 18.0 mm\nOverall housing dimensions: 65 x 24 x 18 mm\nNet Weight: 78 g (0.078 kg)\nGross Weight: 95 g",
    "injector": "Overall length: 182 mm\nWidth 35 mm\nheight: 30 mm\nWeight: 490 g",
    "bracket": "Size 8.5 x 4.25 x 1.75 in\nweight 2 lbs 3 oz",
    "rod": "Länge; Długość: 120 mm, średnica 8 mm",
    "nothing": "Nothing to see, 5 pieces",
}


@query("""SELECT * FROM (VALUES ('sensor', true, 65.0::DOUBLE, 24.0::DOUBLE, 18.0::DOUBLE, 78.0::DOUBLE, 28.08::DOUBLE, '65.0 x 24.0 x 18.0 mm', 0.9::DOUBLE),
    ('injector', true, 182.0, 35.0, 30.0, 490.0, 191.1, '182.0 x 35.0 x 30.0 mm', 0.85), ('bracket', true, 215.9, 107.95, 44.45, 992.23, 1035.97, '215.9 x 107.95 x 44.45 mm', 0.9),
    ('rod', true, 120.0, 8.0, 8.0, NULL, 7.68, '120.0 x 8.0 x 8.0 mm', 0.85), ('nothing', false, NULL, NULL, NULL, NULL, NULL, NULL, 0.0)) t(sheet, found, l, w, h, g, cm3, shown, confidence)""")
def regex_extract(spark, sf):
    raw = dimensions.extract(spark.createDataFrame(list(SHEETS.items()), "sheet string, text string"), "text")
    m = units.metric_record(*[F.col(f"raw.{f}") for f in ("raw_length", "raw_width", "raw_height", "raw_diameter", "raw_weight")])
    return raw.withColumn("m", m).select("sheet", "raw.found", F.col("m.length_mm").alias("l"), F.col("m.width_mm").alias("w"), F.col("m.height_mm").alias("h"), F.col("m.weight_g").alias("g"), F.col("m.volume_cm3").alias("cm3"), F.col("m.dimension_string_mm").alias("shown"), "raw.confidence")


@query("SELECT s, n FROM (VALUES ('0,015', 0.015::DOUBLE), (' 12.5 ', 12.5), ('?', NULL), ('', NULL), ('nan1', NULL), ('7', 7.0)) t(s, n)")
def european_number(spark, sf):
    return spark.createDataFrame([(s,) for s in ("0,015", " 12.5 ", "?", "", "nan1", "7")], "s string").select("s", units.european_number(F.col("s")).alias("n"))


# Ranking


@query(f"""WITH {PARTS}, n AS (SELECT label AS cluster, count(*) AS n FROM parts GROUP BY 1)
    SELECT cluster, n, chr((64 + row_number() OVER (ORDER BY n DESC, cluster))::INTEGER) AS letter FROM n""")
def cluster_letters(spark, sf):
    return ranking.cluster_letters(views.parts(spark, sf).withColumnRenamed("label", "cluster"), "cluster")


@query(f"""WITH {PARTS}, n AS (SELECT p_brand AS g, count(*) AS n FROM parts GROUP BY 1) SELECT g, n, 'NEW_' || row_number() OVER (ORDER BY n DESC, g) AS name FROM n""")
def new_numbering(spark, sf):
    return ranking.new_group_names(views.parts(spark, sf).withColumnRenamed("p_brand", "g"), "g")


@query(f"""WITH {PARTS}, n AS (SELECT p_name AS g, split_part(p_name, ' ', 2) AS name, count(*) AS n FROM parts GROUP BY ALL)
    SELECT g, name, n, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || row_number() OVER (PARTITION BY name ORDER BY n DESC, g) || ')' ELSE name END AS unique_name FROM n""")
def name_collisions(spark, sf):
    n = views.parts(spark, sf).groupBy(F.col("p_name").alias("g")).agg(F.count("*").alias("n"))
    return ranking.tell_apart(n.withColumn("name", F.split_part("g", F.lit(" "), F.lit(2))), "g", "name", "n").select("g", "name", "n", "unique_name")


@query(f"""WITH {NEAREST}, r AS (SELECT *, avg((label = cluster)::INTEGER) OVER (ORDER BY margin DESC, vec_id ROWS UNBOUNDED PRECEDING) AS a FROM nearest)
    SELECT round(coalesce(min(margin) FILTER (a >= 0.98), max(margin), 0), 6) AS threshold FROM r""")
def confidence_threshold(spark, sf):
    n = stored(views.nearest(spark, sf)).withColumn("correct", F.col("label") == F.col("cluster"))
    return ranking.accuracy_threshold(n, "margin", "correct", "vec_id", 0.98).select(R6(F.col("threshold")).alias("threshold"))


@query(f"WITH {NEAREST} SELECT round(quantile_cont(margin, 0.15), 6) AS q15, round(quantile_cont(margin, 0.5), 6) AS q50 FROM nearest")
def margin_quantiles(spark, sf):
    return views.nearest(spark, sf).agg(R6(F.percentile("margin", F.lit(0.15))).alias("q15"), R6(F.percentile("margin", F.lit(0.5))).alias("q50"))


@query(f"""WITH {PARTS}, n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM parts),
    f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(pn || '-0'), pn) - 1) % greatest(2, least(5, (SELECT min(n) FROM n WHERE n >= 5))) AS fold FROM n WHERE n >= 5)
    SELECT label, fold::INTEGER AS fold, count(*) AS n FROM f GROUP BY ALL""")
def fold_sizes(spark, sf):
    return ranking.stratified_folds(views.parts(spark, sf), "label", "pn").filter("fold IS NOT NULL").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, n AS (SELECT label, count(*) AS n FROM parts GROUP BY 1) SELECT label, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS r FROM n) WHERE (r - 1) % 4 = 0""")
def hidden_classes(spark, sf):
    return ranking.every_kth_class(views.parts(spark, sf), "label", 0.25)


@query(f"WITH {PARTS} SELECT pn, ((row_number() OVER (ORDER BY pn) - 1) // 60)::BIGINT AS batch FROM parts")
def fixed_batches(spark, sf):
    return ranking.fixed_batches(views.parts(spark, sf), "pn", 60).select("pn", "batch")


@query(f"WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY pn ORDER BY row_id) AS r FROM records) SELECT pn, row_id FROM r WHERE r = 1")
def first_occurrence(spark, sf):
    return ranking.first_of_each(views.records(spark, sf), F.col("pn"), "row_id").select("pn", "row_id")


@query(f"""WITH {PARTS} SELECT pn, description, cluster_name, confidence FROM (SELECT pn, p_name AS description, label AS cluster_name, p_retailprice AS confidence, p_size % 2 = 0 AS needs_review FROM parts)
    WHERE needs_review AND (contains(lower(pn), 'ge') OR contains(lower(description), 'ge') OR contains(lower(cluster_name), 'ge')) ORDER BY confidence, pn LIMIT 300""")
def review_queue(spark, sf):
    rows = views.parts(spark, sf).select("pn", F.col("p_name").alias("description"), F.col("label").alias("cluster_name"), F.col("p_retailprice").alias("confidence"), (F.col("p_size") % 2 == 0).alias("needs_review"))
    return ranking.review_queue(rows, search="ge", flagged=True).drop("needs_review")


@query(f"""WITH {RECORDS} SELECT p_name AS cluster, count(*) AS n, round(avg(l_quantity), 6) AS mean_confidence, count(*) FILTER (l_returnflag = 'A') AS "A",
    count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'X') AS "X" FROM records GROUP BY 1""")
def cluster_source_pivot(spark, sf):
    r = views.records(spark, sf).withColumnRenamed("p_name", "cluster")
    return case_sensitive(ranking.cluster_summary(r, "cluster", "l_quantity", "l_returnflag", ["A", "N", "X"]).withColumn("mean_confidence", R6(F.col("mean_confidence"))))


@query(f"""WITH l AS ({LINES_SQL}), h AS (SELECT *, regexp_matches(line, '{EDGE_SQL}') AS hit FROM l),
    k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, pos < 30 OR max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS kept FROM h),
    r AS (SELECT *, sum(kept::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM k)
    SELECT doc_id, pos::INTEGER AS pos, line FROM r WHERE n <= 40 OR (kept AND r <= 40)""")
def relevant_lines(spark, sf):
    return ranking.relevant_lines(load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[.,] ", "\n").alias("text")), "doc_id", "text", text.DIMENSION_LINE, most=40)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, pos < 3 OR max(contains(line, 'the')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS kept FROM l),
    r AS (SELECT *, sum(kept::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM k)
    SELECT doc_id, pos::INTEGER AS pos, line FROM r WHERE n <= 8 OR (kept AND r <= 8)""")
def lines_around_hits(spark, sf):
    return ranking.relevant_lines(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", "the", most=8, head_lines=3)


# Evaluation


@query(f"WITH {NEAREST} SELECT label AS y, cluster AS c, count(*) AS n FROM nearest GROUP BY ALL")
def contingency(spark, sf):
    return evaluation.contingency(views.nearest(spark, sf), "label", "cluster")


PAIRS = f"""WITH {NEAREST}, t AS (SELECT label AS y, cluster AS c, count(*)::DOUBLE AS n FROM nearest GROUP BY ALL),
    s AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT sum(n * n) FROM t) AS ab, (SELECT sum(a * a) FROM (SELECT sum(n) AS a FROM t GROUP BY y)) AS a, (SELECT sum(b * b) FROM (SELECT sum(n) AS b FROM t GROUP BY c)) AS b),
    p AS (SELECT ab - n AS tp, b - ab AS fp, a - ab AS fn, n * n - (ab - n) - (b - ab) - (a - ab) - n AS tn FROM s)"""


@query(PAIRS + " SELECT round(tp / (tp + fp), 6) AS pair_precision, round(tp / (tp + fn), 6) AS pair_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS pair_f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS rand, round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM p")
def pair_metrics(spark, sf):
    m = evaluation.pair_metrics(evaluation.contingency(views.nearest(spark, sf), "label", "cluster"))
    return m.select(*[R6(F.col(c)).alias(c) for c in m.columns])


@query(f"""WITH {NEAREST}, t AS (SELECT label AS y, cluster AS c, count(*)::DOUBLE AS n FROM nearest GROUP BY ALL), k AS (SELECT sum(n) AS n FROM t),
    hy AS (SELECT -sum(a / n * ln(a / n)) AS h FROM (SELECT sum(n) AS a FROM t GROUP BY y), k), hc AS (SELECT -sum(b / n * ln(b / n)) AS h FROM (SELECT sum(n) AS b FROM t GROUP BY c), k),
    hb AS (SELECT -sum(t.n / k.n * ln(t.n / k.n)) AS h FROM t, k)
    SELECT round(2 * (hy.h + hc.h - hb.h) / (hy.h + hc.h), 6) AS nmi, round((hy.h + hc.h - hb.h) / hy.h, 6) AS homogeneity, round((hy.h + hc.h - hb.h) / hc.h, 6) AS completeness, round(2 * (hy.h + hc.h - hb.h) / (hy.h + hc.h), 6) AS v_measure FROM hy, hc, hb""")
def nmi_v(spark, sf):
    m = evaluation.entropy_metrics(evaluation.contingency(views.nearest(spark, sf), "label", "cluster"))
    return m.select(*[R6(F.col(c)).alias(c) for c in m.columns])


PURITY = f"""WITH {PARTS}, t AS (SELECT label AS y, p_brand AS c, count(*) AS n FROM parts GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, c) AS r FROM t),
    m AS (SELECT y, sum(n)::BIGINT AS n, count(*) AS n_clusters, min(c) FILTER (r = 1) AS dominant, round(max(n) / sum(n), 6) AS purity, string_agg(c || ':' || n, ', ' ORDER BY r) FILTER (r <= 4) AS distribution FROM r GROUP BY y)"""


@query(PURITY + " SELECT * FROM m")
def purity_map(spark, sf):
    return evaluation.purity_map(evaluation.contingency(views.parts(spark, sf), "label", "p_brand")).withColumn("purity", R6(F.col("purity")))


@query(PURITY + " SELECT * FROM m WHERE n >= 20 ORDER BY purity, y LIMIT 3")
def worst_classes(spark, sf):
    return evaluation.worst_classes(purity_map(spark, sf), most=3)


@query()
def hungarian(spark, sf):
    return evaluation.matching_accuracy(spark, evaluation.contingency(views.nearest(spark, sf), "label", "cluster"))


@query(f"""WITH {NEAREST} SELECT round(avg((label = cluster)::INTEGER), 6) AS accuracy, round(avg((margin >= 0.1)::INTEGER), 6) AS coverage, round(avg((label = cluster)::INTEGER) FILTER (margin >= 0.1), 6) AS accepted_accuracy FROM nearest""")
def accepted_quality(spark, sf):
    q = hybrid.quality(views.nearest(spark, sf).withColumnRenamed("cluster", "predicted"), "label", 0.1)
    return q.select(*[R6(F.col(c)).alias(c) for c in q.columns])


@query(f"""WITH {PARTS}, n AS (SELECT p_brand AS g, split_part(p_name, ' ', 2) AS t, count(*) AS m, min(CASE WHEN p_brand < 'Brand#3' THEN 'NEW: GEARBOX' ELSE 'NEW: BOLT' END) AS p FROM parts GROUP BY ALL),
    b AS (SELECT g, arg_min(t, (-m, t)) AS t, sum(m) AS m, min(p) AS p FROM n GROUP BY g), h AS (SELECT *, ((p = 'NEW: BOLT' AND t = 'bolt') OR (p = 'NEW: GEARBOX' AND t = 'gear'))::INTEGER AS h FROM b)
    SELECT round(sum(h * m) / sum(m), 6) AS by_parts, round(avg(h), 6) AS by_groups FROM h""")
def naming_accuracy(spark, sf):
    p = views.parts(spark, sf).select(F.col("p_brand").alias("g"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("t"), F.when(F.col("p_brand") < "Brand#3", "NEW: GEARBOX").otherwise("NEW: BOLT").alias("p"))
    m = evaluation.naming_accuracy(p, "g", "p", "t", text.name_hit)
    return m.select(*[R6(F.col(c)).alias(c) for c in m.columns])


# Features


def tfidf_sql(terms: str, vocabulary: int) -> str:
    return f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), x AS ({terms}), tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
        v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {vocabulary}),
        w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


WORD_TERMS = r"""SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{N}_]{2,}') AS w FROM d)"""
CHAR_TERMS = r"""SELECT doc_id, unnest(list_transform(range(1, greatest(2, length(w) - n + 2)), lambda i: substr(w, i, n))) AS term FROM
    (SELECT doc_id, ' ' || unnest(list_filter(string_split(regexp_replace(t, '\s+', ' ', 'g'), ' '), lambda w: w <> '')) || ' ' AS w FROM d), range(3, 6) r(n) WHERE n = 3 OR length(w) >= n"""


@query(tfidf_sql(WORD_TERMS, 10_000))
def tfidf_word(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return features.tfidf(d, "doc_id", features.word_terms(F.col("text")), 10_000).withColumn("weight", R6(F.col("weight")))


@query(tfidf_sql(CHAR_TERMS, 20_000))
def tfidf_char(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return features.char_tfidf(d, "doc_id", F.col("text"), 20_000, digits=6)


CTFIDF = """WITH x AS (SELECT lang || '/' || source AS g, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}'), lambda t: lower(t)), lambda t: t NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """))) AS term FROM documents),
    n AS (SELECT g, term, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT count(DISTINCT lang || '/' || source) AS k FROM documents),
    s AS (SELECT g, term, n / sum(n) OVER (PARTITION BY g) * ln(1 + (SELECT k FROM k)::DOUBLE / count(*) OVER (PARTITION BY term)) AS score FROM n)"""


@query(CTFIDF + " SELECT g, term, round(score, 9) AS score FROM s")
def ctfidf_terms(spark, sf):
    d = load(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("g"), "text")
    return features.term_scores(d, "g", "text").withColumn("score", F.round("score", 9))


@query()
def ctfidf_names(spark, sf):
    d = load(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("g"), "text")
    named = features.group_names(d, "g", "text")
    sizes = d.groupBy("g").agg(F.count("*").alias("n"))
    return ranking.tell_apart(named.join(sizes, "g"), "g", "name", "n")


@query(f"""WITH {CENTROIDS} SELECT vec_id, vecs.label AS label, round(list_cosine_similarity(v, m), 6) AS confidence FROM vecs JOIN means ON vecs.label = means.label""")
def centroid_confidence(spark, sf):
    return clustering.centroid_confidence(views.vectors(spark, sf), "label", "v").select("vec_id", "label", R6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {CENTROIDS}, c AS (SELECT vec_id, vecs.label AS label, round(list_cosine_similarity(v, m), 9) AS s FROM vecs JOIN means ON vecs.label = means.label)
    SELECT label, vec_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM c) WHERE rank <= 5""")
def nearest_samples(spark, sf):
    c = clustering.centroid_confidence(views.vectors(spark, sf), "label", "v").withColumn("s", F.round("confidence", 9))
    return ranking.nearest_to_centroid(c, "label", "vec_id", "s").select("label", "vec_id", "rank")


@query(f"""WITH {CENTROIDS}, c AS (SELECT vec_id, round(list_cosine_similarity(v, m), 9) AS s FROM vecs JOIN means ON vecs.label = means.label)
    SELECT vec_id, s < (SELECT quantile_cont(s, 0.15) FROM c) AS needs_review FROM c""")
def review_flags(spark, sf):
    c = clustering.centroid_confidence(views.vectors(spark, sf), "label", "v").withColumn("confidence", F.round("confidence", 9))
    return clustering.flag_least_certain(c).select("vec_id", "needs_review")


@query(f"""WITH {PARTS}, l AS (SELECT pn, log10(greatest(p_size::DOUBLE, 1e-4)) AS a, log10(greatest(p_retailprice, 1e-4)) AS b FROM parts),
    z AS (SELECT pn, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM l)
    SELECT pn, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM z""")
def physics_block(spark, sf):
    p = views.parts(spark, sf).select("pn", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return features.standard_physics(p, ["size", "price"]).select("pn", R6(F.expr("physics[0]")).alias("a"), R6(F.expr("physics[1]")).alias("b"))


@query()
def svd_features(spark, sf):
    p = views.parts(spark, sf)
    rows, _ = features.sparse_rows(features.tfidf(p.select("pn", "matdesc"), "pn", F.concat(features.word_terms(F.col("matdesc")), features.char_terms(F.col("matdesc"))), 20_000), "pn")
    return features.svd(rows, "pn", 50)


# Clustering and the layered classifier


@query()
def agglomerative(spark, sf):
    return clustering.cluster(views.vectors(spark, sf), "vec_id", "v", 0.6)


@query()
def agglomerative_rounds(spark, sf):
    return clustering.cluster_rounds(views.vectors(spark, sf), "vec_id", "v", 0.6, by="label")


def part_vectors(spark, sf, columns: list[str], weights: dict[str, float]):
    """The given columns of each part, and as v its blocks by weight: description (d), phrase (f)
    and physics. Only v is kept of them."""
    p = views.phrases(spark, sf)
    rows, _ = features.sparse_rows(features.tfidf(p.select("pn", "matdesc"), "pn", features.word_terms(F.col("matdesc")), 10_000), "pn")
    phrase_rows, _ = features.sparse_rows(features.tfidf(p.select("pn", "phrase"), "pn", features.char_terms(F.col("phrase")), 20_000), "pn")
    physics = features.standard_physics(p.select("pn", F.col("p_size").cast("double").alias("size")), ["size"])
    met = p.join(features.svd(rows, "pn", 40).withColumnRenamed("features", "d"), "pn").join(features.svd(phrase_rows, "pn", 40).withColumnRenamed("features", "f"), "pn").join(physics.select("pn", "physics"), "pn")
    return stored(met.select(*columns, features.blocks(*[(F.col(c), w) for c, w in weights.items()]).alias("v")))


@query()
def hybrid_classify(spark, sf):
    p = part_vectors(spark, sf, ["pn", "matdesc", "label", "p_partkey"], {"d": 0.7, "f": 0.3, "physics": 0.0})
    known = p.filter("label != 'tbd'")
    fixed = p.filter("p_partkey % 97 = 0").select("pn", F.lit("FIXED").alias("cluster"))
    model = hybrid.HybridClassifier(hybrid.Settings(folds=2)).fit(known, "pn", "v", "label", fixed)
    return model.predict(p.select("pn", "matdesc", "v"), "pn", "v", fixed).drop("v")


@query()
def discover_types(spark, sf):
    p = part_vectors(spark, sf, ["pn", "phrase", "p_partkey"], {"f": 0.5, "d": 0.2, "physics": 0.3})
    fixed = p.filter("p_partkey % 97 = 0").select("pn", F.lit("FIXED").alias("cluster"))
    return clustering.discover_types(p, "pn", "phrase", "v", 0.75, overrides=fixed).select("pn", "phrase", "type_group", "source", "confidence", "needs_review")


# Datasheets


@query("""WITH n AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS now) SELECT event_id, user_id FROM events, n WHERE event_type <> 'error' AND epoch(now) - epoch(ts) < 1209600""")
def cache_ttl(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("fetched_at"), F.lit("text").alias("text"), (F.col("event_type") != "error").alias("has_data"))
    return dimensions.cache_hits(e, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_id", "user_id")


EVIDENCE = [
    ("A", 1, "extracted", 0.9, "wiki", "u1", "10 mm", "", "", "", ""), ("A", 2, "extracted", 0.8, "web", "u2", "11 mm", "5 mm", "", "", "3 g"), ("A", 3, "extracted", 0.9, "mock", "u3", "", "", "7 mm", "", ""),
    ("B", 1, "regex_fallback", 0.95, "wiki", "u1", "1 mm", "", "", "", ""), ("B", 2, "extracted", 0.6, "web", "u2", "2 mm", "", "", "", ""),
    ("C", 1, "estimated", 0.4, "wiki", "u1", "", "", "", "", "1 g"), ("C", 2, "estimated", 0.5, "web", "u2", "", "", "", "", "2 g"),
]


@query("""SELECT * FROM (VALUES ('A', 'extracted', 0.9::DOUBLE, 'wiki', '10 mm', '5 mm', NULL, NULL, '3 g', 'u1, u2'), ('B', 'extracted', 0.6, 'web', '2 mm', NULL, NULL, NULL, NULL, 'u2'), ('C', 'estimated', 0.5, 'web', NULL, NULL, NULL, NULL, '2 g', 'u2'))
    t(pn, method, confidence, source_type, raw_length, raw_width, raw_height, raw_diameter, raw_weight, source_url)""")
def provider_fusion(spark, sf):
    e = spark.createDataFrame(EVIDENCE, "pn string, provider_rank int, method string, confidence double, source_type string, source_url string, raw_length string, raw_width string, raw_height string, raw_diameter string, raw_weight string")
    return dimensions.fuse(e)


@query(f"""WITH b AS (SELECT item_id, regexp_extract(text, '[^ ]+') AS pn FROM benchmark), d AS (SELECT doc_id, text, regexp_replace(upper(text), '[\\s\\-_.]', '', 'g') AS t FROM documents WHERE length(text) > 0),
    s AS (SELECT b.pn AS pn, doc_id, CASE WHEN contains(t, regexp_replace(upper(b.pn), '[\\s\\-_.]', '', 'g')) THEN 2 ELSE 0 END + regexp_matches(text, '{text.HAS_WEIGHT}')::INTEGER + regexp_matches(text, '{text.HAS_DIMENSIONS}')::INTEGER AS score FROM (SELECT DISTINCT pn FROM b) b, d),
    r AS (SELECT *, row_number() OVER (PARTITION BY pn ORDER BY score DESC, doc_id) AS rank, max(score >= 2) OVER (PARTITION BY pn) AS seen FROM s)
    SELECT pn, doc_id, score::INTEGER AS score, rank::INTEGER AS rank FROM r WHERE rank <= 2 AND seen""")
def candidate_pages(spark, sf):
    return benchmark_pages(spark, sf, load(spark, sf, "benchmark"))


def benchmark_pages(spark, sf, items):
    """The best documents of each item's part number. A theta join by containment, which tokens
    cannot replace: the list of numbers does not grow with the documents, and is broadcast."""
    keys = items.select(F.regexp_extract("text", "[^ ]+", 0).alias("pn")).distinct()
    d = load(spark, sf, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    return dimensions.best_pages(dimensions.score_all(dimensions.page_facts(d, "text"), keys, "pn"), "pn", "doc_id").select("pn", "doc_id", "score", "rank")


@query("""SELECT page_id, url FROM pages WHERE NOT (contains(lower(url), 'spam-farm') OR contains(lower(url), 'cheap-pills')) AND (contains(lower(url), '.org') OR contains(lower(url), '.net'))""")
def allowed_domains(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url").filter(dimensions.allowed(F.col("url"), ["spam-farm", "cheap-pills"], [".org", ".net"]))


@query(f"""WITH t AS (SELECT doc_id, trim(line) AS line, pos FROM ({LINES_SQL})), k AS (SELECT doc_id, line, min(pos) AS pos FROM t WHERE length(line) >= 3 AND ({WORDS_SQL} OR {NAMED_SQL}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM k) SELECT doc_id, rank::INTEGER AS rank, line FROM r WHERE rank <= 150""")
def attachment_lines(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[.,] ", "\n").alias("text"), F.lit("0265005303").alias("pn"))
    return dimensions.attachment_lines(d, "doc_id", "text", "pn")


SHEET_ROWS = [("P1", 1, "wiki", "u1", "Length 10 mm", True), ("P1", 2, "web", "u2", "Weight 3 kg", True), ("P1", 3, "mock", "u3", "never read", True), ("P2", 1, "wiki", "u1", "", False), ("P2", 2, "web", "u2", "only this", True)]


@query("""SELECT * FROM (VALUES ('P1', '=== SOURCE: WIKI (u1) ===' || chr(10) || 'Length 10 mm' || chr(10) || chr(10) || '=== SOURCE: WEB (u2) ===' || chr(10) || 'Weight 3 kg', 2::BIGINT), ('P2', 'only this', 1)) t(pn, text, n_sources)""")
def merged_texts(spark, sf):
    s = spark.createDataFrame(SHEET_ROWS, "pn string, provider_rank int, source_type string, source_url string, text string, has_data boolean")
    return dimensions.merge_texts(s)


SAMPLES = [("0265005303", "Wheel speed sensor", SHEETS["sensor"]), ("0445110183", "Injector", SHEETS["injector"])]


@query("SELECT * FROM (VALUES ('0 265 005-303', 65.0::DOUBLE, 78.0::DOUBLE), ('0445110183', 182.0, 490.0), ('999', 110.0, 215.0)) t(pn, length_mm, weight_g)")
def sample_datasheets(spark, sf):
    q = spark.createDataFrame([("0 265 005-303", None), ("0445110183", None), ("999", "plug")], "pn string, category string")
    known = spark.createDataFrame(SAMPLES, "pn string, title string, text string")
    return dimensions.process_batch(spark, q, known).select("pn", "metric.length_mm", "metric.weight_g")


@query()
def kv_specs(spark, sf):
    p = load(spark, sf, "pages").select("page_id", html.page_specs("html").alias("specs"), html.page_text("html").alias("t"))
    return p.select("page_id", F.map_entries("specs").alias("specs"), F.size(F.map_keys(text.line_specs(F.col("t")))).alias("n_line_specs"))


@query("""SELECT 'Net weight: 5 kg' AS line, 'net weight' AS k, '5 kg' AS v UNION ALL SELECT 'Color: red', NULL, NULL UNION ALL SELECT 'Height:  10   mm ', 'height', '10 mm'""")
def line_specs(spark, sf):
    d = spark.createDataFrame([("Net weight: 5 kg",), ("Color: red",), ("Height:  10   mm ",)], "line string")
    e = F.map_entries(text.line_specs(F.col("line")))
    return d.select("line", F.get(e, 0)["key"].alias("k"), F.get(e, 0)["value"].alias("v"))


# JSON and the gateway


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS id, event_type AS cluster FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_assignments(spark, sf):
    body = F.concat(F.lit('{"assignments": [{"id": '), F.get_json_object("props", "$.k"), F.lit(', "cluster": "'), F.col("event_type"), F.lit('"}, {"id": "x", "cluster": "y"}, {"id": 3}]}'))
    return load(spark, sf, "events").select("event_id", F.explode(salvage.assignment_rows(body)).alias("r")).select("event_id", "r.id", "r.cluster")


ANSWERS = ['{"assignments": {"1": " seal ", "x": "no", "2": "ball"}}', '[{"i": 1, "g": "rod"}, {"id": "2", "group": "\\"pin\\""}, {"g": "none"}]', '{"1": "a", "2": "b", "3": ', '{"groups": {"4": "cap"}}']


@query("""SELECT * FROM (VALUES (0, '1=SEAL,2=BALL'), (1, '1=ROD,2=PIN'), (2, '1=A,2=B'), (3, '4=CAP')) t(n, groups)""")
def group_answers(spark, sf):
    d = spark.createDataFrame(list(enumerate(ANSWERS)), "n int, a string")
    pairs = F.transform(F.array_sort(F.map_entries(salvage.group_pairs(F.col("a")))), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return d.select("n", F.array_join(pairs, ",").alias("groups"))


BROKEN = ['```json\n{"a": 1}\n```', 'Sure! {"a": [1, 2]} Done.', '{"assignments": [{"id": 1, "cluster": "A"}, {"id": 2, "cluster": "B{"}, {"id": 3, "cl', 'Here: [{"id": 1, "cluster": "A"}, {"id": 2, "cluster": "B{"}, {"id": 3, "cl', '{"1": "X", "2": "Y", "3": "Z", "4": "', "no json"]


@query("""SELECT * FROM (VALUES (0, '{"a": 1}'), (1, '{"a": [1, 2]}'), (2, NULL), (3, '{"assignments": [{"id": 1, "cluster": "A"}, {"id": 2, "cluster": "B{"}]}'), (4, '{"assignments": {"1": "X", "2": "Y", "3": "Z"}}'), (5, NULL)) t(n, got)""")
def salvaged_json(spark, sf):
    return spark.createDataFrame(list(enumerate(BROKEN)), "n int, a string").select("n", salvage.salvage_json("a").alias("got"))


@query(f"""WITH {PARTS} SELECT pn, CASE {' '.join(f"WHEN contains(lower(matdesc), '{w}') THEN '{k}'" for w, k in gateway.KEYWORDS)} ELSE 'OTHER' END AS kind FROM parts""")
def keyword_types(spark, sf):
    return views.parts(spark, sf).select("pn", gateway.keyword_type(F.col("matdesc")).alias("kind"))


@query(f"""WITH {PARTS} SELECT pn, 'desc="' || matdesc || '"' AS card, CASE WHEN p_size % 3 = 0 THEN 'CACHED' ELSE CASE {' '.join(f"WHEN contains(lower(matdesc), '{w}') THEN '{k}'" for w, k in gateway.KEYWORDS)} ELSE 'OTHER' END END AS cluster FROM parts""")
def batch_classify(spark, sf):
    p = views.parts(spark, sf)
    cards = p.select("pn", text.part_card({"desc": F.col("matdesc")}, ("desc",)).alias("card"))
    return gateway.classify_missing(cards, p.filter("p_size % 3 = 0").select("pn", F.lit("CACHED").alias("cluster")), "pn", "card", gateway.KeywordModel())


@query("SELECT count(*) AS calls, sum(length(text))::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens FROM conversations")
def usage_totals(spark, sf):
    return gateway.usage(load(spark, sf, "conversations").select(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))


# End to end: which parts belong together, and how well that is found


@query(f"""WITH {PHRASES}, k AS (SELECT label, CASE WHEN p_partkey % 97 = 0 THEN 'FIXED' ELSE split_part(phrase, ' ', 2) END AS c FROM phrases WHERE label <> 'tbd'),
    t AS (SELECT label AS y, c, count(*)::DOUBLE AS n FROM k GROUP BY ALL), """ + PAIRS.split("GROUP BY ALL),", 1)[1].strip() + " SELECT round(tp / (tp + fp), 6) AS pair_precision, round(tp / (tp + fn), 6) AS pair_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS pair_f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS rand, round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM p")
def typing_quality(spark, sf):
    p = views.phrases(spark, sf)
    fixed = p.filter("p_partkey % 97 = 0").select("pn", F.lit("FIXED").alias("cluster"))
    typed = entities.lookup(p, fixed, "pn", "cluster", "cluster", F.split_part("phrase", F.lit(" "), F.lit(2)))
    m = evaluation.pair_metrics(evaluation.contingency(typed.filter(~text.is_unlabelled(F.col("label"))), "label", "cluster"))
    return m.select(*[R6(F.col(c)).alias(c) for c in m.columns])
