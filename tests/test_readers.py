"""Reading of datasheets, caches of sheets, family pages, rows of workbooks and doubtful answers."""

import json

import pytest
from pyspark.sql import functions as F

import typeloom
from typeloom import cli
from typeloom.functions import text
from typeloom.operators import dimensions, gateway, readers
from typeloom.sources import providers


def told(answers, pictured=None):
    """A reader that answers by part number; pictures give another answer."""

    class Told:  # local, so that it travels to workers by value
        def read(self, question, images):
            pn = question.split("- pn: ")[1].split("\n")[0]
            got = pictured if images else answers[pn]
            if isinstance(got, Exception):
                raise got
            return got

    return Told()


def test_text_then_pictures_then_patterns(spark):
    sheets = spark.createDataFrame([(pn, "Weight: 3 kg", pics) for pn, pics in [("sure", [b"p"]), ("unsure", [b"p"]), ("bare", None), ("low", [b"p"]), ("fails", [b"p"]), ("odd", [])]], "pn string, text string, images array<binary>")
    reader = told({
        "sure": {"raw_weight": "1 kg", "confidence": 0.7, "method": "extracted"},
        "unsure": {"raw_weight": "1 kg", "confidence": 0.95, "method": "estimated"},
        "bare": {"raw_length": 12, "confidence": 0.5},
        "low": {"raw_weight": "1 kg", "confidence": 0.65},
        "fails": TimeoutError("slow"),
        "odd": {"confidence": "high"},
    }, {"raw_weight": "2 kg", "confidence": 0.9})
    got = {r.pn: (r.seen, r.method, r.raw_weight, r.raw_length) for r in readers.read_sheets(sheets, reader, images="images").collect()}
    assert got == {
        "sure": ("text", "extracted", "1 kg", None), "unsure": ("images", "extracted", "2 kg", None), "bare": ("text", "estimated", None, "12"),
        "low": ("images", "extracted", "2 kg", None), "fails": ("patterns", "regex_fallback", "3 kg", None), "odd": ("patterns", "regex_fallback", "3 kg", None),
    }


def test_one_failing_part_leaves_the_others(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "pn string")
    sheet = [("a", "A", "Length: 10 mm Weight: 3 kg", "u", True, "web", 0), ("b", "B", "nothing", "u", True, "web", 0), ("c", "C", "", "", False, "web", 0)]
    sheets = spark.createDataFrame(sheet, "pn string, title string, text string, source_url string, has_data boolean, source_type string, provider_rank int")
    got = {r.pn: r for r in readers.process(queries, sheets, told({"a": {"raw_weight": "4 kg", "confidence": 0.9}, "b": ValueError("broken")})).collect()}
    assert {k: (r.found, r.notes) for k, r in got.items()} == {"a": (True, ""), "b": (False, "ValueError: broken"), "c": (False, "")}
    assert got["a"].metric.weight_g == 4000 and got["c"].confidence == 0.0
    plain = {r.pn: r.metric.weight_g if r.metric else None for r in readers.process(queries, sheets).collect()}
    assert plain == {"a": 3000, "b": None, "c": None}
    assert readers.process(queries.limit(0), sheets).count() == 0


def test_cached_sheets_are_asked_for_once(spark, tmp_path):
    asked = []

    class Counting:
        def sheets(self, queries):
            asked.append(sorted(r.pn for r in queries.collect()))
            return queries.select("pn", F.lit("t").alias("title"), F.lit("Weight 1 kg").alias("text"), F.lit("u").alias("source_url"), (F.col("pn") != "none").alias("has_data"), F.lit("web").alias("source_type"))

    q = lambda *pns: spark.createDataFrame([(p,) for p in pns], "pn string")
    cached = providers.Cached(Counting(), str(tmp_path / "c"))
    assert cached.sheets(q("a", "none")).count() == 2
    assert sorted(r.pn for r in cached.sheets(q("a", "b", "none")).collect()) == ["a", "b", "none"]
    assert sorted(r.pn for r in providers.Cached(Counting(), str(tmp_path / "c"), negative_ttl=3600).sheets(q("a", "none")).collect()) == ["a", "none"]
    providers.Cached(Counting(), str(tmp_path / "c"), refresh=True).sheets(q("a"))
    assert asked == [["a", "none"], ["b", "none"], [], ["a"]]


def test_family_pages(spark):
    pages = spark.createDataFrame([("u1", "Spec 780211", "about 780211"), ("u2", "Torque Sensor family", "long text"), ("u3", "Other", "x")], "url string, title string, text string")
    q = spark.createDataFrame([("780211", "shaft"), ("5551", "TORQUE gauge"), ("99", "bolt")], "pn string, title string")
    table = providers.PageTable(pages, is_html=False, families=[(r"(?i)torque|^7802", r"(?i)torque sensor")])
    got = {r.pn: (r.title, r.has_data, "long text" in r.text) for r in table.sheets(q).collect()}
    assert got == {"780211": ("Spec 780211", True, True), "5551": ("Torque Sensor family", True, True), "99": ("", False, False)}
    alone = {r.pn: r.text for r in providers.PageTable(pages, is_html=False, families=[("7802", "Torque")], pool=1).sheets(q).collect()}
    assert alone == {"780211": "about 780211", "5551": "", "99": ""}


def test_rows_of_workbooks(spark):
    wide = ["weight"] + ["c"] * 12
    rows = [("k", "1-2", "A", 1, 1, ["Weight", None, " 3 kg "]), ("k", "1-2", "A", 1, 2, wide), ("k", "1-2", "A", 1, 3, wide[1:] + ["1 2"]), ("k", "1-2", "A", 1, 4, [" ", None]), ("k", "1-2", "F", 6, 1, ["weight"]), ("k", "1-2", "B", 2, 1001, ["weight"]), ("k", "1-2", "B", 2, 1000, ["weight" * 60])]
    got = dimensions.attachment_rows(spark.createDataFrame(rows, "key string, pn string, sheet string, sheet_no int, row_no int, cells array<string>"), "key", "pn").orderBy("rank").collect()
    assert [r.line for r in got] == ["[A:R1] Weight | 3 kg", "[A:R3] " + " | ".join(["c"] * 12 + ["1 2"]), "[B:R1000] " + ("weight" * 60)[:200]]


def test_doubtful_answers(spark):
    class Says:
        def ask(self, system, user):
            return json.dumps({"assignments": [{"id": 0, "cluster": " A ", "confidence": 7, "missing": None}, {"id": 1, "cluster": "B", "confidence": "x"}, {"id": 1, "cluster": "C", "confidence": 0.4, "missing": " need drawing/photo "}, {"id": 9, "cluster": "D"}, "junk", {"cluster": "E"}]})

    class Broken:
        def ask(self, system, user):
            raise TimeoutError

    cards = spark.createDataFrame([("p", "x"), ("q", "y")], "pn string, card string")
    got = sorted(tuple(r) for r in gateway.classify_with_confidence(cards, "pn", "card", Says()).collect())
    assert got == [("p", "A", 1.0, ""), ("q", "C", 0.4, "need drawing/photo")]
    assert gateway.classify_with_confidence(cards, "pn", "card", Broken()).count() == 0


def test_query_builders(spark):
    d = spark.createDataFrame([("B", "123", "a, b"), (None, "123", None), ("B", None, "x")], "b string, pn string, t string")
    rows = d.select(text.web_queries(F.col("b"), F.col("pn"), F.col("t"), 99).alias("q"), text.catalog_queries(F.array("pn"), []).alias("c")).collect()
    assert rows[0].q[0] == "B 123 a  b dimensions" and len(rows[0].q) == len(set(rows[0].q)) == 8
    assert len(rows[1].q) == 4 and rows[2].q is None and rows[0].c == []


def test_exports_and_letters(spark):
    assert all(hasattr(typeloom, n) for n in typeloom.__all__)
    got = spark.range(1).select(text.letters(F.lit(475254)), text.letters(F.lit(26)), text.letters(F.lit(12356630))).first()
    assert tuple(got) == ("AAAAA", "AA", "AAAAAA")


def test_extract_from_pages(spark, tmp_path, capsys):
    spark.createDataFrame([("http://x/1", "Sheet 0265005303", "<p>0 265 005 303</p><p>Length: 65 mm</p><p>Weight: 78 g</p>")], "url string, title string, html string").write.parquet(str(tmp_path / "pages"))
    args = ["extract", "--pn", "0265005303", "--json", "--pages", str(tmp_path / "pages"), "--cache", str(tmp_path / "cache"), "--no-fallback"]
    for _ in range(2):
        cli.main(args)
        got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert got["found"] and got["metric"]["weight_g"] == pytest.approx(78)
    cli.main(["extract", "--pn", "1", "--json", "--no-fallback"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["found"] is False
