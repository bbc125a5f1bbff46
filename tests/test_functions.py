"""Texts, units, JSON and pages, by literal cases."""

import pytest
from pyspark.sql import functions as F

from typeloom.functions import pages, salvage, text, units


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("120 mm", 120.0), ("12.5mm", 12.5), ("1 1/2 in", 38.1), ("3/8 in", 9.52), ('4"', 101.6), ("2 ft", 609.6), ("10 - 12 mm", 11.0), ("1,200 mm", 1200.0), ("1,234.5", 1234.5), ("12,5", 12.5), ("5 minutes", 5.0), ("0 mm", None), ("x", None), (None, None)])
def test_length(spark, raw, want):
    assert one(spark, raw, units.length_mm) == want


@pytest.mark.parametrize(("raw", "want"), [("350 g", 350), ("500 mg", 0.5), ("1 lb", 453.59), ("10 oz", 283.5), ("2 lbs 4 oz", 1020.58), ("2lbs4oz", 1020.58), ("", None)])
def test_weight(spark, raw, want):
    assert one(spark, raw, units.weight_g) == want


def test_metric_record_fills_from_triples_and_diameters(spark):
    rows = [("182 x 35 x 30 mm", None, None, None, "490 g"), ("10 mm", None, None, "4 mm", None), ("10 mm", None, "3 mm", "4 mm", None)]
    df = spark.createDataFrame(rows, "l string, w string, h string, d string, g string")
    got = [r[0] for r in df.select(units.metric_record(*map(F.col, "lwhdg"))).collect()]
    assert (got[0].width_mm, got[0].weight_kg, got[0].dimension_string_mm, got[0].volume_cm3) == (35.0, 0.49, "182.0 x 35.0 x 30.0 mm", 191.1)
    assert (got[1].width_mm, got[1].height_mm) == (4.0, 4.0)
    assert (got[2].width_mm, got[2].dimension_string_mm) == (None, "Ø 4.0 x 10.0 mm")


def test_european_numbers_and_grams(spark):
    assert one(spark, " 0,015 ", units.european_number) == 0.015
    assert one(spark, "?", units.european_number) is None
    assert one(spark, 2.0, lambda c: units.grams(c, F.lit(" kg")), "double") == 2000
    assert one(spark, 2.0, lambda c: units.grams(c, F.lit("lb")), "double") is None


@pytest.mark.parametrize(("raw", "want"), [("helical spring | SPRING; IBO2", "SPRING"), ("valve body | VALVE BODY; A-V/T/42/TG11", "VALVE BODY"), ("rubber gasket | SEPARATING SEAL; D 25.4", "SEPARATING SEAL"), ("O-RING 12345", "O-RING"), ("123", "UNKNOWN"), (None, "UNKNOWN")])
def test_type_phrase(spark, raw, want):
    assert one(spark, raw, text.type_phrase) == want


@pytest.mark.parametrize(("raw", "pn", "want"), [("F01G1610HF - F01G.29K.1H2-589 PROTECTOR | PROTECTOR; 0", "F01G1610HF", "PROTECTOR"), ("helical spring | SPRING; IBO2", "", "helical spring · SPRING"), ("rubber gasket | SEPARATING SEAL; D 25.4", "", "rubber gasket · SEPARATING SEAL"), ("L=24,5MM", "", "L=24,5MM"), (None, "1", "")])
def test_readable_description(spark, raw, pn, want):
    assert one(spark, raw, lambda c: text.readable_description(c, F.lit(pn))) == want


def test_labels_and_sentinels(spark):
    assert [one(spark, v, text.clean_str) for v in ("nan", "None", "?", None, "NaN", "x")] == ["", "", "", "", "NaN", "x"]
    assert [one(spark, v, lambda c, m=m: text.is_unlabelled(c, m)) for v, m in (("TBD", "equals"), ("a tbd b", "equals"), ("a TBD b", "contains"), ("TBD", "exact"))] == [True, False, True, False]
    assert one(spark, " a | ", lambda c: text.build_description(c, F.lit("?"))) == "a"
    assert [one(spark, n, text.letters, "long") for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_part_numbers(spark):
    got = one(spark, "0265005303", text.pn_variants)
    assert got == ["0265005303", "0 265 005 303", "0.265.005.303", "0265.005.303", "0265 005 303"]
    assert one(spark, " 12-34 ", text.pn_variants) == ["12-34", "1234"]
    mention = lambda t: one(spark, t, lambda c: text.mentions_pn(c, F.lit("0265005303")))
    assert [mention(t) for t in ("see 0 265 005 303", "x0265.005.303y", "0265005304", None)] == [True, True, False, False]


def test_json_answers(spark):
    assert salvage.whole_objects('x {"a": "}{\\""} {"b": {"c": 1}} {"d"') == ['{"a": "}{\\""}', '{"b": {"c": 1}}']
    assert salvage.whole_objects(None) == []
    assert salvage.salvage('[{"id": 1}, {"id": 2}, {"id":') == '{"assignments": [{"id": 1}, {"id": 2}]}'
    assert salvage.salvage('{"1": "a", "2": "b", "3": "c", "4') == '{"assignments": {"1": "a", "2": "b", "3": "c"}}'
    assert salvage.salvage('"a": "b"') is None
    assert one(spark, '{"1": "a", "1": "b"}', salvage.group_pairs) in ({1: "B"}, {1: "A"})
    assert one(spark, "nothing", salvage.group_pairs) == {}


HTML = """<h2>Technical data</h2><table><tr><th>Weight</th><td>5 <b>kg</b></td></tr><tr><td>Size</td><td>L</td></tr><tr><td>a</td><td>b</td><td>height 3</td></tr></table>
<dl><dt>Length:</dt><dd>10 mm</dd><dt>Colour</dt><dd>1</dd></dl><ul><li>Height: 7 mm<li>Weight: 9 kg</ul><script>var Width = "Width: 3";</script>
<h3>Similar products</h3><h3>Related</h3><table><tr><td>Width</td><td>99 mm</td></tr></table>"""


def test_page_specs():
    assert pages.specs_of(HTML) == {"weight": "5 kg", "length": "10 mm", "height": "7 mm"}
    assert pages.specs_of(None) == {} and "Width: 3" not in pages.text_of(HTML)
    assert "Height: 7 mm" in pages.text_of(HTML).split("\n")


def test_line_specs_first_wins(spark):
    got = one(spark, "Weight: 5 kg\nColour: 3\nWEIGHT: 6 kg\n height : 1\t mm", text.line_specs)
    assert got == {"weight": "5 kg", "height": "1 mm"}


def test_long_pages_are_read_whole():
    page = "<p>" + "word " * 170_000 + "</p><table><tr><td>Weight</td><td>5 kg</td></tr></table><p>the end</p>"
    assert pages.specs_of(page) == {"weight": "5 kg"}
    assert pages.text_of(page).endswith("the end")
