"""The command line and what it is made of, end to end on small files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom import cli, config
from typeloom.functions.text import mentions_pn
from typeloom.operators import encoders
from typeloom.sources import providers


@pytest.fixture
def parts_file(tmp_path):
    rng = random.Random(0)
    nouns = ["ball", "spring", "valve", "seal"]
    rows = ["pn;description;alt;label"]
    for i in range(120):
        n = nouns[i % 4]
        for _ in range(1 + i % 2):
            rows.append(f"{i:05d};{rng.choice(['steel', 'long', 'small'])} {n};{n.upper()}; {'tbd' if i % 5 == 0 else n.upper()}")
    path = tmp_path / "parts.csv"
    path.write_text("\n".join(rows) + "\n")
    return path


def read(spark, path):
    return spark.read.csv(str(path), sep=";", header=True)


def test_classify_and_predict_only(spark, parts_file, tmp_path, capsys):
    base = ["classify", "--input", str(parts_file), "--description", "description,alt", "--label", "label", "--model", str(tmp_path / "m")]
    cli.main([*base, "--out", str(tmp_path / "o"), "--folds", "2", "--target", "0.9", "--compare"])
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert metrics["accuracy"] > 0.95 and "unsupervised_ari" in metrics
    out = read(spark, tmp_path / "o/parts")
    assert out.count() == 120 and out.filter("label != 'tbd' AND cluster_name != label AND source = 'classifier'").count() == 0
    assert read(spark, tmp_path / "o/records").count() == 180
    assert spark.read.json(str(tmp_path / "o/document")).filter("kind = 'part'").count() == 120
    cli.main([*base, "--out", str(tmp_path / "p"), "--predict-only"])
    assert read(spark, tmp_path / "p/parts").count() == 120


@pytest.mark.parametrize("encoder", ["tfidf", "tfidf+head", "hash"])
def test_a_saved_model_reads_another_file(spark, parts_file, tmp_path, capsys, encoder):
    """Words, their numbers and the order of parts all differ from the file that was learned."""
    base = ["classify", "--description", "description,alt", "--label", "label", "--model", str(tmp_path / "m"), "--encoder", encoder]
    cli.main([*base, "--input", str(parts_file), "--out", str(tmp_path / "o"), "--folds", "2", "--target", "0.9"])
    rng, nouns = random.Random(1), ["seal", "valve", "ball"]
    rows = [f"N{i:04d};{' '.join(rng.sample(['aardvark', 'zinc', 'new', 'long', 'brass'], rng.randint(0, 2)))} {nouns[i % 3]};{nouns[i % 3].upper()};tbd" for i in range(45)]
    other = tmp_path / "other.csv"
    other.write_text("\n".join(["pn;description;alt;label", *rows, "N9999;qqqq;xxxx;tbd"]) + "\n")
    cli.main([*base, "--input", str(other), "--out", str(tmp_path / "p"), "--predict-only"])
    got = {r.pn: r for r in read(spark, tmp_path / "p/parts").collect()}
    sure = [i for i in range(45) if got[f"N{i:04d}"].source == "classifier"]
    assert len(got) == 46 and len(sure) > 15
    assert all(got[f"N{i:04d}"].cluster_name == nouns[i % 3].upper() for i in sure)


def test_override(spark, parts_file, tmp_path, capsys):
    rules = tmp_path / "o.yaml"
    args = ["classify", "--input", str(parts_file), "--out", "x", "--overrides", str(rules)]
    cli.main([*args, "--override", "007=SEAL", "--override", "1=A=B"])
    cli.main([*args, "--override", "007=BALL"])
    assert rules.read_text() == '"007": "BALL"\n"1": "A=B"\n' and "2 assignments" in capsys.readouterr().out


def test_discover_and_evaluate(spark, parts_file, tmp_path, capsys):
    args = ["discover", "--input", str(parts_file), "--description", "description,alt", "--label", "label"]
    cli.main([*args, "--out", str(tmp_path / "d"), "--types", "4"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["ari"] > 0.9
    cli.main([*args, "--out", str(tmp_path / "e"), "--grouping", "llm", "--limit", "40"])
    capsys.readouterr()
    cli.main(["evaluate", str(tmp_path / "e/parts")])
    assert json.loads(capsys.readouterr().out.splitlines()[0])["pair_f1"] > 0.5


def test_llm(spark, parts_file, tmp_path, capsys):
    args = ["llm", "--input", str(parts_file), "--description", "description,alt", "--label", "label", "--cache", str(tmp_path / "c")]
    for out in ("a", "b"):
        cli.main([*args, "--out", str(tmp_path / out)])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["pair_f1"] == 1.0
    assert spark.read.parquet(str(tmp_path / "c")).count() == 120


def test_extract(spark, tmp_path, capsys):
    cli.main(["extract", "--pn", "123", "--json"])
    assert json.loads(capsys.readouterr().out)["metric"]["length_mm"] == 110
    (tmp_path / "in.csv").write_text("Part Number;Name\n007;x\n123;y\n007;z\n")
    cli.main(["extract", "--csv-in", str(tmp_path / "in.csv"), "--csv-out", str(tmp_path / "out")])
    assert [r["Name"] for r in read(spark, tmp_path / "out").collect()] == ["x", "y", "z"]


def test_check_and_config(capsys):
    assert cli.main(["check"]) == 0 and "ok: pyspark" in capsys.readouterr().out
    got = config.merged({"llm": {"api_key": "k", "a": 1}}, {"llm": {"api_key": "", "a": 2}, "x": {"y": 1}})
    assert got == {"llm": {"api_key": "k", "a": 2}, "x": {"y": 1}} and config.shown(got)["llm"]["api_key"] == "***"


def test_encoders(spark):
    with pytest.raises(ValueError, match="unknown encoder"):
        encoders.encoder("nope")
    with pytest.raises(ValueError, match="needs labels"):
        encoders.encoder("hash+head")
    df = spark.createDataFrame([(i, f"{'ball' if i % 2 else 'spring'} number {i % 5}", str(i % 2)) for i in range(40)], "k long, t string, label string")
    plain = {r.k: np.array(r.features) for r in encoders.encoder("hash", dim=16)(df, "k", "t").collect()}
    head = {r.k: np.array(r.features) for r in encoders.encoder("hash+head", df, dim=16)(df, "k", "t").collect()}
    apart = lambda v: np.mean([v[i] @ v[i + 2] for i in range(38)]) - np.mean([v[i] @ v[i + 1] for i in range(39)])
    unit = {k: v / np.linalg.norm(v) for k, v in plain.items()}
    assert apart(head) > apart(unit)
    asked = []
    one = encoders.batch_encoder(lambda texts: asked.extend(texts) or np.ones((len(texts), 2)))
    cache = df.filter("k < 38").select(encoders.text_cache_key("s", F.col("t")).alias("cache_key"), F.array(F.lit(0.0), F.lit(0.0)).alias("features")).distinct()
    got = encoders.cached(one, "s", cache)(df, "k", "t")
    assert got.count() == 40 and got.filter("features[0] != 0").count() == 0


def test_providers(spark):
    pages = spark.createDataFrame([("u1", "Datasheet 0.265.005.303", "Part 0 265 005 303 weight 78 g"), ("u2", "other", "see 0265005303"), ("u3", "no", "0265005304")], "url string, title string, text string")
    q = spark.createDataFrame([("0265005303", None, None), ("999", None, "plug")], "pn string, title string, category string")
    got = {r.pn: r for r in providers.PageTable(pages, is_html=False).sheets(q).collect()}
    assert got["0265005303"].source_url == "u1" and "see" in got["0265005303"].text and not got["999"].has_data
    known = spark.createDataFrame([("0265005303", "t", "x")], "pn string, title string, text string")
    both = providers.cascade([providers.PageTable(pages, is_html=False), providers.Samples(known)], q)
    assert both.count() == 4

    def dead(query, most):
        raise OSError

    found = providers.Search([dead, lambda query, most: [{"title": query, "link": "l", "snippet": "s"}]]).results(q.select("pn"), "pn")
    assert {r.title for r in found.collect()} == {"0265005303", "999"}


def test_page_search_finds_any_spelling(spark):
    pages = [
        ("u1", "a", "WHEEL SPEED SENSOR 0 265 005 303"), ("u2", "b", "see 0265005303A"), ("u3", "c", "no 02 65 00 53 03 1"), ("u4", "d", "x0 -265--005. 303"),
        ("u5", "e", "0265/005303"), ("u6", "f", None), ("u7", "g", "ab-c/12 \u00e9"), ("u7", "g", "ab-c/12 \u00e9"),
    ]
    p = spark.createDataFrame(pages, "url string, title string, text string")
    q = spark.createDataFrame([("0 265 005-303",), ("abc/12",), ("B-C",), ("999",), (" ",)], "pn string")
    met = p.crossJoin(q).filter(mentions_pn(F.col("text"), F.col("pn"))).collect()
    want = {}
    for r in sorted(met, key=lambda r: r.url):
        want.setdefault(r.pn, []).append(r.text)
    got = {r.pn: r.text for r in providers.PageTable(p, most=9, is_html=False).sheets(q).collect() if r.has_data}
    assert got == {pn: "\n\n".join(texts) for pn, texts in want.items()}
    assert len(want["0 265 005-303"]) == 4 and len(want["abc/12"]) == 2
