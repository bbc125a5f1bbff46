"""Operators against brute force and by small cases."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.functions import text
from typeloom.operators import clustering, dimensions, entities, evaluation, features, gateway, hybrid, ranking
from typeloom.sources import tables
from typeloom.streaming import landing


def slow_linkage(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((np.mean(d[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def as_sets(labels):
    out = {}
    for i, c in labels:
        out.setdefault(c, set()).add(i)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage(spark, seed):
    x = np.random.default_rng(seed).standard_normal((40, 5))
    want = slow_linkage(x, 0.6)
    assert as_sets(enumerate(clustering.average_linkage(x, 0.6).tolist())) == want
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    assert as_sets((r.k, r.cluster) for r in clustering.cluster(df, "k", "v", 0.6).collect()) == want
    if seed == 0:
        assert as_sets((r.k, r.cluster) for r in clustering.cluster_rounds(df, "k", "v", 0.6).collect()) == want
    assert len(set(clustering.average_linkage(x, k=7).tolist())) == 7


@pytest.mark.parametrize("most", [0, 25])
def test_average_linkage_by_rounds_of_blocks(spark, monkeypatch, most):
    """Blocks of rows, copies, zero rows, groups and rows without a vector or a group; copies take
    no round each, and no table of pairs is written."""
    monkeypatch.setattr(clustering, "KERNEL_ROWS", most)
    monkeypatch.setattr(clustering, "BLOCK", 16)
    written, stored = [], clustering.stored
    monkeypatch.setattr(clustering, "stored", lambda df: written.append(stored(df)) or written[-1])
    x = np.random.default_rng(3).standard_normal((60, 5))
    x = np.concatenate([x, np.repeat(x[:1], 40, 0), np.zeros((2, 5))])
    rows = [(i, v.tolist(), "ab"[i % 3 == 0]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None, "a"), (901, x[0].tolist(), None)], "k long, v array<double>, g string")
    got = [(r.k, r.cluster) for r in clustering.cluster_rounds(df, "k", "v", 0.6, by="g").collect()]
    want = {frozenset([900]), frozenset([901])}
    for g in "ab":
        own = [i for i, _, h in rows if h == g]
        want |= {frozenset(own[i] for i in c) for c in slow_linkage(x[own], 0.6)}
    assert as_sets(got) == want
    assert all(c == min(k for k, d in got if d == c) for _, c in got)
    assert len(written) < 40 and max(t.count() for t in written) <= len(rows) + 2


def test_average_linkage_on_edges():
    assert clustering.average_linkage(np.zeros((0, 3)), 0.5).tolist() == []
    assert len(set(clustering.average_linkage(np.array([[0.0, 0], [0, 0], [1, 0], [1, 0]]), 0.5).tolist())) == 3


@pytest.mark.parametrize("seed", range(6))
def test_assignment_against_permutations(seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
    small, large = sorted(m.shape)
    t = m if m.shape[0] <= m.shape[1] else m.T
    assert evaluation.assign(m) == max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_pair_metrics_against_pairs(spark):
    rng = random.Random(0)
    rows = [(rng.choice("abc"), rng.choice("xyz")) for _ in range(60)]
    m = evaluation.pair_metrics(evaluation.contingency(spark.createDataFrame(rows, "y string, c string"), "y", "c")).first()
    same = [(a[0] == b[0], a[1] == b[1]) for a, b in itertools.combinations(rows, 2)]
    tp = same.count((True, True))
    assert m.pair_precision == pytest.approx(tp / (tp + same.count((False, True))))
    assert m.pair_recall == pytest.approx(tp / (tp + same.count((True, False))))
    assert m.rand == pytest.approx((tp + same.count((False, False))) / len(same))
    perfect = evaluation.contingency(spark.createDataFrame([("a", "1"), ("b", "2")], "y string, c string"), "y", "c")
    assert evaluation.pair_metrics(perfect).first().ari == 1.0 and evaluation.entropy_metrics(perfect).first().nmi == pytest.approx(1)


def test_threshold_is_the_last_position_that_reaches_the_target(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random() < 0.95 - (i % 7 == 0) * 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, m double, c boolean")
    for target in (0.5, 0.9, 0.97, 1.1):
        right, want = 0, max(r[1] for r in rows)
        for n, (_, m, c) in enumerate(sorted(rows, key=lambda r: -r[1]), 1):
            right += c
            want = m if right / n >= target else want
        assert ranking.accuracy_threshold(df, "m", "c", "k", target).first()[0] == want
    assert ranking.accuracy_threshold(df.filter("false"), "m", "c", "k").first()[0] == 0.0


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 30))
    rows = [(i, f"t{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    sparse, size = features.sparse_rows(spark.createDataFrame(rows, "k long, term string, weight double"), "k")
    got = {r.k: np.array(r.features) for r in features.svd(sparse, "k", 3).collect()}
    assert size == 30
    u = np.array([got[i] for i in range(60)])
    want = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(u @ u.T, want @ want.T, atol=1e-6)


def test_modes_break_ties_to_the_smallest(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", ""), ("a", "?"), ("b", None), ("b", " ")], "k string, v string")
    assert {r.k: r.m for r in entities.mode_value(df, ["k"], "v", "m").collect()} == {"a": "x", "b": ""}
    assert {r.k: r.m for r in entities.modes(df, "k", {"v": "m"}).collect()} == {"a": "x", "b": ""}


def test_lookup_never_multiplies(spark):
    t = spark.createDataFrame([("a", "2"), ("a", "1")], "k string, v string")
    got = entities.lookup(spark.createDataFrame([("a",), ("b",)], "k string"), t, "k", "v", "o", F.lit("none")).collect()
    assert sorted(map(tuple, got)) == [("a", "1"), ("b", "none")]


def test_relevant_lines_keeps_a_late_table(spark):
    lines = [f"line {i}" for i in range(200)]
    lines[150] = "Weight: 78 g"
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "short\ntext"), (3, None)], "k long, t string")
    got = ranking.relevant_lines(df, "k", "t", text.DIMENSION_LINE, most=50).collect()
    assert [r.pos for r in got if r.k == 1] == [*range(30), *range(148, 153)] and sum(r.k == 2 for r in got) == 2


def test_hybrid_layers(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = np.eye(6)
    rows = [(f"p{i}", (centres[i % 6] + 0.05 * rng.standard_normal(6)).tolist(), f"type{i % 6}") for i in range(180)]
    df = spark.createDataFrame(rows, "pn string, v array<double>, label string")
    known = df.filter("label != 'type5'")
    fixed = spark.createDataFrame([("p1", "FIXED")], "pn string, cluster string")
    model = hybrid.HybridClassifier(hybrid.Settings(folds=2, target=0.99)).fit(known, "pn", "v", "label", fixed)
    out = {r.pn: r for r in model.predict(df, "pn", "v", fixed).collect()}
    assert len(out) == 180 and (out["p1"].cluster_name, out["p1"].source) == ("FIXED", "override")
    accepted = [r for r in out.values() if r.source == "classifier"]
    assert sum(r.cluster_name == r.label for r in accepted) >= 0.8 * len(accepted)
    assert all(r.needs_review == (r.source == "discovered") for r in out.values())
    model.save(spark, str(tmp_path / "m"))
    again = hybrid.HybridClassifier.load(spark, str(tmp_path / "m"))
    assert (again.threshold, again.labels) == (model.threshold, model.labels)
    assert {r.pn: r.cluster_name for r in again.predict(df, "pn", "v", fixed).collect()} == {k: r.cluster_name for k, r in out.items()}


def test_gateway(spark, tmp_path):
    model = gateway.KeywordModel()
    cards = spark.createDataFrame([(f"p{i}", f'desc="{d}"') for i, d in enumerate(["steel spring", "o-ring 3", "thing", "ball joint"])], "pn string, card string")
    got = {r.pn: r.cluster for r in gateway.classify(cards, "pn", "card", model, size=2).collect()}
    assert got == {"p0": "SPRING", "p1": "O-RING", "p2": "OTHER", "p3": "BALL JOINT"}

    class Broken:
        def ask(self, system, user):
            raise TimeoutError

    cache = spark.createDataFrame([("p0", "KNOWN")], "pn string, cluster string")
    assert {r.pn: r.cluster for r in gateway.classify_missing(cards, cache, "pn", "card", Broken()).collect()} == {"p0": "KNOWN", "p1": "INNE", "p2": "INNE", "p3": "INNE"}
    names = gateway.discover_taxonomy(cards, "pn", "card", model)
    assert "SPRING" in names and names == gateway.taxonomy("discover", [], lambda: names)
    assert gateway.taxonomy("seed", ['"A"', "a "], lambda: ["b"]) == ["A", "B"]
    assert gateway.group_phrases([f"SPRING {i}" for i in range(100)] + ["NUT"], model, 90)["NUT"].startswith("SCREWS")
    assert gateway.name_groups({"g1": ["ball pin", "steel ball"], "g2": ["x"]}, model, {}) == {"g1": "NEW: BALL", "g2": "NEW: OTHER"}
    assert gateway.name_groups({"g": []}, Broken(), {"g": "NEW: F"}) == {"g": "NEW: F"}
    pauses, tries = [], gateway.Retrying(Broken(), tries=3, sleep=lambda s: pauses.append(s))
    with pytest.raises(TimeoutError):
        tries.ask("", "")
    assert tries.calls == 3 and pauses == [1.0, 2.0]


def test_caches(spark):
    rows = [("a", "text", True, "2024-01-20"), ("b", "text", True, "2024-01-01"), ("c", "", False, "2024-01-30"), ("d", "No documentation found", True, "2024-01-30")]
    cache = spark.createDataFrame(rows, "pn string, text string, has_data boolean, d string").withColumn("fetched_at", F.to_timestamp("d"))
    now = F.to_timestamp(F.lit("2024-01-31"))
    q = cache.select("pn")
    left = lambda **o: {r.pn for r in dimensions.to_fetch(q, cache, "pn", now, **o).collect()}
    assert left() == {"b", "c", "d"} and left(refresh=True) == {"a", "b", "c", "d"}
    assert left(negative_ttl=2 * 86400) == {"b"} and left(ttl=None) == {"c", "d"}


def test_find_columns_and_methods(spark):
    assert dimensions.find_columns(["Part Number", "Brand", "x"]) == {"pn": "Part Number", "brand": "Brand", "title": None, "category": None}
    got = spark.createDataFrame([("extracted", 0.1), ("odd", 0.5), (None, 0.7)], "m string, c double").select(dimensions.method_of(F.col("m"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["extracted", "estimated", "extracted"]


def test_sources(spark, tmp_path):
    one = tmp_path / "a.csv"
    one.write_bytes("PN ; Opis\n007;śruba\n".encode())
    two = tmp_path / "b.csv"
    two.write_bytes("PN,Text\n007,x\n".encode())
    assert tables.sniff("a;b\n1;\xe9\n".encode("cp1252")) == (";", "cp1252")
    assert tables.sniff(two.read_bytes()) == (",", "utf-8-sig") and tables.sniff_separator("a,b") == ","
    got = tables.read_records(spark, str(one), encoding="utf-8-sig")
    assert (got.columns, got.first()[0]) == (["PN", "Opis"], "007")
    assert tables.read_records(spark, str(two)).first().asDict() == {"PN": "007", "Text": "x"}
    rules = tmp_path / "o.yaml"
    rules.write_text("# head\n'007': SEAL\n8: BALL\n")
    df = tables.read_overrides(spark, str(rules))
    assert {r.pn: r.cluster for r in df.collect()} == {"007": "SEAL", "8": "BALL"}
    assert tables.parse_overrides(tables.overrides_yaml(df, "# head\n")) == {"007": "SEAL", "8": "BALL"}
    assert tables.read_overrides(spark, str(tmp_path / "none.yaml")).count() == 0
    cache = str(tmp_path / "cache")
    tables.append_cache(spark.createDataFrame([("a", "X"), ("b", None)], "pn string, c string"), cache, "pn", "c")
    assert tables.read_cache(spark, cache, "pn string, c string").count() == 1


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Parts" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>PN</t></si><si><t>007</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>N</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    got = tables.read_workbook(spark, str(tmp_path / "*.xlsx"), "Parts")
    assert got.columns == ["PN", "column_1", "N"] and tuple(got.first()) == ("007", "", "5")


def test_landing_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("pn;description\n1;steel ball\n2;spring\n")
    fixed = spark.createDataFrame([("2", "FIXED")], "pn string, cluster string")
    stream = landing.first_layers(landing.landing_stream(spark, str(src), ["pn", "description"]), fixed, F.col("description"), gateway.keyword_type)
    landing.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    (src / "b.csv").write_text("pn;description\n3;nut\n")
    landing.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.pn: (r.cluster_name, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["1"] == ("BALL", "rule") and got["2"] == ("FIXED", "override") and len(got) == 3
    assert landing.safe_name("../a b.csv", 5) == "a_b.csv"
    with pytest.raises(ValueError):
        landing.safe_name("a.exe", 5)


def test_linear_fit_is_a_minimum(spark):
    from typeloom.operators import linear

    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 4))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(120) > 0.5, "a", np.where(x[:, 1] > 0, "b", "c"))
    df = spark.createDataFrame([(v.tolist(), str(k)) for v, k in zip(x, y)], "v array<double>, y string")
    m = linear.fit(df, "v", "y")
    wide = np.hstack([x, np.ones((120, 1))])
    for label, w in zip(m.labels, m.weights):
        t = np.where(y == label, 1.0, -1.0)
        gap = np.maximum(0, 1 - t * (wide @ w))
        assert np.abs(w - 2 * (gap * t) @ wide).max() < 1e-4
    got = linear.predict(m, df, "v").collect()
    s = m.scores(x)
    assert [r.predicted for r in got] == [m.labels[i] for i in s.argmax(1)]
    assert [r.margin for r in got] == pytest.approx(np.sort(s)[:, -1] - np.sort(s)[:, -2])


def test_rounds_merge_vectors_that_differ_by_rounding_only(spark, monkeypatch):
    seen, finished = [], clustering.finished
    monkeypatch.setattr(clustering, "finished", lambda state, *rest: seen.append(state.count()) or finished(state, *rest))
    rows = [(i, [1.0 + (i % 7) * 1e-15, float(i % 3), 0.3 - (i % 5) * 1e-16]) for i in range(60)]
    got = {r.k: r.cluster for r in clustering.cluster_rounds(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 1e-6).collect()}
    assert got == {i: i % 3 for i in range(60)} and seen == [3]


def test_sparse_rows_spell_their_terms_once(spark):
    weights = features.tfidf(spark.createDataFrame([(1, "one two two"), (2, "two three")], "k long, t string"), "k", features.word_terms(F.col("t")), 100)
    rows, _ = features.sparse_rows(weights, "k")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 2


def test_discovered_types_are_made_once_and_meet_parts_unshuffled(spark):
    v = {"BOLT": [1.0, 0.0, 0.1], "BOLTS": [1.0, 0.1, 0.0], "RING": [0.0, 1.0, 0.0], "SEAL": [0.0, 0.0, 1.0]}
    df = tables.stored(spark.createDataFrame([(f"p{i}", p, v[p]) for i, p in enumerate([*v] * 5)], "pn string, phrase string, v array<double>"))
    fixed = spark.createDataFrame([("p2", "FIXED"), ("p3", "ONE"), ("p7", "TWO")], "pn string, cluster string")
    out = clustering.discover_types(df, "pn", "phrase", "v", 0.5, overrides=fixed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Generate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = {r.pn: r for r in out.collect()}
    # experts agree on RING, so it moves; they differ on SEAL, which keeps its name but for their own parts
    want = {f"p{i}": ("BOLT", "BOLT", "FIXED", "SEAL")[i % 4] for i in range(20)} | {"p3": "ONE", "p7": "TWO"}
    assert {k: r.type_group for k, r in rows.items()} == want
    assert {k for k, r in rows.items() if r.source == "override"} == {"p2", "p3", "p7"}
    assert all(r.confidence > 0.99 for r in rows.values()) and sum(r.needs_review for r in rows.values()) <= 10


def test_svd_basis_weighs_equal_rows_by_their_number(spark):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql import types as T

    dense = np.array([[1.0, 0, 0, 0.5, 0, 0], [0, 1.0, 0, 0.4, 0, 0], [0, 0, 1.0, 0, 0.3, 0.2]])
    many = [x for x, n in zip(dense, (1, 20, 400)) for _ in range(n)]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("features", VectorUDT())])
    rows = spark.createDataFrame([(i, SparseVector(6, np.flatnonzero(x).tolist(), x[x != 0].tolist())) for i, x in enumerate(many)], schema)
    basis = features.svd_basis(rows, 2)
    want = np.linalg.svd(np.array(many))[2][:2].T
    assert np.allclose(abs((basis * want).sum(0)), 1, atol=1e-3)


ODD_TEXTS = ["The theme  of\tthe Été\n", None, "", " \t ", "a", "A b AB", "\U0001f600x 日本語 日本語", "x" * 300, "the theme of the été", " non breaking İstanbul ΣΣ"]


@pytest.mark.parametrize(("vocabulary", "least"), [(1000, 3), (15, 3), (1000, 4)])
def test_char_tfidf_is_tfidf_of_char_terms(spark, vocabulary, least):
    for extra in ([], [(0, "the été"), (1, "Theme"), (None, "ab the"), (None, "the")]):  # repeated keys are one document
        df = spark.createDataFrame([*enumerate(ODD_TEXTS), *extra], "k long, t string")
        slow = features.tfidf(df, "k", features.char_terms(F.col("t"), least, least + 2), vocabulary)
        fast = features.char_tfidf(df, "k", F.col("t"), vocabulary, None, least, least + 2)
        want, got = ([((r.k, r.term), r.weight) for r in x.collect()] for x in (slow, fast))
        assert fast.dtypes == slow.dtypes and dict(got) == pytest.approx(dict(want)) and len(got) == len(want) > 15
    assert features.char_tfidf(df.limit(0), "k", F.col("t"), 10).count() == 0


@pytest.mark.parametrize("dense", [0, 1 << 25])
def test_run_counts_by_small_slices(monkeypatch, dense):
    import pyarrow as pa

    for name, most in (("SPELLED", 40), ("COUNTED", 2), ("SLICE", 3), ("DENSE", dense)):
        monkeypatch.setattr(features, name, most)

    def runs(word, least, most):
        w = f" {word} "
        return [w[i : i + n] for n in range(least, most + 1) for i in range(max(len(w) - n, 0 if n == least else -1) + 1)]

    rng = random.Random(4)
    rows = [None if i % 9 == 8 else ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 20))] for i in range(40)]
    for least, most in ((3, 5), (4, 6)):
        terms = sorted({t for r in rows for w in r or [] for t in runs(w, least, most)})[::2] + ["zz9"]
        got = np.concatenate([total for _, total in features.run_counts(pa.array([None if r is None else " " + " \t ".join(r) for r in rows]), features.RunTable(terms), least, most)])
        for row, counts in zip(rows, got, strict=True):
            all_runs = [t for w in row or [] for t in runs(w, least, most)]
            assert counts.tolist() == [all_runs.count(t) for t in terms]


def test_tfidf_char_makes_no_table_of_runs(spark):
    from typeloom.plans import queries

    plan = queries.tfidf_char(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
