"""corpus_pipeline and the queries of the subpackage, as they are registered."""

import random
import shutil
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from typeloom.llm import jaccard_join, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables: toxic documents, exact and near copies, odd rows and extra columns."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rottenly", "foulx"]))
        rows.append((i, " ".join(w), "en", ("web", "books", None)[i % 3], 7, "x", True))
        marks.append((i, 1, int(i % 6 == 0)))
    for i in range(40):  # copies of clean texts: exact, and with one word changed
        src = rows[6 * i + 1][1].split()
        rows.append((1000 + i, " ".join(src), "en", "web", 7, "x", False))
        src[rng.randrange(len(src))] = "other"
        rows.append((2000 + i, " ".join(src), "en", "web", 7, "x", False))
    rows += [(3000, None, None, None, None, None, None), (3001, "", "en", "web", 0, "x", None), (None, "null id " * 9, "en", "web", 7, "x", None), (3002, "  \t", "en", "web", 3, "x", None), rows[1]]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, row boolean"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def through(spark, folder, out):
    """The result of every stage, each written and read again."""
    docs, got = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        got.append(docs)
    return got


def test_pipeline_stage_by_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean, single, mixed, packed = through(spark, tables, tmp_path)
    assert [s.columns for s in (clean, single, mixed)] == [docs.columns] * 3
    gone = {r.doc_id for r in docs.join(clean.select("doc_id"), "doc_id", "left_anti").collect() if r.doc_id is not None}
    toxic = {i for i in range(600) if i % 6 == 0}
    assert len(gone & toxic) >= 98 and len(gone - toxic) <= 1
    # One row of each group that all pairs give, the one with the smallest doc_id.
    rows = clean.collect()

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        key = r.doc_id is None, r.doc_id or 0
        least[find(i)] = min(least.get(find(i), key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single.collect()) == sorted(least.values())
    # Every source's words come near its target, and packing keeps every token.
    kept = single.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    total = kept.agg(F.sum("n")).first()[0]
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == pytest.approx(total, rel=0.01)
    pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want"), F.count_distinct("start").alias("k"), F.count("*").alias("rows")).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.select("doc_id").collect()}
    assert all(r.n % r.want == 0 for r in pieces)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_pipeline_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/in/{name}.parquet")
    assert [s.count() for s in through(spark, f"{tmp_path}/in", f"{tmp_path}/out")] == [0] * 4


def test_one_of_each_by_join_and_on_repeats(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = sorted(jaccard_join.one_of_each(docs).collect(), key=str)
    assert len(want) == len({r.doc_id for r in want})
    monkeypatch.setattr(jaccard_join, "TOLD", 3)
    assert sorted(jaccard_join.one_of_each(docs).collect(), key=str) == want
    assert jaccard_join.one_of_each(docs.limit(0)).collect() == []


def test_drop_toxic_on_odd_rows(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "vilest foulx rottenly " * 30, 6), (2, "w1 w2", 7), (2, "w1 w2", 7)], "doc_id long, text string, score int")
    assert sorted((r.doc_id, r.text or "") for r in toxicity.drop_toxic(odd, model).collect()) == [(1, ""), (1, ""), (2, "w1 w2"), (2, "w1 w2")]
    assert toxicity.drop_toxic(odd.limit(0), model).collect() == []
    # Repeated labels and rows, and a bound on bytes that leaves few texts, still give a field.
    assert toxicity.train(docs.unionByName(docs), labels.unionByName(labels), most=20_000).scale[0] > 0


WANT = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_source_mix": "doc_id size source_size target taken",
    "op3_license_scan": "doc_id digest license_id",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_vector_dedup": "vec_id n_links component_id kept",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_pitman_yor": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_topk_search": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", WANT)
def test_registered_queries(spark, name):
    got = queries.queries()[name](spark, SF)
    assert set(WANT[name].split()) <= set(got.columns)
    rows = got.collect()
    table, key = {"op4": ("pages", "page_id"), "op6": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name.split("_")[0] not in ("op9", "op10"):
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if "held_out" in got.columns:
        m = 5 if name.startswith("op5") else 10
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == 0) for r in rows)


def test_pipeline_as_registered(spark, tmp_path):
    shutil.copytree(SF, f"{tmp_path}/sf", ignore=lambda d, names: [n for n in names if n.split(".")[0] not in ("sf0", "documents", "labels")])
    assert corpus_pipeline.queries()["pipeline"](spark, f"{tmp_path}/sf").count() > 0
