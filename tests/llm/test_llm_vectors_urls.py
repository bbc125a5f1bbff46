"""Operators on vectors and urls, and connected components, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from typeloom.llm import common, topk_search, url_filter, vector_dedup

NAN, INF = float("nan"), float("inf")


def test_components_against_a_walk(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(7, 7)]
    rng.shuffle(edges)
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = [s]
            while todo:
                x = todo.pop()
                if want.setdefault(x, s) == s:
                    todo += [y for y in near[x] if y not in want]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, run) -> int:
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_few_edges_need_few_jobs_and_many_go_by_rounds(spark, monkeypatch):
    rng = random.Random(6)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)], "a long, b long")
    found = []
    assert jobs_of(spark, lambda: found.append(common.components(edges))) <= 8
    for few in (0, 40):  # rounds alone, and rounds that one task ends
        monkeypatch.setattr(common, "FEW", few)
        assert sorted(common.components(edges).collect()) == sorted(found[0].collect())


def test_a_filter_is_collected_in_one_job(spark, monkeypatch):
    keys = spark.range(4000).withColumnRenamed("id", "key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = []
        assert jobs_of(spark, lambda: found.append(url_filter.build_level(keys, 7, 12))) <= 6
        monkeypatch.setattr(url_filter, "AT_ONCE", 0)
        assert (found[0].words == url_filter.build_level(keys, 7, 12).words).all()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def vectors(seed, n=700, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 150] = x[0] + 0.05 * rng.standard_normal((150, dim))
    x[-40:] = x[1]
    rows = [(i, int(rng.integers(0, 3)), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * dim, [NAN] * dim, [INF] + [0.0] * (dim - 1), [None] * dim, [1.0] * 3, [2.0] * 3]
    rows += [(n + i, 0, v, 1) for i, v in enumerate(odd)]
    return [*rows, (n + 50, None, rows[-45][2], 1), (n + 51, 0, [-0.0] + [1.0] * (dim - 1), 1), (n + 52, 0, [0.0] + [1.0] * (dim - 1), 1), rows[3]]


KINDS = "vec_id long, label int, embedding array<float>, n int"


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    monkeypatch.setattr(vector_dedup, "PER_CELL", 8)
    rows = vectors(seed)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()
    assert len(got) == len(rows)
    fine = [r for r in rows if r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    links, root = [0] * len(fine), list(range(len(fine)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fine):
        for j, b in enumerate(fine[:i]):
            if a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(np.float32(a[2]), float), np.array(np.float32(b[2]), float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(fine):
        least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = {r[0]: (links[i], least[find(i)]) for i, r in enumerate(fine)}
    found = [r for r in got if want.get(r.vec_id, (0, r.vec_id)) == (r.n_links, r.component_id)]
    assert sum(r.n_links for r in got) >= 0.99 * (2 * sum(links) / 2 - 2)
    assert len(found) >= len(got) - 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_hard_pairs(spark):
    """Thousands of pairs whose cosine is just above the threshold; the grid at its usual grain."""
    rng = np.random.default_rng(3)
    x = vector_dedup.unit(rng.standard_normal((3000, 24)))
    noise = rng.standard_normal(x.shape)
    noise = vector_dedup.unit(noise - (noise * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.98, 0.99, (len(x), 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * noise])
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, 0, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, label int, embedding array<double>, n int")).collect()}
    want = both @ both.T >= 0.98
    np.fill_diagonal(want, False)
    assert want.sum() >= 5900
    assert sum(r.n_links for r in got.values()) >= 0.99 * want.sum()
    assert all(got[i].n_links <= n for i, n in enumerate(want.sum(1)))


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(0)
    m = vector_dedup.fit(vector_dedup.unit(rng.standard_normal((500, 8))), 5000, 0.9)
    x = vector_dedup.unit(rng.standard_normal((5, 8)))
    for a, b in zip(*m.distances(x)):
        got = m.traverse(a, b)
        cost = (a[:, None] + b[None, :]).reshape(-1)
        assert set(got) == set(np.flatnonzero(cost <= cost.min() + m.slack).tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    monkeypatch.setattr(topk_search, "CHUNK", 8)
    rows = vectors(seed)[:-1]
    rows += [(5000, 0, [1e30] * 12, 1), (5001, 0, [1e7, -1e7] * 6, 1), (None, 0, [1.0] * 12, 1)]
    got = topk_search.top_k(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 10 == 0).collect()
    fine = [(r[0], [min(max(int(np.floor(256 * float(np.float32(x)))), -(1 << 63)), (1 << 63) - 1) for x in r[2]]) for r in rows if r[0] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    want = set()
    for q, v in fine:
        if q % 10 == 0:
            s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in fine if i != q and len(w) == len(v))
            want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:5])}
    assert {tuple(r) for r in got} == want


URLS = ["http://a.example.org/en/1?x", "https://example.org/es/2", "HTTP://Www.Example.ORG/fr/", "https://x.com/de/7#t", "http://com/fr/", "http://xcom/fr/", "http://x.net/en", "no scheme", None, "", "ftp://org", "http://org/", "http://b.com?/fr/", "http://notexample.org/es/", "a://b://c.com/de/1"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    want = ["example.org/en/1", "example.org/es/", "org/", "com/de/", "com/fr/", None, None, None, None, None, None, "org/", None, "org/", None]
    verdicts = {"example.org/en/1": "block", "example.org/es/": "block", "com/de/": "block"}
    assert [got[i] for i in range(15)] == [(r, verdicts.get(r, "allow")) for r in want]
    assert url_filter.url_filter(pages.filter("false")).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules=[]).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    listed = keys[::37]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = url_filter.build_cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"), bits_per_key=3)
    assert len(levels) > 2
    cols = [url_filter.level_hash(F.col("key"), x.seed).alias(f"h{i}") for i, x in enumerate(levels)]
    rows = universe.select("key", *cols).collect()
    got = url_filter.member(levels, [np.array([r[f"h{i}"] for r in rows]) for i in range(len(levels))])
    assert {r.key for r, m in zip(rows, got) if m} == set(listed)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    assert vector_dedup.near_duplicates(none).count() == 0
    assert topk_search.top_k(none, F.col("vec_id") % 10 == 0).count() == 0


def test_visits_leave_a_task_in_bounded_frames(monkeypatch):
    """All of a batch's visits arrive, but never all at once."""
    from types import SimpleNamespace

    monkeypatch.setattr(topk_search, "VISITS", 50)
    d = SimpleNamespace(bounds=lambda q: np.arange(30.0), rows=np.full(30, 100), blocks=np.full(30, 3), cell=np.arange(30))
    b = pd.DataFrame({"ask": range(20), "id": range(20), "v": [np.zeros(2, "<i8").tobytes()] * 20, "chunk": 0, "floor": [None] * 20})
    frames = list(topk_search.planned(d, b, 5, False))
    assert max(map(len, frames)) < 60
    every = pd.concat(frames)
    assert len(every) == len(every.drop_duplicates(["ask", "cell", "block"])) == 20 * 29 * 3
