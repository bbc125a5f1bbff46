"""Exact top-k inner products by a pivot-distance index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import kmeans, usable

#: Parameters of the index: rows that pivots are fitted on, pivots, annuli in all, rows a block.
SAMPLE, PIVOTS, CELLS, BLOCK, CHUNK = 4096, 48, 8192, 1024, 1024
#: Products of numbers up to this size sum exactly in doubles; larger ones use Python integers.
EXACT = 1 << 22
LONG = (1 << 63) - 1
#: Visits from which they are handed on, so that a task holds few of them.
VISITS = 20_000


def ints(raw) -> np.ndarray:
    rows = list(raw)
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of long they stop at its ends."""
    if max(np.abs(q.astype(float)).max(initial=0), np.abs(x.astype(float)).max(initial=0)) <= EXACT:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), -LONG - 1, LONG).astype(np.int64)


def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(s) > 8 * k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))][:k]


class Directory:
    """The pivots and, for each annulus (cell) of a pivot: the range of distances to it, the
    longest vector, and the number of rows and blocks. Bounded by CELLS, so tasks receive it."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.cell = np.array([r.cell for r in rows], np.int64)
        self.pivot = np.array([r.pivot for r in rows], np.int64)
        self.lo, self.hi, self.norm = (np.array([r[c] for r in rows], float) for c in ("lo", "hi", "norm"))
        self.rows = np.array([r.n for r in rows], np.int64)
        self.blocks = np.maximum(1, -(-self.rows // BLOCK))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """An upper bound of the inner product of q with any vector of each cell. By the triangle
        inequality |q - x| is at least the gap between |q - p| and the annulus, and q.x =
        (|q|^2 + |x|^2 - |q - x|^2) / 2; also q.x <= q.p + |q| |x - p|."""
        qq = float(q @ q)
        far = np.sqrt(np.maximum(((self.pivots - q) ** 2).sum(1), 0))[self.pivot]
        gap = np.maximum(0, np.maximum(self.lo - far, far - self.hi))
        one = (qq + self.norm**2 - gap**2) / 2
        two = (self.pivots @ q)[self.pivot] + math.sqrt(qq) * self.hi
        bound = np.minimum(one, two)
        return bound + 1e-9 * (np.abs(bound) + qq + self.norm**2) + 1e-6


def planned(d: Directory, b: pd.DataFrame, k: int, first: bool):
    """The visits of a batch of queries to blocks of cells, in frames of about VISITS rows."""
    columns = ["ask", "id", "v", "chunk", "floor", "cell", "block"]
    out = []
    for row, q in zip(b.itertuples(index=False), ints(b["v"]).astype(float) if len(b) else []):
        bound = d.bounds(q)
        order = np.argsort(-bound, kind="stable")
        enough = int(np.searchsorted(np.cumsum(d.rows[order]), 4 * k + 1)) + 1
        if first:
            chosen = order[:enough]
        else:
            rest = order[enough:]
            chosen = rest if pd.isna(row.floor) else rest[bound[rest] >= row.floor]
        for c in chosen:
            out += [(row.ask, row.id, row.v, row.chunk, row.floor, int(d.cell[c]), s) for s in range(d.blocks[c])]
            if len(out) >= VISITS:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """For every row where the condition `is_query` holds, its k best other rows by the inner
    product of floor(scale * x): query_id, rank, vec_id, score.

    Vectors are keyed by their nearest pivot and cut by distance from it into annuli. A query
    first scans the annuli with the highest bounds, until they hold enough rows; its k-th score
    so far then rules out every annulus whose bound is lower, and only the others are scanned.
    Annuli are scanned in blocks of at most BLOCK rows against CHUNK queries, each block giving
    at most k rows a query, so neither copies nor a popular annulus gather in one task.
    Only the pivots' sample (SAMPLE rows) and the directory (at most CELLS rows) are collected.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; vectors of other lengths than the query's are no candidates; rows with the query's id
    count as its own; queries with fewer candidates return them all; repeated query rows count
    once; an empty table gives no rows; other columns are not read.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    mine = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = mine.select(F.col(key).cast("long").alias("id"), is_query.alias("is_query"), F.size(vector).alias("dim"), scaled.alias("v"))
    parts = [top_k_of(rows.filter(F.col("dim") == r.dim).drop("dim"), r.dim, r.n, k, seed) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_k_of(rows: DataFrame, dim: int, n: int, k: int, seed: int) -> DataFrame:
    """top_k for vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").collect()
    pivots = kmeans(np.array([r.v for r in sample], float).reshape(len(sample), dim), PIVOTS, seed=seed)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        p = shared.value
        for b in batches:
            raw = np.array([np.asarray(v, "<i8") for v in b["v"]], "<i8").reshape(len(b), dim)
            x = raw.astype(float)
            d = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)
            near = np.argmin(d, 1)
            exact = np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pd.DataFrame({"id": b["id"], "is_query": b["is_query"].fillna(False).astype(bool), "pivot": near.astype(np.int32), "far": exact, "norm": np.sqrt((x * x).sum(1)), "v": [r.tobytes() for r in raw]})

    index = materialize(rows.mapInPandas(place, "id long, is_query boolean, pivot int, far double, norm double, v binary"), "index")
    rings = int(max(1, min(CELLS // max(1, len(pivots)), n // (BLOCK * len(pivots) // 4 + 1) + 1)))
    reach = index.agg(F.max("far")).first()[0] or 0.0
    ring = F.least(F.lit(rings - 1), F.floor(F.col("far") / F.lit((reach or 1.0) / rings))).cast("int")
    index = index.withColumn("cell", F.col("pivot") * rings + ring)
    directory = Directory(pivots, index.groupBy("cell", "pivot").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("cell").collect())
    book = spark.sparkContext.broadcast(directory)
    n_blocks = F.create_map(*[F.lit(int(x)) for c, b in zip(directory.cell, directory.blocks) if b > 1 for x in (c, b)]) if (directory.blocks > 1).any() else None
    many = F.coalesce(F.element_at(n_blocks, F.col("cell")), F.lit(1)) if n_blocks is not None else F.lit(1)
    points = index.select("cell", F.pmod(F.xxhash64("id", "v"), many).cast("int").alias("block"), "id", "v")
    asks = index.filter("is_query").select("id", "v").distinct().withColumn("ask", F.xxhash64("id", "v"))
    chunks = max(1, -(-asks.count() // CHUNK))
    asks = materialize(asks.withColumn("chunk", F.pmod(F.col("ask"), F.lit(chunks)).cast("int")).withColumn("floor", F.lit(None).cast("long")), "asks")
    schema = "ask long, id long, v binary, chunk int, floor long, cell int, block int"

    def visits(asked: DataFrame, first: bool) -> DataFrame:
        def plan(batches):
            for b in batches:
                yield from planned(book.value, b, k, first)

        return asked.select("ask", "id", "v", "chunk", "floor").mapInPandas(plan, schema)

    def scan(keys, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        s, ids, out = scores_of(ints(q["v"]), ints(x["v"])), x["id"].to_numpy(np.int64), []
        floors = q["floor"].fillna(-LONG - 1).tolist() if q["floor"].notna().any() else [-LONG - 1] * len(q)
        for ask, qid, floor, row in zip(q["ask"], q["id"], floors, s):
            keep = np.flatnonzero((ids != qid) & (row >= floor))
            at = keep[best_of(row[keep], ids[keep], k)] if len(keep) else keep
            out += [(ask, qid, int(ids[i]), int(row[i])) for i in at]
        return pd.DataFrame(out, columns=["ask", "query_id", "vec_id", "score"]).astype("int64")

    def scanned(asked: DataFrame, first: bool) -> DataFrame:
        v = materialize(visits(asked, first), "visits")
        pairs = v.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("chunk").alias("part")).distinct()
        near = points.join(pairs, (points["cell"] == pairs["c"]) & (points["block"] == pairs["b"])).select("c", "b", "part", "id", "v")
        return v.groupBy("cell", "block", "chunk").cogroup(near.groupBy("c", "b", "part")).applyInPandas(scan, "ask long, query_id long, vec_id long, score long")

    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    start = materialize(scanned(asks, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "start")
    floors = start.filter(F.col("rank") == k).select("ask", F.col("score").alias("floor"))
    rest = scanned(asks.drop("floor").join(floors, "ask", "left"), False)
    both = start.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
