"""Embedding near-duplicates by an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize
from .vectors import kmeans, matrix, usable

#: Parameters: rows that codebooks are fitted on, at least, and a code; rows a cell should hold;
#: codes a half at most. The grid grows with the rows up to CODES * CODES cells (some 800 million
#: rows); beyond, cells grow instead.
SAMPLE, PER_CODE, PER_CELL, CODES = 8192, 16, 48, 4096
#: Rows of a block, and the recall that the traversal must reach on the hardest pairs.
BLOCK, RECALL = 512, 0.995
#: Rows, about, that one call compares: many small blocks, or a few large ones.
BUNDLE = 8192


class MultiIndex:
    """Codebooks for both halves of unit vectors, and how far a traversal goes on (slack)."""

    def __init__(self, one: np.ndarray, two: np.ndarray, half: int):
        self.one, self.two, self.half, self.slack = one, two, half, 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def to(a, c):
            return np.maximum((a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T, 0)

        return to(x[:, : self.half], self.one), to(x[:, self.half :], self.two)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return np.argmin(a, 1) * len(self.two) + np.argmin(b, 1)

    def excess(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much farther y's cell is from x than x's nearest cell."""
        a, b = self.distances(x)
        cell, i = self.home(y), np.arange(len(x))
        return a[i, cell // len(self.two)] - a.min(1) + b[i, cell % len(self.two)] - b.min(1)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells of the grid in order of distance from one vector, given its distances to the
        codes of each half, until the distance is more than slack above the nearest cell's.
        Both halves are sorted; a front of one column for each row moves outward."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        u, v = a[i] - a[i[0]], b[j] - b[j[0]]
        ends = np.searchsorted(v, self.slack - u[u <= self.slack], side="right")
        return [int(r) * len(self.two) + int(c) for r, end in zip(i, ends) for c in j[:end]]


def codes_for(rows: int) -> int:
    """Codes of a half for so many rows."""
    return int(max(1, min(CODES, round((rows / PER_CELL) ** 0.5))))


def fit(sample: np.ndarray, rows: int, threshold: float, seed: int = 0) -> MultiIndex:
    """Fit codebooks on unit vectors, and calibrate the slack: of pairs that lie exactly at the
    threshold, the hardest there are, a traversal from either side must reach RECALL."""
    half = (sample.shape[1] + 1) // 2
    codes = codes_for(rows)
    index = MultiIndex(kmeans(sample[:, :half], codes, seed=seed), kmeans(sample[:, half:], codes, seed=seed + 1) if sample.shape[1] > 1 else np.zeros((1, 0)), half)
    rng = np.random.default_rng(seed)
    x = np.repeat(sample, max(1, 4096 // max(1, len(sample))), axis=0)[:8192]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise / np.where(size > 0, size, 1)
    index.slack = float(np.quantile(np.minimum(index.excess(x, y), index.excess(y, x)), RECALL)) + 1e-9
    return index


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, group: str = "label", key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """Link rows of equal, non-null `group` whose cosine in double precision is at least
    `threshold`: key, n_links (rows linked directly), component_id (smallest key reachable), kept.

    Equal vectors of a group become one class, whose rows are linked to each other without
    being paired. Classes lie in the cells of a grid, the product of independent codebooks on
    both halves of the unit vectors; each class visits the nearest cells up to the calibrated
    distance, and every visited pair of cells is compared whole, in blocks of at most BLOCK by
    BLOCK rows. A block returns, for each of its rows, the number of links it found, and edges
    that join what is linked there, at most one less than it has rows; pairs are never listed.
    A pair of cells that either side visits is compared once, so counts are symmetric.
    Only the sample that codebooks are fitted on (SAMPLE vectors, or PER_CODE a code) is collected.
    Equal vectors are told by 64 bits of a hash of group and vector.

    Vectors that are null, empty, zero, or hold null or non-finite components, rows without a
    group and vectors of different lengths link with nothing. A row without a key has no
    component. Repeated rows are rows of their own, linked by their equal vectors. An empty table
    gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = usable(F.col(vector)) & F.exists(v, lambda x: x != 0) & F.col(group).isNotNull()
    clean = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are equal
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(fine, F.col(group).cast("string")).alias("grp"), F.when(fine, clean).alias("v"))
    rows = rows.withColumn("cls", F.when(F.col("grp").isNotNull(), F.xxhash64("grp", "v")))
    classes = rows.filter("grp IS NOT NULL").groupBy("cls").agg(F.first("grp").alias("grp"), F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "classes")
    dims = [(r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    found = [link(classes.filter(F.col("dim") == d), d, n, threshold, seed) for d, n in dims]
    empty = spark.createDataFrame([], "cls long, links long, a long, b long")
    links = empty
    for f in found:
        links = links.unionByName(f)
    links = materialize(links, "links")
    counts = links.filter("links IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(links.filter("a IS NOT NULL").select("a", "b"))
    least = classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    ends = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = classes.select("cls", "n").join(least.select("cls", "root"), "cls").join(ends, "root").join(counts, "cls", "left")
    # Written first, so that the join deals plain rows of both sides and can split a large class.
    known = materialize(known.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "known")
    out = rows.select("id", "cls").join(known, "cls", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def link(classes: DataFrame, dim: int, rows: int, threshold: float, seed: int) -> DataFrame:
    """Links between classes of vectors of one length: rows (cls, links, -, -) that count linked
    rows, to be summed by cls, and rows (-, -, a, b) that join classes."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "cls"), "cls").limit(max(SAMPLE, PER_CODE * codes_for(rows))).select("v").collect()
    raw = np.array([r.v for r in sample], float).reshape(len(sample), dim)
    index = spark.sparkContext.broadcast(fit(unit(raw), rows, threshold, seed))

    def place(batches):
        m = index.value
        for b in batches:
            raw = np.array([np.asarray(v, float) for v in b["v"]]).reshape(len(b), dim)
            x = unit(raw)
            one, two = m.distances(x)
            home = m.home(x)
            yield pd.DataFrame({"cls": b["cls"], "grp": b["grp"], "n": b["n"], "home": home, "visits": [m.traverse(p, q) for p, q in zip(one, two)], "x": [r.tobytes() for r in x]})

    placed = materialize(classes.select("cls", "grp", "n", "v").mapInPandas(place, "cls long, grp string, n long, home long, visits array<long>, x binary"), "placed")
    cells = placed.groupBy("grp", "home").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    visited = placed.select("grp", "home", F.explode("visits").alias("cell")).filter("home != cell")
    visited = visited.select("grp", F.least("home", "cell").alias("lo"), F.greatest("home", "cell").alias("hi")).distinct()
    own = cells.select("grp", F.col("home").alias("lo"), F.col("home").alias("hi"))
    pairs = visited.unionByName(own)
    for side in ("lo", "hi"):  # empty cells drop out here
        pairs = pairs.join(cells.select("grp", F.col("home").alias(side), F.col("blocks").alias(f"b_{side}"), (F.col("m") / F.col("blocks")).alias(f"m_{side}")), ["grp", side])
    tasks = pairs.select("grp", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("b_lo") - 1)).alias("i"), "b_hi", (F.col("m_lo") + F.col("m_hi")).alias("weight"))
    tasks = tasks.select("grp", "lo", "hi", "i", F.explode(F.sequence(F.lit(0), F.col("b_hi") - 1)).alias("j"), "weight").filter("lo != hi OR i <= j")
    tasks = materialize(tasks.withColumn("task", F.xxhash64("grp", "lo", "hi", "i", "j")), "tasks")
    bundles = int((tasks.agg(F.sum("weight")).first()[0] or 0) // BUNDLE) + 1
    rows_ = placed.join(cells.select("grp", "home", "blocks"), ["grp", "home"]).withColumn("block", F.pmod(F.col("cls"), F.col("blocks")).cast("int")).select("grp", "home", "block", "cls", "n", "x")
    left = rows_.join(tasks.select("grp", F.col("lo").alias("home"), F.col("i").alias("block"), "task", "hi", "j", F.lit(0).alias("side"), ((F.col("lo") == F.col("hi")) & (F.col("i") == F.col("j"))).alias("same")), ["grp", "home", "block"])
    right = rows_.join(tasks.filter("lo != hi OR i != j").select("grp", F.col("hi").alias("home"), F.col("j").alias("block"), "task", F.lit(1).alias("side")), ["grp", "home", "block"])
    sent = left.select("task", "side", "cls", "n", "x").unionByName(right.select("task", "side", "cls", "n", "x"))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["task", "side"], kind="stable")
        x, cls, n = matrix(batch["x"]), batch["cls"].to_numpy(), batch["n"].to_numpy(float)
        task, side = batch["task"].to_numpy(), batch["side"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        ids, counts, a, b = [], [], [], []
        for lo, end in zip(starts, [*starts[1:], len(task)]):
            mid = lo + int((side[lo:end] == 0).sum())
            p, q = slice(lo, mid), slice(mid, end) if mid < end else slice(lo, mid)
            near = x[p] @ x[q].T >= threshold
            if q == p:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            for one, links in ((p, near @ n[q]), (q, near.T @ n[p]))[: 1 if q == p else 2]:
                ids += cls[one][links > 0].tolist()
                counts += links[links > 0].astype(np.int64).tolist()
            more_a, more_b = forest(near, cls[p], cls[q])
            a += more_a
            b += more_b
        return frame(ids, counts, a, b)

    return sent.groupBy(F.pmod("task", F.lit(bundles)).alias("bundle")).applyInPandas(compare, "cls long, links long, a long, b long")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    big = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def forest(near: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[list, list]:
    """Edges that join what a block links: for each part that hangs together, one row is joined
    to every other row and column of the part."""
    a, b = [], []
    todo = near.any(1)
    while todo.any():
        first = int(np.argmax(todo))
        rows, cols = np.zeros(len(p), bool), near[first].copy()
        rows[first] = True
        while True:
            more = near[:, cols].any(1) & ~rows
            if not more.any():
                break
            rows |= more
            cols |= near[more].any(0)
        todo &= ~rows
        rows[first] = False
        ends = [*p[rows].tolist(), *q[cols].tolist()]
        a += [int(p[first])] * len(ends)
        b += ends
    return a, b


def frame(ids, counts, a, b) -> pd.DataFrame:
    one = pd.DataFrame({"cls": pd.array(ids, "Int64"), "links": pd.array(counts, "Int64"), "a": pd.array([None] * len(ids), "Int64"), "b": pd.array([None] * len(ids), "Int64")})
    two = pd.DataFrame({"cls": pd.array([None] * len(a), "Int64"), "links": pd.array([None] * len(a), "Int64"), "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})
    return pd.concat([one, two], ignore_index=True)
