"""How well clusters agree with labels: everything from one contingency table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("y"), F.col(cluster).alias("c")).agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """One row: rows, and sums of squares and of n ln n, for cells and both margins."""
    both = table.cube("y", "c").agg(F.sum("n").alias("n"), F.grouping("y").alias("gy"), F.grouping("c").alias("gc"))
    at = lambda gy, gc, e: F.sum(F.when((F.col("gy") == gy) & (F.col("gc") == gc), e))
    n = F.col("n").cast("double")
    out = {"t": at(1, 1, n)}
    for name, (gy, gc) in {"ab": (0, 0), "a": (0, 1), "b": (1, 0)}.items():
        out |= {f"q_{name}": at(gy, gc, n * n), f"l_{name}": at(gy, gc, n * F.ln(n))}
    return both.agg(*[F.coalesce(e, F.lit(0.0)).alias(k) for k, e in out.items()])


def pair_metrics(table: DataFrame) -> DataFrame:
    """Precision, recall, F1, Rand index and adjusted Rand index over ordered pairs."""
    s = _sums(table).select((F.col("q_ab") - F.col("t")).alias("tp"), (F.col("q_b") - F.col("q_ab")).alias("fp"), (F.col("q_a") - F.col("q_ab")).alias("fn"), "t")
    s = s.withColumn("tn", F.col("t") * F.col("t") - F.col("tp") - F.col("fp") - F.col("fn") - F.col("t"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    ari = F.when((fp == 0) & (fn == 0), 1.0).otherwise(F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    return s.select(p.alias("pair_precision"), r.alias("pair_recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("pair_f1"), F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero).alias("rand"), ari.alias("ari"))


def entropy_metrics(table: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean, which equals the V-measure), homogeneity
    and completeness; 1 where an entropy is 0."""
    t = F.col("t")
    h = lambda c: F.ln(t) - F.col(c) / t
    s = _sums(table).select(h("l_a").alias("hy"), h("l_b").alias("hc"), h("l_ab").alias("hyc"))
    mi, hy, hc = F.col("hy") + F.col("hc") - F.col("hyc"), F.col("hy"), F.col("hc")
    share = lambda a, b: F.when(b < 1e-12, 1.0).otherwise(a / b)
    return s.select(share(2 * mi, hy + hc).alias("nmi"), share(mi, hy).alias("homogeneity"), share(mi, hc).alias("completeness"), share(2 * mi, hy + hc).alias("v_measure"))


def purity_map(table: DataFrame, top: int = 4) -> DataFrame:
    """For each true class: rows, clusters, dominant cluster, purity, and its commonest clusters."""
    w = Window.partitionBy("y")
    r = table.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "c"))).withColumn("total", F.sum("n").over(w))
    shown = F.when(F.col("rank") <= top, F.struct("rank", F.concat(F.col("c").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("s")))
    agg = r.groupBy("y").agg(F.max("total").alias("n"), F.count("*").alias("n_clusters"), F.min(F.when(F.col("rank") == 1, F.col("c"))).alias("dominant"), (F.max("n") / F.max("total")).alias("purity"), F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]).alias("d"))
    return agg.withColumn("distribution", F.array_join("d", ", ")).drop("d")


def worst_classes(purity: DataFrame, least: int = 20, most: int = 12) -> DataFrame:
    return purity.filter(F.col("n") >= least).orderBy("purity", "y").limit(most)


def assign(weight: np.ndarray) -> float:
    """The largest total weight of a one-to-one choice of rows and columns, by shortest
    augmenting paths with potentials."""
    cost = -np.asarray(weight, float)
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        best, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            gap = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            closer = ~done[1:] & (gap < best[1:])
            best[1:][closer], back[1:][closer] = gap[closer], at
            to = 1 + int(np.argmin(np.where(done[1:], np.inf, best[1:])))
            step = best[to]
            np.add.at(u, owner[done], step)
            v[done] -= step
            best[~done] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return float(-sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


def matching_accuracy(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The share of rows on the best one-to-one matching of labels and clusters. The contingency
    table reaches the driver; it has a row for each pair of a label and a cluster that occurs."""
    rows = table.collect()
    y, c = ({v: i for i, v in enumerate(sorted({r[k] for r in rows}, key=str))} for k in ("y", "c"))
    m = np.zeros((max(1, len(y)), max(1, len(c))))
    for r in rows:
        m[y[r.y], c[r.c]] = r.n
    return spark.createDataFrame([(float(assign(m) / max(1.0, m.sum())),)], "matching_accuracy double")


def naming_accuracy(df: DataFrame, group: str, proposed: str, true: str, hit) -> DataFrame:
    """Share of parts, and of groups, whose proposed name fits the commonest true one."""
    n = df.groupBy(group, true).agg(F.count("*").alias("m"), F.min(proposed).alias("p"))
    best = n.groupBy(group).agg(F.min(F.struct((-F.col("m")).alias("k"), F.col(true).alias("t")))["t"].alias("t"), F.sum("m").alias("m"), F.min("p").alias("p"))
    right = hit(F.col("p"), F.col("t")).cast("double")
    return best.agg((F.sum(right * F.col("m")) / F.sum("m")).alias("by_parts"), F.avg(right).alias("by_groups"))
