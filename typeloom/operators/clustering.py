"""Average-linkage clustering by cosine distance, and the discovery of types with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import cosine
from ..sources.tables import stored
from .features import centroids, unit_length

#: Up to so many vectors one task clusters alone; more go round by round, in blocks of rows.
KERNEL_ROWS, BLOCK = 3000, 4096
#: Decimals of vectors and distances that rounds tell apart.
DIGITS = 12


def average_linkage(x: np.ndarray, threshold: float | None = None, k: int | None = None, size: np.ndarray | None = None) -> np.ndarray:
    """Flat clusters of rows by average cosine distance: the closest two merge while they are
    nearer than `threshold`, or until k are left. A zero row is at distance 1 from all others.
    With `size`, a row is the mean of so many vectors of length 1."""
    n = len(x)
    if size is None:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x, size = x / np.where(length > 0, length, 1), np.ones(n)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, label, live = np.array(size, float), np.arange(n), n
    near = d.argmin(1) if n else np.zeros(0, int)
    gap = d[np.arange(n), near] if n else np.zeros(0)
    while live > max(1, k or 1):
        i = int(gap.argmin())
        j = int(near[i])
        if k is None and not gap[i] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        live -= 1
        gap[j] = np.inf
        stale = np.flatnonzero(((near == i) | (near == j)) & np.isfinite(gap))
        for r in {i, *stale.tolist()}:
            near[r] = d[r].argmin()
            gap[r] = d[r, near[r]]
        closer = np.isfinite(gap) & (merged < gap)
        near[closer], gap[closer] = i, merged[closer]
    return np.unique(label, return_inverse=True)[1]


def cluster_small(df: DataFrame, key: str, vector: str, threshold: float | None = None, k: int | None = None, by: str | None = None) -> DataFrame:
    """(key, cluster) with one kernel call for all rows, or for each value of `by`."""
    kind = df.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        return pd.DataFrame({key: rows["k"], "cluster": average_linkage(np.array(rows["v"].tolist(), float), threshold, k)})

    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(by) if by else F.lit(0)).alias("g"))
    return rows.groupBy("g").applyInPandas(run, f"{key} {kind}, cluster long")


def nearest_in(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the clusters of two blocks (or of one, met with itself), each one's nearest in the other
    and its distance; of equally near ones the smallest."""
    rows = rows.sort_values("c")
    one, two = rows[rows["i"] == rows["lo"]], rows[rows["i"] == rows["hi"]]
    a, b = (np.array(r["s"].tolist(), float).reshape(len(r), -1) / r["n"].to_numpy(float)[:, None] for r in (one, two))
    keys, others, same = one["c"].to_numpy(), two["c"].to_numpy(), len(rows) and rows["lo"].iloc[0] == rows["hi"].iloc[0]
    far, at, out = np.full(len(b), np.inf), np.zeros(len(b), int), []
    if not len(a) or not len(b):
        return rows[["c"]].iloc[:0].assign(d=0.0, b=rows["c"].iloc[:0])
    for start in range(0, len(a), 512):
        d = np.round(1 - a[start : start + 512] @ b.T, DIGITS) + 0.0
        if same:
            d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
        else:
            low = d.argmin(0)
            gap = d[low, np.arange(len(b))]
            far, at = np.where(gap < far, gap, far), np.where(gap < far, start + low, at)
        near = d.argmin(1)
        out.append(pd.DataFrame({"c": keys[start : start + 512], "d": d[np.arange(len(d)), near], "b": others[near]}))
    if not same:
        out.append(pd.DataFrame({"c": others, "d": far, "b": keys[at]}))
    met = pd.concat(out)
    return met[np.isfinite(met["d"])]


def cluster_rounds(df: DataFrame, key: str, vector: str, threshold: float, by: str | None = None) -> DataFrame:
    """The same clusters by rounds, inside each value of `by`. The average distance of two clusters
    follows from the sums of their vectors of length 1, so a cluster is one row and there is no table
    of pairs. Vectors equal to DIGITS decimals merge first, as sums in another order differ by less. Average linkage is reducible, so every two clusters that are
    each other's nearest can merge at once: each round compares blocks of clusters, block with block,
    and merges such pairs below the threshold; once KERNEL_ROWS or fewer are left in every group, one
    task a group ends the work. Comparisons are quadratic in a group, rows are not. A cluster is
    named by its smallest key; rows without a vector or a group stay alone."""
    kind = df.schema[key].dataType.simpleString()
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("k"), F.transform(unit_length(v), lambda x: F.round(x, DIGITS)).alias("u"), (F.col(by) if by else F.lit(0)).alias("g"))
    rows = stored(rows.withColumn("z", F.when(F.exists("u", lambda x: x != 0) & (F.lit(threshold) > 0), F.lit("")).otherwise(F.col("k").cast("string"))))
    whole = rows.filter("u IS NOT NULL AND g IS NOT NULL")
    heads = stored(whole.groupBy("g", "u", "z").agg(F.min("k").alias("c"), F.count("*").alias("n")))
    state = heads.select("g", "c", F.col("n").cast("double").alias("n"), F.transform("u", lambda x: x * F.col("n")).alias("s"))
    names = heads.select("c", F.col("c").alias("cluster"))
    while True:
        counts = state.groupBy("g").agg(F.count("*").alias("m"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        if (counts.agg(F.max("m")).first()[0] or 0) <= KERNEL_ROWS:
            names = finished(state, names, threshold, kind)
            break
        dealt = state.join(F.broadcast(counts.filter("m > 1")), "g").withColumn("i", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
        sent = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "c", "n", "s", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
        met = sent.groupBy("g", "lo", "hi").applyInPandas(nearest_in, f"c {kind}, d double, b {kind}")
        near = stored(met.groupBy("c").agg(F.min(F.struct("d", "b")).alias("m")).select("c", F.col("m.b").alias("b"), F.col("m.d").alias("d")).filter(F.col("d") < threshold))
        back = near.select(F.col("b").alias("c"), F.col("c").alias("b"))
        merges = stored(near.join(back, ["c", "b"]).filter("c < b").select(F.col("b").alias("old"), F.col("c").alias("new")))
        if merges.isEmpty():
            closest = near.orderBy("d", F.least("c", "b")).limit(1)  # rounding may hide who is nearest to whom
            merges = stored(closest.select(F.greatest("c", "b").alias("old"), F.least("c", "b").alias("new")))
            if merges.isEmpty():
                break
        gone = state.join(merges, F.col("c") == F.col("old")).select(F.col("new").alias("c"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        kept = state.join(merges.select(F.col("old").alias("c")), "c", "left_anti").join(gone, "c", "left")
        both = F.when(F.col("s2").isNull(), F.col("s")).otherwise(F.zip_with("s", "s2", lambda x, y: x + y))
        state = stored(kept.select("g", "c", (F.col("n") + F.coalesce("n2", F.lit(0.0))).alias("n"), both.alias("s")))
        names = renamed(names, merges)
    alone = rows.filter("u IS NULL OR g IS NULL").select("k", F.col("k").alias("cluster"))
    members = whole.join(heads.select("g", "u", "z", "c"), ["g", "u", "z"]).join(names, "c").select("k", "cluster")
    return members.unionByName(alone).select(F.col("k").alias(key), "cluster")


def renamed(names: DataFrame, merges: DataFrame) -> DataFrame:
    moved = names.join(merges.withColumnRenamed("old", "cluster"), "cluster", "left")
    return stored(moved.select("c", F.coalesce("new", "cluster").alias("cluster")))


def finished(state: DataFrame, names: DataFrame, threshold: float, kind: str) -> DataFrame:
    """names after average linkage of what is left, a kernel call for each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        n = rows["n"].to_numpy(float)
        label = average_linkage(np.array(rows["s"].tolist(), float).reshape(len(n), -1) / n[:, None], threshold, size=n)
        return pd.DataFrame({"old": rows["c"], "new": rows["c"].groupby(label).transform("min")})

    return renamed(names, state.groupBy("g").applyInPandas(run, f"old {kind}, new {kind}"))


def cluster(df: DataFrame, key: str, vector: str, threshold: float = 0.6) -> DataFrame:
    """Average linkage with the kernel or by rounds, whichever suits the number of rows."""
    return cluster_small(df, key, vector, threshold) if df.count() <= KERNEL_ROWS else cluster_rounds(df, key, vector, threshold)


def shortest_name(df: DataFrame, group: str, phrase: str) -> DataFrame:
    """Each group named by its shortest phrase, of equally short ones the first."""
    return df.groupBy(group).agg(F.min_by(phrase, F.struct(F.length(phrase), phrase)).alias("name"))


def centroid_confidence(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Cosine of each row to its group's centroid, 0 where either is missing or zero."""
    c = stored(centroids(df, group, vector))
    return df.join(c, group, "left").withColumn("confidence", cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def flag_least_certain(df: DataFrame, confidence: str = "confidence", share: float = 0.15) -> DataFrame:
    """needs_review for rows below the exact quantile of confidence."""
    cut = df.agg(F.percentile(confidence, F.lit(share)).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("needs_review", F.col(confidence) < F.col("cut")).drop("cut")


def discover_types(parts: DataFrame, key: str, phrase: str, vector: str, threshold: float = 0.75, known: DataFrame | None = None, overrides: DataFrame | None = None, share: float = 0.15) -> DataFrame:
    """Types without labels: phrases that `known` (phrase, group) lacks are clustered by their mean
    vector; corrections by experts then move whole phrases where they agree; confidence is the
    cosine to the group's centroid, and the least certain rows are marked for review.
    Returns parts with type_group, source, confidence and needs_review.
    Tables of a row a phrase, group or correction are written first: each is made once, the plan
    stays short, and Spark knows their sizes, so small ones meet the parts without a shuffle."""
    from .entities import phrase_corrections

    phrases = centroids(parts, phrase, vector).withColumnRenamed("centroid", "v")
    if known is not None:
        phrases = phrases.join(known.select(phrase), phrase, "left_anti")
    if overrides is not None:
        overrides = stored(overrides.select(key, "cluster"))
    grouped = stored(cluster(stored(phrases), phrase, "v", threshold))
    names = shortest_name(grouped, "cluster", phrase)
    groups = grouped.join(names, "cluster").select(phrase, F.col("name").alias("type_group"))
    if known is not None:
        groups = groups.unionByName(known.select(phrase, F.col("group").alias("type_group")))
    source = F.lit("discovered")
    if overrides is not None:
        fixed = phrase_corrections(parts.select(key, phrase), overrides, key, phrase, "cluster").withColumnRenamed("cluster", "fix")
        groups = groups.join(fixed, phrase, "left").select(phrase, F.coalesce("fix", "type_group").alias("type_group"))
    rows = parts.join(stored(groups), phrase, "left").withColumn("type_group", F.coalesce("type_group", phrase))
    if overrides is not None:
        own = overrides.select(F.col(key), F.col("cluster").alias("own"))
        rows = rows.join(own, key, "left").withColumn("source", F.when(F.col("own").isNotNull(), "override").otherwise(source)).withColumn("type_group", F.coalesce("own", "type_group")).drop("own")
    else:
        rows = rows.withColumn("source", source)
    return flag_least_certain(centroid_confidence(rows, "type_group", vector), share=share)
