"""Operators that order rows: thresholds, numbering, samples, folds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import letters


def accuracy_threshold(scored: DataFrame, margin: str, correct: str, key: str, target: float = 0.999) -> DataFrame:
    """The margin down to which answers stay right in at least `target` of cases: rows run from
    the largest margin, and the last position whose running mean reaches the target counts. If
    none does it is the largest margin; without rows it is 0.

    Running sums are first made inside ranges of margins and then shifted by what lies above
    each range, so no task has to hold or walk all rows.
    """
    cuts = scored.approxQuantile(margin, [i / 64 for i in range(1, 64)], 0.001) if scored.take(1) else []
    m = F.col(margin)
    part = sum((F.when(m <= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = scored.select(m.alias("m"), F.col(correct).cast("int").alias("c"), F.col(key).alias("k"), part.alias("p"))
    sums = rows.groupBy("p").agg(F.sum("c").alias("pc"), F.count("*").alias("pn"))
    above = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    before = sums.select("p", F.coalesce(F.sum("pc").over(above), F.lit(0)).alias("c0"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("n0"))
    run = Window.partitionBy("p").orderBy(F.desc("m"), "k").rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.col("c0") + F.sum("c").over(run)) / (F.col("n0") + F.count("*").over(run))
    walked = rows.join(F.broadcast(before), "p").withColumn("mean", mean)
    return walked.agg(F.coalesce(F.min(F.when(F.col("mean") >= target, F.col("m"))), F.max("m"), F.lit(0.0)).alias("threshold"))


def top2_margin(scores: Column) -> Column:
    """The gap between the two highest scores; of a single score its size."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) == 1, F.abs(s[0])).otherwise(s[0] - s[1])


def numbered(sizes: DataFrame, size: str, name: str, out: str) -> DataFrame:
    """Groups numbered from 1 by size, larger first, then by name. Groups are few."""
    return sizes.withColumn(out, F.row_number().over(Window.orderBy(F.desc(size), name)))


def cluster_letters(df: DataFrame, cluster: str) -> DataFrame:
    """A legend: each cluster, its number of rows, and A, B, ..., AA by size."""
    n = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return numbered(n, "n", cluster, "_r").withColumn("letter", letters(F.col("_r") - 1)).drop("_r")


def new_group_names(df: DataFrame, group: str) -> DataFrame:
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return numbered(n, "n", group, "_r").select(group, "n", F.concat(F.lit("NEW_"), F.col("_r").cast("string")).alias("name"))


def tell_apart(names: DataFrame, group: str, name: str, size: str) -> DataFrame:
    """Groups with one name get numbers, the largest first; a name of one group stays."""
    same = Window.partitionBy(name)
    rank = F.row_number().over(same.orderBy(F.desc(size), group))
    shown = F.when(F.count("*").over(same) > 1, F.concat(F.col(name), F.lit(" ("), rank.cast("string"), F.lit(")"))).otherwise(F.col(name))
    return names.withColumn("unique_name", shown)


def nearest_to_centroid(df: DataFrame, group: str, key: str, similarity: str, n: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(similarity), key))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def every_kth_class(df: DataFrame, label: str, share: float) -> DataFrame:
    """Every k-th class by frequency, k = max(2, round(1 / share))."""
    k = max(2, round(1 / share))
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return numbered(n, "n", label, "_r").filter((F.col("_r") - 1) % k == 0).drop("_r")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, least: int = 5, seed: int = 0) -> DataFrame:
    """A fold for each row of a class with at least `least` rows (others train only: null). With
    few rows in the smallest such class there are fewer folds, but at least two."""
    n = F.count("*").over(Window.partitionBy(label))
    with_n = df.withColumn("_n", n)
    smallest = with_n.filter(F.col("_n") >= least).agg(F.min("_n")).first()[0]
    k = max(2, min(folds, smallest or folds))
    order = F.row_number().over(Window.partitionBy(label).orderBy(dealt(key, seed), key))
    return with_n.withColumn("fold", F.when(F.col("_n") >= least, (order - 1) % k).cast("int")).drop("_n")


def dealt(key: str, seed: int) -> Column:
    """Hex digits that put keys into an order that looks random and is the same in every run."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that every run draws alike."""
    return df.orderBy(dealt(key, seed), key).limit(n)


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def batches(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Rows in batches of at most `size`. Lanes of about 64 batches are numbered on their own, so
    there is no single order over all rows; only the last batch of a lane may be smaller."""
    lanes = max(1, -(-df.count() // (64 * size)))
    lane = F.conv(F.substring(dealt(key, seed), 1, 8), 16, 10).cast("long") % lanes
    order = F.row_number().over(Window.partitionBy("_lane").orderBy(key))
    return df.withColumn("_lane", lane).withColumn("batch", F.concat_ws("-", F.col("_lane"), F.floor((order - 1) / size))).drop("_lane")


def fixed_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batches in the order of the key, for tables that are small by nature (a taxonomy)."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("long"))


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, by an order column."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def review_queue(df: DataFrame, cluster: str | None = None, search: str = "", flagged: bool = False, most: int = 300) -> DataFrame:
    """What an expert sees: rows of a cluster, flagged ones if asked, that hold a text in number,
    description or cluster; the least certain first; `most` rows."""
    rows = df if cluster is None else df.filter(F.col("cluster_name") == cluster)
    rows = rows.filter("needs_review") if flagged else rows
    if search:
        rows = rows.filter(sum((F.contains(F.lower(c), F.lit(search.lower())).cast("int") for c in ("pn", "description", "cluster_name")), F.lit(0)) > 0)
    return rows.orderBy("confidence", "pn").limit(most)


def cluster_summary(df: DataFrame, cluster: str, confidence: str, source: str, sources: list[str]) -> DataFrame:
    """Rows, mean confidence and rows by source for each cluster; sources without rows count 0."""
    by = [F.count(F.when(F.col(source) == s, 1)).alias(s) for s in sources]
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), *by)


def relevant_lines(docs: DataFrame, key: str, text: str, pattern: str, most: int = 120, head_lines: int = 30, around: int = 2) -> DataFrame:
    """Lines worth reading: a short text whole; of a longer one its head and what lies around
    telling lines, found from the top until `most` lines are kept; in order, `most` at most."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key)
    near = w.orderBy("pos").rowsBetween(-around, around)
    lines = lines.withColumn("n", F.count("*").over(w)).withColumn("hit", F.col("line").rlike(pattern))
    lines = lines.withColumn("kept", (F.col("pos") < head_lines) | F.max("hit").over(near))
    # When a telling line at p is taken in, everything kept up to p + around is there.
    run = F.sum(F.col("kept").cast("int")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("rank", run)
    return lines.filter((F.col("n") <= most) | (F.col("kept") & (F.col("rank") <= most))).select(key, "pos", "line")
