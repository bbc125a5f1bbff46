"""From records to one row a part: lookups, modes, medians, overrides and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NO_DESCRIPTION, clean_str, is_unlabelled


def ensure_columns(df: DataFrame, names: list[str], fill: str = "") -> DataFrame:
    """df with every named column; those it lacks are filled."""
    return df.withColumns({n: F.lit(fill) for n in names if n not in df.columns})


def present_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that df has, in the given order."""
    return df.select([n for n in names if n in df.columns])


def mode_value(df: DataFrame, keys: list[str], value: str, out: str, empty: str = "") -> DataFrame:
    """The commonest non-blank value of each group; of equally common ones the smallest; `empty`
    where there is none. Counted before it is ranked, so a large group costs a row a value."""
    v = clean_str(F.col(value))
    counts = df.select(*keys, v.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    rank = F.when(F.trim("_v") != "", F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
    return counts.groupBy(*keys).agg(F.coalesce(F.min(rank)["v"], F.lit(empty)).alias(out))


def modes(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """mode_value of several columns at once, from one pass: values maps columns to new names."""
    pairs = F.explode(F.array(*[F.struct(F.lit(out).alias("c"), clean_str(F.col(c)).alias("v")) for c, out in values.items()]))
    counts = df.select(key, pairs.alias("p")).groupBy(key, F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(F.count("*").alias("n"))
    best = [F.coalesce(F.min(F.when((F.col("c") == out) & (F.trim("v") != ""), F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))["v"], F.lit("")).alias(out) for out in values.values()]
    return counts.groupBy(key).agg(*best)


def distinct_concat(value: Column, most: int = 400) -> Column:
    """An aggregate: the different non-blank values in order, joined and cut; a fixed text if none."""
    kept = F.array_sort(F.collect_set(F.when(F.trim(value) != "", value)))
    return F.coalesce(F.nullif(F.substring(F.array_join(kept, " ; "), 1, most), F.lit("")), F.lit(NO_DESCRIPTION))


def dedup_to_parts(records: DataFrame, key: str, description: str, fields: dict[str, str]) -> DataFrame:
    """One row a part: its descriptions, the mode of each field, and its number of records."""
    base = records.groupBy(key).agg(distinct_concat(F.col(description)).alias("MATDESC"), F.count("*").alias("n_rows"))
    return base.join(modes(records, key, fields), key) if fields else base


def physics(records: DataFrame, key: str, weight: Column, volume: Column, value: Column) -> DataFrame:
    """Medians a part of weight, volume and value, and density as the ratio of the medians."""
    agg = records.groupBy(key).agg(F.median(weight).alias("weight_g"), F.median(volume).alias("volume_cm3"), F.median(value).alias("value_eur"))
    return agg.withColumn("density", F.try_divide("weight_g", "volume_cm3"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default: Column) -> DataFrame:
    """A dictionary lookup as a left join with a default; of repeated keys the smallest value
    counts, so rows never multiply. Spark broadcasts the table if its size allows."""
    one = table.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v"))
    return df.join(one, df[key] == one["_k"], "left").withColumn(out, F.coalesce("_v", default)).drop("_k", "_v")


def keep_matching(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi")


def keep_missing(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key a cache or map lacks."""
    return df.join(known.select(key), key, "left_anti")


def labelled_union(own: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of own, and those of extra with keys that own lacks; missing columns become null."""
    return own.unionByName(keep_missing(extra, own, key), allowMissingColumns=True)


def label_mode(df: DataFrame, key: str, label: str, out: str = "label") -> DataFrame:
    """The commonest label that is not `tbd` (equality ignoring case); `tbd` where there is none."""
    return mode_value(df.withColumn(label, F.when(~is_unlabelled(F.col(label), "equals"), F.col(label)).otherwise("")), [key], label, out, "tbd")


def label_list(df: DataFrame, label: str) -> DataFrame:
    bad = F.lower(F.trim(label)).isin("tbd", "nan", "none", "")
    return df.filter(F.col(label).isNotNull() & ~bad).select(F.trim(label).alias("label")).distinct()


def min_class_size(df: DataFrame, label: str, is_override: Column, least: int = 2) -> DataFrame:
    """Rows of classes with `least` rows or more, or that an expert named."""
    w = Window.partitionBy(label)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("_o", F.max(is_override).over(w)).filter((F.col("_n") >= least) | F.col("_o")).drop("_n", "_o")


def upsert_overrides(old: DataFrame, new: DataFrame, key: str = "pn", value: str = "cluster") -> DataFrame:
    """Old and new assignments merged; a new one replaces an old one with its key."""
    both = old.select(key, value, F.lit(0).alias("v")).unionByName(new.select(key, value, F.lit(1).alias("v")))
    return both.groupBy(key).agg(F.max_by(value, F.struct("v", value)).alias(value))


def phrase_corrections(parts: DataFrame, overrides: DataFrame, key: str, phrase: str, group: str) -> DataFrame:
    """Phrases whose corrected parts all got one group: that group is carried to the phrase."""
    met = parts.join(overrides, key)
    return met.groupBy(phrase).agg(F.count_distinct(group).alias("n"), F.min(group).alias(group)).filter("n = 1").select(phrase, group)


def spread_to_records(records: DataFrame, parts: DataFrame, key: str, cluster: str, default: str = "NEEDS_REVIEW") -> DataFrame:
    """Each record with its part's cluster; a default where the part has none."""
    return lookup(records, parts.select(key, cluster), key, cluster, cluster, F.lit(default))
