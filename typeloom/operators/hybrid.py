"""The layered classifier: overrides, a linear classifier that may decline, and discovery."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import linear
from .clustering import cluster
from .encoders import apply_head, contrast_head
from .entities import min_class_size
from .ranking import accuracy_threshold, every_kth_class, new_group_names, stratified_folds


@dataclass
class Settings:
    """Defaults of the layers."""

    target: float = 0.999
    threshold: float | None = None
    discovery: float = 0.60
    least: int = 2
    least_scored: int = 5
    folds: int = 5
    c: float = 1.0
    seed: int = 0
    head: bool = False


def drawn(df: DataFrame, vector: str, head: np.ndarray | None) -> DataFrame:
    """df with its vectors drawn through a head, if there is one."""
    if head is None:
        return df
    return apply_head(df.withColumnRenamed(vector, "features"), head).withColumnRenamed("features", vector)


def head_for(df: DataFrame, key: str, vector: str, label: str) -> np.ndarray:
    return contrast_head(df.select(key, F.col(vector).alias("features")), df, key, label)


def out_of_fold(df: DataFrame, key: str, vector: str, label: str, settings: Settings) -> DataFrame:
    """Honest predictions: each row of a class that is large enough is scored by a model (and a
    head, if asked for) that has not seen its fold; rows of small classes only train."""
    folded = stored(stratified_folds(df, label, key, settings.folds, settings.least_scored, settings.seed))
    out = None
    for (k,) in folded.filter("fold IS NOT NULL").select("fold").distinct().orderBy("fold").collect():
        train = folded.filter((F.col("fold") != k) | F.col("fold").isNull())
        head = head_for(train, key, vector, label) if settings.head else None
        model = linear.fit(drawn(train, vector, head), vector, label, settings.c)
        part = linear.predict(model, drawn(folded.filter(F.col("fold") == k), vector, head), vector)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else folded.withColumn("predicted", F.lit(None).cast("string")).withColumn("margin", F.lit(0.0)).filter("false")


def quality(oof: DataFrame, label: str, threshold: float) -> DataFrame:
    """Accuracy, coverage and accuracy of what is accepted."""
    right, taken = (F.col("predicted") == F.col(label)).cast("double"), F.col("margin") >= threshold
    return oof.agg(F.avg(right).alias("accuracy"), F.avg(taken.cast("double")).alias("coverage"), F.avg(F.when(taken, right)).alias("accepted_accuracy"))


def threshold_for_coverage(margins: DataFrame, margin: str, coverage: float) -> DataFrame:
    """The margin that accepts a share of rows: an exact quantile, carried to another model."""
    return margins.agg(F.percentile(margin, F.lit(1 - coverage)).alias("threshold"))


class HybridClassifier:
    """Layer 0: expert overrides. Layer 1: the linear classifier, accepted at or above a margin
    that out-of-fold accuracy sets. Layer 2: what it declines is clustered, each group a new type."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.model, self.head, self.threshold, self.report = None, None, 0.0, None

    def fit(self, df: DataFrame, key: str, vector: str, label: str, overrides: DataFrame | None = None) -> HybridClassifier:
        s = self.settings
        rows = df.select(key, vector, label).withColumn("is_override", F.lit(False))
        if overrides is not None:
            named = overrides.select(F.col(key), F.col("cluster"))
            rows = rows.join(named, key, "left").withColumn("is_override", F.col("cluster").isNotNull()).withColumn(label, F.coalesce("cluster", label)).drop("cluster")
        rows = stored(min_class_size(rows.filter(F.col(label).isNotNull()), label, F.col("is_override"), s.least).drop("is_override"))
        oof = stored(out_of_fold(rows, key, vector, label, s))
        scored = oof.select(key, "margin", (F.col("predicted") == F.col(label)).alias("correct"))
        found = accuracy_threshold(scored, "margin", "correct", key, s.target).first()["threshold"]
        self.threshold = found if s.threshold is None else s.threshold
        self.report = quality(oof, label, self.threshold)
        self.head = head_for(rows, key, vector, label) if s.head else None
        self.model = linear.fit(drawn(rows, vector, self.head), vector, label, s.c)
        return self

    def predict(self, df: DataFrame, key: str, vector: str, overrides: DataFrame | None = None) -> DataFrame:
        """df with cluster_name, source, confidence and needs_review."""
        rows = linear.predict(self.model, drawn(df, vector, self.head), vector)
        named = overrides.select(F.col(key), F.col("cluster").alias("own")) if overrides is not None else None
        rows = stored(rows.join(named, key, "left") if named is not None else rows.withColumn("own", F.lit(None).cast("string")))
        declined = rows.filter(F.col("own").isNull() & (F.col("margin") < self.threshold))
        groups = cluster(declined, key, vector, self.settings.discovery)
        new = groups.join(new_group_names(groups, "cluster"), "cluster").select(key, F.col("name").alias("new"))
        met = rows.join(new, key, "left")
        source = F.when(F.col("own").isNotNull(), "override").when(F.col("new").isNull(), "classifier").otherwise("discovered")
        name = F.coalesce("own", "new", "predicted")
        confidence = F.when(F.col("own").isNotNull(), 1.0).otherwise(F.col("margin"))
        return met.select(*df.columns, name.alias("cluster_name"), source.alias("source"), confidence.alias("confidence"), (source == "discovered").alias("needs_review"))

    @property
    def labels(self) -> list[str]:
        return self.model.labels if self.model else []

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings, threshold, head, labels and weights; no training rows."""
        facts = {**asdict(self.settings), "threshold": float(self.threshold), "drawn": None if self.head is None else self.head.tolist()}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")
        rows = [(label, w.tolist()) for label, w in zip(self.model.labels, self.model.weights)]
        spark.createDataFrame(rows, "label string, weights array<double>").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HybridClassifier:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        drawn_by = facts.pop("drawn", None)
        self = cls(Settings(**facts))
        self.threshold, self.head = facts["threshold"], None if drawn_by is None else np.array(drawn_by)
        rows = spark.read.parquet(f"{path}/weights").orderBy("label").collect()
        self.model = linear.LinearModel([r.label for r in rows], np.array([r.weights for r in rows]))
        return self


def simulate_new_types(df: DataFrame, key: str, vector: str, label: str, share: float = 0.2, settings: Settings | None = None) -> DataFrame:
    """Hide every k-th class, fit on the others, and see how many hidden rows are declined, how
    many known ones wrongly so, and how right accepted ones are."""
    hidden = every_kth_class(df, label, share).select(label)
    known = stored(df.join(hidden, label, "left_anti"))
    model = HybridClassifier(settings).fit(known, key, vector, label)
    out = model.predict(df, key, vector).join(hidden.withColumn("hidden", F.lit(True)), label, "left")
    is_hidden, declined = F.coalesce("hidden", F.lit(False)), F.col("source") == "discovered"
    share_of = lambda c, among: F.avg(F.when(among, c.cast("double")))
    return out.agg(share_of(declined, is_hidden).alias("novelty_recall"), share_of(declined, ~is_hidden).alias("false_alarm"), share_of(F.col("cluster_name") == F.col(label), ~is_hidden & ~declined).alias("accepted_accuracy"))
