"""A landing directory as a stream: only the layers that look at one part at a time may run here,
for groups of new types depend on everything that is clustered with them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ALLOWED, MOST_BYTES = (".csv", ".xlsx", ".xls"), 200 * 1024 * 1024


def safe_name(name: str, size: int) -> str:
    """A landing name without path or odd characters; other kinds and larger files are refused."""
    base = re.sub(r"[^A-Za-z0-9._-]", "_", name.replace("\\", "/").rsplit("/", 1)[-1])
    if not base.lower().endswith(ALLOWED):
        raise ValueError(f"not one of {', '.join(ALLOWED)}: {name}")
    if size > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes: {name}")
    return base


def landing_stream(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 64) -> DataFrame:
    """Delimited files of strings that arrive in a directory."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).option("sep", ";").option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def first_layers(stream: DataFrame, overrides: DataFrame, description: Column, rule: Callable[[Column], Column], key: str = "pn") -> DataFrame:
    """Overrides, then a rule for one part at a time; a stream-static join and projections."""
    met = stream.join(overrides.select(key, "cluster"), key, "left")
    source = F.when(F.col("cluster").isNotNull(), "override").otherwise("rule")
    return met.withColumn("source", source).withColumn("cluster_name", F.coalesce("cluster", rule(description))).drop("cluster")


def typed_counts(stream: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each kind by window of event time; late rows count until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), kind).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take in what has arrived, append it as Parquet exactly once, and stop."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
