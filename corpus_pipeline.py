"""From documents to training sequences: toxic documents go, one document of each group of
near-duplicates stays, sources are mixed to their target weights, and what is left is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from typeloom.llm.common import load, materialize
from typeloom.llm.jaccard_join import one_of_each
from typeloom.llm.mixing import mix_documents
from typeloom.llm.packing import pack
from typeloom.llm.toxicity import drop_toxic, train


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: A fitted classifier, a join by shingles, seeded draws and a tokenizer: SQL has none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
