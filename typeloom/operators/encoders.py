"""Encoders of texts as vectors, by name: base[+head], with an embedding cache keyed by text.

A plug-in is a function (DataFrame, key, text column) -> DataFrame (key, features array).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored
from .entities import keep_missing
from .features import char_terms, projected, sparse_rows, svd_basis, term_counts, text_cache_key, vocabulary_of, weighted, word_terms

Encoder = Callable[[DataFrame, str, str], DataFrame]
BASES: dict[str, Callable[[dict], Encoder]] = {}
ALIASES = {"tf-idf": "tfidf"}


def base(name: str):
    """Register a maker of encoders (options -> encoder) under a name."""

    def put(make):
        BASES[name] = make
        return make

    return put


def lettered(text: Column) -> list[tuple[str, Column]]:
    """Both kinds of terms of a text, each under its letter."""

    def under(letter: str, terms: Column) -> tuple[str, Column]:
        return letter, F.transform(terms, lambda t: F.concat(F.lit(letter), t))

    return [under("c:", char_terms(text)), under("w:", word_terms(text))]


class TfidfSpace:
    """A vocabulary with idf and a basis, fitted on one table and applied to any: words and pairs
    of words, and runs of characters in words, projected by SVD."""

    def __init__(self, terms: list[str], idf: list[float], basis: np.ndarray):
        self.terms, self.idf, self.basis = terms, idf, basis

    @classmethod
    def fit(cls, df: DataFrame, key: str, text: str, options: dict) -> TfidfSpace:
        sizes = {"c:": options.get("chars", 20_000), "w:": options.get("words", 10_000)}
        rows = df.select(key, F.col(text).alias("_t"))
        n, found = rows.count(), {}
        for letter, terms in lettered(F.col("_t")):
            found |= {r.term: r.idf for r in vocabulary_of(term_counts(rows, key, terms), n, sizes[letter]).collect()}
        space = cls(sorted(found), [found[t] for t in sorted(found)], np.zeros((max(1, len(found)), 1)))
        space.basis = svd_basis(space.sparse(df, key, text), options.get("dim", 200), options.get("seed", 0))
        return space

    def sparse(self, df: DataFrame, key: str, text: str) -> DataFrame:
        rows, known = df.select(key, F.col(text).alias("_t")), stored(df.sparkSession.createDataFrame(list(zip(range(len(self.terms)), self.terms, self.idf)), "at int, term string, idf double"))
        parts = [weighted(term_counts(rows, key, terms), key, known.filter(F.startswith("term", F.lit(letter))).select("term", "idf")) for letter, terms in lettered(F.col("_t"))]
        return sparse_rows(parts[0].unionByName(parts[1]), key, known.select("term", "at"))[0]

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, features); zeros for a text without known terms."""
        zeros = F.array_repeat(F.lit(0.0), self.basis.shape[1])
        made = projected(self.sparse(df, key, text), key, self.basis)
        return df.select(key).distinct().join(made, key, "left").select(key, F.coalesce("features", zeros).alias("features"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.terms)), self.terms, self.idf, self.basis.tolist()))
        spark.createDataFrame(rows, "at int, term string, idf double, basis array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfSpace:
        """A vocabulary is bounded by its options, so it is read whole."""
        rows = spark.read.parquet(path).orderBy("at").collect()
        return cls([r.term for r in rows], [r.idf for r in rows], np.array([r.basis for r in rows]) if rows else np.zeros((1, 1)))


@base("tfidf")
def tfidf_encoder(options: dict) -> Encoder:
    """A TfidfSpace that is fitted on the very table it encodes."""
    return lambda df, key, text: TfidfSpace.fit(df, key, text, options)(df, key, text)


@base("hash")
def hash_encoder(options: dict) -> Encoder:
    """Signed sums of hashed words: no corpus is needed, so it also suits streams."""
    dim = options.get("dim", 128)

    def encode(df: DataFrame, key: str, text: str) -> DataFrame:
        terms = F.explode(word_terms(F.col(text)))
        cell = df.select(key, terms.alias("t")).select(key, F.pmod(F.xxhash64("t"), F.lit(dim)).alias("i"), F.when(F.xxhash64(F.lit(1), "t") >= 0, 1.0).otherwise(-1.0).alias("x"))
        sums = cell.groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
        return df.select(key).distinct().join(sums, key, "left").select(key, dense.alias("features"))

    return encode


def batch_encoder(predict: Callable[[list[str]], np.ndarray]) -> Encoder:
    """An encoder from a function of a batch of texts, such as a pretrained model's."""

    def encode(df: DataFrame, key: str, text: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([v.tolist() for v in np.asarray(predict(texts.fillna("").tolist()), float)])

        return df.select(key, run(text).alias("features"))

    return encode


def contrast_head(rows: DataFrame, labels: DataFrame, key: str, label: str, shrink: float = 0.1) -> np.ndarray:
    """A linear head that draws rows of one label together: it divides by the spread within
    labels. Only the scatter matrix (dim x dim), summed over partitions, reaches the driver."""
    from .features import centroids

    met = rows.join(labels.select(key, label), key)
    met = met.join(centroids(met, label, "features"), label).select("features", "centroid")
    dim = len(met.first()["features"])

    def scatter(batch):
        total = np.zeros((dim, dim))
        for r in batch:
            d = np.array(r["features"]) - np.array(r["centroid"])
            total += np.outer(d, d)
        yield total

    s = met.rdd.mapPartitions(scatter).treeReduce(np.add)
    values, basis = np.linalg.eigh(s / max(np.trace(s) / dim, 1e-12) + shrink * np.eye(dim))
    return basis @ np.diag(values**-0.5) @ basis.T


def apply_head(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """rows with `features` drawn through a head and scaled to length 1."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float) @ head
        return pd.Series((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist())

    return rows.withColumn("features", run("features"))


def fitted(spec: str, df: DataFrame, key: str, text: str, **options) -> Encoder:
    """An encoder that puts any table into the space of df. A head is not part of it: a classifier
    fits that to the labels it may see (Settings.head)."""
    name = spec.partition("+")[0].strip().lower()
    plain = encoder(name, **options)
    return TfidfSpace.fit(df, key, text, options) if ALIASES.get(name, name) == "tfidf" else plain


def save(encode: Encoder, spec: str, spark: SparkSession, path: str) -> None:
    """Keep a fitted encoder beside its classifier; one that needs no corpus is kept by its name."""
    spark.createDataFrame([(spec,)], "spec string").write.mode("overwrite").parquet(f"{path}/spec")
    if isinstance(encode, TfidfSpace):
        encode.save(spark, f"{path}/space")


def load(spark: SparkSession, path: str) -> Encoder:
    spec = spark.read.parquet(f"{path}/spec").first().spec.partition("+")[0].strip().lower()
    return TfidfSpace.load(spark, f"{path}/space") if ALIASES.get(spec, spec) == "tfidf" else encoder(spec)


def encoder(spec: str = "tfidf", labels: DataFrame | None = None, label: str = "label", **options) -> Encoder:
    """An encoder by its name; with +head it is refitted to labels. Unknown names raise ValueError."""
    name, _, head = spec.strip().lower().partition("+")
    name = ALIASES.get(name, name)
    if name not in BASES or head not in ("", "head"):
        raise ValueError(f"unknown encoder {spec!r}; known: {', '.join(sorted(BASES))}, each also with +head")
    if head and labels is None:
        raise ValueError(f"{spec!r} needs labels")
    plain = BASES[name](options)

    def encode(df: DataFrame, key: str, text: str) -> DataFrame:
        rows = plain(df, key, text)
        return apply_head(rows, contrast_head(rows, labels, key, label)) if head else rows

    return encode


def cached(encode: Encoder, spec: str, cache: DataFrame) -> Encoder:
    """Only texts that a cache (cache_key, features) lacks are encoded, each once. It suits
    encoders whose vector depends on the text alone."""

    def run(df: DataFrame, key: str, text: str) -> DataFrame:
        keyed = df.select(key, F.col(text).alias("_t"), text_cache_key(spec, F.col(text)).alias("cache_key"))
        new = encode(keep_missing(keyed, cache, "cache_key").select("cache_key", "_t").distinct(), "cache_key", "_t")
        return keyed.join(cache.select("cache_key", "features").unionByName(new.select("cache_key", "features")), "cache_key").select(key, "features")

    return run
