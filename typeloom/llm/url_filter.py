"""URL filters: exact membership in a list by a cascade of Bloom filters, without joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Bits of a filter that is collected in one piece, at most (16 bytes for every 64 bits).
AT_ONCE = 1 << 25
#: The rules of the url query, (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key (host or parent domain, then a path prefix of a listed length) a url could
    match, longest first; a prefix length beyond the path gives no key."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    pairs = F.flatten(F.transform(hosts, lambda h: F.array(*[F.when(F.length(path) >= n, F.concat(h, F.substring(path, 1, n))) for n in lengths])))
    keys = F.array_distinct(F.filter(pairs, lambda k: k.isNotNull()))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])


class Level:
    """One Bloom filter: `bits` as 64-bit words, k probes of a hash seeded by the level."""

    def __init__(self, seed: int, size: int, probes: int, words: np.ndarray):
        self.seed, self.size, self.probes, self.words = seed, size, probes, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        one, two = h.astype(np.uint64), (h.astype(np.uint64) >> np.uint64(17)) | np.uint64(1)
        out = np.ones(len(h), bool)
        for i in range(self.probes):
            at = (one + np.uint64(i) * two) % np.uint64(self.size)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def level_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def build_level(keys: DataFrame, seed: int, bits_per_key: int, most_bits: int = 1 << 62) -> Level | None:
    """A filter of the `key` column, built on the executors: positions become words of 64 bits
    that are OR-ed per word, so only the filter itself (bits_per_key bits a key, `most_bits` at most) is
    collected. None if there are no keys."""
    n = keys.count()
    if not n:
        return None
    size, probes = max(64, min(most_bits, n * bits_per_key)), max(1, round(bits_per_key * math.log(2)))

    @F.pandas_udf("array<long>")
    def positions(h: pd.Series) -> pd.Series:
        one = h.to_numpy(np.int64).astype(np.uint64)
        two = (one >> np.uint64(17)) | np.uint64(1)
        return pd.Series([*np.stack([(one + np.uint64(i) * two) % np.uint64(size) for i in range(probes)], 1).astype(np.int64)])

    at = keys.select(F.explode(positions(level_hash(F.col("key"), seed))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))).alias("bits"))
    table = np.zeros(size // 64 + 1, np.uint64)
    if size <= AT_ONCE:  # one job; an iterator starts one for each partition
        got = words.toArrow()
        table[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    else:
        for w, b in words.toLocalIterator():
            table[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return Level(seed, size, probes, table)


def passes(level: Level):
    """A function of a column of hashes: whether the level holds them."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(level.holds(h.to_numpy(np.int64)))

    return test


def member(levels: list[Level], hashes: list[np.ndarray]) -> np.ndarray:
    """Whether each key of the universe is listed: the first level that lacks it decides, and
    odd levels hold listed keys, even ones the false positives of the level before."""
    out, open_ = np.zeros(len(hashes[0]) if hashes else 0, bool), np.ones(len(hashes[0]) if hashes else 0, bool)
    for i, (level, h) in enumerate(zip(levels, hashes)):
        inside = level.holds(h)
        out[open_ & ~inside] = i % 2 == 1
        open_ &= inside
    out[open_] = len(levels) % 2 == 1
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = 12, seed: int = 1) -> list[Level]:
    """Levels that decide exactly, for every `key` of `universe`, whether `listed` has it.

    Level 1 encodes the listed keys; level 2 the keys of the universe that pass it unlisted;
    level 3 the listed keys that pass level 2; and so on until nothing passes wrongly. Only keys
    that pass a filter are made distinct, a small share of the universe.
    """
    levels: list[Level] = []
    wrong = listed.select("key").distinct()
    other = universe.select("key")
    while (level := build_level(wrong, seed + len(levels), bits_per_key)) is not None:
        levels.append(level)

        passed = other.filter(passes(level)(level_hash(F.col("key"), level.seed))).distinct()
        if len(levels) == 1:  # the list is no larger than a filter, so Spark's planner may broadcast it here
            passed = passed.join(listed.select("key"), "key", "left_anti")
        wrong, other = materialize(passed, "passed"), wrong
    return levels


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, bits_per_key: int = 12, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every url: key, host, path, rule (the longest that fits, like net/; null if none),
    verdict (the rule's; allow where no rule fits, for then its keys are not listed).

    The key universe is every (parent domain, path prefix of a listed length) of the corpus.
    One cascade lists the keys that rules block, one those that rules allow. They are exact for
    this universe, so urls are judged in one map over the scan: no join touches them. The
    filters that tasks receive take bits_per_key bits a listed key or passing false positive.

    Null urls and urls without :// have empty host and path and no rule; an empty table gives
    no rows; repeated rows are judged one by one; other columns are not read.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    with_keys = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths)) if lengths else parts.withColumn("keys", F.array().cast("array<string>"))
    universe = with_keys.select(F.explode("keys").alias("key"))
    cascades = {}
    for verdict in ("allow", "block"):
        mine = [(h + p,) for v, h, p in rules if v == verdict]
        cascades[verdict] = build_cascade(universe, spark.createDataFrame(mine, "key string")) if mine else []
    shared = spark.sparkContext.broadcast(cascades)
    seeds = sorted({level.seed for levels in cascades.values() for level in levels})

    @F.pandas_udf("struct<at:int,verdict:string>")
    def judge(hashes: pd.Series) -> pd.DataFrame:
        rows = hashes.tolist()
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.array([list(x) for r in rows for x in r], np.int64).reshape(-1, max(1, len(seeds)))
        by_seed = {s: flat[:, i] for i, s in enumerate(seeds)}
        hit = {v: member(levels, [by_seed[x.seed] for x in levels]) if levels else np.zeros(len(flat), bool) for v, levels in shared.value.items()}
        at, verdict, start = [], [], 0
        either = hit["allow"] | hit["block"]
        for n in counts:
            found = np.flatnonzero(either[start : start + n])
            at.append(int(found[0]) + 1 if len(found) else 0)
            verdict.append("block" if len(found) and hit["block"][start + found[0]] else "allow")
            start += n
        return pd.DataFrame({"at": pd.Series(at, dtype="int32"), "verdict": pd.Series(verdict, dtype="object")})

    probes = F.transform("keys", lambda k: F.array(*[level_hash(k, s) for s in seeds])) if seeds else F.array().cast("array<array<long>>")
    judged = with_keys.withColumn("j", judge(probes))
    return judged.select(key, "host", "path", F.when(F.col("j.at") > 0, F.expr("keys[j.at - 1]")).alias("rule"), F.col("j.verdict").alias("verdict"))
