"""Feature spaces: TF-IDF in long form, SVD, blocks, physics and centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import NEW_NAME, name_tokens
from ..functions.units import let, log_size
from ..sources.tables import stored

WORDS = r"[\p{L}\p{N}_]{2,}"
#: Of a batch of documents, so many words are spelled out at a time, and the terms of so many
#: documents and words are counted at once. Steps of a trie that are kept in one array at most.
SPELLED, COUNTED, SLICE, DENSE = 4_000_000, 32, 65_536, 1 << 25


def word_terms(text: Column, pairs: bool = True) -> Column:
    """Words of two characters or more, lower case, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))
    if not pairs:
        return words
    return let(words, lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))))


def char_words(text: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def char_runs(word: Column, least: int = 3, most: int = 5) -> Column:
    """Runs of characters of a word padded with a space on both sides; a word shorter than a run
    stands for itself, once."""
    w = F.concat(F.lit(" "), word, F.lit(" "))

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))

    longer = [F.when(F.length(w) >= n, of_length(n)).otherwise(F.array().cast("array<string>")) for n in range(least + 1, most + 1)]
    return F.flatten(F.array(of_length(least), *longer))


def exploded_runs(words: DataFrame, word: str, least: int = 3, most: int = 5) -> DataFrame:
    """The other columns of words beside each of its char_runs, a row for each, as `term`. It says
    the same by two plain explosions, which Spark compiles."""
    at = words.withColumn("_w", F.concat(F.lit(" "), word, F.lit(" "))).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_w") - least + 1, F.lit(1)))))
    longer = [F.when(F.length("_w") - F.col("_i") + 1 >= n, F.substring("_w", F.col("_i"), F.lit(n))) for n in range(least + 1, most + 1)]
    runs = F.explode(F.array(F.substring("_w", F.col("_i"), F.lit(least)), *longer))
    return at.select(*[c for c in words.columns if c != word], runs.alias("term")).filter("term IS NOT NULL")


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """The char_runs of all words of a text."""
    return F.flatten(F.transform(char_words(text), lambda w: char_runs(w, least, most)))


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf). Documents are dealt by key once, before their terms are spelled out, so
    that what is counted or summed by key later needs no further shuffle."""
    return docs.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary_of(tf: DataFrame, n: int, size: int) -> DataFrame:
    """The `size` terms with the highest counts in a corpus of n documents, with smoothed idf + 1."""
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(size)
    return stats.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(tf: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, weight) of the terms that a vocabulary holds: (1 + ln tf) * idf, rows of length
    1. Only the vocabulary, bounded by its size, is broadcast."""
    w = tf.join(F.broadcast(idf), "term").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    return w.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


def tfidf(docs: DataFrame, key: str, terms: Column, vocabulary: int) -> DataFrame:
    """Long TF-IDF (key, term, weight) over the `vocabulary` commonest terms of the corpus."""
    n = docs.count()
    tf = term_counts(docs, key, terms)
    return weighted(tf, key, vocabulary_of(tf, n, vocabulary))


class RunTable:
    """Numbers of terms that are runs of characters, found for many words at once: a trie whose
    steps (node, character) are looked up in one array, or by bisection if that would be large."""

    def __init__(self, terms: list[str]):
        self.terms, nodes = terms, {"": 0}
        chars = sorted({c for t in terms for c in t})
        for t in terms:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        number, self.chars = {c: i for i, c in enumerate(chars)}, np.array([ord(c) for c in chars], np.int64)
        self.width, self.dead = len(chars) + 1, len(nodes)  # the last character stands for all others
        self.term = np.full(len(nodes) + 1, -1, np.int32)
        self.term[[nodes[t] for t in terms]] = np.arange(len(terms))
        steps = sorted((nodes[t[:-1]] * self.width + number[t[-1]], n) for t, n in nodes.items() if t)
        self.keys, self.next = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))

    def stepped(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function from nodes and characters to the nodes below."""
        if (self.dead + 1) * self.width <= DENSE:
            below = np.full((self.dead + 1) * self.width, self.dead, np.int32)
            below[self.keys] = self.next
            return lambda node, char: below[node * self.width + char]
        keys, nodes = np.append(self.keys, np.iinfo(np.int64).max), np.append(self.next, self.dead)

        def bisect(node, char):
            key = node.astype(np.int64) * self.width + char
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, nodes[at], self.dead)

        return bisect

    def spelled(self, words: pa.StringArray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the char_runs of words, word after word, and how many each word has;
        runs that are no terms are left out."""
        step, found, many = self.stepped(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        number = np.full(0x110000, self.width - 1, np.int32)
        number[self.chars] = np.arange(self.width - 1)
        for lo in range(0, len(words), SLICE):
            some = words.slice(lo, SLICE)
            text = number[np.frombuffer("".join([f" {w} " for w in some.to_pylist()]).encode("utf-32-le"), np.uint32)]
            size = pc.utf8_length(some).to_numpy().astype(np.int64) + 2
            begin = np.cumsum(size) - size
            left = np.repeat(begin + size, size) - np.arange(len(text))  # characters up to the word's end
            node, hits = np.zeros(len(text), np.int32), np.full((len(text), most - least + 1), -1, np.int32)
            text = np.concatenate([text, np.full(most, self.width - 1, np.int32)])
            for n in range(1, most + 1):
                node = step(node, text[n - 1 : n - 1 + len(node)])
                if n >= least:
                    hits[:, n - least] = np.where(left >= n, self.term[node], hits[:, n - least])
                else:
                    whole = begin[size == n]  # shorter than a run
                    hits[whole, 0] = self.term[node[whole]]
            known = hits >= 0
            found.append(hits[known])
            many.append(np.add.reduceat(known.sum(1), begin))
        return np.concatenate(found), np.concatenate(many)


def run_counts(texts: pa.StringArray, table: RunTable, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of lower-cased texts, some at a time: the first one's place, and a matrix (row, number) of
    how often each has each term. A word is spelled out once for many rows that hold it."""
    lists = pc.ascii_split_whitespace(texts)  # may give empty words, whose only run is no term
    lens, size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), max(1, len(table.terms))
    ends, first = np.cumsum(lens), 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - lens[first] + SPELLED, "right")))
        coded = lists.slice(first, last - first).flatten().dictionary_encode()
        codes, (found, many) = coded.indices.to_numpy(), table.spelled(coded.dictionary, least, most)
        begins, place = np.cumsum(many) - many, np.concatenate([[0], np.cumsum(lens[first:last])])
        for lo in range(0, last - first, COUNTED):
            hi = min(lo + COUNTED, last - first)
            owner, total = np.repeat(np.arange(hi - lo) * size, lens[first + lo : first + hi]), None
            for x in range(place[lo], place[hi], SLICE):
                c = codes[x : min(x + SLICE, place[hi])]
                n = many[c]
                runs = found[np.repeat(begins[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                more = np.bincount(np.repeat(owner[x - place[lo] : x - place[lo] + len(c)], n) + runs, minlength=(hi - lo) * size)
                total = more if total is None else total + more
            yield first + lo, np.zeros((hi - lo, size), np.int64) if total is None else total.reshape(-1, size)
        first = last
        del coded, codes, found
        pa.default_memory_pool().release_unused()


def char_tfidf(docs: DataFrame, key: str, text: Column, vocabulary: int, digits: int | None = None, least: int = 3, most: int = 5) -> DataFrame:
    """What tfidf gives for char_terms, weights rounded to `digits` if given. Runs never cross
    words, so totals follow from the counts of different words, and there is no table of the runs
    of all documents: each is counted in its row against the vocabulary, which alone (bounded by
    its size) reaches the driver; once for df, once for weights. Documents are dealt by key and
    lower-cased once; texts of a repeated key are joined, as they count as one document."""
    lower, repeated = F.lower(text).alias("text"), docs.groupBy(key).count().filter("count > 1")
    alone = docs.repartition(key).select(key, lower)
    texts = stored(alone if repeated.isEmpty() else docs.groupBy(key).agg(F.concat_ws(" ", F.collect_list(lower)).alias("text")))

    def counted(batches):
        for batch in batches:
            found = pc.ascii_split_whitespace(batch.column(0)).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["w", "n"])

    counts = texts.select("text").mapInArrow(counted, "w string, n long").filter("w != ''").groupBy("w").agg(F.sum("n").alias("n"))
    totals = exploded_runs(counts, "w", least, most).groupBy("term").agg(F.sum("n").alias("total"))
    terms = [r.term for r in totals.orderBy(F.desc("total"), "term").limit(vocabulary).collect()]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(RunTable(terms))

    def holders(batches):
        df = np.zeros(max(1, len(shared.value.terms)), np.int64)
        for batch in batches:
            for _, total in run_counts(batch.column(0), shared.value, least, most):
                df += np.count_nonzero(total, axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "df"])

    held = texts.select("text").mapInArrow(holders, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max(1, len(terms)))
    df[[r["at"] for r in held]] = [r["df"] for r in held]
    idf = sc.broadcast(np.log((1.0 + docs.count()) / (1.0 + df)) + 1.0)
    schema = T.StructType([docs.schema[key], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))])

    def weigh(batches):
        for batch in batches:
            for first, total in run_counts(batch.column(1), shared.value, least, most):
                size, flat = total.shape[1], total.ravel()
                place = np.flatnonzero(flat > 0)
                ends = np.searchsorted(place, np.arange(len(total) + 1) * size)
                row = np.repeat(np.arange(len(total)), np.diff(ends))
                at = place - row * size
                w = (1.0 + np.log(flat[place])) * idf.value[at]
                w /= np.sqrt(np.bincount(row, w * w, len(total)))[row]
                w = w if digits is None else np.floor(w * 10.0**digits + 0.5) / 10.0**digits
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (at.astype(np.int32), w)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(total)), *lists], schema.names)

    rows = texts.mapInArrow(weigh, schema).select(key, "w", F.posexplode("at").alias("i", "at")).select(key, "at", F.expr("w[i]").alias("weight"))
    named = docs.sparkSession.createDataFrame(pa.table({"at": pa.array(range(len(terms)), pa.int32()), "term": pa.array(terms, pa.string())}))
    return rows.join(F.broadcast(named), "at").select(key, "term", "weight")


def numbered_terms(weights: DataFrame) -> DataFrame:
    """A vocabulary with positions; it is bounded, so one window over it is cheap."""
    return weights.select("term").distinct().withColumn("at", F.row_number().over(Window.orderBy("term")) - 1)


def sparse_rows(weights: DataFrame, key: str, terms: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows (key, features) of a long table, as sparse vectors; `terms` (term, at) if they have
    numbers already. The long table is written first, as its terms are spelled out but once then."""
    weights = stored(weights)
    terms = numbered_terms(weights) if terms is None else terms
    size = terms.count()

    @F.udf(VectorUDT())
    def pack(at, weight):
        return SparseVector(size, at, weight)

    rows = weights.join(F.broadcast(terms), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"))
    return stored(rows.select(key, pack("p.at", "p.weight").alias("features"))), size


def svd_basis(rows: DataFrame, dim: int = 200, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of sparse rows, found by randomised subspace iteration:
    each round is one pass that sums X'X Q over partitions, so only size x dim numbers reach the
    driver. Equal rows are merged first and weigh by their number. Without rows, one column of zeros."""
    some = rows.take(1)
    if not some:
        return np.zeros((1, 1))
    size, n = some[0]["features"].size, rows.count()
    k = max(1, min(max(2, min(dim, min(n, size) - 1)), size))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, k + 10))))
    sc = rows.sparkSession.sparkContext
    data = rows.groupBy("features").agg(F.count("*").alias("n")).persist()
    for _ in range(4):
        shared = sc.broadcast(q)

        def step(batch, shared=shared):
            total = np.zeros_like(shared.value)
            for r in batch:
                v = r["features"]
                total[v.indices] += np.outer(r["n"] * v.values, v.values @ shared.value[v.indices])
            yield total

        q, _ = np.linalg.qr(data.rdd.mapPartitions(step).treeReduce(np.add))
        shared.unpersist()
    data.unpersist()
    return q[:, :k]


def projected(rows: DataFrame, key: str, basis: np.ndarray) -> DataFrame:
    """(key, features array) of sparse rows projected on a basis, then scaled to length 1."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    @F.udf("array<double>")
    def project(v):
        x = v.values @ shared.value[v.indices]
        n = float(np.linalg.norm(x))
        return (x / n if n else x).tolist()

    return rows.select(key, project("features").alias("features"))


def svd(rows: DataFrame, key: str, dim: int = 200, seed: int = 0) -> DataFrame:
    """(key, features array) of sparse rows projected on their leading right singular vectors."""
    return projected(rows, key, svd_basis(rows, dim, seed))


def standard_physics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sizes as log10, missing ones at the median, standardised by the population's deviation (1
    where that is 0), rows of length 1: an array column `physics`."""
    logs = df.withColumns({f"_{c}": log_size(F.col(c)) for c in columns})
    medians = logs.agg(*[F.coalesce(F.median(f"_{c}"), F.lit(0.0)).alias(c) for c in columns]).first()
    filled = logs.withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(float(medians[c]))) for c in columns})
    stats = filled.agg(*[F.avg(f"_{c}").alias(f"m_{c}") for c in columns], *[F.stddev_pop(f"_{c}").alias(f"s_{c}") for c in columns]).first()
    z = F.array(*[(F.col(f"_{c}") - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns])
    return filled.withColumn("physics", unit_length(z)).drop(*[f"_{c}" for c in columns])


def unit_length(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def blocks(*weighted: tuple[Column, float]) -> Column:
    """Blocks of features one after another, each scaled by its weight."""
    def scaled(c: Column, w: float) -> Column:
        return F.transform(c, lambda x: x * F.lit(float(w)))

    return F.concat(*[scaled(c, w) for c, w in weighted])


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each group, of length 1 unless it is zero. Components are averaged
    before the shuffle."""
    at = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    return rows.withColumn("centroid", unit_length(F.col("centroid")))


def term_scores(docs: DataFrame, group: str, text: str) -> DataFrame:
    """Class-based TF-IDF: (group, term, score), a term's share in a group times
    ln(1 + groups / groups with the term)."""
    groups = docs.select(group).distinct().count()
    n = docs.select(group, F.explode(name_tokens(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    df = F.count("*").over(Window.partitionBy("term"))
    return n.select(group, "term", (F.col("n") / total * F.log1p(F.lit(float(groups)) / df)).alias("score"))


def group_names(docs: DataFrame, group: str, text: str, words: int = 2) -> DataFrame:
    """A proposed name for each group: its best terms, skipping those that share the first four
    characters with one taken. Each word is one pass over all terms of a group."""
    rest, named = term_scores(docs, group, text), docs.select(group).distinct().withColumn("n", F.array().cast("array<string>"))
    for _ in range(words):
        best = rest.groupBy(group).agg(F.min_by("term", F.struct(-F.col("score"), "term")).alias("w"))
        named = named.join(best, group, "left").select(group, F.when(F.col("w").isNull(), F.col("n")).otherwise(F.concat("n", F.array("w"))).alias("n"))
        clash = F.startswith("term", F.substring("w", 1, 4)) | F.startswith("w", F.substring("term", 1, 4))
        rest = rest.join(best, group).filter(~clash).drop("w")
    return named.select(group, F.concat(F.lit(NEW_NAME), F.coalesce(F.nullif(F.upper(F.array_join("n", " ")), F.lit("")), F.lit("UNRECOGNISED"))).alias("name"))


def text_cache_key(spec: str, text: Column) -> Column:
    """The key of a text in an embedding cache: one entry a text and encoder."""
    return F.sha2(F.concat(F.lit(spec), F.lit("\u0001"), text).cast("binary"), 256)
