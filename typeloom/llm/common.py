"""Helpers shared by the operators of this subpackage.

Nothing here collects data of unbounded size: tables that must outlive a job are
written under the shared checkpoint folder of the session, connected components
are contracted with joins, and hashes are stable across workers and reruns.
"""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Edges that one task joins into components, at most.
FEW = 1 << 18
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one test table, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() would also change other alphabets."""
    return F.translate(c, UPPER_AZ, LOWER_AZ)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own where none is set and all runs on
    one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return known or os.path.join(tempfile.gettempdir(), "checkpoints")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage,
    survives lost executors and is computed once however often it is used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/typeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._typeloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by materialize() that no later step reads. The driver collects its
    garbage then, upon which Spark removes the shuffle files of plans that are gone too."""
    for t in tables:
        path = getattr(t, "_typeloom_path", None)
        if path:
            jvm, jsc = t.sparkSession._jvm, t.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one value."""
    raw = io.BytesIO()
    for a in arrays:
        np.save(raw, a, allow_pickle=False)
    return raw.getvalue()


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    f = io.BytesIO(raw)
    return [np.load(f, allow_pickle=False) for _ in range(n)]


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them all."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(h: np.ndarray) -> np.ndarray:
    """Ascending 64-bit numbers as their differences, in as many bytes each as the largest takes:
    a table of bytes."""
    d = np.diff(h, prepend=np.uint64(0))
    first, d[:1] = d[:1].copy(), 0
    width = max(1, -(-int(d.max(initial=0)).bit_length() // 8))
    return np.concatenate([first.view(np.uint8), d.view(np.uint8).reshape(-1, 8)[:, :width].ravel()])


def unsteps(raw: np.ndarray, n: int) -> np.ndarray:
    """The n numbers that steps() wrote."""
    if not n:
        return np.zeros(0, np.uint64)
    d = np.zeros((n, 8), np.uint8)
    d[:, : (len(raw) - 8) // n] = raw[8:].reshape(n, -1)
    d = d.view(np.uint64).ravel()
    d[0] = raw[:8].view(np.uint64)[0]
    return np.cumsum(d, dtype=np.uint64)


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash as int, memoised; emptied when it holds `most` words,
    which costs time only."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def release() -> None:
    """Give freed memory back to the system: Python workers live on and serve other stages, and
    several of them share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Columns of Arrow batches as Python lists, in slices of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
    release()


def pieces(batch: pa.RecordBatch, rows: int = 8) -> Iterator[pa.RecordBatch]:
    """A batch of large values, a few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def forest(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """(node, to) for the nodes of all edges (a, b) of a task: the smallest node they reach."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := to.setdefault(x, x)) != x:
            to[x] = x = to[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            to[max(a, b)] = min(a, b)
    nodes = [*to]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"node": part, "to": [root(x) for x in part]}, pa.schema([("node", pa.int64()), ("to", pa.int64())]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) for every node that an
    edge names, where component is the smallest node that can be reached.

    More than FEW edges are contracted by rounds of joins; up to FEW that are left are joined up
    in one task, which spares small tables dozens of jobs.

    Each round every node moves to the neighbour (or itself) with the smallest hash of that
    round, and on to where that one moved; edges are renamed, loops and repeats go. Renaming
    keeps what is connected connected, and random orders shrink even long paths by a factor
    per round, so there are about log(longest path) rounds. Hubs do no harm: minima are
    combined before the shuffle, and the joins are plain sort-merge joins, which AQE splits.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while (n := left.count()) > FEW:
        seed = F.lit(len(maps) + 1)
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        best = both.groupBy("node").agg(F.min(F.struct(F.xxhash64(seed, "near").alias("h"), F.col("near").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64(seed, "node").alias("h"), F.col("node").alias("id"))
        step = materialize(best.select("node", F.least(own, F.col("m"))["id"].alias("to")), "step")
        on = step.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        jump = materialize(step.join(on, "to", "left").select("node", F.coalesce("onward", "to").alias("to")), "jump")
        renamed = left.join(jump.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(jump.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        rest = materialize(renamed.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct(), "edges")
        discard(left, step)
        maps.append(jump)
        left = rest
    if not maps:
        found = left.coalesce(1).mapInArrow(forest, "node long, to long") if n else left.toDF("node", "to")
        found = materialize(found.withColumnRenamed("to", "component"), "components")
        discard(left)
        return found
    if n:
        maps.append(materialize(left.coalesce(1).mapInArrow(forest, "node long, to long"), "jump"))
    found = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        found = found.join(m.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = materialize(found, "roots")
    discard(left, *maps)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(found.join(least, "root").select("node", "component"), "components")
