"""Mixing sources to target weights, by blocks and pseudorandom permutations."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, release

#: Words in a block at most; a source is cut into 1024 blocks at least, as far as it has words.
BLOCK = 512
#: Lanes of a source, at least: each lane lays its documents end to end on its own. There are as
#: many more as keep a lane to so many documents or about.
LANES, LANE_ROWS = 1024, 50_000
WEIGHTS = (5, 2, 1)
CAP = 3


def share_out(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets by weight that sum to all sizes; one that would exceed cap times its size stops
    there, and the excess is shared by weight among the others until none is above."""
    total, fixed = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(o for o, f in zip(out, fixed) if f)
        weight = sum(w for w, f in zip(weights, fixed) if not f)
        for i, w in enumerate(weights):
            if not fixed[i]:
                out[i] = rest * w / weight
        above = [i for i, o in enumerate(out) if not fixed[i] and o > cap * sizes[i]]
        if not above:
            return out
        for i in above:
            fixed[i], out[i] = True, float(cap * sizes[i])


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, at x: four Feistel rounds on the least
    even number of bits that holds n, walked on until the value is below n."""
    half = np.array([max(1, (int(v - 1).bit_length() + 1) // 2) for v in n], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    y, n, key = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    odd = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo = np.ones(len(y), bool)
    while todo.any():
        left, right = y[todo] >> half[todo], y[todo] & mask[todo]
        for r in range(4):
            h = (right ^ key[todo]) + odd[r]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask[todo])
        y[todo] = (left << half[todo]) | right
        todo[todo] = y[todo] >= n[todo]
    return y.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a row number that tells repeated rows apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row"))


class Plan:
    """What a mix takes: `docs` (row, doc_id, source, size, source_size, target, and the place of
    its first word in its lane) and `taken` (row, start, length, copy, shard): spans of words."""

    def __init__(self, docs: DataFrame, taken: DataFrame):
        self.docs, self.taken = docs, taken


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, lanes: int = LANES, shard_slots: int = 4096, seed: int = 0) -> Plan:
    """Decide which spans of words a mix takes.

    Sources by code point, null last, weigh `weights` in turn. The words of a source are packed
    end to end, lane after lane, into blocks of a fixed length. Output shards of `shard_slots`
    slots draw multinomial source counts; draws beyond a source's exact number of slots go, in
    order, to sources that lack some, so that totals are met. The j-th slot of a source maps
    through pass j div n of its permutation of 0..n-1 to a block, and blocks are joined by index.
    A source's last slot takes only as many words as its target still lacks.

    Collected on the driver: one row for each distinct source (name, size), so sources must be
    datasets rather than, say, hosts. Everything about
    documents, lanes, shards and slots stays in DataFrames; no key gathers a source's rows, for
    lanes split every source.
    """
    spark = docs.sparkSession
    base = materialize(sized(docs), "sized")
    sizes = base.groupBy("source").agg(F.sum("size").cast("long").alias("n"), F.count("*").alias("rows")).collect()
    lanes = max([lanes, *(r.rows // LANE_ROWS for r in sizes)])
    base = base.withColumn("lane", F.pmod(F.xxhash64("doc_id", "row"), F.lit(lanes)).cast("int"))
    order = sorted(sizes, key=lambda r: (r.source is None, r.source or ""))
    names, totals = [r.source for r in order], [r.n for r in order]
    targets = share_out(totals, [weights[i % len(weights)] for i in range(len(totals))], cap) if sum(totals) else [0.0] * len(totals)
    plan = pd.DataFrame({"sid": range(len(names)), "source": pd.Series(names, dtype=object), "source_size": totals, "target": targets})
    plan["unit"] = [max(1, min(block, t // 1024)) for t in totals]
    plan["blocks"] = [-(-t // u) for t, u in zip(totals, plan["unit"])]
    words = [min(int(round(t)), int(cap * n)) for t, n in zip(targets, totals)]
    plan["slots"] = [min(-(-w // u), int(cap * b)) for w, u, b in zip(words, plan["unit"], plan["blocks"])]
    plan["last"] = [max(0, w - (s - 1) * u) for w, u, s in zip(words, plan["unit"], plan["slots"])]
    kinds = "sid int, source string, source_size long, target double, unit long, blocks long, slots long, last long"
    sources = spark.createDataFrame([tuple(None if v is None else v for v in r) for r in plan.astype(object).itertuples(index=False)], kinds)

    # Places: where each document's words lie in its source.
    lane_size = base.groupBy("source", "lane").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane_at = lane_size.select(F.col("source").alias("ls"), F.col("lane").alias("ll"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_start"))
    in_lane = Window.partitionBy("source", "lane").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("at", F.coalesce(F.sum("size").over(in_lane), F.lit(0)))
    placed = placed.join(lane_at, placed["source"].eqNullSafe(lane_at["ls"]) & (placed["lane"] == lane_at["ll"])).withColumn("at", F.col("at") + F.col("lane_start")).drop("ls", "ll", "lane_start", "lane")
    known = sources.withColumnRenamed("source", "s")
    placed = materialize(placed.join(known, placed["source"].eqNullSafe(known["s"])).drop("s", "slots", "last", "blocks"), "placed")

    # Slots: multinomial counts of each shard, then the ordinal of each slot in its source.
    all_slots = int(plan["slots"].sum()) if len(plan) else 0
    p = plan["slots"].to_numpy(float) / max(1, all_slots)
    shards = -(-all_slots // shard_slots)
    want = plan["slots"].to_numpy(np.int64)

    def draw(batches):
        for b in batches:
            for shard in b["id"]:
                n = min(shard_slots, all_slots - int(shard) * shard_slots)
                got = np.random.default_rng([seed, int(shard)]).multinomial(n, p)
                yield pd.DataFrame({"shard": int(shard), "sid": np.arange(len(p), dtype=np.int32), "n": got})

    drawn = materialize(spark.range(0, shards, 1, max(1, min(shards, 200))).mapInPandas(draw, "shard long, sid int, n long"), "drawn")
    got = {r.sid: r.n for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, got.get(i, 0) - int(w)) for i, w in enumerate(want)]
    lack = [max(0, int(w) - got.get(i, 0)) for i, w in enumerate(want)]
    start_of = np.concatenate([[0], np.cumsum(over)]).astype(np.int64)
    lack_end = np.cumsum(lack).astype(np.int64)
    unit, blocks, last = plan["unit"].to_numpy(np.int64), plan["blocks"].to_numpy(np.int64), plan["last"].to_numpy(np.int64)
    key_of = [np.random.SeedSequence([seed, i]).generate_state(1, np.uint64)[0] for i in range(len(plan))]

    keys, lacking = np.array(key_of, np.uint64), np.array(lack, np.int64)
    had = np.array([got.get(i, 0) for i in range(len(want))], np.int64)

    def fill(batches):
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                n, sid = part["n"].to_numpy(np.int64), part["sid"].to_numpy(np.int64)
                s, shard = np.repeat(sid, n), np.repeat(part["shard"].to_numpy(np.int64), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(part["first"].to_numpy(np.int64), n)
                extra = j >= want[s]
                if extra.any():  # the k-th draw too many of all sources becomes the k-th one lacking
                    k = start_of[s[extra]] + j[extra] - want[s[extra]]
                    to = np.searchsorted(lack_end, k, side="right")
                    s[extra], j[extra] = to, k - (lack_end[to] - lacking[to]) + had[to]
                if len(j):
                    passes = j // blocks[s]
                    block_at = permute(j % blocks[s], blocks[s], keys[s] + passes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                    yield pd.DataFrame({"sid": s.astype(np.int32), "block": block_at, "copy": passes, "shard": shard, "take": np.where(j == want[s] - 1, last[s], unit[s])})

    run = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = drawn.withColumn("first", F.coalesce(F.sum("n").over(run), F.lit(0)))
    slots = first.mapInPandas(fill, "sid int, block long, copy long, shard long, take long")

    # Blocks: the parts of documents that lie in each; then both sides meet by (source, block).
    end = F.col("at") + F.col("size")
    inside = placed.filter("size > 0").select("row", "sid", "at", "size", "unit", F.explode(F.sequence(F.floor(F.col("at") / F.col("unit")), F.floor((end - 1) / F.col("unit")))).alias("block"))
    # Both sides grow with the corpus, so neither is ever broadcast.
    met = inside.hint("merge").join(slots, ["sid", "block"])
    lo = F.greatest("at", F.col("block") * F.col("unit"))
    hi = F.least(end, F.col("block") * F.col("unit") + F.least("take", "unit"))
    taken = met.select("row", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"), "copy", "shard").filter("length > 0")
    return Plan(placed, taken)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """What a mix takes of every document: doc_id, size, source_size, target, taken.

    Options as in mix_plan. Reruns over the same table agree. Null texts have size 0 and are
    never taken; null is a source of its own, after all others; repeated rows each count as a
    document; an empty table gives no rows; other columns are not read.
    """
    plan = mix_plan(docs, **options)
    taken = plan.taken.groupBy("row").agg(F.sum("length").alias("taken"))
    return plan.docs.hint("merge").join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of docs: for each document that the mix takes
    words of, one row whose text is those words with the white space between them, copy after
    copy; n_chars (if there) is counted anew. Documents that no slot drew do not appear."""
    names = docs.columns
    base = materialize(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("mix_row")), "mix")
    id_, text_, source_ = (f"c{names.index(c)}" for c in ("doc_id", "text", "source"))
    plan = mix_plan(base.select(F.struct(id_, "mix_row").alias("doc_id"), F.col(text_).alias("text"), F.col(source_).alias("source")), **options)
    spans = plan.taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("copy", "start", "length"))).alias("mix_spans"))
    spans = plan.docs.hint("merge").join(spans, "row").select(F.col("doc_id.mix_row").alias("mix_row"), "mix_spans")
    met = base.hint("merge").join(spans, "mix_row")

    fields = [f"c{i}" for i in range(len(names))]
    at = fields.index(text_)

    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                new = [take_spans(t, [(s["start"], s["length"]) for s in ss]) for t, ss in zip(part.column(at).to_pylist(), part.column(len(fields)).to_pylist())]
                columns = [pa.array(new, part.schema.field(at).type) if i == at else part.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)
            release()  # a batch holds thousands of texts, and workers stay beside the executor's heap

    new = met.select(*fields, "mix_spans").mapInArrow(cut, met.select(*fields).schema)
    out = [F.length(text_).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return new.select(*out)


def take_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of each span (first word, number of words) with the white space after them."""
    starts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    out = ""
    for at, n in spans:
        if out and not out[-1].isspace():
            out += "\n"
        out += text[0 if at == 0 else starts[at] : starts[at + n]]
    return out
