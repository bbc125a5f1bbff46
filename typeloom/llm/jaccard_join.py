"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, discard, materialize, narrow, packed, pieces, release, rows_of, steps, unpacked, unsteps, words_of
from .url_filter import build_level, level_hash, passes

#: Words of a shingle, and the similarity in per cent.
WORDS, PERCENT = 5, 75
#: Sets of up to this size may be enumerated; the boundary among them is chosen by cost.
SMALL = 12
#: Cost of checking what an inverted list brings together, in rows of an enumeration.
CHECK = 4
#: Shingles and sets of a block of texts, bytes of text that a range of hashes stands for, and the
#: bits of a shingle's hash; above them a key has the shingle's frequency class.
BLOCK, MANY, RANGE_BYTES, HASH_BITS = 1_500_000, 65_535, 6_500_000, 56
#: Bits of a pre-filter of sets, at most.
FILTER_BITS = 1 << 27
#: Entries from which a list is long, keys that travel with the sets of long lists, and longs of a
#: set's signature.
LONG, FRONT, SIGNATURE = 32, 64, 16
#: Rounds with chance neighbours before all remaining pairs are met, neighbours of an entry, and
#: entries of a part of a list.
TURNS, NEAR, PART = 2, 4, 4096
#: Rows that are told to tasks rather than joined, at most.
TOLD = 4_000_000
#: What blocks send to ranges, and ranges to blocks.
TO_RANGES = [("to", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("idx", pa.binary()), ("counts", pa.binary()), ("info", pa.binary())]
TO_BLOCKS = [("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("idx", pa.binary()), ("ranks", pa.binary()), ("info", pa.binary())]


def need(s, t, percent: int = PERCENT):
    """The least intersection that links sets of s and t elements (also on Columns)."""
    if isinstance(s, Column) or isinstance(t, Column):
        return F.ceil((s + t) * percent / (100 + percent) - 1e-9).cast("long")
    return -(-percent * (s + t) // (100 + percent))


def prefix(s: int, percent: int = PERCENT) -> int:
    """Of its elements in any fixed order, the first so many of a set share one with those of
    every set that it is linked to."""
    return s - -(-percent * s // 100) + 1


def fits(s, t, percent: int = PERCENT):
    """Sizes that can be linked at all."""
    return (s * 100 >= t * percent) & (t * 100 >= s * percent)


#: An odd multiplier and its inverse modulo 2**64, and words that are hashed at once.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 100_000
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of BASE and of its inverse; kept, and doubled when more are asked for."""
    while len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            step = np.uint64(pow(base, len(_powers[i]), 1 << 64))
            _powers[i] = np.concatenate([_powers[i], _powers[i] * step])
    return _powers


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles of `words` words; a shorter text
    is one shingle; without words the set is empty. Hashes are differences of one running
    polynomial over the bytes of the words, joined by single spaces."""
    all_words = words_of(text)
    if not all_words:
        return np.zeros(0, np.uint64)
    width, parts = min(words, len(all_words)), []
    for at in range(0, len(all_words) - width + 1, CHUNK):
        raw = np.frombuffer(b" ".join(all_words[at : at + CHUNK + width - 1]), np.uint8)
        gaps = np.flatnonzero(raw == 32)
        start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
        start, end = start[: len(start) - width + 1], end[width - 1 :]
        up, down = powers(len(raw))
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=run[1:])
        h = (run[end] - run[start]) * down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        parts.append(h ^ (h >> np.uint64(29)))
    out = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_name(s: np.ndarray) -> int:
    """Equal sets have equal names: 64 bits of a hash of the whole set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of hashes; sorted hashes lie in sorted ranges."""
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def spelled(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them) for every i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Block:
    """Sets of consecutive texts, up to BLOCK shingles, on their way to the ranges."""

    def __init__(self):
        self.ids, self.at, self.names, self.sets, self.index, self.size = [], [], [], [], {}, 0

    def add(self, doc_id: int | None, s: np.ndarray) -> None:
        name, at = None, -1
        if len(s):
            name = set_name(s)
            at = self.index.get(name, -1)
            if at < 0:
                at = self.index[name] = len(self.sets)
                self.names.append(name)
                self.sets.append(s)
                self.size += len(s)
        self.ids.append(doc_id)
        self.at.append(at)

    @property
    def full(self) -> bool:
        return self.size >= BLOCK or len(self.sets) >= MANY or len(self.ids) >= 4 * MANY

    def rows(self, ranges: int, salt: int) -> pa.RecordBatch:
        """A row for each range that the block has shingles in, and one about the block. Of a
        shingle that several sets of the block have, the range gets one entry and how many there
        are, and the block's own row keeps which: so a shingle has an entry a block at most."""
        sizes = np.array([len(x) for x in self.sets], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        self.sets.clear()
        h >>= np.uint64(64 - HASH_BITS)
        idx = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        order = np.argsort(h, kind="stable")
        h, idx = h[order], idx[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        n = np.diff(np.append(first, len(h)))
        one, several = h[first], n > 1
        who = np.where(several, np.uint16(MANY), idx[first] if len(idx) else idx)
        inside = spelled(first[several], n[several])
        ids = np.array([x or 0 for x in self.ids], np.int64)
        info = packed(ids, np.array([x is None for x in self.ids], bool), narrow(np.array(self.at) + 1), np.array(self.names, np.int64), narrow(sizes), one[several], narrow(n[several]), idx[inside])
        block = xxhash.xxh3_64_intdigest(info, salt) - (1 << 63)
        cut = np.searchsorted(range_of(one, ranges), np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cut))
        out = {"to": [], "n": [], "hashes": [], "idx": [], "counts": []}
        for r in some:
            part = slice(cut[r], cut[r + 1])
            out["to"].append(int(r))
            out["n"].append(int(cut[r + 1] - cut[r]))
            out["hashes"].append(steps(one[part]).tobytes())
            out["idx"].append(who[part].tobytes())
            out["counts"].append(n[part][several[part]].astype(np.uint32).tobytes())
        out["to"].append(int(block % ranges))
        for c, v in (("n", 0), ("hashes", None), ("idx", None), ("counts", None)):
            out[c].append(v)
        out |= {"block": [block] * len(out["to"]), "info": [None] * len(some) + [info]}
        return pa.RecordBatch.from_pydict({c: out[c] for c, _ in TO_RANGES}, pa.schema(TO_RANGES))


def shared_keys(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (set size), set (its name) and `keys` of every text: its shingles that another set
    of the corpus has as well, rarest first. A text has keys where its block meets its set first,
    and only if they are so many of its shingles that a set may be linked to it.

    Blocks of the scan send their shingles, sorted and packed, to ranges of hashes, which count the
    sets of each and send back those that several have; a key is the frequency class of a shingle
    and then its hash, so all sets order their keys alike. What is sent grows with the corpus; a
    row holds at least one shingle, however many ranges there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(4, size // RANGE_BYTES))

    def gather(batches):
        part, turn, block = TaskContext.get().partitionId(), 0, Block()
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for i, text in zip(ids, texts):
                block.add(i, shingle_set(text, words))
                if block.full:
                    yield from pieces(block.rows(ranges, part << 24 | turn))
                    turn, block = turn + 1, Block()
        if block.ids:
            yield from pieces(block.rows(ranges, part << 24 | turn))
        del block
        release()

    def meet(group: pa.Table) -> pa.Table:
        out = ranked(group.to_pylist())
        release()
        return pa.Table.from_pylist(out, pa.schema(TO_BLOCKS))

    def ranked(rows: list[dict]) -> list[dict]:
        told = [r for r in rows if r["info"] is not None]
        rows = [r for r in rows if r["info"] is None]
        out = [{"block": r["block"], "n": 0, "hashes": None, "idx": None, "ranks": None, "info": r["info"]} for r in told]
        if rows:
            h = [unsteps(np.frombuffer(r["hashes"], np.uint8), r["n"]) for r in rows]
            ends = np.cumsum([len(x) for x in h])[:-1]
            h, idx = np.concatenate(h), np.concatenate([np.frombuffer(r["idx"], np.uint16) for r in rows])
            n = np.ones(len(h), np.int64)
            n[idx == MANY] = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            order = np.argsort(h, kind="stable")
            sorted_ = h[order]
            run = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
            total = np.bincount(run, n[order])[run]
            rank = np.zeros(len(h), np.uint8)
            rank[order] = np.where(total > 1, np.minimum(63, 4 * np.log2(total)), 0)
            for r, x, i, k in zip(rows, np.split(h, ends), np.split(idx, ends), np.split(rank, ends)):
                some = k > 0
                if some.any():
                    out.append({"block": r["block"], "n": int(some.sum()), "hashes": steps(x[some]).tobytes(), "idx": i[some].tobytes(), "ranks": k[some].tobytes(), "info": None})
        return out

    def settle(group: pa.Table) -> pa.Table:
        out = keyed(group.to_pylist())
        release()
        return out

    def keyed(rows: list[dict]) -> pa.Table:
        ids, none, at, names, sizes, many, times, inside = unpacked(next(r["info"] for r in rows if r["info"] is not None), 8)
        rows = [r for r in rows if r["info"] is None]
        at, sizes, times = at.astype(np.int64) - 1, sizes.astype(np.int64), times.astype(np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *[unsteps(np.frombuffer(r["hashes"], np.uint8), r["n"]) for r in rows]])
        idx = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(r["idx"], np.uint16) for r in rows]]).astype(np.int64)
        key = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r["ranks"], np.uint8) for r in rows]]).astype(np.uint64) << np.uint64(HASH_BITS) | h
        group_ = idx == MANY
        which = np.searchsorted(many, h[group_])
        own = inside[spelled((np.cumsum(times) - times)[which], times[which])]
        key = np.concatenate([key[~group_], np.repeat(key[group_], times[which])])
        idx = np.concatenate([idx[~group_], own.astype(np.int64)])
        able = np.bincount(idx, minlength=len(sizes))[: len(sizes)] > sizes - prefix(sizes, percent)
        use = able[idx] if len(idx) else np.zeros(0, bool)
        key, idx = key[use], idx[use]
        order = np.lexsort((key, idx))
        parts = np.split(key[order].view(np.int64), np.searchsorted(idx[order], np.arange(1, len(sizes)))) if len(sizes) else []
        lead = np.zeros(len(at), bool)
        lead[np.unique(at, return_index=True)[1]] = True
        keys = [parts[i] if i >= 0 and f and able[i] else None for i, f in zip(at, lead)]
        columns = [pa.array(ids, mask=none), pa.array(np.append(sizes, 0)[at]), pa.array(np.append(names, 0)[at], mask=at < 0), pa.array(keys, pa.list_(pa.int64()))]
        return pa.table(columns, names=["doc_id", "n", "set", "keys"])

    sent = docs.mapInArrow(gather, "to int, block long, n int, hashes binary, idx binary, counts binary, info binary")
    met = sent.groupBy("to").applyInArrow(meet, "block long, n int, hashes binary, idx binary, ranks binary, info binary")
    return met.groupBy("block").applyInArrow(settle, "doc_id long, n long, set long, keys array<long>")


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size up to which sets are enumerated: the cheapest, given how many sets have each
    size. Enumerating costs a row a subset; an inverted list a row and CHECK for each key."""

    def enumerated(s, x):
        return sum(math.comb(s, need(s, t, percent)) for t in range(1, x + 1) if fits(s, t, percent) and need(s, t, percent) <= s)

    def total(x):
        low = sum(n * enumerated(s, x) for s, n in counts.items() if s <= x)
        return low + sum(n * prefix(s, percent) * (1 + CHECK) for s, n in counts.items() if s > x or fits(s, x + 1, percent))

    return min(range(SMALL + 1), key=lambda x: (total(x), x))


def small_edges(sets: DataFrame, x: int, percent: int) -> DataFrame:
    """Edges that join the linked sets (set, n, keys) of at most x elements: for each pair of sizes
    (s, t), a set lists its subsets of need(s, t) elements, of its keys only, as others have no
    other element of it; sets of sizes s and t with a subset in common are linked, without any
    further check, so each joins the smallest of the other size."""

    def enumerate_(batches):
        for b in batches:
            out = []
            for name, n, keys in b.itertuples(index=False):
                for t in range(1, x + 1):
                    c = need(n, t, percent)
                    if fits(n, t, percent) and c <= min(n, t):
                        for sub in combinations(keys, c):
                            out.append((xxhash.xxh3_64_intdigest(np.array(sub, np.int64).tobytes()) - (1 << 63), min(n, t), max(n, t), n <= t, n >= t, name))
            yield pd.DataFrame(out, columns=["sub", "s", "t", "low", "high", "set"])

    rows = sets.select("set", "n", "keys").mapInPandas(enumerate_, "sub long, s long, t long, low boolean, high boolean, set long")
    on = ["sub", "s", "t"]
    least = rows.groupBy(*on).agg(F.min(F.when(F.col("low"), F.col("set"))).alias("l"), F.min(F.when(F.col("high"), F.col("set"))).alias("h"), F.count("*").alias("m")).filter("m > 1")
    met = rows.join(least, on)
    return met.select(F.col("set").alias("a"), F.explode(F.array(F.when(F.col("high"), F.col("l")), F.when(F.col("low"), F.col("h")))).alias("b")).filter("b IS NOT NULL AND a != b").distinct()


def verified(shared: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked, by the exact size of the intersection of their
    whole sets: what two sets share are keys of both. A bounded filter spares the keys of other
    sets, and the joins drop what it lets through."""
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    level = build_level(named, 7, 12, FILTER_BITS)
    discard(named)
    if level is None:
        return materialize(pairs.limit(0), "links")  # pairs may be discarded while links are still read
    sets = shared.filter("keys IS NOT NULL").filter(passes(level)(level_hash(F.col("set"), 7))).select("set", "n", "keys").dropDuplicates(["set"])
    a, b = sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("keys").alias("x")), sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("y"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.filter(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b"), "links")


def signature(keys: pd.Series) -> pd.Series:
    """Keys as bits: a bit of SIGNATURE longs is set where a key has that number as its low bits."""
    out = np.zeros((len(keys), 64 * SIGNATURE), np.uint8)
    for row, k in zip(out, keys):
        row[k.astype(np.int64) % (64 * SIGNATURE)] = 1
    return pd.Series([*np.packbits(out, axis=1, bitorder="little").view(np.int64)])


def promising(shared: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link: a bit that only one of two sets has stands
    for one or more keys that the other lacks. Signatures are made at the scan, keys stay there."""
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    level = build_level(named, 7, 12, FILTER_BITS)
    discard(named)
    if level is None:
        return pairs
    # In two steps, as a task that filters and signs at once holds two Python workers.
    some = materialize(shared.filter("keys IS NOT NULL").filter(passes(level)(level_hash(F.col("set"), 7))).select("set", "n", "keys"), "named")
    sets = materialize(some.select("set", F.col("n").cast("int").alias("n"), F.size("keys").alias("k"), F.pandas_udf(signature, "array<long>")("keys").alias("g")).dropDuplicates(["set"]), "signatures")
    discard(some)
    a, b = (sets.select(F.col("set").alias(s), *[F.col(c).alias(f"{c}{s}") for c in "nkg"]) for s in "ab")

    def only(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda total, bits: total + bits)

    most = F.least(F.col("ka") - only("ga", "gb"), F.col("kb") - only("gb", "ga"))
    out = materialize(pairs.join(a, "a").join(b, "b").filter(most >= need(F.col("na"), F.col("nb"), percent)).select("a", "b"), "pairs")
    discard(sets, pairs)
    return out


def reachable(n, pos, n2, pos2, percent: int) -> Column:
    """Whether sets of n and n2 elements whose first common element stands at pos and pos2 (from
    0) can still share enough."""
    return F.least(n - pos, n2 - pos2) >= need(n, n2, percent)


def opened(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The entries of lists in which sets of different components meet, with `comp`."""
    rows = lists.join(comps.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("component", "set")).drop("component")
    several = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("key")
    return materialize(rows.join(several, "key"), "open")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Group texts whose shingle sets have a Jaccard similarity of at least percent / 100:
    doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Copies with one shingle set count as one set throughout. Inverted lists are counted whole
    first, so that of each set only the shingles that others have remain (its keys), and only of
    sets that have enough of them. Small sets enumerate subsets of their keys; the others scan
    inverted lists, which hold a set under its prefix: its rarest shingles, so many that linked
    sets must meet there. The boundary is chosen by cost, and small sets near it also lie in the
    lists. In a list, every set is compared with the list's pivot; links so found join sets into
    components, and only lists that still hold several components are gone through again: in
    rounds with chance neighbours, and then for all pairs of different components whose sizes,
    places in both orders, and then signatures, allow a link. What is dropped on the way cannot be
    linked or is joined already, so components are exact. Rows are spread by shingle; no key gathers a group's
    texts.

    Null and empty texts and texts of white space have empty sets and link with nothing; fewer
    than `words` words are one shingle; repeated rows and copies share a component; rows with a
    null doc_id are grouped but name no component, unless there is no other name; an empty table
    gives no rows; other columns are not read. Texts are used whole. Shingles are told apart by
    HASH_BITS bits and sets by 64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = materialize(shared_keys(docs, words, percent), "shared")
    discard(docs)
    sets = shared.filter("keys IS NOT NULL")
    counts = sets.filter(F.col("n") <= SMALL).groupBy("n").agg(F.count_distinct("set").alias("c")).collect()
    x = boundary({r.n: r.c for r in counts}, percent)
    edges = materialize(small_edges(sets.filter(F.col("n") <= x).dropDuplicates(["set"]), x, percent), "edges") if x else None

    # Inverted lists: an entry's place in its set's order, of n shingles, and the list's length
    # and pivot. What no other set has comes first in the order.
    lone = F.col("n") - F.size("keys")
    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    front = F.slice("keys", F.lit(1), (F.col("n") - least + 1 - lone).cast("int"))
    entry = sets.filter((F.col("n") > x) | fits(F.col("n"), F.lit(x + 1), percent)).select("set", F.col("n").cast("int").alias("n"), lone.alias("lone"), F.element_at(front, -1).alias("w"), F.posexplode(front).alias("at", "key"))
    entry = entry.select("key", "set", "n", "w", (F.col("lone") + F.col("at")).cast("int").alias("pos")).distinct()
    pivot = F.min(F.struct(F.xxhash64("set").alias("h"), "set", "n", "pos")).alias("o")
    whole = entry.groupBy("key").agg(F.count("*").alias("m"), pivot).filter("m > 1")
    lists = materialize(entry.join(whole, "key"), "lists")

    def allowed(o: str) -> Column:
        return (F.col(f"{o}.set") != F.col("set")) & fits(F.col("n"), F.col(f"{o}.n"), percent) & reachable(F.col("n"), F.col("pos"), F.col(f"{o}.n"), F.col(f"{o}.pos"), percent)

    def pair(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def joined(pairs: DataFrame, edges: DataFrame | None, comps: DataFrame | None):
        """Edges and components with the links among `pairs` added."""
        links = verified(shared, pairs, percent)
        more = links if edges is None else materialize(edges.unionByName(links), "edges")
        if edges is not None:
            discard(edges, links)
        out = components(more)
        if comps is not None:
            discard(comps)
        return more, out

    tried = materialize(lists.filter(allowed("o")).select(*pair("set", "o.set")).distinct(), "pairs")
    edges, comps = joined(tried, edges, None)
    lists_ = lists.drop("o")
    for turn in range(TURNS):
        open_ = opened(lists_, comps)
        # Long lists are dealt into parts by chance, others each round.
        near = Window.partitionBy("key", F.pmod(F.xxhash64(F.lit(turn), "set"), F.floor(F.col("m") / PART) + 1)).orderBy(F.xxhash64(F.lit(turn), "key", "set"), "set")
        me = F.struct("set", "n", "pos", "comp")
        rows = open_.withColumns({f"o{k}": F.lag(me, k).over(near) for k in range(1, NEAR + 1)})
        rows = rows.select("set", "n", "pos", "comp", F.explode(F.array(*[f"o{k}" for k in range(1, NEAR + 1)])).alias("o")).filter("o IS NOT NULL AND o.comp != comp").filter(allowed("o"))
        pairs = materialize(rows.select(*pair("set", "o.set")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialize(tried.unionByName(pairs), "tried")
        edges, comps = joined(pairs, edges, comps)
        discard(tried, pairs, open_)
        tried = more
    open_ = opened(lists_, comps)
    discard(lists)
    # Sets of long lists carry their first keys there, so that most pairs are met but once.
    front = open_.groupBy("set").agg(F.when(F.max("m") >= LONG, F.slice(F.sort_array(F.collect_list("key")), 1, FRONT)).alias("front"))
    rows = open_.join(front, "set")
    x, y = (rows.select(F.col("key").alias(f"k{s}"), F.col("set").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "w", "pos", "comp", "front")]) for s in "ab")
    once = (F.col("compa") != F.col("compb")) & ((F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b"))))
    common = F.array_intersect("fronta", "frontb")
    here = F.coalesce(F.element_at(F.when(F.size(common) > 0, common), 1), F.col("ka")) == F.col("ka")
    # The first side's prefix ends first, so what is common up to there lies in both prefixes.
    whole = (F.size("fronta") < FRONT) & (F.size("frontb") < FRONT)
    enough = ~whole | (F.size(common) + F.ceil(F.col("na") * percent / 100 - 1e-9) - 1 >= need(F.col("na"), F.col("nb"), percent))
    can = once & fits(F.col("na"), F.col("nb"), percent) & reachable(F.col("na"), F.col("posa"), F.col("nb"), F.col("posb"), percent)
    met = x.join(y, (F.col("ka") == F.col("kb")) & can & (F.col("fronta").isNull() | F.col("frontb").isNull() | (here & enough)))
    pairs = promising(shared, materialize(met.select(*pair("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs"), percent)
    discard(tried, open_)
    edges, comps = joined(pairs, edges, comps)
    discard(pairs, edges)

    rooted = shared.select("doc_id", "n", "set").join(comps.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("component", "set"))
    # Written first: the join then deals plain rows of both sides, and a large group can be split.
    least = materialize(rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    out = rooted.select("doc_id", "n", "root").join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group of linked texts the
    row with the smallest doc_id stays (a null counts as largest; of rows alike in doc_id and text
    any one). Texts without words are all kept, but for such repeated rows; an empty table stays
    empty. Rows are told apart by a 64-bit hash of both columns, not by their place, so the table
    need not be read twice in one order.

    The rows that go are looked up in a table that travels to the tasks as long as it has at most
    TOLD rows, and by a join beyond. Texts are shuffled only in that join."""
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    groups = jaccard_join(docs.select(row.alias("doc_id"), "text"), words, percent)
    rows = docs.groupBy(row.alias("row")).agg(F.min("doc_id").alias("id"), F.count("*").alias("times"))
    known = groups.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("n"))
    named = known.join(rows, "row").withColumn("order", F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    best = materialize(named.groupBy("component").agg(F.min("order").alias("best")), "best")
    judged = named.join(best, "component").select("row", (F.col("best.row") == F.col("row")).alias("stays"), (F.col("times") > 1).alias("repeated"))
    special = materialize(judged.filter("NOT stays OR repeated").select("row", "stays"), "special")
    return dropped(docs, row, special)


def dropped(docs: DataFrame, row: Column, special: DataFrame) -> DataFrame:
    """docs without the rows that `special` (row, stays) names, but one each of those that stay."""
    n = special.count()
    if not n:
        return docs
    columns = docs.columns
    if n <= TOLD:
        table = special.sparkSession.sparkContext.broadcast(np.sort(np.array([r.row for r in special.select("row").toLocalIterator()], np.int64)))

        @F.pandas_udf("boolean")
        def told(h: pd.Series) -> pd.Series:
            keys, h = table.value, h.to_numpy(np.int64)
            return pd.Series(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)

        plain, others = docs.filter(~told(row)), docs.filter(told(row))
    else:
        named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), row.alias("row")).join(special.select("row", F.lit(True).alias("named")), "row", "left")
        plain, others = (named.filter(c).select("r.*") for c in ("named IS NULL", "named"))
    again = special.filter("stays").select("row")
    if again.isEmpty():
        return plain
    kept = others.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), row.alias("row")).join(again, "row").groupBy("row").agg(F.first("r").alias("r")).select("r.*")
    return plain.unionByName(kept)
