"""LM scoring by a hierarchical Pitman-Yor model, its restaurants seated by Gibbs sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, narrow, packed, pieces, release, rows_of, steps, unpacked, unsteps, words_of

#: Parameters: sweeps before samples are kept; samples whose predictions are averaged.
BURN_IN, SAMPLES = 3, 3
#: Tokens and texts of a block; tokens that a bucket of contexts stands for.
BLOCK, MANY, BUCKET = 1_000_000, 65_000, 2_000_000
#: Strength of the restaurants, and of the root.
THETA = 1.0
#: Bits of a word's hash. Base probabilities are kept in so many parts of a power of ten.
HASH_BITS, PARTS = 57, 100
#: One text in so many is looked at to find contexts so common that they are dealt by word as well.
LOOK = 64
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end of text\x00") >> (64 - HASH_BITS))
#: What stands between words, for the base; and the letters that bytes count as.
GAP = 256
LETTERS = np.array([GAP if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)])


class Words(dict):
    """The different words of a block, numbered as they come; 0 is the end of a text."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        out = np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - HASH_BITS) for w in self), np.uint64, len(self))
        out[0] = END
        return out

    def spelled(self, letters: np.ndarray) -> np.ndarray:
        """-log10 of each word's probability under the base: its bytes and then its end, each drawn
        by the one before from `letters`, in PARTS of a power of ten, rounded up."""
        size = np.fromiter(map(len, self), np.int64, len(self))
        line = np.full(size.sum() + len(size) + 1, GAP)
        ends = np.cumsum(size + 1)
        inside = np.ones(len(line), bool)
        inside[0] = inside[ends] = False
        line[inside] = np.frombuffer(b"".join(self), np.uint8)
        cost = np.concatenate([[0.0], np.cumsum(letters[line[:-1], line[1:]])])
        return np.minimum(65535, np.ceil((cost[ends] - cost[ends - size - 1]) * PARTS - 1e-6)).astype(np.uint16)


def letter_pairs(texts: list[str | None]) -> np.ndarray:
    """Which letters (bytes, capitals as small ones, white space as GAP) follow which in texts, as
    numbers 257 * first + second."""
    raw = b" " + b" ".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b" "
    line = LETTERS[np.frombuffer(raw, np.uint8)]
    return line[:-1] * (GAP + 1) + line[1:]


def letters_of(pairs: np.ndarray) -> np.ndarray:
    """-log10 probabilities of a letter after another, from how often each pair occurs; every pair
    counts once more."""
    n = pairs.reshape(GAP + 1, GAP + 1) + 1.0
    return -np.log10(n / n.sum(1, keepdims=True))


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of hashes; sorted hashes lie in sorted ranges."""
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each hash stands among the sorted known ones, or -1."""
    at = np.searchsorted(known, h)
    return np.where((at < len(known)) & (np.append(known, 0)[at] == h), at, -1)


class Block:
    """Consecutive texts as numbers of words, on their way to the buckets."""

    def __init__(self):
        self.words, self.tokens, self.ids, self.held, self.size = Words(), [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: str | None) -> None:
        words = words_of(text)
        self.tokens.append(np.fromiter(map(self.words.__getitem__, [*words, b""]), np.int32, len(words) + 1))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words) + 1

    @property
    def full(self) -> bool:
        return self.size >= BLOCK or len(self.ids) >= MANY

    def rows(self, facts: Facts, salt: int, texts: bool) -> pa.RecordBatch:
        """A row for each bucket that the block has contexts in: its pairs of a context (the word
        before; the end, before a text's first) and a word, and either how often each occurs in
        training and what the words' base costs are, or which texts each occurs in."""
        h = self.words.hashes()
        order = np.argsort(h)
        rank = np.empty(len(h), np.int32)
        rank[order] = np.arange(len(h), dtype=np.int32)
        costs = self.words.spelled(facts.letters)[order]
        h = h[order]
        w = rank[np.concatenate(self.tokens)]
        u = np.concatenate([rank[:1], w[:-1]])
        size = np.array([len(t) for t in self.tokens])
        doc = np.repeat(np.arange(len(size)), size).astype(np.uint16)
        train = ~np.array(self.held)
        bucket = range_of(h, facts.buckets).astype(np.int32)[u]
        if len(facts.heavy):
            spread = (within(h, facts.heavy) >= 0)[u]
            bucket[spread] = dealt(h[u[spread]], h[w[spread]], facts.buckets)
        key = (bucket.astype(np.int64) * len(h) + u) * len(h) + w
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        del key
        learned = None if texts else np.add.reduceat(train[doc].astype(np.int64), first)
        order = order[first]
        u, w, bucket = u[order], w[order], bucket[order]
        self.tokens.clear()
        info = packed(np.array([x or 0 for x in self.ids], np.int64), np.array([x is None for x in self.ids], bool), ~train, narrow(size)) if texts else b""
        block = xxhash.xxh3_64_intdigest(h.tobytes(), salt) - (1 << 63)
        out = {c: [] for c, _ in TO_BUCKETS}
        del order
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            heads, each = np.unique(u[lo:hi], return_counts=True)
            own, at = np.unique(w[lo:hi], return_inverse=True)
            parts = [steps(h[heads]), narrow(each), steps(h[own]), narrow(at)]
            if texts:
                inside = doc[first[lo] : first[hi] if hi < len(first) else len(doc)]
                parts += [narrow(n[lo:hi]), inside, np.packbits(train)]
            else:
                parts += [narrow(learned[lo:hi]), costs[own]]
            out["bucket"].append(int(bucket[lo]))
            out["data"].append(packed(*parts))
            out["info"].append(None)
        if texts:
            out["bucket"].append(int(block % facts.buckets))
            out["data"].append(None)
            out["info"].append(info)
        out["block"] = [block] * len(out["bucket"])
        return pa.RecordBatch.from_pydict(out, pa.schema(TO_BUCKETS))


TO_BUCKETS = [("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("info", pa.binary())]
NOTES = [("kind", pa.int32()), ("bucket", pa.int32()), ("to", pa.int32()), ("data", pa.binary()), ("nums", pa.list_(pa.int64()))]
NOTE = "kind int, bucket int, to int, data binary, nums array<long>"
#: Kinds of notes: about a bucket's pairs, its words, a heavy context, totals.
PAIRS, WORDS, HEAVY, TOTALS = range(4)


def dealt(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of pairs whose context is too common to lie in one."""
    x = u * np.uint64(0x9E3779B97F4A7C15) ^ w * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Facts:
    """What all tasks know before they start: numbers of buckets and of groups of words, the base,
    heavy contexts."""

    def __init__(self, buckets: int, letters: np.ndarray, heavy: np.ndarray):
        self.buckets, self.groups = buckets, max(1, buckets // 2)
        self.letters, self.heavy = letters, heavy


class Merged:
    """The pairs of one bucket, merged over blocks and sorted by hashes: contexts and words, and
    for each pair the places of both. `at` has, for each row, where its pairs stand."""

    def __init__(self, rows: list[list[np.ndarray]]):
        heads = [unsteps(r[0], len(r[1])) for r in rows]
        n_words = [(int(r[3].max()) + 1) if len(r[3]) else 0 for r in rows]
        own = [unsteps(r[2], n) for r, n in zip(rows, n_words)]
        self.u, ui = np.unique(np.concatenate(heads), return_inverse=True)
        self.w, self.word_at = np.unique(np.concatenate(own), return_inverse=True)
        up, wp = np.concatenate([[0], np.cumsum([len(x) for x in heads])]), np.concatenate([[0], np.cumsum(n_words)])
        keys = [np.repeat(ui[a:b], r[1]) * len(self.w) + self.word_at[c + r[3].astype(np.int64)] for r, a, b, c in zip(rows, up, up[1:], wp)]
        both, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.pu, self.pw = both // len(self.w), both % len(self.w)
        self.at = np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose c customers sit down one after another: customer j + 1 opens a
    table with probability a / (a + j - d t), where t tables stand. The first 32 customers are
    drawn one by one. After them, where tables are rare (a below 20), the next opening is drawn at
    once from its survival function, a ratio of gamma functions that is a power of j to within a
    part in ten thousand there; elsewhere customers come in groups of a fiftieth of those seated,
    with the chance of the group's middle."""
    t = (c > 0).astype(np.int64)
    for j in range(1, 32):
        on = np.flatnonzero(c > j)
        if not len(on):
            return t
        stay = np.maximum(j - d * t[on], 0)
        t[on] += rng.random(len(on)) * (a[on] + stay) < a[on]
    on, j = np.flatnonzero((c > 32) & (a >= 20)), 32
    while len(on):
        n = np.minimum(c[on] - j, max(1, j // 50))
        t[on] += rng.binomial(n, a[on] / (a[on] + np.maximum(j + n / 2 - d * t[on], 0)))
        j += max(1, j // 50)
        on = on[c[on] > j]
    on = np.flatnonzero((c > 32) & (a < 20))
    j = np.full(len(on), 32.0)
    while len(on):
        shift = a[on] / 2 - d * t[on] - 0.5
        with np.errstate(over="ignore", divide="ignore"):
            nxt = (j + shift) * rng.random(len(on)) ** (-1 / np.maximum(a[on], 1e-12)) - shift
        nxt = np.maximum(np.ceil(nxt), j + 1)
        opens = nxt <= c[on]
        on, j = on[opens], nxt[opens]
        t[on] += 1
    return t


class Model:
    """Totals that all tasks need. `customers` and `tables`: of the root, one for each sample.
    `heavy_c` and `heavy_t`: customers and tables (a row a sample) of the heavy contexts."""

    def __init__(self, d0: float, d1: float, customers, tables, heavy_c: np.ndarray, heavy_t: np.ndarray, theta: float = THETA):
        self.d0, self.d1, self.theta = d0, d1, theta
        self.customers, self.tables = np.array(customers, float), np.array(tables, float)
        self.heavy_c, self.heavy_t = heavy_c, heavy_t

    def root(self, customers: np.ndarray, tables: np.ndarray, cost: np.ndarray, s: int, more: float = 0.0) -> np.ndarray:
        """The root's probability of words with so many customers and tables there."""
        total = self.theta + self.customers[s] + more
        return np.maximum(customers - self.d0 * tables, 0) / total + (self.theta + self.d0 * self.tables[s]) / total * 10.0 ** (-cost.astype(float) / PARTS)

    def word(self, c, t, total_c, total_t, parent):
        """A restaurant's probability of a dish, whose parent gives it `parent`."""
        return (np.maximum(c - self.d1 * t, 0) + (self.theta + self.d1 * total_t) * parent) / (self.theta + total_c)


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def table(rows: list[dict], schema: list) -> pa.Table:
    release()
    return pa.Table.from_pylist(rows, pa.schema(schema))


def note(kind: int, bucket: int = -1, to: int = -1, data: bytes | None = None, nums=()) -> dict:
    return {"kind": kind, "bucket": bucket, "to": to, "data": data, "nums": [int(x) for x in nums]}


def grouped(h: np.ndarray, groups: int):
    """Slices of sorted hashes by their group."""
    g = range_of(h, groups)
    cuts = np.flatnonzero(np.diff(g, prepend=-1, append=-1))
    return [(int(g[lo]), slice(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:])]


def gathered(docs: DataFrame, facts: Facts, texts: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(facts)

    def gather(batches):
        part, turn, block = TaskContext.get().partitionId(), 0, Block()
        for ids, flags, all_texts in rows_of(batches, "doc_id", "held_out", "text"):
            for i, held, text in zip(ids, flags, all_texts):
                block.add(i, held, text)
                if block.full:
                    yield from pieces(block.rows(shared.value, part << 24 | turn, texts))
                    turn, block = turn + 1, Block()
        if block.ids:
            yield from pieces(block.rows(shared.value, part << 24 | turn, texts))

    return docs.mapInArrow(gather, "bucket int, block long, data binary, info binary")


def looked_at(docs: DataFrame, share: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many buckets the corpus takes, how often each letter follows another, and the hashes of
    words that make up more than one in `2 * buckets` tokens, judged by one text in LOOK. The
    latter only decide how the work is dealt."""

    def look(batches):
        pairs, n_texts, seen = np.zeros((GAP + 1) ** 2, np.int64), 0, {}
        for (texts,) in rows_of(batches, "text"):
            pairs += np.bincount(letter_pairs(texts), minlength=len(pairs))
            n_texts += len(texts)
            for t in texts:
                if xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) % LOOK == 0:
                    for w in [*words_of(t), b""]:
                        seen[w] = seen.get(w, 0) + 1
            if len(seen) > 500_000:
                seen = {w: n for w, n in seen.items() if n > 2}
        total = sum(seen.values())
        most = [(n, int(END) if not w else xxhash.xxh3_64_intdigest(w) >> (64 - HASH_BITS)) for w, n in seen.items() if n * 10_000 > total]
        some = np.flatnonzero(pairs)
        columns = [some, pairs[some], [h for _, h in most], [n for n, _ in most]]
        yield pa.record_batch([pa.array([n_texts]), pa.array([total]), *[pa.array([x], pa.list_(pa.int64())) for x in columns]], names=["texts", "looked", "pairs", "times", "words", "n"])

    rows = materialize(docs.select("text").mapInArrow(look, "texts long, looked long, pairs array<long>, times array<long>, words array<long>, n array<long>"), "look")
    sums = rows.agg(F.sum("texts").alias("texts"), F.sum("looked").alias("looked")).first()
    pairs = np.zeros((GAP + 1) ** 2, np.int64)
    for r in rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times").alias("n")).collect():
        pairs[r.pairs] = r.n
    ends = pairs.reshape(GAP + 1, GAP + 1)[:GAP, GAP].sum()
    buckets = int(max(4, (ends + (sums.texts or 0)) // share))
    common = rows.select(F.explode(F.arrays_zip("words", "n")).alias("x")).groupBy("x.words").agg(F.sum("x.n").alias("n")).filter(F.col("n") * 2 * buckets > F.lit(sums.looked or 0))
    heavy = np.sort(np.array([r.words for r in common.limit(4 * buckets).collect()], np.uint64)) if buckets >= 8 else np.zeros(0, np.uint64)
    discard(rows)
    return buckets, pairs, heavy


def lm_scores(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Score whole texts under a hierarchical Pitman-Yor model of order two, learned from the
    rows whose crc32(doc_id as text) mod 10 is not 0: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 of the text's probability).

    Every word of the training texts is a context with a restaurant of its own (as is the end,
    before a text's first word); all are children of one root, whose base spells words byte
    after byte, so that unseen words have a probability each, and a small one. Seatings are sampled by
    Gibbs sweeps: in each, the customers of every pair (context, word) get up and sit down again
    given the tables of its context and of the root as they then are. After `burn_in` sweeps,
    `samples` are kept; the root is then seated anew for each, and a token's predictive
    probabilities are averaged.

    Blocks of the scan count their pairs and send them, packed, to buckets of contexts, where a
    restaurant lies whole; only contexts too common for one bucket (`Facts.heavy`) are dealt by
    word, and their totals (a bounded number) go to all tasks, as of the round before. What the
    root needs of each word travels between buckets and groups of words. Pairs met once have one
    table, so only the others are kept between rounds. At last blocks send the texts in which
    pairs occur to the same buckets, which send back sums for each text; texts themselves are
    never shuffled, and what is shuffled grows with the corpus. Within a bucket tables of the root
    are counted as they change, those of other buckets as they were before. Words are told apart
    by HASH_BITS bits of a hash; a bucket's sums of a text's score are 32-bit floats.

    Null and empty texts are one token, the end; repeated rows are learned and scored one by one;
    a null doc_id is never held out; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    buckets, pairs_of_letters, heavy = looked_at(docs, bucket)
    facts = Facts(buckets, letters_of(pairs_of_letters), heavy)
    groups = facts.groups

    def count(group: pa.Table) -> pa.Table:
        """First notes on a bucket: the pairs that occur more than once in training, and of each
        word its tokens, contexts and base cost, and whether such pairs have it."""
        b = int(group["bucket"][0].as_py())
        rows = [unpacked(x, 6) for x in group["data"].to_pylist()]
        m = Merged(rows)
        c = np.bincount(np.concatenate(m.at), np.concatenate([r[4] for r in rows]), len(m.pu)).astype(np.int64)
        cost = np.zeros(len(m.w), np.uint16)
        cost[m.word_at] = np.concatenate([r[5] for r in rows])
        n, kinds = (np.bincount(m.pw, x, len(m.w)).astype(np.int64) for x in (c, c > 0))
        types = np.bincount(m.pu, c > 0, len(m.u)).astype(np.int64)
        more = np.flatnonzero(c > 1)
        many = np.zeros(len(m.w), bool)
        many[m.pw[more]] = True
        heads, hat = np.unique(m.pu[more], return_inverse=True)
        words, wat = np.unique(m.pw[more], return_inverse=True)
        out = [note(PAIRS, b, data=packed(m.u[heads], narrow(types[heads]), narrow(hat), narrow(wat), narrow(c[more]), cost[words]))]
        out += [note(WORDS, b, g, packed(steps(m.w[p]), narrow(n[p]), narrow(kinds[p]), cost[p], many[p])) for g, p in grouped(m.w, groups)]
        place = within(m.u, facts.heavy)
        sums = np.bincount(m.pu, c, len(m.u)).astype(np.int64)
        out += [note(HEAVY, b, nums=[place[i], sums[i], types[i]]) for i in np.flatnonzero(place >= 0)]
        out.append(note(TOTALS, b, nums=[c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()]))
        return table(out, NOTES)

    notes = materialize(gathered(docs, facts, False).groupBy("bucket").applyInArrow(count, NOTE), "notes")
    discard(docs)

    def totals(df: DataFrame, n: int) -> list[int]:
        got = df.filter(F.col("kind") == TOTALS).agg(*[F.sum(F.get("nums", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
        return [int(x or 0) for x in got]

    def heavies(df: DataFrame, n: int) -> np.ndarray:
        """Sums over buckets of what they note of heavy contexts: a row for each number noted."""
        out = np.zeros((n, len(facts.heavy)), np.int64)
        at = F.get("nums", F.lit(0)).alias("at")
        for r in df.filter(F.col("kind") == HEAVY).groupBy(at).agg(*[F.sum(F.get("nums", F.lit(i + 1))).alias(f"s{i}") for i in range(n)]).collect():
            out[:, r.at] = [r[f"s{i}"] for i in range(n)]
        return out

    train_tokens, pairs, ones, twos = totals(notes, 4)
    heavy_c, heavy_t = heavies(notes, 2)

    def open_root(group: pa.Table) -> pa.Table:
        """The first seating of the root, a customer for each context of a word; tells buckets of
        the words that their repeated pairs have."""
        g, rows = int(group["to"][0].as_py()), group.select(["bucket", "data"]).to_pylist()
        words = [unpacked(r["data"], 5) for r in rows]
        all_, at = np.unique(np.concatenate([unsteps(x[0], len(x[1])) for x in words]), return_inverse=True)
        own = np.bincount(at, np.concatenate([x[2] for x in words])).astype(np.int64)
        n = np.bincount(at, np.concatenate([x[1] for x in words])).astype(np.int64)
        out, where = [], np.split(at, np.cumsum([len(x[1]) for x in words])[:-1])
        for r, x, i in zip(rows, words, where):
            out.append(note(WORDS, r["bucket"], g, packed(narrow(own[i[x[4]]]))))
        return table([*out, note(TOTALS, nums=[(n > 0).sum(), (own == 1).sum(), (own == 2).sum()])], NOTES)

    of_words = notes.filter(F.col("kind") == WORDS)
    opening = materialize(of_words.select("to", "bucket", "data").groupBy("to").applyInArrow(open_root, NOTE), "opening")
    vocabulary, root_ones, root_twos = totals(opening, 3)
    discounts = discount(root_ones, root_twos), discount(ones, twos)
    first = spark.sparkContext.broadcast(Model(*discounts, [pairs], [vocabulary], heavy_c, heavy_t[None]))

    def settle(own: pa.Table, told: pa.Table) -> pa.Table:
        """Sweeps over one bucket; notes the tables of its repeated pairs, one array a sample, and
        the tables that these add to words and heavy contexts."""
        out = []
        for r in own.to_pylist():
            b, m = r["bucket"], first.value
            u, types, hat, wat, c, cost = unpacked(r["data"], 6)
            replies = sorted(told.to_pylist(), key=lambda x: x["to"])
            seen = [unpacked(x["data"], 1)[0] for x in replies]
            own_w = np.concatenate([np.zeros(0, np.int64), *seen]).astype(np.int64)
            types, hat, wat, c = (x.astype(np.int64) for x in (types, hat, wat, c))
            place = within(u, facts.heavy)
            base = np.where(place >= 0, np.append(m.heavy_t[0], 0)[place], types)
            rng, t, kept = np.random.default_rng([seed, b]), np.ones(len(c), np.int64), []
            for i in range(burn_in + samples):
                total_t = base + np.bincount(hat, t - 1, len(u))
                more = np.bincount(wat, t - 1, len(own_w))
                parent = m.root(own_w + more, np.ones(len(own_w)), cost, 0, more.sum())
                a = (m.theta + m.d1 * (total_t[hat] - t + 1)) * parent[wat]
                t = seat(c, a, m.d1, rng)
                if i >= burn_in:
                    kept.append(t)
            out.append(note(PAIRS, b, data=packed(*map(narrow, kept))))
            extra, at = [np.bincount(wat, t - 1, len(own_w)).astype(np.int64) for t in kept], 0
            for x, s in zip(replies, map(len, seen)):
                out.append(note(WORDS, b, x["to"], packed(*[narrow(e[at : at + s]) for e in extra])))
                at += s
            added = np.array([np.bincount(hat, t - 1, len(u)) for t in kept]).astype(np.int64)
            out += [note(HEAVY, b, nums=[place[i], *added[:, i]]) for i in np.flatnonzero(place >= 0)]
        return table(out, NOTES)

    of_pairs = notes.filter(F.col("kind") == PAIRS).select("bucket", "data")
    told = opening.filter(F.col("kind") == WORDS).select("bucket", "to", "data")
    seated = materialize(of_pairs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(settle, NOTE), "seated")
    del told, of_pairs
    discard(opening)
    heavy_t = heavy_t[None] + heavies(seated, samples)

    def close_root(group: pa.Table) -> pa.Table:
        """Seats the root for each sample and tells buckets of all their words."""
        g, rows = int(group["to"][0].as_py()), group.select(["bucket", "data", "later"]).to_pylist()
        words = {r["bucket"]: unpacked(r["data"], 5) for r in rows if not r["later"]}
        extra = {r["bucket"]: unpacked(r["data"], samples) for r in rows if r["later"]}
        order = sorted(words)
        all_, at = np.unique(np.concatenate([unsteps(words[b][0], len(words[b][1])) for b in order]), return_inverse=True)
        n, own = (np.bincount(at, np.concatenate([words[b][k] for b in order])).astype(np.int64) for k in (1, 2))
        cost = np.zeros(len(all_), np.uint16)
        cost[at] = np.concatenate([words[b][3] for b in order])
        many, m = np.concatenate([words[b][4] for b in order]), first.value
        rng, customers, tables = np.random.default_rng([seed, g, 1]), [], []
        for s in range(samples):
            more = np.concatenate([extra[b][s] for b in order]) if many.any() else []
            customers.append(own + np.bincount(at[many], more, len(all_)).astype(np.int64))
            tables.append(seat(customers[s], (m.theta + m.d0 * m.tables[0]) * 10.0 ** (-cost.astype(float) / PARTS), m.d0, rng))
        where = np.split(at, np.cumsum([len(words[b][1]) for b in order])[:-1])
        out = [note(WORDS, b, g, packed(narrow(n[i]), cost[i], *[narrow(x[i]) for x in (*customers, *tables)])) for b, i in zip(order, where)]
        return table([*out, note(TOTALS, nums=[x.sum() for x in (*customers, *tables)])], NOTES)

    both = of_words.select("to", "bucket", "data", F.lit(False).alias("later")).unionByName(seated.filter(F.col("kind") == WORDS).select("to", "bucket", "data", F.lit(True).alias("later")))
    closing = materialize(both.groupBy("to").applyInArrow(close_root, NOTE), "closing")
    del both, of_words
    sums = totals(closing, 2 * samples)
    discard(notes)
    final = spark.sparkContext.broadcast(Model(*discounts, sums[:samples], sums[samples:], heavy_c, heavy_t))

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        """Sums for each text of what its tokens in this bucket score."""
        rows = own.to_pylist()
        out = [{"block": r["block"], "data": None, "info": r["info"]} for r in rows if r["info"] is not None]
        rows = [r for r in rows if r["info"] is None]
        if rows:
            parts = [unpacked(r["data"], 7) for r in rows]
            b, m = Merged(parts), final.value
            times = [np.add.reduceat(np.unpackbits(x[6])[x[5]], np.cumsum(x[4], dtype=np.int64) - x[4], dtype=np.int64) for x in parts]
            c = np.bincount(np.concatenate(b.at), np.concatenate(times), len(b.pu)).astype(np.int64)
            del times
            notes_ = told.to_pylist()
            words = [unpacked(x["data"], 2 + 2 * samples) for x in sorted((x for x in notes_ if x["kind"] == WORDS), key=lambda x: x["to"])]
            n, cost, *rest = (np.concatenate([x[k] for x in words]) for k in range(2 + 2 * samples))
            seats = unpacked(next(x["data"] for x in notes_ if x["kind"] == PAIRS), samples)
            if len(n) != len(b.w) or len(seats[0]) != (c > 1).sum():
                raise RuntimeError("the table was not read twice alike: a bucket's words differ")
            place = within(b.u, facts.heavy)
            total_c = np.where(place >= 0, np.append(m.heavy_c, 0)[place], np.bincount(b.pu, c, len(b.u)))
            p = np.zeros(len(b.pu))
            for s in range(samples):
                t = (c > 0).astype(np.int64)
                t[c > 1] = seats[s]
                total_t = np.where(place >= 0, np.append(m.heavy_t[s], 0)[place], np.bincount(b.pu, t, len(b.u)))
                parent = m.root(rest[s].astype(float), rest[samples + s].astype(float), cost, s)
                p += m.word(c, t, total_c[b.pu], total_t[b.pu], parent[b.pw]) / samples
            p = np.log10(p)
            base = np.log10((n + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))[b.pw]
            known = (n > 0)[b.pw]
            for r, x, at in zip(rows, parts, b.at):
                at = np.repeat(at, x[4])
                texts, doc = np.unique(x[5], return_inverse=True)
                own_sums = [np.bincount(doc, y[at], len(texts)) for y in (p, base, known)]
                out.append({"block": r["block"], "data": packed(texts, own_sums[0].astype(np.float32), own_sums[1], narrow(own_sums[2].astype(np.int64))), "info": None})
        return table(out, [("block", pa.int64()), ("data", pa.binary()), ("info", pa.binary())])

    def total(group: pa.Table) -> pa.Table:
        rows = group.select(["data", "info"]).to_pylist()
        ids, none, flags, size = unpacked(next(r["info"] for r in rows if r["info"] is not None), 4)
        sums = np.zeros((3, len(ids)))
        for r in rows:
            if r["info"] is None:
                texts, *parts = unpacked(r["data"], 4)
                for k, x in enumerate(parts):
                    sums[k, texts] += x
        columns = [pa.array(ids, mask=none), pa.array(flags), pa.array(size.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[0])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    told = closing.filter(F.col("kind") == WORDS).unionByName(seated.filter(F.col("kind") == PAIRS)).select("bucket", "kind", "to", "data")
    scored = gathered(docs, facts, True).groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(score, "block long, data binary, info binary")
    return scored.groupBy("block").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
