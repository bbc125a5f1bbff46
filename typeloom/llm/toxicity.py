"""Toxicity: a linear-chain conditional random field over words."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, rows_of

TOKEN = regex.compile(r"[\p{L}\p{N}]+")
#: The classifier is fitted on at most so many clean and toxic labelled rows, taken by hash, and
#: so many bytes of their texts.
SAMPLE_CLEAN, SAMPLE_TOXIC, SAMPLE_BYTES = 4000, 1500, 1 << 26
#: Windows without marked words that are drawn from each text of the sample.
COLD_WINDOWS = 1
PREFIXES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    """Names of a word's features: the word, and its beginnings where it is longer."""
    return ["=" + word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


class Crf:
    """Two tags (0 clean, 1 toxic). `weights` of features and `bias` give a word's score for tag
    1 against tag 0; `move[a][b]` scores tag b after tag a."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, scale: tuple[float, float]):
        self.weights, self.bias, self.move, self.scale = weights, bias, move, scale

    def emissions(self) -> dict:
        crf = self

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 150_000:
                    self.clear()
                s = crf.bias + sum(crf.weights.get(f, 0.0) for f in features_of(word))
                self[word] = s
                return s

        return Known()

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """P(tag 1) at each word of one text, by forward-backward, exactly. Stretches of words
        without features all carry the bias, and a run of them is one power of one matrix."""
        n = len(e)
        out = np.full(n, np.nan)
        if not n:
            return out
        t = np.exp(self.move)
        at = np.flatnonzero(e != self.bias)
        neutral = t * np.array([1.0, math.exp(self.bias)])  # step into a neutral word
        gaps = np.diff(np.concatenate([[-1], at, [n]])) - 1
        powers = {0: np.eye(2)}

        def power(k: int) -> np.ndarray:
            if k not in powers:
                m = np.linalg.matrix_power(neutral / neutral.sum(1).max(), k)
                powers[k] = m / m.max()
            return powers[k]

        alpha, front = np.array([1.0, 0.0]), []  # before the first word the tag is 0
        for i, k in zip(at, gaps):
            a = (alpha @ power(int(k))) @ t * np.array([1.0, math.exp(min(e[i], 500.0))])
            alpha = a / a.sum()
            front.append(alpha)
        beta = power(int(gaps[-1])) @ np.ones(2)
        for j in range(len(at) - 1, -1, -1):
            m = front[j] * beta
            out[at[j]] = m[1] / m.sum()
            beta = power(int(gaps[j])) @ (t @ (np.array([1.0, math.exp(min(e[at[j]], 500.0))]) * beta))
            beta = beta / beta.sum()
        return out

    def raw(self, marginal: np.ndarray) -> float:
        """Log-odds that some word is toxic, from the marginals of words that have features."""
        m = marginal[~np.isnan(marginal)]
        clean = float(np.log1p(-np.minimum(m, 1 - 1e-12)).sum()) if len(m) else 0.0
        p = min(max(-math.expm1(clean), 1e-9), 1 - 1e-9)
        return math.log(p / (1 - p))

    def score(self, raw: float) -> float:
        a, b = self.scale
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * raw + b))))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


#: Features of a word that has none.
NONE: list = []


class Sample:
    """Labelled texts as arrays of word numbers; far smaller than their words."""

    def __init__(self, texts):
        numbers: dict[str, int] = {}
        self.docs = [(np.array([numbers.setdefault(w, len(numbers)) for w in tokens_of(t)], np.int32), int(y)) for t, y in texts]
        self.words = list(numbers)

    def feature_hashes(self) -> np.ndarray:
        """A row for each word: hashes of its features, 0 where it has fewer."""
        out = np.zeros((len(self.words), 1 + len(PREFIXES)), np.uint64)
        for i, w in enumerate(self.words):
            for k, f in enumerate(features_of(w)):
                out[i, k] = xxhash.xxh3_64_intdigest(f) | 1
        return out


def contexts_of(sample: Sample, hashes: np.ndarray, label: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features in texts of a label, and in how many different contexts each stands."""
    found, around = [], []
    for ids, y in sample.docs:
        if y == label and len(ids):
            wide = np.concatenate([[-1], ids, [-1]]).astype(np.int64).view(np.uint64)
            near = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
            f = hashes[ids]
            keep = (f != 0) if among is None else np.isin(f, among)
            found.append(f[keep])
            around.append((f * np.uint64(0xD6E8FEB86659FD93) + near[:, None])[keep])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, first = np.unique(np.concatenate(around), return_index=True)
    return np.unique(np.concatenate(found)[first], return_counts=True)


def label_words(sample: Sample, least: int = 4) -> list[str]:
    """Features that mark toxic words, from texts with labels.

    A feature's support in a class is the number of different contexts (word before, word after)
    in which it stands there, so copies and shared passages count once. A feature is kept if it
    has at least `least` contexts in toxic texts and its share of contexts there is above the
    share of words there so clearly that chance would give no such feature among all that were
    looked at (a Chernoff bound on the binomial tail, times the number of features).
    """
    hashes = sample.feature_hashes()
    totals = [1 + sum(len(ids) for ids, y in sample.docs if y == label) for label in (0, 1)]
    names, ones = contexts_of(sample, hashes, 1)
    chance = math.log(1 + len(names)) + 1
    names, ones = names[ones >= least], ones[ones >= least]
    clean = dict(zip(*(x.tolist() for x in contexts_of(sample, hashes, 0, names))))
    share, kept = totals[1] / sum(totals), set()
    for f, one in zip(names.tolist(), ones.tolist()):
        zero = clean.get(f, 0)
        q = one / (one + zero)
        if q > share:
            bound = (one + zero) * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))
            odds = math.log(one / totals[1]) - math.log((zero + 0.5) / totals[0])
            if bound > chance and odds > 3.0:
                kept.add(f)
    rows = np.flatnonzero(np.isin(hashes, np.array(sorted(kept), np.uint64)).any(1)) if kept else []
    return sorted({f for i in rows for f in features_of(sample.words[i]) if (xxhash.xxh3_64_intdigest(f) | 1) in kept})


def fit_crf(sample: Sample, steps: int = 60, window: int = 24, cold_windows: int = COLD_WINDOWS) -> Crf:
    """Fit the field on texts with document labels.

    Words get labels first: 1 for a word of a toxic text that has a marking feature, else 0.
    Training sequences are all windows of the sample with such words, and of each text
    `cold_windows` others; weights
    climb the penalised log-likelihood, whose gradient is empirical minus expected counts from
    forward-backward run over all windows at once. A logistic curve over the log-odds of whole
    texts then turns marginals into scores.
    """
    names = label_words(sample)
    where = {f: i for i, f in enumerate(names)}
    marks = {i: hits for i, w in enumerate(sample.words) if (hits := [where[f] for f in features_of(w) if f in where])}
    marked = np.zeros(len(sample.words), bool)
    marked[list(marks)] = True
    windows, rng = [], np.random.default_rng(0)
    for ids, y in sample.docs:
        hot = np.unique(np.flatnonzero(marked[ids]) // window) * window
        cold = np.setdiff1d(np.arange(0, len(ids), window), hot)
        for s in [*hot.tolist(), *rng.permutation(cold)[:cold_windows].tolist()]:
            hits = [marks.get(i, NONE) for i in ids[s : s + window].tolist()]
            windows.append((hits, [int(bool(h) and y == 1) for h in hits]))
    if not windows or not names:
        return Crf({}, -6.0, np.zeros((2, 2)), (1.0, 0.0))
    n = len(windows)
    length = np.array([len(h) for h, _ in windows])
    gold = np.zeros((n, window), np.int8)
    cells_t, cells_f = [], []
    for i, (hits, tags) in enumerate(windows):
        gold[i, : len(tags)] = tags
        for t, fs in enumerate(hits):
            for f in fs:
                cells_t.append(i * window + t)
                cells_f.append(f)
    cells_t, cells_f = np.array(cells_t, np.int64), np.array(cells_f, np.int64)
    live = np.arange(window)[None, :] < length[:, None]
    w, bias, move = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    pen, rate = 0.02, 0.15
    m_w, v_w = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    both = live[:, 1:] & live[:, :-1]
    gold_move = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_w = np.bincount(cells_f, gold.reshape(-1)[cells_t], len(names))
    for step in range(1, steps + 1):
        e = bias + np.bincount(cells_t, w[cells_f], n * window).reshape(n, window)
        phi = np.stack([np.ones_like(e), np.exp(np.minimum(e, 30))], 2)
        t = np.exp(move)
        alpha, beta = np.zeros((n, window, 2)), np.ones((n, window, 2))
        alpha[:, 0] = phi[:, 0] / phi[:, 0].sum(1, keepdims=True)
        for k in range(1, window):
            a = (alpha[:, k - 1] @ t) * phi[:, k]
            alpha[:, k] = np.where(live[:, k, None], a / a.sum(1, keepdims=True), alpha[:, k - 1])
        for k in range(window - 2, -1, -1):
            b = (beta[:, k + 1] * phi[:, k + 1]) @ t.T
            beta[:, k] = np.where(live[:, k + 1, None], b / b.sum(1, keepdims=True), 1.0)
        m = alpha * beta
        m = m / m.sum(2, keepdims=True)
        p1 = np.where(live, m[:, :, 1], 0.0)
        pair = alpha[:, :-1, :, None] * t * (phi[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair = pair / pair.sum((2, 3), keepdims=True)
        want_move = (pair * both[:, :, None, None]).sum((0, 1))
        g = np.concatenate([gold_w - np.bincount(cells_f, p1.reshape(-1)[cells_t], len(names)) - pen * n * w / max(1, len(names)), [gold.sum() - p1.sum()], (gold_move - want_move - 0.05 * move).reshape(-1)]) / n
        m_w, v_w = 0.8 * m_w + 0.2 * g, 0.95 * v_w + 0.05 * g * g
        up = rate * (m_w / (1 - 0.8**step)) / (np.sqrt(v_w / (1 - 0.95**step)) + 1e-8)
        w, bias, move = w + up[: len(names)], bias + up[len(names)], move + up[len(names) + 1 :].reshape(2, 2)
    crf = Crf({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias), move, (1.0, 0.0))
    known = crf.emissions()
    scores = np.array([known[w] for w in sample.words])
    x = np.array([crf.raw(crf.marginals(scores[ids])) for ids, _ in sample.docs])
    y = np.array([label for _, label in sample.docs], float)
    a, b = 1.0, 0.0
    weight = np.full(len(y), 1 / len(y))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        d = weight * (y - p)
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
        da, db = np.linalg.solve(hess, [(d * x).sum() - 1e-4 * (a - 1), d.sum() - 1e-4 * b])
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-6:
            break
    crf.scale = (max(a, 1e-3), b)
    return crf


def train(docs: DataFrame, labels: DataFrame, clean: int = SAMPLE_CLEAN, toxic: int = SAMPLE_TOXIC, most: int = SAMPLE_BYTES) -> Crf:
    """The field fitted on rows of docs (doc_id, text) with labels (doc_id, toxic) whose
    crc32(doc_id as text) mod 5 is not 0: at most `clean` and `toxic` of each label, those
    with the smallest hashes of doc_id, as long as their texts come to at most `most` bytes.
    Repeated rows of a doc_id count as one, with the least of their texts. One task fits that
    bounded sample; only the field reaches the driver."""
    mine = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id", "toxic")
    picked = [mine.filter(F.col("toxic") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, clean), (1, toxic))]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # A global order, but of the sample's rows only.
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic"))
    sample = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= most).drop("so_far")

    def fit(batches):
        texts = [(i, y, t) for b in batches for i, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")))]
        texts.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        field = pickle.dumps(fit_crf(Sample((t, y) for _, y, t in texts)))
        texts.clear()
        release()
        yield pa.record_batch([pa.array([field], pa.binary())], names=["field"])

    got = sample.coalesce(1).mapInArrow(fit, "field binary").collect()
    return pickle.loads(got[0].field) if got else fit_crf(Sample(()))


def toxicity_scores(docs: DataFrame, model: Crf, offsets: bool = True) -> DataFrame:
    """Score whole texts: doc_id, score, predicted and, if asked, spans: the (start, end)
    character offsets in the lower-cased text of words whose marginal is at least 0.5.

    One map over the scan. Null and empty texts have no words and the score of a text without
    toxic words; repeated rows are scored one by one; null doc_ids stay; an empty table gives no
    rows; other columns are not read; texts are never cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        crf = shared.value
        known = crf.emissions()
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for ids, texts in rows_of(batches, "doc_id", "text"):
            scores, spans = [], []
            for text in texts:
                words = tokens_of(text)
                marginal = crf.marginals(np.fromiter(map(known.__getitem__, words), float, len(words)))
                scores.append(crf.score(crf.raw(marginal)))
                bad = np.flatnonzero(np.nan_to_num(marginal) >= 0.5) if offsets else []
                at = [m.span() for m in TOKEN.finditer(text.lower())] if len(bad) else []
                spans.append([{"start": at[i][0], "end": at[i][1]} for i in bad])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, span_type)], names=["doc_id", "score", "spans"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, spans array<struct<start:int,end:int>>")
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out if offsets else out.drop("spans")


def drop_toxic(docs: DataFrame, model: Crf) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5. One map over the scan; null
    and empty texts stay, repeated rows are judged one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def keep(batches):
        crf = shared.value
        known = crf.emissions()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fine = []
                for t in part.column(text).to_pylist():
                    words = tokens_of(t)
                    fine.append(crf.score(crf.raw(crf.marginals(np.fromiter(map(known.__getitem__, words), float, len(words))))) < 0.5)
                yield part.filter(pa.array(fine, pa.bool_()))
        del known
        release()

    return docs.mapInArrow(keep, docs.schema)
