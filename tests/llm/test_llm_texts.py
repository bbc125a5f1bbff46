"""Operators on texts, against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from typeloom.llm import bpe, jaccard_join, license_scan, mixing, packing, pitman_yor, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, size long, row long, `set` string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "   \n\t", "a", "One two", "the the the the the the", "Hello, world! It's 12345 times\n\n  indented <|endoftext|> end", "naïve ßtraße \u3000 日本語 \U0001f600", LONG, "x" * 5000, "same text here for both rows", "same text here for both rows"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 1, 2, 3, 4, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[-1], (None, "a text without id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts_match_the_library(spark, docs, lib):
    got = token_counts.token_counts(docs, PATH).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(lib(r.text)), len(lib(r.text)) > 1024) for r in docs.collect())
    assert Counter(tuple(r) for r in got) == want


def test_pre_tokens_and_ids_match_the_library_for_all_kinds_of_characters(lib):
    b = bpe.byte_bpe(PATH)
    assert b.ranked
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = b.lib.pre_tokenizer.pre_tokenize_str
    settled = [c for c in chars if b.settled(c)]
    assert len(settled) > 90_000
    for part in (settled, [c for c in chars if not b.settled(c)]):
        at = random.Random(0).sample(part, 40_000)
        text = "".join(f"a{c}{c} 1{c}" for c in at)
        ids = lib(text)
        assert part is not settled or [text[i:j] for _, (i, j) in cut(text)] == b.cut(text)
        assert b.ids(text).tolist() == ids
        assert bpe.TokenCounter(b, ["the", " a"]).count(text) == len(ids)


def test_whole_tokens_are_single(lib):
    whole = bpe.byte_bpe(PATH).whole_tokens()
    assert len(whole) > 40_000
    assert all(len(lib(w)) == 1 for w in random.Random(0).sample(whole, 300))


def test_packing_round_trip(spark, docs, lib):
    for capacity in (1024, 16):
        out = packing.pack(docs, PATH, capacity=capacity, group_docs=4, with_ids=True).collect()
        pieces, bins = defaultdict(list), defaultdict(list)
        for r in out:
            ids = np.frombuffer(r.raw, "<u4")
            assert len(ids) == r.length and zlib.crc32(r.raw) == r.ids_crc32
            pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            assert sum(n for _, n in parts) <= capacity
        want = defaultdict(list)
        for r in docs.collect():
            ids = [*lib(r.text), 0]
            want[r.doc_id] += [(s, ids[s : s + capacity], len(ids)) for s in range(0, len(ids), capacity)]
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_first_fit_against_a_plain_loop():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] * (at == len(room))
        room[at] -= s
        want.append(at)
    assert packing.first_fit(sizes, 100) == want


def test_targets_stop_and_reshare():
    assert mixing.share_out([10, 1000], [5, 2]) == [30.0, 980.0]
    assert mixing.share_out([100, 100], [1, 1]) == [100.0, 100.0]
    assert sum(mixing.share_out([1, 2, 3, 1000], [5, 2, 1, 5])) == pytest.approx(1006)


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 100, 1023, 1024, 1025):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])), None if i % 11 == 0 else "s0" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(docs).collect()
    assert len(got) == 600 and {r.doc_id: r.size for r in got} == {i: len(words(t)) for i, t, _ in rows}
    size, taken, target = Counter(), Counter(), {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    assert all(r.source_size == size[rows[r.doc_id][2]] for r in got)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 3 for s in size)
    order = sorted((s for s in size if s), key=str) + [None]
    assert [target[s] for s in order] == pytest.approx(mixing.share_out([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]))
    again = mixing.mix_counts(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_on_awkward_rows(spark, docs):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == docs.count() and sum(r.size for r in got) == sum(len(words(r.text)) for r in docs.collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    plan = mixing.mix_plan(docs.select("doc_id", "text", "source"))
    assert sum(len(words(r.text)) for r in mixed.collect()) == plan.taken.agg(F.sum("length")).first()[0]


def test_license_digests(spark):
    mit = license_scan.KNOWN_TEXTS["MIT"]
    texts = [mit, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper(), mit.replace(",", " ;\n"), mit + " more", None, "", "released under the mit LICENCE"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, license_id string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs, license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, "MIT-line", "MIT"]


def test_every_listed_license_in_another_dress(spark):
    """Each listed text, and each as others write it, told by a plain account of the rules."""
    def plain(t):
        w = re.findall(r"[0-9a-z\u0080-\uffff]+", re.sub(license_scan.COPYRIGHT_LINE, "", t.lower()))
        line = " " + " ".join(w) + " "
        for one, other in license_scan.SPELLINGS:
            while f" {one} " in line:
                line = line.replace(f" {one} ", f" {other} ")
        return line.strip()

    dressed = {k: ["Copyright (c) 1999 Some One\n" + t.upper(), re.sub(r"[ \n]+", "\n   ", t), "## " + t.replace(".", " .\r\n")] for k, t in license_scan.KNOWN_TEXTS.items()}
    rows = [(k, t) for k, ts in dressed.items() for t in [license_scan.KNOWN_TEXTS[k], *ts]] + [(None, "licence licence licence"), (None, license_scan.KNOWN_TEXTS["MIT"][:-20])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs, license_scan.known_licenses(spark)).collect()}
    same = {plain(t): k for k, t in reversed(license_scan.KNOWN_TEXTS.items())}
    for i, (k, t) in enumerate(rows):
        assert got[i].license_id == (same[plain(license_scan.KNOWN_TEXTS[k])] if k else None)
        assert got[i].digest == hashlib.sha256(plain(t).encode()).hexdigest()


def test_license_with_typographic_signs_titles_and_holders(spark):
    mit = license_scan.KNOWN_TEXTS["MIT"]
    curly = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", mit)
    wrapped = mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("copyright notice", "\ncopyright notice")
    texts = [curly, mit.replace(", ", ",\u00a0"), "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + mit, "The MIT License (MIT)\r\nCopyright Jane Doe 2020\r\n" + curly, "\u2022 Copyright Jane Doe\n" + wrapped, wrapped, "MIT License", "Copyright Jane Doe", curly + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs, license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(9)] == ["MIT"] * 6 + [None] * 3


def brute_groups(rows):
    def shingles(t):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: (len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows)}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 11, 14, 20, 60, 200]))] for _ in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(420):
        w = list(base[rng.randrange(40)] if i % 3 else base[0] + passage)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        out.append((1000 - i, " ".join(w) if rng.random() < 0.9 else "\n".join(w).upper()))
    return [*out, (5000, None), (5001, ""), (5002, " \t"), (5003, passage[0])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_against_all_pairs(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == brute_groups(rows)


def test_small_sets_alone(spark, monkeypatch):
    """The enumeration with the boundary forced up finds the same groups."""
    monkeypatch.setattr(jaccard_join, "boundary", lambda counts, percent: 9)
    rows = [(d, t) for d, t in near_copies(7) if len(words(t)) < 18]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == brute_groups(rows)


def test_signatures_take_one_worker_a_task(spark, monkeypatch):
    """A plan that filters and signs in one step holds two Python workers beside a task."""
    plans, real = [], jaccard_join.materialize

    def seen(df, name="step"):
        if name == "signatures":
            plans.append(df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        return real(df, name)

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    shared = spark.createDataFrame([(1, 6, list(range(6))), (2, 6, list(range(6))), (3, 6, list(range(40, 46)))], "`set` long, n long, keys array<long>")
    pairs = real(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), "pairs")
    assert [tuple(r) for r in jaccard_join.promising(shared, pairs, 75).collect()] == [(1, 2)]
    assert plans == [1]


def test_a_large_group_that_is_nearly_linked(spark, monkeypatch):
    """Copies with three words changed, most pairs of them just below the threshold: few of the
    31125 pairs are met, and no link is lost."""
    rng, met, verified = random.Random(5), [], jaccard_join.verified
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(5, 145), rng.choice([2, 3, 3, 3])):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))

    def counted(shared, pairs, percent):
        met.append(pairs.count())
        return verified(shared, pairs, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert met[-1] < 500


def test_one_of_each_keeps_rows_without_words(spark, docs):
    kept = jaccard_join.one_of_each(docs).collect()
    assert docs.columns == list(kept[0].asDict())
    ids = Counter(r.doc_id for r in kept)
    assert ids == Counter([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None])


def test_toxicity_learns_words_and_finds_them(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}ord" for i in range(500)]
    rows, marks = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rottenly", "rottener", "foulx"]))
        rows.append((i, " ".join(w), "x"))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == marks[i][1] for i in held) >= 0.97 * len(held)
    for r in got.values():
        for s in r.spans:
            assert rows[r.doc_id][1][s.start : s.end] in ("vilest", "rottenly", "rottener", "foulx")
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    odd = toxicity.toxicity_scores(spark.createDataFrame([(1, None), (1, ""), (None, "foulx " * 20_000)], "doc_id long, text string"), model).collect()
    assert sorted(r.predicted for r in odd) == [0, 0, 1] and all(0 <= r.score <= 1 for r in odd)


def test_marginals_against_enumeration():
    move = np.array([[0.3, -0.7], [-0.2, 0.9]])
    crf = toxicity.Crf({}, -1.0, move, (1.0, 0.0))
    e = np.array([-1.0, -1.0, 2.0, -1.0, 0.5, -1.0, -1.0, -1.0, 1.0])
    total, one = 0.0, np.zeros(len(e))
    for code in range(1 << len(e)):
        tags = [(code >> i) & 1 for i in range(len(e))]
        w = np.exp(sum(e[i] * t for i, t in enumerate(tags)) + sum(move[a][b] for a, b in zip([0, *tags], tags)))
        total += w
        one += w * np.array(tags)
    got = crf.marginals(e)
    assert np.isnan(got[e == -1.0]).all()
    assert got[e != -1.0] == pytest.approx((one / total)[e != -1.0])


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def written(spark, path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("bucket", [6_000_000, 300])
def test_language_model_counts(spark, tmp_path, bucket):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randint(0, 60))), 1.0) for i in range(400)]
    rows += [(900, None, 1.0), (901, "", 1.0), (902, LONG, 1.0), (903, "Unseen WORDS only here", 1.0), (None, "t1 t2", 1.0), (3, rows[3][1], 1.0)]
    got = pitman_yor.lm_scores(written(spark, tmp_path / "d", rows, "doc_id long, text string, score double"), bucket=bucket).collect()
    toks = lambda t: [w.lower() for w in words(t)] + [None]
    c = Counter(w for d, t, _ in rows if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n) for d, t, _ in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    by_id = {d: t for d, t, _ in rows}
    for r in got:
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(by_id[r.doc_id]))
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_every_word_is_a_context(spark, tmp_path):
    rows = [(d, f"a{d % 400} b{d % 400}") for d in range(8000)]
    got = {r.doc_id: r.score - r.base_score for r in pitman_yor.lm_scores(written(spark, tmp_path / "d", rows)).collect() if held(r.doc_id)}
    # b, one token in 1200, is all but certain after its a; a list of the 256 commonest misses most of them
    assert len(got) > 500 and min(got.values()) > 3


def markov(seed, texts=400, length=30):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(150)]
    after = {w: rng.sample(vocabulary, 6) for w in [None, *vocabulary]}
    rows = []
    for d in range(texts):
        text, w = [], None
        for _ in range(rng.randint(length // 2, length)):
            w = rng.choices(after[w], [9, 5, 3, 2, 1, 1])[0] if rng.random() < 0.8 else rng.choice(vocabulary)
            text.append(w)
        rows.append((d, " ".join(text)))
    return rows, rng


def test_scores_tell_junk_from_shuffled_and_real_texts(spark, tmp_path):
    rows, rng = markov(1)
    ids = [d for d in range(10_000, 11_000) if held(d)]
    known = next(t for d, t in rows if not held(d))
    mixed = words(known)
    rng.shuffle(mixed)
    junk = " ".join("".join(rng.choices("qxzjkvw", k=6)) for _ in mixed)
    got = {r.doc_id: r for r in pitman_yor.lm_scores(written(spark, tmp_path / "d", [*rows, (ids[0], junk), (ids[1], " ".join(mixed)), (ids[2], known)])).collect()}
    assert got[ids[0]].score < got[ids[1]].score < got[ids[2]].score
    assert got[ids[0]].score < got[ids[0]].base_score
    rate = lambda which: -sum(got[d].score for d, _ in rows if held(d) == which) / sum(got[d].n_tokens for d, _ in rows if held(d) == which)
    assert rate(True) > rate(False)
    assert rate(True) < -sum(got[d].base_score for d, _ in rows if held(d)) / sum(got[d].n_tokens for d, _ in rows if held(d))


def plain_scores(rows, sweeps=12, keep=6):
    """The same model seated customer by customer, with every table kept."""
    rng = random.Random(0)
    toks = {d: [None if w is None else w.encode() for w in [*words(t), None]] for d, t in rows}
    pairs = {d: list(zip([None, *ts[:-1]], ts)) for d, ts in toks.items()}
    train = [p for d, ps in pairs.items() if not held(d) for p in ps]
    letters = pitman_yor.letters_of(np.bincount(pitman_yor.letter_pairs([t for _, t in rows]), minlength=257 * 257))
    table = pitman_yor.Words()
    for d in toks:
        for w in toks[d]:
            table[w or b""]  # noqa: B018
    base = dict(zip(table, 10.0 ** (-table.spelled(letters).astype(float) / pitman_yor.PARTS)))
    base[None] = base[b""]
    count = Counter(train)
    kinds = Counter(w for _, w in count)
    d1, d0 = (pitman_yor.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in (count, kinds))
    theta, seats, root = pitman_yor.THETA, {p: [n] for p, n in count.items()}, {w: [n] for w, n in kinds.items()}
    c, t = Counter(u for u, _ in train), Counter(u for u, _ in count)

    def parent(w):
        own = root.get(w, [])
        return (max(sum(own) - d0 * len(own), 0) + (theta + d0 * totals[1]) * base[w]) / (theta + totals[0])

    def p(u, w):
        own = seats.get((u, w), [])
        return (max(sum(own) - d1 * len(own), 0) + (theta + d1 * t[u]) * parent(w)) / (theta + c[u])

    def up(own):
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    def down(own, d, new):
        k = rng.choices(range(len(own) + 1), [*[n - d for n in own], new])[0]
        if k == len(own):
            own.append(1)
            return True
        own[k] += 1
        return False

    totals = [sum(kinds.values()), len(kinds)]
    mean = Counter()
    for sweep in range(sweeps + keep):
        for u, w in train:
            c[u] -= 1
            if up(seats[u, w]):
                t[u] -= 1
                totals[0] -= 1
                totals[1] -= up(root[w])
            if down(seats[u, w], d1, (theta + d1 * t[u]) * parent(w)):
                t[u] += 1
                totals[1] += down(root[w], d0, (theta + d0 * totals[1]) * base[w])
                totals[0] += 1
            c[u] += 1
        if sweep >= sweeps:
            for q in {q for ps in pairs.values() for q in ps}:
                mean[q] += p(*q) / keep
    return {d: sum(np.log10(mean[q]) for q in ps) for d, ps in pairs.items()}


@pytest.mark.parametrize("bucket", [6_000_000, 800])
def test_scores_against_seating_one_by_one(spark, tmp_path, bucket):
    rows, _ = markov(2, texts=250)
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in pitman_yor.lm_scores(written(spark, tmp_path / "d", rows), bucket=bucket).collect()}
    for which in (True, False):
        ids = [d for d in want if held(d) == which]
        assert sum(got[d] for d in ids) == pytest.approx(sum(want[d] for d in ids), rel=0.01)
        assert np.corrcoef([got[d] for d in ids], [want[d] for d in ids])[0, 1] > 0.995


def test_predictions_sum_to_one():
    m = pitman_yor.Model(0.7, 0.4, [20], [5], np.zeros(0), np.zeros((1, 0)))
    own, tables, cost = np.array([9, 6, 4, 1]), np.array([2, 1, 1, 1]), np.array([110, 130, 90, 250])
    p = m.root(own, tables, cost, 0)
    rest = (m.theta + m.d0 * 5) / (m.theta + 20) * (1 - (10.0 ** (-cost / pitman_yor.PARTS)).sum())
    assert p.sum() + rest == pytest.approx(1)
    c, t = np.array([4, 0, 6, 0]), np.array([1, 0, 2, 0])
    assert m.word(c, t, 10, 3, p).sum() + m.word(0, 0, 10, 3, rest) == pytest.approx(1)


def test_base_is_a_distribution_over_words():
    letters = pitman_yor.letters_of(np.bincount(pitman_yor.letter_pairs(["Some words, of SOME text", None, "\u00e9t\u00e9 \t x"]), minlength=257 * 257))
    assert (10.0**-letters).sum(1) == pytest.approx(np.ones(257))
    table = pitman_yor.Words()
    for w in (b"some", b"zzzz", b"\xc3\xa9t\xc3\xa9"):
        table[w]  # noqa: B018
    want = [letters[256, 256], *[sum(letters[a, b] for a, b in zip([256, *w], [*w, 256])) for w in list(table)[1:]]]
    got = table.spelled(letters) / pitman_yor.PARTS
    assert (got >= np.array(want) - 1e-6).all() and (got < np.array(want) + 0.011).all()


def test_seating_has_the_right_mean():
    rng = np.random.default_rng(0)
    for c, a, d in ((10, 0.8, 0.5), (400, 0.7, 0.3), (1500, 60.0, 0.6)):
        t = pitman_yor.seat(np.full(4000, c), np.full(4000, a), d, rng).mean()
        slow = np.ones(4000)
        for j in range(1, c):
            slow += rng.random(4000) * (a + j - d * slow) < a
        assert t == pytest.approx(slow.mean(), rel=0.04)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert token_counts.token_counts(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert mixing.mix_counts(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert license_scan.license_scan(none, license_scan.known_licenses(spark)).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert pitman_yor.lm_scores(none).count() == 0
    assert toxicity.toxicity_scores(none, toxicity.train(none, labels)).count() == 0
