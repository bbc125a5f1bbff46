"""Work for a language model, in batches: taxonomy, classification, and grouping of phrases.

The model is anything with ask(system, user) -> str; KeywordModel answers offline by rules.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.salvage import salvage
from .ranking import batches, fixed_batches, sample_rows

# Words of a description and the type each stands for; the first that occurs counts.
KEYWORDS: list[tuple[str, str]] = [
    ("o-ring", "O-RING"), ("o ring", "O-RING"), ("ball joint", "BALL JOINT"), ("ball", "BALL"),
    ("wheel speed sensor", "SENSOR"), ("pressure sensor", "SENSOR"), ("sensor", "SENSOR"),
    ("screw", "SCREWs & NUTs & BOLTs & PINs & STUDs"), ("bolt", "SCREWs & NUTs & BOLTs & PINs & STUDs"),
    ("nut", "SCREWs & NUTs & BOLTs & PINs & STUDs"), ("stud", "SCREWs & NUTs & BOLTs & PINs & STUDs"),
    ("rivet", "SCREWs & NUTs & BOLTs & PINs & STUDs"), ("pin", "SCREWs & NUTs & BOLTs & PINs & STUDs"),
    ("gasket", "SEAL"), ("seal", "SEAL"), ("bearing", "BEARING, BRACKET, SUPPORT, NEEDLE, GUIDE RING"),
    ("bracket", "BEARING, BRACKET, SUPPORT, NEEDLE, GUIDE RING"), ("bushing", "BUSHING"), ("bush", "BUSHING"),
    ("spring", "SPRING"), ("filter", "FILTER"), ("clip", "CLIP & CLAMP"), ("clamp", "CLIP & CLAMP"),
    ("piston", "PISTON"), ("damper", "DAMPER"), ("solenoid", "SOLENOID VALVE"), ("valve", "VALVE BODY"),
    ("motor", "MOTOR"), ("pump", "PUMP ELEMENT"), ("washer", "WASHER"), ("ecu", "ECU"),
    ("label", "ADHESIVE FILM, LABEL, STICKER"), ("sticker", "ADHESIVE FILM, LABEL, STICKER"),
    ("cap", "PROTECTION CAP / SLEEVE"), ("sleeve", "PROTECTION CAP / SLEEVE"), ("rod", "ROD"),
    ("plug", "SCREW PLUG GROMMET"), ("grommet", "SCREW PLUG GROMMET"), ("reservoir", "RESERVOIR CAP"),
    ("armature", "ARMATURE"), ("tappet", "TAPPET"), ("plate", "PLATE/DISC"), ("disc", "PLATE/DISC"),
    ("housing", "HOUSING"), ("hydraulic", "HYDRAULIC UNIT"), ("coil", "COIL / MAGNET"), ("magnet", "COIL / MAGNET"),
]
OTHER, UNANSWERED = "OTHER", "INNE"


def keyword_type(description: Column) -> Column:
    """The type of the first rule whose word a description holds."""
    out = F.lit(OTHER)
    for word, kind in reversed(KEYWORDS):
        out = F.when(F.contains(F.lower(description), F.lit(word)), kind).otherwise(out)
    return out


class Model(Protocol):
    def ask(self, system: str, user: str) -> str: ...


class KeywordModel:
    """Answers by the rules, in the shape that the question asks for."""

    def kind(self, text: str) -> str:
        return next((k for w, k in KEYWORDS if w in text.lower()), OTHER)

    def ask(self, system: str, user: str) -> str:
        if numbered := re.findall(r"^\s*(\d+)\. (.+)$", user, re.M):
            return json.dumps({"assignments": {n: self.kind(t) for n, t in numbered}})
        if groups := re.findall(r'^GROUP "([^"]+)"\n((?:  - .*\n?)+)', user, re.M):
            return json.dumps({"names": [{"group": g, "name": self.vote(b.splitlines())} for g, b in groups]})
        if cards := re.findall(r'^\[(\d+)\].*?desc="(.*?)"', user, re.M):
            return json.dumps({"assignments": [{"id": int(i), "cluster": self.kind(d), **self.doubt(d)} for i, d in cards]})
        return json.dumps({"clusters": sorted({k for _, k in KEYWORDS} | {OTHER})})

    def doubt(self, text: str) -> dict:
        known = self.kind(text) != OTHER
        return {"confidence": 0.9 if known else 0.3, "missing": "" if known else "description too generic/only a code"}

    def vote(self, lines: list[str]) -> str:
        kinds = [self.kind(x) for x in lines if x.strip(" -\t")]
        best = Counter([k for k in kinds if k != OTHER] or kinds).most_common()
        return min((k for k, n in best if n == best[0][1]), default=OTHER)


class Retrying:
    """A model asked again after failures, with growing pauses; counts calls. It may be given a
    way to `adapt` to an error (to drop a parameter, or to raise the token budget once)."""

    def __init__(self, model: Model, tries: int = 5, longest: float = 30.0, adapt=None, sleep=time.sleep):
        self.model, self.tries, self.longest, self.adapt, self.sleep = model, tries, longest, adapt, sleep
        self.calls = 0

    def ask(self, system: str, user: str) -> str:
        for turn in range(self.tries):
            self.calls += 1
            try:
                return self.model.ask(system, user)
            except Exception as e:  # noqa: BLE001  whatever the client raises
                if turn + 1 == self.tries:
                    raise
                if not (self.adapt and self.adapt(e)):
                    self.sleep(min(self.longest, 2.0**turn))
        raise AssertionError


def _rows(answer: str, item: str) -> list:
    got = json.loads(salvage(answer) or "null")
    got = got.get(item, []) if isinstance(got, dict) else got
    return got if isinstance(got, list) else []


def discover_taxonomy(cards: DataFrame, key: str, card: str, model: Model, sample: int = 180, chunk: int = 60) -> list[str]:
    """Type names proposed for a sample of cards, then consolidated in one more question."""
    chosen = fixed_batches(sample_rows(cards, key, sample), key, chunk)

    def propose(group: pd.DataFrame) -> pd.DataFrame:
        answer = model.ask("taxonomy", "Propose clusters for these cards:\n" + "\n".join(group[card]))
        return pd.DataFrame({"name": [str(x) for x in _rows(answer, "clusters")]}, dtype=object)

    names = tidy_names(r[0] for r in chosen.groupBy("batch").applyInPandas(propose, "name string").distinct().orderBy("name").collect())
    return tidy_names(_rows(model.ask("taxonomy", "Consolidate these clusters:\n- " + "\n- ".join(names)), "clusters")) or names


def tidy_names(names) -> list[str]:
    """Names without spaces and quotes around them, upper case, each once, in order."""
    return list(dict.fromkeys(t for n in names if (t := str(n).strip().strip("\"'").strip().upper())))


def taxonomy(mode: str, seed: list[str], find) -> list[str]:
    """A fixed list; a seed followed by what is found; or what is found alone."""
    return tidy_names({"fixed": lambda: seed, "seed": lambda: [*seed, *find()], "discover": find}[mode]())


def _answers(model: Model, task: str, group: pd.DataFrame, key: str, card: str) -> list[tuple]:
    """(key, item) for every item of the answer that names a card of the batch."""
    ids = group[key].tolist()
    try:
        items = _rows(model.ask(task, "\n".join(f"[{i}] {c}" for i, c in enumerate(group[card]))), "assignments")
    except Exception:  # noqa: BLE001  one failed batch must not end the others
        return []
    at = [(str(x.get("id", "")).strip(), x) for x in items if isinstance(x, dict)]
    return [(ids[int(i)], x) for i, x in at if i.isdigit() and int(i) < len(ids)]


def share(value) -> float:
    """A number between 0 and 1 from whatever a model says; 0 where it is none."""
    try:
        return max(0.0, min(1.0, float(value))) if float(value) == float(value) else 0.0
    except (TypeError, ValueError):
        return 0.0


def classify(cards: DataFrame, key: str, card: str, model: Model, size: int = 25, allow_new: bool = True) -> DataFrame:
    """(key, cluster) in batches, spread over tasks. Items of an answer that make no sense are left
    out, a batch that fails gives no rows, and a leading NEW: is dropped."""
    from ..functions.text import strip_new

    kind = cards.schema[key].dataType.simpleString()
    work = batches(cards.select(key, card), key, size)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        named = ((k, str(x.get("cluster") or "").strip()) for k, x in _answers(model, "classify", group, key, card))
        return pd.DataFrame([(k, c) for k, c in named if c], columns=[key, "cluster"])

    got = work.groupBy("batch").applyInPandas(ask, f"{key} {kind}, cluster string")
    return got.withColumn("cluster", strip_new(F.col("cluster"))) if allow_new else got


def classify_with_confidence(cards: DataFrame, key: str, card: str, model: Model, size: int = 25) -> DataFrame:
    """(key, cluster, confidence, missing) in batches: how sure the model is of each answer, and
    what it lacks where it is not. Of several answers for a card the last counts; a batch that
    fails gives no rows."""
    kind = cards.schema[key].dataType.simpleString()

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        last = dict(_answers(model, "classify, with confidence and what is missing", group, key, card))
        out = [(k, str(x.get("cluster") or "").strip(), share(x.get("confidence")), str(x.get("missing") or "").strip()) for k, x in last.items()]
        return pd.DataFrame(out, columns=[key, "cluster", "confidence", "missing"])

    return batches(cards.select(key, card), key, size).groupBy("batch").applyInPandas(ask, f"{key} {kind}, cluster string, confidence double, missing string")


def classify_missing(cards: DataFrame, cache: DataFrame, key: str, card: str, model: Model, **options) -> DataFrame:
    """Cached answers, and new ones for what the cache lacks; unanswered items get a default."""
    from .entities import keep_missing

    new = classify(keep_missing(cards, cache, key), key, card, model, **options)
    known = cache.select(key, "cluster").unionByName(new)
    return cards.join(known, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(UNANSWERED)))


def name_groups(groups: dict[str, list[str]], model: Model, fallback: dict[str, str]) -> dict[str, str]:
    """A name for each group from one question about all; a fallback where the answer has none."""
    text = "\n".join(f'GROUP "{g}"\n' + "\n".join(f"  - {s}" for s in samples) for g, samples in groups.items())
    try:
        got = {str(x["group"]): str(x["name"]).strip() for x in _rows(model.ask("names", text), "names") if isinstance(x, dict) and x.get("group") and x.get("name")}
    except Exception:  # noqa: BLE001  naming must never end a run
        got = {}
    return {g: f"NEW: {got[g].upper()}" if got.get(g) else fallback.get(g, "NEW: UNRECOGNISED") for g in groups}


def group_phrases(phrases: list[str], model: Model, size: int = 90) -> dict[str, str]:
    """Groups of phrases, batch after batch, as each question names the groups found so far."""
    out: dict[str, str] = {}
    for at in range(0, len(phrases), size):
        part = phrases[at : at + size]
        known = sorted(set(out.values()))
        user = "Groups so far: " + ", ".join(known) + "\n" + "\n".join(f"{i}. {p}" for i, p in enumerate(part, 1))
        got = json.loads(salvage(model.ask("phrases", user)) or "{}").get("assignments", {})
        out |= {part[int(i) - 1]: g.strip().upper() for i, g in got.items() if str(i).isdigit() and 0 < int(i) <= len(part) and str(g).strip()}
    return out


def usage(log: DataFrame) -> DataFrame:
    """Calls and tokens of a log (prompt_tokens, completion_tokens)."""
    return log.agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
