"""JSON from language models: what can be read of fenced, chatty or cut-off answers.

Well-formed answers are read by Spark's own functions; only the scan for whole objects in a
broken text, which no regular expression can do, is an Arrow-batched function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE_OPEN, FENCE_CLOSE = r"^```[a-zA-Z]*\n?", r"\n?```$"
TEXT_PAIR = r'"([^"\\]{1,60})"\s*:\s*"([^"\\]{1,80})"'
NUMBER_PAIR = r'"(\d+)"\s*:\s*"([^"]*)"'
#: One step of the scan: a whole string, a string cut off by the end, or a brace.
STEP = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?$|[{}]', re.S)


def whole_objects(text: str | None) -> list[str]:
    """The outermost balanced {...} blocks; braces inside strings don't count."""
    out, depth, start = [], 0, 0
    for m in STEP.finditer(text or ""):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : m.end()])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_objects(texts: pd.Series) -> pd.Series:
    return texts.map(whole_objects)


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def salvage(text: str | None) -> str | None:
    """JSON text of the best reading of an answer: the whole; the outermost object or list in
    it; objects with an id; three or more flat text pairs; null if there is none of these."""
    t = (text or "").strip()
    if t.startswith("```"):
        t = re.sub(FENCE_CLOSE, "", re.sub(FENCE_OPEN, "", t)).strip()
    spans = [t, *(t[t.find(a) : t.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= t.find(a) < t.rfind(b))]
    for candidate in spans:
        got = _load(candidate)
        if got is not None or candidate == "null":
            return json.dumps(got, ensure_ascii=False)
    items = [o for o in map(_load, whole_objects(t)) if isinstance(o, dict) and "id" in o]
    pairs = re.findall(TEXT_PAIR, t)
    found = items or (dict(pairs) if len(pairs) >= 3 else None)
    return json.dumps({"assignments": found}, ensure_ascii=False) if found else None


@F.pandas_udf(T.StringType())
def salvage_json(texts: pd.Series) -> pd.Series:
    return texts.map(salvage)


def unfenced(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, FENCE_OPEN, ""), FENCE_CLOSE, ""))).otherwise(t)


def group_pairs(c: Column) -> Column:
    """map<int, string> of an answer that gives groups to numbers, as a map or as a list of
    {i or id, g or group}; whatever cannot be read is left out; names trimmed, upper case. A
    broken answer still gives its whole "number": "name" pairs."""
    body = F.coalesce(F.get_json_object(c, "$.assignments"), F.get_json_object(c, "$.groups"), c)
    as_map = F.map_entries(F.from_json(body, "map<string,string>"))
    listed = F.from_json(F.when(F.trim(body).startswith("["), body), "array<struct<i:string,id:string,g:string,`group`:string>>")
    as_list = F.transform(listed, lambda x: F.struct(F.coalesce(x["i"], x["id"]).alias("key"), F.coalesce(x["g"], x["group"]).alias("value")))
    keys, names = (F.regexp_extract_all(c, F.lit(NUMBER_PAIR), F.lit(g)) for g in (1, 2))
    torn = F.zip_with(keys, names, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    entries = F.coalesce(F.when(F.trim(body).startswith("["), as_list), F.when(F.try_parse_json(body).isNotNull(), as_map), torn)
    tidy = F.transform(entries, lambda e: F.struct(F.trim(e["key"]).try_cast("int").alias("k"), F.upper(F.trim(F.btrim(F.trim(e["value"]), F.lit('"')))).alias("v")))
    good = F.filter(tidy, lambda e: e["k"].isNotNull() & e["v"].isNotNull() & (e["v"] != ""))
    ks = F.transform(good, lambda e: e["k"])
    last = F.filter(good, lambda e, i: ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), e["k"]))
    return F.map_from_entries(last)


def assignment_rows(c: Column) -> Column:
    """array<struct<id int, cluster string>> of {"assignments": [{"id", "cluster"}]}; items without
    a whole number or a name are left out."""
    rows = F.from_json(F.get_json_object(c, "$.assignments"), "array<struct<id:string,cluster:string>>")
    typed = F.transform(rows, lambda r: F.struct(F.trim(r["id"]).try_cast("int").alias("id"), F.trim(r["cluster"]).alias("cluster")))
    return F.filter(typed, lambda r: r["id"].isNotNull() & (F.coalesce(r["cluster"], F.lit("")) != ""))
