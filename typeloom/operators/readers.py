"""Datasheets read by a model: texts first, pictures where a text does not do, and patterns where
the model fails. A reader is anything with read(question, images) -> dict of raw fields."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import raw_dimensions
from .dimensions import FIELDS, extract, fuse, normalised

#: From this confidence on, what was extracted from a text is not checked against pictures.
SURE = 0.7
ANSWER = {**dict.fromkeys(FIELDS, "string"), "confidence": "double", "method": "string", "seen": "string", "error": "string"}


class Reader(Protocol):
    def read(self, question: str, images: list[bytes]) -> dict: ...


def settled(answer: dict, seen: str) -> dict:
    """An answer in the shape of ANSWER; a method that is none of the two follows the confidence."""
    sure = float(answer.get("confidence", 0.0))
    method = answer.get("method")
    if method not in ("extracted", "estimated"):
        method = "extracted" if sure >= 0.6 else "estimated"
    fields = {f: None if answer.get(f) is None else str(answer[f]) for f in FIELDS}
    return {**fields, "confidence": sure, "method": method, "seen": seen, "error": None}


def read_one(reader: Reader, question: str, images: list[bytes]) -> dict:
    """The text's answer if it is sure or there are no pictures, else that of text and pictures;
    of a reader that fails, its message alone."""
    try:
        told = settled(reader.read(question, []), "text")
        if not images or (told["method"] == "extracted" and told["confidence"] >= SURE):
            return told
        return settled(reader.read(question, images), "images")
    except Exception as e:  # noqa: BLE001  one item must not end the others
        return {**dict.fromkeys(ANSWER), "confidence": 0.0, "error": f"{type(e).__name__}: {e}"[:200]}


def question(sheets: DataFrame, text: str) -> Column:
    """What is known of a part, then the text."""
    known = [F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in ("brand", "pn", "title", "category") if c in sheets.columns]
    return F.concat_ws("\n", F.lit("PART"), *known, F.lit("DATASHEET"), F.coalesce(F.col(text), F.lit("")))


def read_sheets(sheets: DataFrame, reader: Reader, text: str = "text", images: str | None = None) -> DataFrame:
    """sheets with raw fields, confidence and method, what was `seen` (text, images or patterns)
    and the reader's `error`. `images` names an array of pictures. Questions go out in Arrow
    batches; an item that fails is read by patterns and leaves the others alone."""

    @F.pandas_udf(f"struct<{','.join(f'{k}:{t}' for k, t in ANSWER.items())}>")
    def run(questions: pd.Series, pictures: pd.Series) -> pd.DataFrame:
        rows = [read_one(reader, q, [] if p is None else list(p)) for q, p in zip(questions, pictures)]
        return pd.DataFrame(rows, columns=list(ANSWER))

    pictures = F.col(images) if images else F.lit(None).cast("array<binary>")
    # a model is asked once an item, whatever reads the answer afterwards
    out = sheets.withColumn("_a", run.asNondeterministic()(question(sheets, text), pictures)).withColumn("_p", raw_dimensions(F.col(text)))
    failed = F.col("_a.error").isNotNull()
    either = {f: F.when(failed, F.col(f"_p.{f}")).otherwise(F.col(f"_a.{f}")) for f in [*FIELDS, "confidence"]}
    either |= {"method": F.when(failed, "regex_fallback").otherwise(F.col("_a.method")), "seen": F.when(failed, "patterns").otherwise(F.col("_a.seen")), "error": F.col("_a.error")}
    return out.withColumns(either).drop("_a", "_p")


def process(queries: DataFrame, sheets: DataFrame, reader: Reader | None = None, images: str | None = None) -> DataFrame:
    """Every query (pn) with its metric record from ranked sheets (see providers.cascade), read by
    a reader or by patterns alone and fused. Parts without any figure stay, with found false;
    notes say what failed on the way."""
    read = sheets.filter("has_data")
    if reader:
        read = read_sheets(read, reader, images=images)
    else:
        read = extract(read, "text").select("*", *[f"raw.{f}" for f in [*FIELDS, "confidence"]], F.lit(None).cast("string").alias("error"))
    evidence = read.select("pn", "provider_rank", "method", "source_type", F.coalesce("source_url", F.lit("")).alias("source_url"), *FIELDS, "confidence", "error")
    notes = evidence.groupBy("pn").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("notes"))
    out = queries.select("pn").distinct().join(normalised(fuse(evidence.drop("error"))), "pn", "left").join(notes, "pn", "left")
    some = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in FIELDS]).isNotNull()
    return out.withColumns({"found": some, "confidence": F.when(some, F.col("confidence")).otherwise(0.0), "notes": F.coalesce("notes", F.lit(""))})
