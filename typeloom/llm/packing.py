"""Packing of documents into token sequences: first-fit decreasing with a tournament tree."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import rows_of

GROUP_DOCS = 2048


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, taken in the given order: the first bin with room for it.

    Bins are leaves of a tournament tree whose inner nodes hold the most room below them, so a
    search goes down from the root to the left-most leaf with enough room.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [capacity] * (2 * width)
    out = []
    for size in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < size:
                at += 1
        out.append(at - width)
        room[at] -= size
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS, with_ids: bool = False, seed: int = 0) -> DataFrame:
    """Pack texts of (doc_id, text) into sequences of at most `capacity` token ids.

    A document is its ids and then `end_id`; it is cut every `capacity` ids, and only the rest
    at its end competes for room. Pieces are dealt to randomised groups of about `group_docs`
    documents, and each group runs first-fit decreasing on its own, so work is spread evenly
    whatever a source or a document holds. Only descriptions of pieces are shuffled, unless
    `with_ids` asks for their ids too.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).
    A null or empty text is one piece with `end_id` alone; repeated rows are packed one by one;
    null doc_ids stay null; an empty table gives no rows; other columns are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def cut(batches):
        bpe, row = byte_bpe(tokenizer), 0
        part = TaskContext.get().partitionId()
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(doc_ids, texts):
                ids = np.append(bpe.ids(text or ""), np.uint32(end_id)).astype("<u4")
                mix = np.random.SeedSequence([seed, part, row]).generate_state(1)[0]
                row += 1
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    raw = piece.tobytes()
                    for c, v in zip(cols, (doc_id, start, len(piece), zlib.crc32(raw), len(ids), (int(mix) + k) % groups, raw if with_ids else None)):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "raw"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = np.array(first_fit(group["length"].tolist(), capacity), np.int64)
        group["sequence_id"] = group["grp"].astype("int64") * (1 << 32) + bins
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="grp")

    base = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"{base}, grp int, raw binary")
    out = pieces.groupBy("grp").applyInPandas(fill, f"{base}, raw binary, sequence_id long, offset long")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names, "raw") if with_ids else out.select(*names)
