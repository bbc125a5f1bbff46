"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TokenCounter, byte_bpe
from .common import rows_of


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The vocabulary strings that encode alone as one token are proved once, on the driver, and
    broadcast (never more than the vocabulary). A pre-token among them counts one without
    merging; only the others are merged. One map over the scan, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; null
    keys stay; an empty table gives no rows; other columns are not read. Texts of any length
    are counted whole. Strings of added special tokens count as that one token.
    """
    whole = docs.sparkSession.sparkContext.broadcast(byte_bpe(tokenizer).whole_tokens())

    def count(batches):
        counter = TokenCounter(byte_bpe(tokenizer), whole.value)
        for ids, sizes, texts in rows_of(batches, "k", "n", "t"):
            yield pa.record_batch({"k": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())})

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.select(F.col(key).cast("long").alias("k"), size.alias("n"), F.col(text).alias("t")).mapInArrow(count, "k long, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
