"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches, byte_size, slices, tokenizer
from .common import quoted, short_batches, strings, with_struct

#: Characters from which on a text is split at safe boundaries.
PART = 1 << 15


def token_counts(texts: list[str], path: str, part: int = PART) -> list[int]:
    """Tokens of each text. Long texts are split at safe boundaries; the parts of all texts are coded in batches of
    about equal bytes, of parts of like size, and only their lengths are kept."""
    t, out = tokenizer(path), [0] * len(texts)
    parts = [(i, p) for i, x in enumerate(texts) if x for p in slices(x, size=part)]
    parts.sort(key=lambda x: byte_size(x[1]))
    at = 0
    for batch in batches([p for _, p in parts]):
        for (i, _), e in zip(parts[at : at + len(batch)], t.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            out[i] += len(e)
        at += len(batch)
    return out


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text, for a byte-level BPE file.

    Long texts are split at safe boundaries (a single space between two other characters) and coded in batches balanced
    by bytes; only lengths leave the function. Null counts as the empty text: 0 bytes, 0 tokens. Repeated rows count
    alike; extra columns stay; columns of df with the names of the new ones are replaced. An empty table gives an empty
    one.
    """
    short_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array(token_counts(strings(array), path), pa.int64())

    t = F.col(quoted(text))
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint")
    out = with_struct(df, F.struct(size.alias("n_bytes"), run(t).alias("n_tokens")), ["n_bytes", "n_tokens"])
    return out.drop("over_limit").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
