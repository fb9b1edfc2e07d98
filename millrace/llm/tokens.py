"""Token counts and token boundaries by a public byte-level BPE vocabulary."""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: The rank file; a parameter of every operator, found on each worker, never copied.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in stretches of about so many characters.
STRETCH = 200_000


@lru_cache(4)
def encoder(ranks: str = RANKS):
    """(encoding, bytes of each token)."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(table.values()) + 1, np.int32)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _stretches(text: str):
    """Parts of about STRETCH characters that each end where the splitting pattern ends a match, so that all merges stay as they are."""
    at = 0
    for m in _pattern().finditer(text):
        if m.end() - at >= STRETCH:
            yield text[at : m.end()]
            at = m.end()
    if at < len(text):
        yield text[at:]


def encode(text: str, ranks: str = RANKS) -> list[int]:
    coder, _ = encoder(ranks)
    if len(text) <= STRETCH:
        return coder.encode_ordinary(text)
    return [t for part in _stretches(text) for t in coder.encode_ordinary(part)]


def _counts(ranks: str):
    def run(batches):
        for batch in batches:
            n = [None if t is None else len(encode(t, ranks)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])
    return run


def with_counts(df: DataFrame, text: str, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """`keep` columns and n_tokens (null for a null text, 0 for an empty one) of every row, over whole texts."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_counts(ranks), f"{schema}, n_tokens long")
