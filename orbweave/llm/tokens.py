"""Sizes of texts in tokens of a public tokenizer; its vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    """Path of the byte-level BPE of 50,256 ranks among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizer(path: str):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return sizes


def token_sizes(rows: DataFrame, keep: dict[str, str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns of `keep` (name: type) and `tokens`, the whole text's size; null and empty texts have 0."""
    chosen = rows.select(*(F.col(c).cast(t).alias(c) for c, t in keep.items()), F.col(text).alias("_text"))
    schema = ", ".join(f"{c} {t}" for c, t in keep.items()) + ", tokens bigint"
    return chosen.mapInArrow(_sizer(vocabulary or default_vocabulary()), schema)
