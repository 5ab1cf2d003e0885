"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how texts are cut before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER):
    """The tokenizer in the file at `path` (ranks, one token a line); loaded once in a Python process."""
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_loaded_by_path", {})
    if path not in loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def count_tokens(docs: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """Columns `keep` of `docs` and `n_tokens`, the size of the whole `text`: 0 for a null or empty one."""
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text_of_tokens")).mapInArrow(run, schema)
