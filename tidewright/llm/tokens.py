"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_50k.tiktoken"
_ENCODERS: dict[tuple[str, str], object] = {}


def vocabulary(name: str = DEFAULT) -> tuple[str, str]:
    """Path of a rank file of the installed public tokenizers, and their pattern."""
    import public_tokenizers as p

    return p.path(name), p.PATTERN


def encoder(path: str, pattern: str):  # noqa: ANN201
    """Byte-level BPE of a rank file, loaded once in each worker."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def counted(df: DataFrame, ident: str, text: str, keep: list[str] | None = None, vocab: tuple[str, str] | None = None) -> DataFrame:
    """(id, *keep, n_tokens); a null text has no tokens."""
    path, pattern = vocab or vocabulary()
    cols = [ident, *(keep or [])]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(cols))), pa.array(n, pa.int64())], names=[*cols, "n_tokens"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "n_tokens bigint"])
    return df.select(F.col(text), *cols).mapInArrow(run, schema)
