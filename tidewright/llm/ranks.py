"""Problem 3: percentiles of very large columns, with a stated rank error.

A summary of n values is a list of tuples (value, least rank, greatest rank),
kept sorted.  Summaries are built per partition and merged hierarchically, first
by key and salt, then by key.  Merging adds rank bounds exactly.  Compression
removes tuples as long as the uncertainty between the neighbours that stay,

    greatest rank of i + 1 - least rank of i,

is at most twice the permitted error times n.  Each level of merging is given a
part of the permitted error, so that what accumulates never exceeds it; what it
came to is computed from the tuples and stated with every result.  Everything is
deterministic in its input; summaries of runs, zones or days can be stored and
merged later.

Defined cases: null and non-finite values are left out; null keys are a key;
a key without values has no summary; with at most 1 / (2 * error) values at every
level a summary is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted error of a rank, as a part of n.
ERROR = 0.001
#: Values that a task buffers before it summarises them.
BUFFER = 1_000_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def exact(values: np.ndarray) -> Summary:
    v = np.sort(values.astype(np.float64), kind="stable")
    r = np.arange(1, len(v) + 1)
    return v, r, r.copy(), len(v)


def compress(s: Summary, error: float) -> Summary:
    """The summary without the tuples that the permitted error can spare; both ends stay."""
    v, lo, hi, n = s
    room = 2 * error * n
    if len(v) < 3 or room < 2:
        return s
    # The farthest tuple whose greatest rank is within reach of each tuple's least rank.
    reach = np.searchsorted(hi, lo + room, "right") - 1
    reach = np.maximum(reach, np.arange(len(v)) + 1).tolist()
    keep, i, last = [0], 0, len(v) - 1
    while i < last:
        i = min(reach[i], last)
        keep.append(i)
    return v[keep], lo[keep], hi[keep], n


def merge(a: Summary, b: Summary) -> Summary:
    """The tuples of both, with the ranks that they have among the values of both."""
    va, la, ha, na = a
    vb, lb, hb, nb = b

    def ranks(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, y: np.ndarray, ylo: np.ndarray, yhi: np.ndarray, ny: int, side: str) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(y, x, side=side)  # y[k-1] comes before x, y[k] after it
        before = np.where(k > 0, ylo[np.maximum(k - 1, 0)], 0)
        after = np.where(k < len(y), yhi[np.minimum(k, len(y) - 1)] - 1, ny)
        return lo + before, hi + after

    l1, h1 = ranks(va, la, ha, vb, lb, hb, nb, "left")
    l2, h2 = ranks(vb, lb, hb, va, la, ha, na, "right")
    v = np.concatenate([va, vb])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([l1, l2])[order], np.concatenate([h1, h2])[order], na + nb


def united(many: list[Summary]) -> Summary:
    """All summaries merged, in a balanced tree."""
    while len(many) > 1:
        many = [merge(*many[i : i + 2]) if i + 1 < len(many) else many[i] for i in range(0, len(many), 2)]
    return many[0]


def error(s: Summary) -> float:
    """Ranks by which an answer may be off at most."""
    v, lo, hi, n = s
    if len(v) < 2:
        return float(n - 1) if n else 0.0
    ends = max(float(lo[0] - 1), float(hi[0] - 1), float(n - lo[-1]))
    return max(ends, float((hi[1:] - lo[:-1]).max()) / 2)


def quantile(s: Summary, q: float) -> float:
    """A value whose rank is within the summary's error of ceil(q n)."""
    v, lo, hi, n = s
    r = min(max(1, math.ceil(q * n)), n)
    return float(v[int(np.maximum(r - lo, hi - r).argmin())])


SCHEMA = "n bigint, v array<double>, lo array<bigint>, hi array<bigint>"


def _emit(keys: list[tuple], got: list[Summary], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
    cols += [pa.array([s[3] for s in got], pa.int64())]
    cols += [pa.array([s[i].tolist() for s in got], pa.list_(t)) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=[*names, "n", "v", "lo", "hi"])


def _split(b: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, finite values) of a batch of keys and a value."""
    x = b.column(keys).to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.isfinite(x)
    code = np.zeros(len(x), np.int64)
    for i in range(keys):
        enc = b.column(i).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * max(1, len(enc.dictionary)) + enc.indices.to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    order = order[ok[order]]
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield tuple(b.column(i)[int(part[0])].as_py() for i in range(keys)), x[part]


def summaries(df: DataFrame, keys: list[str], value: str, error: float = ERROR / 4) -> DataFrame:
    """Summaries of the keys in each partition: (*keys, n, v, lo, hi).  A task holds
    at most BUFFER values; a key of more has several summaries."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[np.ndarray]] = {}
        held, kinds = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(waiting.items())
            for i in range(0, len(items), 200):
                own = items[i : i + 200]
                yield _emit([k for k, _ in own], [compress(exact(np.concatenate(v)), error) for _, v in own], keys, kinds)
            waiting.clear()

        for b in batches:
            kinds = kinds or [b.schema.field(i).type for i in range(len(keys))]
            for k, x in _split(b, len(keys)):
                waiting.setdefault(k, []).append(x)
                held += len(x)
            if held > BUFFER:
                yield from flush()
                held = 0
        if kinds:
            yield from flush()

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), SCHEMA])
    return df.select(*keys, F.col(value).cast("double")).mapInArrow(run, schema)


def combined(parts: DataFrame, keys: list[str], error: float) -> DataFrame:
    """Summaries of one key united within each partition, which is sorted by the
    keys: a task holds the summaries of one key at a time."""
    types = dict(parts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [b.schema.field(i).type for i in range(len(keys))]
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

        for k, own in groupby(rows(), key=lambda r: r[: len(keys)]):
            many = [(np.array(v, float), np.array(lo, np.int64), np.array(hi, np.int64), n) for n, v, lo, hi in (r[len(keys) :] for r in own)]
            yield _emit([k], [compress(united(many), error)], keys, kinds)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), SCHEMA])
    return parts.select(*keys, "n", "v", "lo", "hi").mapInArrow(run, schema)


def merged(parts: DataFrame, keys: list[str], error: float = ERROR, before: float = ERROR / 4) -> DataFrame:
    """One summary for each key with an error of at most `error`, from summaries
    with an error of at most `before`.  Merging is hierarchical: by key and salt,
    then by key; no task receives more than the summaries of about the square
    root of the number of partitions for a key."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("n", F.element_at("v", 1), F.element_at("v", -1)), F.lit(max(2, math.isqrt(n))))
    salted = parts.withColumn("_salt", salt)
    first = combined(salted.repartition(n, *keys, "_salt").sortWithinPartitions(*keys, "_salt"), [*keys, "_salt"], (before + error) / 2).drop("_salt")
    return combined(first.repartition(n, *keys).sortWithinPartitions(*keys), keys, error)


def percentiles(sums: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(*keys, q, value, n, rank_error): the error in ranks, as stated by each summary."""
    types = dict(sums.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            rows = []
            for row in zip(*cols):
                k, (n, v, lo, hi) = row[: len(keys)], row[len(keys) :]
                s = np.array(v, float), np.array(lo, np.int64), np.array(hi, np.int64), n
                e = error(s)
                rows += [(*k, q, quantile(s, q), n, e) for q in qs]
            arrays = [pa.array([r[i] for r in rows], b.schema.field(i).type) for i in range(len(keys))]
            k = len(keys)
            arrays += [pa.array([r[k + j] for r in rows], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "q", "value", "n", "rank_error"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "q double, value double, n bigint, rank_error double"])
    return sums.select(*keys, "n", "v", "lo", "hi").mapInArrow(run, schema)
