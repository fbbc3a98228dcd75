"""Hashed text vectors, structured frames, and their similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tidewright.functions.text import place_norm
from tidewright.functions.triage import NEEDS

# Weights of the two parts, and of the parts of a frame.
LEXICAL, SEMANTIC = 0.55, 0.75
FLAGS = ("disabled", "elderly", "infant", "injured", "pregnant")
LEVELS = ("none", "mild", "moderate", "critical")


def buckets(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, bucket, s): sums of signs of character 3- to 5-grams in 256 buckets.
    A bucket is the first byte of a gram's MD5, its sign the next bit."""
    t = df.select(ident, F.concat(F.lit(" "), place_norm(F.col(text)), F.lit(" ")).alias("t"))

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(n)))

    grams = F.concat(*[cut(n) for n in (3, 4, 5)])
    h = t.select(ident, F.explode(grams).alias("g")).select(ident, F.md5("g").alias("h"))
    sign = F.when(F.substring("h", 3, 1) < "8", 1).otherwise(-1)
    return h.groupBy(ident, F.substring("h", 1, 2).alias("bucket")).agg(F.sum(sign).alias("s")).filter("s <> 0")


def lexical(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, bucket, w): the unit vectors of `buckets`."""
    v = buckets(df, ident, text)
    n = v.groupBy(ident).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return v.join(n, ident).select(ident, "bucket", (F.col("s") / F.col("norm")).alias("w"))


def vectors(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, v, norm): `buckets` as one array of 256 whole numbers, and its length."""
    at = F.conv("bucket", 16, 10).cast("int")
    g = buckets(df, ident, text).groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("s").cast("int").alias("s")))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return g.select(ident, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("v"), "norm")


def weights() -> tuple[float, float]:
    """What the cosines of both parts count in that of the joint vector."""
    return LEXICAL**2, SEMANTIC**2


#: Normal texts have blanks, digits and letters only: a gram is a number in base 37.
_DIGIT = np.zeros(128, np.int32)
for _k, _c in enumerate(b" 0123456789abcdefghijklmnopqrstuvwxyz"):
    _DIGIT[_c] = _k
_LONG, _TABLE = (3, 4, 5), []


def _hashed(at: int, codes: np.ndarray, text: bytes, starts: np.ndarray) -> np.ndarray:
    """2 * bucket + (1 if the sign is positive) of the grams of _LONG[at] characters that begin at `starts`
    of `text`.  A process keeps what it has hashed: pages of the tables that no gram needs take no memory."""
    n = _LONG[at]
    while len(_TABLE) <= at:
        _TABLE.append(np.zeros(37 ** _LONG[len(_TABLE)], np.int16))
    key = np.zeros(len(starts), np.int32)
    for k in range(n):
        key *= 37
        key += codes[starts + k]
    got = _TABLE[at][key]
    new = np.flatnonzero(got == 0)
    if len(new):
        fresh, first = np.unique(key[new], return_index=True)
        for x, s in zip(fresh.tolist(), starts[new[first]].tolist(), strict=True):
            h = hashlib.md5(text[s : s + n]).digest()
            _TABLE[at][x] = 2 * h[0] + (h[1] < 128) + 1
        got = _TABLE[at][key]
    return got - 1


def counted(texts: list[str]) -> np.ndarray:
    """(texts, 256): what `buckets` gives for padded normal texts, as whole numbers."""
    raw = [t.encode("ascii") for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    text, begin = b"".join(raw), np.cumsum(size) - size
    codes = _DIGIT[np.frombuffer(text, np.uint8)]
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(begin + size, size) - np.arange(len(text))
    out = np.zeros(len(raw) * 256, np.int64)
    for at, n in enumerate(_LONG):
        starts = np.flatnonzero(left >= n)
        h = _hashed(at, codes, text, starts)
        both = np.bincount(owner[starts] * 512 + h, minlength=len(raw) * 512)
        out += both[1::2] - both[::2]
        for k in np.flatnonzero(size < n):  # a text shorter than the gram is one
            h = hashlib.md5(raw[k]).digest()
            out[k * 256 + h[0]] += 1 if h[1] < 128 else -1
    return out.reshape(len(raw), 256)


def packed(df: DataFrame, text: str, v: str = "v") -> DataFrame:
    """`df` with `v` instead of `text`: the 256 whole numbers of `buckets` as
    little-endian bytes, each of one byte if all fit, else of two or four."""
    names = [c for c in df.columns if c != text]
    kept = df.withColumn(text, F.concat(F.lit(" "), place_norm(F.col(text)), F.lit(" ")))
    schema = StructType([df.schema[c] for c in names]).add(v, BinaryType())

    def one(x: np.ndarray) -> bytes:
        most = np.abs(x).max()
        return x.astype("<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4").tobytes()

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                b = batch.slice(s, 1000)
                made = pa.array([one(x) for x in counted([t or "  " for t in b.column(text).to_pylist()])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], [*names, v])

    return kept.mapInArrow(vectors_of, schema)


def unpacked(c: pa.ChunkedArray) -> np.ndarray:
    """(rows, 256) whole numbers of what `packed` made, in the least type that holds all."""
    rows = [np.frombuffer(x, f"<i{len(x) // 256}") for x in c.to_pylist()]
    return np.stack(rows)


def unit(v: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """The joint unit vectors of `unpacked` numbers and frames, in double precision."""
    lex = v.astype(float)
    norm = np.sqrt((lex * lex).sum(1))[:, None]
    size = (LEXICAL**2 + SEMANTIC**2) ** 0.5
    return np.hstack([np.divide(lex, norm, out=lex, where=norm > 0) * (LEXICAL / size), frames * (SEMANTIC / size)])


def frame(need: Column, flags: Column, level: Column, people: Column) -> Column:
    """Unit vector of need, flags, urgency and a soft logarithmic headcount."""
    one = [F.when(need == n, 1.0).otherwise(0.0) for n in NEEDS]
    two = [F.when(F.array_contains(flags, f), 0.7).otherwise(0.0) for f in FLAGS]
    three = [F.when(level == x, 0.8).otherwise(0.0) for x in LEVELS]
    b = F.least(F.lit(3.0), F.log1p(people.cast("double")) / F.log(F.lit(60.0)) * 4)
    low = F.floor(b)
    four = [F.when(low == k, (1 - (b - low)) * 0.9).when(low + 1 == k, (b - low) * 0.9).otherwise(0.0) for k in range(4)]
    v = F.array(*one, *two, *three, *four)
    return F.transform(F.array(v), lambda x: F.transform(x, lambda y: y / F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, z: a + z * z))))[0]


def joint(items: DataFrame, ident: str) -> DataFrame:
    """(id, dim, w): unit vectors of both parts of `items` (id, raw_text, need_type,
    flags, level, people), whose products are the cosines of `similar`."""
    size = (LEXICAL**2 + SEMANTIC**2) ** 0.5
    lex = lexical(items, ident, "raw_text").select(ident, F.col("bucket").alias("dim"), (F.col("w") * (LEXICAL / size)).alias("w"))
    f = items.select(ident, F.posexplode(frame(F.col("need_type"), F.col("flags"), F.col("level"), F.col("people"))).alias("k", "v"))
    sem = f.filter("v <> 0").select(ident, F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".")).alias("dim"), (F.col("v") * (SEMANTIC / size)).alias("w"))
    return lex.unionByName(sem)


def similar(pairs: DataFrame, items: DataFrame, ident: str, least: float | str) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) whose joint vectors are alike: their
    cosine is at least `least`, a number or a column of `pairs`.  `items` (id, v,
    norm, frame) has one row for each text, and a pair stays one row throughout.

    Both parts have unit length, so the cosine of the joint vector is the
    weighted mean of the parts' cosines; a text without grams has no lexical part.
    """
    x = items.select(F.col(ident).alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"), F.col("frame").alias("fa"))
    y = items.select(F.col(ident).alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"), F.col("frame").alias("fb"))
    j = pairs.join(x, "a").join(y, "b")
    dot = lambda p, q, zero: F.aggregate(F.zip_with(p, q, lambda u, w: u * w), zero, lambda s, z: s + z)
    lex = F.coalesce(dot("va", "vb", F.lit(0)) / (F.col("na") * F.col("nb")), F.lit(0.0))
    l2, s2 = LEXICAL**2, SEMANTIC**2
    cos = (l2 * lex + s2 * dot("fa", "fb", F.lit(0.0))) / (l2 + s2)
    bar = F.col(least) if isinstance(least, str) else F.lit(least)
    return j.select("a", "b", F.round(cos, 6).alias("cosine"), bar.alias("bar")).filter("cosine >= bar").drop("bar")
