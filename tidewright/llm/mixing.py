"""Problem 9: mixing sources to target weights.

Documents of each source fall into blocks by a hash of their ids.  For each mix
the total is the largest at which every source that is there can give its share
without being used more often than allowed; a source gives whole passes and,
of one more pass, blocks in order up to its quota.  Of the last blocks of that
pass, those documents are taken whose sizes fill what is left of the quota as far
as can be, by subset sums.  A multivariate-hypergeometric splitting tree parts
the exact numbers of blocks of all sources among the output shards: at each node
the left shards draw their number of blocks from all blocks at hand without
replacement.  Shards then take disjoint runs of the permuted blocks and shuffle
their documents.

Blocks have BLOCK_DOCS documents or, in a collection of more than PLAN_BLOCKS
times that, as many more as keep their number at about PLAN_BLOCKS: that is all
the driver plans with.  A shard has SHARD_BLOCKS blocks.

Defined cases: spellings of sources are united (case, blanks, hyphens); null
sources and texts without tokens take no part; absent sources are reported with
nothing drawn, and the others keep their proportions; more than PLAN_BLOCKS rows
of targets are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.packing import fullest
from tidewright.session import small

PLAN_BLOCKS, BLOCK_DOCS, SHARD_BLOCKS = 100_000, 16, 16
#: Tokens at the end of a quota that are filled by subset sums; documents before them are taken in order.
EXACT_TOKENS = 100_000


def united(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Numbers of blocks of each source for each shard, by recursive halving."""
    if shards == 1:
        return [counts]
    left = shards // 2
    total = int(counts.sum())
    take = round(total * left / shards)
    draw = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts * 0
    return split(draw, left, rng) + split(counts - draw, shards - left, rng)


def blocked(sizes: DataFrame, source: str, ident: str, seed: int) -> tuple[DataFrame, list]:
    """Documents with their block, and (source, block, docs, tokens) of all blocks."""
    d = sizes.filter(F.col(source).isNotNull() & (F.col("n_tokens") > 0)).withColumn("source", united(F.col(source)))
    per = d.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    whole = F.greatest(F.lit(1), F.ceil(F.sum("c").over(W.partitionBy()) / F.lit(BLOCK_DOCS * PLAN_BLOCKS)))  # one row for each source
    per = per.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("c") / (F.lit(BLOCK_DOCS) * whole))))
    d = d.join(small(per.select("source", "blocks")), "source")
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), ident), F.col("blocks")).cast("int")).drop("blocks")
    sums = d.groupBy("source", "block").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    return d, sums.collect()


def plan(targets: list, sums: list, seed: int, total_tokens: int | None = None) -> tuple[list, list]:
    """Draws (mix, source, pass, block, shard, cut) and the report; `cut` is null
    for a block that is taken whole, else the number of tokens to take of all the
    blocks with a `cut` together: those about the end of the quota."""
    tokens: dict[str, dict[int, int]] = {}
    for r in sums:
        tokens.setdefault(r.source, {})[r.block] = r.tokens
    mixes: dict[str, list] = {}
    for t in targets:
        mixes.setdefault(t.mix_id, []).append(t)
    draws, report = [], []
    for mix in sorted(mixes):
        rows = sorted(mixes[mix], key=lambda t: t.source)
        avail = {t.source: sum(tokens.get(t.source, {}).values()) for t in rows}
        limits = [t.max_repeats * avail[t.source] / t.target_share for t in rows if avail[t.source] and t.target_share > 0]
        total = min([*limits, *([total_tokens] if total_tokens else [])], default=0)
        rng = np.random.default_rng([seed, *mix.encode()])
        lists: list[list[tuple[int, int, int | None]]] = []
        for t in rows:
            quota = min(int(total * t.target_share), t.max_repeats * avail[t.source])
            own: list[tuple[int, int, int | None]] = []
            order = sorted(tokens.get(t.source, {}))
            passes, left = divmod(quota, avail[t.source]) if avail[t.source] else (0, 0)
            own += [(p, b, None) for p in range(passes) for b in order]
            # Of the pass that the quota ends in: whole blocks, but for the one it ends in and its neighbours.
            k = 0
            while left and tokens[t.source][order[k]] <= left:
                left -= tokens[t.source][order[k]]
                k += 1
            if left:
                last = order[max(0, k - 1) : k + 2]
                left += tokens[t.source][order[k - 1]] if k else 0
                own += [(passes, b, None) for b in order[: max(0, k - 1)]] + [(passes, b, left) for b in last]
            else:
                own += [(passes, b, None) for b in order[:k]]
            lists.append([own[i] for i in rng.permutation(len(own))])
            report.append((mix, t.source, float(t.target_share), int(t.max_repeats), avail[t.source], quota))
        counts = np.array([len(x) for x in lists], np.int64)
        shards = max(1, math.ceil(counts.sum() / SHARD_BLOCKS))
        at = [0] * len(rows)
        for k, quota in enumerate(split(counts, shards, rng)):
            for i, t in enumerate(rows):
                for p, b, cut in lists[i][at[i] : at[i] + int(quota[i])]:
                    draws.append((mix, t.source, p, b, k, cut))
                at[i] += int(quota[i])
    return draws, report


def ends(d: pd.DataFrame) -> pd.DataFrame:
    """The rows of one draw that fill its `cut` as far as can be: in order as long
    as more than EXACT_TOKENS are left, then by subset sums."""
    d = d.sort_values(["_order", "_id"], kind="stable").reset_index(drop=True)
    room, n = int(d["cut"].iloc[0]), d["n_tokens"].to_numpy()
    first = int(np.searchsorted(np.cumsum(n), room - EXACT_TOKENS, side="right")) if room > EXACT_TOKENS else 0
    room -= int(n[:first].sum())
    by: dict[int, list[int]] = {}
    for i in range(first, len(n)):
        by.setdefault(int(n[i]), []).append(i)
    took = fullest(sorted(by), {k: len(v) for k, v in by.items()}, room)
    return d.iloc[[*range(first), *(i for k, m in took for i in by[k][:m])]]


def mixture(sizes: DataFrame, mixes: DataFrame, ident: str, source: str = "source", seed: int = 17, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixed collection (mix_id, shard, position, id, source, pass, n_tokens)
    and the report of targets (mix_id, source, target_share, max_repeats,
    available_tokens, quota_tokens)."""
    spark = sizes.sparkSession
    targets = mixes.select("mix_id", united(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    listed = targets.limit(PLAN_BLOCKS + 1).collect()
    if len(listed) > PLAN_BLOCKS:
        raise ValueError(f"more than {PLAN_BLOCKS} targets")
    wanted = sizes.join(small(targets.select(F.col("source").alias("_s")).distinct()), united(F.col(source)) == F.col("_s"), "left_semi")
    d, sums = blocked(wanted, source, ident, seed)
    draws, report = plan(listed, sums, seed, total_tokens)
    drawn = small(spark.createDataFrame(draws, "mix_id string, source string, pass int, block int, shard int, cut bigint"))
    j = d.select(F.col(ident).alias("_id"), "source", "block", "n_tokens").join(drawn, ["source", "block"])
    cols = ["mix_id", "shard", "_id", "source", "pass", "n_tokens"]
    part = j.filter("cut is not null").select(*cols, "cut", F.xxhash64(F.lit(seed + 1), "_id").alias("_order"))
    part = part.groupBy("mix_id", "source", "pass").applyInPandas(ends, part.schema).select(*cols)
    out = j.filter("cut is null").select(*cols).unionByName(part).withColumnRenamed("_id", ident)
    order = W.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "pass", ident), ident, "pass")
    out = out.withColumn("position", F.row_number().over(order))
    out = out.select("mix_id", "shard", "position", ident, "source", "pass", "n_tokens")
    return out, spark.createDataFrame(report, "mix_id string, source string, target_share double, max_repeats int, available_tokens bigint, quota_tokens bigint")


def shares(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """Targets beside what was reached."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_docs"), (F.max("pass") + 1).alias("most_uses"))
    r = report.join(got, ["mix_id", "source"], "left").fillna(0, ["drawn_tokens", "drawn_docs", "most_uses"])
    total = F.sum("drawn_tokens").over(W.partitionBy("mix_id"))
    return r.withColumn("actual_share", F.when(total > 0, F.col("drawn_tokens") / total).otherwise(F.lit(0.0)))
