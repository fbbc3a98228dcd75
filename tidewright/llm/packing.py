"""Problem 8: filling containers of fixed capacity, by minimum bin slack.

For each container the largest remaining item is taken, and the fullest
combination of the remaining lengths is found exactly by a subset-sum dynamic
programme over bits: bit s of an integer says that s tokens can be filled.
Lengths with their numbers stand for items, so equal lengths cost one step.
Items larger than the capacity are split into full containers and a remainder,
which is packed like an item; nothing else is split.

Items are packed in blocks of bounded size, drawn by a hash of their ids, so
that blocks are packed in parallel; a block loses less than one container to
the others.

Defined cases: items of no tokens (null and empty texts) are not packed; a
capacity of less than 1 packs nothing; more than MAX_SPECS specs are refused.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one block.
BLOCK = 10_000
#: Specs at most; more are refused.
MAX_SPECS = 1000


def fullest(lengths: list[int], count: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The numbers of items of each length that fill `room` as far as can be;
    `lengths` are sorted in increasing order."""
    if room <= 0:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        left, c = min(count[n], room // n), 1
        while left > 0:
            k = min(c, left)
            new = reach | (reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            left -= k
            c *= 2
        if reach >> room & 1:
            break
    s = reach.bit_length() - 1
    take: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> s & 1:
            take[n] = take.get(n, 0) + k
            s -= n * k
    return list(take.items())


def pack(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (item index, first token, tokens) for items (index, tokens)."""
    out: list[list[tuple[int, int, int]]] = []
    by: dict[int, list[tuple[int, int]]] = {}
    for i, n in items:
        start = 0
        while n - start > capacity:
            out.append([(i, start, capacity)])
            start += capacity
        if n > start:
            by.setdefault(n - start, []).append((i, start))
    lengths = sorted(by)
    count = {n: len(v) for n, v in by.items()}
    while lengths:
        seed = lengths[-1]
        count[seed] -= 1
        if not count[seed]:
            lengths.pop()
        chosen = [(seed, 1), *fullest(lengths, count, capacity - seed)]
        box = []
        for k, (n, m) in enumerate(chosen):
            for _ in range(m):
                i, start = by[n].pop()
                box.append((i, start, n))
            if k:
                count[n] -= m
                if not count[n]:
                    lengths.pop(bisect_right(lengths, n) - 1)
        out.append(box)
    return out


def packed(sizes: DataFrame, specs: DataFrame, ident: str, block: int = BLOCK) -> DataFrame:
    """(spec_id, container_id, id, piece, start_token, n_tokens) for all specs."""
    n = sizes.filter("n_tokens > 0").count()
    blocks = max(1, -(-n // block))
    kind = dict(sizes.dtypes)[ident]
    s = sizes.filter("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64(ident), F.lit(blocks)))
    # Specs are a small fixed table; each item is packed once for each of them.
    rows = [(r.spec_id, r.capacity_tokens) for r in specs.filter("capacity_tokens > 0").distinct().orderBy("spec_id").limit(MAX_SPECS + 1).collect()]
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    if not rows:
        rows = [("", 0)]
        s = s.limit(0)
    spec = F.explode(F.array(*[F.struct(F.lit(a).alias("spec_id"), F.lit(int(c)).alias("capacity")) for a, c in rows]))
    s = s.select(F.col(ident).alias("id"), "n_tokens", "block", spec.alias("s")).select("id", "n_tokens", "block", "s.spec_id", "s.capacity")

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["n_tokens", "id"], kind="stable").reset_index(drop=True)
        boxes = pack(list(enumerate(d.n_tokens.tolist())), int(key[2]))
        base = int(key[1]) << 32
        rows = [(base + b, i, start, m) for b, box in enumerate(boxes) for i, start, m in box]
        out = pd.DataFrame(rows, columns=["container_id", "i", "start_token", "n_tokens"])
        ids = d["id"].to_numpy()[out["i"].to_numpy(dtype=int)] if len(out) else []
        return pd.DataFrame({
            "spec_id": key[0], "container_id": out.container_id, "id": ids, "piece": (out.start_token // max(1, int(key[2]))).astype("int32"),
            "start_token": out.start_token, "n_tokens": out.n_tokens,
        })

    schema = f"spec_id string, container_id bigint, id {kind}, piece int, start_token bigint, n_tokens bigint"
    return s.groupBy("spec_id", "block", "capacity").applyInPandas(run, schema).withColumnRenamed("id", ident)
