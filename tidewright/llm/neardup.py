"""Problem 5: near-duplicate records, by token-combination prefixes.

Records become sets of words (after problem 1).  Words are ordered by how many
records hold them, rarest first, and fall into classes: single words of class 1
and combinations of k words of class k are indexed.  The prefix of a record is
extended until

    sum over classes (words of class k in the prefix - (k - 1)) >= misses + 1

where `misses` is how many of its words a similar record may lack.  Two sets
with Jaccard similarity of at least t then share a combination of one class,
because fewer matches than k in every class k would mean more misses than may
be.  How many words may be missing depends on both sizes, so each combination
carries the level of the prefix that it came in at, and pairs only meet in
combinations that both their prefixes need.  Records of a combination come with a
parity sketch of their set, ordered by level: two levels add up to no more than the
words in which a pair may differ, and so do the bits of two sketches.  What does
not fit is never a row, as a corpus of fixed vocabulary has candidates that grow
with its square.  Candidates are then verified on the words.

Sizes fall into ranges, each with its own parts of classes (long sets would have a
number of combinations that grows with a power of their length).  A pair meets in
the range of its larger set; a set takes part in the ranges above its own with as
much of its prefix as partners of that size need.

Equal sets are handled once: similarity is computed between distinct sets, and
records join to sets afterwards.  Words and sets are told apart by hashes of 40
and 64 bits.

Defined cases: null texts and texts with fewer words than `min_words` take no
part; repeated rows of a record count once; a similarity equal to t is a match.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.lookalike import lookalike_table, rewriter
from tidewright.operators.components import by_shared_keys
from tidewright.session import cut

#: Slots of the table of word counts that is sent to all tasks: 4 MB, whatever the corpus.
SLOTS = 1 << 20
#: Bytes kept of each word's hash.
WIDTH = 5
#: Records that one combination should hold on average; sets the class borders.
SHARE = 512
#: Hash parts that a class is split into (fewer combinations for a slightly longer prefix), for small sets.
PARTS = {1: 1, 2: 1, 3: 2, 4: 2}
#: Sizes at which ranges begin: RANGE, then STEP times as many words each.
RANGE, STEP = 28, 1.3
STARTS = [round(RANGE * STEP**k) for k in range(70)]
#: Combinations that are compared at once on average, and that a task holds before it hands them on.
CELL, HELD = 1 << 20, 1 << 21
#: Pairs that are compared in one step.
STEP_PAIRS = 1 << 20
M64 = (1 << 64) - 1


def parts_of(r: int) -> dict[int, int]:
    """Hash parts of each class for the sets of range r."""
    if r == 0 or STARTS[r - 1] < 45:
        return PARTS
    p = max(2, STARTS[r - 1] // 24)
    return {1: 1, 2: p, 3: p, 4: p}


def range_of(n: int) -> int:
    return bisect_right(STARTS, n)


def sketch_words(r: int) -> int:
    """Numbers of 64 bits in the sketches of range r."""
    return min(4, -(-STARTS[r] // 96))


def record(r: int) -> np.dtype:
    """A combination of range r that a set has."""
    return np.dtype([("sig", "<u4"), ("level", "<u4"), ("n", "<u4"), ("no", "<u8"), ("bits", "<u8", (sketch_words(r),))])


def loss(r: int = 0) -> int:
    """Words that class borders may cost a prefix at most in range r."""
    return sum(p * (k - 1) for k, p in parts_of(r).items())


def misses(n: int, t: float) -> int:
    """How many of its n words a set may lack in a set of similarity t or more."""
    return n - math.ceil(t * n - 1e-9)


def borders(n: int) -> np.ndarray:
    """Largest counts of the classes 1 to 3 among n records."""
    n = max(n, SHARE)
    return np.array([n * (SHARE / n) ** (1 / k) for k in (1, 2, 3)])


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as WIDTH bytes each."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def word_sets(df: DataFrame, ident: str, text: str, keep: list[str], min_words: int, table: dict[str, str]) -> DataFrame:
    """(id, *keep, uid, n, words) of the records with enough words; `words`
    holds sorted hashes of the distinct words, `uid` stands for the set.  Sets that
    a task has written before may come without words."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    mask = (1 << (8 * WIDTH)) - 1
    schema = ", ".join(["id string", *(f"`{c}` {kinds[c]}" for c in keep), "uid bigint", "n int", "words binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rewriter(table)
        seen: dict[str, int] = {}
        written: set[int] = set()
        for b in batches:
            if len(seen) > 500_000:
                seen.clear()
            if len(written) > 500_000:
                written.clear()
            rows, ns, flat, ends = [], [], [], [0]
            valid = b.column(0).is_valid().to_pylist()
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t or len(t) < 2 * min_words - 1 or not valid[k]:
                    continue
                w = set(f(t).lower().split())
                if len(w) < min_words:
                    continue
                hs = set()
                for x in w:
                    h = seen.get(x)
                    if h is None:
                        h = seen[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & mask
                    hs.add(h)
                flat += sorted(hs)
                ends.append(len(flat))
                rows.append(k)
                ns.append(len(w))
            whole = pack(np.array(flat, np.uint64)) if flat else b""
            words = [whole[WIDTH * x : WIDTH * y] for x, y in zip(ends, ends[1:])]
            uids = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in words]
            for k, u in enumerate(uids):
                if u in written:
                    words[k] = None
                written.add(u)
            part = b.take(pa.array(rows, pa.int64()))
            cols = [part.column(0).cast(pa.string()), *(part.column(i + 2) for i in range(len(keep)))]
            cols += [pa.array(uids, pa.int64()), pa.array(ns, pa.int32()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *keep, "uid", "n", "words"])

    return df.select(F.col(ident), F.col(text), *keep).mapInArrow(run, schema)


def sketches(h: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Of each set, whose words begin at `at`, 64 * q bits: whether a bit's words are odd in number.
    The sketches of two sets differ in no more bits than the sets in words."""
    bit = (h >> np.uint64(3)) % np.uint64(64 * q)
    one = np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), at) for k in range(q)], axis=1)


def word_counts(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How many records hold the words of each hash slot, and how many records there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            n += b.num_rows
            if b.num_rows:
                h = np.concatenate([unpack(x) for x in b.column(0).to_pylist()])
                total += np.bincount(h & np.uint64(SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(at, -1), pa.int64()), "c": pa.array(np.append(total[at], n), pa.int64())})

    got = sets.select("words").mapInArrow(run, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    at = got.slot >= 0
    out[got.slot[at].to_numpy()] = got.c[at].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32), int(got.c[~at].sum())


def combos(g: list[int], part: list[int], cls: list[int], m: int) -> tuple[list[int], list[int]]:
    """Signatures of one set and the level of each: the coverage that the prefix
    had before the word that completes it.  The words, as mixed hashes of less
    than 60 bits, come in global order, with their parts and classes; `m` is the
    number of misses up to which prefixes are wanted."""
    have: dict[int, list[int]] = {}
    cover, out, level = 0, [], []
    for x, p, k in zip(g, part, cls):
        group = have.setdefault(p, [])
        was = len(out)
        if k == 1:
            out.append(x)
        elif k == 2:
            out += [x + y for y in group]
        elif k == 3:
            out += [x + y + z for y, z in combinations(group, 2)]
        else:
            out += [x + sum(c) for c in combinations(group, k - 1)]
        level += [cover] * (len(out) - was)
        group.append(x)
        if len(group) >= k:
            cover += 1
            if cover > m:
                break
    return out, level


def mixed(h: np.ndarray, cls: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Hashes of words in a class and range, of less than 60 bits."""
    x = h + (cls.astype(np.uint64) + r.astype(np.uint64) * np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(5)


def common(na, nb, t: float):  # noqa: ANN001, ANN201
    """Words that sets of these sizes share at least, if their similarity is t or more."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def signatures(sets: DataFrame, counts: np.ndarray, n: int, t: float) -> DataFrame:
    """(cell, r, recs) of distinct sets (no, n, words): combinations as records of
    range r, those that may be equal in one cell.  A rare collision makes a candidate
    that verification drops.  Bytes of one place stand together: most compress to nothing."""
    table = sets.sparkSession.sparkContext.broadcast(counts)
    edge = borders(n)
    buckets = max(1, n * 40 // CELL)

    def packed(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        cells, rs, recs = [], [], []
        for r, got in held.items():
            bucket, rec = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(bucket, kind="stable")
            bucket, rec = bucket[order], rec[order]
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)).tolist()
            for x, y in zip([0, *ends], ends):
                cells.append(r << 32 | int(bucket[x]))
                rs.append(r)
                recs.append(np.ascontiguousarray(rec[x:y].view(np.uint8).reshape(y - x, -1).T).tobytes())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(rs, pa.int32()), pa.array(recs, pa.binary())], names=["cell", "r", "recs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = table.value
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        many = 0
        for b in batches:
            if not b.num_rows:
                continue
            nos, ns, words = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_pylist(), b.column(2).to_pylist()
            # A set as often as it has ranges.
            own = [(i, r) for i, m in enumerate(ns) for r in range(range_of(m), range_of(int(m / t + 1e-9)) + 1)]
            h = unpack(b"".join(words[i] for i, _ in own))
            size = np.array([len(words[i]) // WIDTH for i, _ in own])
            start = np.cumsum(size) - size
            doc, rs = np.repeat(np.arange(len(own)), size), np.array([r for _, r in own])
            df = c[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((h, df, doc))
            g, df, r = h[order], df[order], rs[doc]
            cls = np.searchsorted(edge, df, side="left") + 1
            parts = np.array([[1, *parts_of(x).values()] for x in range(int(r.max()) + 1)], np.uint64)[r, cls]
            part = (g % parts).astype(np.int64) * 8 + cls
            g, part, cls = mixed(g, cls, r).tolist(), part.tolist(), cls.tolist()
            sig, level, count, at = [], [], [], 0
            for (i, x), k in zip(own, size.tolist()):
                # In a range above its own a set only meets larger ones.
                m = misses(ns[i], t) if ns[i] >= STARTS[x - 1] or x == 0 else ns[i] - int(common(np.int64(ns[i]), STARTS[x - 1], t))
                s, lv = combos(g[at : at + k], part[at : at + k], cls[at : at + k], m)
                sig += s
                level += lv
                count.append(len(s))
                at += k
            v = np.array(sig, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            v = (v ^ (v >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            v ^= v >> np.uint64(29)
            bucket, level = ((v >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.array(level, np.uint32)
            which = np.repeat(np.arange(len(own)), count)
            who = np.array([i for i, _ in own])
            size_of = np.array(ns, np.uint32)
            for x in np.unique(rs).tolist():
                of = np.flatnonzero(rs[which] == x)
                # `bits` of the sets that have this range alone.
                here = np.flatnonzero(rs == x)
                flat = np.repeat(start[here] - (np.cumsum(size[here]) - size[here]), size[here]) + np.arange(size[here].sum())
                bits = np.zeros((len(own), sketch_words(x)), np.uint64)
                bits[here] = sketches(h[flat], np.cumsum(size[here]) - size[here], sketch_words(x))
                rec = np.empty(len(of), record(x))
                w = which[of]
                rec["sig"], rec["level"], rec["n"], rec["no"], rec["bits"] = v[of] & np.uint64(0xFFFFFFFF), level[of], size_of[who[w]], nos[who[w]], bits[w]
                held[x].append((bucket[of], rec))
            many += len(sig)
            if many >= HELD:
                yield packed(held)
                many = 0
        if held:
            yield packed(held)

    return sets.select("no", "n", "words").mapInArrow(run, "cell bigint, r int, recs binary")


def meet(rec: np.ndarray, r: int, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x < y) of numbers of sets that share a record of range r which both
    need and whose sketches don't tell them apart."""
    key = rec["sig"].astype(np.uint64) << np.uint64(32) | rec["level"]
    order = np.argsort(key)
    key = key[order]
    level, n, no, bits = (rec[k][order] for k in ("level", "n", "no", "bits"))
    level, n = level.astype(np.int64), n.astype(np.int64)
    # Most words that a set and a partner in this range can differ in.
    most = np.floor((n + np.minimum(np.floor(n / t + 1e-9), STARTS[r] - 1)) * ((1 - t) / (1 + t)) + 1e-6).astype(np.int64)
    room = most - level
    last = np.searchsorted(key, (key >> np.uint64(32) << np.uint64(32)) | np.maximum(room, 0).astype(np.uint64), side="right")
    at = np.arange(len(key))
    many = np.where(room >= level, np.maximum(last - at - 1, 0), 0)
    rows = np.flatnonzero(many)
    sums = np.cumsum(many[rows])
    low, done = (STARTS[r - 1] if r else 0), 0
    while done < len(rows):
        to = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + STEP_PAIRS, side="right")))
        i, k = rows[done:to], many[rows[done:to]]
        done = to
        # A record that very many others share is taken in pieces.
        for piece in range(0, int(k.max()), 4 * STEP_PAIRS) if len(i) == 1 else (0,):
            part = np.minimum(k - piece, 4 * STEP_PAIRS) if len(i) == 1 else k
            x = np.repeat(i, part)
            y = x + 1 + piece + np.arange(len(x)) - np.repeat(np.cumsum(part) - part, part)
            ok = np.flatnonzero(np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most[x])
            x, y = x[ok], y[ok]
            o = common(n[x], n[y], t)
            ok = (level[x] <= n[x] - o) & (level[y] <= n[y] - o) & (np.maximum(n[x], n[y]) >= low) & (no[x] != no[y])
            ok &= np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * o
            x, y = no[x[ok]], no[y[ok]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)


def candidates(cells: DataFrame, t: float) -> DataFrame:
    """(x, y), each once: numbers of sets that meet in a cell."""

    def pairs(r: int, recs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kind = record(r)
        rec = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() for x in recs])
        for x, y in meet(rec, r, t):
            both = np.unique(np.stack([x, y], axis=1).astype(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r, held = -1, 0, []
        for b in batches:
            for cell, q, recs in zip(*(b.column(i).to_pylist() for i in range(3))):
                if cell != now:
                    if held:
                        yield from pairs(r, held)
                    now, r, held = cell, q, []
                held.append(recs)
        if held:
            yield from pairs(r, held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "x bigint, y bigint").distinct()


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """(ua, ub), each once: pairs of the distinct `sets` (no, uid, n, words) of
    similarity t or more, written to the shared folder."""
    counts, n = word_counts(sets)
    pairs = cut(candidates(signatures(sets, counts, n, t), t), "candidates", release=True)
    words = sets.select("no", "uid", "n", "words")
    full = pairs.join(words.select(F.col("no").alias("x"), F.col("uid").alias("ua"), F.col("n").alias("na"), F.col("words").alias("wa")), "x")
    full = full.join(words.select(F.col("no").alias("y"), F.col("uid").alias("ub"), F.col("n").alias("nb"), F.col("words").alias("wb")), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            cols = [b.column(i).to_pylist() for i in range(6)]
            for i, (na, nb, wa, wb) in enumerate(zip(*cols[2:])):
                o = len(np.intersect1d(unpack(wa), unpack(wb), assume_unique=True))
                if o >= t * (na + nb - o) - 1e-9:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select([0, 1])

    found = full.select("ua", "ub", "na", "nb", "wa", "wb").mapInArrow(verify, "ua bigint, ub bigint")
    return cut(found.select(F.least("ua", "ub").alias("ua"), F.greatest("ua", "ub").alias("ub")), "similar", release=True)


def prepared(df: DataFrame, ident: str, text: str, keep: list[str], min_words: int, t: float, table: dict[str, str] | None) -> DataFrame:
    """The word sets of `df`, numbered, written to the shared folder; one row of each set has its words."""
    if math.ceil(t * min_words) < loss() + 1:
        raise ValueError(f"prefixes need min_words with t * min_words of at least {loss() + 1}")
    if any(math.ceil(t * max(min_words, s)) < loss(r) + 1 for r, s in enumerate([0, *STARTS[:-1]]) if r >= range_of(min_words)):
        raise ValueError("prefixes need a larger t")
    table = lookalike_table(df, text) if table is None else table
    sets = word_sets(df, ident, text, keep, min_words, table)
    first = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("words").isNull())) == 1
    return cut(sets.withColumn("words", F.when(first, F.col("words"))).withColumn("no", F.monotonically_increasing_id()), "wordsets", release=True)


def distinct_sets(sets: DataFrame) -> DataFrame:
    return sets.filter("words is not null").select("no", "uid", "n", "words")


def near_pairs(
    df: DataFrame, ident: str = "message_id", text: str = "raw_text", time: str = "received_at", hours: float = 12,
    t: float = 0.8, min_words: int = 20, table: dict[str, str] | None = None,
) -> DataFrame:
    """Pairs (a < b) of records at most `hours` apart whose word sets are alike."""
    d = df.select(F.col(ident), F.col(text), F.expr(f"unix_micros(cast(`{time}` as timestamp))").alias("at"))
    sets = prepared(d, ident, text, ["at"], min_words, t, table)
    sims = similar_sets(distinct_sets(sets), t)
    width = int(hours * 3_600_000_000)
    rows = sets.select("id", "uid", "at").filter("at is not null").distinct()
    # Sets are paired with themselves too where several records hold them.
    same = rows.groupBy("uid").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select(F.col("uid").alias("ua"), F.col("uid").alias("ub"))
    links = sims.unionByName(same)
    slot = F.floor(F.col("at") / width)
    x = rows.select(F.col("uid").alias("ua"), F.col("id").alias("i"), F.col("at").alias("ai"), slot.alias("s"))
    y = rows.select(F.col("uid").alias("ub"), F.col("id").alias("j"), F.col("at").alias("aj"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("s"))
    out = links.join(x, "ua").join(y, ["ub", "s"]).filter((F.col("i") != F.col("j")) & (F.abs(F.col("ai") - F.col("aj")) <= width))
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def near_groups(df: DataFrame, ident: str = "message_id", text: str = "raw_text", t: float = 0.8, min_words: int = 20, table: dict[str, str] | None = None) -> DataFrame:
    """(id, set_id, group_id, n_links): each record with enough words, its set of
    words, the group of sets that are alike directly or through others (named by
    the least set id), and how many other sets its own is alike to.  Copies share
    a set, so a group of any size costs a row for each record."""
    sets = prepared(df.select(ident, text), ident, text, [], min_words, t, table)
    links = similar_sets(distinct_sets(sets), t)
    ends = links.select("ua", "ub").unionByName(links.select(F.col("ub").alias("ua"), F.col("ua").alias("ub")))
    n = ends.groupBy(F.col("ua").alias("uid")).agg(F.count(F.lit(1)).alias("n_links"))
    g = by_shared_keys(ends.select(F.col("ua").alias("node"), F.concat_ws("|", F.least("ua", "ub"), F.greatest("ua", "ub")).alias("key")))
    out = sets.select("id", "uid").distinct().join(n, "uid", "left").join(g.withColumnRenamed("node", "uid"), "uid", "left")
    return out.select(F.col("id").alias(ident), F.col("uid").alias("set_id"), F.coalesce("component", "uid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
