"""Clusters of alike reports: components without chains, and their spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import alike, embed
from tidewright.operators.spatial import EARTH_M, located
from tidewright.session import cut

#: Least cosine of a member with the centre of its cluster.
CENTRE_ALIKE = 0.5984


def refined(groups: DataFrame, vectors: DataFrame, least: float = CENTRE_ALIKE, rounds: int = 64) -> DataFrame:
    """(node, cluster) for each row of `groups` (node, component); `vectors` has
    (node, dim, w) of unit vectors.  A cluster is named by its least node.

    Groups of at most two stay.  In larger ones the members alike to the centre
    (the mean of all) become a cluster, and the others are looked at again; if
    none is alike, or after the last round, each is a cluster of its own.
    """
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    g = cut(groups.join(size, "component"), "groups")
    done = [g.filter("n <= 2").select("node", "component", F.lit("0").alias("part"))]
    rest = cut(g.filter("n > 2").select("node", "component"), "rest")
    vectors = cut(vectors.join(rest.select("node"), "node", "left_semi"), "vectors")
    for k in range(1, rounds + 1):
        if rest.isEmpty():
            break
        own = rest.join(vectors, "node")
        centre = own.groupBy("component", "dim").agg(F.sum("w").alias("s"))
        norm = centre.groupBy("component").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
        dots = own.join(centre, ["component", "dim"]).groupBy("component", "node").agg(F.sum(F.col("w") * F.col("s")).alias("dot"))
        m = rest.join(dots, ["component", "node"], "left").join(norm, "component", "left")
        # Vectors that cancel out have no centre: the group stays as it is.
        alike = F.when(F.coalesce("norm", F.lit(0.0)) < 1e-9, True).otherwise(F.round(F.coalesce("dot", F.lit(0.0)) / F.col("norm"), 6) >= least)
        m = cut(m.select("node", "component", alike.alias("keep")), "round")
        n = m.groupBy("component").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("left"))
        m = m.join(n, "component")
        part = F.when(F.col("keep"), f"{k}").when(F.col("kept") == 0, F.concat(F.lit(f"{k}|"), "node")).when(F.col("left") <= 2, f"{k}|")
        m = cut(m.select("node", "component", part.alias("part")), "parts")
        done.append(m.filter("part is not null"))
        rest = m.filter("part is null").select("node", "component")
    done.append(rest.select("node", "component", F.concat(F.lit("|"), "node").alias("part")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = cut(out, "refined")
    name = out.groupBy("component", "part").agg(F.min("node").alias("cluster"))
    return out.join(name, ["component", "part"]).select("node", "cluster")


#: A component of more nodes is split by all tasks together until few are left.
LARGE = 20_000
ROUNDS = 64


def _keyed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held, last = [], None
    for b in batches:
        k = b.column(key).to_pylist()
        starts = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
        for s, e in zip(starts, starts[1:], strict=False):
            if e == s:
                continue
            if held and k[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = k[s]
    if held:
        yield pa.Table.from_batches(held)


def parts_of(x: np.ndarray, names: list[str], least: float, first: int = 1) -> list[str]:
    """The part of each row of the unit vectors `x` (names `names`) of one component, from round `first` on: see `refined`."""
    part, rest = np.full(len(x), "", object), np.arange(len(x))
    if first == 1 and len(x) <= 2:
        return ["0"] * len(x)
    for k in range(first, ROUNDS + 1):
        own = x[rest]
        s = own.sum(0)
        norm = np.sqrt((s * s).sum())
        keep = alike.rounded(own @ s / norm) >= least if norm >= 1e-9 else np.ones(len(rest), bool)
        part[rest[keep]] = f"{k}"
        left = rest[~keep]
        if len(left) == len(rest):
            break
        if len(left) <= 2:
            part[left] = f"{k}|"
            return part.tolist()
        rest = left
    for i in rest:
        part[i] = "|" + names[i]
    return part.tolist()


def _walked(x: np.ndarray, centres: list, least: float) -> np.ndarray:
    """The round in which each row is alike to the centre; 0 if in none."""
    out = np.zeros(len(x), np.int64)
    for k, c in enumerate(centres, 1):
        rest = np.flatnonzero(out == 0)
        out[rest[alike.rounded(x[rest] @ c) >= least]] = k
    return out


def _centres(large: DataFrame, names: list[str], least: float) -> tuple[dict[str, list], dict[str, str]]:
    """(centres, ends) of the components `names` of `large` (component, v, frame).

    A pass over the rows gives what is left of each component and its sum, which
    is one vector from each task.  Ends: `rest` if few are left, which one task
    splits; `one` if they are a part; `each` if each is a part of its own.
    """
    centres, ends, before = {n: [] for n in names}, {}, dict.fromkeys(names, -1)
    while open_ := [n for n in names if n not in ends]:
        now = {n: centres[n] for n in open_}

        def sums(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            count, total = {}, {}
            for b in batches:
                of = np.array(b.column("component").to_pylist(), object)
                for n in set(of.tolist()) & set(now):
                    x = embed.unit(*_columns(b.filter(pa.array(of == n))))
                    x = x[_walked(x, now[n], least) == 0]
                    count[n], total[n] = count.get(n, 0) + len(x), total.get(n, 0.0) + x.sum(0)
            if count:
                yield pa.RecordBatch.from_pydict({"n": list(count), "k": list(count.values()), "s": [v.tolist() for v in total.values()]}, pa.schema([("n", pa.string()), ("k", pa.int64()), ("s", pa.list_(pa.float64()))]))

        got: dict[str, list] = {n: [0, 0.0] for n in open_}
        for r in large.filter(F.col("component").isin(open_)).mapInArrow(sums, "n string, k long, s array<double>").toLocalIterator():
            got[r.n][0] += r.k
            got[r.n][1] = got[r.n][1] + np.array(r.s)
        for n, (k, s) in got.items():
            norm = float(np.sqrt(np.sum(np.square(s))))
            if k <= 2 and before[n] >= 0:
                ends[n] = "one"
            elif k == before[n] or len(centres[n]) == ROUNDS:
                ends[n] = "each"
            elif k <= LARGE:
                ends[n] = "rest"
            elif norm < 1e-9:  # vectors that cancel out have no centre
                ends[n] = "one"
            else:
                centres[n].append(s / norm)
            before[n] = k
    return centres, ends


def _columns(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return embed.unpacked(b.column("v")), np.stack(b.column("frame").to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column("frame").to_numpy())


def split(members: DataFrame, least: float = CENTRE_ALIKE) -> DataFrame:
    """(node, cluster) as of `refined`, of `members` (node, component, v, frame) with the vectors as
    they are packed.  A component is split by one task, after all tasks have taken the parts of a
    large one away round by round."""
    members = cut(members.select("component", "node", "v", "frame"), "members")
    names = [r.component for r in members.groupBy("component").count().filter(F.col("count") > LARGE).select("component").toLocalIterator()]
    large = members.filter(F.col("component").isin(names))
    centres, ends = _centres(large, names, least) if names else ({}, {})
    sent = members.sparkSession.sparkContext.broadcast((centres, ends))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, ends = sent.value
        for b in batches:
            of, nodes = b.column("component").to_pylist(), b.column("node").to_pylist()
            part = np.full(len(of), None, object)
            for n in set(of):
                rows = np.flatnonzero(np.array([x == n for x in of], bool))
                for i, k in zip(rows, _walked(embed.unit(*_columns(b.take(pa.array(rows)))), centres[n], least), strict=True):
                    end = {"rest": None, "one": f"{len(centres[n])}|", "each": "|" + nodes[i]}[ends[n]]
                    part[i] = f"{k}" if k else end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.tolist(), pa.string())], ["component", "node", "v", "frame", "part"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = sent.value
        for t in _keyed(batches, "component"):
            nodes, name = t.column("node").to_pylist(), t.column("component")[0].as_py()
            x = embed.unit(*_columns(t)) if len(nodes) > 2 or name in centres else np.zeros((len(nodes), 1))
            part = parts_of(x, nodes, least, len(centres.get(name, ())) + 1)
            yield pa.RecordBatch.from_pydict({"component": [name] * len(nodes), "node": nodes, "part": part}, pa.schema([(c, pa.string()) for c in ("component", "node", "part")]))

    kind = "component string, node string, part string"
    rest, done = members, None
    if names:
        walked = large.mapInArrow(taken, "component string, node string, v binary, frame array<double>, part string")
        done = walked.filter("part is not null").select("component", "node", "part")
        rest = members.filter(~F.col("component").isin(names)).unionByName(walked.filter("part is null").drop("part"))
    out = rest.repartition("component").sortWithinPartitions("component").mapInArrow(apart, kind)
    out = cut(out.unionByName(done) if done is not None else out, "split")
    name = out.groupBy("component", "part").agg(F.min("node").alias("cluster"))
    return out.join(name, ["component", "part"]).select("node", "cluster")


#: Points of a cluster beyond which those near each other are compared as one first, and cells along its extent.
CROWD, GRID = 1024, 64


def _farthest(p: np.ndarray) -> tuple[int, int]:
    """Two of the points `p` on the unit sphere that are farthest from each other."""
    p = p - p.mean(0)  # small numbers keep their digits

    def most(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
        top = (-1.0, 0, 0)
        for s in range(0, len(a), 1024):
            q = p[a[s : s + 1024]]
            d = (q * q).sum(1)[:, None] + (p[b] * p[b]).sum(1)[None] - 2 * (q @ p[b].T)
            k = int(d.argmax())
            top = max(top, (float(d.flat[k]), int(a[s + k // len(b)]), int(b[k % len(b)])))
        return top

    every = np.arange(len(p))
    if len(p) <= CROWD:
        return most(every, every)[1:]
    cell = np.floor((p - p.min(0)) * (GRID / max(np.ptp(p, axis=0).max(), 1e-300))).astype(np.int64)
    _, of = np.unique(cell @ np.array([1 << 20, 1 << 10, 1]), return_inverse=True)
    order = np.argsort(of, kind="stable")
    cells = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    centre = np.stack([p[c].mean(0) for c in cells])
    r = np.array([np.sqrt(((p[c] - m) ** 2).sum(1).max()) for c, m in zip(cells, centre, strict=True)])
    one = most(every[:1], every)
    best = most(np.array([one[2]]), every)
    # A pair of cells can hold the farthest pair only if its centres are far enough apart.
    for i in range(len(cells)):
        bound = np.sqrt(((centre[i:] - centre[i]) ** 2).sum(1)) + r[i:] + r[i]
        for j in np.flatnonzero(bound >= best[0] ** 0.5 * (1 - 1e-9)):
            best = max(best, most(cells[i], cells[i + j]))
    return best[1:]


def spread(points: DataFrame) -> DataFrame:
    """(cluster, metres): the largest distance between two points of a cluster,
    of `points` (cluster, lat, lon).

    A task looks at one cluster after the other.  Of a large one, only those
    cells of a grid are compared that are far enough apart to hold a farther pair.
    """
    p = located(points).select("cluster", "lat", "lon").distinct()

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, metres = [], []
        for t in _keyed(batches, "cluster"):
            names.append(t.column("cluster")[0].as_py())
            lat, lon = t.column("lat").to_numpy(), t.column("lon").to_numpy()
            if len(lat) > 1:
                y, x = np.radians(lat), np.radians(lon)
                i, j = _farthest(np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1))
                h = np.sin((y[j] - y[i]) / 2) ** 2 + np.cos(y[i]) * np.cos(y[j]) * np.sin((x[j] - x[i]) / 2) ** 2
                metres.append(float(2 * EARTH_M * np.arcsin(min(1.0, np.sqrt(h)))))
            else:
                metres.append(0.0)
            if len(names) == 10_000:
                yield pa.RecordBatch.from_pydict({"cluster": names, "metres": metres})
                names, metres = [], []
        if names:
            yield pa.RecordBatch.from_pydict({"cluster": names, "metres": metres})

    return p.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(widest, "cluster string, metres double")
