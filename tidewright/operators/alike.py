"""Pairs of reports that pass the gate and read alike, without a row for each pair that only passes the gate.

Reports meet in cells of space, time and need.  Each is owned by one cell and is
a guest of those reached cells that come later in order, so that each pair of
places is compared in exactly one cell.  A task compares a cell in blocks: the
rows of one kind of place are halved until few are left, their partners are
those of each other kind within the box that its radius reaches, and one product
of matrices gives the cosines of a block.  Pairs near the bar or above it are
then tested exactly: the gate as in `graph.gated` and `graph.barred`, the cosine
as in `embed.similar`, from whole numbers and in the same order of operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import embed, graph
from tidewright.operators.spatial import EARTH_M, located

#: Cells are this many times the largest radius wide, and the window of time long.
SIDE, SLOTS = 3, 3
#: Rows of a block, and rows of pairs that are sent together.
LEAF, SENT = 128, 1 << 16
WINDOW_US = graph.MINUTES * 60_000_000
KINDS = sorted(graph.UNCERTAIN.values())
#: What a product in single precision may lack.
SLACK = 1e-4

PLACES = "places array<struct<lat:double,lon:double,u:double>>"


def _reach(u: float) -> float:
    """The largest radius of a pair with a place of uncertainty `u`."""
    return max([r for v in KINDS if (r := graph.BASE_M + u + v) <= graph.MOST_M], default=0.0)


def uncertainty(resolution: Column) -> Column:
    u = F.lit(None).cast("double")
    for k, v in graph.UNCERTAIN.items():
        u = F.when(resolution == k, v).otherwise(u)
    return u


def placed(items: DataFrame, locations: DataFrame) -> DataFrame:
    """`items` with the distinct usable places of each: one row for each message, `places` in order."""
    loc = located(locations).select("message_id", "lat", "lon", uncertainty(F.col("resolution")).alias("u")).filter("u is not null")
    loc = loc.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct("lat", "lon", "u"))).alias("places"))
    return items.join(loc, "message_id")


def _cells(items: DataFrame) -> DataFrame:
    """A row of each place for its own cell and for each later cell that it reaches."""
    side = SIDE * graph.MOST_M * 1.001 / EARTH_M
    d = items.filter("us is not null and need_type is not null").select("*", F.posexplode("places").alias("at", "p")).withColumns({"lat": F.col("p.lat"), "lon": F.col("p.lon"), "u": F.col("p.u")}).drop("p")
    d = d.withColumn("places", F.when(F.size("places") > 1, F.col("places")))
    reach = F.lit(0.0)
    for v in KINDS:
        reach = F.when(F.col("u") == v, _reach(v) * 1.001 / EARTH_M).otherwise(reach)
    y, x = F.radians("lat"), F.radians("lon")
    axes = {"cx": F.cos(y) * F.cos(x), "cy": F.cos(y) * F.sin(x), "cz": F.sin(y)}
    own, keys = [], [*axes, "slot"]
    for c, v in axes.items():
        step = reach * F.sqrt(F.greatest(F.lit(0.0), 1 - v * v)) + reach * reach
        own.append(F.floor(v / side).alias(c))
        d = d.withColumn(c, F.explode(F.sequence(F.floor((v - step) / side), F.floor((v + step) / side))))
    slot = lambda t: F.floor(t / F.lit(SLOTS * WINDOW_US))
    own.append(slot(F.col("us")).alias("slot"))
    d = d.withColumn("slot", F.explode(F.sequence(slot(F.col("us") - WINDOW_US), slot(F.col("us") + WINDOW_US))))
    d = d.withColumn("own", F.struct(*own)).withColumn("cell", F.struct(*keys)).filter("cell >= own")
    return d.select("need_type", *keys, (F.col("cell") != F.col("own")).alias("guest"), "message_id", "us", "people", "sure", "frame", "v", "lat", "lon", "u", "at", "places")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches that are sorted by cell."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(k).to_pylist() for k in ("need_type", "cx", "cy", "cz", "slot")), strict=True))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for s, e in zip(starts, starts[1:], strict=False):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places as Spark does: half up, told from the shortest decimal."""
    y = x * 1e6
    out = np.rint(y) / 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _metres(lat: np.ndarray, lon: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat[i]), np.radians(lat[j])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _halved(rows: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """`rows` in parts of at most LEAF, halved along the axis in which they are widest."""
    out, todo = [], [rows]
    while todo:
        r = todo.pop()
        if len(r) <= LEAF:
            out += [r] if len(r) else []
            continue
        own = x[r]
        k = int(np.argmax(own.max(0) - own.min(0)))
        o, m = np.argpartition(own[:, k], len(r) // 2), len(r) // 2
        todo += [r[o[m:]], r[o[:m]]]
    return out


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x and y; `label` has the least member of each one's set."""
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label[:] = label[label]


class _Cell:
    """The rows of one cell, and the pairs among them."""

    def __init__(self, t: pa.Table, coarse: bool) -> None:
        self.coarse, col = coarse, lambda c: t.column(c).to_numpy()
        self.own = np.flatnonzero(~col("guest").astype(bool))
        self.guests = np.flatnonzero(col("guest").astype(bool))
        ids = t.column("message_id").combine_chunks().dictionary_encode()
        names = ids.dictionary.to_numpy(zero_copy_only=False)
        order = sorted(range(len(names)), key=lambda k: names[k].encode())
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        self.code, self.names = rank[ids.indices.to_numpy()], pa.array(names[order], pa.string())
        self.lat, self.lon, self.u, self.us, self.at = col("lat"), col("lon"), col("u"), col("us"), col("at")
        y, x = np.radians(self.lat), np.radians(self.lon)
        self.xyz = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)
        self.people = t.column("people").to_numpy().astype(float)  # none: nan
        self.sure = t.column("sure").fill_null(True).to_numpy().astype(bool)
        self.places = dict(self._several(t.column("places")))
        self.several = np.zeros(len(t), bool)
        self.several[list(self.places)] = True
        self.v = embed.unpacked(t.column("v"))
        self.frame = np.stack(t.column("frame").to_numpy())
        square = np.zeros(len(t))
        for s in range(0, len(t), 4096):
            square[s : s + 4096] = (self.v[s : s + 4096].astype(np.float64) ** 2).sum(1)
        self.norm = np.sqrt(square)
        self.exact = np.float32 if square.max(initial=0) < 1 << 24 else np.float64
        w = embed.weights()
        scale = np.divide(w[0] ** 0.5, self.norm, out=np.zeros(len(t)), where=self.norm > 0)
        self.joint = np.empty((len(t), self.v.shape[1] + self.frame.shape[1]), np.float32)
        np.multiply(self.v, scale[:, None], out=self.joint[:, : self.v.shape[1]], casting="unsafe")
        self.joint[:, self.v.shape[1] :] = self.frame * w[1] ** 0.5
        self.joint /= (w[0] + w[1]) ** 0.5

    @staticmethod
    def _several(c: pa.ChunkedArray) -> Iterator[tuple[int, list]]:
        for i in np.flatnonzero(c.is_valid().to_numpy()):
            yield int(i), [(p["lat"], p["lon"], p["u"]) for p in c[int(i)].as_py()]

    def pairs(self, least: float, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, cosines) of the pairs, block by block; with `label`, only of messages that it has in two sets."""
        reach = max(map(_reach, KINDS)) * 1.001 / EARTH_M
        box = np.column_stack([self.xyz / reach, (self.us - self.us.min()) / WINDOW_US])
        for u in KINDS:
            parts = _halved(self.own[self.u[self.own] == u], box)
            for v in (k for k in KINDS if graph.BASE_M + u + k <= graph.MOST_M):
                radius = graph.BASE_M + u + v
                near = not self.coarse or radius <= graph.PRECISE_M
                bar = least if near else graph.COARSE_ALIKE
                r = np.array([radius * 1.001 / EARTH_M / reach] * 3 + [1.0 + 1e-9])
                guests = self.guests[self.u[self.guests] == v]
                # Own rows of an earlier kind have met this one already, and so have earlier parts of this kind.
                after = np.concatenate(parts) if v == u and parts else self.own[self.u[self.own] == v] if v > u else self.own[:0]
                done = 0
                for part in parts:
                    inside = after[done:] if v == u else after
                    done += len(part)
                    lo, hi = box[part].min(0) - r, box[part].max(0) + r
                    those = np.concatenate([inside, guests])
                    if label is not None and (label[self.code[part]] == label[self.code[part[0]]]).all():
                        those = those[label[self.code[those]] != label[self.code[part[0]]]]
                    b = box[those]
                    those = those[((b >= lo) & (b <= hi)).all(1)]
                    for s in range(0, len(those), 8192):
                        some = those[s : s + 8192]
                        i, j = np.nonzero(self.joint[part] @ self.joint[some].T >= bar - SLACK)
                        i, j = part[i], some[j]
                        if v == u:
                            place = np.full(len(self.code), len(self.code))
                            place[part] = np.arange(len(part))
                            keep = place[i] < place[j]
                            i, j = i[keep], j[keep]
                        if label is not None:
                            keep = label[self.code[i]] != label[self.code[j]]
                            i, j = i[keep], j[keep]
                        i, j, c = self._tested(i, j, radius, near, bar)
                        if label is None:
                            i, j, c = self._once(i, j, c)
                        if len(i):
                            yield i, j, c

    def _tested(self, i: np.ndarray, j: np.ndarray, radius: float, near: bool, bar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = (self.code[i] != self.code[j]) & (np.abs(self.us[i] - self.us[j]) <= WINDOW_US)
        i, j = i[keep], j[keep]
        lo, hi = np.fmin(self.people[i], self.people[j]), np.fmax(self.people[i], self.people[j])
        keep = ~(self.sure[i] & self.sure[j] & ~(lo <= 0)) | (hi <= graph.RATIO * lo)
        if not near:
            keep &= ~(lo > 0) | (hi <= graph.COARSE_RATIO * lo)
        i, j = i[keep], j[keep]
        keep = _metres(self.lat, self.lon, i, j) <= radius
        i, j = i[keep], j[keep]
        c = np.empty(len(i))
        for s in range(0, len(i), 4096):
            c[s : s + 4096] = self._cosine(i[s : s + 4096], j[s : s + 4096])
        c = rounded(c)
        keep = c >= bar
        return i[keep], j[keep], c[keep]

    def _cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dot = np.einsum("ij,ij->i", self.v[i].astype(self.exact), self.v[j].astype(self.exact)).astype(float)
        norm = self.norm[i] * self.norm[j]
        lex = np.divide(dot, norm, out=np.zeros(len(i)), where=norm > 0)
        sem = np.zeros(len(i))
        p, q = self.frame[i], self.frame[j]
        for k in range(p.shape[1]):
            sem += p[:, k] * q[:, k]
        a, b = embed.weights()
        return (a * lex + b * sem) / (a + b)

    def _once(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of two messages of which one has several places, the pair of places with the lowest bar, the first of these, stands for all."""
        keep = np.ones(len(i), bool)
        for n in np.flatnonzero(self.several[i] | self.several[j]):
            x, y = (i[n], j[n]) if self.code[i[n]] < self.code[j[n]] else (j[n], i[n])
            best = []
            for k, (la, lo, u) in enumerate(self.places.get(x, [(self.lat[x], self.lon[x], self.u[x])])):
                for m, (lb, lc, w) in enumerate(self.places.get(y, [(self.lat[y], self.lon[y], self.u[y])])):
                    radius = graph.BASE_M + u + w
                    if radius <= graph.MOST_M and self._meet(la, lo, lb, lc) <= radius and (bar := self._bar(x, y, radius)):
                        best.append((bar, k, m))
            at = tuple(int(self.at[z]) if z in self.places else 0 for z in (x, y))
            keep[n] = min(best)[1:] == at
        return i[keep], j[keep], c[keep]

    def _bar(self, x: int, y: int, radius: float) -> float:
        if not self.coarse or radius <= graph.PRECISE_M:
            return graph.ALIKE
        lo, hi = np.fmin(self.people[x], self.people[y]), np.fmax(self.people[x], self.people[y])
        return graph.COARSE_ALIKE if not lo > 0 or hi <= graph.COARSE_RATIO * lo else 0.0

    @staticmethod
    def _meet(*p: float) -> float:
        a = np.array(p)
        return float(_metres(a[[0, 2]], a[[1, 3]], np.array([0]), np.array([1]))[0])


def _sorted(items: DataFrame) -> DataFrame:
    keys = ["need_type", "cx", "cy", "cz", "slot"]
    spark = items.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return _cells(items).repartition(n, *keys).sortWithinPartitions(*keys)


def pairs(items: DataFrame, least: float, coarse: bool = False) -> DataFrame:
    """(a, b, cosine) of the pairs of `items` (message_id, us, need_type, people,
    sure, frame, v, places) that pass the gate with a rounded cosine of `least`
    or more.  `coarse` asks for what `graph.barred` asks for beyond PRECISE_M."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cell, held, n = _Cell(t, coarse), [], 0

            def out(cell: _Cell = cell, held: list = held) -> pa.RecordBatch:
                i, j, c = (np.concatenate(x) for x in zip(*held, strict=True))
                p, q = cell.code[i], cell.code[j]
                return pa.RecordBatch.from_arrays([cell.names.take(pa.array(np.minimum(p, q))), cell.names.take(pa.array(np.maximum(p, q))), pa.array(c)], ["a", "b", "cosine"])

            for x in cell.pairs(least):
                held.append(x)
                n += len(x[0])
                if n >= SENT:
                    yield out()
                    held.clear()
                    n = 0
            if held:
                yield out()

    return _sorted(items).mapInArrow(compared, "a string, b string, cosine double")


def joined(items: DataFrame, least: float, coarse: bool = False) -> DataFrame:
    """(a, b): links of messages that connect the same messages as `pairs` do, of each cell at most one for each message."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cell = _Cell(t, coarse)
            label = np.arange(len(cell.names))
            for i, j, _ in cell.pairs(least, label):
                unite(label, cell.code[i], cell.code[j])
            rest = np.flatnonzero(label != np.arange(len(label)))
            if len(rest):
                yield pa.RecordBatch.from_arrays([cell.names.take(pa.array(label[rest])), cell.names.take(pa.array(rest))], ["a", "b"])

    return _sorted(items).mapInArrow(compared, "a string, b string")
