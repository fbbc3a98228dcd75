"""Graphs of places, shortest paths, and the gate for pairs of reports."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.spatial import EARTH_M, haversine_m, located
from tidewright.session import BROADCAST_ROWS, cut

ROAD_KMH, BOAT_KMH = 40.0, 9.0


def zone_edges(zones: DataFrame) -> DataFrame:
    """(u, v, length_m) in both directions between zones that share a side."""
    k = F.explode(F.sequence(F.lit(1), F.size("boundary") - 1)).alias("k")
    s = zones.select("h3_cell", "centre_lat", "centre_lon", "boundary", k)
    corner = lambda i: F.struct(F.round(F.element_at("boundary", i)["lat"], 6).alias("y"), F.round(F.element_at("boundary", i)["lon"], 6).alias("x"))
    a, b = corner(F.col("k")), corner(F.col("k") + 1)
    s = s.select("h3_cell", "centre_lat", "centre_lon", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    r = s.select(F.col("h3_cell").alias("v"), F.col("centre_lat").alias("vlat"), F.col("centre_lon").alias("vlon"), "p", "q")
    j = s.join(r, ["p", "q"]).filter("h3_cell <> v")
    return j.select(F.col("h3_cell").alias("u"), "v", F.round(haversine_m(F.col("centre_lat"), F.col("centre_lon"), F.col("vlat"), F.col("vlon")), 3).alias("length_m")).distinct()


def costed(edges: DataFrame) -> DataFrame:
    """Edges with the seconds that they take by road and by boat."""
    s = lambda kmh: F.round(F.col("length_m") / (kmh / 3.6), 3)
    return edges.select("u", "v", "length_m", s(ROAD_KMH).alias("road_s"), s(BOAT_KMH).alias("boat_s"))


def shortest(edges: DataFrame, sources: DataFrame, limit: float, per_source: bool = False, rounds: int = 500) -> DataFrame:
    """([source,] node, dist) of all nodes within `limit`, by relaxing a frontier:
    each round extends only the nodes whose distance fell in the round before,
    and keeps the least distance by an aggregate."""
    keys = ["source", "node"] if per_source else ["node"]
    e = cut(edges.select(F.col("u").alias("node"), "v", "w"), "edges")
    start = sources.select(*([F.col("node").alias("source")] if per_source else []), "node", F.lit(0.0).alias("dist"))
    best = cut(start.withColumn("fresh", F.lit(True)), "dist")
    for _ in range(rounds):
        step = best.filter("fresh").join(e, "node").select(*(["source"] if per_source else []), F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        step = step.filter(F.col("dist") <= limit)
        both = best.select(*keys, "dist", F.lit(0).alias("new")).unionByName(step.select(*keys, "dist", F.lit(1).alias("new")))
        # An old distance wins a tie, so that nothing is extended twice.
        least = both.groupBy(*keys).agg(F.min(F.struct("dist", "new")).alias("b"))
        best = cut(least.select(*keys, "b.dist", (F.col("b.new") == 1).alias("fresh")), "dist")
        if best.filter("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"distances did not settle in {rounds} rounds")
    return best.drop("fresh")


def nearest(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, dist, source, label) of the nearest of `sources` (node, label) for
    each node that one reaches; the least source, then label, wins a tie.

    Distances are whole thousandths of the weights, so that ties are exact; each
    node keeps one distance, however many sources there are.
    """
    e = cut(edges.groupBy(F.col("u").alias("node"), "v").agg(F.round(F.min("w") * 1000).cast("bigint").alias("w")), "edges")
    start = sources.filter("node is not null").groupBy("node").agg(F.min("label").alias("label"))
    best = cut(start.select("node", F.lit(0).cast("bigint").alias("dist"), F.col("node").alias("source"), "label", F.lit(True).alias("fresh")), "dist")
    cols = ["node", "dist", "source", "label"]
    for _ in range(rounds):
        step = best.filter("fresh").join(e, "node").select(F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "source", "label")
        both = best.select(*cols, F.lit(0).alias("new")).unionByName(step.select(*cols, F.lit(1).alias("new")))
        least = both.groupBy("node").agg(F.min(F.struct("dist", "source", "label", "new")).alias("b"))
        best = cut(least.select("node", "b.dist", "b.source", "b.label", (F.col("b.new") == 1).alias("fresh")), "dist")
        if best.filter("fresh").isEmpty():
            return best.select("node", (F.col("dist") / 1000.0).alias("dist"), "source", "label")
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def travel(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """(source, node, dist) of all nodes within `limit` of each of `sources` (node).

    A graph of at most BROADCAST_ROWS edges goes to every task, which walks it
    from one source after the other; a larger one is relaxed by `shortest`.
    """
    e = edges.groupBy("u", "v").agg(F.min("w").alias("w"))
    spark, s = edges.sparkSession, sources.select("node").distinct()
    rows = e.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return shortest(e, s, limit, per_source=True, rounds=10_000)
    out: dict[str, list[tuple[str, float]]] = {}
    for u, v, w in rows:
        out.setdefault(u, []).append((v, w))
    sent = spark.sparkContext.broadcast(out)

    def walk(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for start in batch.column("node").to_pylist():
                dist, heap = {}, [(0.0, start)]
                while heap:
                    d, n = heapq.heappop(heap)
                    if n not in dist:
                        dist[n] = d
                        for v, w in sent.value.get(n, ()):
                            if v not in dist and d + w <= limit:
                                heapq.heappush(heap, (d + w, v))
                yield pa.RecordBatch.from_pydict({"source": [start] * len(dist), "node": list(dist), "dist": list(dist.values())})

    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return s.filter("node is not null").repartition(parts).mapInArrow(walk, "source string, node string, dist double")


# Metres of uncertainty by resolution.
UNCERTAIN = {"point": 60.0, "building": 180.0, "street": 550.0, "ward": 2600.0}
BASE_M, MOST_M, MINUTES, RATIO = 180.0, 3000.0, 90, 1.6
# Beyond PRECISE_M of joint uncertainty, texts and headcounts must agree more closely.
PRECISE_M, ALIKE, COARSE_ALIKE, COARSE_RATIO = 1400.0, 0.68, 0.86, 1.35


def _met(items: DataFrame) -> DataFrame:
    """(a, b, radius, ...) for each pair of rows that meets in time, place, need
    and headcount: see `gated`.

    Cells lie in space, on the unit sphere: two points are as far apart there as
    on the ground at every latitude and across the date line.  One side registers
    in its own cell, the other in all cells that its largest radius reaches, and
    likewise for slots of time, so no pair is lost and none is compared twice.
    """
    chord = MOST_M * 1.001 / EARTH_M
    u = F.lit(None).cast("double")
    for k, v in UNCERTAIN.items():
        u = F.when(F.col("resolution") == k, v).otherwise(u)
    d = located(items).withColumn("u", u).filter("u is not null and us is not null")
    y, x = F.radians("lat"), F.radians("lon")
    axes = {"cx": F.cos(y) * F.cos(x), "cy": F.cos(y) * F.sin(x), "cz": F.sin(y)}
    cell = lambda c: F.floor(c / F.lit(chord))
    d = d.withColumn("slot", F.floor(F.col("us") / F.lit(MINUTES * 60_000_000)))
    b = d.withColumn("slot", F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])))
    for c, v in axes.items():
        # Along an axis, a step over the ground of length `chord` is at most this long.
        reach = chord * F.sqrt(F.greatest(F.lit(0.0), 1 - v * v)) + chord * chord
        b = b.withColumn(c, F.explode(F.sequence(cell(v - reach), cell(v + reach))))
        d = d.withColumn(c, cell(v))
    keys, cols = [*axes, "slot", "need_type"], ["message_id", "lat", "lon", "us", "people", "sure", "u"]
    p = d.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    q = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = p.join(q, keys).filter(F.col("a_message_id") < F.col("b_message_id"))
    hi, lo = F.greatest("a_people", "b_people"), F.least("a_people", "b_people")
    heads = ~(F.col("a_sure") & F.col("b_sure") & (lo > 0)) | (hi <= F.lit(RATIO) * lo)
    radius = BASE_M + F.col("a_u") + F.col("b_u")
    cheap = (F.abs(F.col("a_us") - F.col("b_us")) <= MINUTES * 60_000_000) & heads & (radius <= MOST_M)
    j = j.filter(cheap).filter(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius)
    return j.select(F.col("a_message_id").alias("a"), F.col("b_message_id").alias("b"), radius.alias("radius"), lo.alias("lo"), hi.alias("hi"))


def gated(items: DataFrame) -> DataFrame:
    """Pairs (a < b) of located items (message_id, lat, lon, us, resolution,
    need_type, people, sure) that pass the gate: at most 90 minutes and the
    joint uncertainty apart, of one need, and of like headcount if both are sure."""
    return _met(items).select("a", "b").distinct()


def barred(items: DataFrame) -> DataFrame:
    """(a, b, bar): pairs that pass the gate and the least cosine that links them.
    A radius of at most 1,400 m asks for .68; a wider one for .86, and for
    headcounts within 1.35 of each other (sure or not) if both are known."""
    near = F.col("radius") <= PRECISE_M
    like = (F.col("lo") <= 0) | (F.col("hi") <= F.lit(COARSE_RATIO) * F.col("lo"))
    m = _met(items).withColumn("bar", F.when(near, ALIKE).when(F.coalesce(like, F.lit(True)), COARSE_ALIKE))
    return m.filter("bar is not null").groupBy("a", "b").agg(F.min("bar").alias("bar"))
