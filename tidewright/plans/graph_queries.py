"""Graph queries: components, shortest paths over neighbouring zones, edge costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import alike, clusters, embed, graph
from tidewright.operators.components import by_shared_keys
from tidewright.operators.spatial import haversine_m
from tidewright.plans import demand_queries
from tidewright.session import cut
from tidewright.sources.tables import table

HOPS = 12
LIMIT_S = 4 * 3600.0
# Assets that verify by telephone, and the seconds that this takes anywhere.
VERIFIERS, VERIFY_S = ("operator", "volunteer"), 180.0


def g2_components(spark: SparkSession, root: str) -> DataFrame:
    """Size of each group of demands that list a common source, by clean ids."""
    c = by_shared_keys(demand_queries.report_links(spark, root), "demand_id", "mid")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("members"))


def g1_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges between zones that share a side, with their length and the seconds by road and boat."""
    return graph.costed(graph.zone_edges(table(spark, root, "zones")))


def g3_hops(spark: SparkSession, root: str) -> DataFrame:
    """Zones within 12 steps of the first zone, with the number of steps; `g3_seconds` has the times from all sources."""
    z = table(spark, root, "zones")
    start = z.agg(F.min("h3_cell").alias("node"))
    edges = graph.zone_edges(z).select("u", "v", F.lit(1.0).alias("w"))
    d = graph.shortest(edges, start, float(HOPS))
    return d.select("node", F.col("dist").cast("int").alias("hops"))


def _assets(spark: SparkSession, root: str) -> DataFrame:
    """(asset_type, node): the zones that assets of each type were sent to.
    Those of VERIFIERS call back and travel nowhere."""
    a = table(spark, root, "served").filter("zone is not null and asset_type is not null").filter(~F.col("asset_type").isin(*VERIFIERS)).select("asset_type", F.col("zone").alias("node")).distinct()
    return a.join(table(spark, root, "zones").select(F.col("h3_cell").alias("node")), "node", "left_semi")


def g3_seconds(spark: SparkSession, root: str) -> DataFrame:
    """Seconds from each source of each asset type to all zones within four hours: boats at the speed on water, others by road."""
    assets = cut(_assets(spark, root), "assets")
    edges = cut(graph.costed(graph.zone_edges(table(spark, root, "zones"))), "costs")
    out = []
    for boat, w in ((True, "boat_s"), (False, "road_s")):
        own = assets.filter((F.col("asset_type") == "boat") == boat)
        d = graph.travel(edges.select("u", "v", F.col(w).alias("w")), own, LIMIT_S)
        out.append(own.withColumnRenamed("node", "source").join(d, "source"))
    return out[0].unionByName(out[1]).select("asset_type", "source", "node", F.round("dist", 3).alias("seconds"))


def g5_nearest_depot(spark: SparkSession, root: str) -> DataFrame:
    """For each zone: type, source and seconds of the nearest asset that travels, and type and seconds of the first of all assets, those that telephone included."""
    assets = cut(_assets(spark, root), "assets")
    edges = cut(graph.costed(graph.zone_edges(table(spark, root, "zones"))), "costs")
    out = []
    for boat, w in ((True, "boat_s"), (False, "road_s")):
        own = assets.filter((F.col("asset_type") == "boat") == boat).select("node", F.col("asset_type").alias("label"))
        out.append(graph.nearest(edges.select("u", "v", F.col(w).alias("w")), own))
    d = out[0].unionByName(out[1]).groupBy("node").agg(F.min(F.struct(F.col("dist").alias("seconds"), "source", F.col("label").alias("asset_type"))).alias("b"))
    calls = table(spark, root, "served").filter(F.col("asset_type").isin(*VERIFIERS)).agg(F.min("asset_type").alias("call"))
    z = table(spark, root, "zones").select(F.col("h3_cell").alias("node")).distinct().join(d, "node", "left").crossJoin(calls)
    called = F.col("call").isNotNull() & (F.coalesce(F.col("b.seconds"), F.lit(float("inf"))) > VERIFY_S)
    first = F.when(called, F.struct(F.col("call").alias("t"), F.lit(VERIFY_S).alias("s"))).otherwise(F.struct(F.col("b.asset_type").alias("t"), F.col("b.seconds").alias("s")))
    return z.select("node", "b.asset_type", "b.source", "b.seconds", first["t"].alias("first_type"), first["s"].alias("first_s"))


def d3_gate_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of messages that may report one happening: near in time and place, of one need, of like headcount."""
    r = demand_queries.message_items(spark, root)
    return graph.gated(r).select("a", "b")


def _vectors(m: DataFrame) -> DataFrame:
    """Of each message of `m` (as `messages_read`): time, need, headcount, frame and text vector."""
    m = m.select("message_id", "us", "need_type", "people", "sure", embed.frame(F.col("need_type"), F.col("flags"), F.col("level"), F.col("people")).alias("frame"), "raw_text")
    return cut(embed.packed(m, "raw_text"), "items")


def _placed_items(spark: SparkSession, root: str) -> DataFrame:
    return alike.placed(_vectors(demand_queries.messages_read(spark, root)), table(spark, root, "message_locations"))


def e3_similar_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that pass the gate and have a cosine of .68 at least, at every radius; `d3_links` has the pairs that count as one happening."""
    return alike.pairs(_placed_items(spark, root), graph.ALIKE)


def d3_links(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that pass the whole gate: beyond a radius of 1,400 m only those with a cosine of .86 and like headcounts."""
    return alike.pairs(_placed_items(spark, root), graph.ALIKE, coarse=True)


def _components(links: DataFrame, name: str) -> DataFrame:
    return by_shared_keys(links.select(F.explode(F.array("a", "b")).alias(name), F.concat_ws("|", "a", "b").alias("k")), name, "k")


def d4_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Components of alike pairs, with their size and the diagonal of their box in metres; `d5_clusters` has the clusters without chains."""
    c = _components(cut(alike.joined(_placed_items(spark, root), graph.ALIKE), "alike"), "message_id")
    loc = table(spark, root, "message_locations").filter("lat is not null and lon is not null").select("message_id", "lat", "lon").distinct()
    g = c.join(loc, "message_id").groupBy("component").agg(
        F.countDistinct("message_id").alias("members"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1")
    )
    return g.select("component", "members", F.round(haversine_m(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1")), 3).alias("box_m"))


def clustered(spark: SparkSession, root: str, messages: DataFrame | None = None) -> DataFrame:
    """(node, cluster) of all messages: links by the whole gate, then clusters without chains.
    `messages` are those of `messages_read`, if they have been read."""
    m = _vectors(demand_queries.messages_read(spark, root) if messages is None else messages)
    links = cut(alike.joined(alike.placed(m, table(spark, root, "message_locations")), graph.ALIKE, coarse=True), "links")
    c = cut(_components(links, "node"), "components")
    n = m.select(F.col("message_id").alias("node"), "v", "frame")
    alone = n.select("node").join(c.select("node"), "node", "left_anti").select("node", F.col("node").alias("cluster"))
    return clusters.split(n.join(c, "node")).unionByName(alone)


def d5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of all messages by the whole gate, without chains and with those that stand alone: size and largest distance between members."""
    of = cut(clustered(spark, root), "clusters")
    loc = table(spark, root, "message_locations").filter(F.col("resolution").isin(list(graph.UNCERTAIN))).select(F.col("message_id").alias("node"), "lat", "lon")
    wide = clusters.spread(of.join(loc, "node"))
    g = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).join(wide, "cluster", "left")
    return g.select("cluster", "members", F.round(F.coalesce("metres", F.lit(0.0)), 3).alias("spread_m"))


_EDGES = """edges as (with s as (select h3_cell, least(a, b) p, greatest(a, b) q from (select h3_cell, {'y': round(boundary[k].lat, 6), 'x': round(boundary[k].lon, 6)} a, {'y': round(boundary[k+1].lat, 6), 'x': round(boundary[k+1].lon, 6)} b from zones, unnest(range(1, len(boundary))) t(k)))
select distinct l.h3_cell u, r.h3_cell v from s l join s r on l.p = r.p and l.q = r.q and l.h3_cell <> r.h3_cell)"""
_LEN = "2*6371000*asin(least(1.0, sqrt(power(sin(radians(b.centre_lat-a.centre_lat)/2),2)+cos(radians(a.centre_lat))*cos(radians(b.centre_lat))*power(sin(radians(b.centre_lon-a.centre_lon)/2),2))))"
_HAV = "2*6371000*asin(least(1.0, sqrt(power(sin(radians(q.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(q.lat))*power(sin(radians(q.lon-p.lon)/2),2))))"

SQL = {
    "g2_components": f"""with recursive l as {demand_queries.LINKS_SQL},
e as (select distinct a.demand_id x, b.demand_id y from (select mid, min(demand_id) demand_id from l group by mid having count(distinct demand_id) > 1) a join l b using (mid)),
f as (select x, y from e union select y, x from e), r as (select x, y from f union select r.x, f.y from r join f on r.y = f.x)
select component, count(*) as members from (select x, min(y) component from (select * from r) group by x) group by component""",
    "g1_edges": f"with {_EDGES} select u, v, round({_LEN}, 3) as length_m, round(round({_LEN}, 3) / (40 / 3.6), 3) as road_s, round(round({_LEN}, 3) / (9 / 3.6), 3) as boat_s from edges join zones a on a.h3_cell = u join zones b on b.h3_cell = v",
    "g3_hops": f"with recursive {_EDGES}, r as (select min(h3_cell) node, 0 hops from zones union select v, hops + 1 from r join edges on u = node where hops < 12) select node, min(hops)::int as hops from r group by node",
    "d3_gate_pairs": demand_queries.GATE_SQL,
    "e3_similar_pairs": demand_queries.ALIKE_SQL,
    "d3_links": f"""with s as ({demand_queries.ALIKE_SQL}), i as ({demand_queries.ITEMS_SQL}),
r as (select s.a, s.b, cosine, 180 + p.u + q.u radius, least(p.people, q.people) lo, greatest(p.people, q.people) hi from s join i p on p.message_id = s.a join i q on q.message_id = s.b
 where 180 + p.u + q.u <= 3000 and {_HAV} <= 180 + p.u + q.u)
select distinct a, b, cosine from r where radius <= 1400 or cosine >= 0.86 and (lo <= 0 or hi <= 1.35::double * lo)""",
    "d4_clusters": f"""with recursive s as ({demand_queries.ALIKE_SQL}), f as (select a x, b y from s union select b, a from s union select a, a from s union select b, b from s),
r as (select x, y from f union select r.x, f.y from r join f on r.y = f.x), c as (select x message_id, min(y) component from (select * from r) group by x),
l as (select distinct message_id, lat, lon from message_locations where lat is not null and lon is not null),
g as (select component, count(distinct message_id) members, min(lat) y0, max(lat) y1, min(lon) x0, max(lon) x1 from c join l using (message_id) group by 1)
select component, members, round(2*6371000*asin(least(1.0, sqrt(power(sin(radians(y1-y0)/2),2)+cos(radians(y0))*cos(radians(y1))*power(sin(radians(x1-x0)/2),2)))), 3) as box_m from g""",
}

QUERIES = {f.__name__: f for f in (g2_components, g1_edges, g3_hops, g3_seconds, g5_nearest_depot, d3_gate_pairs, e3_similar_pairs, d3_links, d4_clusters, d5_clusters)}
