"""Queries on locations, places and zones (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import spatial
from tidewright.sources.tables import table

NEAR_M = 250.0


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Places whose radius a location lies in, and zones that contain it though its cell says otherwise."""
    loc = spatial.located(table(spark, root, "message_locations").select("message_id", "lat", "lon", "h3_cell").filter("message_id is not null"))
    near = spatial.near_places(loc.select("message_id", "lat", "lon"), table(spark, root, "gazetteer"))
    a = near.select("message_id", F.lit("place").alias("target_kind"), F.col("place").alias("target_id"))
    inside = spatial.regions_of(loc, table(spark, root, "zones"))
    b = loc.join(inside, ["lat", "lon"]).filter(~F.col("h3_cell").eqNullSafe(F.col("region")))
    b = b.select("message_id", F.lit("cell").alias("target_kind"), F.col("region").alias("target_id"))
    return a.unionByName(b).distinct()


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """For each location whose message number is divisible by 50: how many other locations lie within 250 m of it; `p4_neighbour_points` tells which."""
    loc = table(spark, root, "message_locations").select("message_id", "lat", "lon").distinct()
    number = F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint")
    out = spatial.near_counts(loc, loc.filter(number % 50 == 0), NEAR_M, "message_id")
    return out.select("message_id", (F.col("n_near") - 1).alias("n_near"))


def p4_neighbour_points(spark: SparkSession, root: str) -> DataFrame:
    """For each location whose message number is divisible by 50: the points within 250 m of it that hold locations, its own included; `p4_point_members` has the ids at each point."""
    loc = table(spark, root, "message_locations").select("message_id", "lat", "lon").distinct()
    number = F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint")
    out = spatial.near_points(loc, loc.filter(number % 50 == 0), NEAR_M, "message_id")
    return out.withColumn("metres", F.round("metres", 3))


def p4_point_members(spark: SparkSession, root: str) -> DataFrame:
    """Each location's id with the point at which it lies."""
    return spatial.located(table(spark, root, "message_locations").select("message_id", "lat", "lon")).filter("message_id is not null").distinct()


_HAV = "2*6371000*asin(least(1.0, sqrt(power(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*power(sin(radians({b}.lon-{a}.lon)/2),2))))"

SQL = {
    "p4_found": f"""
with l as (select distinct message_id, lat, lon, h3_cell from message_locations where lat is not null and lon is not null and message_id is not null),
e as (select z.h3_cell, z.boundary[k].lat y1, z.boundary[k].lon x1, z.boundary[k+1].lat y2, z.boundary[k+1].lon x2,
      list_min(list_transform(z.boundary, lambda p: p.lon)) xa, list_max(list_transform(z.boundary, lambda p: p.lon)) xb
      from zones z, unnest(range(1, len(z.boundary))) t(k)),
c as (select l.message_id, l.lat, l.lon, l.h3_cell, e.h3_cell zone, count(*) n from l join e
      on ((e.y1 <= l.lat) <> (e.y2 <= l.lat)) and l.lon >= e.xa and l.lon <= e.xb and e.x1 + (l.lat-e.y1)/(e.y2-e.y1)*(e.x2-e.x1) > l.lon
      group by all)
select distinct l.message_id, 'place' as target_kind, g.name as target_id from l join gazetteer g
  on g.radius_m is not null and abs(g.lat-l.lat) < 0.01 and {_HAV.format(a="l", b="g")} <= g.radius_m
union
select message_id, 'cell', zone from c where n % 2 = 1 and h3_cell is distinct from zone""",
    "p4_neighbour_points": f"""
with l as (select distinct message_id, lat, lon from message_locations where lat is not null and lon is not null),
q as (select distinct message_id, lat, lon from l where cast(regexp_extract(message_id, '(\\d+)$', 1) as bigint) % 50 = 0),
p as (select distinct lat, lon from l)
select q.message_id as message_id, q.lat as qlat, q.lon as qlon, p.lat as lat, p.lon as lon, round({_HAV.format(a="q", b="p")}, 3) as metres from q join p on abs(q.lat-p.lat) < 0.01 and {_HAV.format(a="q", b="p")} <= 250.0""",
    "p4_point_members": "select distinct message_id, lat, lon from message_locations where lat is not null and lon is not null and message_id is not null",
    "p4_neighbours": f"""
with l as (select distinct message_id, lat, lon from message_locations where lat is not null and lon is not null),
q as (select distinct message_id, lat, lon from l where cast(regexp_extract(message_id, '(\\d+)$', 1) as bigint) % 50 = 0)
select q.message_id as message_id, count(*) - 1 as n_near from q join l on abs(q.lat-l.lat) < 0.01 and {_HAV.format(a="q", b="l")} <= 250.0
group by q.message_id, q.lat, q.lon""",
}

QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_neighbour_points": p4_neighbour_points, "p4_point_members": p4_point_members}
