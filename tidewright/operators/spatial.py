"""Problem 4: points near other points, near places, and inside regions.

Regions: polygon edges are binned into latitude strips (and into the longitude
bins of their region's box), candidate points join the edges of their bin, and
ray crossings are grouped by point and region; an odd count means inside.

Boundaries: an edge from (y1, x1) to (y2, x2) is crossed by the ray going east
from (y, x) if exactly one of y1 <= y and y2 <= y holds and the crossing lies
strictly east of x.  A point on a boundary between regions therefore lies in
exactly one of them: the one to its north or east.

Defined cases: points with a null or non-finite coordinate match nothing; open
rings are closed; repeated points count once per id where ids are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import small

EARTH_M = 6_371_000.0
#: Metres in one degree of latitude, rounded down so that bins are never too narrow.
DEGREE_M = 111_194.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def located(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with usable coordinates only."""
    ok = F.lit(True)
    for c in (lat, lon):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) <= 360)
    return points.filter(ok)


def region_edges(regions: DataFrame, region: str = "h3_cell", ring: str = "boundary", strip: float = 0.01, bin_: float = 0.01) -> DataFrame:
    """(strip, bin, region, y1, x1, y2, x2): each edge in each latitude strip
    that it crosses and each longitude bin of its region's box."""
    r = regions.select(F.col(region).alias("region"), F.col(ring).alias("ring")).filter(F.size("ring") > 2)
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    r = r.select("region", closed.alias("ring"))
    lons = F.transform("ring", lambda p: p["lon"])
    r = r.withColumn("b0", F.floor(F.array_min(lons) / bin_)).withColumn("b1", F.floor(F.array_max(lons) / bin_))
    r = r.select("region", "ring", "b0", "b1", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("k"))
    a, b = F.element_at("ring", F.col("k")), F.element_at("ring", F.col("k") + 1)
    e = r.select("region", "b0", "b1", a["lat"].alias("y1"), a["lon"].alias("x1"), b["lat"].alias("y2"), b["lon"].alias("x2")).filter("y1 <> y2")
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip))))
    return e.select(F.explode(F.sequence("b0", "b1")).alias("bin"), "strip", "region", "y1", "x1", "y2", "x2")


def regions_of(points: DataFrame, regions: DataFrame, region: str = "h3_cell", ring: str = "boundary", strip: float = 0.01, bin_: float = 0.01) -> DataFrame:
    """(lat, lon, region) for each distinct point that lies inside a region.

    Crowded spots cost one row, since equal points are united (partially before
    the shuffle).  The edges are broadcast if their counted size allows, and
    joined by shuffle else.
    """
    p = located(points).select("lat", "lon").distinct()
    p = p.withColumn("strip", F.floor(F.col("lat") / strip)).withColumn("bin", F.floor(F.col("lon") / bin_))
    e = small(region_edges(regions, region, ring, strip, bin_))
    j = p.join(e, ["strip", "bin"])
    above = (F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat"))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    j = j.filter(above & (x > F.col("lon")))
    return j.groupBy("lat", "lon", "region").agg(F.count(F.lit(1)).alias("crossings")).filter("crossings % 2 = 1").drop("crossings")


def near_places(points: DataFrame, places: DataFrame, name: str = "name", radius: str = "radius_m") -> DataFrame:
    """`points` joined to the places within whose own radius they lie.

    Places fall into levels by radius, each twice the one before; a level has
    cells of its size on the unit sphere, so that a large place makes no small one
    coarser, and latitude and the date line do not matter.  A place registers in
    the cells that its radius reaches, a point in its own cell of each level.
    """
    ok = F.col(radius).isNotNull() & ~F.isnan(radius) & (F.col(radius) >= 0) & (F.col(radius) < float("inf"))
    g = located(places).filter(ok).select(F.col(name).alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col(radius).cast("double").alias("pr"))
    # Radii beyond half the Earth reach everything at the level of half the Earth.
    g = g.withColumn("level", F.ceil(F.log2(F.greatest(F.lit(1.0), F.least(F.col("pr"), F.lit(4 * EARTH_M))))).cast("int"))
    levels = sorted(r.level for r in g.select("level").distinct().collect())  # 0 to 25
    if not levels:
        return points.limit(0).withColumn("place", F.lit(None).cast("string")).withColumn("metres", F.lit(None).cast("double"))
    chord = F.pow(F.lit(2.0), F.col("level")) * F.lit(1.001 / EARTH_M)
    axes = lambda y, x: {"cx": F.cos(F.radians(y)) * F.cos(F.radians(x)), "cy": F.cos(F.radians(y)) * F.sin(F.radians(x)), "cz": F.sin(F.radians(y))}
    for c, v in axes("plat", "plon").items():
        reach = chord * F.sqrt(F.greatest(F.lit(0.0), 1 - v * v)) + chord * chord
        g = g.withColumn(c, F.explode(F.sequence(F.floor((v - reach) / chord), F.floor((v + reach) / chord))))
    p = located(points).withColumns({f"_{c}": v for c, v in axes("lat", "lon").items()}).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    p = p.withColumns({c: F.floor(F.col(f"_{c}") / chord) for c in ("cx", "cy", "cz")}).drop("_cx", "_cy", "_cz")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return p.join(small(g), ["level", "cx", "cy", "cz"]).withColumn("metres", d).filter("metres <= pr").drop("level", "cx", "cy", "cz", "plat", "plon", "pr")


def near_counts(points: DataFrame, queries: DataFrame, metres: float, ident: str, parts: int = 4) -> DataFrame:
    """For each row of `queries` (id, lat, lon): how many rows of `points` lie
    within `metres` of it; `near_points` tells which.

    Equal points are united with their number.  The plane is cut into cells of
    metres/parts; a cell that lies wholly within reach of a query is counted by
    its total, so that a crowd costs one row, and only the cells on the rim are
    compared point by point.
    """
    pts = located(points).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("m"))
    side = metres / parts / DEGREE_M
    lat_max = pts.agg(F.max(F.abs("lat"))).first()[0]
    if lat_max is None:
        return queries.select(ident).limit(0).withColumn("n_near", F.lit(0).cast("bigint"))
    # Degrees of longitude of one cell are chosen at the widest latitude: cells are never wider than `side`.
    cell = lambda c: F.floor(F.col(c) / side)
    pts = pts.withColumn("gy", cell("lat")).withColumn("gx", cell("lon"))
    cells = pts.groupBy("gy", "gx").agg(F.sum("m").alias("total"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
    reach_y = parts + 1
    q = located(queries).select(F.col(ident).alias("qid"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).distinct()
    spots = q.select("qlat", "qlon").distinct()
    wide = F.ceil(F.lit(parts + 0.01) / F.greatest(F.lit(0.02), F.cos(F.radians(F.least(F.lit(89.0), F.abs("qlat") + F.lit(metres / DEGREE_M)))))) + 1
    s = spots.withColumn("qy", F.floor(F.col("qlat") / side)).withColumn("qx", F.floor(F.col("qlon") / side))
    s = s.withColumn("gy", F.explode(F.sequence(F.col("qy") - reach_y, F.col("qy") + reach_y)))
    s = s.withColumn("gx", F.explode(F.sequence(F.col("qx") - wide, F.col("qx") + wide)))
    j = s.join(cells, ["gy", "gx"])
    # The corner of the cell's box that is farthest from the query, and its nearest point.
    far_y = F.when(F.abs(F.col("y0") - F.col("qlat")) > F.abs(F.col("y1") - F.col("qlat")), F.col("y0")).otherwise(F.col("y1"))
    far_x = F.when(F.abs(F.col("x0") - F.col("qlon")) > F.abs(F.col("x1") - F.col("qlon")), F.col("x0")).otherwise(F.col("x1"))
    near_y = F.greatest(F.col("y0"), F.least(F.col("y1"), F.col("qlat")))
    ql, qn = F.col("qlat"), F.col("qlon")
    # On a box this small the farthest point is a corner, up to the change of a
    # parallel's length over the box: both parallels are tried.
    worst = F.greatest(*[haversine_m(ql, qn, y, far_x) for y in (far_y, F.col("y0"), F.col("y1"))])
    j = j.withColumn("whole", worst <= metres).filter(F.abs(near_y - ql) * DEGREE_M <= metres)
    bulk = j.filter("whole").groupBy("qlat", "qlon").agg(F.sum("total").alias("c"))
    rim = j.filter("not whole").select("qlat", "qlon", "gy", "gx").join(pts, ["gy", "gx"])
    rim = rim.filter(haversine_m(ql, qn, F.col("lat"), F.col("lon")) <= metres).groupBy("qlat", "qlon").agg(F.sum("m").alias("c"))
    total = bulk.unionByName(rim).groupBy("qlat", "qlon").agg(F.sum("c").alias("c"))
    out = q.join(total, ["qlat", "qlon"], "left")
    return out.select(F.col("qid").alias(ident), F.coalesce("c", F.lit(0)).cast("bigint").alias("n_near"))


def near_points(points: DataFrame, queries: DataFrame, metres: float, ident: str) -> DataFrame:
    """(id, qlat, qlon, lat, lon, metres): for each distinct row of `queries`
    (id, lat, lon) the distinct points of `points` within `metres` of it, its own
    spot included.  A crowd on one spot is one point, and queries on one spot are
    compared once.

    Cells lie on the unit sphere, so that latitude and the date line do not matter.
    """
    chord = metres * 1.001 / EARTH_M
    cell = lambda c: F.floor(c / F.lit(chord))
    axes = lambda y, x: {"cx": F.cos(F.radians(y)) * F.cos(F.radians(x)), "cy": F.cos(F.radians(y)) * F.sin(F.radians(x)), "cz": F.sin(F.radians(y))}
    p = located(points).select("lat", "lon").distinct()
    p = p.withColumns({c: cell(v) for c, v in axes("lat", "lon").items()})
    q = located(queries).select(F.col(ident), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).distinct()
    s = q.select("qlat", "qlon").distinct()
    for c, v in axes("qlat", "qlon").items():
        reach = chord * F.sqrt(F.greatest(F.lit(0.0), 1 - v * v)) + chord * chord
        s = s.withColumn(c, F.explode(F.sequence(cell(v - reach), cell(v + reach))))
    d = haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    near = s.join(p, ["cx", "cy", "cz"]).withColumn("metres", d).filter(F.col("metres") <= metres).drop("cx", "cy", "cz")
    return q.join(near, ["qlat", "qlon"]).select(ident, "qlat", "qlon", "lat", "lon", "metres")
