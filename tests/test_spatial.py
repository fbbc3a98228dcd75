"""Spatial operators against brute force, and their edge cases."""

import math
import random

from tidewright.operators import spatial
from tidewright.operators.components import by_shared_keys


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * spatial.EARTH_M * math.asin(min(1, math.sqrt(h)))


def squares(spark, n=4, side=0.01):
    rows = []
    for i in range(n):
        for j in range(n):
            y, x = i * side, j * side
            ring = [(y, x), (y, x + side), (y + side, x + side), (y + side, x), (y, x)]
            rows.append((f"z{i}{j}", ring))
    return spark.createDataFrame(rows, "h3_cell string, boundary array<struct<lat:double,lon:double>>")


def test_regions(spark):
    r = random.Random(1)
    pts = [(r.uniform(-0.01, 0.05), r.uniform(-0.01, 0.05)) for _ in range(300)]
    df = spark.createDataFrame(pts + [(None, 0.0), (float("nan"), 0.0)], "lat double, lon double")
    got = {(x.lat, x.lon): x.region for x in spatial.regions_of(df, squares(spark)).collect()}
    want = {(a, b): f"z{int(a / 0.01)}{int(b / 0.01)}" for a, b in pts if 0 <= a < 0.04 and 0 <= b < 0.04}
    assert got == want


def test_boundary_points_lie_in_one_region(spark):
    df = spark.createDataFrame([(0.005, 0.01), (0.01, 0.005), (0.01, 0.01)], "lat double, lon double")
    got = spatial.regions_of(df, squares(spark)).collect()
    assert len(got) == len({(x.lat, x.lon) for x in got}) == 3


def test_near_places(spark):
    r = random.Random(2)
    places = [(f"p{i}", r.uniform(9.4, 9.5), r.uniform(76.4, 76.5), r.choice([60.0, 400.0, None])) for i in range(60)]
    pts = [(f"m{i}", r.uniform(9.4, 9.5), r.uniform(76.4, 76.5)) for i in range(400)]
    got = spatial.near_places(spark.createDataFrame(pts, "message_id string, lat double, lon double"), spark.createDataFrame(places, "name string, lat double, lon double, radius_m double"))
    want = {(m, p) for m, a, b in pts for p, c, d, rad in places if rad is not None and hav(a, b, c, d) <= rad}
    assert {(x.message_id, x.place) for x in got.collect()} == want


def test_near_counts_with_a_crowd(spark):
    r = random.Random(3)
    pts = [(i, 9.45 + r.uniform(-0.004, 0.004), 76.45 + r.uniform(-0.004, 0.004)) for i in range(300)]
    pts += [(1000 + i, 9.45, 76.45) for i in range(500)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    q = df.filter("id % 7 = 0")
    got = {x.id: x.n_near for x in spatial.near_counts(df, q, 150.0, "id").collect()}
    want = {i: sum(hav(a, b, c, d) <= 150.0 for _, c, d in pts) for i, a, b in pts if i % 7 == 0}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "message_id string, lat double, lon double")
    places = spark.createDataFrame([], "name string, lat double, lon double, radius_m double")
    assert spatial.near_places(none, places).count() == 0
    assert spatial.regions_of(none, squares(spark)).count() == 0
    assert spatial.near_counts(none, none, 10.0, "message_id").count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(f"a{i:03}", f"k{i}") for i in range(40)] + [(f"a{i + 1:03}", f"k{i}") for i in range(39)]
    rows += [(f"s{i:03}", "hub") for i in range(60)] + [("lonely", "own")]
    got = {r.node: r.component for r in by_shared_keys(spark.createDataFrame(rows, "node string, key string")).collect()}
    assert {got[f"a{i:03}"] for i in range(40)} == {"a000"}
    assert {got[f"s{i:03}"] for i in range(60)} == {"s000"}
    assert "lonely" not in got


def test_places_of_all_sizes_across_the_date_line(spark):
    r = random.Random(8)
    places = [(f"p{k}", r.choice([9.6, 76.5, -60.0, 0.0]) + r.uniform(-0.2, 0.2), r.choice([179.99, -179.99, 10.0]) + r.uniform(-0.009, 0.009), float(r.choice([0, 1, 150, 900, 5_000, 50_000, 3_000_000]))) for k in range(60)]
    places += [("null", 9.6, 179.99, None), ("nowhere", None, 1.0, 5.0), ("all", 0.0, 0.0, 1e9)]
    points = [(f"m{k}", r.choice([9.6, 76.5, -60.0, 0.0, 89.9]) + r.uniform(-0.1, 0.1), r.choice([179.99, -179.99, 10.0]) + r.uniform(-0.009, 0.009)) for k in range(80)]
    points += [(n + "x", la, lo) for n, la, lo, _ in places[:40]] + [("none", None, 3.0)]
    g = spark.createDataFrame([(*x, "z") for x in places], "name string, lat double, lon double, radius_m double, level string")
    p = spark.createDataFrame([(*x, "z") for x in points], "message_id string, lat double, lon double, place2 string")
    got = {(x.message_id, x.place) for x in spatial.near_places(p, g).select("message_id", "place").collect()}

    def away(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))

    want = {(m, n) for m, a, b in points if a is not None for n, c, d, rad in places if c is not None and rad is not None and away(a, b, c, d) <= rad}
    assert got == want and len(want) > 200
