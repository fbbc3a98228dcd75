"""The pair gate, clusters and travel times against brute force."""

import math
import random

from test_spatial import hav

from tidewright.operators import clusters, graph, spatial
from tidewright.plans import graph_queries

ITEM = "message_id string, lat double, lon double, us long, resolution string, need_type string, people int, sure boolean"


def brute_pairs(rows):
    out = set()
    for a in rows:
        for b in rows:
            radius = 180 + graph.UNCERTAIN[a[4]] + graph.UNCERTAIN[b[4]]
            if a[0] < b[0] and radius <= 3000 and abs(a[3] - b[3]) <= 90 * 60_000_000 and hav(a[1], a[2], b[1], b[2]) <= radius:
                out.add((a[0], b[0]))
    return out


def test_gate_loses_no_pair_at_any_latitude(spark):
    r = random.Random(4)
    rows = []
    for y, x, wide in ((9.5, 76.4, 0.03), (76.5, 9.6, 0.12), (-76.5, 180.0, 0.12), (89.99, 40.0, 180.0), (12.3, 80.0, 0.03)):
        for _ in range(40):
            lon = (x + r.uniform(-wide, wide) + 180) % 360 - 180
            kind = r.choice(["point", "building", "ward"])
            rows.append((f"m{len(rows):03}", y + r.uniform(-0.005, 0.005), lon, r.randrange(0, 4 * 3_600_000_000), kind, "boat", 4, True))
    # Neighbours 1 to 3 km apart in longitude, all at one time.
    rows += [(f"n{k}", 76.5, 9.6 + k * 0.045, 0, "ward" if k % 2 else "point", "boat", 4, True) for k in range(6)]
    got = [(p.a, p.b) for p in graph.gated(spark.createDataFrame(rows, ITEM)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_wide_pairs_need_a_higher_bar_and_like_headcounts(spark):
    rows = [
        ("a", 9.5, 76.4, 0, "ward", "boat", 4, True), ("b", 9.501, 76.4, 0, "point", "boat", 5, True), ("c", 9.502, 76.4, 0, "point", "boat", 6, False),
        ("d", 9.5, 76.401, 0, "point", "boat", 0, False), ("e", 9.5, 76.5, 0, "point", "boat", 4, True),
    ]
    got = {(p.a, p.b): p.bar for p in graph.barred(spark.createDataFrame(rows, ITEM)).collect()}
    # a and c: 6 > 1.35 * 4, although one of the counts is not sure.
    assert got == {("a", "b"): 0.86, ("a", "d"): 0.86, ("b", "c"): 0.68, ("b", "d"): 0.68, ("c", "d"): 0.68}


def test_chains_are_split_and_single_reports_kept(spark):
    r = random.Random(5)
    bar, vec, groups = clusters.CENTRE_ALIKE, {}, []
    for c, size in (("p", 9), ("q", 14), ("r", 2), ("s", 1), ("t", 30)):
        for i in range(size):
            v = [r.gauss(0, 1) + (c == "q") for _ in range(4)]
            n = math.sqrt(sum(x * x for x in v))
            vec[f"{c}{i:02}"] = [x / n for x in v]
            groups.append((f"{c}{i:02}", c))

    def split(members):
        out = []
        while members:
            if len(members) <= 2:
                return [*out, members]
            s = [sum(vec[m][k] for m in members) for k in range(4)]
            n = math.sqrt(sum(x * x for x in s))
            keep = [m for m in members if sum(x * y for x, y in zip(vec[m], s)) / n >= bar]
            if not keep:
                return out + [[m] for m in members]
            out.append(keep)
            members = [m for m in members if m not in keep]
        return out

    want = {(m, min(x)) for c in "pqrst" for x in split([m for m, g in groups if g == c]) if x for m in x}
    v = spark.createDataFrame([(m, str(k), x) for m, xs in vec.items() for k, x in enumerate(xs)], "node string, dim string, w double")
    got = clusters.refined(spark.createDataFrame(groups, "node string, component string"), v)
    assert {(x.node, x.cluster) for x in got.collect()} == want and len({c for _, c in want}) > 5


def test_spread_is_the_largest_distance(spark):
    r = random.Random(6)
    pts = [(c, y + r.uniform(-s, s), x + r.uniform(-s, s)) for c, y, x, s in (("a", 9.5, 76.4, 0.02), ("b", 76.5, 9.6, 0.01)) for _ in range(60)]
    pts += [("one", 9.0, 76.0)] * 2
    got = {x.cluster: x.metres for x in clusters.spread(spark.createDataFrame(pts, "cluster string, lat double, lon double")).collect()}
    for c in ("a", "b", "one"):
        own = [p for p in pts if p[0] == c]
        assert abs(got[c] - max(hav(*p[1:], *q[1:]) for p in own for q in own)) < 1e-6


def test_clusters_hold_every_message(spark, root):
    rows = graph_queries.d5_clusters(spark, root).collect()
    m = spark.read.parquet(f"{root}/messages.parquet").filter("raw_text is not null and received_at is not null")
    assert sum(x.members for x in rows) == m.select("message_id").distinct().count()
    assert any(x.members == 1 for x in rows) and all(x.spread_m == 0 for x in rows if x.members == 1)


def reach(edges, start, limit):
    dist = {start: 0.0}
    for _ in range(len(edges)):
        new = {v: dist[u] + w for u, v, w in edges if u in dist and dist[u] + w <= limit and dist[u] + w < dist.get(v, math.inf) - 1e-9}
        if not new:
            break
        for u, v, w in edges:
            if u in dist and dist[u] + w <= limit:
                dist[v] = min(dist.get(v, math.inf), dist[u] + w)
    return dist


def test_travel_reaches_all_within_the_limit(spark, monkeypatch):
    r = random.Random(7)
    edges = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(40)] + [(f"n{r.randrange(41):02}", f"n{r.randrange(41):02}", r.uniform(3, 9)) for _ in range(30)]
    e = spark.createDataFrame(edges, "u string, v string, w double")
    s = spark.createDataFrame([("n00",), ("n20",), ("alone",), ("n00",)], "node string")
    for rows in (200_000, 5):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
        got = sorted((x.source, x.node, round(x.dist, 6)) for x in graph.travel(e, s, 35.0).collect())
        assert got == sorted((a, n, round(d, 6)) for a in ("n00", "n20", "alone") for n, d in reach(edges, a, 35.0).items())


def test_seconds_reach_beyond_twelve_steps(spark, root):
    d = graph_queries.g3_seconds(spark, root)
    road = d.filter("asset_type = 'truck'")
    n, zones = road.select("source").distinct().count(), spark.read.parquet(f"{root}/zones.parquet").count()
    assert n == 133 and road.count() == n * zones
    assert d.filter("seconds > 14400").isEmpty() and {x.asset_type for x in d.select("asset_type").distinct().collect()} == {"ambulance", "boat", "truck"}


def test_nearest_source_without_a_bound(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}", 30_000.0) for i in range(20)]
    edges += [(v, u, w) for u, v, w in edges]
    s = spark.createDataFrame([("n00", "b"), ("n08", "b"), ("n08", "a")], "node string, label string")
    got = {x.node: (x.dist, x.source, x.label) for x in graph.nearest(spark.createDataFrame(edges, "u string, v string, w double"), s).collect()}
    want = {f"n{i:02}": min((i * 30_000.0, "n00", "b"), (abs(i - 8) * 30_000.0, "n08", "a")) for i in range(21)}
    assert got == want


def test_every_zone_has_a_nearest_asset(spark, root):
    rows = graph_queries.g5_nearest_depot(spark, root).collect()
    assert len(rows) == spark.read.parquet(f"{root}/zones.parquet").count() and all(x.source for x in rows)
    road = graph_queries.g3_seconds(spark, root).groupBy("node").min("seconds").collect()
    assert {x.node: x.seconds for x in rows} == {n: round(s, 3) for n, s in road}
    assert all(x.first_s == min(x.seconds, 180.0) for x in rows)


def test_near_points_list_what_is_counted(spark):
    r = random.Random(8)
    pts = [(i, y + r.uniform(-0.003, 0.003), x + r.uniform(-w, w)) for i, (y, x, w) in enumerate([(9.45, 76.45, 0.003), (76.5, 9.6, 0.02)] * 100)]
    pts += [(1000 + i, 9.45, 76.45) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = sorted((x.id, x.lat, x.lon, round(x.metres, 6)) for x in spatial.near_points(df, df.filter("id % 7 = 0"), 150.0, "id").collect())
    spots = {(c, d) for _, c, d in pts}
    assert got == sorted((i, c, d, round(hav(a, b, c, d), 6)) for i, a, b in pts if i % 7 == 0 for c, d in spots if hav(a, b, c, d) <= 150.0)
    at = {}
    for _, c, d in pts:
        at[c, d] = at.get((c, d), 0) + 1
    counts = {x.id: x.n_near for x in spatial.near_counts(df, df.filter("id % 7 = 0"), 150.0, "id").collect()}
    assert counts == {i: sum(at[c, d] for j, c, d, _ in got if j == i) for i in counts}
