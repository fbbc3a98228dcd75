"""Alike pairs found in cells against the gate and cosine of each pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import alike, clusters, embed, graph

MESSAGE = "message_id string, raw_text string, us long, need_type string, people int, sure boolean, flags array<string>, level string"
PLACE = "message_id string, lat double, lon double, resolution string"
WORDS = "water rising fast near the old bridge send boat now please help many people stuck roof".split()


def tables(spark, seed, n, centres=((9.5, 76.4, 0.02), (9.52, 76.43, 0.02), (76.5, 180.0, 0.1), (89.99, 40.0, 180.0))):
    r = random.Random(seed)
    m, p = [], []
    for i in range(n):
        text = " ".join(r.choices(WORDS, k=r.choice([0, 1, 6, 9]))) if i % 9 else "sos"
        m.append((f"m{i:04}", text, r.randrange(0, 9 * 3_600_000_000), r.choice(["medical", "water"]), r.choice([0, 4, 5, 6, 9]), r.random() < 0.5, r.choice([[], ["elderly"]]), r.choice(["none", "critical"])))
        y, x, wide = r.choice(centres)
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            kind = r.choice(["point", "building", "street", "ward", "unknown"])
            p.append((m[-1][0], y + r.uniform(-0.004, 0.004), (x + r.uniform(-wide, wide) + 180) % 360 - 180, kind))
    p += [p[0], (p[1][0], None, 3.0, "point")]
    return spark.createDataFrame(m, MESSAGE), spark.createDataFrame(p, PLACE)


def made(m, p):
    frame = embed.frame(F.col("need_type"), F.col("flags"), F.col("level"), F.col("people"))
    return alike.placed(embed.packed(m.withColumn("frame", frame).drop("flags", "level"), "raw_text"), p)


def one_by_one(m, p, coarse):
    frame = embed.frame(F.col("need_type"), F.col("flags"), F.col("level"), F.col("people"))
    items = m.select("message_id", frame.alias("frame")).join(embed.vectors(m, "message_id", "raw_text"), "message_id", "left")
    met = m.join(p.filter("lat is not null").distinct(), "message_id")
    pairs = graph.barred(met) if coarse else graph.gated(met)
    return embed.similar(pairs, items, "message_id", "bar" if coarse else graph.ALIKE)


def sets(pairs):
    of = {}
    for a, b in pairs:
        x = of.setdefault(a, {a}) | of.setdefault(b, {b})
        for k in x:
            of[k] = x
    return {frozenset(x) for x in of.values()}


def test_small_blocks_find_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(alike, "LEAF", 8)
    m, p = tables(spark, 2, 700)
    t = alike._sorted(made(m, p)).toArrow().sort_by([(k, "ascending") for k in ("need_type", "cx", "cy", "cz", "slot")])
    for coarse in (False, True):
        got = []
        for cell in (alike._Cell(g, coarse) for g in alike._groups(iter(t.to_batches()))):
            for i, j, c in cell.pairs(graph.ALIKE):
                x, y = np.minimum(cell.code[i], cell.code[j]), np.maximum(cell.code[i], cell.code[j])
                got += zip(cell.names.take(x).to_pylist(), cell.names.take(y).to_pylist(), c.tolist(), strict=True)
        assert sorted(got) == sorted((x.a, x.b, x.cosine) for x in one_by_one(m, p, coarse).collect())


def test_the_pairs_are_those_of_gate_and_cosine(spark):
    m, p = tables(spark, 1, 900)
    m, p = m.cache(), p.cache()
    for coarse in (False, True):
        want = {(x.a, x.b): x.cosine for x in one_by_one(m, p, coarse).collect()}
        rows = alike.pairs(made(m, p), graph.ALIKE, coarse).collect()
        got = {(x.a, x.b): x.cosine for x in rows}
        assert len(rows) == len(got) and got == want and len(want) > 200
        assert sets((x.a, x.b) for x in alike.joined(made(m, p), graph.ALIKE, coarse).collect()) == sets(want)


def test_text_vectors_are_those_of_buckets(spark):
    texts = ["", "a", "ab", "Water  is rising -- HERE 12!", "വെള്ളം", "x" * 3000, "aé b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = {x.i: x.v for x in embed.vectors(df, "i", "t").collect()}
    for x in embed.packed(df, "t").collect():
        v = np.frombuffer(x.v, f"<i{len(x.v) // 256}")
        assert v.tolist() == want.get(x.i, [0] * 256)


def test_rounding_is_that_of_spark(spark):
    x = np.array([0.6799995, 0.6800005, 0.1234565, 0.1234575, -0.1234565, 1.0, 0.0, 0.8599994999, *np.random.default_rng(1).uniform(-1, 1, 500)])
    want = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert alike.rounded(x).tolist() == want


def test_a_crowd_makes_no_row_for_each_pair_of_the_gate(spark, root, monkeypatch):
    """Before, all pairs that pass the gate were written and joined with the vectors of both."""
    from tidewright.plans import graph_queries

    def never(*_, **__):
        raise AssertionError("pairs of the gate became rows")

    for f in ("gated", "barred"):
        monkeypatch.setattr(graph, f, never)
    monkeypatch.setattr(embed, "similar", never)
    for q in (graph_queries.e3_similar_pairs, graph_queries.d3_links, graph_queries.d4_clusters):
        assert q(spark, root).count() > 0


def test_large_components_are_split_as_small_ones(spark, monkeypatch):
    """The vectors stay packed: before, each number of a vector was a row in each round."""
    r = random.Random(7)
    rows = []
    for c, n in (("p", 150), ("q", 90), ("r", 2), ("s", 1), ("t", 40), ("u", 130)):
        for k in range(n):
            text = " ".join(r.choices(WORDS[:6] if k % 3 or c == "u" else WORDS[9:], k=5)) if c != "t" else str(r.random())
            rows.append((f"{c}{k:03}", text, 0, r.choice(["medical", "water", "food"]), r.choice([0, 4, 60]), True, [], r.choice(["none", "critical"])))
    frame = embed.frame(F.col("need_type"), F.col("flags"), F.col("level"), F.col("people"))
    m = spark.createDataFrame(rows, MESSAGE).withColumn("component", F.substring("message_id", 1, 1)).withColumn("node", F.col("message_id"))
    want = {(x.node, x.cluster) for x in clusters.refined(m.select("node", "component"), embed.joint(m, "node")).collect()}
    v = embed.packed(m.select("node", "component", frame.alias("frame"), "raw_text"), "raw_text").cache()
    for large in (20_000, 50):
        monkeypatch.setattr(clusters, "LARGE", large)
        assert {(x.node, x.cluster) for x in clusters.split(v).collect()} == want
    assert 6 < len({c for _, c in want}) < len(want) - 20


def test_farthest_of_a_crowd():
    r = np.random.default_rng(3)
    for n, wide in ((2000, (0.001, 0.001)), (3000, (0.01, 0.0001)), (1500, (1.0, 2.0))):
        y, x = r.normal(0.2, wide[0], n), r.normal(1.3, wide[1], n)
        p = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)
        i, j = clusters._farthest(p)
        most = max(((p[k] - p) ** 2).sum(1).max() for k in range(n))
        assert abs(((p[i] - p[j]) ** 2).sum() - most) < 1e-12


def test_records_of_clusters_parse_texts_once(spark, root, monkeypatch):
    from tidewright.functions import triage
    from tidewright.plans import record_queries

    n, read = [], triage.extraction
    monkeypatch.setattr(triage, "extraction", lambda c: n.append(1) or read(c))
    assert record_queries.r5_pipeline(spark, root).count() > 0 and len(n) == 1
