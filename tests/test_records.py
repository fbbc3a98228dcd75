"""Records from groups of reports, running trust, and tables that are cut and discarded."""

import os
import random

from pyspark.sql import functions as F

from tidewright.functions import trust
from tidewright.operators import embed, reconcile
from tidewright.session import cut, discard

SCHEMA = (
    "demand_id string, message_id string, channel string, sender_hash string, at bigint, need_type string, need_raw double, people int, people_raw double, "
    "flags array<string>, flags_raw double, level string, urgency_raw double, raw_text string"
)


def report(d, m, at, need="water", people=4, **kw):
    base = dict(demand_id=d, message_id=m, channel="sms", sender_hash="s", at=at, need_type=need, need_raw=0.8, people=people, people_raw=0.9, flags=[], flags_raw=0.55, level="none", urgency_raw=0.7, raw_text=m)
    return base | kw


def made(spark, rows):
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_a_record_of_one_and_of_many(spark):
    rows = [report("d1", "m1", 0, raw_text=None, channel=None)]
    rows += [report("d2", f"m{k}", k * 60_000_000, people=p, sender_hash=f"s{k}", channel=c) for k, (p, c) in enumerate([(3, "sms"), (9, "web"), (5, "sms"), (400, "call")])]
    rows += [report("d2", "m9", 500_000_000, need="food", need_raw=0.5, people=77, flags=["elderly", "infant"], flags_raw=0.88, level="critical", urgency_raw=0.91)]
    got = {r.demand_id: r for r in reconcile.records(made(spark, rows), "demand_id", F.lit(600_000_000)).collect()}
    assert set(got) == {"d1", "d2"}
    one, many = got["d1"], got["d2"]
    assert one.duplicate_collapse_count == 1 and one.channels == [] and one.need.people == 4 and one.time_decay_class == "stable"
    # The upper median of the four that agree on the need, not of all.
    assert many.need.type == "water" and many.need.people == 9
    assert many.need.vulnerability_flags == ["elderly", "infant"] and many.need.medical_urgency == "critical" and many.time_decay_class == "escalating"
    assert many.channels == ["call", "sms", "web"] and many.raw_texts == ["m0", "m1", "m2", "m3", "m9"]
    assert many.need.people_lower <= 9 <= many.need.people_upper
    assert reconcile.records(made(spark, rows).limit(0), "demand_id", F.lit(0)).count() == 0


def test_texts_are_the_earliest_eight(spark):
    rows = [report("d", f"m{k:02}", 1000 - k) for k in range(20)]
    r = reconcile.records(made(spark, rows), "demand_id", F.lit(0)).first()
    assert r.raw_texts == [f"m{k:02}" for k in range(19, 11, -1)] and r.duplicate_collapse_count == 20


def test_running_trust_is_the_trust_of_each_prefix(spark):
    r = random.Random(2)
    rows = [report(f"d{k % 3}", f"m{k:02}", r.randint(0, 50) * 60_000_000, need=r.choice(["water", "food"]), people=r.randint(0, 9), sender_hash=r.choice("abc"), channel=r.choice(["sms", "web", "call"])) for k in range(40)]
    df = made(spark, rows)
    now = F.lit(60 * 60_000_000)
    got = {(x.demand_id, x.message_id): x.trust for x in trust.graded(trust.running(df, "demand_id"), ["demand_id", "message_id"], now).collect()}
    assert len(got) == 40
    for d in ("d0", "d1", "d2"):
        own = sorted((x for x in rows if x["demand_id"] == d), key=lambda x: (x["at"], x["message_id"]))
        for k in (1, 2, 5, len(own)):
            want = trust.score(made(spark, own[:k]), "demand_id", now).first().trust
            assert abs(got[d, own[k - 1]["message_id"]] - want) <= 1e-4


def test_similarity_of_texts(spark):
    rows = [("a", "water is rising here", "water"), ("b", "water is rising here", "water"), ("c", "", "water"), ("d", "doctor for my mother", "medical")]
    df = spark.createDataFrame([(*r, ["elderly"], "none", 4) for r in rows], "i string, t string, need string, flags array<string>, level string, people int")
    items = df.select("i", embed.frame(F.col("need"), F.col("flags"), F.col("level"), F.col("people")).alias("frame")).join(embed.vectors(df, "i", "t"), "i", "left")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    got = {r.b: r.cosine for r in embed.similar(pairs, items, "i", -1.0).collect()}
    assert got["b"] == 1.0 and got["b"] > got["c"] > got["d"]


def test_cut_tables_are_discarded(spark):
    discard(spark)
    d = cut(spark.range(5))
    path = d.inputFiles()[0].removeprefix("file://")
    assert d.count() == 5 and os.path.exists(path)
    assert discard(spark) == 1 and not os.path.exists(path)
