"""Hand-checked values of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import geo, text, triage, trust


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("hai hain ka ki the", ("hi", 0.8)),
        ("the a an is are", ("en", 0.98)),
        ("hai ki the is", ("mixed", 0.837)),
        ("", ("en", 0.2)),
        ("xyz", ("en", 0.25)),
    ],
)
def test_language(spark, words, want):
    r = one(spark, text.language(F.col("t")), t=words)
    assert (r.language, r.confidence) == want


def test_tokens_and_back(spark):
    t = text.detokenized(text.expanded(text.tokens(F.col("t"))))
    assert one(spark, t, t="Pls  send BOAT, (now)!") == "please send boat, (now)!"


@pytest.mark.parametrize(("a", "b", "cost"), [("near", "nera", 1), ("near", "near", 0), ("boat", "bot", 1), ("boat", "bota", 1), ("boat", "tabo", 2), ("water", "watar", 1)])
def test_edit_cost(spark, a, b, cost):
    assert one(spark, text.edit_cost(F.col("a"), F.col("b")), a=a, b=b) == cost


def test_corrections(spark):
    tok = spark.createDataFrame([("watre",), ("1234",), ("bot",), ("rescue",), ("zzzzzz",)], ["token"])
    voc = spark.createDataFrame([("water", 0), ("rescue", 1)], ["word", "rank"])
    got = {r.token: r.correction for r in text.corrections(tok, voc).collect()}
    assert got == {"watre": "water", "1234": "1234", "bot": "bot", "rescue": "rescue", "zzzzzz": "zzzzzz"}


@pytest.mark.parametrize(
    ("point", "conf", "want"), [(7, 0.62, (4, 7, 10)), (7, 0.9, (6, 7, 8)), (20, 0.78, (15, 20, 25)), (5, 0.15, (1, 5, 9)), (1, 0.5, (0, 1, 2)), (10, 1.0, (10, 10, 10))]
)
def test_interval(spark, point, conf, want):
    r = one(spark, triage.interval(F.col("p"), F.col("c")), p=point, c=conf)
    assert (r.lower, r.point, r.upper) == want


@pytest.mark.parametrize(("raw", "want"), [(0.93, 0.758), (0.90, 0.740), (0.58, 0.548), (0.44, 0.464), (0.15, 0.290)])
def test_unfitted(spark, raw, want):
    assert one(spark, triage.unfitted(F.col("r")), r=raw) == pytest.approx(want)


@pytest.mark.parametrize(("acc", "want"), [(12.0, ("point", 0.95)), (90.0, ("building", 0.86)), (400.0, ("street", 0.66)), (1500.0, ("ward", 0.42)), (9000.0, ("ward", 0.28))])
def test_ladder(spark, acc, want):
    r = one(spark, geo.ladder(F.col("a")), a=acc)
    assert (r.resolution, r.confidence) == want


def test_extraction(spark):
    r = one(spark, triage.extraction(F.col("t")), t="We are 12 people trapped, send boat. A pregnant woman is sick")
    assert r.need.need_type == "evacuation"
    assert (r["head"].people, r["head"].method) == (12, "first_person_count")
    assert r.vuln.flags == ["pregnant"]
    assert r.urgency.level == "mild"
    nothing = one(spark, triage.extraction(F.col("t")), t="")
    assert (nothing.need.need_type, nothing.need.raw, nothing["head"].people) == ("evacuation", 0.18, 5)


def test_trust(spark):
    hour = 3_600_000_000
    rows = [("a", "sms", "s1", "water", 7, 0)]
    rows += [("b", c, s, "water", p, t) for c, s, p, t in (("sms", "s1", 7, 0), ("chat", "s2", 7, hour // 6), ("web", "s3", 8, hour // 3))]
    d = spark.createDataFrame(rows, "g string, channel string, sender_hash string, need_type string, people int, at bigint")
    got = {r.g: r for r in trust.score(d, "g", F.lit(hour // 3)).collect()}
    assert got["b"].consistency == 0.9836
    assert got["b"].trust == pytest.approx(0.9970, abs=2e-4)
    fresh = {r.g: r.trust for r in trust.score(d, "g", F.lit(0)).collect()}
    assert fresh["a"] == pytest.approx(0.5733, abs=1e-4)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(0, 1)), min_size=1, max_size=30))
def test_interval_is_ordered(spark, rows):
    df = spark.createDataFrame([(a, float(b)) for a, b in rows], "p int, c double").select("p", triage.interval(F.col("p"), F.col("c")).alias("i"))
    assert all(r.i.lower <= r.i.point <= r.i.upper for r in df.collect())
