"""Demand records from groups of reports: what all reports of a group say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import triage, trust

#: Texts that a record keeps at most, the earliest.
TEXTS = 8
# How senders raise the confidence in a headcount, and its bound.
PER_SENDER, SENDERS, SUREST = 0.06, 3, 0.97


def _upper_median(hist: Column, n: Column) -> Column:
    """The element at n div 2 of the sorted values in `hist`, an array of (people, c) in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at"))
    step = lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["c"] > F.floor(n / 2), x["people"])).alias("at"))
    return F.aggregate(hist, start, step)["at"]


def needs(reports: DataFrame, group: str) -> DataFrame:
    """(group, need_type, need_raw, people, people_raw): the need by confidence-weighted
    vote, and the upper median of the headcounts of the members that agree on it.

    Headcounts are small whole numbers, so a need of a group is a histogram of
    bounded size, whatever the number of its reports.
    """
    first = F.min(F.struct("at", "message_id")).alias("first")
    one = reports.groupBy(group, "need_type", "people").agg(F.count(F.lit(1)).alias("c"), F.sum("need_raw").alias("w"), F.max("need_raw").alias("best"), F.max("people_raw").alias("sure"), first)
    two = one.groupBy(group, "need_type").agg(
        F.sum("c").alias("n"), F.bround(F.sum("w"), 6).alias("w"), F.max("best").alias("best"), F.max("sure").alias("sure"), F.min("first").alias("first"),
        F.min("people").alias("lo"), F.max("people").alias("hi"), F.array_sort(F.collect_list(F.struct("people", "c"))).alias("hist"),
    )
    g = two.groupBy(group).agg(F.min(F.struct((-F.col("w")).alias("nw"), "first", "need_type", "best", "n", "sure", "lo", "hi", "hist")).alias("b"), F.sum("w").alias("tot"), F.sum("n").alias("all"))
    share = -F.col("b.nw") / F.col("tot")
    raw = F.when(F.col("all") > 1, F.least(F.lit(0.995), F.col("b.best") * (0.80 + 0.20 * share))).otherwise(F.col("b.best"))
    g = g.withColumn("people", _upper_median(F.col("b.hist"), F.col("b.n")))
    agree = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), (F.col("b.hi") - F.col("b.lo")) / F.greatest(F.lit(1), F.col("people")) / 1.5))
    sure = F.when(F.col("b.n") > 1, F.least(F.lit(SUREST), F.col("b.sure") * (0.72 + 0.28 * agree))).otherwise(F.col("b.sure"))
    return g.select(group, "b.need_type", raw.alias("need_raw"), "people", sure.alias("people_raw"))


def flags(reports: DataFrame, group: str) -> DataFrame:
    """(group, flags, flags_raw): united flags, in order, and their confidence."""
    top = reports.groupBy(group).agg(F.max("flags_raw").alias("raw"), F.count(F.lit(1)).alias("n"))
    c = reports.select(group, F.explode("flags").alias("flag")).groupBy(group, "flag").agg(F.count(F.lit(1)).alias("c"))
    c = c.groupBy(group).agg(F.array_sort(F.collect_set("flag")).alias("flags"), F.max("c").alias("most"))
    j = top.join(c, group, "left")
    raw = F.when(F.col("flags").isNotNull() & (F.col("n") > 1), F.least(F.lit(0.96), F.col("raw") + 0.05 * (F.col("most") - 1))).otherwise(F.col("raw"))
    return j.select(group, F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), raw.alias("flags_raw"))


def records(reports: DataFrame, group: str, now_us: Column) -> DataFrame:
    """One demand record for each group of `reports` (group, message_id, channel,
    sender_hash, at, need_type, need_raw, people, people_raw, flags, flags_raw,
    level, urgency_raw, raw_text).  Raw confidences are calibrated without a fit;
    the interval comes from the unrounded confidence in the headcount.

    Defined cases: groups without reports have no record; ties of needs go to the
    need reported first, ties of urgency to the report that came first.
    """
    worst = F.when(F.col("level") == "critical", 3).when(F.col("level") == "moderate", 2).when(F.col("level") == "mild", 1).otherwise(0)
    base = reports.groupBy(group).agg(
        F.count(F.lit(1)).alias("duplicate_collapse_count"), F.countDistinct("sender_hash").alias("senders_"), F.min("at").alias("first_us"), F.max("at").alias("last_us"),
        F.array_sort(F.collect_set("channel")).alias("channels"), F.min(F.struct((-worst).alias("o"), "at", "message_id", "level", "urgency_raw")).alias("u"),
    )
    w = W.partitionBy(group).orderBy("at", "message_id")
    texts = reports.select(group, "at", "message_id", "raw_text").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= TEXTS)
    texts = texts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw_text"))), lambda x: x["raw_text"]).alias("raw_texts"))
    score = trust.score(reports, group, now_us).select(group, F.col("trust").alias("trust_score"))
    j = base.join(needs(reports, group), group).join(flags(reports, group), group).join(texts, group).join(score, group)
    sure = triage.unfitted(F.col("people_raw"))
    quantity = F.least(F.lit(SUREST), sure * (1.0 + PER_SENDER * F.least(F.lit(SENDERS), F.col("senders_") - 1)))
    j = j.withColumn("i", triage.interval(F.col("people"), quantity))
    r = lambda c: F.round(triage.unfitted(F.col(c)), 6)
    return j.select(
        group, "duplicate_collapse_count", F.struct(F.col("need_type").alias("type"), F.col("i.point").alias("people"), F.col("i.lower").alias("people_lower"), F.col("i.upper").alias("people_upper"),
        F.col("flags").alias("vulnerability_flags"), F.col("u.level").alias("medical_urgency")).alias("need"),
        F.struct(r("need_raw").alias("need_type"), r("people_raw").alias("headcount"), r("flags_raw").alias("vulnerability"), F.round(triage.unfitted(F.col("u.urgency_raw")), 6).alias("medical_urgency")).alias("field_confidence"),
        F.bround(quantity, 4).alias("quantity_confidence"), "trust_score", "first_us", "last_us", triage.decay_class(F.col("need_type"), F.col("u.level")).alias("time_decay_class"), "channels", "raw_texts",
    )
