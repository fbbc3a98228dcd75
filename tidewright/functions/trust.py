"""Trust in a group of reports: corroboration, diversity, consistency, freshness, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.text import clip

# Weights, half-life in minutes, senders that saturate corroboration.
WEIGHTS = {"corroboration": 0.28, "diversity": 0.24, "consistency": 0.18, "freshness": 0.22, "propagation": 0.08}
HALF_LIFE, SENDERS, SINGLE = 90.0, 3.0, 0.52


def freshness(stale: Column) -> Column:
    return F.bround(F.pow(F.lit(0.5), F.greatest(stale, F.lit(0.0)) / HALF_LIFE), 4)


def redecayed(trust: Column, stale: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.05), trust * freshness(stale)), 4)


def entropies(reports: DataFrame, group: str, by: str, out: str) -> DataFrame:
    """Entropy of `by` within each group over the log of its distinct values."""
    c = reports.groupBy(group, by).agg(F.count(F.lit(1)).alias("c"))
    # sum of -(c/n) ln(c/n) = ln n - sum(c ln c) / n, so one more aggregate is enough.
    g = c.groupBy(group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.log("c")).alias("s"), F.max("c").alias("top"))
    h = F.when((F.col("n") <= 1) | (F.col("k") <= 1), F.lit(0.0)).otherwise((F.log("n") - F.col("s") / F.col("n")) / F.log("k"))
    return g.select(group, h.alias(f"{out}_h"), F.col("k").alias(f"{out}_k"), (F.col("top") / F.col("n")).alias(f"{out}_top"))


def score(reports: DataFrame, group: str, now_us: Column) -> DataFrame:
    """Trust of each group of `reports` (group, channel, sender_hash, need_type,
    people, at in microseconds) as of `now_us`, with its components."""
    base = reports.groupBy(group).agg(
        F.count(F.lit(1)).alias("reports"), F.countDistinct("sender_hash").alias("senders"), F.min("at").alias("t0"), F.max("at").alias("t1"),
        F.min(F.when(F.col("people") > 0, F.col("people"))).alias("p0"), F.max(F.when(F.col("people") > 0, F.col("people"))).alias("p1"),
        F.avg(F.when(F.col("people") > 0, F.col("people"))).alias("pm"), F.count(F.when(F.col("people") > 0, 1)).alias("pn"),
    )
    for by, out in (("channel", "ch"), ("sender_hash", "se"), ("need_type", "ne")):
        base = base.join(entropies(reports, group, by, out), group)
    return graded(base, [group], now_us)


def graded(base: DataFrame, keys: list[str], now_us: Column) -> DataFrame:
    """Components and trust of `base`, whose rows describe groups of reports:
    reports, senders, t0, t1 (microseconds), p0, p1, pm, pn (least, largest, mean
    and number of headcounts above 0), ch_k, ch_h, se_h and ne_top (see `entropies`)."""
    n, senders = F.col("reports"), F.col("senders")
    spread = F.when(F.col("pn") >= 2, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), (F.col("p1") - F.col("p0")) / F.col("pm") / 2.5))).otherwise(1.0)
    span = F.greatest(F.lit(1.0), (F.col("t1") - F.col("t0")) / 60e6)
    penalty = F.when(n / senders >= 3, F.least(F.lit(0.55), 0.16 * (n / senders - 2))).otherwise(0.0) + F.when((n / span > 0.5) & (senders <= 2), 0.25).otherwise(0.0)
    d = base.select(
        *keys, "reports", "senders",
        F.least(F.lit(1.0), senders / SENDERS).alias("corroboration"),
        F.bround(F.least(F.least(F.lit(1.0), F.col("ch_k") / 3), 0.45 * F.col("ch_h") + 0.55 * F.col("se_h")), 4).alias("diversity"),
        F.when(n < 2, F.lit(1.0)).otherwise(F.bround(0.7 * F.col("ne_top") + 0.3 * spread, 4)).alias("consistency"),
        freshness((now_us - F.col("t1")) / 60e6).alias("freshness"),
        F.when(n < 4, F.lit(1.0)).otherwise(F.bround(F.greatest(F.lit(0.05), 1 - penalty), 4)).alias("propagation"),
    )
    raw = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    raw = F.when((senders == 1) & (F.col("propagation") > 0.6), F.greatest(raw, SINGLE * F.col("freshness"))).otherwise(raw)
    return d.withColumn("trust", F.bround(F.round(clip(raw, 0.0, 1.0), 8), 4))


def running(reports: DataFrame, group: str) -> DataFrame:
    """The rows of `reports` (see `score`, with message_id) with what `graded`
    needs of all reports of the group up to this one, in order of time and id.

    A category's k-th report changes the sum of c ln c by k ln k - (k-1) ln (k-1),
    so entropies are running sums, and no prefix is formed twice.
    """
    order = ["at", "message_id"]
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = reports
    for by, out in (("channel", "ch"), ("sender_hash", "se"), ("need_type", "ne")):
        d = d.withColumn(f"_{out}", F.row_number().over(W.partitionBy(group, by).orderBy(*order)).cast("double"))
    d = d.withColumn("reports", F.row_number().over(w))
    n = F.col("reports").cast("double")
    for out in ("ch", "se"):
        k = F.col(f"_{out}")
        step = k * F.log(k) - F.when(k > 1, (k - 1) * F.log(F.greatest(k - 1, F.lit(1.0)))).otherwise(0.0)
        d = d.withColumn(f"{out}_k", F.sum((k == 1).cast("int")).over(w)).withColumn(f"{out}_s", F.sum(step).over(w))
        h = F.when((n <= 1) | (F.col(f"{out}_k") <= 1), F.lit(0.0)).otherwise((F.log(n) - F.col(f"{out}_s") / n) / F.log(F.col(f"{out}_k").cast("double")))
        d = d.withColumn(f"{out}_h", h)
    some = F.when(F.col("people") > 0, F.col("people"))
    d = d.withColumn("senders", F.col("se_k")).withColumn("ne_top", F.max("_ne").over(w) / n)
    d = d.withColumn("t0", F.first("at").over(w)).withColumn("t1", F.col("at"))
    d = d.withColumn("p0", F.min(some).over(w)).withColumn("p1", F.max(some).over(w)).withColumn("pm", F.avg(some).over(w)).withColumn("pn", F.count(some).over(w))
    return d.drop("_ch", "_se", "_ne", "ch_s", "se_s")
