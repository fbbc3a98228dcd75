"""Queries on demands and their reports: votes, trust, calibration, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import triage, trust
from tidewright.functions.text import clean_id
from tidewright.plans import text_queries as tq
from tidewright.session import cut
from tidewright.sources.tables import table


def _demands(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "demands").dropDuplicates(["demand_id"])


def report_links(spark: SparkSession, root: str) -> DataFrame:
    """(demand_id, mid): the sources that demands list, each once, as clean ids."""
    links = table(spark, root, "demands").select("demand_id", F.explode("source_message_ids").alias("mid"))
    return links.select("demand_id", clean_id(F.col("mid")).alias("mid")).filter("mid <> ''").distinct()


def _reports(spark: SparkSession, root: str) -> DataFrame:
    """(demand_id, message_id, channel, sender_hash, at, need_type, need_raw, people, people_raw, flags, level, urgency_raw) of all demands' messages."""
    m = message_reports(spark, root)
    return report_links(spark, root).join(m.withColumn("mid", clean_id(F.col("message_id"))), "mid").drop("mid")


def message_reports(spark: SparkSession, root: str) -> DataFrame:
    """What each message says, as `_reports` without demands."""
    m = table(spark, root, "messages").filter("raw_text is not null and received_at is not null").dropDuplicates(["message_id"])
    m = m.select("message_id", "channel", "sender_hash", "raw_text", F.expr("unix_micros(cast(received_at as timestamp))").alias("at"), triage.extraction(F.col("raw_text")).alias("e"))
    return m.select(
        "message_id", "channel", "sender_hash", "raw_text", "at", "e.need.need_type", F.col("e.need.raw").alias("need_raw"), "e.head.people", F.col("e.head.raw").alias("people_raw"),
        "e.vuln.flags", F.col("e.vuln.raw").alias("flags_raw"), "e.urgency.level", F.col("e.urgency.raw").alias("urgency_raw"),
    )


def k1_trust_score(spark: SparkSession, root: str) -> DataFrame:
    """Trust of each demand's reports as of the last message received."""
    r = cut(_reports(spark, root), "reports")  # five aggregates read it: texts are parsed once
    last = table(spark, root, "messages").agg(F.max(F.expr("unix_micros(cast(received_at as timestamp))")).alias("x")).first()["x"]
    return trust.score(r, "demand_id", F.lit(last))


def k7_redecayed(spark: SparkSession, root: str) -> DataFrame:
    """Stored trust decayed by the time since the last corroboration."""
    d = _demands(spark, root).filter("trust_score is not null and last_corroborated_at is not null")
    us = F.expr("unix_micros(cast(last_corroborated_at as timestamp))")
    top = d.agg(F.max(us).alias("x"))
    stale = (F.col("x") - us) / 60e6
    return d.crossJoin(F.broadcast(top)).select("demand_id", trust.redecayed(F.col("trust_score"), stale).alias("trust"))  # one row


def r1_need_vote(spark: SparkSession, root: str) -> DataFrame:
    """Need of each demand by confidence-weighted vote of its reports."""
    r = _reports(spark, root)
    v = r.groupBy("demand_id", "need_type").agg(F.bround(F.sum("need_raw"), 6).alias("w"), F.min("message_id").alias("first"), F.max("need_raw").alias("best"), F.count(F.lit(1)).alias("c"))
    g = v.groupBy("demand_id").agg(F.min(F.struct((-F.col("w")).alias("nw"), F.col("first"), F.col("need_type"), F.col("best"))).alias("b"), F.sum("w").alias("tot"), F.sum("c").alias("n"))
    conf = F.when(F.col("n") > 1, F.least(F.lit(0.995), F.col("b.best") * (0.80 + 0.20 * -F.col("b.nw") / F.col("tot")))).otherwise(F.col("b.best"))
    return g.select("demand_id", "b.need_type", F.round(conf, 5).alias("confidence"))


def r2_headcount(spark: SparkSession, root: str) -> DataFrame:
    """Upper median of the headcounts of each demand's reports, and its confidence."""
    r = _reports(spark, root)
    w = W.partitionBy("demand_id").orderBy("people", "message_id")
    o = r.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("demand_id")))
    g = o.groupBy("demand_id").agg(
        F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("people"))).alias("people"), F.max("people_raw").alias("best"), F.min("people").alias("lo"), F.max("people").alias("hi"), F.max("n").alias("n")
    )
    agree = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), (F.col("hi") - F.col("lo")) / F.greatest(F.lit(1), F.col("people")) / 1.5))
    conf = F.when(F.col("n") > 1, F.least(F.lit(0.97), F.col("best") * (0.72 + 0.28 * agree))).otherwise(F.col("best"))
    return g.select("demand_id", "people", F.round(conf, 5).alias("confidence"))


def r3_flags(spark: SparkSession, root: str) -> DataFrame:
    """United vulnerability flags of each demand's reports."""
    r = _reports(spark, root).select("demand_id", F.explode("flags").alias("flag"))
    c = r.groupBy("demand_id", "flag").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("demand_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.max("c").alias("top_mentions"))


def r4_urgency(spark: SparkSession, root: str) -> DataFrame:
    """Worst urgency of each demand's reports, and the class of its decay."""
    r = _reports(spark, root)
    order = F.when(F.col("level") == "critical", 3).when(F.col("level") == "moderate", 2).when(F.col("level") == "mild", 1).otherwise(0)
    g = r.groupBy("demand_id").agg(F.min(F.struct((-order).alias("o"), F.col("at"), F.col("message_id"), F.col("level"), F.col("urgency_raw"))).alias("b"))
    need = r1_need_vote(spark, root).select("demand_id", "need_type")
    j = g.select("demand_id", "b.level", F.col("b.urgency_raw").alias("confidence")).join(need, "demand_id")
    return j.select("demand_id", "level", "confidence", triage.decay_class(F.col("need_type"), F.col("level")).alias("decay_class"))


def c4_interval(spark: SparkSession, root: str) -> DataFrame:
    """Headcount interval of each demand at its confidence."""
    d = _demands(spark, root).filter("need.people is not null and quantity_confidence is not null")
    d = d.select("demand_id", triage.interval(F.col("need.people"), F.col("quantity_confidence")).alias("i"))
    return d.select("demand_id", "i.lower", "i.point", "i.upper")


def c2_unfitted(spark: SparkSession, root: str) -> DataFrame:
    """Field confidences calibrated without a fit."""
    d = _demands(spark, root).filter("field_confidence is not null")
    return d.select("demand_id", *[F.round(triage.unfitted(F.col(f"field_confidence.{c}")), 6).alias(c) for c in ("need_type", "headcount", "vulnerability", "medical_urgency")])


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    """(raw, correct): trust of each settled demand, and whether it was resolved."""
    d = _demands(spark, root).filter("trust_score is not null and status is not null")
    return d.select(F.col("trust_score").alias("raw"), (F.col("status") == "resolved").alias("correct"))


def c5_reliability(spark: SparkSession, root: str) -> DataFrame:
    """Ten equal bins of trust: mean prediction and observed rate."""
    b = sum(((F.col("raw") >= i / 10).cast("int") for i in range(1, 10)), F.lit(0))
    d = _labelled(spark, root).select(b.alias("bin"), "raw", F.col("correct").cast("int").alias("y"))
    return d.groupBy("bin").agg(F.round(F.avg("raw"), 4).alias("predicted"), F.round(F.avg("y"), 4).alias("observed"), F.count(F.lit(1)).alias("n"))


def c6_ece_brier(spark: SparkSession, root: str) -> DataFrame:
    """Expected calibration error over the bins, and the Brier score."""
    bins = c5_reliability(spark, root)
    e = bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n"), 4).alias("ece"))
    b = _labelled(spark, root).agg(F.round(F.avg(F.pow(F.col("raw") - F.col("correct").cast("int"), 2)), 4).alias("brier"))
    return e.crossJoin(b)  # two single rows


def c1_isotonic(spark: SparkSession, root: str) -> DataFrame:
    """Isotonic fit of resolution on trust rounded to hundredths (pool adjacent violators)."""
    import pandas as pd

    x = _labelled(spark, root).select(F.round("raw", 2).alias("x"), F.col("correct").cast("int").alias("y"))
    g = x.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).withColumn("one", F.lit(1))  # at most 101 rows

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("x").reset_index(drop=True)
        blocks: list[list[float]] = []
        for i in range(len(d)):
            blocks.append([float(d.s[i]), float(d.n[i]), 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, k = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + k]
        y = [s / n for s, n, k in blocks for _ in range(int(k))]
        return pd.DataFrame({"x": d.x, "fitted": [round(min(0.98, max(0.02, v)), 6) for v in y]})

    return g.groupBy("one").applyInPandas(fit, "x double, fitted double")


def gl_consensus(spark: SparkSession, root: str) -> DataFrame:
    """Consensus location of each demand's messages: the mean at the finest resolution."""
    loc = table(spark, root, "message_locations").filter("lat is not null and lon is not null").select(clean_id(F.col("message_id")).alias("mid"), "lat", "lon", "resolution", "geo_confidence").distinct()
    rank = F.when(F.col("resolution") == "point", 0).when(F.col("resolution") == "building", 1).when(F.col("resolution") == "street", 2).when(F.col("resolution") == "ward", 3).otherwise(4)
    j = report_links(spark, root).join(loc, "mid").withColumn("o", rank)
    g = j.groupBy("demand_id", "o").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("geo_confidence").alias("best"), F.count(F.lit(1)).alias("k"))
    b = g.groupBy("demand_id").agg(F.min(F.struct("o", "lat", "lon", "best", "k")).alias("b"))
    conf = F.least(F.lit(0.97), F.col("b.best") + F.least(F.lit(0.12), 0.04 * (F.col("b.k") - 1)))
    return b.select("demand_id", F.col("b.o").alias("level"), F.round("b.lat", 8).alias("lat"), F.round("b.lon", 8).alias("lon"), F.round(conf, 6).alias("confidence"))


def z1_zone_totals(spark: SparkSession, root: str) -> DataFrame:
    """People in need by cell, what was served there, and the deficit."""
    d = _demands(spark, root).groupBy(F.coalesce("location.h3_cell", F.lit("unzoned")).alias("zone")).agg(F.coalesce(F.sum("need.people"), F.lit(0)).cast("bigint").alias("people"))
    s = table(spark, root, "served").distinct().groupBy(F.coalesce("zone", F.lit("unzoned")).alias("zone")).agg(F.coalesce(F.sum("people_committed"), F.lit(0)).cast("bigint").alias("served"))
    j = d.join(s, "zone", "left").withColumn("served", F.coalesce("served", F.lit(0)))
    return j.select("zone", "people", "served", F.when(F.col("people") > 0, F.round(1 - F.least(F.lit(1.0), F.col("served") / F.col("people")), 6)).otherwise(F.lit(0.0)).alias("deficit"))


def message_items(spark: SparkSession, root: str) -> DataFrame:
    """Located messages with need, headcount and time, as the pair gate takes them."""
    m = table(spark, root, "messages").filter("raw_text is not null and received_at is not null").dropDuplicates(["message_id"])
    return _located_items(spark, root, m).select("message_id", "us", "need_type", "people", "sure", "lat", "lon", "resolution")


def message_frames(spark: SparkSession, root: str) -> DataFrame:
    """As `message_items`, with the text, flags and urgency."""
    m = table(spark, root, "messages").filter("raw_text is not null and received_at is not null").dropDuplicates(["message_id"])
    return _located_items(spark, root, m)


def messages_read(spark: SparkSession, root: str) -> DataFrame:
    """As `message_frames`, of all messages and without their places."""
    return _read(table(spark, root, "messages").filter("raw_text is not null and received_at is not null").dropDuplicates(["message_id"]))


def _read(m: DataFrame) -> DataFrame:
    m = m.select("message_id", "raw_text", F.expr("unix_micros(cast(received_at as timestamp))").alias("us"), triage.extraction(F.col("raw_text")).alias("e"))
    return m.select("message_id", "raw_text", "us", "e.need.need_type", "e.head.people", (F.col("e.head.raw") >= 0.85).alias("sure"), "e.vuln.flags", "e.urgency.level")


def _located_items(spark: SparkSession, root: str, m: DataFrame) -> DataFrame:
    loc = table(spark, root, "message_locations").filter("lat is not null and lon is not null").select("message_id", "lat", "lon", "resolution").distinct()
    return _read(m).join(loc, "message_id")




def even(x: str, n: int) -> str:
    """`x` rounded to n places, ties to even, where a tie is told from what doubles make of it."""
    k = f"(({x}) * 1e{n})"
    return f"(case when abs({k} - floor({k}) - 0.5) < 1e-5 then floor({k}) + floor({k}) % 2 else round({k}) end / 1e{n})"


CLEAN = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
LINKS_SQL = f"(select * from (select distinct demand_id, {CLEAN.format('m')} mid from (select demand_id, unnest(source_message_ids) m from demands)) where mid <> '')"
_T = tq.SQL["t1_extract"].replace(tq._M, "(select message_id, any_value(raw_text) raw_text from messages where raw_text is not null and received_at is not null group by message_id)")
_R = f"""x as ({_T}), m as (select message_id, any_value(channel) channel, any_value(sender_hash) sender_hash, any_value(epoch_us(received_at)) at_us from messages where raw_text is not null and received_at is not null group by message_id),
l as {LINKS_SQL}, r as (select l.demand_id, m.*, x.* exclude (message_id) from l join m on l.mid = {CLEAN.format('m.message_id')} join x using (message_id))"""
_D = "(select * from (select *, row_number() over (partition by demand_id) rn_ from demands) where rn_ = 1)"


def _ent(by: str, out: str) -> str:
    return f"""{out} as (select demand_id, count(*) k, max(c) / sum(c) top, case when sum(c) <= 1 or count(*) <= 1 then 0.0 else (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) end h
 from (select demand_id, {by}, count(*) c from r group by 1, 2) group by 1)"""


GATE_SQL = f"""with x as ({_T}), m as (select message_id, any_value(epoch_us(received_at)) us from messages where raw_text is not null and received_at is not null group by message_id),
c as (select distinct message_id, lat, lon, resolution from message_locations where lat is not null and lon is not null),
i as (select message_id, us, need_type, people, people_raw >= 0.85 sure, lat, lon, case resolution when 'point' then 60 when 'building' then 180 when 'street' then 550 when 'ward' then 2600 end u from m join x using (message_id) join c using (message_id))
select distinct a.message_id as a, b.message_id as b from i a join i b on a.need_type = b.need_type and a.message_id < b.message_id and abs(a.us - b.us) <= 5400000000 and 180 + a.u + b.u <= 3000
 and abs(a.lat - b.lat) < 0.03 and (not (a.sure and b.sure and least(a.people, b.people) > 0) or greatest(a.people, b.people) <= 1.6::double * least(a.people, b.people))
 and 2*6371000*asin(least(1.0, sqrt(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lon-a.lon)/2),2)))) <= 180 + a.u + b.u"""

_FRAME = ("[" + ", ".join([f"(need_type = '{n}')::int::double" for n in triage.NEEDS] + [f"case when list_contains(string_split(flags, ','), '{f}') then 0.7 else 0.0 end" for f in ("disabled", "elderly", "infant", "injured", "pregnant")]
 + [f"case when level = '{x}' then 0.8 else 0.0 end" for x in ("none", "mild", "moderate", "critical")] + [f"case when floor(hb) = {k} then (1 - (hb - floor(hb))) * 0.9 when floor(hb) + 1 = {k} then (hb - floor(hb)) * 0.9 else 0.0 end" for k in range(4)]) + "]::double[]")
ITEMS_SQL = f"""with x as ({_T}), c as (select distinct message_id, lat, lon, resolution from message_locations where lat is not null and lon is not null)
select message_id, people, lat, lon, case resolution when 'point' then 60 when 'building' then 180 when 'street' then 550 when 'ward' then 2600 end u from x join c using (message_id)"""

ALIKE_SQL = f"""select a, b, cosine from (with gate as ({GATE_SQL}), x as ({_T}), ids as (select a message_id from gate union select b from gate),
t as (select message_id, ' ' || {tq._PN.format('any_value(raw_text)')} || ' ' t from messages where raw_text is not null and received_at is not null group by message_id),
g as (select message_id, unnest(list_concat(list_concat(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)), list_transform(range(1, greatest(length(t) - 2, 2)), lambda i: substr(t, i, 4))), list_transform(range(1, greatest(length(t) - 3, 2)), lambda i: substr(t, i, 5)))) g
 from t where message_id in (select message_id from ids)),
v as (select message_id, ('0x' || substr(md5(g), 1, 2))::int bucket, sum(case when substr(md5(g), 3, 1) < '8' then 1 else -1 end)::double s from g group by 1, 2),
d as (select message_id, list(coalesce(v.s, 0.0) order by n.bucket) w from (select message_id, bucket from ids, (select unnest(range(0, 256)) bucket)) n left join v using (message_id, bucket) group by 1),
f as (select message_id, {_FRAME} fr from (select *, least(3.0, ln(1 + people) / ln(60.0::double) * 4) hb from x)),
j as (select gate.a, gate.b, case when list_dot_product(x.w, x.w) > 0 and list_dot_product(y.w, y.w) > 0 then list_dot_product(x.w, y.w) / sqrt(list_dot_product(x.w, x.w)) / sqrt(list_dot_product(y.w, y.w)) else 0 end l,
 list_dot_product(p.fr, q.fr) / sqrt(list_dot_product(p.fr, p.fr)) / sqrt(list_dot_product(q.fr, q.fr)) s from gate join d x on x.message_id = gate.a join d y on y.message_id = gate.b join f p on p.message_id = gate.a join f q on q.message_id = gate.b)
select a, b, round((0.55::double * 0.55 * l + 0.75::double * 0.75 * s) / (0.55::double * 0.55 + 0.75::double * 0.75), 6) as cosine from j) where cosine >= 0.68"""

SQL = {
    "k1_trust_score": f"""with {_R}, {_ent('channel', 'ch')}, {_ent('sender_hash', 'se')}, {_ent('need_type', 'ne')},
b as (select demand_id, count(*) n, count(distinct sender_hash) s, min(at_us) t0, max(at_us) t1, min(people) p0, max(people) p1, avg(people) pm, (select max(epoch_us(received_at)) from messages) now_us from r group by 1),
c as (select b.demand_id, n as reports, s as senders, least(1.0, s / 3.0) corroboration, round_even(least(least(1.0, ch.k / 3), 0.45 * ch.h + 0.55 * se.h), 4) diversity,
 case when n < 2 then 1.0 else round_even(0.7 * ne.top + 0.3 * greatest(0.0, 1 - least(1.0, (p1 - p0) / pm / 2.5)), 4) end consistency,
 round_even(power(0.5, (now_us - t1) / 60e6 / 90), 4) freshness,
 case when n < 4 then 1.0 else round_even(greatest(0.05, 1 - (case when n / s >= 3 then least(0.55, 0.16 * (n / s - 2)) else 0.0 end + case when n / greatest(1.0, (t1 - t0) / 60e6) > 0.5 and s <= 2 then 0.25 else 0.0 end)), 4) end propagation
 from b join ch using (demand_id) join se using (demand_id) join ne using (demand_id)),
w as (select *, 0.28::double * corroboration + 0.24::double * diversity + 0.18::double * consistency + 0.22::double * freshness + 0.08::double * propagation raw from c)
select * exclude (raw), {even("least(1.0, greatest(0.0, case when senders = 1 and propagation > 0.6 then greatest(raw, 0.52::double * freshness) else raw end))", 4)} as trust from w""",
    "k7_redecayed": f"""with d as (select demand_id, trust_score, epoch_us(last_corroborated_at) u from {_D} where trust_score is not null and last_corroborated_at is not null)
select demand_id, round_even(greatest(0.05, trust_score * round_even(power(0.5, ((select max(u) from d) - u) / 60e6 / 90), 4)), 4) as trust from d""",
    "r1_need_vote": f"""with {_R}, v as (select demand_id, need_type, round(sum(need_type_raw), 6) w, min(message_id) f, max(need_type_raw) best, count(*) c from r group by 1, 2),
k as (select *, row_number() over (partition by demand_id order by w desc, f, need_type) rk, sum(w) over (partition by demand_id) tot, sum(c) over (partition by demand_id) n from v)
select demand_id, need_type, round(case when n > 1 then least(0.995, best * (0.80 + 0.20 * w / tot)) else best end, 5) as confidence from k where rk = 1""",
    "r2_headcount": f"""with {_R}, o as (select *, row_number() over (partition by demand_id order by people, message_id) - 1 k, count(*) over (partition by demand_id) n from r),
g as (select demand_id, max(case when k = n // 2 then people end) people, max(people_raw)::double best, min(people) lo, max(people) hi, max(n) n from o group by 1)
select demand_id, people, round(case when n > 1 then least(0.97, best * (0.72 + 0.28 * greatest(0.0, 1 - least(1.0, (hi - lo) / greatest(1, people) / 1.5)))) else best end, 5) as confidence from g""",
    "r3_flags": f"""with {_R}, c as (select demand_id, flag, count(*) c from (select demand_id, unnest(string_split(flags, ',')) flag from r where flags <> '') group by 1, 2)
select demand_id, string_agg(flag, ',' order by flag) as flags, max(c) as top_mentions from c group by 1""",
    "r4_urgency": f"""with {_R}, v as (select demand_id, need_type, round(sum(need_type_raw), 6) w, min(message_id) f from r group by 1, 2),
nv as (select demand_id, need_type from (select *, row_number() over (partition by demand_id order by w desc, f, need_type) rk from v) where rk = 1),
u as (select demand_id, level, urgency_raw, row_number() over (partition by demand_id order by case level when 'critical' then 3 when 'moderate' then 2 when 'mild' then 1 else 0 end desc, at_us, message_id) rk from r)
select u.demand_id as demand_id, level, urgency_raw::double as confidence, case when level in ('critical', 'moderate') or need_type in ('evacuation', 'missing_person') then 'escalating' else 'stable' end as decay_class
from u join nv using (demand_id) where rk = 1""",
    "c4_interval": f"""with d as (select demand_id, need.people p, quantity_confidence c from {_D} where need.people is not null and quantity_confidence is not null),
h as (select *, least(greatest((1 - c) * 1.05, 0.04), 0.95) hw from d), i as (select *, greatest(0, round_even(p * (1 - hw), 0)::int) lo, round_even(p * (1 + hw), 0)::int hi from h),
j as (select *, greatest(lo, hi) u0 from i), k as (select *, case when c < 0.9 and lo = u0 then u0 + 1 else u0 end u from j)
select demand_id, lo as lower, greatest(lo, least(p, u)) as point, u as upper from k""",
    "c2_unfitted": "select demand_id, " + ", ".join(f"round(least(greatest(0.5 + 0.6 * (field_confidence.{c} - 0.5), 0.05), 0.95), 6) as {c}" for c in ("need_type", "headcount", "vulnerability", "medical_urgency")) + f" from {_D} where field_confidence is not null",
    "c5_reliability": f"""select least(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: trust_score >= e::double)), 9)::int as bin, round(avg(trust_score), 4) as predicted, round(avg((status = 'resolved')::int), 4) as observed, count(*) as n
from {_D} where trust_score is not null and status is not null group by 1""",
    "c6_ece_brier": f"""with d as (select trust_score p, (status = 'resolved')::int y from {_D} where trust_score is not null and status is not null),
b as (select round(avg(p), 4) a, round(avg(y), 4) o, count(*) n from d group by len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: p >= e::double)))
select (select round(sum(n * abs(a - o)) / sum(n), 4) from b) as ece, (select round(avg(power(p - y, 2)), 4) from d) as brier""",
    "c1_isotonic": f"""with d as (select round(trust_score, 2) x, count(*) n, sum((status = 'resolved')::int) s from {_D} where trust_score is not null and status is not null group by 1),
p as (select x, row_number() over (order by x) i, sum(n) over (order by x) cn, sum(s) over (order by x) cs, n, s from d),
a as (select l.i i, h.i j, (h.cs - l.cs + l.s) / (h.cn - l.cn + l.n) v from p l join p h on h.i >= l.i),
m as (select k.i, max(w) f from p k join (select a.i i, q.i kk, min(a.v) w from a join p q on q.i >= a.i and q.i <= a.j group by 1, 2) z on z.kk = k.i group by 1)
select p.x as x, round(least(0.98, greatest(0.02, m.f)), 6) as fitted from p join m on p.i = m.i""",
    "gl_consensus": f"""with l as {LINKS_SQL},
c as (select distinct message_id, lat, lon, resolution, geo_confidence from message_locations where lat is not null and lon is not null),
g as (select demand_id, case resolution when 'point' then 0 when 'building' then 1 when 'street' then 2 when 'ward' then 3 else 4 end o, avg(lat) lat, avg(lon) lon, max(geo_confidence) best, count(*) k from l join c on l.mid = {CLEAN.format('c.message_id')} group by 1, 2),
b as (select *, row_number() over (partition by demand_id order by o) rk from g)
select demand_id, o as level, round(lat, 8) as lat, round(lon, 8) as lon, round(least(0.97, best + least(0.12, 0.04 * (k - 1))), 6) as confidence from b where rk = 1""",
    "z1_zone_totals": f"""with d as (select coalesce(location.h3_cell, 'unzoned') zone_, coalesce(sum(need.people), 0)::bigint people from {_D} group by 1),
s as (select coalesce(zone, 'unzoned') zone_, coalesce(sum(people_committed), 0)::bigint served from (select distinct * from served) group by 1)
select d.zone_ as zone, people, coalesce(served, 0) as served, case when people > 0 then round(1 - least(1.0, coalesce(served, 0) / people), 6) else 0.0 end as deficit from d left join s using (zone_)""",
}

QUERIES = {f.__name__: f for f in (k1_trust_score, k7_redecayed, r1_need_vote, r2_headcount, r3_flags, r4_urgency, c4_interval, c2_unfitted, c5_reliability, c6_ece_brier, c1_isotonic, gl_consensus, z1_zone_totals)}
