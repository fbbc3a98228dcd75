"""Whole demand records, snapshots as of a time, and the console's views of demands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import triage, trust
from tidewright.operators import reconcile
from tidewright.plans import demand_queries as dq
from tidewright.plans import graph_queries
from tidewright.session import cut
from tidewright.sources.tables import table

TICK_US = 900_000_000
# Urgency by level and by need, on a scale from 1 to 10.
URGENCY_BASE = {"critical": 9.0, "moderate": 6.5, "mild": 4.5, "none": 3.0}
NEED_FLOOR = {"evacuation": 5.0, "medical": 5.5, "missing_person": 5.0, "water": 3.5, "food": 2.5, "shelter": 3.0, "sanitation": 2.0, "infrastructure": 2.0}
# Minutes within which a need must be met, by urgency and in general, and weights of urgency.
WINDOWS = {("medical", "critical"): 60.0, ("medical", "moderate"): 120.0, ("medical", "mild"): 240.0, ("evacuation", "critical"): 60.0, ("evacuation", "moderate"): 120.0}
NEED_WINDOW = {"evacuation": 180.0, "medical": 180.0, "missing_person": 240.0, "water": 360.0, "food": 480.0, "shelter": 480.0, "sanitation": 720.0, "infrastructure": 720.0}
WEIGHTS = {"critical": 4.0, "moderate": 2.2, "mild": 1.4, "none": 1.0}
# How a map may draw a place of a resolution.
RENDER = {"point": "pin", "building": "pin", "street": "circle", "ward": "hex"}


def _pick(c: Column, values: dict[str, float | str], other: float | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], F.lit(other))


def _last_us(spark: SparkSession, root: str) -> int:
    return table(spark, root, "messages").agg(F.max(F.expr("unix_micros(cast(received_at as timestamp))")).alias("x")).first()["x"]


def _flat(r: DataFrame, group: str) -> DataFrame:
    us = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return r.select(
        group, "duplicate_collapse_count", F.col("need.type").alias("need_type"), "need.people", "need.people_lower", "need.people_upper", F.array_join("need.vulnerability_flags", ",").alias("flags"), "need.medical_urgency",
        F.col("field_confidence.need_type").alias("need_confidence"), F.col("field_confidence.headcount").alias("headcount_confidence"), F.col("field_confidence.vulnerability").alias("vulnerability_confidence"),
        F.col("field_confidence.medical_urgency").alias("urgency_confidence"), "quantity_confidence", "trust_score", us("first_us").alias("first_reported_at"), us("last_us").alias("last_corroborated_at"),
        "time_decay_class", F.array_join("channels", ",").alias("channels"), F.size("raw_texts").alias("n_texts"), F.md5(F.array_join("raw_texts", "\n")).alias("texts_md5"),
    )


def r5_records(spark: SparkSession, root: str) -> DataFrame:
    """The record that each demand's reports amount to, as of the last message."""
    r = cut(dq._reports(spark, root), "reports")
    return _flat(reconcile.records(r, "demand_id", F.lit(_last_us(spark, root))), "demand_id")


def r5_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """From messages to records in one plan: reports are clustered, and each cluster becomes a record."""
    read = cut(dq.message_reports(spark, root), "messages")  # texts are parsed once
    m = read.select("message_id", "raw_text", F.col("at").alias("us"), "need_type", "people", (F.col("people_raw") >= 0.85).alias("sure"), "flags", "level")
    of = cut(graph_queries.clustered(spark, root, m), "clusters")
    r = read.join(of.select(F.col("node").alias("message_id"), "cluster"), "message_id")
    return _flat(reconcile.records(cut(r, "reports"), "cluster", F.lit(_last_us(spark, root))), "cluster")


def x2_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Each demand at each tick of a quarter of an hour at which more of its reports are visible than before: reports, senders, trust as of the tick, and escalation by the hours since the first report."""
    r = dq._reports(spark, root)
    t0 = table(spark, root, "messages").agg(F.min(F.expr("unix_micros(cast(received_at as timestamp))")).alias("x")).first()["x"] or 0
    state = cut(trust.running(r, "demand_id"), "running").withColumn("tick", F.ceil((F.col("at") - F.lit(t0)) / TICK_US).cast("int"))
    names = ["message_id", "reports", "senders", "t0", "t1", "p0", "p1", "pm", "pn", "ch_k", "ch_h", "se_h", "ne_top"]
    last = state.groupBy("demand_id", "tick").agg(F.max_by(F.struct(*names), "reports").alias("s")).select("demand_id", "tick", "s.*")
    now = F.lit(t0) + F.col("tick").cast("bigint") * TICK_US
    g = trust.graded(last, ["demand_id", "tick", "t0"], now)
    hours = (F.lit(t0) + F.col("tick").cast("bigint") * TICK_US - F.col("t0")) / 3.6e9
    return g.select("demand_id", "tick", "reports", "senders", "trust", F.round(F.least(F.lit(3.0), 1 + 0.35 * hours), 6).alias("escalation"))


def x4_verified(spark: SparkSession, root: str) -> DataFrame:
    """Demands that a verification was sent to: confidence, trust and interval as raised by it."""
    v = table(spark, root, "served").filter("kind = 'verification'").select("demand_id").distinct()
    d = dq._demands(spark, root).filter("quantity_confidence is not null and trust_score is not null and need.people is not null").join(v, "demand_id", "left_semi")
    c = F.least(F.lit(0.95), F.col("quantity_confidence") + 0.30)
    d = d.select("demand_id", c.alias("c"), F.least(F.lit(1.0), F.col("trust_score") + 0.25).alias("t"), triage.interval(F.col("need.people"), c).alias("i"))
    return d.select("demand_id", F.round("c", 6).alias("quantity_confidence"), F.round("t", 6).alias("trust_score"), "i.lower", "i.point", "i.upper")


def c3_bypassed(spark: SparkSession, root: str) -> DataFrame:
    """Field confidences where no calibration is used: clipped and rounded."""
    d = dq._demands(spark, root).filter("field_confidence is not null")
    clip = lambda c: F.bround(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(f"field_confidence.{c}"))), 4).alias(c)
    return d.select("demand_id", *[clip(c) for c in ("need_type", "headcount", "vulnerability", "medical_urgency")])


def urgency_score(need: Column, escalation: Column) -> Column:
    base = F.greatest(_pick(need["medical_urgency"], URGENCY_BASE, 3.0), _pick(need["type"], NEED_FLOOR, 2.0))
    base = base + F.least(F.lit(1.2), 0.4 * F.greatest(F.lit(0), F.coalesce(F.size(need["vulnerability_flags"]), F.lit(0)))) + F.least(F.lit(1.5), (F.coalesce(escalation, F.lit(1.0)) - 1.0) * 1.2)
    return F.bround(F.greatest(F.lit(1.0), F.least(F.lit(10.0), base)), 1)


def urgency_window(need: Column) -> Column:
    out = _pick(need["type"], NEED_WINDOW, 360.0)
    for (n, u), minutes in WINDOWS.items():
        out = F.when((need["type"] == n) & (need["medical_urgency"] == u), F.lit(minutes)).otherwise(out)
    return out


def qc_urgency(spark: SparkSession, root: str) -> DataFrame:
    """Urgency of each demand from 1 to 10, and its band."""
    d = dq._demands(spark, root).filter("need is not null").select("demand_id", urgency_score(F.col("need"), F.col("escalation_weight")).alias("urgency_score"))
    return d.withColumn("band", F.when(F.col("urgency_score") >= 8, "critical").when(F.col("urgency_score") >= 4, "moderate").otherwise("low"))


def qd_rows(spark: SparkSession, root: str) -> DataFrame:
    """Demands as rows of a console: how the map may draw them, minutes since the last report, first text."""
    d = dq._demands(spark, root)
    us = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    render = F.when(F.col("location").isNotNull(), _pick(F.col("location.resolution"), RENDER, "list_only"))
    stale = F.bround((F.lit(_last_us(spark, root)) - us("last_corroborated_at")) / 60e6, 1)
    return d.select(
        "demand_id", "status", F.col("need.type").alias("need_type"), F.col("location.resolution").alias("resolution"), render.alias("render_as"), stale.alias("staleness_minutes"),
        F.bround("escalation_weight", 2).alias("escalation_weight"), F.substring(F.try_element_at("raw_texts", F.lit(1)), 1, 160).alias("preview"),
    )


def qa_search(spark: SparkSession, root: str) -> DataFrame:
    """A search over demands as a console makes it: filters, a word in id, method or texts, by trust and id, first page, with the totals beside it."""
    d = dq._demands(spark, root)
    text = F.lower(F.concat_ws(" ", "demand_id", "location.method", F.array_join(F.coalesce("raw_texts", F.array().cast("array<string>")), " ")))
    hit = d.filter(F.col("status").isin("unassigned", "assigned") & (F.col("quantity_confidence") >= 0.2) & (F.col("trust_score") >= 0.1) & F.contains(text, F.lit("water")))
    totals = hit.agg(F.count(F.lit(1)).alias("total")).crossJoin(d.agg(F.count(F.lit(1)).alias("total_unfiltered"), F.count_if(F.col("status") == "unassigned").alias("unassigned")))  # single rows
    page = hit.select("demand_id", "trust_score", "status").orderBy(F.desc("trust_score"), "demand_id").limit(300)
    return page.crossJoin(F.broadcast(totals))


def qf_detail(spark: SparkSession, root: str) -> DataFrame:
    """Each demand with its provenance and what was sent to it: reports found, their spread in time, visits, the last visit and its asset."""
    links = dq.report_links(spark, root)
    m = table(spark, root, "messages").select(dq.clean_id(F.col("message_id")).alias("mid"), "received_at", "channel").dropDuplicates(["mid"])
    p = links.join(m, "mid").groupBy("demand_id").agg(F.count(F.lit(1)).alias("reports"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.countDistinct("channel").alias("n_channels"))
    s = table(spark, root, "served").select("served_id", "demand_id", "asset_id", "kind").distinct().groupBy("demand_id").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(F.col("kind") == "rescue").alias("rescues"), F.max(F.struct("served_id", "asset_id")).alias("l")
    )
    d = dq._demands(spark, root).select("demand_id", F.coalesce(F.col("location.resolution") == "unknown", F.lit(False)).alias("needs_place"))
    j = d.join(p, "demand_id", "left").join(s, "demand_id", "left")
    return j.select("demand_id", "needs_place", F.coalesce("reports", F.lit(0)).alias("reports"), "first_at", "last_at", F.coalesce("n_channels", F.lit(0)).alias("n_channels"), F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("rescues", F.lit(0)).alias("rescues"), F.col("l.asset_id").alias("last_asset"))


def m1_windows(spark: SparkSession, root: str) -> DataFrame:
    """Minutes within which each demand must be met."""
    return dq._demands(spark, root).filter("need is not null").select("demand_id", urgency_window(F.col("need")).alias("window_min"))


def m3_in_window(spark: SparkSession, root: str) -> DataFrame:
    """For each run, the people reached: within their window, of urgent demands within it, and by weight of urgency, as parts of all. Onset is the first report, in minutes since the first of all."""
    d = dq._demands(spark, root).filter("need.people > 0").select("demand_id", "need", F.expr("unix_micros(cast(first_reported_at as timestamp))").alias("f"))
    d = d.select("demand_id", F.col("need.people").alias("p"), urgency_window(F.col("need")).alias("w"), F.col("need.medical_urgency").alias("u"), _pick(F.col("need.medical_urgency"), WEIGHTS, 1.0).alias("k"), "f")
    d = cut(d, "needs")
    urgent = F.coalesce(F.col("u").isin("critical", "moderate"), F.lit(False))
    t = d.agg(F.sum("p").alias("all"), F.sum(F.when(urgent, F.col("p")).otherwise(0)).alias("urgent"), F.sum(F.col("p") * F.col("k")).alias("weighted"), F.min("f").alias("f0")).first()
    s = table(spark, root, "served").select("served_id", "run_id", "demand_id", "kind", "is_hoax", "is_duplicate_visit", "arrived_at_min", "people_committed").distinct()
    s = s.filter("kind = 'rescue' and not is_hoax and not is_duplicate_visit and people_committed is not null").join(d, "demand_id")
    n = F.least("people_committed", "p")
    onset = (F.col("f") - F.lit(t["f0"])) / 60e6
    at = F.when(~F.isnan("arrived_at_min"), F.col("arrived_at_min"))
    ok = F.coalesce(at - onset <= F.col("w"), F.lit(False))
    part = lambda x, of: F.round(F.least(F.lit(1.0), F.sum(x) / F.lit(float(t[of] or 1))), 6)
    return s.groupBy("run_id").agg(
        part(F.when(ok, n).otherwise(0), "all").alias("in_window"), part(F.when(ok & urgent, n).otherwise(0), "urgent").alias("urgent_in_window"), part(n * F.col("k"), "weighted").alias("weighted_coverage")
    )


def gh_attached(spark: SparkSession, root: str) -> DataFrame:
    """Locations where only what is attached counts."""
    from tidewright.functions import geo

    m = table(spark, root, "messages").dropDuplicates(["message_id"])
    c = F.coalesce(geo.attached(F.col("attached_geo")), geo.located(F.lit(9.62), F.lit(76.48), F.lit("unknown"), F.lit(0.0), "unknown"))
    return m.select("message_id", c.alias("c")).select("message_id", "c.*")


def n8_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """The words that corrections may choose: common words of the messages and all words of the gazetteer."""
    from tidewright.functions import text
    from tidewright.plans import text_queries as tq

    v = tq._vocabulary(cut(tq._messages(spark, root), "texts")).select("word")
    g = table(spark, root, "gazetteer").select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return v.unionByName(g.select(F.explode(text.words(F.col("n"))).alias("word"))).distinct()


def _map_sql(c: str, values: dict, other: float | str) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::double"
    return f"case {c} " + " ".join(f"when '{k}' then {q(v)}" for k, v in values.items()) + f" else {q(other)} end"


_UNF = "least(greatest(0.5 + 0.6::double * ({0} - 0.5), 0.05), 0.95)"
_NOW = "(select max(epoch_us(received_at)) from messages)"
_T0 = "(select min(epoch_us(received_at)) from messages)"
_LEVEL = "case level when 'critical' then 3 when 'moderate' then 2 when 'mild' then 1 else 0 end"
_WINDOW = "case " + " ".join(f"when need.type = '{n}' and need.medical_urgency = '{u}' then {m}::double" for (n, u), m in WINDOWS.items()) + f" else {_map_sql('need.type', NEED_WINDOW, 360.0)} end"
SQL = {
    "r5_records": f"""with {dq._R}, tr as ({dq.SQL['k1_trust_score']}), v as (select demand_id, need_type, round(sum(need_type_raw), 6)::double w, min({{'at': at_us, 'm': message_id}}) f, max(need_type_raw)::double best, count(*) c from r group by 1, 2),
k as (select *, row_number() over (partition by demand_id order by w desc, f, need_type) rk, sum(w) over (partition by demand_id) tot, sum(c) over (partition by demand_id) n from v),
nd as (select demand_id, need_type, case when n > 1 then least(0.995, best * (0.80 + 0.20::double * w / tot)) else best end conf from k where rk = 1),
o as (select r.*, row_number() over (partition by r.demand_id order by people) - 1 i, count(*) over (partition by r.demand_id) n from r join nd on nd.demand_id = r.demand_id and nd.need_type = r.need_type),
h as (select demand_id, max(case when i = n // 2 then people end) people, max(people_raw)::double best, min(people) lo, max(people) hi, max(n) n from o group by 1),
hc as (select demand_id, people, case when n > 1 then least(0.97, best * (0.72 + 0.28::double * greatest(0.0, 1 - least(1.0, (hi - lo) / greatest(1, people) / 1.5)))) else best end raw from h),
fc as (select demand_id, flag, count(*) c from (select demand_id, unnest(string_split(flags, ',')) flag from r where flags <> '') group by 1, 2),
fl as (select demand_id, string_agg(flag, ',' order by flag) flags, max(c) most from fc group by 1),
ur as (select demand_id, level, urgency_raw::double raw from (select *, row_number() over (partition by demand_id order by {_LEVEL} desc, at_us, message_id) rk from r) where rk = 1),
tx as (select demand_id, count(*) n_texts, md5(string_agg(raw_text, chr(10) order by at_us, message_id)) texts_md5 from (select r.*, any_m.raw_text, row_number() over (partition by demand_id order by at_us, message_id) k from r
 join (select message_id, any_value(raw_text) raw_text from messages group by 1) any_m using (message_id)) where k <= 8 group by 1),
b as (select demand_id, count(*) n, count(distinct sender_hash) s, min(at_us) t0, max(at_us) t1, string_agg(distinct channel, ',' order by channel) channels, max(vulnerability_raw)::double vr from r group by 1),
z as (select *, least(0.97, {_UNF.format('raw')} * (1.0 + 0.06::double * least(3, s - 1))) q from b join hc using (demand_id)),
i as (select *, least(greatest((1 - q) * 1.05, 0.04), 0.95) hw from z), j as (select *, greatest(0, round_even(people * (1 - hw), 0)::int) lo, round_even(people * (1 + hw), 0)::int hi from i),
ub as (select *, greatest(lo, hi) u0 from j), y as (select *, case when q < 0.9 and lo = u0 then u0 + 1 else u0 end up from ub)
select y.demand_id as demand_id, n as duplicate_collapse_count, nd.need_type as need_type, greatest(lo, least(people, up)) as people, lo as people_lower, up as people_upper, coalesce(fl.flags, '') as flags, ur.level as medical_urgency,
 round({_UNF.format('nd.conf')}, 6) as need_confidence, round({_UNF.format('y.raw')}, 6) as headcount_confidence, round({_UNF.format("(case when fl.flags is not null and n > 1 then least(0.96, vr + 0.05::double * (most - 1)) else vr end)")}, 6) as vulnerability_confidence,
 round({_UNF.format('ur.raw')}, 6) as urgency_confidence, {dq.even('q', 4)} as quantity_confidence, tr.trust as trust_score, make_timestamp(t0) as first_reported_at, make_timestamp(t1) as last_corroborated_at,
 case when ur.level in ('critical', 'moderate') or nd.need_type in ('evacuation', 'missing_person') then 'escalating' else 'stable' end as time_decay_class, channels, n_texts::int as n_texts, texts_md5
 from y join nd using (demand_id) join ur using (demand_id) join tx using (demand_id) join tr using (demand_id) left join fl using (demand_id)""",
    "x2_snapshots": f"""with {dq._R}, tk as (select *, ceil((at_us - {_T0}) / 900000000.0)::int tick from r), ts as (select distinct demand_id, tick from tk),
vis as (select a.demand_id, a.tick, b.* exclude (demand_id, tick) from ts a join tk b on a.demand_id = b.demand_id and b.tick <= a.tick),
e as (select demand_id, tick, count(*) reports, count(distinct sender_hash) senders, count(distinct channel) ch_k, min(at_us) t0, max(at_us) t1, min(people) p0, max(people) p1, avg(people) pm from vis group by 1, 2),
ch as (select demand_id, tick, case when sum(c) <= 1 or count(*) <= 1 then 0.0 else (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) end h from (select demand_id, tick, channel, count(*) c from vis group by 1, 2, 3) group by 1, 2),
se as (select demand_id, tick, case when sum(c) <= 1 or count(*) <= 1 then 0.0 else (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) end h from (select demand_id, tick, sender_hash, count(*) c from vis group by 1, 2, 3) group by 1, 2),
ne as (select demand_id, tick, max(c) / sum(c) top from (select demand_id, tick, need_type, count(*) c from vis group by 1, 2, 3) group by 1, 2),
c as (select e.*, least(1.0, senders / 3.0) corroboration, round_even(least(least(1.0, ch_k / 3), 0.45 * ch.h + 0.55 * se.h), 4) diversity,
 case when reports < 2 then 1.0 else round_even(0.7 * ne.top + 0.3 * greatest(0.0, 1 - least(1.0, (p1 - p0) / pm / 2.5)), 4) end consistency, round_even(power(0.5, greatest(0.0, {_T0} + tick::bigint * 900000000 - t1) / 60e6 / 90), 4) freshness,
 case when reports < 4 then 1.0 else round_even(greatest(0.05, 1 - (case when reports / senders >= 3 then least(0.55, 0.16 * (reports / senders - 2)) else 0.0 end + case when reports / greatest(1.0, (t1 - t0) / 60e6) > 0.5 and senders <= 2 then 0.25 else 0.0 end)), 4) end propagation
 from e join ch using (demand_id, tick) join se using (demand_id, tick) join ne using (demand_id, tick)),
w as (select *, 0.28::double * corroboration + 0.24::double * diversity + 0.18::double * consistency + 0.22::double * freshness + 0.08::double * propagation raw from c)
select demand_id, tick, reports, senders, {dq.even("least(1.0, greatest(0.0, case when senders = 1 and propagation > 0.6 then greatest(raw, 0.52::double * freshness) else raw end))", 4)} as trust,
 round(least(3.0, 1 + 0.35 * ({_T0} + tick::bigint * 900000000 - t0) / 3.6e9), 6) as escalation from w""",
    "x4_verified": f"""with d as (select demand_id, need.people p, least(0.95, quantity_confidence + 0.30::double) c, least(1.0, trust_score + 0.25::double) t from {dq._D} where quantity_confidence is not null and trust_score is not null and need.people is not null
 and demand_id in (select demand_id from served where kind = 'verification')),
h as (select *, least(greatest((1 - c) * 1.05, 0.04), 0.95) hw from d), i as (select *, greatest(0, round_even(p * (1 - hw), 0)::int) lo, round_even(p * (1 + hw), 0)::int hi from h),
j as (select *, greatest(lo, hi) u0 from i), k as (select *, case when c < 0.9 and lo = u0 then u0 + 1 else u0 end u from j)
select demand_id, round(c, 6) as quantity_confidence, round(t, 6) as trust_score, lo as lower, greatest(lo, least(p, u)) as point, u as upper from k""",
    "c3_bypassed": "select demand_id, " + ", ".join(f"round_even(greatest(0.01, least(0.99, field_confidence.{c})), 4) as {c}" for c in ("need_type", "headcount", "vulnerability", "medical_urgency")) + f" from {dq._D} where field_confidence is not null",
    "qc_urgency": f"""with s as (select demand_id, round_even(greatest(1.0, least(10.0, greatest({_map_sql('need.medical_urgency', URGENCY_BASE, 3.0)}, {_map_sql('need.type', NEED_FLOOR, 2.0)})
 + least(1.2, 0.4::double * coalesce(len(need.vulnerability_flags), 0)) + least(1.5, (coalesce(escalation_weight, 1.0) - 1.0) * 1.2))), 1) as urgency_score from {dq._D} where need is not null)
select *, case when urgency_score >= 8 then 'critical' when urgency_score >= 4 then 'moderate' else 'low' end as band from s""",
    "qd_rows": f"""select demand_id, status, need.type as need_type, location.resolution as resolution, case when location is not null then {_map_sql('location.resolution', RENDER, 'list_only')} end as render_as,
 {dq.even(f'({_NOW} - epoch_us(last_corroborated_at)) / 60e6', 1)} as staleness_minutes, {dq.even('escalation_weight', 2)} as escalation_weight, substr(raw_texts[1], 1, 160) as preview from {dq._D}""",
    "qa_search": f"""with d as {dq._D}, h as (select * from d where status in ('unassigned', 'assigned') and quantity_confidence >= 0.2 and trust_score >= 0.1
 and contains(lower(concat_ws(' ', demand_id, location.method, array_to_string(coalesce(raw_texts, []), ' '))), 'water'))
select demand_id, trust_score, status, (select count(*) from h) as total, (select count(*) from d) as total_unfiltered, (select count(*) from d where status = 'unassigned') as unassigned from h order by trust_score desc, demand_id limit 300""",
    "qf_detail": f"""with p as (select demand_id, count(*) reports, min(received_at) first_at, max(received_at) last_at, count(distinct channel) n_channels from {dq.LINKS_SQL} l
 join (select {dq.CLEAN.format('message_id')} mid, any_value(received_at) received_at, any_value(channel) channel from messages group by 1) m using (mid) group by 1),
s as (select demand_id, count(*) visits, count(case when kind = 'rescue' then 1 end) rescues, max_by(asset_id, served_id) last_asset from (select distinct * from served) group by 1)
select d.demand_id as demand_id, coalesce(location.resolution = 'unknown', false) as needs_place, coalesce(reports, 0) as reports, first_at, last_at, coalesce(n_channels, 0) as n_channels, coalesce(visits, 0) as visits, coalesce(rescues, 0) as rescues, last_asset
 from {dq._D} d left join p using (demand_id) left join s using (demand_id)""",
    "m1_windows": f"select demand_id, {_WINDOW} as window_min from {dq._D} where need is not null",
    "m3_in_window": f"""with d as (select demand_id, need.people p, {_WINDOW} w, need.medical_urgency u, {_map_sql('need.medical_urgency', WEIGHTS, 1.0)} k, epoch_us(first_reported_at) f from {dq._D} where need.people > 0),
t as (select sum(p) a, sum(case when u in ('critical', 'moderate') then p else 0 end) g, sum(p * k) x, min(f) f0 from d),
s as (select run_id, least(people_committed, p) n, k, coalesce(u in ('critical', 'moderate'), false) g, coalesce(not isnan(arrived_at_min) and arrived_at_min - (f - (select f0 from t)) / 60e6 <= w, false) ok
 from (select distinct * from served) join d using (demand_id) where kind = 'rescue' and not is_hoax and not is_duplicate_visit and people_committed is not null)
select run_id, round(least(1.0, sum(case when ok then n else 0 end) / (select a from t)), 6) as in_window, round(least(1.0, sum(case when ok and g then n else 0 end) / (select g from t)), 6) as urgent_in_window,
 round(least(1.0, sum(n * k) / (select x from t)), 6) as weighted_coverage from s group by run_id""",
    "gh_attached": """select message_id, case when att then a.lat else 9.62 end as lat, case when att then a.lon else 76.48 end as lon, case when not att then 'unknown' when acc <= 50 then 'point' when acc <= 150 then 'building' when acc <= 600 then 'street' else 'ward' end as resolution,
 (case when not att then 0.0 when acc <= 50 then 0.95 when acc <= 150 then 0.86 when acc <= 600 then 0.66 when acc <= 2500 then 0.42 else 0.28 end)::double as confidence, case when att then 'attached_geo' else 'unknown' end as method
 from (select message_id, a, coalesce(a.accuracy_m, 100) acc, coalesce(a.lat is not null and a.lon is not null, false) att from (select message_id, any_value(attached_geo) a from messages group by 1))""",
    "n8_vocabulary": """with w as (select message_id, unnest(list_distinct(regexp_extract_all(lower(raw_text), '([a-z]+)', 1))) word from (select distinct message_id, raw_text from messages where raw_text is not null)),
g as (select unnest(list_concat([name], coalesce(aliases, []))) n from gazetteer)
select word from w group by word having length(word) >= 2 and count(*) * 200 >= (select count(*) from (select distinct message_id, raw_text from messages where raw_text is not null)) union select unnest(regexp_extract_all(lower(n), '([a-z]+)', 1)) from g""",
}

QUERIES = {f.__name__: f for f in (r5_records, r5_pipeline, x2_snapshots, x4_verified, c3_bypassed, qc_urgency, qd_rows, qa_search, qf_detail, m1_windows, m3_in_window, gh_attached, n8_vocabulary)}
