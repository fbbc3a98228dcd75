"""Evaluation metrics, windows, joins, set operations and views, as SQL over the tables.

Each text runs as it stands on Spark (tables are bound as parameters) and on
the comparison engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.tables import table

TABLES = ("messages", "message_locations", "demands", "served", "results", "gazetteer", "zones", "documents", "events", "customer", "orders", "nation", "region")
# Each row once, with the columns that a text mentions (see `_pruned`).
_S, _D = "@SERVED@", "@DEMANDS@"
SERVED = "run_id demand_id truth_id asset_id asset_type kind zone dispatched_at_min arrived_at_min people_committed people_actually_present is_hoax is_stale is_duplicate_visit".split()
DEMANDS = "need trust_score quantity_confidence status location first_reported_at last_corroborated_at escalation_weight".split()
_RES = "(select distinct run_id, lower(trim(policy)) as policy, people_in_need, people_reached, coverage, zone_gini, median_time_to_reach_min, sensing_seconds, messages, replans from results)"
_OK = "arrived_at_min is not null and not isnan(arrived_at_min) and arrived_at_min >= dispatched_at_min and arrived_at_min <> 99999e0"

_CLEAN = "lower(@STRIP@{0}))"
_L = f"(select * from (select distinct demand_id, {_CLEAN.format('explode_ids')} as mid from (select demand_id, @EXPLODE@ from demands) y) y2 where mid <> '')"

SQL = {
    # coverage of people by genuine first rescues, for each run
    "m2_coverage": f"""select s.run_id, cast(sum(case when kind = 'rescue' and not is_hoax and not is_duplicate_visit then least(people_committed, people_actually_present) else 0 end) as bigint) as reached,
 max(r.people_in_need) as people_in_need,
 round(least(1e0, sum(case when kind = 'rescue' and not is_hoax and not is_duplicate_visit then least(people_committed, people_actually_present) else 0 end) / max(r.people_in_need)), 6) as coverage
 from {_S} s join {_RES} r on s.run_id = r.run_id group by s.run_id""",
    # zones reached by rescues among the zones with demands
    "m6_zones_reached": f"""with d as (select distinct location.h3_cell as zone from {_D} x where location.h3_cell is not null), r as (select distinct run_id, zone from {_S} s where kind = 'rescue' and zone is not null)
select r.run_id, count(*) as zones, count(d.zone) as demanded_zones from r left join d on r.zone = d.zone group by r.run_id""",
    # mean of the worst quarter of zone coverages (W4)
    "m7_worst_quartile": f"""with z as (select run_id, zone, least(1e0, sum(people_actually_present) / cast(sum(people_committed) as double)) as f from {_S} s where zone is not null and people_committed > 0 and kind = 'rescue' group by run_id, zone),
k as (select *, row_number() over (partition by run_id order by f, zone) as i, count(*) over (partition by run_id) as n from z)
select run_id, max(n) as zones, round(avg(f), 6) as worst_quartile from k where i <= greatest(1, floor(n * 0.25e0)) group by run_id""",
    # Gini of zone coverage by position-weighted sums (W2)
    "m8_zone_gini": f"""with z as (select run_id, zone, least(1e0, sum(people_actually_present) / cast(sum(people_committed) as double)) as f from {_S} s where zone is not null and people_committed > 0 and kind = 'rescue' group by run_id, zone),
k as (select *, row_number() over (partition by run_id order by f, zone) as i, count(*) over (partition by run_id) as n from z)
select run_id, round(case when sum(f) = 0 then 1e0 else 2e0 * sum(i * f) / (max(n) * sum(f)) - (max(n) + 1e0) / max(n) end, 6) as gini from k group by run_id""",
    # exact median travel of rescues
    "m9_travel": f"select run_id, round(median(arrived_at_min - dispatched_at_min), 6) as median_travel, count(*) as n from {_S} s where kind = 'rescue' and {_OK} group by run_id",
    # time to the first assignment of each happening: median and nearest-rank 95th percentile (W3)
    "m10_first_assignment": f"""with f as (select run_id, truth_id, min(dispatched_at_min) as t from {_S} s where truth_id is not null and dispatched_at_min >= 0 group by run_id, truth_id),
k as (select *, row_number() over (partition by run_id order by t, truth_id) - 1 as i, count(*) over (partition by run_id) as n from f)
select run_id, round(median(t), 6) as median_t, round(max(case when i = least(n - 1, floor(n * 0.95e0)) then t end), 6) as p95_t from k group by run_id""",
    "m11_waste": f"""select run_id, count(case when is_hoax then 1 end) as hoax, count(case when is_duplicate_visit then 1 end) as duplicates, count(case when is_stale then 1 end) as stale,
 cast(sum(case when is_hoax or is_duplicate_visit then people_committed else 0 end) as bigint) as wasted_seats, cast(sum(greatest(0, people_committed - people_actually_present)) as bigint) as phantom_seats,
 round(count(case when is_hoax or is_duplicate_visit or is_stale then 1 end) / cast(count(*) as double), 6) as wasted_fraction from {_S} s group by run_id""",
    "m12_verification": f"""select run_id, count(case when kind = 'verification' then 1 end) as tasks,
 round(count(case when kind = 'verification' and is_hoax then 1 end) / cast(greatest(1, count(case when is_hoax then 1 end)) as double), 6) as hoax_catch from {_S} s group by run_id""",
    # pair precision and recall of demands against truths, in closed form (W11)
    "m13_dedup": f"""with p as (select distinct demand_id, truth_id, served_id from {_S} s where truth_id is not null),
ct as (select demand_id, truth_id, count(*) as n from p group by demand_id, truth_id), c as (select demand_id, sum(n) as n, count(*) as k from ct group by demand_id), t as (select truth_id, sum(n) as n from ct group by truth_id),
x as (select (select sum(n * (n - 1)) from ct) as tp, (select sum(n * (n - 1)) from c) as pred, (select sum(n * (n - 1)) from t) as true_pairs, (select count(case when k > 1 then 1 end) from c) as contaminated)
select round(tp / cast(greatest(1, pred) as double), 6) as p, round(tp / cast(greatest(1, true_pairs) as double), 6) as r, cast(contaminated as bigint) as contaminated from x""",
    # distance of locations from the centre of their recorded cell, by resolution
    "m14_geo_error": """with e as (select resolution, round(2e0 * 6371000 * asin(least(1e0, sqrt(power(sin(radians(z.centre_lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(z.centre_lat)) * power(sin(radians(z.centre_lon - l.lon) / 2), 2)))), 3) as m
 from (select distinct message_id, lat, lon, resolution, h3_cell from message_locations) l join zones z on l.h3_cell = z.h3_cell where l.lat is not null and l.lon is not null),
k as (select *, row_number() over (partition by resolution order by m) - 1 as i, count(*) over (partition by resolution) as n from e)
select resolution, max(n) as n, round(median(m), 3) as median_m, max(case when i = least(n - 1, floor(n * 0.9e0)) then m end) as p90_m from k group by resolution""",
    "m15_headcount_accuracy": f"""select status, count(*) as n, round(avg(case when need.people between need.people_lower and need.people_upper then 1e0 else 0e0 end), 6) as ordered_interval,
 round(avg(cast(need.people_upper - need.people_lower as double)), 6) as mean_width from {_D} d where need.people is not null and need.people_lower is not null and need.people_upper is not null group by status""",
    "m18_need_counts": f"select need.type as need_type, need.medical_urgency as urgency, count(*) as n, round(avg(trust_score), 6) as mean_trust from {_D} d where need is not null group by need.type, need.medical_urgency",
    # mean and population deviation of runs by policy
    "qp_ablation": f"select policy, count(*) as runs, round(avg(coverage), 6) as mean_coverage, round(stddev_pop(coverage), 6) as sd_coverage, round(avg(zone_gini), 6) as mean_gini from {_RES} r group by policy",
    "m17_throughput": f"select policy, round(sum(messages) / sum(sensing_seconds), 4) as messages_per_second, max(replans) as most_replans from {_RES} r where sensing_seconds > 0 group by policy",
    # visits after the first to one happening, in order of completion
    "w5_duplicate_visits": f"""select run_id, count(*) as visits, count(case when i > 1 then 1 end) as repeats from (select run_id, row_number() over (partition by run_id, truth_id order by arrived_at_min, served_id) as i from {_S} s where truth_id is not null and kind = 'rescue' and {_OK}) k group by run_id""",
    # reports of a demand that are visible at each arrival
    "w6_visible_prefix": f"""with l as (select distinct d.demand_id, m.message_id, m.received_at from {_L} d join (select distinct message_id, received_at from messages) m on d.mid = {_CLEAN.format("m.message_id")})
select demand_id, message_id, count(*) over (partition by demand_id order by received_at, message_id rows between unbounded preceding and current row) as visible from l""",
    # ten bins of trust, empty bins kept
    "w7_histogram": f"""with b as (select least(9, cast(floor(trust_score * 10) as int)) as bin from {_D} d where trust_score is not null and not isnan(trust_score)), all_bins as (select 0 as bin union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9)
select a.bin, count(b.bin) as n from all_bins a left join b on a.bin = b.bin group by a.bin""",
    # the queue: most trusted and escalated first, second page
    "w8_queue_page": f"select demand_id, round(trust_score * escalation_weight * need.people_lower, 6) as priority from {_D} d where trust_score is not null and escalation_weight is not null and need.people_lower is not null order by trust_score * escalation_weight * need.people_lower desc, demand_id limit 300 offset 300",
    "w9_best_of_zone": f"select zone, max_by(served_id, cast(people_committed as bigint) * 1000000000 - served_id) as served_id, max(people_committed) as people from {_S} s where zone is not null group by zone",
    "w10_last_events": f"select served_id, arrived_at_min from {_S} s where {_OK} order by arrived_at_min desc, served_id desc limit 40",
    "w12_zone_intersection": f"select zone from (select zone from {_S} s where zone is not null intersect select location.h3_cell as zone from {_D} d where location.h3_cell is not null) x",
    "w13_union": "select source, count(*) as n from (select 'message' as source, message_id as id from messages union all select 'demand', demand_id from demands union select 'served', cast(served_id as @STRING@) from served) u group by source",
    # nearest k by zone
    "j6_top_k": f"select * from (select zone, served_id, row_number() over (partition by zone order by arrived_at_min, served_id) as k from {_S} s where zone is not null and {_OK}) x where k <= 10",
    "j7_served_results": f"select r.policy, s.asset_type, count(*) as n, cast(sum(people_committed) as bigint) as people from {_S} s left join {_RES} r on s.run_id = r.run_id group by r.policy, s.asset_type",
    "j8_provenance": f"""select d.demand_id, count(m.message_id) as found, count(*) as listed, min(m.received_at) as first_received from {_L} d
 left join (select distinct message_id, received_at from messages) m on d.mid = {_CLEAN.format("m.message_id")} group by d.demand_id""",
    "j11_unserved": f"select status, count(*) as n from {_D} d where not exists (select 1 from served s where s.demand_id = d.demand_id) group by status",
    "j11_served": f"select status, count(*) as n from {_D} d where exists (select 1 from served s where s.demand_id = d.demand_id and s.kind = 'rescue') group by status",
    # reports visible at each tick of a clock (as-of counts, X1 and J12)
    "x1_visible_at_ticks": """with m as (select distinct message_id, received_at from messages where received_at is not null), t as (select min(received_at) as t0 from m), z as (select @TICK@ as last from (select max(received_at) as received_at, min(received_at) as t0 from m) y), k as (select @TICKS@ as tick from z),
b as (select @TICK@ as tick, count(*) as n from m cross join t group by 1)
select k.tick, cast(coalesce(sum(b.n) over (order by k.tick), 0) as bigint) as visible from k left join b on b.tick = k.tick""",
    "qa_demand_page": f"""select demand_id, status, need.type as need_type, trust_score from {_D} d where status in ('unassigned', 'verifying') and need.type = 'medical' and quantity_confidence between 0.2e0 and 0.9e0 and trust_score >= 0.3e0
 order by trust_score desc, demand_id limit 300""",
    "qe_facets": f"""select status, location.resolution as resolution, count(*) as n, count(case when quantity_confidence < 0.55e0 then 1 end) as unsure, count(case when trust_score < 0.4e0 then 1 end) as doubted from {_D} d group by status, location.resolution""",
    "qk_summary": """select count(*) as demand_rows, count(distinct demand_id) as demands, (select count(distinct message_id) from messages) as messages, round((select count(distinct message_id) from messages) / cast(count(distinct demand_id) as double), 6) as collapse from demands""",
    # beyond the surveyed operators
    "b1_rollup": f"select need.type as need_type, status, count(*) as n from {_D} d where need.type is not null and status is not null group by rollup (need.type, status)",
    "b2_cube": f"select kind, asset_type, grouping(kind) as g_kind, count(*) as n from {_S} s group by cube (kind, asset_type)",
    "b3_gaps": "select user_id, count(*) as n, count(case when event_id - before > 150 then 1 end) as gaps from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as before from events) x group by user_id",
    "b4_ntile": f"select quarter, count(*) as n, round(min(trust_score), 6) as lo, round(max(trust_score), 6) as hi from (select trust_score, ntile(4) over (order by trust_score, demand_id) as quarter from {_D} d where trust_score is not null) x group by quarter",
    "b5_except": "select count(*) as missing from (select message_id from messages except select message_id from message_locations) x",
    "b6_star_join": "select r.r_name, n.n_name, count(*) as orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where o.o_orderstatus = 'F' group by r.r_name, n.n_name",
    "b7_tumbling": "select event_type, @HOUR@ as hour, count(*) as n, round(sum(value), 4) as total from events group by event_type, @HOUR@",
}

SPARK = {"@EXPLODE@": "explode(source_message_ids) as explode_ids", "@STRING@": "string", "@STRIP@": "trim(both ' \t\r\n' from ", "@TICKS@": "explode(sequence(0, last))", "@TICK@": "cast(ceil((unix_micros(cast(received_at as timestamp)) - unix_micros(cast(t0 as timestamp))) / 900e6) as int)", "@HOUR@": "cast(date_trunc('hour', ts) as timestamp_ntz)"}
OTHER = {"@EXPLODE@": "unnest(source_message_ids) as explode_ids", "@STRING@": "varchar", "@STRIP@": "trim(", "@TICKS@": "unnest(range(0, last + 1))", "@TICK@": "cast(ceil((epoch_us(received_at) - epoch_us(t0)) / 900e6) as int)", "@HOUR@": "date_trunc('hour', ts)"}


def _pruned(sql: str) -> str:
    """Distinct rows of served and demands with no more columns than the text needs."""
    for mark, key, cols, source in (("@SERVED@", "served_id", SERVED, "served"), ("@DEMANDS@", "demand_id", DEMANDS, "demands")):
        used = [key, *(c for c in cols if re.search(rf"\b{c}\b", sql))]
        sql = sql.replace(mark, f"(select distinct {', '.join(used)} from {source})")
    return sql


def _bind(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = _bind(SQL_TEXT[name], SPARK)
    used = [t for t in TABLES if re.search(rf"(?:from|join)\s+{t}\b", sql)]
    text = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", sql)

    def run(spark: SparkSession, root: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, root, t) for t in used})

    run.__name__ = name
    return run


SQL_TEXT = {n: _pruned(s) for n, s in SQL.items()}
QUERIES = {n: _query(n) for n in SQL_TEXT}
SQL = {n: _bind(s, OTHER) for n, s in SQL_TEXT.items()}
