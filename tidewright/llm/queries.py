"""Queries of the text and training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import language, lookalike, mixing, neardup, packing, personal, ranks, spam, survivors, tokens
from tidewright.session import bounded_sample, cut, small
from tidewright.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of messages whose texts look the same but differ in code points."""
    pairs = lookalike.alike_pairs(table(spark, root, "messages"))
    return pairs.select(F.col("a").alias("message_id_a"), F.col("b").alias("message_id_b"))


def p1_normalized(spark: SparkSession, root: str) -> DataFrame:
    """Every message with its text in the one consistent form."""
    m = table(spark, root, "messages").select("message_id", "raw_text").dropDuplicates()
    return lookalike.canonical(m).select("message_id", "canonical_text")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Each message and each type of personal detail that occurs in its text."""
    m = personal.redacted(table(spark, root, "messages").select("message_id", "raw_text"))
    return m.filter(F.size("pii_types") > 0).select("message_id", F.explode("pii_types").alias("pii_type")).distinct()


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every message with placeholders in the place of personal details."""
    m = table(spark, root, "messages").select("message_id", "raw_text").dropDuplicates()
    return personal.redacted(m).select("message_id", "redacted_text", F.array_join("pii_types", ",").alias("pii_types"))


PERCENTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
#: Arrivals that stand for "unknown".
SENTINELS = [99999.0]


def policy(c: Column) -> Column:
    """One spelling for each policy."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def _runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "results").select("run_id", policy(F.col("policy")).alias("policy"), F.col("median_time_to_reach_min").alias("median")).distinct()


def _arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Possible arrivals, each served row once: finite, not negative, not before
    the dispatch, and no sentinel."""
    s = table(spark, root, "served").select("served_id", "run_id", "zone", "arrived_at_min", "dispatched_at_min")
    a, d = F.col("arrived_at_min"), F.col("dispatched_at_min")
    ok = a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) & (a >= 0) & ~a.isin(SENTINELS) & F.coalesce(a >= d, F.lit(True))
    return s.filter(ok).distinct()


def _by_run(spark: SparkSession, root: str) -> DataFrame:
    """One summary of arrivals for each run, with half of the permitted error."""
    return ranks.merged(ranks.summaries(_arrivals(spark, root), ["run_id"], "arrived_at_min"), ["run_id"], ranks.ERROR / 2)


def p3_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of arrivals and of the runs' medians for each policy, with the
    rank error (at most a thousandth of n), from summaries of runs."""
    runs = _runs(spark, root)
    with_policy = _by_run(spark, root).join(runs.select("run_id", "policy").distinct(), "run_id").select("policy", F.lit("arrived_at_min").alias("metric"), "n", "v", "lo", "hi")
    medians = runs.filter("median > 0").select("policy", F.lit("median_time_to_reach_min").alias("metric"), "median")
    both = with_policy.unionByName(ranks.summaries(medians, ["policy", "metric"], "median"))
    keys = ["policy", "metric"]
    return ranks.percentiles(ranks.merged(both, keys, ranks.ERROR, ranks.ERROR / 2), keys, PERCENTILES)


def p3_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """One rank summary for each run, to be stored and merged with later ones."""
    return _by_run(spark, root)


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    return tokens.counted(table(spark, root, "documents").select("doc_id", "source", "text"), "doc_id", "text", ["source"])


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every document in the containers of every spec."""
    return packing.packed(cut(_sizes(spark, root).select("doc_id", "n_tokens"), "sizes"), table(spark, root, "pack_specs"), "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and fill of each spec."""
    p = p8_packing(spark, root).join(small(table(spark, root, "pack_specs").distinct()), "spec_id")
    boxes = p.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return boxes.groupBy("spec_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity_tokens")).alias("fill"), F.max("used").alias("fullest"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The documents of each mix, by shard, in shuffled order."""
    return mixing.mixture(cut(_sizes(spark, root), "sizes"), table(spark, root, "source_mix"), "doc_id")[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached shares of each source in each mix."""
    return mixing.shares(*mixing.mixture(cut(_sizes(spark, root), "sizes"), table(spark, root, "source_mix"), "doc_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of messages within 12 hours whose sets of words are alike."""
    pairs = neardup.near_pairs(table(spark, root, "messages"))
    return pairs.select(F.col("a").alias("message_id_a"), F.col("b").alias("message_id_b"))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each message with its class of look-alike texts and its own spelling."""
    return lookalike.alike_classes(table(spark, root, "messages"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each message with its set of words, the group of sets that are mostly the same, and its number of links."""
    return neardup.near_groups(table(spark, root, "messages"))


#: Names of places that the class of names is trained on at most.
MAX_NAMES = 5000


def _names(spark: SparkSession, root: str) -> list[str]:
    g = table(spark, root, "gazetteer").select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return sorted(r.n for r in bounded_sample(g.filter("n is not null").distinct(), "n", MAX_NAMES).collect())


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Messages whose language label is missing or wrong, with each language of their text."""
    return language.mislabelled(table(spark, root, "messages"), names=_names(spark, root))


def p6_segments(spark: SparkSession, root: str) -> DataFrame:
    """Each stretch of each message with its language and confidence."""
    m = table(spark, root, "messages").select("message_id", "raw_text", "detected_language").dropDuplicates(["message_id"])
    d = language.identified(m, keep=["message_id"], names=_names(spark, root))
    d = d.select("message_id", F.array_join("langs", "+").alias("languages"), F.round("confidence", 4).alias("confidence"), F.posexplode("segments").alias("segment", "s"))
    return d.select("message_id", "languages", "confidence", "segment", "s.text", "s.lang", F.round("s.confidence", 4).alias("segment_confidence"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Groups of demands with a member that is best in all respects, and that member."""
    return survivors.found(table(spark, root, "demands"), table(spark, root, "messages"))


def p7_survivors(spark: SparkSession, root: str) -> DataFrame:
    """The surviving record of each group of demands and of each demand without one, field bundle by field bundle."""
    s = survivors.survivors(table(spark, root, "demands"), table(spark, root, "messages"))
    return s.select("group_id", "demand_id", "n_members", "trust_score", "duplicate_collapse_count", "channels", "source_message_ids", "location", "need", "status", "time_decay_class", "first_reported_at", "last_corroborated_at", "raw_texts")


P7_SQL = r"""
with recursive d as (select distinct * from demands),
l as (select distinct demand_id, lower(trim(m)) mid from (select demand_id, unnest(source_message_ids) m from d)),
k as (select demand_id, mid from l where mid in (select lower(trim(message_id)) from messages)),
e as (select distinct a.demand_id x, b.demand_id y from k a join k b using (mid)),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
g as (select x demand_id, min(y) group_id from r group by x),
m as (select g.group_id, d.demand_id, coalesce(last_corroborated_at, timestamp '0001-01-01') la, coalesce(trust_score, -1e300) tr,
 (d.demand_id is not null)::int + coalesce((len(source_message_ids) > 0)::int, 0) + (duplicate_collapse_count is not null)::int + (location is not null)::int
 + (need is not null)::int + (field_confidence is not null)::int + (quantity_confidence is not null)::int + (trust_score is not null)::int
 + (first_reported_at is not null)::int + (last_corroborated_at is not null)::int + (time_decay_class is not null)::int + (status is not null)::int
 + (escalation_weight is not null)::int + coalesce((len(channels) > 0)::int, 0) + coalesce((len(raw_texts) > 0)::int, 0) fi
 from d join g using (demand_id)),
t as (select group_id, max(fi) fi, max(la) la, max(tr) tr, count(*) n from m group by group_id)
select m.group_id, min(m.demand_id) as demand_id from m join t on m.group_id = t.group_id and m.fi = t.fi and m.la = t.la and m.tr = t.tr and t.n > 1
group by m.group_id having count(*) = 1"""


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents of whose text more than half is repeated keywords, links or tags."""
    return spam.scored(table(spark, root, "documents")).filter("spam").select("doc_id")


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its page score, host rate and smoothed score."""
    return spam.scored(table(spark, root, "documents")).select("doc_id", "host", "page_score", "host_rate", "score", "spam")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_normalized": p1_normalized,
        "p1_classes": p1_classes,
        "p2_found": p2_found,
        "p2_redacted": p2_redacted,
        "p3_percentiles": p3_percentiles,
        "p3_run_summaries": p3_run_summaries,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_segments": p6_segments,
        "p7_found": p7_found,
        "p7_survivors": p7_survivors,
        "p8_packing": p8_packing,
        "p8_fill": p8_fill,
        "p9_mixture": p9_mixture,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_scores": p10_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL}
