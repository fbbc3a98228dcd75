"""Problem 7: the best representative of each group of duplicate demands.

Demands that share a source message, directly or through others, form a group.
Fields that depend on one another are bundled (place, need, times, state,
texts), and each bundle of the surviving record comes whole from one member.
Whose record it is (the identity) is a bundle too.  Branch and bound chooses
the bundles of highest trust under functional dependencies:

    place, texts -> need type      they come from members with the need that is chosen
    times -> status                likewise
    need type, urgency, decay      stand together in some member
    identity                       at least as good as every member in columns
                                   filled, last corroboration and trust, and
                                   better than each in one of them

Where no member meets the last one, the group has no dominant member, and the
search is run without it.  Before the search, members are reduced by aggregates
to the best one per bundle and determinant, and per order of the three
criteria, so that a group of any size reaches the search as a few candidates: a
member that dominates comes first in every order.

Defined cases: exact repeats of a row count once; ids are compared without case
and surrounding blanks; entries that are no message link nothing; a null or NaN
trust or a null time ranks lowest; records in no group survive as they are, with
their channels and messages cleaned in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import clean_id
from tidewright.operators.components import by_shared_keys
from tidewright.session import cut

LOWEST = -1e300
BUNDLES = ("place", "need", "state", "times", "texts")
FIELDS = {
    "place": ["location"],
    "need": ["need", "field_confidence", "quantity_confidence"],
    "state": ["time_decay_class", "status", "escalation_weight"],
    "times": ["first_reported_at", "last_corroborated_at"],
    "texts": ["raw_texts"],
}


def filled(c: str, kind: str) -> Column:
    """Whether a column is filled: not null and not an empty list."""
    ok = F.col(c).isNotNull()
    return ok & (F.size(c) > 0) if kind.startswith("array") else ok


def members(demands: DataFrame) -> DataFrame:
    """Demands with `_h` (hash of the row), `_filled`, `_last` and `_trust`."""
    kinds = dict(demands.dtypes)
    count = sum((filled(c, kinds[c]).cast("int") for c in demands.columns), F.lit(0))
    last = F.expr("unix_micros(cast(last_corroborated_at as timestamp))").cast("double")
    trust = F.when(F.isnan("trust_score"), None).otherwise(F.col("trust_score"))
    return (
        demands.withColumn("_h", F.xxhash64(*demands.columns))
        .withColumn("_filled", count)
        .withColumn("_last", F.coalesce(last, F.lit(LOWEST)))
        .withColumn("_trust", F.coalesce(trust, F.lit(LOWEST)))
    )


def source_links(demands: DataFrame, messages: DataFrame) -> DataFrame:
    """(demand_id, mid): the sources of each demand that are messages."""
    got = demands.select("demand_id", F.explode("source_message_ids").alias("m")).select("demand_id", clean_id(F.col("m")).alias("mid"))
    got = got.filter("demand_id is not null and mid <> ''").distinct()
    known = messages.select(clean_id(F.col("message_id")).alias("mid")).distinct()
    return got.join(known, "mid", "left_semi")


def groups(demands: DataFrame, messages: DataFrame) -> DataFrame:
    """(demand_id, group_id) of the demands that are linked to another."""
    g = by_shared_keys(source_links(demands, messages), "demand_id", "mid")
    return g.withColumnRenamed("component", "group_id")


def _share(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("double") for c in cols), F.lit(0.0)) / len(cols)


ORDERS = {"who1": ("f", "l", "t"), "who2": ("f", "t", "l"), "who3": ("l", "f", "t"), "who4": ("l", "t", "f"), "who5": ("t", "f", "l"), "who6": ("t", "l", "f")}


def candidates(m: DataFrame) -> DataFrame:
    """Rows (group_id, bundle, sig, k1, k2, k3, h, id): what each member offers.

    `sig` is what functional dependencies see of a bundle.  Values are trust
    times the share of the bundle's fields that are filled; records that break
    their own order (times, headcount bounds) offer nothing.
    """
    trust = F.greatest(F.col("_trust"), F.lit(0.0)) + F.lit(0.01)
    need, loc = F.col("need"), F.col("location")
    word = lambda c: F.coalesce(F.lower(c), F.lit(""))
    kind, status, decay = word(need["type"]), word(F.col("status")), word(F.col("time_decay_class"))
    bounds = F.coalesce((need["people_lower"] <= need["people"]) & (need["people"] <= need["people_upper"]), F.lit(True))
    times = F.coalesce(F.col("first_reported_at") <= F.col("last_corroborated_at"), F.lit(True))
    n = _share(need["type"], need["people"], need["people_lower"], need["people_upper"], need["medical_urgency"], F.col("field_confidence"), F.col("quantity_confidence"))
    value = {
        "place": (kind, trust * _share(loc["lat"], loc["lon"], loc["resolution"], loc["geo_confidence"], loc["method"], loc["h3_cell"])),
        "need": (F.concat_ws("|", kind, word(need["medical_urgency"])), F.when(bounds, trust * n).otherwise(0.0)),
        "state": (F.concat_ws("|", decay, status), trust * _share(F.col("time_decay_class"), F.col("status"), F.col("escalation_weight"))),
        "times": (status, F.when(times, trust * _share(F.col("first_reported_at"), F.col("last_corroborated_at"))).otherwise(0.0)),
        "texts": (kind, trust * F.least(F.lit(1.0), F.coalesce(F.size("raw_texts"), F.lit(0)) / 2.0)),
    }
    up = F.pmod(F.col("_h"), F.lit(1 << 53)).cast("bigint")
    zero = F.lit(0.0)

    def offer(bundle: str, sig: Column, k1: Column, k2: Column, k3: Column, h: Column) -> Column:
        ks = [k.cast("double").alias(f"k{i + 1}") for i, k in enumerate((k1, k2, k3))]
        return F.struct(F.lit(bundle).alias("bundle"), sig.alias("sig"), *ks, h.alias("h"), F.col("demand_id").alias("id"))

    rows = [offer(b, s, v, F.col("_last"), zero, up) for b, (s, v) in value.items()]
    rows.append(offer("witness", F.concat_ws("|", value["need"][0], decay), zero, zero, zero, F.lit(0).cast("bigint")))
    by = {"f": F.col("_filled"), "l": F.col("_last"), "t": F.col("_trust")}
    rows += [offer(w, F.lit(""), *(by[x] for x in o), up) for w, o in ORDERS.items()]
    rows.append(offer("twin", F.lit(""), *(by[x] for x in ORDERS["who1"]), -up))
    return m.select("group_id", F.explode(F.array(*rows)).alias("c")).select("group_id", "c.*")


def fits(b: str, o: dict, chosen: dict, seen: set[str]) -> bool:
    """Whether offer `o` of bundle `b` keeps the dependencies with those chosen."""
    need, state = (o if b == "need" else chosen.get("need")), (o if b == "state" else chosen.get("state"))
    if need is not None:
        kind = need["sig"].split("|")[0]
        if any(x is not None and x["sig"] != kind for x in (o if b == "place" else chosen.get("place"), o if b == "texts" else chosen.get("texts"))):
            return False
    if state is not None:
        times = o if b == "times" else chosen.get("times")
        if times is not None and times["sig"] != state["sig"].split("|")[1]:
            return False
    return need is None or state is None or f"{need['sig']}|{state['sig'].split('|')[0]}" in seen


def search(offers: list[dict]) -> dict:
    """Branch and bound over the bundles of one group."""
    by: dict[str, list[dict]] = {}
    for o in offers:
        by.setdefault(o["bundle"], []).append(o)
    seen = {o["sig"] for o in by["witness"]}
    who: dict[int, dict] = {}
    for w, order in ORDERS.items():
        o = by[w][0]
        who.setdefault(o["h"], {"id": o["id"], "h": o["h"], "sig": "", **{x: o[f"k{i + 1}"] for i, x in enumerate(order)}})
    top = {x: max(o[x] for o in who.values()) for x in "flt"}
    # The member that is first in the order by filling, and the last of its equals.
    twins = by["twin"][0]["h"] != -by["who1"][0]["h"]
    for o in who.values():
        o["k1"], o["k2"] = max(o["t"], 0.0) + 0.01, o["l"]
        o["leads"] = all(o[x] >= top[x] for x in "flt") and not twins
    ranked = {b: sorted(by[b], key=lambda o: (-o["k1"], -o["k2"], o["id"], o["h"])) for b in BUNDLES}

    def best(identities: list[dict]) -> tuple[float, dict]:
        ranked["who"] = sorted(identities, key=lambda o: (-o["k1"], -o["k2"], -o["f"], o["id"], o["h"]))
        order = sorted(ranked, key=lambda b: len(ranked[b]), reverse=True)
        rest = [0.0] * (len(order) + 1)
        for i in range(len(order) - 1, -1, -1):
            rest[i] = rest[i + 1] + ranked[order[i]][0]["k1"]
        out: list = [-1.0, {}]

        def grow(i: int, total: float, chosen: dict) -> None:
            if total + rest[i] <= out[0]:
                return
            if i == len(order):
                out[0], out[1] = total, dict(chosen)
                return
            b = order[i]
            for o in ranked[b]:
                if fits(b, o, chosen, seen):
                    chosen[b] = o
                    grow(i + 1, total + o["k1"], chosen)
                    del chosen[b]

        grow(0, 0.0, {})
        return out[0], out[1]

    leading = [o for o in who.values() if o["leads"]]
    total, got = best(leading or list(who.values()))
    out = {b: got[b]["id"] for b in BUNDLES} | {f"{b}_h": got[b]["h"] for b in BUNDLES}
    return out | {"lead_id": got["who"]["id"], "lead_h": got["who"]["h"], "dominant": bool(got["who"]["leads"]), "trust_total": total}


CHOICE = "group_id string, lead_id string, lead_h bigint, dominant boolean, trust_total double, " + ", ".join(f"{b} string, {b}_h bigint" for b in BUNDLES)


def grouped(demands: DataFrame, messages: DataFrame, g: DataFrame | None = None) -> DataFrame:
    """Members with their `group_id`; a demand that is linked to no other is a group of its own."""
    g = groups(demands, messages) if g is None else g
    m = members(demands).filter("demand_id is not null")
    return m.join(g, "demand_id", "left").withColumn("group_id", F.coalesce("group_id", "demand_id"))


def choose(m: DataFrame) -> DataFrame:
    """One row for each group of two or more different records of `m` (see
    `grouped`): which member each bundle of the survivor comes from, the member
    whose record it is, and whether that member is dominant."""
    several = m.groupBy("group_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).filter("lo <> hi").select("group_id")
    c = candidates(m.join(several, "group_id"))
    # Exact repeats of a row offer the same, and so fall together here.
    best = c.groupBy("group_id", "bundle", "sig").agg(F.max(F.struct("k1", "k2", "k3", "h", "id")).alias("o"))
    per = best.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "sig", "o.k1", "o.k2", "o.k3", "o.h", "o.id")).alias("offers"))
    names = [x.strip().split(" ")[0] for x in CHOICE.split(",")]
    kinds = [x.strip().split(" ")[1] for x in CHOICE.split(",")]
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [search(o) | {"group_id": i} for i, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow[k]) for n, k in zip(names, kinds)], names=names)

    return per.mapInArrow(run, CHOICE)


def found(demands: DataFrame, messages: DataFrame) -> DataFrame:
    """(group_id, demand_id): groups of demands that share a message, with the
    dominant member that the search chose."""
    linked = source_links(demands, messages).select("demand_id").distinct()
    m = grouped(demands.join(linked, "demand_id", "left_semi"), messages)
    return choose(m).filter("dominant").select("group_id", F.col("lead_id").alias("demand_id"))


def survivors(demands: DataFrame, messages: DataFrame) -> DataFrame:
    """The surviving record of each group and of each demand without a group, with
    united channels and messages and the right `duplicate_collapse_count` (the
    number of its messages, at least 1)."""
    links = cut(source_links(demands, messages), "sources")
    g = by_shared_keys(links, "demand_id", "mid").withColumnRenamed("component", "group_id")
    m = cut(grouped(demands, messages, g).dropDuplicates(["demand_id", "_h"]).withColumn("_key", F.pmod(F.col("_h"), F.lit(1 << 53)).cast("bigint")), "members")
    pick = choose(m)
    parts = pick.select("group_id", F.explode(F.array(
        F.struct(F.lit("who").alias("b"), F.col("lead_id").alias("demand_id"), F.col("lead_h").alias("_key")),
        *[F.struct(F.lit(b).alias("b"), F.col(b).alias("demand_id"), F.col(f"{b}_h").alias("_key")) for b in BUNDLES],
    )).alias("p")).select("group_id", "p.*")
    cols = [c for b in BUNDLES for c in FIELDS[b]]
    whole = parts.join(m.select("demand_id", "_key", *cols), ["demand_id", "_key"])
    take = lambda b, c: F.first(F.when(F.col("b") == b, F.struct(F.col(c).alias("v"))), ignorenulls=True)["v"].alias(c)
    built = whole.groupBy("group_id").agg(take("who", "demand_id"), *[take(b, c) for b in BUNDLES for c in FIELDS[b]])
    alone = m.join(built.select("group_id"), "group_id", "left_anti").select("group_id", "demand_id", *cols)
    channel = F.regexp_replace(F.lower(F.trim("ch")), r"[\s\-]+", "_")
    ch = m.select("group_id", F.explode("channels").alias("ch")).select("group_id", channel.alias("ch")).filter("ch <> ''")
    ch = ch.groupBy("group_id").agg(F.array_sort(F.collect_set("ch")).alias("channels"))
    mids = links.join(m.select("demand_id", "group_id").distinct(), "demand_id").groupBy("group_id").agg(F.array_sort(F.collect_set(F.upper("mid"))).alias("source_message_ids"))
    trust = m.groupBy("group_id").agg(F.max(F.when(~F.isnan("trust_score"), F.col("trust_score"))).alias("trust_score"), F.countDistinct("demand_id").alias("n_members"))
    out = built.unionByName(alone).join(ch, "group_id", "left").join(mids, "group_id", "left").join(trust, "group_id")
    none = F.array().cast("array<string>")
    out = out.withColumn("source_message_ids", F.coalesce("source_message_ids", none)).withColumn("channels", F.coalesce("channels", none))
    count = F.greatest(F.lit(1), F.size("source_message_ids"))
    return out.select("group_id", "demand_id", "n_members", "trust_score", *cols, "channels", "source_message_ids", count.alias("duplicate_collapse_count"))
