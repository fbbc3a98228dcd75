"""Percentiles, near-duplicates, survivors, packing and mixing against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidewright.llm")

from tidewright.llm import mixing, neardup, packing, ranks, survivors, tokens  # noqa: E402


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=200), min_size=1, max_size=8), st.sampled_from([0.002, 0.02, 0.1]))
def test_rank_error_holds(parts, permitted):
    level = [ranks.compress(ranks.exact(np.array(p, float)), permitted / 3) for p in parts]
    level = [ranks.compress(ranks.united(level[i : i + 3]), permitted * 2 / 3) for i in range(0, len(level), 3)]
    s = ranks.compress(ranks.united(level), permitted)
    whole = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    e = ranks.error(s)
    assert s[3] == len(whole) and e <= max(1.0, permitted * len(whole))
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        v, r = ranks.quantile(s, q), min(max(1, math.ceil(q * len(whole))), len(whole))
        lo, hi = np.searchsorted(whole, v, "left") + 1, np.searchsorted(whole, v, "right")
        assert lo - e <= r <= hi + e


def test_summaries_stay_small_over_many_merges():
    r = np.random.default_rng(3)
    level = [ranks.compress(ranks.exact(r.lognormal(3, 1, 20_000)), 0.001 / 4) for _ in range(64)]
    level = [ranks.compress(ranks.united(level[i : i + 8]), 0.001 * 5 / 8) for i in range(0, 64, 8)]
    s = ranks.compress(ranks.united(level), 0.001)
    assert ranks.error(s) <= 0.001 * 64 * 20_000 and len(s[0]) <= 6000


def test_percentiles_by_key(spark):
    r = random.Random(5)
    rows = [("a" if r.random() < 0.9 else "b", r.lognormvariate(3, 1)) for _ in range(20_000)] + [("a", float("nan")), ("b", None), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    sums = ranks.merged(ranks.summaries(df, ["k"], "x", 0.005), ["k"], 0.02, 0.005)
    got = {(x.k, x.q): x for x in ranks.percentiles(sums, ["k"], [0.5, 0.99]).collect()}
    assert {k for k, _ in got} == {"a", "b"}
    for k in "ab":
        v = sorted(x for n, x in rows if n == k and x is not None and math.isfinite(x))
        for q in (0.5, 0.99):
            x = got[k, q]
            assert x.n == len(v)
            assert abs(v.index(x.value) + 1 - math.ceil(q * len(v))) <= x.rank_error <= 0.02 * len(v)
    assert ranks.merged(ranks.summaries(df.limit(0), ["k"], "x"), ["k"]).count() == 0


def brute(rows, t, hours, least):
    out = set()
    sets = {(i, a): set(x.lower().split()) for i, x, a in rows if x and a}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        x, y = sets[i, a], sets[j, b]
        if i != j and min(len(x), len(y)) >= least and len(x & y) >= t * len(x | y) - 1e-9 and abs((a - b).total_seconds()) <= hours * 3600:
            out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_pairs(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(2000)]
    t0, rows = dt.datetime(2026, 1, 1), []
    for g in range(60):
        base = r.sample(words[:60], 14) + r.sample(words[60:], r.randint(8, 20))
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(words)], [w[k], r.choice(words)]])
            r.shuffle(w)
            rows.append((f"m{len(rows):04}", " ".join(w), t0 + dt.timedelta(hours=r.uniform(0, 30))))
    rows += [(f"c{k}", "Same " + " ".join(words[:25]), t0) for k in range(12)]  # a hot group of copies
    rows += [("n1", None, t0), ("n2", "short text", t0), ("n3", rows[0][1], None), rows[5], ("long", " ".join(words), t0)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "message_id string, raw_text string, received_at timestamp_ntz, uid int").repartition(3)
    got = {(x.a, x.b) for x in neardup.near_pairs(df).collect()}
    assert got == brute(rows, 0.8, 12, 20)
    assert len(got) > 60


def test_near_pairs_of_long_records(spark):
    """Records of some hundred to thousands of frequent words, at the borders of the ranges of sizes too."""
    r = random.Random(9)
    words = [f"w{k}" for k in range(6000)]
    t0, rows = dt.datetime(2026, 1, 1), []
    for n in (50, 100, 104, 120, 127, 128, 140, 200, 409, 415, 511, 520, 1000, 2500):
        for _ in range(2):
            base = r.sample(words[: max(90, 2 * n)], n)
            rows.append((f"m{len(rows):04}", " ".join(base), t0))
            for lost in (0.0, 0.05, 0.1, 0.19, 0.21):
                k = int(n * lost)
                rows.append((f"m{len(rows):04}", " ".join(r.sample(base, n - k)), t0))
                rows.append((f"m{len(rows):04}", " ".join(base[k // 2 :] + [f"new{len(rows)}x{j}" for j in range(k // 2)]), t0))
    df = spark.createDataFrame(rows, "message_id string, raw_text string, received_at timestamp_ntz").repartition(3)
    got = {(x.a, x.b) for x in neardup.near_pairs(df).collect()}
    assert got == brute(rows, 0.8, 12, 20)
    assert len(got) > 300


def templated(n, r, t0):
    """Messages of seven sentences out of 40, whose words are the same but for names and numbers; some twice with changes."""
    sentences = [[f"s{k}w{j}" for j in range(6)] for k in range(40)]
    rows = []
    while len(rows) < n:
        w = [x for s in r.sample(sentences, 7) for x in [*s, f"name{r.randrange(300)}", f"{r.randrange(90)}"]] + [f"ref{len(rows)}"]
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            v = list(w)
            for _ in range(r.randint(0, 8)):
                v[r.randrange(len(v))] = r.choice([f"name{r.randrange(300)}", f"typo{r.randrange(10**6)}"])
            r.shuffle(v)
            rows.append((f"m{len(rows):05}", " ".join(v), t0 + dt.timedelta(minutes=r.uniform(0, 600))))
    return rows


def test_near_pairs_of_shared_sentences_leave_little_on_disk(spark):
    rows = templated(1500, random.Random(4), dt.datetime(2026, 1, 1))
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        got = disk.getAllFiles()
        return {(f := got.apply(i)).getName(): f.length() for i in range(got.size())}

    df = spark.createDataFrame(rows, "message_id string, raw_text string, received_at timestamp_ntz").repartition(3).cache()
    df.count()
    before = files()
    got = {(x.a, x.b) for x in neardup.near_pairs(df).collect()}
    left = sum(v for k, v in files().items() if k.startswith("shuffle_") and k not in before)
    df.unpersist()
    assert got == brute(rows, 0.8, 12, 20)
    assert len(got) > 200
    assert left < 0.5 * sum(len(x) for _, x, _ in rows), left / sum(len(x) for _, x, _ in rows)


@pytest.mark.parametrize("n", [16_000_000, 80_000_000])
def test_combinations_do_not_grow_with_a_fixed_vocabulary(n):
    """Sets of 53 words: a number, 14 names and numbers, and words of sentences that a tenth of all sets have."""
    r, many = random.Random(2), 0
    edge = neardup.borders(n)
    for _ in range(200):
        df = sorted([1] + [r.randint(n // 500, n // 50) for _ in range(14)] + [r.randint(n // 30, n // 8) for _ in range(38)])
        h = [r.getrandbits(40) for _ in df]
        cls = [int(k) + 1 for k in np.searchsorted(edge, df)]
        parts = neardup.parts_of(neardup.range_of(53))
        sig, _ = neardup.combos(h, [x % parts[k] * 8 + k for x, k in zip(h, cls)], cls, neardup.misses(53, 0.8))
        many += len(sig)
    assert many / 200 < 100


def test_meeting_needs_both_levels_and_sketches():
    """A record that 3,000 sets share: only pairs whose words can be alike are handed on."""
    r, sets = random.Random(3), []
    for k in range(1500):
        a = r.sample(range(10**6), 50)
        sets += [a, a[: r.choice([49, 48, 46])] + [10**6 + k]]
    rng = neardup.range_of(50)
    rec = np.zeros(len(sets), neardup.record(rng))
    for k, x in enumerate(sets):
        h = np.array([v * 2654435761 % 2**40 for v in x], np.uint64)
        rec[k] = (7, r.randint(0, 4), len(x), k, neardup.sketches(h, np.array([0]), 1)[0])
    got = {(int(x), int(y)) for p in neardup.meet(rec, rng, 0.8) for x, y in zip(*p)}
    need = set()
    for k in range(0, len(sets), 2):
        a, b = rec[k], rec[k + 1]
        o = math.ceil(0.8 / 1.8 * (int(a["n"]) + int(b["n"])) - 1e-9)
        if a["level"] <= a["n"] - o and b["level"] <= b["n"] - o:
            need.add((k, k + 1))
    assert need <= got and len(need) > 500
    assert len(got) < len(need) + 20


def test_near_groups(spark):
    base = [f"w{k}" for k in range(30)]
    rows = [(f"c{k}", " ".join(base)) for k in range(5)] + [("e", " ".join(base[:27])), ("f", " ".join(base[3:27])), ("x", " ".join(f"y{k}" for k in range(25))), ("s", "short"), ("n", None)]
    got = {r.message_id: r for r in neardup.near_groups(spark.createDataFrame(rows, "message_id string, raw_text string")).collect()}
    assert set(got) == {*(f"c{k}" for k in range(5)), "e", "f", "x"}
    assert len({got[k].group_id for k in ("c0", "c4", "e", "f")}) == 1 and got["x"].group_id == got["x"].set_id
    assert (got["c0"].n_links, got["e"].n_links, got["x"].n_links) == (2, 2, 0)


@pytest.mark.parametrize("n", [64, 128, 200, 400, 1000, 4000])
def test_combinations_are_in_proportion_to_length(n):
    r = neardup.range_of(n)
    parts = neardup.parts_of(r)[4]
    h = list(range(n))
    sig, level = neardup.combos(h, [x % parts * 8 + 4 for x in h], [4] * n, neardup.misses(n, 0.8))
    assert len(sig) <= 200 * n and len(sig) == len(level)
    assert math.ceil(0.8 * (neardup.RANGE * 4 ** (r - 1) if r else 20)) > neardup.loss(r)


def test_near_pairs_edges(spark):
    df = spark.createDataFrame([], "message_id string, raw_text string, received_at timestamp_ntz")
    assert neardup.near_pairs(df).count() == 0
    with pytest.raises(ValueError, match="min_words"):
        neardup.near_pairs(df, min_words=5)


def offer(bundle, sig, k1, ident, k2=0.0, h=0, k3=0.0):
    return {"bundle": bundle, "sig": sig, "k1": k1, "k2": k2, "k3": k3, "h": h, "id": ident}


def offers_of(members):
    """What the aggregates leave of members (f, l, t, kind, urgency, decay, status, values of bundles)."""
    best: dict[tuple, dict] = {}

    def put(o, key=None):
        k = (o["bundle"], o["sig"])
        if k not in best or (o["k1"], o["k2"], o["k3"], o["h"]) > tuple(best[k][x] for x in ("k1", "k2", "k3", "h")):
            best[k] = o

    for i, m in enumerate(members):
        crit = {"f": m["f"], "l": m["l"], "t": m["t"]}
        for w, order in survivors.ORDERS.items():
            a, b, c = (crit[x] for x in order)
            put(offer(w, "", a, f"m{i}", b, i + 1, c))
        put(offer("twin", "", m["f"], f"m{i}", m["l"], -(i + 1), m["t"]))
        put(offer("witness", f"{m['kind']}|{m['urgency']}|{m['decay']}", 0.0, "w"))
        sig = {"place": m["kind"], "need": f"{m['kind']}|{m['urgency']}", "state": f"{m['decay']}|{m['status']}", "times": m["status"], "texts": m["kind"]}
        for b in survivors.BUNDLES:
            put(offer(b, sig[b], m["v"][b], f"m{i}", h=i + 1))
    return list(best.values())


@pytest.mark.parametrize("seed", range(40))
def test_search_is_exact(seed):
    r = random.Random(seed)
    members = [
        {"f": r.randint(5, 7), "l": r.randint(0, 2), "t": r.randint(0, 2) / 2, "kind": r.choice("ab"), "urgency": r.choice("xy"), "decay": r.choice("se"), "status": r.choice("pq"),
         "v": {b: r.random() for b in survivors.BUNDLES}}
        for _ in range(r.randint(2, 6))
    ]
    got = survivors.search(offers_of(members))
    key = lambda m: (m["f"], m["l"], m["t"])
    leads = [i for i, m in enumerate(members) if all(key(m)[k] >= max(key(x)[k] for x in members) for k in range(3)) and sum(key(x) == key(m) for x in members) == 1]
    assert got["dominant"] == bool(leads)
    if leads:
        assert got["lead_id"] == f"m{leads[0]}"
    seen = {(m["kind"], m["urgency"], m["decay"]) for m in members}
    top = 0.0
    for need, state, place, texts, times in itertools.product(members, repeat=5):
        if place["kind"] == need["kind"] == texts["kind"] and times["status"] == state["status"] and (need["kind"], need["urgency"], state["decay"]) in seen:
            top = max(top, need["v"]["need"] + state["v"]["state"] + place["v"]["place"] + texts["v"]["texts"] + times["v"]["times"])
    who = members[leads[0]]["t"] if leads else max(m["t"] for m in members)
    assert got["trust_total"] == pytest.approx(top + who + 0.01)


DEMAND = (
    "demand_id string, source_message_ids array<string>, duplicate_collapse_count int, location struct<lat:double,lon:double,resolution:string,geo_confidence:double,method:string,h3_cell:string>, "
    "need struct<type:string,people:int,people_lower:int,people_upper:int,vulnerability_flags:array<string>,medical_urgency:string>, "
    "field_confidence struct<need_type:double,headcount:double,vulnerability:double,medical_urgency:double>, quantity_confidence double, trust_score double, first_reported_at timestamp_ntz, "
    "last_corroborated_at timestamp_ntz, time_decay_class string, status string, escalation_weight double, channels array<string>, raw_texts array<string>"
)


def demand(i, mids, trust=None, last=None, **kw):
    base = dict.fromkeys(x.strip().split(" ")[0] for x in ("duplicate_collapse_count location need field_confidence quantity_confidence first_reported_at time_decay_class status escalation_weight channels raw_texts".split()))
    row = base | {"demand_id": i, "source_message_ids": mids, "trust_score": trust, "last_corroborated_at": last} | kw
    return row


def test_survivors(spark):
    t = [dt.datetime(2026, 1, 1, h) for h in range(4)]
    loc = (9.5, 76.4, "point", 0.9, "attached_geo", "c1")
    rows = [
        demand("d1", ["M1", " m2 "], 0.2, t[0], channels=["SMS"]),
        demand("d2", ["m2", "M3"], 0.9, t[3], channels=["field report"], location=loc, status="assigned"),
        demand("d3", ["M3", "n/a", ""], None, t[1]),
        demand("d4", ["M4"], 0.5, t[0]), demand("d5", ["M4"], 0.5, t[0], status="x"), demand("d6", ["m4"], 0.6, t[0]),
        demand("d7", ["n/a"], 0.5, t[0]), demand("d8", ["n/a"], 0.5, t[0]), demand("d9", None, 0.5, t[0]),
    ]
    rows.append(rows[1])
    df = spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in NAMES) for r in rows], DEMAND)
    m = spark.createDataFrame([("M1",), ("M2",), ("m3",), ("M4",), (None,)], "message_id string")
    got = {r.group_id: r for r in survivors.choose(survivors.grouped(df, m)).collect()}
    assert set(got) == {"d1", "d4"}
    assert {(r.group_id, r.demand_id) for r in survivors.found(df, m).collect()} == {("d1", "d2")}
    assert got["d1"].dominant and got["d1"].lead_id == "d2"
    assert not got["d4"].dominant
    s = {r.group_id: r for r in survivors.survivors(df, m).collect()}
    assert s["d1"].source_message_ids == ["M1", "M2", "M3"]
    assert s["d1"].duplicate_collapse_count == 3 and s["d1"].n_members == 3
    assert s["d1"].channels == ["field_report", "sms"]
    assert s["d1"].location.h3_cell == "c1"
    # Records without a group survive as they are.
    assert set(s) == {"d1", "d4", "d7", "d8", "d9"}
    assert s["d7"].n_members == 1 and s["d7"].duplicate_collapse_count == 1 and s["d7"].source_message_ids == [] and s["d9"].channels == []
    assert survivors.survivors(df.limit(0), m).count() == 0


NAMES = [
    "demand_id", "source_message_ids", "duplicate_collapse_count", "location", "need", "field_confidence", "quantity_confidence", "trust_score", "first_reported_at",
    "last_corroborated_at", "time_decay_class", "status", "escalation_weight", "channels", "raw_texts",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=0, max_size=9), st.integers(1, 60))
def test_fullest_is_the_best_sum(items, room):
    count: dict[int, int] = {}
    for n in items:
        count[n] = count.get(n, 0) + 1
    got = packing.fullest(sorted(count), count, room)
    assert all(m <= count[n] for n, m in got)
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
    assert sum(n * m for n, m in got) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 120))
def test_pack_keeps_everything(sizes, capacity):
    boxes = packing.pack(list(enumerate(sizes)), capacity)
    assert all(sum(n for _, _, n in b) <= capacity for b in boxes)
    got: dict[int, list] = {}
    for b in boxes:
        for i, s, n in b:
            got.setdefault(i, []).append((s, n))
    for i, n in enumerate(sizes):
        spans = sorted(got.get(i, []))
        assert sum(x for _, x in spans) == n
        assert len(spans) == -(-n // capacity)
        assert [s for s, _ in spans] == [k * capacity for k in range(len(spans))]


def test_packed(spark):
    docs = spark.createDataFrame([(i, i % 90, "x") for i in range(400)] + [(999, 1000, "x")], "doc_id long, n_tokens long, block string").drop("block")
    specs = spark.createDataFrame([("s", 64), ("l", 256), ("none", 0)], "spec_id string, capacity_tokens int")
    rows = packing.packed(docs, specs, "doc_id", 100).collect()
    for spec, cap in (("s", 64), ("l", 256)):
        own = [r for r in rows if r.spec_id == spec]
        assert sum(r.n_tokens for r in own) == sum(i % 90 for i in range(400)) + 1000
        box: dict[int, int] = {}
        for r in own:
            box[r.container_id] = box.get(r.container_id, 0) + r.n_tokens
        assert max(box.values()) <= cap
        assert sum(box.values()) / (len(box) * cap) > 0.93
    assert packing.packed(docs.limit(0), specs, "doc_id").count() == 0


def test_split_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([100, 3, 0, 57])
    parts = mixing.split(counts, 7, rng)
    assert (sum(parts) == counts).all()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 2


def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, "Big One" if i % 3 else "small-one", r.randint(0, 60)) for i in range(3000)] + [(9000 + i, "tiny", 40) for i in range(20)] + [(9999, None, 50)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    mix = spark.createDataFrame([("m", "big_one", 0.6, 1), ("m", "small_one", 0.3, 2), ("m", "tiny", 0.05, 4), ("m", "absent", 0.05, 9)], "mix_id string, source string, target_share double, max_repeats int")
    out, report = mixing.mixture(df, mix, "doc_id")
    rows = out.collect()
    seen = [(x.doc_id, x["pass"]) for x in rows]
    assert len(seen) == len(set(seen))
    uses: dict[int, int] = {}
    for x in rows:
        uses[x.doc_id] = uses.get(x.doc_id, 0) + 1
    assert max(uses[9000 + i] for i in range(20) if 9000 + i in uses) <= 4
    s = {x.source: x for x in mixing.shares(out, report).collect()}
    assert s["absent"].drawn_tokens == 0
    for name, share in (("big_one", 0.6), ("small_one", 0.3), ("tiny", 0.05)):
        assert s[name].actual_share == pytest.approx(share / 0.95, abs=0.02)
        assert 0 <= s[name].quota_tokens - s[name].drawn_tokens <= 3
    pos: dict[int, list] = {}
    for x in rows:
        pos.setdefault(x.shard, []).append(x.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in pos.values())
    with pytest.raises(ValueError, match="targets"):
        mixing.PLAN_BLOCKS, was = 3, mixing.PLAN_BLOCKS
        try:
            mixing.mixture(df, mix, "doc_id")
        finally:
            mixing.PLAN_BLOCKS = was
    empty, rep = mixing.mixture(df.limit(0), mix, "doc_id")
    assert empty.count() == 0 and rep.count() == 4


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "പാലം " * 50)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.counted(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 50
