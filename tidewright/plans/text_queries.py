"""Queries on texts: normalisation, marker language, extraction, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import geo, text, triage
from tidewright.session import cut
from tidewright.sources.tables import table


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "messages").select("message_id", "raw_text").filter("raw_text is not null").dropDuplicates(["message_id", "raw_text"])


def n1_language(spark: SparkSession, root: str) -> DataFrame:
    """Marker-based language of each message."""
    return _messages(spark, root).select("message_id", text.language(F.col("raw_text")).alias("l")).select("message_id", "l.*")


def n2_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each message, joined by blanks."""
    t = text.tokens(F.col("raw_text"))
    return _messages(spark, root).select("message_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def n3_expanded(spark: SparkSession, root: str) -> DataFrame:
    """Messages with shorthand written out, put together again."""
    return _messages(spark, root).select("message_id", text.detokenized(text.expanded(text.tokens(F.col("raw_text")))).alias("normalized"))


def _vocabulary(m: DataFrame) -> DataFrame:
    """Words that at least one in 200 messages holds, ranked by that."""
    w = m.select("message_id", F.explode(F.array_distinct(text.words(F.col("raw_text")))).alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = m.count()
    return c.filter((F.length("word") >= 2) & (F.col("n") * 200 >= n)).select("word", (-F.col("n")).alias("rank"))


def n5_corrections(spark: SparkSession, root: str) -> DataFrame:
    """Distinct words with their correction against the common words."""
    m = cut(_messages(spark, root), "texts")
    return text.corrections(m.select(F.explode(text.words(F.col("raw_text"))).alias("token")), _vocabulary(m)).filter("token <> correction")


def n9_place_norm(spark: SparkSession, root: str) -> DataFrame:
    """Gazetteer names and aliases in the form that texts are compared in."""
    g = table(spark, root, "gazetteer").select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return g.select("name", "alias", text.place_norm(F.col("alias")).alias("key")).distinct()


def t1_extract(spark: SparkSession, root: str) -> DataFrame:
    """Need, headcount, vulnerability and urgency of each message."""
    e = _messages(spark, root).select("message_id", triage.extraction(F.col("raw_text")).alias("e"))
    return e.select(
        "message_id", "e.need.need_type", F.col("e.need.raw").alias("need_type_raw"), "e.head.people", F.col("e.head.raw").alias("people_raw"), "e.head.method",
        F.array_join("e.vuln.flags", ",").alias("flags"), F.round("e.vuln.raw", 6).alias("vulnerability_raw"), "e.urgency.level", F.col("e.urgency.raw").alias("urgency_raw"),
    )


def t2_need_mix(spark: SparkSession, root: str) -> DataFrame:
    """Messages and mean confidence by channel and need."""
    m = table(spark, root, "messages").filter("raw_text is not null").dropDuplicates(["message_id"]).select("channel", triage.need(triage.plain(F.col("raw_text"))).alias("n"))
    return m.groupBy("channel", "n.need_type").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("n.raw"), 8).alias("mean_raw"))


def ga_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Location of each message: attached, written, gazetteer, sender's region, else unknown."""
    m = table(spark, root, "messages").dropDuplicates(["message_id"]).select("message_id", "raw_text", "attached_geo", "sender_region")
    hit = geo.matched(m.filter("raw_text is not null"), table(spark, root, "gazetteer")).select("message_id", F.col("lat").alias("glat"), F.col("lon").alias("glon"), "name")
    j = m.join(hit, "message_id", "left")
    region = F.col("sender_region")
    conf = F.when(geo.generic_place(F.col("raw_text")).isNotNull(), F.lit(0.35)).otherwise(F.lit(0.28))
    c = F.coalesce(
        geo.attached(F.col("attached_geo")),
        geo.written(F.col("raw_text")),
        F.when(F.col("name").isNotNull(), geo.located(F.col("glat"), F.col("glon"), F.lit("street"), F.lit(0.65), "gazetteer")),
        F.when(region["lat"].isNotNull(), geo.located(region["lat"], region["lon"], F.lit("ward"), conf, "sender_region")),
        geo.located(F.lit(9.62), F.lit(76.48), F.lit("unknown"), F.lit(0.0), "unknown"),
    )
    return j.select("message_id", c.alias("c")).select("message_id", "c.*")


def gc_written(spark: SparkSession, root: str) -> DataFrame:
    """Coordinates written into texts."""
    return _messages(spark, root).select("message_id", geo.written(F.col("raw_text")).alias("c")).filter("c is not null").select("message_id", "c.lat", "c.lon")


def gd_gazetteer(spark: SparkSession, root: str) -> DataFrame:
    """The longest gazetteer name in each message."""
    return geo.matched(_messages(spark, root), table(spark, root, "gazetteer")).select("message_id", "key", "name")


def ge_generic(spark: SparkSession, root: str) -> DataFrame:
    """The longest nameless place word in each message."""
    return _messages(spark, root).select("message_id", geo.generic_place(F.col("raw_text")).alias("place")).filter("place is not null")


def gk_hex_totals(spark: SparkSession, root: str) -> DataFrame:
    """Demands and people by hexagon of 900 m."""
    d = table(spark, root, "demands").dropDuplicates(["demand_id"]).filter("location.lat is not null and location.lon is not null")
    d = d.select(geo.hex_cell(F.col("location.lat"), F.col("location.lon"), 900.0).alias("cell"), F.col("need.people").alias("people"))
    return d.groupBy("cell").agg(F.count(F.lit(1)).alias("demands"), F.coalesce(F.sum("people"), F.lit(0)).cast("bigint").alias("people"))


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_M = "(select distinct message_id, raw_text from messages where raw_text is not null)"
_MD = "(select message_id, any_value(channel) channel, any_value(raw_text) raw_text, any_value(attached_geo) attached_geo, any_value(sender_region) sender_region from messages group by message_id)"
_PN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'))"
_TOK = r"regexp_extract_all(lower(trim(raw_text)), '([a-z0-9]+|[^\sa-z0-9])', 1)"


def _need_sql() -> str:
    parts = []
    for i, n in enumerate(triage.NEEDS):
        s = " + ".join(f"case when regexp_matches(t, '{p}') then {w} else 0.0 end" for p, w in triage.NEED_CUES[n])
        parts.append(f"{{'score': round({s}, 6)::double, 'ord': {-i}, 'need': '{n}'}}")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x.score > 0)"


def _spelled_sql(c: str) -> str:
    for w, n in triage.NUMBER_WORDS.items():
        c = rf"regexp_replace({c}, '\b{w}\b', '{n}', 'g')"
    return c


def _grab(p: str) -> str:
    return f"try_cast(nullif(regexp_extract(u, '{p}', 1), '') as int)"


_RAW = "0.55 * sc / tot + 0.45 * (sc - s2) / sc"
_NEED = rf"""(select *, case when len(r) = 0 then 'evacuation' else r[1].need end need_type,
 case when len(r) = 0 then 0.18 else round_even(least(0.995, ({_RAW}) * (0.72 + 0.28 * least(1.0, sc / 5)) + 0.12 * least(1.0, sc / 6)), 4) end need_raw
 from (select *, r[1].score sc, coalesce(r[2].score, 0) s2, list_sum(list_transform(r, lambda x: x.score)) tot
  from (select *, list_reverse_sort({_need_sql()}) r from (select *, regexp_replace(regexp_replace(regexp_replace(lower(raw_text), '\p{{Cf}}', '', 'g'), '[^\x00-\x7F\pZ\pP\pS\pC]', '_', 'g'), '\pZ', ' ', 'g') t from @SRC@))))"""
_URG = "case " + " ".join(f"when regexp_matches(t, '{p}') then {{{{'level': '{level}', 'raw': {round(min(0.95, 0.52 + 0.13 * w), 2)}}}}}" for level, p, w in triage.URGENCY)
_URG = _URG.replace("{{", "{").replace("}}", "}") + " when need_type = 'medical' then {'level': 'mild', 'raw': 0.42} when need_type = 'evacuation' then {'level': 'none', 'raw': 0.62} else {'level': 'none', 'raw': 0.70} end"
_FLAGS = "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in triage.VULNERABLE.items()) + "], lambda x: x is not null))"
_NAMES = f"""names as (select distinct name, lat, lon, {_PN.format('n')} as key from (select name, lat, lon, unnest(list_concat([name], coalesce(aliases, []))) n from gazetteer) where length({_PN.format('n')}) >= 6 and len(list_filter(string_split({_PN.format('n')}, ' '), lambda x: length(x) >= 4)) > 0),
hits as (select m.message_id, k.key, k.name, k.lat, k.lon, row_number() over (partition by m.message_id order by -length(k.key), k.key, k.name, k.lat, k.lon) rk
 from (select message_id, ' ' || regexp_replace({_PN.format('raw_text')}, ' +', ' ', 'g') || ' ' t from @SRC@) m join names k on contains(m.t, ' ' || regexp_replace(k.key, ' +', ' ', 'g') || ' '))"""
_GENERIC = "case " + " ".join(f"when contains(' ' || {_PN.format('raw_text')} || ' ', ' {g} ') then '{g}'" for g in geo.GENERIC) + " end"
_COORD = r"(?:^|[^\d.])([-+]?\d{1,2}\.\d{3,8})\s*[,;/ ]\s*([-+]?\d{2,3}\.\d{3,8})(?:$|[^\d.])"
_WRITTEN = f"""(select message_id, la, lo from (select message_id, try_cast(nullif(regexp_extract(raw_text, '{_COORD}', 1), '') as double) la,
 try_cast(nullif(regexp_extract(raw_text, '{_COORD}', 2), '') as double) lo from @SRC@) where la is not null and abs(la) <= 90 and abs(lo) <= 180)"""
_DEL = "list_distinct(list_concat([{0}], case when length({0}) > 3 then list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)) else [] end))"

SQL = {
    "n1_language": f"""select message_id,
 case when n = 0 then 'en' when hi_hits / n >= 0.72 then 'hi' when hi_hits / n <= 0.18 then 'en' else 'mixed' end as language,
 case when len(w) = 0 then 0.2 when n = 0 then 0.25 else round_even(least(greatest(
  (case when hi_hits / n >= 0.72 then hi_hits / n when hi_hits / n <= 0.18 then 1 - hi_hits / n else 1 - abs(hi_hits / n - 0.45) * 1.6 end)
  * (0.55 + 0.45 * least(1.0, n / 5)), 0.2), 0.98), 3) end as confidence, hi_hits, en_hits
 from (select *, (hi_hits + en_hits)::double n from (select message_id, w, len(list_filter(w, lambda x: list_contains({_list(text.HINDI_MARKERS)}, x)))::int hi_hits,
  len(list_filter(w, lambda x: list_contains({_list(text.ENGLISH_MARKERS)}, x)))::int en_hits
  from (select message_id, regexp_extract_all(lower(raw_text), '([a-z]+)', 1) w from {_M})))""",
    "n2_tokens": f"select message_id, len({_TOK})::int as n_tokens, array_to_string({_TOK}, ' ') as tokens from {_M}",
    "n3_expanded": f"""select message_id, regexp_replace(regexp_replace(array_to_string(list_transform({_TOK},
 lambda x: coalesce(map({_list(list(text.EXPANSIONS))}, {_list(list(text.EXPANSIONS.values()))})[x], x)), ' '), ' ([,.!?;:%)''])', '\\1', 'g'), '\\( ', '(', 'g') as normalized from {_M}""",
    "n5_corrections": f"""with m as {_M}, w as (select message_id, unnest(regexp_extract_all(lower(raw_text), '([a-z]+)', 1)) word from m),
v as (select word, -count(distinct message_id) rank from w group by word having length(word) >= 2 and count(distinct message_id) * 200 >= (select count(*) from m)),
t as (select distinct word token from w where length(word) >= 4 and word not in (select word from v)),
p as (select distinct token, word, rank from (select token, unnest({_DEL.format('token')}) k from t) join (select word, rank, unnest({_DEL.format('word')}) k from v) using (k)),
c as (select *, case when token = word then 0 when levenshtein(token, word) <= 1 then 1 when length(token) = length(word) and damerau_levenshtein(token, word) <= 1 then 1 else 2 end cost from p)
select token, word as correction from (select *, row_number() over (partition by token order by cost, rank, -length(word), word) k from c) where k = 1""",
    "n9_place_norm": f"select distinct name, alias, {_PN.format('alias')} as key from (select name, unnest(list_concat([name], coalesce(aliases, []))) alias from gazetteer)",
    "t1_extract": f"""select message_id, need_type, need_raw as need_type_raw,
 case when we is not null then greatest(1, least(we, 500)) when coalesce(pa, pb) is not null then greatest(1, least(coalesce(pa, pb), 500))
  when hh is not null then greatest(1, least(round_even(hh * 4.6::double, 0)::int, 500)) when bare is not null then greatest(1, least(bare, 500)) else 5 end as people,
 case when we is not null then 0.93 when coalesce(pa, pb) is not null then 0.90 when hh is not null then 0.58 when bare is not null then 0.44 else 0.15 end as people_raw,
 case when we is not null then 'first_person_count' when coalesce(pa, pb) is not null then 'number_with_person_unit' when hh is not null then 'households_x_mean_size' when bare is not null then 'bare_number' else 'household_prior' end as method,
 array_to_string(fl, ',') as flags, round(case when len(fl) = 0 then 0.55 else least(0.95, 0.68 + 0.10 * len(fl)) end, 6) as vulnerability_raw, ur.level as level, ur.raw as urgency_raw
 from (select *, {_FLAGS} fl, {_URG} ur, {_grab(triage.WE_ARE)} we, {_grab(triage.PEOPLE_AFTER)} pa, {_grab(triage.PEOPLE_BEFORE)} pb, {_grab(triage.HOUSES)} hh,
  list_max(list_filter(list_transform(regexp_extract_all(u, '{triage.BARE}', 1), lambda x: x::int), lambda x: x > 0 and x <= 400)) bare
  from (select *, {_spelled_sql('t')} u from {_NEED.replace('@SRC@', _M)}))""",
    "t2_need_mix": f"select channel, need_type, count(*) as messages, round(avg(need_raw), 8) as mean_raw from {_NEED.replace('@SRC@', '(select * from ' + _MD + ' where raw_text is not null)')} group by channel, need_type",
    "ga_cascade": f"""with {_NAMES.replace('@SRC@', _MD)}, wr as {_WRITTEN.replace('@SRC@', _MD)},
j as (select m.*, g.lat glat, g.lon glon, g.name, wr.la, wr.lo, coalesce(attached_geo.accuracy_m, 100) acc, attached_geo.lat is not null and attached_geo.lon is not null att,
 {_GENERIC} gen from {_MD} m left join (select * from hits where rk = 1) g using (message_id) left join wr using (message_id))
select message_id, case when att then attached_geo.lat when la is not null then la when name is not null then glat when sender_region.lat is not null then sender_region.lat else 9.62 end as lat,
 case when att then attached_geo.lon when la is not null then lo when name is not null then glon when sender_region.lat is not null then sender_region.lon else 76.48 end as lon,
 case when att then case when acc <= 50 then 'point' when acc <= 150 then 'building' when acc <= 600 then 'street' else 'ward' end when la is not null then 'point' when name is not null then 'street' when sender_region.lat is not null then 'ward' else 'unknown' end as resolution,
 case when att then case when acc <= 50 then 0.95 when acc <= 150 then 0.86 when acc <= 600 then 0.66 when acc <= 2500 then 0.42 else 0.28 end when la is not null then 0.92 when name is not null then 0.65 when sender_region.lat is not null then case when gen is not null then 0.35 else 0.28 end else 0.0 end as confidence,
 case when att then 'attached_geo' when la is not null then 'text_coordinates' when name is not null then 'gazetteer' when sender_region.lat is not null then 'sender_region' else 'unknown' end as method from j""",
    "gc_written": f"select message_id, la as lat, lo as lon from {_WRITTEN.replace('@SRC@', _M)}",
    "gd_gazetteer": f"with {_NAMES.replace('@SRC@', _M)} select message_id, key, name from hits where rk = 1",
    "ge_generic": f"select * from (select message_id, {_GENERIC} as place from {_M}) where place is not null",
    "gk_hex_totals": """with d as (select demand_id, any_value(location) l, any_value(need.people) people from demands group by demand_id),
p as (select people, (l.lon - 76.48) * (pi()/180*6371000.0*cos(radians(9.62))) x, (l.lat - 9.62) * (pi()/180*6371000.0) y from d where l.lat is not null and l.lon is not null),
h as (select people, (sqrt(3)/3*x - y/3)/900 q, (2/3*y)/900 r from p),
c as (select *, floor(q+0.5) rq, floor(r+0.5) rr, floor(-q-r+0.5) rs from h),
e as (select *, abs(rq-q) dq, abs(rr-r) dr, abs(rs-(-q-r)) ds from c)
select (case when dq > dr and dq > ds then -rr-rs else rq end)::bigint::varchar || ':' || (case when dq > dr and dq > ds then rr when dr > ds then -rq-rs else rr end)::bigint::varchar as cell,
 count(*) as demands, coalesce(sum(people), 0)::bigint as people from e group by 1""",
}

for _n, _cols in (("t1_extract", ("people_raw", "vulnerability_raw", "urgency_raw")), ("ga_cascade", ("confidence",))):
    SQL[_n] = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in _cols)}) from ({SQL[_n]})"

QUERIES = {f.__name__: f for f in (n1_language, n2_tokens, n3_expanded, n5_corrections, n9_place_norm, t1_extract, t2_need_mix, ga_cascade, gc_written, gd_gazetteer, ge_generic, gk_hex_totals)}
