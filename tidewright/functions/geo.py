"""Locations from attached coordinates, texts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import let, place_norm
from tidewright.session import small

# Fixed value: how coordinates are written.
COORDINATES = r"(?<![\d.])([-+]?\d{1,2}\.\d{3,8})\s*[,;/ ]\s*([-+]?\d{2,3}\.\d{3,8})(?![\d.])"
# Place words without a name, the longest first.
GENERIC = sorted(
    [
        "panchayat", "panchayath", "panchayat office", "school", "lp school", "govt school", "chc", "phc", "health centre", "church", "palli",
        "temple", "kshetram", "mandir", "mosque", "masjid", "juma masjid", "jetty", "kadavu", "market", "chanta", "bazaar", "bus stand",
        "bus stop", "bridge", "palam", "pul", "water tank", "colony", "anganwadi", "balwadi", "old mill", "mill compound", "dairy", "milma",
    ],
    key=lambda s: (-len(s), s),
)


def located(lat: Column, lon: Column, resolution: Column, confidence: Column, method: str) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"), resolution.alias("resolution"), confidence.alias("confidence"), F.lit(method).alias("method"))


def ladder(accuracy: Column) -> Column:
    """Struct (resolution, confidence) by accuracy in metres (fixed values)."""
    a = F.coalesce(accuracy, F.lit(100.0))
    step = lambda r, c: F.struct(F.lit(r).alias("resolution"), F.lit(c).alias("confidence"))
    return F.when(a <= 50, step("point", 0.95)).when(a <= 150, step("building", 0.86)).when(a <= 600, step("street", 0.66)).when(a <= 2500, step("ward", 0.42)).otherwise(step("ward", 0.28))


def attached(geo: Column) -> Column:
    s = ladder(geo["accuracy_m"])
    return F.when(geo["lat"].isNotNull() & geo["lon"].isNotNull(), located(geo["lat"], geo["lon"], s["resolution"], s["confidence"], "attached_geo"))


def written(text: Column) -> Column:
    """Coordinates that the text states, if they are in range."""
    a, b = F.regexp_extract(text, COORDINATES, 1), F.regexp_extract(text, COORDINATES, 2)
    lat, lon = F.when(a != "", a.cast("double")), F.when(b != "", b.cast("double"))
    ok = lat.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(ok, located(lat, lon, F.lit("point"), F.lit(0.92), "text_coordinates"))


def generic_place(text: Column) -> Column:
    """The longest place word in the text, or null."""
    t = F.concat(F.lit(" "), place_norm(text), F.lit(" "))
    return let(t, lambda t: F.coalesce(*[F.when(t.contains(f" {g} "), F.lit(g)) for g in GENERIC]))


def names_of(gazetteer: DataFrame) -> DataFrame:
    """(key, name, lat, lon, token): each name or alias of at least 6 characters
    with its token of 4 or more characters that is rarest among all names."""
    g = gazetteer.select("name", "lat", "lon", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    g = g.select("name", "lat", "lon", place_norm(F.col("n")).alias("key")).filter(F.length("key") >= 6).distinct()
    t = g.select("name", "key", F.explode(F.array_distinct(F.split("key", " +"))).alias("token")).filter(F.length("token") >= 4)
    rare = t.groupBy("token").agg(F.countDistinct("key").alias("n"))
    pick = t.join(rare, "token").groupBy("name", "key").agg(F.min(F.struct("n", "token")).alias("r")).select("name", "key", "r.token")
    return g.join(pick, ["name", "key"])


def matched(messages: DataFrame, gazetteer: DataFrame, ident: str = "message_id", text: str = "raw_text") -> DataFrame:
    """(id, key, name, lat, lon): the longest name that a text holds as whole words.

    Names are found through their rarest token by an equality join; ties of
    equal length go to the first name in order.
    """
    names = small(names_of(gazetteer))
    m = messages.select(ident, place_norm(F.col(text)).alias("t")).filter("t <> ''")
    cand = m.select(ident, "t", F.explode(F.array_distinct(F.split("t", " +"))).alias("token")).join(names, "token")
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, " +", " "), F.lit(" "))
    hit = cand.filter(F.contains(padded(F.col("t")), padded(F.col("key"))))
    best = hit.groupBy(ident).agg(F.min(F.struct(-F.length("key"), F.col("key"), F.col("name"), F.col("lat"), F.col("lon"))).alias("b"))
    return best.select(ident, "b.key", "b.name", "b.lat", "b.lon")


def hex_cell(lat: Column, lon: Column, size_m: float, lat0: float = 9.62, lon0: float = 76.48) -> Column:
    """Id `q:r` of the hexagon of a plane about (lat0, lon0) that holds a point."""
    import math

    k = math.pi / 180 * 6_371_000.0
    x = (lon - F.lit(lon0)) * F.lit(k * math.cos(math.radians(lat0)))
    y = (lat - F.lit(lat0)) * F.lit(k)
    q, r = (F.lit(math.sqrt(3) / 3) * x - y / 3) / size_m, F.lit(2 / 3) * y / size_m
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws(":", fq.cast("bigint").cast("string"), fr.cast("bigint").cast("string"))
