"""Synthetic happenings and reports, deterministic in a seed: each value is a
function of a hash of the row's number, so any part can be made anywhere."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Scenario:
    """Dials of a scenario; defaults stand for what a file leaves out."""

    seed: int = 42
    total_messages: int = 6000
    hours: float = 6.0
    tick_minutes: int = 15
    centre: tuple[float, float] = (9.62, 76.48)
    radius_km: float = 25.0
    duplicate_rate: float = 0.25
    amplified_share: float = 0.55
    amplified_extra: float = 4.0
    hoax_rate: float = 0.03
    geo_share: float = 0.35
    needs: dict[str, float] = field(default_factory=lambda: {"evacuation": 0.3, "medical": 0.15, "water": 0.2, "food": 0.15, "shelter": 0.1, "sanitation": 0.1})

    def per_happening(self) -> float:
        return 1 + self.duplicate_rate / (1 - self.duplicate_rate) + self.amplified_share * self.amplified_extra

    @staticmethod
    def load(path: str) -> Scenario:
        """From a YAML file; unknown keys are refused."""
        import yaml

        with open(path) as f:
            raw = yaml.safe_load(f) or {}
        if "centre" in raw:
            raw["centre"] = tuple(raw["centre"])
        return Scenario(**raw)


def uniform(seed: int, name: str, *cols: str) -> Column:
    """A number in (0, 1) that depends on the seed, a name and columns."""
    h = F.xxhash64(F.lit(seed), F.lit(name), *cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def chosen(u: Column, weights: dict[str, float]) -> Column:
    """One of the keys with the given weights."""
    total, low, out = sum(weights.values()), 0.0, None
    for k, w in weights.items():
        low += w / total
        out = F.when(u < low, k) if out is None else out.when(u < low, k)
    return out.otherwise(list(weights)[-1])


def truth(spark: SparkSession, s: Scenario) -> DataFrame:
    """Happenings: place on a disc, need, people, urgency, onset in minutes, hoax."""
    n = max(1, int(s.total_messages / s.per_happening()))
    d = spark.range(n).withColumnRenamed("id", "k")
    u = lambda name: uniform(s.seed, name, "k")
    r, a = F.sqrt(u("r")) * s.radius_km * 1000, u("a") * 2 * math.pi
    k = 180 / math.pi / 6_371_000.0
    peak = math.log(0.35) + 0.5
    z = F.sqrt(-2 * F.log(u("z1"))) * F.cos(2 * math.pi * u("z2"))
    onset = F.least(F.lit(0.995), F.exp(peak + 0.7 * z)) * s.hours * 60
    return d.select(
        F.format_string("T-%09d", "k").alias("truth_id"), "k",
        (F.lit(s.centre[0]) + r * F.sin(a) * k).alias("lat"), (F.lit(s.centre[1]) + r * F.cos(a) * k / math.cos(math.radians(s.centre[0]))).alias("lon"),
        chosen(u("need"), s.needs).alias("need_type"), (1 + F.floor(-8 * F.log(u("people")))).cast("int").alias("people"),
        chosen(u("urgency"), {"none": 0.6, "mild": 0.2, "moderate": 0.15, "critical": 0.05}).alias("medical_urgency"),
        onset.alias("onset_min"), (u("hoax") < s.hoax_rate).alias("is_hoax"),
    )


def report_count(s: Scenario, hoax: Column, *key: str) -> Column:
    """Geometric repeats (at most 6) and an exponential echo of some, at most 40."""
    again = F.least(F.lit(6), F.floor(F.log(uniform(s.seed, "again", *key)) / math.log(s.duplicate_rate)))
    mean = F.when(hoax, s.amplified_extra * 2.2).otherwise(s.amplified_extra)
    echo = F.when(uniform(s.seed, "echo?", *key) < s.amplified_share, F.floor(-mean * F.log(uniform(s.seed, "echo", *key)))).otherwise(0)
    return F.least(F.lit(40), 1 + again + echo).cast("int")


def reports(truths: DataFrame, s: Scenario) -> DataFrame:
    """Reports of each happening with delay, headcount, channel, sender and accuracy."""
    d = truths.withColumn("n", report_count(s, F.col("is_hoax"), "k")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = lambda name: uniform(s.seed, name, "k", "i")
    z = lambda name: F.sqrt(-2 * F.log(u(name + "1"))) * F.cos(2 * math.pi * u(name + "2"))
    delay = F.when(F.col("i") == 1, 0.0).otherwise(F.abs(22 + 26 * z("delay")))
    return d.select(
        F.format_string("MSG-%09d-%02d", "k", "i").alias("message_id"), "truth_id", "need_type", "is_hoax",
        F.greatest(F.lit(1), F.round(F.col("people") * (1 + 0.18 * z("people")))).cast("int").alias("people"),
        (F.col("onset_min") + delay).alias("minute"),
        chosen(u("channel"), {"sms": 0.35, "chat": 0.25, "social": 0.2, "web_form": 0.1, "call_transcript": 0.1}).alias("channel"),
        F.substring(F.sha2(F.concat_ws("::", F.lit(str(s.seed)), F.when(F.col("is_hoax"), F.col("truth_id")).otherwise(F.concat_ws("/", "truth_id", "i"))), 256), 1, 24).alias("sender_hash"),
        F.when(u("geo") < s.geo_share, chosen(u("acc"), {"12": 1, "35": 1, "90": 1, "400": 1, "1500": 1}).cast("double")).alias("accuracy_m"),
    )
