"""Sinks and readers for results, audit entries and fitted calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "created_at timestamp_ntz, actor string, action string, entity_type string, entity_id string, evidence string"
STEPS = "head string, x array<double>, y array<double>, n bigint"


def append_results(rows: DataFrame, path: str) -> None:
    """Append one JSON object per run."""
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.read.schema(schema).json(path)


def record(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Append audit entries, partitioned by the kind of entity."""
    entries.select([x.split(" ")[0] for x in AUDIT.split(", ")]).write.mode("append").partitionBy("entity_type").parquet(path)


def recent(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The newest audit entries, newest first."""
    return spark.read.schema(AUDIT).parquet(path).orderBy(F.desc("created_at"), F.desc("entity_id")).limit(limit)


def for_entity(spark: SparkSession, path: str, kind: str, ident: str) -> DataFrame:
    """All audit entries of one entity, newest first; other kinds are pruned."""
    return spark.read.schema(AUDIT).parquet(path).filter((F.col("entity_type") == kind) & (F.col("entity_id") == ident)).orderBy(F.desc("created_at"))


def save_calibration(steps: DataFrame, path: str) -> None:
    """Write the step functions of all heads."""
    steps.select("head", "x", "y", "n").coalesce(1).write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEPS).json(path)


def calibrated(df: DataFrame, steps: DataFrame, head: str, raw: str, out: str = "calibrated") -> DataFrame:
    """Interpolate `raw` between the thresholds of `head`, within [.02, .98];
    outside the thresholds the nearest one counts.  `steps` has one row per head."""
    s = steps.filter(F.col("head") == head).select(F.col("x").alias("_x"), F.col("y").alias("_y")).limit(1)
    d = df.crossJoin(F.broadcast(s))  # one row
    i = F.size(F.filter("_x", lambda t: t <= F.col(raw)))
    x0, y0 = F.try_element_at("_x", i), F.try_element_at("_y", i)
    x1, y1 = F.try_element_at("_x", i + 1), F.try_element_at("_y", i + 1)
    first, last = F.element_at("_y", 1), F.element_at("_y", -1)
    v = F.when(i == 0, first).when(i == F.size("_x"), last).otherwise(y0 + (y1 - y0) * (F.col(raw) - x0) / (x1 - x0))
    return d.withColumn(out, F.greatest(F.lit(0.02), F.least(v, F.lit(0.98)))).drop("_x", "_y")
