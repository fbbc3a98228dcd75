"""Session helpers: configuration, shared storage and broadcast bounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that any operator here will broadcast.  A side is only
#: broadcast after its size was counted against this bound; beyond it the same
#: join runs as a shuffle join.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """Return a local session configured as the operators expect."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TW_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: `spark.checkpoint.dir`, or a new
    temporary folder where that is unset (single-machine runs only)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Spark deletes an execution's shuffle files at its end, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "t", release: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, the
    result survives the loss of executors, and later reads are columnar.  `release`
    deletes the shuffle files of the writing as soon as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the tables that `cut` has written, once their results have been
    stored or are not needed any more; returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint `df` for broadcast if it has at most `rows` rows, else leave the
    choice of a shuffle join to the optimizer."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def bounded_sample(df: DataFrame, ident: str, n: int) -> DataFrame:
    """At most `n` rows, the first by a hash of `ident`.  Rows are thinned by that
    hash before they are ordered, so that what partitions send is bounded too."""
    h = F.pmod(F.xxhash64(ident), F.lit(1 << 30))
    total = df.count()
    if total > 2 * n:
        df = df.filter(h < F.lit(int(1.5 * n / total * (1 << 30)) + 1))
    return df.orderBy(F.xxhash64(ident), ident).limit(n)
