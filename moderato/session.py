"""Session helpers: a local session for tests/bench and the shared scratch
folder (``spark.checkpoint.dir``) used to cut lineage or stage files."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "moderato") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def safe_unions(spark: SparkSession) -> None:
    """Spark 4.1 lets a union pass on a partitioning that its inputs share.  With adaptive
    execution these can be coalesced apart, and a grouping that trusts the union then counts one
    key in two tasks (``tests/test_session.py`` shows it).  Sessions that run these operators turn
    the claim off; other versions don't know the setting."""
    if spark.version.startswith("4."):
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: Spark's default of 10,000 rows holds tens of MB a task outside
    the heap, on both sides.  A setting of one's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; set a local one only when unset
    (tests and local runs)."""
    safe_unions(spark)
    small_batches(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="moderato-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder (eager; cuts the
    lineage; survives executor loss).  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """Writes ``df`` as Parquet below the shared checkpoint folder and reads it back:
    computed once, the lineage cut, nothing lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes made inside delete their shuffle files when they are complete, not when the driver next
    collects garbage: what is written is read from its files from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
