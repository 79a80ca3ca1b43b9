"""Session construction and cluster settings used across the package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Broadcast only below this many bytes, as estimated by Catalyst; above it the
# same join runs as a shuffle join.
BROADCAST_BYTES_LIMIT = 64 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "concordat") -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        if master.startswith("local"):
            # One JVM does all the work; its default heap of 1 GiB is too small.
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    A temporary folder is used only in local mode, where driver and executors
    are one process on one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="concordat-ckpt-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for a plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimate is under ``limit``."""
    return df.hint("broadcast") if estimated_bytes(df) <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (Arrow UDFs need it).

    The package is zipped once per application and distributed with the job.
    """
    sc = spark.sparkContext
    if getattr(sc, "_concordat_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="concordat-pkg-")) / "concordat.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._concordat_shipped = True
