"""Session helpers.

The library never creates a cluster session behind the user's back: every
operator takes DataFrames. ``local_session`` is for tests and the bench only.
``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the running session and
only sets one (under a fresh scratch folder) when the session has none, which is
the case for local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Largest table the library broadcasts on its own decision. Every such choice
# measures the table first (row count times a measured or fixed row width);
# larger tables are joined by shuffle.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 32


def fits_broadcast(n_rows: int, row_bytes: int, budget: int | None = None) -> bool:
    """Whether ``n_rows`` rows of at most ``row_bytes`` bytes each fit the budget."""
    limit = BROADCAST_MAX_BYTES if budget is None else budget
    return n_rows * (row_bytes + ROW_OVERHEAD_BYTES) <= limit


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local[N] session configured the way the bench and tests expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vellum")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (set one only if unset)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    # No shared folder configured. A machine-local folder is only acceptable when
    # driver and executors are one process (local tests and the bench).
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach "
            "(e.g. on the cluster's distributed file system)")
    path = tempfile.mkdtemp(prefix="vellum-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Session setting: tables of the registered queries are dealt into so many
#: partitions when read. For test tables of one row group, whose scan is one
#: task; unset (the default) a scan is left as Spark splits it.
READ_PARTITIONS = "spark.vellum.readPartitions"


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one of the driver's parquet tables."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def materialize(df):
    """Cut lineage at a table that several branches read (a seeded order feeding
    splits and bands): a reliable checkpoint in the session's shared checkpoint
    folder, so lost executors never force recomputing the upstream text work."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, *cluster_by: str):
    """``df`` written as a Parquet table in the shared checkpoint folder and read
    back: later reads prune its columns and see its row counts, and lost executors
    only reread it. ``cluster_by`` deals rows out by these columns first."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vellum-scratch/stored-{uuid.uuid4().hex}"
    (df.repartition(*cluster_by) if cluster_by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
