"""Sinks. Tables are written by Spark's own writers, partitioned by the
columns later reads filter on (split, dataset, run), so readers prune."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory (never a
    machine-local temporary folder)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/vellum-scratch/{name}-{uuid.uuid4().hex}"


#: Hash partitions of a write by split, before small ones are put together: so many
#: that two splits hardly meet in one, where a large one would cut the other up.
SPLIT_PARTITIONS = 1024


def write_split_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Named splits in one table, one folder per split. Rows are rebalanced by
    split before the write: a small split is one file however many tasks hold its
    rows, and a large one is cut into files of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so no task writes a hot split alone."""
    df.hint("rebalance", SPLIT_PARTITIONS, "split").write.mode(mode).partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", cluster_by: Sequence[str] = ()) -> None:
    """A table whose files follow its size, not the number of tasks; with
    ``cluster_by``, rows are range-clustered by these columns, so readers skip
    files by their minima and maxima."""
    even = df.hint("rebalance")
    if cluster_by:
        even = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    even.write.mode(mode).parquet(path)


def write_predictions(preds: DataFrame, path: str, part: str = "all") -> None:
    """(dataset, run, text, pred) as JSON lines partitioned by dataset, run and
    part: every run is kept (the reference overwrote the file on each run). A
    run written in several calls names each of them with ``part``. Dynamic
    partition overwrite: a retried part replaces itself, other parts and runs
    stay."""
    (preds.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "run", "part").json(path))


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each row becomes one line holding a JSON array of one record (the
    hand-over format of the reference, split into lines so it stays splittable).
    Spark's own JSON generator writes every double, long and timestamp so that it
    reads back unchanged; nulls are written as such."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    line = F.to_json(F.array(record), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_text_files(df: DataFrame, path: str, text_col: str = "text",
                     partition_by: Sequence[str] = ()) -> None:
    """One file per row (a document per file), optionally under partition
    folders. Without its native library Hadoop starts a process for the mode of each
    file that it creates in a local (shared) folder, so there the tasks write the
    files themselves; elsewhere Spark's writer does."""
    spark, rows = df.sparkSession, df.select(*partition_by, text_col)
    local = _local_folder(spark, path)
    if local is None:
        w = rows.write.mode("errorifexists").option("maxRecordsPerFile", 1)
        (w.partitionBy(*partition_by) if partition_by else w).text(path)
        return
    os.makedirs(local)  # an error if it exists
    names = [F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(partition_by)]
    cols, name = [str(c) for c in partition_by], uuid.uuid4().hex

    def run(batches):
        task = TaskContext.get()
        attempt, n = f"{local}/_attempt-{task.taskAttemptId()}", 0
        made: dict[str, list[str]] = {}
        os.makedirs(attempt)
        for batch in batches:
            for *values, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder = "/".join(f"{_path_name(c)}={_path_name(v)}" for c, v in zip(cols, values))
                if folder not in made:
                    os.makedirs(f"{attempt}/{folder}", exist_ok=True)
                    made[folder] = []
                made[folder].append(f"part-{task.partitionId():05d}-{name}-c{n:06d}.txt")
                n += 1
                with open(f"{attempt}/{folder}/{made[folder][-1]}", "wb") as f:
                    f.write((text or "").encode() + b"\n")
        # only whole attempts get in; a second one replaces the files of the first
        for folder, files in made.items():
            os.makedirs(f"{local}/{folder}", exist_ok=True)
            for file in files:
                os.rename(f"{attempt}/{folder}/{file}", f"{local}/{folder}/{file}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(*names, F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder of the local file system, else None."""
    url = urlparse(path)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return url.path if (url.scheme or urlparse(default).scheme) == "file" and url.netloc in ("", "localhost") else None


def _path_name(value: str | None) -> str:
    """A partition column's name or value in a path, written as Spark writes it."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


_ESCAPED = {*map(chr, range(1, 0x20)), "\x7f", *"\"#%'*/:=?\\{[]^"}


def write_attr_results(results: DataFrame, path: str) -> None:
    """Accuracies (dataset, attr, run, ...) as one folder per dataset, attribute
    and run; a retried run replaces its own folder."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "attr", "run").parquet(path))


def attr_predictions(rows: DataFrame, preds: DataFrame, key: str = "row_id", run: str = "run",
                     pred: str = "pred", drop: Sequence[str] = ("embedding",)) -> DataFrame:
    """Row attributes without the vector, plus the list of predictions in run
    order (one entry per run: bounded per row)."""
    lists = preds.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(pred).alias("p")))),
                    lambda s: s["p"]).alias(pred))
    return rows.drop(*[c for c in drop if c in rows.columns]).join(lists, key)


#: Partition column of a table written by ``write_checked``, and its values.
STATUS, VALID, QUARANTINED = "status", "valid", "quarantined"


def write_checked(df: DataFrame, checks: dict[str, Column], path: str, casts: dict[str, Column] | None = None) -> None:
    """Valid rows and bad ones written apart in one pass over the input: the folders
    ``status=valid`` and ``status=quarantined`` of one table. A row is valid when every
    check holds (null: it does not); the names of the failed ones are its ``reasons``.
    ``casts`` replace columns of valid rows; a bad row keeps what was read as JSON text in
    ``raw`` (with the corrupt record's text, if any), and casts that would be lossy
    never run on it."""
    casts = casts or {}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    judged = df.withColumn("reasons", failed)
    bad = F.size("reasons") > 0
    cols = [F.when(~bad, casts.get(c, F.col(f"`{c}`"))).alias(c) for c in df.columns]
    rows = judged.select(*cols, "reasons", F.when(bad, raw).alias("raw"), F.when(bad, QUARANTINED).otherwise(VALID).alias(STATUS))
    rows.write.mode("errorifexists").partitionBy(STATUS).parquet(path)


def read_checked(spark: SparkSession, path: str, status: str = VALID) -> DataFrame:
    """The valid (or the quarantined) rows of ``write_checked``, by partition pruning."""
    rows = spark.read.parquet(path).where(F.col(STATUS) == status).drop(STATUS)
    return rows.drop("reasons", "raw") if status == VALID else rows.select("raw", "reasons")
