"""Sinks of streaming queries that may see a batch twice.

``foreachBatch`` gives a batch again when a query is restarted before its commit was
written. Here a batch owns one folder, named by its id, which a replay overwrites, so
the table is the same however often a batch is written. Views add the batches up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import scoring as S
from vellum.sources import writers as W

BATCH = "batch"


def stream_of(rows: DataFrame, path: str, keys: Sequence[str], batches: int) -> DataFrame:
    """``rows`` written to ``path`` and read back as a stream of about ``batches``
    micro-batches. ``keys`` deal the rows into so many folders, whose files follow
    their size: neither a writer nor a reader has a fixed share of the rows."""
    spark = rows.sparkSession
    dealt = rows.withColumn("split", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int"))
    W.write_split_table(dealt, path)
    files = len(spark.read.schema(dealt.schema).parquet(path).inputFiles())
    reader = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", max(1, -(-files // batches)))
    return reader.parquet(path).drop("split")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a batch as its folder of the table; written again, it replaces itself.
    A batch without rows leaves an empty folder's place: nothing of an earlier try."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def idempotent_sink(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``stream``, transformed by the function that a batch job would
    use, into its own folder of ``path``. Processes what there is (``availableNow``) and
    resumes from ``checkpoint``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(transform(batch), batch_id, path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


F1_SUMS = "n long, sum_pr double, sum_rc double"


def token_f1_sums(pairs: DataFrame, by: Sequence[str], ref: str = "ref", pred: str = "pred") -> DataFrame:
    """Sums of token precision and recall of each group: what batches add up."""
    rows = S.token_f1_rows(pairs, ref, pred, by)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_pr").alias("sum_pr"), F.sum("_rc").alias("sum_rc"))


def token_f1_history(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of each group over all batches of the table."""
    total = spark.read.parquet(path).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sum_pr", "sum_rc")])
    p, r = F.col("sum_pr") / F.col("n"), F.col("sum_rc") / F.col("n")
    return total.select(*by, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
