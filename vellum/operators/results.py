"""The long ``metrics`` table and its views (history, latest, report) and the
per-run sink that replaces the reference's per-run JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import scoring as S


def metric_history(metrics: DataFrame, keys: Sequence[str] = ("dataset", "metric"),
                   run: str = "run", value: str = "value") -> DataFrame:
    """One row per (dataset, metric): values ordered by run, the value of the
    latest run and the number of runs. Groups hold one row per run (bounded
    by the number of runs, not by the data)."""
    return metrics.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias("history"),
        F.max_by(value, run).alias("latest"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def latest_run(metrics: DataFrame, keys: Sequence[str] = ("dataset",), run: str = "run") -> DataFrame:
    """Rows of the highest run per key (the value a single-file sink would keep)."""
    top = metrics.groupBy(*keys).agg(F.max(run).alias("_top"))
    return metrics.join(top, list(keys)).where(F.col(run) == F.col("_top")).drop("_top")


def report(metrics: DataFrame) -> DataFrame:
    """Sorted metric listing (what the reference prints after evaluation)."""
    return metrics.select("dataset", "run", "metric", "value").orderBy("dataset", "run", "metric")


#: What names one value of the metrics table, and so one of its folders.
METRIC_KEYS = ("dataset", "split", "run", "metric")


def append_metrics(metrics: DataFrame, path: str, split: str = "test") -> None:
    """Add metric rows to the metrics table; ``split`` names the split of rows
    without that column. The table is partitioned by METRIC_KEYS and written
    with dynamic partition overwrite, so a retried or repeated run replaces just
    the metrics it writes again; its other metrics, other splits and other runs
    are left as they are."""
    if "split" not in metrics.columns:
        metrics = metrics.withColumn("split", F.lit(split))
    (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*METRIC_KEYS).parquet(path))


#: The metrics of a reconstruction run, in the order of its report.
RECONSTRUCTION = ("precision", "recall", "f1", "rouge1", "rouge2", "rougeL", "rougeLsum", "bleu1", "bleu2", "bleu3", "bleu4")


def score_runs(predictions: DataFrame, path: str, ref: str = "text", pred: str = "pred", key: str = "pair_id",
               split: str = "test", n_samples: int = 1000, seed: int = 2023) -> DataFrame:
    """Decoded runs in, stored history out: all metrics of every (dataset, run) of
    ``predictions``, added to the metrics table at ``path``; returns the table's
    history. A run scored again replaces its own values, other runs stay."""
    wide = S.reconstruction_metrics(predictions, ref, pred, key, ["dataset", "run"], n_samples, seed)
    append_metrics(S.to_long(wide, ["dataset", "run"], RECONSTRUCTION), path, split)
    return metric_history(predictions.sparkSession.read.parquet(path).where(F.col("split") == split))
