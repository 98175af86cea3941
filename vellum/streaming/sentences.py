"""Structured Streaming entry for the stateless part of the corpus job.

The reference has no streaming operator; sentence splitting, cleaning and
record rendering are row-local, so the same Column functions run unchanged on
a ``readStream`` frame. Shuffles (ordinals, splits, top-k, corpus metrics)
stay batch jobs over the sink's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import corpus as C


def clean_sentence_stream(stream: DataFrame, min_words: int = 8, max_words: int = 128,
                          keep=("doc_id", "lang")) -> DataFrame:
    """documents stream -> clean sentences stream (doc keys, pos, text, n_words)."""
    return C.clean_sentences(C.sentences(stream, keep=list(keep)), min_words, max_words)


def run_to_table(spark: SparkSession, source_dir: str, schema, out_path: str, checkpoint: str,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Process every parquet file of ``source_dir`` (a folder or a glob, on any
    file system Spark reads) once (``availableNow``) and append clean sentences
    to ``out_path``; progress is kept in ``checkpoint`` so a restarted job
    resumes where it stopped. ``max_files_per_trigger`` bounds a micro-batch;
    unset, one batch takes all files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (clean_sentence_stream(stream).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).option("path", out_path)
         .outputMode("append").trigger(availableNow=True).start())
    return q
