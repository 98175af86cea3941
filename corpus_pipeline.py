"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
every stage's rows as Parquet in the session's shared folder and rereads them.
All but the last return the columns of ``documents``; where a stage changes a
text, ``n_chars`` follows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard_join, mixing, packing, quality, sanitise
from vellum.llm.common import stored
from vellum.llm.queries import BYTE_RANKS, PACK_TOKENIZER, PATTERN, PIECE_MODEL
from vellum.session import table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser-fertility rules keep."""
    judged, column = quality.quality(docs, PIECE_MODEL, BYTE_RANKS, PATTERN)
    return judged.where(F.col(f"{column}.kept")).drop(column)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return jaccard_join.one_of_each(docs)


def sanitising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it generalised."""
    return _counted(sanitise.sanitised(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in order of training position."""
    return _counted(mixing.mixed_documents(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, in training order."""
    return packing.pack(_placed(docs), PACK_TOKENIZER, PATTERN, order_col="place", added=True)


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and place: where the row stands in the table as it was written.
    A scan deals files by size, so their order is that of the part numbers, and of the
    file numbers inside a part where the writer limits a file's rows. A table that
    was not read from files is in the order of its partitions."""
    try:
        file = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", file.getField("file_name").alias("file"), file.getField("row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    part, number = (F.coalesce(F.regexp_extract("file", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)\."))
    return rows.select("doc_id", "text", (part * F.lit(1 << 44) + number * F.lit(1 << 32) + F.col("row")).alias("place"))


STAGES = [("quality_rules", quality_rules), ("jaccard_dedup", jaccard_dedup), ("sanitising", sanitising),
          ("source_mix", source_mix), ("sequence_packing", sequence_packing)]

#: The first stage tokenises; SQL cannot express it. The tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
