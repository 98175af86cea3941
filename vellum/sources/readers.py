"""Readers for the reference's input formats. Every reader takes an explicit
schema (no inference on the hot path) and returns a DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from vellum.functions import text as T
from vellum.operators.corpus import join_lines
from vellum.sources import writers as W


#: Column that holds the text of a record that does not parse.
CORRUPT = "_corrupt_record"


def _with_corrupt(reader, schema: PT.StructType, corrupt: bool):
    if not corrupt:
        return reader.schema(schema)
    return reader.schema(PT.StructType([*schema.fields, PT.StructField(CORRUPT, PT.StringType())])).option("columnNameOfCorruptRecord", CORRUPT)


def read_jsonl(spark: SparkSession, path: str, schema: PT.StructType, corrupt: bool = False) -> DataFrame:
    """JSON-lines documents (one object per line; splittable). With ``corrupt`` a
    malformed line is kept as text in the column CORRUPT, its fields null."""
    return _with_corrupt(spark.read, schema, corrupt).json(path)


def read_json_records(spark: SparkSession, path: str, schema: PT.StructType,
                      multiline: bool = False, corrupt: bool = False) -> DataFrame:
    """Files of JSON arrays of records. ``multiline=True`` reads pretty-printed
    array files whole (one task per file, as the format requires); otherwise
    each line may hold one array (or one object) and lines are split across
    tasks. ``corrupt`` as in ``read_jsonl``."""
    return _with_corrupt(spark.read, schema, corrupt).option("multiLine", str(bool(multiline)).lower()).json(path)


def read_csv_columns(spark: SparkSession, path: str, schema: PT.StructType,
                     columns: Sequence[str], dropna: bool = True, corrupt: bool = False) -> DataFrame:
    """CSV with a header: keep ``columns`` (names may contain dots) and drop
    rows with a null in any of them. Column pruning reaches the CSV scan. With
    ``corrupt`` a malformed line is kept as text in the column CORRUPT, and no row is dropped."""
    df = _with_corrupt(spark.read, schema, corrupt).option("header", True).csv(path)
    cols = [F.col(f"`{c}`") for c in columns]
    out = df.select(*cols, *([CORRUPT] if corrupt else []))
    if corrupt or not dropna:
        return out
    # explicit predicate: na.drop() would parse the dots in names like Heart.Rate
    keep = cols[0].isNotNull()
    for c in cols[1:]:
        keep = keep & c.isNotNull()
    return out.where(keep)


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: (file, text) with the file's lines stripped of
    line breaks and joined with blanks (universal newlines, as Python's text
    mode reads them). Directory partitions (``split=...``) become columns.

    Spark's reader keeps every file's name, status and place in a partition on the
    driver. In a local (shared) folder tasks list and read the files, anew in each action,
    and the driver knows the folders only; elsewhere, and for packed files, Spark's reader does it."""
    raw = _texts_by_tasks(spark, path)
    if raw is None:
        raw = spark.read.text(path, wholetext=True)
        raw = raw.select(F.input_file_name().alias("_file"), "value", *[c for c in raw.columns if c != "value"])
    norm = F.regexp_replace(F.col("value"), "\r\n?", "\n")
    return raw.select(F.col("_file").alias("file"), join_lines(norm).alias("text"), *raw.columns[2:])


#: Files that one task reads at most on average, and bytes of text it hands over at once.
TASK_FILES = 10_000
BATCH_BYTES = 4 << 20
#: Endings of the files that Hadoop unpacks when it reads them.
PACKED = (".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy", ".passthrough")


def _texts_by_tasks(spark: SparkSession, path: str) -> DataFrame | None:
    """(_file, value, partition columns) of the files that Spark's reader finds under the
    local folder ``path``, listed and read by tasks; None where that reader is needed."""
    local = W._local_folder(spark, path)
    if local is None or not os.path.isabs(local) or re.search(r"[*?\[\]{}\\#;]", path) or not os.path.isdir(local):
        return None
    cores = spark.sparkContext.defaultParallelism
    found, level = [], [local]
    while level:
        looks = spark.sparkContext.parallelize(level, min(len(level), 4 * cores)).map(_look).collect()
        found += [(folder, *about) for folder, (_, *about) in zip(level, looks) if about[0]]
        level = [f"{folder}/{name}" for folder, (names, *_) in zip(level, looks) for name in names]
    if not found or any(packed for *_, packed in found):
        return None
    # the partition columns and their types are Spark's own, from one file of each folder
    firsts = ["file://" + re.sub(r"([*?\[\]{}\\])", r"\\\1", f"{folder}/{first}") for folder, first, *_ in found]
    seen = spark.read.option("basePath", path).text(firsts, wholetext=True)
    parts = [f for f in seen.schema.fields if f.name != "value"]
    if not parts:  # without them only the files of the folder itself count
        found = [x for x in found if x[0] == local]
        if not found:
            return None
        seen = spark.read.text(firsts[:1], wholetext=True)
    n_files, n_bytes = (sum(x[i] for x in found) for i in (2, 3))
    per_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(1, min(n_files, cores), -(-n_files // TASK_FILES), -(-n_bytes // per_task))
    inner = [PT.StructField(f"_{i}", f.dataType) for i, f in enumerate(parts)]
    url, name = PT.StructField("url", PT.StringType()), PT.StructField("name", PT.StringType())
    folders = seen.select(F.input_file_name().alias("url"), *[F.col(f"`{f.name}`").alias(x.name) for f, x in zip(parts, inner)])
    files = folders.repartition(min(len(found), 4 * cores)).mapInArrow(_names, PT.StructType([url, name, *inner]))
    texts = files.repartition(tasks, "url", "name").mapInArrow(_texts, PT.StructType([url, PT.StructField("value", PT.BinaryType()), *inner]))
    return texts.select(F.col("url").alias("_file"), F.col("value").cast("string").alias("value"),
                        *[F.col(x.name).alias(f.name) for f, x in zip(parts, inner)])


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What Spark lists of a folder, one at a time: no hidden and half-copied files."""
    with os.scandir(folder) as entries:
        for e in entries:
            if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")):
                yield e


def _look(folder: str) -> tuple[list[str], str | None, int, int, bool]:
    """A folder's folders, one of its files (one with content if there is any), how many
    files with content and bytes it has, and whether a file is packed."""
    folders, first, n_files, n_bytes, packed = [], None, 0, 0, False
    for e in _entries(folder):
        if e.is_dir():
            folders.append(e.name)
            continue
        size = e.stat().st_size
        if first is None or size and not n_files:
            first = e.name
        n_files, n_bytes, packed = n_files + (size > 0), n_bytes + size, packed or e.name.lower().endswith(PACKED)
    return folders, first, n_files, n_bytes, packed


def _names(batches):
    """The names of the files with content beside each given one, 10,000 at once."""
    for batch in batches:
        for i, url in enumerate(batch.column(0).to_pylist()):
            folder = url[:url.rindex("/") + 1]
            names = (e.name for e in _entries(_plain(folder)) if not e.is_dir() and e.stat().st_size)
            while some := list(islice(names, 10_000)):
                rows = batch.take(pa.array([i] * len(some)))
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(some)), pa.array(some), *rows.columns[1:]],
                                                 names=["url", "name", *batch.schema.names[1:]])


def _texts(batches):
    """The contents of the named files, about BATCH_BYTES at once."""
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in (0, 1))))
        start, size, texts = 0, 0, []
        for end, (folder, name) in enumerate(rows, 1):
            with open(_plain(folder) + name, "rb") as f:
                texts.append(f.read())
            size += len(texts[-1])
            if size >= BATCH_BYTES or end == len(rows):
                urls = pa.array([x + _quoted(y) for x, y in rows[start:end]])
                yield pa.RecordBatch.from_arrays([urls, pa.array(texts, pa.binary()), *batch.slice(start, end - start).columns[2:]],
                                                 names=["url", "value", *batch.schema.names[2:]])
                start, size, texts = end, 0, []


def _plain(url: str) -> str:
    """The path of a local file's URL."""
    return unquote(urlsplit(url).path)


def _quoted(name: str) -> str:
    """A file name in a URL as Java writes it: signs outside ASCII stay, but for blanks and controls."""
    return re.sub(r"[^\w!$&'()*+,\-.:;=@~]", lambda m: m[0] if m[0] > "\x9f" and not m[0].isspace() else quote(m[0]), name)


def read_split_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table written with ``partitionBy("split")``; choosing a split prunes
    the other folders at planning time."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_datasets(spark: SparkSession, root: str, names: Sequence[str], encoder: str | None = None,
                  split: str | None = None) -> DataFrame:
    """Several named datasets stored under ``root/encoder=../dataset=../split=..``
    read in one scan; the name list and encoder are partition filters."""
    df = spark.read.parquet(root).where(F.col("dataset").isin(list(names)))
    if encoder is not None:
        df = df.where(F.col("encoder") == encoder)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def rename_hub_splits(df: DataFrame, col: str = "split") -> DataFrame:
    """The public copy names its validation split ``val``; use ``valid``."""
    return df.withColumn(col, F.when(F.col(col) == "val", "valid").otherwise(F.col(col)))


def partition_values(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of partition columns, from the names of the files alone: the
    source of binary files opens none of them unless their content is asked for."""
    return spark.read.format("binaryFile").load(path).select(*columns).distinct()


def read_latest_runs(spark: SparkSession, path: str, schema: PT.StructType | str, keys: Sequence[str] = ("dataset",),
                     run: str = "run", fmt: str = "json") -> DataFrame:
    """The rows of the newest run of each key of a table partitioned by keys and run.
    The newest runs come from the folder names (one row a key reaches the driver) and
    are a partition filter, so older runs are not read and no row is joined."""
    newest = partition_values(spark, path, [*keys, run]).groupBy(*keys).agg(F.max(run).alias(run)).collect()
    rows = spark.read.schema(schema).format(fmt).load(path)
    names = [*keys, run]
    types = {f.name: f.dataType for f in rows.schema.fields}
    wanted = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in names]) for r in newest]
    return rows.where(F.struct(*[F.col(c) for c in names]).isin(*wanted)) if wanted else rows.where(F.lit(False))
