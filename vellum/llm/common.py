"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.session import checkpoint_dir

#: ASCII white space: what ``[^\x20\x09-\x0D]+`` splits on and ``bytes.split()`` too.
SPACE = " \t\n\x0b\x0c\r"

#: Documents handled together by the vectorised helpers (bounds worker memory).
BLOCK_BYTES = 1_500_000

#: Rows of an Arrow batch where whole texts go to Python workers.
TEXT_ROWS = 1000

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the session's shared checkpoint folder and
    read back: cuts the lineage, and lost executors only reread it. Nobody looks for
    the marker file of a finished job, which a driver on a local folder forks for."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run meanwhile, once, leaves no shuffle files: else they stay until
    the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_with(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of its rows that are counted while they are written,
    without jobs of their own: each job costs the driver some MB of short-lived memory."""
    seen = Observation()
    table = stored(df.observe(seen, *[c.alias(name) for name, c in aggregates.items()]))
    return table, seen.get


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands Python workers TEXT_ROWS rows at a time: Spark's 10,000
    whole texts are tens of MB in the JVM and, as objects, several times that in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def key_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3 constants)."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where
    each text's words begin (with the total last). A word's hash is a polynomial
    in random numbers of its bytes, from prefix sums over the whole block."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * powers(_MULT, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, len(data))[start]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, begin)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items: a polynomial over
    Z/2^64 built by doubling, finalised so that all bits depend on all items."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = _MULT
    out, length, power, size = None, 0, h, 1
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, length = power, size
            else:
                m = np.uint64(pow(mult, size, 1 << 64))
                take = min(len(out), len(power) - length)
                out = out[:take] * m + power[length:length + take]
                length += size
        rest >>= 1
        if rest:
            m = np.uint64(pow(mult, size, 1 << 64))
            power = power[:-size] * m + power[size:] if len(power) > size else power[:0]
            size *= 2
    return mix(out[:n])


def blocks(batches, id_col: str = "doc_id", text_col: str = "text"):
    """Arrow batches as (ids, texts as bytes), BLOCK_BYTES of text at a time."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_col))
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
        for lo, n in cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK_BYTES):
            yield ids.slice(lo, n).to_pylist(), texts.slice(lo, n).to_pylist()


def cuts(sizes: np.ndarray, most: int):
    """(start, number) of consecutive parts whose sizes add up to about ``most``."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)))
        yield lo, hi - lo
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``start, start+1, ...`` runs."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    step = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    step[0] = s[0]
    at = np.cumsum(n)[:-1]
    step[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(step)
