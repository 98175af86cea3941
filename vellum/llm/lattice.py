"""Vectors as integers floor(scale * x), for operators that compare them exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, limit: int) -> DataFrame:
    """(vec_id, x) of the vectors that are not null and hold no null or non-finite
    component. An integer of ``limit`` or more in size is an error: products of
    such leave the range of long."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(v, lambda c: F.abs(c) < limit / scale)
    scaled = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    x = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component is {limit / scale:g} or more")).cast("array<bigint>"))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
