"""Token-id sequence shaping for decoder labels: cut to the model length,
append EOS when shorter, pad every sequence of a batch to the batch's longest
with -100 (on the right or the left)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD_LABEL = -100


def truncate_eos(ids, max_length: int, eos: int) -> Column:
    """Keep the first ``max_length`` ids; append ``eos`` only when shorter."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(ids) < max_length, F.concat(ids, F.array(F.lit(eos)))).otherwise(
        F.slice(ids, 1, max_length))


def pad_batches(df: DataFrame, ids: str, batch: Column, pad: int = PAD_LABEL,
                side: str = "right") -> DataFrame:
    """Pad ``ids`` to the longest sequence of its batch. A batch is a small
    group (the loader's batch size), so the window partition is bounded."""
    if side not in ("right", "left"):
        raise ValueError(f"padding side must be right or left, not {side!r}")
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = F.array_repeat(F.lit(pad), longest - F.size(ids))
    padded = F.concat(F.col(ids), fill) if side == "right" else F.concat(fill, F.col(ids))
    return df.withColumn(ids, padded)
