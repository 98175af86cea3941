"""Mixing sources to target weights along a curriculum.

Every source has a weight and a schedule: the rate at which it is demanded at
training time t in [0, 1]. The rate is piecewise linear, ``1 + slope * (1 - 2t)``
(integral 1), with slope > 0 for sources wanted early. Its integral, the
cumulative demand ``D(t) = t + slope * (t - t*t)``, is inverted in closed form:
the word at cumulative offset c of a source that must give T words has the
position ``D^-1(c / T)``. A source whose target exceeds its size is read again
(up to ``max_repeats`` times); every copy of a document is one row with its own
position, and rows are range-sorted by position.

Targets are water-filling: sources share the total by weight, a source stops at
``max_repeats`` times its size, and the excess goes to the others by weight.
With the sources in order of cap / weight, the level is a ratio of running sums,
so no loop is needed.

Inside a source the order is the md5 of the document id, so reruns agree. The
running sum goes over buckets of that hash (their number follows the row
count), so a source with a third of all rows is spread over many tasks.

Nulls: a null text has size 0 and is never taken; null sources are one source,
last in order; a null doc_id is ordered by its text alone. Rows equal in id and
text are separate rows, in any order, taken like any others. An empty table
gives an empty result; a corpus without words takes nothing. Only the columns
named are read, the others are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slope of the demand rate by place of the source in its weight cycle.
SLOPES = (0.5, 0.0, -0.5)
ROWS_PER_BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> rank, weight and target of each source. One row
    per source: windows over the whole of it order sources, not documents."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    everything = W.partitionBy()
    # cap / weight in exact order: compare cap * (product of the other weights)
    scale = 1
    for w in weights:
        scale *= w
    ratio = F.col("cap") * (F.lit(scale) / F.col("weight")).cast("long")
    order = W.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    levels = (ranked.withColumn("ratio", ratio)
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("capped", F.coalesce(F.sum("cap").over(order), F.lit(0)))
              .withColumn("left_weight", F.sum("weight").over(everything)
                          - F.coalesce(F.sum("weight").over(order), F.lit(0))))
    # the level if this source and all after it stay uncapped; it holds from the first source that fits
    num, den = F.col("total") - F.col("capped"), F.col("left_weight")
    fits = num * scale <= F.col("ratio") * den
    first = F.min(F.when(fits, F.struct(F.col("ratio"), F.col("rank"), num.alias("num"), den.alias("den")))).over(everything)
    share = F.col("weight") * F.col("first.num")
    capped = F.struct("ratio", "rank") < F.struct(F.col("first.ratio").alias("ratio"), F.col("first.rank").alias("rank"))
    target = F.when(F.col("first").isNull() | capped, F.col("cap").cast("double")).otherwise(
        share.cast("double") / F.col("first.den").cast("double"))
    return levels.withColumn("first", first).select("source", "source_size", "rank", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_repeats: int = MAX_REPEATS, n_rows: int | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with size, source, source_size,
    target, start (words before it in its source) and taken (words the mix
    takes from it, repeats counted)."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       n_words(F.col(f"`{text_col}`").cast("string")).alias("size"),
                       F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("place"),
                       F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tie"))
    total = docs.count() if n_rows is None else n_rows
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    digits = len(f"{buckets - 1:x}") if buckets > 1 else 1
    # never null, so the window and the join below deal rows by the same keys: texts move once
    rows = rows.withColumn("bucket", F.substring("place", 1, digits)).withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = rows.groupBy("source", "named", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    offsets = sums.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "named", "bucket", "bucket_start", "source_size", "rank", "target")
    inside = W.partitionBy("named", "bucket").orderBy("place", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["named", "bucket"])
    start = F.col("bucket_start") + F.col("inside")
    words = F.round(F.col("target")).cast("long")

    def of_copy(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), words - start - F.lit(k) * F.col("source_size")))

    taken = sum((of_copy(k) for k in range(1, max_repeats)), of_copy(0))
    return placed.select("doc", "source", "size", "source_size", "target", (F.col("rank") % len(SLOPES)).cast("int").alias("cycle"),
                         start.alias("start"), F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))


def position(offset: Column, target: Column, cycle: Column, slopes=SLOPES) -> Column:
    """Training position in [0, 1) of the word at ``offset`` of its source:
    the inverse of ``D(t) = (1 + s) t - s t*t`` at offset / target."""
    s = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), cycle + 1)
    y = offset.cast("double") / target
    root = F.sqrt(F.greatest((1 + s) * (1 + s) - 4 * s * y, F.lit(0.0)))
    return F.when(target <= 0, 0.0).when(s == 0, y).otherwise((1 + s - root) / (2 * s))


def curriculum(mixed: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per copy that the mix takes: doc, take (its words; fewer than
    size only for the copy at a source's target) and position; range-sorted."""
    copies = mixed.where("taken > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_repeats), F.ceil(F.col("taken") / F.col("size")).cast("int")) - 1)))
    take = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    at = position(F.col("start") + F.col("copy") * F.col("source_size"), F.col("target"), F.col("cycle"))
    return copies.withColumn("take", take).withColumn("position", at).orderBy("position", "copy")


def mixed_documents(docs: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """The training stream: rows of ``docs`` with all their columns, repeated as
    the mix takes them, in order of position. Only the copy that meets a source's
    target is cut, after its last taken word."""
    rows = curriculum(mix(docs, text_col=text_col, **columns))
    text = F.col(f"doc.`{text_col}`")
    up_to_word = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.when(F.col("take") >= F.col("size"), text).otherwise(F.array_join(F.slice(up_to_word, F.lit(1), F.col("take").cast("int")), ""))
    return rows.select(*[(cut if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def taken_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **columns) -> DataFrame:
    """Every row of ``docs``: its id, size, source_size, target, taken (words of
    the copies placed in the curriculum, 0 without any) and first_position (of
    its first copy, null without any), range-sorted by first_position."""
    mixed = mix(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, **columns)
    mixed = mixed.withColumn("doc", F.struct(F.col(f"doc.`{id_col}`").alias(id_col)))
    mixed = stored(mixed.withColumn("row", F.monotonically_increasing_id()))  # rows equal in id and text stay apart
    placed = curriculum(mixed, columns.get("max_repeats", MAX_REPEATS)).groupBy("row").agg(
        F.sum("take").alias("placed"), F.min("position").alias("first_position"))
    joined = mixed.join(placed, "row", "left").orderBy(F.col("first_position").asc_nulls_last(), "row")
    return joined.select(F.col(f"doc.`{id_col}`").alias(id_col), "size", "source_size", "target",
                         F.coalesce("placed", F.lit(0)).cast("long").alias("taken"), "first_position")
