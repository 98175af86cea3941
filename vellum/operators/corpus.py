"""Sentence-corpus operators (job A): documents -> sentences -> quality filter ->
seeded order -> dense ordinal -> fixed-size splits and length bands.

Order is semantic in the reference (slices of a shuffled list), so every table
here carries an explicit order: ``_h = md5(seed:key)`` with the unique key as
tie-breaker. A dense ordinal over that order is built without a single-partition
sort (see ``with_ordinal``), so slicing is a filter, never a driver-side take.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.session import fits_broadcast, materialize, stored

# Ordinal buckets are prefixes of the md5 order key, as wide as the row count
# needs: about ORDINAL_TARGET_ROWS rows per fine bucket and at least 4 buckets
# per task slot (1 to 8 hex digits; 6 digits, ~30,000 rows each, at 5e11 rows).
# Up to 4 digits the bucket offsets (<= 65,536 rows) are broadcast; beyond,
# super buckets 4 digits shorter each span at most 65,536 fine buckets in their
# running-sum window, and the super offsets, the only broadcast table, have at
# most 16**4 rows.
ORDINAL_TARGET_ROWS = 50_000
ORDINAL_MAX_HEX = 8
ORDINAL_SUPER_SPAN_HEX = 4


def ordinal_bucket_hex(n_rows: int, slots: int) -> int:
    """Hex digits of the fine ordinal buckets for ``n_rows`` rows."""
    want = max(n_rows / ORDINAL_TARGET_ROWS, 4 * slots, 1)
    digits = 1
    while 16**digits < want and digits < ORDINAL_MAX_HEX:
        digits += 1
    return digits


def sentences(
    docs: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    splitter: Callable[[Column], Column] | None = None,
    n_words: str | None = None,
) -> DataFrame:
    """One row per sentence: ``keep`` columns, ``pos`` (0-based), stripped ``text``
    and, where a name is given, its number of words.

    ``splitter`` maps a text Column to an array Column of sentences; the default
    breaks after ``.``, ``!`` or ``?`` followed by white space.
    """
    split = (splitter or T.split_sentences)(F.col(text_col))
    # stripped (and counted) inside the array: as a projection above the explode, the
    # expression would be written into every condition that a later filter pushes down
    each = F.transform(split, T.strip)
    if n_words is None:
        return docs.select(*keep, F.posexplode(each).alias("pos", "text"))
    each = F.transform(each, lambda t: F.struct(t.alias("text"), T.word_count_stripped(t).alias("n")))
    rows = docs.select(*keep, F.posexplode(each).alias("pos", "_s"))
    return rows.select(*keep, "pos", F.col("_s.text").alias("text"), F.col("_s.n").alias(n_words))


def clean_sentences(sents: DataFrame, min_words: int = 8, max_words: int = 128,
                    text_col: str = "text") -> DataFrame:
    """Keep sentences passing ``sentence_clean``, with ``n_words`` (the
    sentences of ``sentences`` are already stripped, and counted on request)."""
    known = "n_words" in sents.columns
    ok = T.sentence_clean(F.col(text_col), min_words, max_words, stripped=True, n_words=F.col("n_words") if known else None)
    return sents.where(ok) if known else sents.where(ok).withColumn("n_words", T.word_count_stripped(text_col))


# A dropped row is sent as its id.
DEDUP_ROW_BYTES = 8


def md5_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              broadcast_bytes: int | None = None) -> DataFrame:
    """Exact-copy removal: keep the row with the smallest id per md5 of the text.
    NULL texts are copies of one another.

    Every text is hashed once; the (md5, id) table is kept in the checkpoint
    folder. Copy groups come from a map-side-combined aggregate, so a group
    holding a large share of all rows collapses before the shuffle. Only the
    ids to drop meet the documents: they are counted, and while they fit the
    broadcast budget (``broadcast_bytes``) the documents are not shuffled.
    """
    h = materialize(df.select(F.md5(F.col(text_col)).alias("_m"), F.col(id_col)))
    copies = h.groupBy("_m").agg(F.min(id_col).alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n_drop = copies.agg(F.sum(F.col("_n") - 1)).first()[0] or 0
    if n_drop == 0:
        return df
    drop = (h.join(copies.select(F.col("_m").alias("_c"), "_keep"), F.col("_m").eqNullSafe(F.col("_c")))
            .where(F.col(id_col) != F.col("_keep")).select(id_col))
    small = fits_broadcast(n_drop, DEDUP_ROW_BYTES, broadcast_bytes)
    return df.join(F.broadcast(drop) if small else drop, id_col, "left_anti")


def order_key(seed, *key_cols) -> Column:
    """Seeded, partition-independent order key ``md5(seed:k1:k2...)``."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def _earlier_sum(value: str, order: str, within: Sequence[str]) -> Column:
    """Sum of ``value`` over the rows before this one in ``order`` (0 for the first)."""
    w = Window.partitionBy(*within) if within else Window
    return F.coalesce(F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_ordinal(df: DataFrame, hash_col: str, tie_cols: Sequence[str], out: str = "ord",
                 n_rows: int | None = None, bucket_hex: int | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based ordinal over ``(hash_col, *tie_cols)`` without a global sort,
    restarting in every group of the (non-null) ``by`` columns.

    A prefix sum over hash-prefix buckets: count rows per fine bucket (first
    ``bucket_hex`` hex digits, map-side combined). Up to 16**4 buckets the
    running offsets are one small window (broadcast when there are no groups).
    Beyond that the sum has two levels: bucket counts summed per super bucket
    (4 digits shorter, <= 65,536 rows per group, running offsets), then running
    offsets of the fine buckets inside each super bucket (window partitioned by
    super bucket). Non-broadcast offsets are joined to the rows on the fine
    bucket, the key the numbering window is partitioned by, so the rows are
    shuffled once. Each row's ordinal is its bucket offset plus
    ``row_number`` inside the bucket.
    ``hash_col`` must be a uniform hash of a unique key, so no bucket is hot
    (a group holding most rows is still spread over all its buckets).
    Bucket width follows ``n_rows`` (counted when not given). The input is
    read again for the counts and the numbering: materialise it first when it
    is expensive to recompute.
    """
    by = list(by)
    if bucket_hex is None:
        n = df.count() if n_rows is None else n_rows
        bucket_hex = ordinal_bucket_hex(n, df.sparkSession.sparkContext.defaultParallelism)
    # fixed bound (<= 65,536 rows) only without groups; group counts are unbounded
    small = F.broadcast if not by else (lambda t: t)
    b = df.withColumn("_b", F.substring(F.col(hash_col), 1, bucket_hex))
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if bucket_hex <= ORDINAL_SUPER_SPAN_HEX:
        offsets = small(counts.select(*by, "_b", _earlier_sum("_n", "_b", by).alias("_off")))
    else:
        counts = counts.withColumn("_sb", F.substring("_b", 1, bucket_hex - ORDINAL_SUPER_SPAN_HEX))
        supers = counts.groupBy(*by, "_sb").agg(F.sum("_n").alias("_sn"))
        super_off = small(supers.select(*by, "_sb", _earlier_sum("_sn", "_sb", by).alias("_so")))
        offsets = counts.join(super_off, [*by, "_sb"]).select(
            *by, "_b", (F.col("_so") + _earlier_sum("_n", "_b", [*by, "_sb"])).alias("_off"))
    inside = Window.partitionBy(*by, "_b").orderBy(hash_col, *tie_cols)
    return (
        b.join(offsets, [*by, "_b"])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_off"))
        .drop("_b", "_off")
    )


def with_position(df: DataFrame, order_cols: Sequence[str], out: str = "ord") -> DataFrame:
    """Dense 0-based position over ``order_cols`` themselves (``with_ordinal`` is for
    hashes): rows are range-partitioned and sorted once and stored, so that a row's place
    in its partition is fixed; the partitions' sizes, all that reaches the driver, are
    the offsets. The order should be unique: rows that tie stand together, in any order."""
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    kept = stored(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = sorted((r["_p"], r["n"]) for r in kept.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        # the generated id is the partition's number above 33 bits of the place inside
        offsets.append((p, before - (p << 33)))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "_p int, _off long")
    return kept.join(F.broadcast(table), "_p").withColumn(out, F.col("_i") + F.col("_off")).drop("_p", "_i", "_off")


def seeded_order(df: DataFrame, seed, key_cols: Sequence[str], out: str = "ord") -> DataFrame:
    """Seeded shuffle: attach ``_h`` and the dense ordinal of the shuffled order."""
    keyed = df.withColumn("_h", order_key(seed, *key_cols))
    return with_ordinal(keyed, "_h", key_cols, out)


# Hex digits by which a histogram of the order key is refined; its counts (at most
# 16 ** RANGE_HEX for each band or boundary) are the only thing the driver sees.
RANGE_HEX = 3
# A boundary of a range is refined until its bucket holds so few rows.
BOUNDARY_ROWS = 4096
HASH_HEX = 32


class Boundary(NamedTuple):
    """Where a rank of an order lies: in the bucket of this hash prefix, which has
    ``rows`` rows after the ``before`` rows of all smaller hashes."""
    prefix: str
    before: int
    rows: int


class HashOrder:
    """Rows by rank of (hash_col, *tie_cols), found by distributed selection.

    A histogram over hash prefixes locates a rank; the bucket that holds it is counted
    again by longer prefixes until it is small. Rows outside a range are neither
    numbered nor shuffled. ``keys`` is read several times: pass a stored table
    of narrow rows (keys and hash, no texts; see ``stored_keys``), and fetch what is
    wide for the chosen rows only (``sentence_texts``).
    """

    def __init__(self, keys: DataFrame, hash_col: str, tie_cols: Sequence[str], band: Column | None = None):
        self.keys, self.hash_col, self.tie_cols, self.band = keys, hash_col, list(tie_cols), band
        self.bands: dict[str, list[tuple[str, int]]] = {}
        total: dict[str, int] = {}
        label = F.lit(None).cast("string") if band is None else band
        counted = keys.groupBy(self._prefix(RANGE_HEX).alias("_b"), label.alias("_band")).agg(F.count(F.lit(1)).alias("_n"))
        for r in sorted(counted.collect(), key=lambda r: r["_b"]):
            total[r["_b"]] = total.get(r["_b"], 0) + r["_n"]
            if r["_band"] is not None:
                self.bands.setdefault(r["_band"], []).append((r["_b"], r["_n"]))
        self.buckets: list[Boundary] = []
        self.n_rows = 0
        for b, n in total.items():
            self.buckets.append(Boundary(b, self.n_rows, n))
            self.n_rows += n

    def _prefix(self, digits: int) -> Column:
        return F.substring(self.hash_col, 1, digits)

    def boundaries(self, ranks: Sequence[int]) -> list[Boundary]:
        """The boundary of each rank (below ``n_rows``). One count for each level
        of refinement, whatever the number of ranks."""
        def holding(buckets, rank):
            return next(b for b in reversed(buckets) if b.before <= rank)

        found = [holding(self.buckets, r) for r in ranks]
        while wide := {b for b in found if b.rows > BOUNDARY_ROWS and len(b.prefix) < HASH_HEX}:
            digits = len(next(iter(wide)).prefix)
            longer = min(HASH_HEX, digits + RANGE_HEX)
            rows = (self.keys.where(self._prefix(digits).isin([b.prefix for b in wide]))
                    .groupBy(self._prefix(longer).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect())
            inside: dict[str, list[Boundary]] = {b.prefix: [] for b in wide}
            upto = {b.prefix: b.before for b in wide}
            for r in sorted(rows, key=lambda r: r["_b"]):
                p = r["_b"][:digits]
                inside[p].append(Boundary(r["_b"], upto[p], r["_n"]))
                upto[p] += r["_n"]
            found = [holding(inside[b.prefix], r) if b in wide else b for b, r in zip(found, ranks)]
        return found

    def between(self, low: Boundary, high: Boundary, out: str) -> DataFrame:
        """All rows from one boundary's bucket to another's, with their rank in
        the whole order as ``out``. The prefix filter stands below the numbering."""
        part = self.keys.where((F.col(self.hash_col) >= low.prefix) & (self._prefix(len(high.prefix)) <= high.prefix))
        inside = [b for b in self.buckets if low.prefix[:RANGE_HEX] <= b.prefix <= high.prefix[:RANGE_HEX]]
        if max((b.rows for b in inside), default=0) > ORDINAL_TARGET_ROWS:
            n = high.before + high.rows - low.before  # finer buckets than those counted
            return with_ordinal(part, self.hash_col, self.tie_cols, out, n_rows=n).withColumn(out, F.col(out) + low.before)
        # the counts are known: they are the offsets
        offsets = self.keys.sparkSession.createDataFrame([(b.prefix, max(b.before, low.before)) for b in inside], "_b string, _off long")
        rank = Window.partitionBy("_b").orderBy(self.hash_col, *self.tie_cols)
        numbered = part.withColumn("_b", self._prefix(RANGE_HEX)).withColumn("_r", F.row_number().over(rank) - 1)
        return numbered.join(F.broadcast(offsets), "_b").withColumn(out, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")

    def range(self, start: int, stop: int, out: str = "ord") -> DataFrame:
        """Rows ``start <= rank < stop``, with the rank."""
        stop = min(stop, self.n_rows)
        if start >= stop:
            return self.keys.where(F.lit(False)).withColumn(out, F.lit(None).cast("long"))
        low, high = self.boundaries([start, stop - 1])
        return self.between(low, high, out).where((F.col(out) >= start) & (F.col(out) < stop))

    def splits(self, sizes: dict[str, int], out: str = "ord") -> DataFrame:
        """Contiguous splits by sizes from the start of the order; ``ValueError``
        when there are not so many rows."""
        _check_sizes(sizes, self.n_rows)
        return _label_splits(self.range(0, sum(sizes.values()), out), sizes, out)


def stored_keys(df: DataFrame, hash_col: str, tie_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The narrow columns of an order, written once: what made ``df`` (splitting,
    filtering, hashing of texts) runs a single time, however often the order is read."""
    return stored(df.select(*tie_cols, *keep, hash_col))


def sentence_texts(chosen: DataFrame, docs: DataFrame, n_chosen: int, text_col: str = "text", id_col: str = "doc_id",
                   splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Late materialisation: ``chosen`` sentences (id_col, pos, ...) with their
    texts. Only documents with a chosen sentence are split again; their ids are
    broadcast while ``n_chosen`` of them fit the budget."""
    chosen = stored(chosen)
    ids = chosen.select(id_col).distinct()
    some = docs.join(F.broadcast(ids) if fits_broadcast(n_chosen, DEDUP_ROW_BYTES) else ids, id_col, "left_semi")
    return chosen.join(sentences(some, text_col, [id_col], splitter), [id_col, "pos"])


def ordinal_range(df: DataFrame, start: int, stop: int, hash_col: str, tie_cols: Sequence[str], out: str = "ord") -> DataFrame:
    """Rows ``start <= ordinal < stop`` of the order (hash_col, tie_cols), with
    the ordinal (see ``HashOrder``)."""
    return HashOrder(df, hash_col, tie_cols).range(start, stop, out)


def _label_splits(df: DataFrame, sizes: dict[str, int], ord_col: str) -> DataFrame:
    label = None
    upper = 0
    for name, size in sizes.items():
        upper += size
        cond = F.col(ord_col) < upper
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def _check_sizes(sizes: dict[str, int], have: int) -> None:
    need = sum(sizes.values())
    if need > have:
        raise ValueError(f"splits of {need} rows in all do not fit a table of {have} rows")


def shuffled_splits(df: DataFrame, sizes: dict[str, int], hash_col: str, tie_cols: Sequence[str],
                    out: str = "ord") -> DataFrame:
    """``split_by_sizes`` of an order that is not numbered yet: only the buckets
    of the splits' rows are."""
    return HashOrder(df, hash_col, tie_cols).splits(sizes, out)


def first_n(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """``select(range(n))`` of a numbered table; ``n < 0`` means all rows."""
    return df if n < 0 else df.where(F.col(ord_col) < n)


def range_slice(df: DataFrame, start: int, stop: int, ord_col: str = "ord") -> DataFrame:
    """``select(range(start, stop))`` of a numbered table."""
    return df.where((F.col(ord_col) >= start) & (F.col(ord_col) < stop))


def split_by_sizes(df: DataFrame, sizes: dict[str, int], ord_col: str = "ord",
                   total_rows: int | None = None) -> DataFrame:
    """Contiguous positional splits (e.g. train/valid/test) of a numbered table
    by sizes. Raises ``ValueError`` when the sizes add up to more rows than the
    table has (one count job; pass ``total_rows`` when it is already known).
    Rows past the sum of sizes get no split and are dropped."""
    _check_sizes(sizes, df.count() if total_rows is None else total_rows)
    return _label_splits(df, sizes, ord_col)


def length_band(n_words: Column, band: str) -> Column:
    """Strict word-count bands of the bucketed test sets."""
    if band == "medium":
        return (n_words > 35) & (n_words < 50)
    if band == "long":
        return n_words > 65
    raise ValueError(f"unknown band {band!r}")


def remainder_bands(df: DataFrame, cap: int, bands: Sequence[str], size: int, hash_col: str, tie_cols: Sequence[str],
                    n_col: str = "n_words", out: str = "ord") -> DataFrame:
    """First ``size`` rows of each length band among the rows after the first
    ``cap`` of the order (hash_col, tie_cols): adds ``out`` (ordinal in the whole
    order), ``band`` and ``band_ord`` (restarting per band).

    One pass counts rows per bucket and band. Only the rows between the cap's
    boundary and the bucket in which the last band fills are numbered; if a band has
    fewer than ``size`` rows, that is the last bucket."""
    label = None
    for name in bands:
        cond = length_band(F.col(n_col), name)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    order = HashOrder(df, hash_col, tie_cols, label)
    if cap >= order.n_rows:
        none = df.where(F.lit(False)).withColumn(out, F.lit(None).cast("long"))
        return none.withColumn("band", F.lit(None).cast("string")).withColumn("band_ord", F.lit(None).cast("long"))
    low = order.boundaries([cap])[0]
    lo = low.prefix[:RANGE_HEX]
    full = dict.fromkeys(bands, lo)  # the bucket in which a band has its rows together
    for name in bands:
        filled = 0
        for b, n in order.bands.get(name, []):
            if b > lo and filled < size:  # the cap's own bucket may hold capped rows only
                filled, full[name] = filled + n, b
        if filled < size:
            full[name] = order.buckets[-1].prefix
    high = next(b for b in order.buckets if b.prefix == max(full.values()))
    rest = order.between(low, high, out).where(F.col(out) >= cap).withColumn("band", label)
    needed = [(F.col("band") == name) & (F.substring(hash_col, 1, RANGE_HEX) <= b) for name, b in full.items()]
    rest = rest.where(reduce(lambda a, b: a | b, needed))
    # a band's rows up to that bucket are about ``size``: one small window each
    inside = Window.partitionBy("band").orderBy(out)
    return rest.withColumn("band_ord", (F.row_number().over(inside) - 1).cast("long")).where(F.col("band_ord") < size)


def split_period_sentences(docs: DataFrame, text_col: str = "text",
                           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Plain ``'. '`` splitter with periods restored (one row per piece)."""
    return docs.select(*keep, F.posexplode(T.split_period(F.col(text_col))).alias("pos", "text"))


def join_lines(c: Column) -> Column:
    """Text-directory document: strip ``\\n`` off each line, join lines with a
    blank after each, strip the result."""
    lines = F.split(c, "(?<=\n)")
    pieces = F.transform(lines, lambda x: F.concat(T.strip_chars(x, "\n"), F.lit(" ")))
    return T.strip(F.array_join(pieces, ""))
