"""Attribute-record operators (job B): nested header/content lookup, value
cleaning filters, frequent-value filters, text rendering and multiple-choice
candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from vellum.functions import text as T
from vellum.operators import corpus as C
from vellum.session import fits_broadcast

CANDIDATES = 10


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------ nested lookup ---
def has_attributes(header, names: Sequence[str]) -> Column:
    """All ``names`` occur in the header array."""
    return F.forall(F.array(*[F.lit(n) for n in names]), lambda a: F.array_contains(_c(header), a))


def lookup(header, content, name: str) -> Column:
    """Content at the first position of ``name`` in the header; NULL if absent."""
    pos = F.array_position(_c(header), F.lit(name))
    return F.when(pos > 0, F.element_at(_c(content), pos.cast("int")))


def extract_attributes(df: DataFrame, table_col: str, names: Sequence[str]) -> DataFrame:
    """Keep rows whose header holds every name, then add one column per name."""
    hdr, cnt = F.col(f"{table_col}.column_header"), F.col(f"{table_col}.content")
    return df.where(has_attributes(hdr, names)).withColumns({n: lookup(hdr, cnt, n) for n in names})


def header_counts(df: DataFrame, header_col: str, first: Column | None = None) -> DataFrame:
    """Frequency of each header name over all rows (explode + map-side count).
    With ``first`` (the row's place in the table order), ``first`` also holds
    where each name was first seen: min of (row place, position in header)."""
    if first is None:
        return df.select(F.explode(_c(header_col)).alias("value")).groupBy("value").count()
    ex = df.select(first.alias("_row"), F.posexplode(_c(header_col)).alias("_pos", "value"))
    return ex.groupBy("value").agg(F.count(F.lit(1)).alias("count"),
                                   F.min(F.struct("_row", "_pos")).alias("first"))


def most_common(counts: DataFrame, k: int = 20) -> DataFrame:
    """``Counter.most_common(k)`` of a (value, count[, first]) table: count
    descending, ties in first-seen order (by value when ``first`` is absent).
    At most ``k`` rows, so the result can be broadcast."""
    tie = F.asc("first") if "first" in counts.columns else F.asc("value")
    return counts.orderBy(F.desc("count"), tie, F.asc("value")).limit(k).select("value", "count")


# ---------------------------------------------------------------- filters ---
def occupation_markup_free(c) -> Column:
    """No ``-lrb-``/``-rrb-`` bracket tokens and no digit."""
    c = _c(c)
    return ~c.contains("-lrb-") & ~c.contains("-rrb-") & ~T.has_digit(c)


def any_piece_in(pieces, line) -> Column:
    """Some piece occurs in the line (an empty piece always does)."""
    return F.exists(_c(pieces), lambda p: _c(line).contains(p))


def first_match(pieces, line) -> Column:
    """First piece contained in the line, else the last piece."""
    hits = F.filter(_c(pieces), lambda p: _c(line).contains(p))
    return F.coalesce(F.get(hits, 0), F.element_at(_c(pieces), -1))


def value_counts(df: DataFrame, col: str, first: Column | None = None) -> DataFrame:
    """Count per value; with ``first`` (the row's place in the table order,
    any orderable column) also the place where the value was first seen."""
    g = df.groupBy(F.col(col).alias("value"))
    if first is None:
        return g.count()
    return g.agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("first"))


# Items that a frequent-items sketch tracks. A value that its result leaves out is
# no more frequent than SKETCH_ERROR / TRACKED of all rows: the sketch's error is at most
# 3.5 over its map size (TRACKED / 0.75 or more), and it returns what exceeds twice that.
TRACKED = 10_000
SKETCH_ERROR = 2 * 3.5 * 0.75


def frequent_candidates(df: DataFrame, col: str, tracked: int = TRACKED) -> tuple[DataFrame, int, int]:
    """(values, number of rows, largest count of any value not among them): the
    values of ``col`` that a mergeable frequent-items sketch keeps, at most ``tracked``.
    One sketch a task is all that is shuffled."""
    row = df.agg(F.expr(f"approx_top_k(`{col}`, {tracked}, {tracked})").alias("t"), F.count(F.lit(1)).alias("n")).first()
    schema = PT.StructType([PT.StructField("value", df.schema[col].dataType)])
    values = df.sparkSession.createDataFrame([(r["item"],) for r in row["t"] or []], schema)
    return values, row["n"], int(SKETCH_ERROR * row["n"] / tracked)


def top_k_values(df: DataFrame, col: str, k: int = 20, first: Column | None = None, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values; ties in first-seen order when
    ``first`` gives the table order (``Counter.most_common``), else by value.

    Candidates come from a sketch and only they are counted exactly, so distinct values
    are not shuffled. The result is certain when the k-th count is above what any
    other value can have, or when the candidates are all there is; else (a flat
    distribution) all values are counted. ``df`` is read twice: pass a stored table
    where it is expensive."""
    candidates, n, others = frequent_candidates(df, col, tracked)
    # named apart from ``col``, which may be called "value" itself
    candidates = candidates.select(F.col("value").alias(f"_candidate_{col}"))
    some = df.join(F.broadcast(candidates), F.col(f"`{col}`").eqNullSafe(F.col(f"`_candidate_{col}`")), "left_semi")
    counts = value_counts(some, col, first)
    best = most_common(counts, k)
    top = best.collect()  # k rows
    certain = len(top) == k and top[-1]["count"] > others
    if certain or (counts.agg(F.sum("count")).first()[0] or 0) == n:
        return df.sparkSession.createDataFrame(top, best.schema)
    return most_common(value_counts(df, col, first), k)


def top_k_headers(df: DataFrame, header_col: str, k: int = 20, first: Column | None = None, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent header names, found like ``top_k_values``; a name's place
    is that of the row, then its position in the header."""
    place = first if first is None else F.struct(first.alias("_row"), F.col("_pos"))
    rows = df.select(*([] if first is None else df.columns), F.posexplode(_c(header_col)).alias("_pos", "_name"))
    return top_k_values(rows, "_name", k, place, tracked)


def keep_top_k(df: DataFrame, col: str, k: int = 20, over: DataFrame | None = None,
               first: Column | None = None) -> DataFrame:
    """Rows whose ``col`` is among the k most frequent values of ``over``
    (default: ``df`` itself); a broadcast semi join on a k-row table."""
    top = top_k_values(over if over is not None else df, col, k, first).select(F.col("value").alias(col))
    return df.join(F.broadcast(top), col, "left_semi")


# -------------------------------------------------------------- rendering ---
def render_attributes(values: dict[str, Column], text: Column) -> Column:
    """``The <name with blanks> is <value>.`` for each attribute, then the text."""
    parts = [F.format_string("The %s is %s.", F.lit(name.replace("_", " ")), v.cast("string"))
             for name, v in values.items()]
    return F.concat_ws(" ", *parts, text)


def render_prompt(attr: str | Column, candidate: Column) -> Column:
    """``The <attr> is <candidate>`` (no period), as used for candidate prompts."""
    a = F.lit(attr.replace("_", " ")) if isinstance(attr, str) else F.replace(attr, F.lit("_"), F.lit(" "))
    return F.format_string("The %s is %s", a, candidate.cast("string"))


def disposition(c) -> Column:
    return F.when(_c(c) == "D", F.lit("discharge")).otherwise(F.lit("admittance"))


def checked_int(c, name: str) -> Column:
    """Cast a double to int, raising when the cast would lose information
    (ANSI cast truncates 88.5 to 88 silently)."""
    c = _c(c)
    i = c.cast("int")
    return F.when(c.isNull() | (i.cast("double") == c), i).otherwise(
        F.raise_error(F.concat(F.lit(f"lossy int cast of {name}: "), c.cast("string"))))


def required_final_period(c, name: str = "text") -> Column:
    """Append a period; an empty text is an error (as in the reference)."""
    c = _c(c)
    return F.when(F.length(c) == 0, F.raise_error(F.lit(f"empty {name}"))).otherwise(T.final_period(c))


# ------------------------------------------------------------- candidates ---
def domain_ids(df: DataFrame, col: str, seed=2023, n_values: int | None = None) -> DataFrame:
    """Distinct values of ``col`` with a dense id (0..n-1) in a seeded order
    (``n_values``, the domain size, sizes the ordinal buckets when known)."""
    dom = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    dom = dom.withColumn("_h", C.order_key(seed, F.lit(col), "value"))
    return C.with_ordinal(dom, "_h", ["value"], "id", n_rows=n_values).select("value", "id")


def domain_sizes(df: DataFrame, cols: Sequence[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Exact number of distinct non-null values of each column and the
    longest value in bytes (bounds the domain table's size), one pass."""
    row = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(f"n_{c}") for c in cols],
                 *[F.max(F.octet_length(F.col(c).cast("string"))).alias(f"w_{c}") for c in cols]).first()
    return ({c: int(row[f"n_{c}"]) for c in cols}, {c: int(row[f"w_{c}"] or 0) for c in cols})


def _draw_int(seed, attr: str, key: Column, j: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(attr), key.cast("string"), j.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def floyd_draw(n: int, k: int, seed, attr: str, key: Column) -> Column:
    """``k`` distinct ids out of ``0..n-1`` (Floyd's algorithm, k steps), drawn
    uniformly and reproducibly from md5(seed, attr, key, step)."""
    def step(acc, j):
        r = F.pmod(_draw_int(seed, attr, key, j), j + 1)
        return F.when(F.array_contains(acc, r), F.concat(acc, F.array(j))).otherwise(F.concat(acc, F.array(r)))

    seq = F.sequence(F.lit(n - k).cast("long"), F.lit(n - 1).cast("long"))
    return F.aggregate(seq, F.array().cast("array<bigint>"), step)


def candidate_lists(df: DataFrame, key: str, col: str, seed=2023, k: int = CANDIDATES,
                    domain_from: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """``[truth] + (k-1)`` distinct other values of ``col`` per row, truth first
    (see ``candidate_lists_multi``)."""
    res = candidate_lists_multi(df, key, [col], seed, k, domain_from)
    return res if out is None else res.withColumnRenamed(f"{col}_candidate_list", out)


def candidate_lists_multi(df: DataFrame, key: str, cols: Sequence[str], seed=2023,
                          k: int = CANDIDATES, domain_from: DataFrame | None = None) -> DataFrame:
    """Add ``<col>_candidate_list`` = ``[truth] + (k-1)`` distinct other values
    of ``col`` for every column in ``cols``; the truth is always first.

    Each attribute's domain (distinct values of ``domain_from``, default
    ``df``) gets dense ids in a seeded order. Every row draws k distinct ids
    per attribute with Floyd's algorithm (k steps, md5 of seed/attr/row/step),
    the ids are looked up, the truth is dropped if drawn and the first k-1
    remain. Per row this is O(k) work whatever the domain size. While the
    measured domains fit the broadcast budget they travel as one row of arrays
    and the lookup is by position, without a shuffle of rows; beyond it the ids
    are joined to values on (attr, id), uniform keys, with one group-by and one
    join back for all attributes. A two-value domain yields ``[truth, other]``; fewer than k values
    raise ``ValueError``.
    """
    src = domain_from if domain_from is not None else df
    sizes, widths = domain_sizes(src, cols)
    doms = None
    for c in cols:
        d = domain_ids(src, c, seed, sizes[c]).withColumn("attr", F.lit(c))
        doms = d if doms is None else doms.unionByName(d)
    ks = {}
    for c in cols:
        n = sizes.get(c, 0)
        ks[c] = 2 if n == 2 and k > 2 else k
        if n < ks[c]:
            raise ValueError(f"{c}: domain has {n} distinct values, {ks[c]} candidates needed")
    widest = max(len(c) + 8 + widths[c] for c in cols)
    if fits_broadcast(sum(sizes.values()), widest):
        return _looked_up(df, key, cols, doms, sizes, ks, seed)
    draws = None
    for c in cols:
        d = df.select(F.col(key), F.lit(c).alias("attr"), F.col(c).cast("string").alias("_truth"),
                      F.posexplode(floyd_draw(sizes[c], ks[c], seed, c, F.col(key))).alias("_pos", "id"))
        draws = d if draws is None else draws.unionByName(d)
    named = draws.join(doms, ["attr", "id"]).where(F.col("value") != F.col("_truth"))
    # one group per row: at most len(cols) * k small structs
    per_row = named.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("attr", "_pos", "value"))).alias("_drawn"))
    out = df.join(per_row, key, "left")
    lists = {}
    for c in cols:
        others = F.transform(F.filter("_drawn", _attr_is(c)), lambda x: x["value"])
        lists[f"{c}_candidate_list"] = F.when(
            F.col(c).isNotNull(),
            F.concat(F.array(F.col(c).cast("string")), F.slice(others, 1, ks[c] - 1)))
    return out.withColumns(lists).drop("_drawn")


def _looked_up(df: DataFrame, key: str, cols: Sequence[str], doms: DataFrame, sizes: dict[str, int], ks: dict[str, int],
               seed) -> DataFrame:
    """Candidate lists by position in the domains, sent as one row (measured)."""
    arrays = doms.groupBy().agg(*[F.transform(
        F.array_sort(F.collect_list(F.when(F.col("attr") == c, F.struct("id", "value")))), lambda s: s["value"]).alias(f"_dom_{c}")
        for c in cols]).withColumn("_one", F.lit(1))
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(arrays), "_one").drop("_one")
    # the drawn ids in a projection of their own, not once for each use
    out = out.withColumns({f"_ids_{c}": floyd_draw(sizes[c], ks[c], seed, c, F.col(key)) for c in cols})
    lists = {}
    for c in cols:
        truth = F.col(c).cast("string")
        drawn = F.transform(f"_ids_{c}", _value_at(f"_dom_{c}"))
        lists[f"{c}_candidate_list"] = F.when(
            truth.isNotNull(), F.concat(F.array(truth), F.slice(F.array_remove(drawn, truth), 1, ks[c] - 1)))
    return out.withColumns(lists).drop(*[f"_dom_{c}" for c in cols], *[f"_ids_{c}" for c in cols])


def _value_at(domain: str):
    return lambda i: F.get(F.col(domain), i.cast("int"))


def _attr_is(c: str):
    return lambda x: x["attr"] == F.lit(c)


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantined) instead of failing the job, for
    checks the reference enforces by raising (lossy casts, empty texts)."""
    flag = F.coalesce(valid, F.lit(False))
    return df.where(flag), df.where(~flag)


def lossless_int(c) -> Column:
    """Predicate: the double converts to int without loss (NULL passes)."""
    c = _c(c)
    return c.isNull() | (c.cast("int").cast("double") == c)
