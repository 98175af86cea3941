"""Embedding operators (jobs C and E): encode text to vectors, pool token
vectors, attach vectors by key, and score attribute inference (dot product of
each generated-text vector with every candidate-prompt vector of its row, first
arg-max, accuracy per attribute and run)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from vellum import session
from vellum.functions import arrays as A
from vellum.operators import corpus as C
from vellum.operators.records import render_prompt
from vellum.session import fits_broadcast, stored


class HashedEncoder:
    """Deterministic offline text encoder: signed feature hashing of lower-case
    alphanumeric tokens into ``dim`` buckets, L2-normalised. Stands in for a
    neural encoder so every job runs without model files."""

    def __init__(self, dim: int = 64, normalize: bool = True):
        self.dim, self.normalize = dim, normalize
        self.seen: dict[str, tuple[int, float]] = {}

    def _cell(self, token: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
        return h % self.dim, 1.0 if (h >> 63) & 1 else -1.0

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        tokens = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
        if len(self.seen) > 200_000:
            self.seen.clear()
        for tok in {x for row in tokens for x in row}.difference(self.seen):
            self.seen[tok] = self._cell(tok)
        flat = [self.seen[x] for row in tokens for x in row]
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        if flat:
            cell, sign = zip(*flat)
            np.add.at(out, (np.repeat(np.arange(len(texts)), [len(r) for r in tokens]), list(cell)), sign)
        if not self.normalize:
            return out
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, 1e-12)


def embed(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("row_id",),
          make_encoder: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None, dim: int = 64,
          batch_size: int = 100, out: str = "embedding") -> DataFrame:
    """Encode ``text_col`` in batches of ``batch_size`` texts.

    Runs as ``mapInPandas``: Arrow batches flow to the Python worker and rows
    stay in their partitions (no shuffle). ``make_encoder`` is called once in
    every task (a model is loaded there, never shipped from the driver) and
    returns a function from a list of strings to an ``(n, dim)`` array; the
    default makes a ``HashedEncoder(dim)``.
    """
    make = make_encoder or (lambda: HashedEncoder(dim))
    keep = list(keep)
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = PT.StructType(fields + [PT.StructField(out, PT.ArrayType(PT.FloatType(), False), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                vecs = np.asarray(encode(part[text_col].tolist()), dtype=np.float32)
                res = part[keep].copy()
                res[out] = list(vecs)
                yield res

    return df.select(*keep, text_col).mapInPandas(run, schema)


def check_dim(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Fail the job when a vector does not have the declared width."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.size(c) == dim, c).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} width is not {dim}: "), F.size(c).cast("string")))))


def hashed_token_vector(token: Column, dim: int) -> Column:
    """JVM-side deterministic token vector in [-0.5, 0.5)^dim (from md5)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.conv(
        F.substring(F.md5(F.concat_ws(":", token, d.cast("string"))), 1, 8), 16, 10).cast("double")
        / float(2**32) - 0.5)


# Rows of sums that a task holds before it sends them.
HELD_BYTES = 64 << 20


def _group_sums(keys: pa.Table, n: np.ndarray, sums: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of equal keys added up: their keys, counts and sums, in order of the
    first row of each."""
    code = np.zeros(keys.num_rows, np.int64)
    for c in keys.columns:
        own = pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    _, seen, code = np.unique(code, return_index=True, return_inverse=True)
    if len(seen) == keys.num_rows:
        return keys, n, sums
    order = np.argsort(seen[code], kind="stable")
    first = np.flatnonzero(np.diff(seen[code][order], prepend=-1))
    return keys.take(pa.array(order[first])), np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0)


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str, where: Column | None = None,
                 out: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of each key group. Rows failing ``where``, or
    without a vector, are masked out; a group with none left keeps its row, with a
    NULL vector. Vectors of different widths, or with a null component, are an error.

    Two levels of partial sums: a task adds up the vectors of each of its groups (one
    matrix reduction an Arrow batch) and sends a count and a binary accumulator; groups
    meet by key, sorted, and are added up as they stream by. No cell is ever a
    row, no group is held, and a hot key sends one accumulator a task, about."""
    keys = list(keys)
    used = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    fields = [f for f in df.select(*keys).schema.fields]
    partial = PT.StructType([*fields, PT.StructField("_n", PT.LongType()), PT.StructField("_sum", PT.BinaryType())])
    final = PT.StructType([*fields, PT.StructField(out, PT.ArrayType(PT.DoubleType()))])

    def rows(held):
        t, n, sums = held
        return pa.table([*t.columns, pa.array(n), pa.array([x.tobytes() if k else None for x, k in zip(sums, n)], pa.binary())],
                        names=[*keys, "_n", "_sum"]).combine_chunks().to_batches()

    def joined(held, more):
        if held is None:
            return more
        wide = max(held[2].shape[1], more[2].shape[1])  # a part without a vector has no width
        parts = [h[2] if h[2].shape[1] == wide else np.zeros((len(h[1]), wide)) for h in (held, more)]
        if any(h[2].shape[1] not in (0, wide) for h in (held, more)):
            raise ValueError("vectors of different widths")
        return _group_sums(pa.concat_tables([held[0], more[0]]), np.concatenate([held[1], more[1]]), np.concatenate(parts))

    def add(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            use = pc.and_(t.column("_u"), pc.is_valid(t.column("_v"))).combine_chunks()
            some = t.column("_v").combine_chunks().filter(use)
            if len(some) and some.flatten().null_count:
                raise ValueError("a vector has a null component")
            m = _matrix(some, "a row") if len(some) else np.empty((0, 0))
            sums, n = np.zeros((len(use), m.shape[1])), use.to_numpy(zero_copy_only=False).astype(np.int64)
            sums[n > 0] = m
            held = joined(held, _group_sums(t.select(keys), n, sums))
            if held[2].nbytes > HELD_BYTES:
                yield from rows(held)
                held = None
        if held is not None:
            yield from rows(held)

    def merge(batches):
        held = None  # the last group may go on in the next batch

        def means(h):
            t, n, sums = h
            lists = [(x / k).tolist() if k else None for x, k in zip(sums, n)]
            return pa.table([*t.columns, pa.array(lists, pa.list_(pa.float64()))], names=[*keys, out]).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            raw = t.column("_sum").to_pylist()
            wide = max((len(x) // 8 for x in raw if x), default=0)
            if any(x and len(x) != 8 * wide for x in raw):
                raise ValueError("vectors of different widths")
            sums = np.frombuffer(b"".join(x or bytes(8 * wide) for x in raw)).reshape(len(raw), wide)
            held = joined(held, _group_sums(t.select(keys), t.column("_n").to_numpy(), sums))
            last = held[0].num_rows - 1
            if last:
                yield from means((held[0].slice(0, last), held[1][:last], held[2][:last]))
                held = held[0].slice(last), held[1][last:], held[2][last:]
        if held is not None:
            yield from means(held)

    parts = df.select(*keys, used.alias("_u"), F.col(vec).cast("array<double>").alias("_v")).mapInArrow(add, partial)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, final)


def pool_mean_masked(tokens: DataFrame, keys: Sequence[str], vec: str = "vec", mask: str = "mask",
                     out: str = "embedding") -> DataFrame:
    """Mean of token vectors where mask = 1; NULL for a group without an
    unmasked token."""
    return mean_vectors(tokens, keys, vec, F.col(mask) == 1, out)


def pool_cls(tokens: DataFrame, keys: Sequence[str], vec: str = "vec", pos: str = "pos",
             out: str = "embedding") -> DataFrame:
    """Vector of the first token of each group."""
    return tokens.groupBy(*keys).agg(F.min_by(vec, pos).alias(out))


def pool_pooler(df: DataFrame, pooled: str = "pooler_output", out: str = "embedding") -> DataFrame:
    """The model's own pooled output is the embedding: a rename."""
    return df.withColumnRenamed(pooled, out)


def attach(rows: DataFrame, vectors: DataFrame, key: str = "row_id") -> DataFrame:
    """Vector i belongs to row i: an equi-join on the row key, never a zip."""
    return rows.join(vectors, key)


def attach_by_position(rows: DataFrame, vectors: DataFrame, row_order: Sequence[str], vector_order: Sequence[str],
                       out: str = "i") -> DataFrame:
    """Row i of one table, in its order, gets row i of the other: a dense position on
    both sides and an equi-join on it. Rows without a counterpart fail the job, as
    tables of different lengths would pair the wrong rows."""
    left, right = C.with_position(rows, row_order, out), C.with_position(vectors, vector_order, out).withColumn("_there", F.lit(True))
    paired = left.withColumn("_here", F.lit(True)).join(right, out, "full")
    whole = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    return paired.withColumn(out, F.when(whole, F.col(out)).otherwise(
        F.raise_error(F.concat(F.lit("no counterpart of row "), F.col(out).cast("string"))).cast("long"))).drop("_here", "_there")


# Bytes of gathered candidate vectors that a task multiplies at once.
GATHER_BYTES = 32 << 20


def products(texts: np.ndarray, ids: np.ndarray, prompts: np.ndarray) -> np.ndarray:
    """Dot product of row i of ``texts`` with the rows ``ids[i]`` of ``prompts``
    (-1: none, not a number). One matrix product with all prompts while these are few
    against the candidates of a row, else products with the gathered rows."""
    n, k = ids.shape
    safe = np.maximum(ids, 0)
    if len(prompts) <= 4 * k:
        out = np.take_along_axis(texts @ prompts.T, safe, axis=1)
    else:
        out, step = np.empty((n, k)), max(1, GATHER_BYTES // max(1, 8 * k * texts.shape[1]))
        for lo in range(0, n, step):
            out[lo:lo + step] = (prompts[safe[lo:lo + step]] @ texts[lo:lo + step, :, None])[:, :, 0]
    return np.where(ids < 0, np.nan, out)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, what: str) -> np.ndarray:
    """A list column as a matrix of doubles; a missing vector is an error."""
    if column.null_count:
        raise ValueError(f"no vector of {what}")
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"vectors of {what} differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _padded(lists: pa.Array) -> np.ndarray:
    """A column of id lists as a matrix, -1 where a list is shorter (or null)."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.full((len(n), max(int(n.max(initial=0)), 1)), -1, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


class PromptMatrix:
    """Vectors of distinct prompts (attr, value), by id. Small ones (measured) are
    one matrix, broadcast; their ids are places in it and are looked up inside
    the tasks. Others have dense ids by a hashed order and come in blocks of rows that
    fit the budget, one pass over the texts for each."""

    def __init__(self, prompt_vecs: DataFrame, vec: str = "embedding", normalize: bool = False):
        self.vec, self.normalize = vec, normalize
        self.spark = prompt_vecs.sparkSession
        self.table = prompt_vecs.select("attr", "value", vec)
        m = self.table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d"),
                           F.max(F.octet_length("attr") + F.octet_length("value")).alias("t")).first()
        self.n, self.width = m["n"], m["d"] or 0
        self.whole = fits_broadcast(self.n, 8 * self.width + (m["t"] or 0))
        if not self.whole:
            keyed = self.table.withColumn("_h", F.md5(F.concat_ws(":", "attr", "value")))
            self.table = stored(C.with_ordinal(keyed, "_h", ["attr", "value"], "id", n_rows=self.n).drop("_h"))

    def blocks(self):
        """(first id, matrix, (attr, value) of its rows) of each block, broadcast."""
        if self.whole:
            yield self._broadcast(0, self.table)
            return
        per_row = 8 * self.width + 32
        rows = max(1, session.BROADCAST_MAX_BYTES // per_row)
        for lo in range(0, self.n, rows):
            yield self._broadcast(lo, self.table.where((F.col("id") >= lo) & (F.col("id") < lo + rows)).orderBy("id"))

    def _broadcast(self, first: int, rows: DataFrame):
        t = rows.select("attr", "value", self.vec).toArrow().combine_chunks()
        m = _matrix(t.column(self.vec).combine_chunks(), "a prompt") if t.num_rows else np.empty((0, self.width))
        names = pc.binary_join_element_wise(t.column("attr").cast(pa.string()), t.column("value").cast(pa.string()), "\x1f")
        return self.spark.sparkContext.broadcast((first, _unit(m) if self.normalize and len(m) else m, names.to_pylist()))

    def with_ids(self, candidates: DataFrame, key: str, lists: str = "_c") -> DataFrame:
        """(key, attr, cand_pos, value) rows as one row a key: ``lists`` has structs
        (attr, cand_pos, value) in order; where the matrix comes in blocks, also the id."""
        fields = ["attr", "cand_pos", "value"]
        if not self.whole:
            candidates = candidates.join(self.table.select("attr", "value", "id"), ["attr", "value"], "left").withColumn(
                "id", F.coalesce("id", F.raise_error(F.concat(F.lit("no vector of candidate: "), F.concat_ws("=", "attr", "value"))).cast("long")))
            fields.append("id")
        return candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(lists))


def _ids_of(lists: pa.Array, first: int, names: list[str], whole: bool) -> pa.Array:
    """Candidate lists as lists of rows of a block's matrix (-1: not in it)."""
    s = lists.flatten()
    if whole:
        wanted = pc.binary_join_element_wise(pc.struct_field(s, "attr"), pc.struct_field(s, "value"), "\x1f")
        ids = pc.index_in(wanted, value_set=pa.array(names, pa.string()))
        if ids.null_count:
            raise ValueError(f"no vector of candidate: {wanted.filter(ids.is_null())[0].as_py()}".replace("\x1f", "="))
        ids = ids.cast(pa.int64())
    else:
        at = pc.struct_field(s, "id").to_numpy(zero_copy_only=False) - first
        ids = pa.array(np.where((at >= 0) & (at < len(names)), at, -1))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))),
                                             pa.int32()), ids)


def candidate_scores(rows: DataFrame, prompts: PromptMatrix, vec: str, lists: str = "_c", out: str = "_s",
                     normalize: bool = False) -> DataFrame:
    """``rows`` with the scores of their candidates (``lists`` of ``with_ids``) as a
    list in the same order. A block of text vectors meets the prompt matrix in one
    product; neither the vectors nor the candidates are copied or exploded."""
    if not prompts.whole:
        rows = stored(rows)
    schema = PT.StructType([*rows.schema.fields, PT.StructField(out, PT.ArrayType(PT.DoubleType()))])
    at_vec, at_lists = rows.columns.index(vec), rows.columns.index(lists)

    def scored(shared):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                first, matrix, names = shared.value
                lists_col = batch.column(at_lists)
                t = _matrix(batch.column(at_vec), "the row")
                own = _ids_of(lists_col, first, names, prompts_whole)
                s = products(_unit(t) if normalize else t, _padded(own), matrix)
                n = pc.list_value_length(own).to_numpy(zero_copy_only=False)
                flat = s[np.arange(s.shape[1]) < n[:, None]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(own.offsets, pa.array(flat))], names=[*batch.schema.names, out])

        return rows.mapInArrow(run, schema)

    prompts_whole = prompts.whole
    parts = [scored(b) for b in prompts.blocks()]
    if prompts_whole or not parts:
        return parts[0] if parts else rows.withColumn(out, F.lit(None).cast("array<double>"))
    # one pass for each block: a candidate has its score in one of them, and no number in the others
    keys = [c for c in rows.columns if c not in (vec, lists)]
    total = None
    for p in parts:
        p = p.select(*keys, F.posexplode(out).alias("_i", "_x")).where(~F.isnan("_x"))
        total = p if total is None else total.unionByName(p)
    back = total.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias(out))
    return rows.join(back, keys)


def attribute_scores(text_vecs: DataFrame, candidates: DataFrame, cand_vecs: DataFrame,
                     key: str = "row_id", run: str = "run", vec: str = "embedding",
                     normalize: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Dot product of every (row, run) text vector with every candidate vector
    of the same row: (keep of the text vectors, key, attr, run, cand_pos, score).

    ``candidates`` is (key, attr, cand_pos, value); ``cand_vecs`` is (attr,
    value, vector) with one vector per distinct prompt. A row's candidates are one
    narrow list, which meets the row's vectors by an equi-join on the key; the
    products are made a block at a time (see ``candidate_scores``). A candidate
    without a vector, or a row without a text vector, fails the job: a dropped
    truth would let a wrong candidate win."""
    prompts = PromptMatrix(cand_vecs, vec, normalize)
    tv = text_vecs.select(*keep, key, run, F.col(vec).alias("_tv"))
    rows = prompts.with_ids(candidates, key).join(tv, key, "left")
    scored = candidate_scores(rows, prompts, "_tv", normalize=normalize)
    each = scored.select(*keep, key, run, F.explode(F.arrays_zip("_c", "_s")).alias("_z"))
    return each.select(*keep, key, F.col("_z._c.attr").alias("attr"), run, F.col("_z._c.cand_pos").alias("cand_pos"), F.col("_z._s").alias("score"))


def attribute_accuracy(scores: DataFrame, key: str = "row_id", run: str = "run",
                       by: Sequence[str] = ()) -> DataFrame:
    """First arg-max per (row, attr, run); accuracy = share of rows whose best
    candidate is position 0 (the truth), per (attr, run). ``n_tied`` counts
    rows whose maximum score is shared, where the smallest position decides."""
    # one group per (row, attr, run) holds its k candidate scores (bounded by
    # the candidate count); they are put in candidate order and reduced with
    # array functions.
    per = scores.groupBy(*by, key, "attr", run).agg(
        F.array_sort(F.collect_list(F.struct("cand_pos", "score"))).alias("_c")).withColumn(
        "_s", F.transform("_c", lambda s: s["score"]))
    best = per.select(*by, "attr", run, F.get("_c", A.argmax_first("_s"))["cand_pos"].alias("_best"),
                      (A.n_tied_max("_s") > 1).cast("int").alias("_tied"))
    return best.groupBy(*by, "attr", run).agg(
        F.avg((F.col("_best") == 0).cast("double")).alias("accuracy"),
        F.sum("_tied").cast("long").alias("n_tied"),
        F.count(F.lit(1)).alias("n_rows"))


def infer_attributes(preds: DataFrame, candidates: DataFrame, attrs: Sequence[str], make_encoder=None, dim: int = 64,
                     key: str = "row_id", run: str = "run", text: str = "text", by: Sequence[str] = ("dataset",),
                     normalize: bool = False, batch_size: int = 100) -> DataFrame:
    """Attribute inference from texts to accuracies, all attributes and datasets
    in one job: (by, attr, run, accuracy, n_tied, n_rows).

    ``preds`` has the texts of each row (by, key, run, text), ``candidates`` the row's
    ``<attr>_candidate_list`` of each attribute (position 0 is the truth; null: the
    row doesn't count). Every distinct prompt ``The <attr> is <value>`` is encoded
    once, and so is every text, in the task that scores it: its vector meets the prompt
    matrix there, the first arg-max is taken, and only counts leave the task. Prompts
    beyond the broadcast budget take the way of ``attribute_scores``."""
    lists = {a: f"{a}_candidate_list" for a in attrs}
    values = None
    for a, c in lists.items():
        v = candidates.select(F.lit(a).alias("attr"), F.explode(c).alias("value")).distinct()
        values = v if values is None else values.unionByName(v)
    rendered = values.withColumn(text, render_prompt(F.col("attr"), F.col("value")))
    prompt_vecs = stored(embed(rendered, text, ["attr", "value"], make_encoder, dim))
    prompts = PromptMatrix(prompt_vecs, normalize=normalize)
    if not prompts.whole:
        text_vecs = stored(embed(preds, text, [*by, key, run], make_encoder, dim))
        scores = attribute_scores(text_vecs, candidates_long(candidates, key, attrs), prompt_vecs, key, run, normalize=normalize, keep=by)
        return attribute_accuracy(scores, key, run, by)

    shared = next(iter(prompts.blocks()))
    make = make_encoder or (lambda: HashedEncoder(dim))
    narrow = _with_ids(candidates.select(key, *lists.values()), key, lists, shared)
    rows = narrow.join(preds.select(*by, key, run, text, F.lit(True).alias("_there")), key, "left")
    rows = rows.select(*by, run, text, "_there", *[f"_i_{a}" for a in attrs])
    head = [*by, run]
    schema = PT.StructType([f for f in rows.schema.fields if f.name in head] + [
        PT.StructField("attr", PT.StringType()), PT.StructField("_n", PT.LongType()), PT.StructField("_right", PT.LongType()), PT.StructField("_tied", PT.LongType())])

    def count(batches):
        encode, (_, matrix, _) = make(), shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, batch_size):
                batch = whole.slice(lo, batch_size)
                if batch.column(len(head) + 1).null_count:
                    raise ValueError("no vector of the row: a row with candidates has no text")
                t = np.asarray(encode(batch.column(len(head)).to_pylist()), np.float32).astype(np.float64)
                t = _unit(t) if normalize else t
                group = pa.table(batch.columns[:len(head)], names=head)
                out = []
                for j, a in enumerate(attrs):
                    ids = _padded(batch.column(len(head) + 2 + j))
                    has = ids[:, 0] >= 0
                    if not has.any():
                        continue
                    best, tied = first_best(products(t[has], ids[has], matrix), ids[has] >= 0)
                    g = group.filter(pa.array(has)).append_column("_n", pa.array(np.ones(len(best), np.int64))).append_column(
                        "_right", pa.array((best == 0).astype(np.int64))).append_column("_tied", pa.array((tied > 1).astype(np.int64)))
                    g = g.group_by(head).aggregate([("_n", "sum"), ("_right", "sum"), ("_tied", "sum")])
                    out.append(pa.table([*(g.column(c) for c in head), pa.array([a] * g.num_rows), *(g.column(f"{c}_sum") for c in ("_n", "_right", "_tied"))],
                                        names=[*head, "attr", "_n", "_right", "_tied"]))
                if out:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()

    sums = rows.mapInArrow(count, schema).groupBy(*by, "attr", run).agg(*[F.sum(c).alias(c) for c in ("_n", "_right", "_tied")])
    return sums.select(*by, "attr", run, (F.col("_right") / F.col("_n")).alias("accuracy"), F.col("_tied").alias("n_tied"), F.col("_n").alias("n_rows"))


def first_best(scores: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first largest score of each row (not a number is the largest, as in
    ``argmax``) and how many share it, among the places that are ``there``."""
    s = np.where(there, scores, -np.inf)
    best = s.argmax(axis=1)
    top = np.take_along_axis(s, best[:, None], axis=1)
    return best, (((s == top) | (np.isnan(s) & np.isnan(top))) & there).sum(axis=1)


def _with_ids(rows: DataFrame, key: str, lists: dict[str, str], shared) -> DataFrame:
    """Candidate lists as lists of rows of the prompt matrix: (key, _i_<attr>...)."""
    names = [f"_i_{a}" for a in lists]
    schema = PT.StructType([rows.schema[key], *(PT.StructField(n, PT.ArrayType(PT.LongType())) for n in names)])

    def run(batches):
        known = pa.array(shared.value[2], pa.string())
        for batch in batches:
            out = [batch.column(0)]
            for j, a in enumerate(lists):
                col = batch.column(j + 1)
                ids = pc.index_in(pc.binary_join_element_wise(pa.scalar(a), col.flatten(), "\x1f"), value_set=known).cast(pa.int64())
                n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), ids))
            yield pa.RecordBatch.from_arrays(out, names=[key, *names])

    return rows.mapInArrow(run, schema)


def candidates_long(df: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Unpivot ``<attr>_candidate_list`` columns to (key, attr, cand_pos, value)."""
    parts = [df.select(key, F.lit(a).alias("attr"),
                       F.posexplode(f"{a}_candidate_list").alias("cand_pos", "value")) for a in attrs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_attributes(df: DataFrame, exclude: Sequence[str] = ("text", "pred", "embedding")) -> list[str]:
    """Attribute columns: every column not excluded and not a candidate list
    (schema metadata only, no job)."""
    return [c for c in df.columns if c not in exclude and "candidate_list" not in c]
