"""Clipped n-gram overlaps of token arrays, for BLEU, ROUGE-N and token F1.

Counted by column, a whole Arrow batch at once, without a loop over rows or
n-grams: tokens are interned, an n-gram is a number made of its row and its tokens'
places in the row's vocabulary, one sort of these numbers for each order puts
equal n-grams of a row side by side, and run lengths are the counts. Exact: numbers
that would not fit 63 bits are ranked first. Tokenisation stays JVM-side: the UDF
receives token arrays, never raw text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens counted together (bounds the memory of a worker: about 150 bytes for each).
TOKENS_AT_ONCE = 200_000
_MOST = 1 << 62


def _row_codes(tokens: pa.Array, row: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of each token in the vocabulary of its row, and the largest
    vocabulary's size. Null tokens equal one another."""
    coded = tokens.dictionary_encode()
    code = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = np.unique(row * (len(coded.dictionary) + 1) + code, return_inverse=True)[1]
    first = np.full(int(row.max()) + 1, len(rank))
    np.minimum.at(first, row, rank)
    local = rank - first[row]
    return local, int(local.max()) + 1


def clipped_counts(tokens: pa.Array, lengths: np.ndarray, row: np.ndarray, side: np.ndarray, n_rows: int,
                   orders: Sequence[int]) -> np.ndarray:
    """(n_rows, orders) sums of clipped n-gram counts. ``tokens`` has the tokens of
    all lists, one after the other, ``lengths`` those of the lists, which belong to
    a ``row`` and a ``side``: 0, or a reference from 1. An n-gram counts as often as side
    0 has it, but not more than the reference that has it most."""
    out = np.zeros((n_rows, len(orders)), np.int64)
    if not len(tokens):
        return out
    of_list = np.repeat(np.arange(len(lengths)), lengths)
    code, vocabulary = _row_codes(tokens, row[of_list])
    sides = int(side.max()) + 1
    # an n-gram as a number: the first part, gram // span, tells its row
    gram, row_of, span, most = row[of_list] * vocabulary + code, np.arange(n_rows), vocabulary, n_rows * vocabulary
    at = np.arange(len(gram))  # first tokens
    for n in range(1, max(orders) + 1):
        if n > 1:
            on = (at + n - 1 < len(code)) & (of_list[np.minimum(at + n - 1, len(code) - 1)] == of_list[at])
            gram, at = gram[on], at[on]
            if not len(at):
                break
            if most > _MOST // vocabulary // sides:
                distinct, gram = np.unique(gram, return_inverse=True)
                row_of, span, most = row_of[distinct // span], 1, len(distinct)
            gram, span, most = gram * vocabulary + code[at + n - 1], span * vocabulary, most * vocabulary
        if n not in orders:
            continue
        keys = np.sort(gram * sides + side[of_list[at]])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count, (group, is_side) = np.diff(first, append=len(keys)), np.divmod(keys[first], sides)
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        mine = np.where(is_side[start] == 0, count[start], 0)
        theirs = np.maximum.reduceat(np.where(is_side > 0, count, 0), start)
        sums = np.bincount(row_of[group[start] // span], weights=np.minimum(mine, theirs), minlength=n_rows)
        out[:, orders.index(n)] = sums.astype(np.int64)
    return out


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows whose sizes add up to ``most``, about."""
    lo, upto = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


def _counted(a: pa.Array, refs: pa.Array, lengths: np.ndarray, row: np.ndarray, side: np.ndarray, missing: np.ndarray,
             orders: Sequence[int]) -> pa.Array:
    """Overlaps of each list of ``a`` with the lists ``refs`` (of ``row`` and ``side``), as an
    array of lists, TOKENS_AT_ONCE tokens at a time, about."""
    own = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = own + np.bincount(row, weights=lengths, minlength=len(a)).astype(np.int64)
    mine, theirs = a.flatten(), refs.flatten()
    before, ref_before, ref_at = (np.concatenate(([0], np.cumsum(x))) for x in (own, lengths, np.bincount(row, minlength=len(a))))
    out = []
    for lo, hi in parts(total, TOKENS_AT_ONCE):
        r0, r1 = ref_at[lo], ref_at[hi]
        tokens = pa.concat_arrays([mine.slice(before[lo], before[hi] - before[lo]), theirs.slice(ref_before[r0], ref_before[r1] - ref_before[r0])])
        out.append(clipped_counts(tokens, np.concatenate([own[lo:hi], lengths[r0:r1]]), np.concatenate([np.arange(hi - lo), row[r0:r1] - lo]),
                                  np.concatenate([np.zeros(hi - lo, np.int64), side[r0:r1]]), hi - lo, orders))
    counts = np.concatenate(out) if out else np.zeros((0, len(orders)), np.int64)
    there = ~missing
    offsets = np.concatenate(([0], np.cumsum(np.where(there, len(orders), 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts[there].ravel()), mask=pa.array(missing))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _nulls(lists: pa.Array) -> np.ndarray:
    return pc.is_null(lists).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=None)
def _udf(orders: tuple[int, ...]):
    @F.arrow_udf("array<long>")
    def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
        n = len(a)
        return _counted(a, b, _lengths(b), np.arange(n), np.ones(n, np.int64), _nulls(a) | _nulls(b), orders)

    return overlaps


@lru_cache(maxsize=None)
def _udf_many(orders: tuple[int, ...]):
    @F.arrow_udf("array<long>")
    def overlaps(a: pa.Array, refs: pa.Array) -> pa.Array:
        many, lists = _lengths(refs), refs.flatten()
        row = np.repeat(np.arange(len(a)), many)
        side = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1
        return _counted(a, lists, _lengths(lists), row, side, _nulls(a) | _nulls(refs), orders)

    return overlaps


def ngram_overlaps(a, b, orders: Sequence[int]) -> Column:
    """Array of the clipped overlaps of each order (NULL if a side is NULL)."""
    return _udf(tuple(orders))(a, b)


def ngram_overlaps_many(a, refs, orders: Sequence[int]) -> Column:
    """The same with several references (an array of token arrays): an n-gram is
    clipped at the reference that has it most."""
    return _udf_many(tuple(orders))(a, refs)
