"""Longest-common-subsequence helpers for ROUGE-L / ROUGE-Lsum.

An LCS is a dynamic program over two token arrays; Spark's higher-order
functions would copy the DP row at every step (cubic), so these two per-row
helpers run in Arrow UDFs. Tokenisation stays JVM-side: the UDFs receive token
arrays, never raw text, and turn a few rows at a time into lists of numbers, so a
worker holds one Arrow batch and TOKENS_AT_ONCE tokens besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.overlap import _lengths, parts

#: Tokens that are Python objects at a time.
TOKENS_AT_ONCE = 100_000


def lcs_length(a, b) -> int:
    """LCS length by the bit-parallel recurrence (Hyyroe 2004): one big-int
    update per token of ``b``, O(len(a) * len(b) / wordsize)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    match: dict = {}
    for i, tok in enumerate(a):
        match[tok] = match.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for tok in b:
        u = s & match.get(tok, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def lcs_rows(ref, can) -> list[int]:
    """Row i of the LCS table as a bit vector over ``can`` (same recurrence):
    cell (i, j) is the number of zero bits among the lowest j of row i. A row
    takes len(can) bits, so 20,000 x 20,000 tokens take 50 MB."""
    match: dict = {}
    for j, tok in enumerate(can):
        match[tok] = match.get(tok, 0) | (1 << j)
    full = (1 << len(can)) - 1
    rows = [full]
    for tok in ref:
        s = rows[-1]
        u = s & match.get(tok, 0)
        rows.append(((s + u) | (s - u)) & full)
    return rows


def lcs_indices(ref, can) -> list[int]:
    """Positions in ``ref`` of one LCS with ``can`` (walk back that prefers
    moving along ``can`` only when it is strictly better)."""
    i, j, out = len(ref), len(can), []
    if i == 0 or j == 0:
        return []
    rows = lcs_rows(ref, can)
    low = (1 << j) - 1
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
            low >>= 1
            continue
        # zero bits: cell (i, j - 1) against cell (i - 1, j)
        left = j - 1 - (rows[i] & (low >> 1)).bit_count()
        up = j - (rows[i - 1] & low).bit_count()
        if left > up:
            j -= 1
            low >>= 1
        else:
            i -= 1
    out.reverse()
    return out


def fmeasure(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def lcs_f(ref, pred) -> float:
    """ROUGE-L F for two token sequences."""
    if len(ref) == 0 or len(pred) == 0:
        return 0.0
    n = lcs_length(ref, pred)
    return fmeasure(n / len(pred), n / len(ref))


def union_lcs_f(ref_sents, pred_sents) -> float:
    """ROUGE-Lsum F: summary-level union LCS over newline sentences."""
    ref_sents = [list(s) for s in ref_sents if len(s)]
    pred_sents = [list(s) for s in pred_sents if len(s)]
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in pred_sents)
    if not ref_sents or not pred_sents or m == 0 or n == 0:
        return 0.0
    cnt_r: dict = {}
    cnt_c: dict = {}
    for s in ref_sents:
        for t in s:
            cnt_r[t] = cnt_r.get(t, 0) + 1
    for s in pred_sents:
        for t in s:
            cnt_c[t] = cnt_c.get(t, 0) + 1
    hits = 0
    for r in ref_sents:
        union = sorted(set().union(*[lcs_indices(r, c) for c in pred_sents]))
        for i in union:
            t = r[i]
            if cnt_c.get(t, 0) > 0 and cnt_r.get(t, 0) > 0:
                hits += 1
                cnt_c[t] -= 1
                cnt_r[t] -= 1
    return fmeasure(hits / n, hits / m)


def _split(items: list, lengths: np.ndarray) -> list[list]:
    ends = np.cumsum(lengths).tolist()
    return [items[a:b] for a, b in zip([0, *ends], ends)]


def _numbered(*lists: pa.Array) -> list[list[list[int]]]:
    """Token lists of each array as lists of numbers, equal for equal tokens."""
    # an array without lists may flatten to one with an offset out of its buffers
    flat = [t for t in (x.flatten() for x in lists if len(x)) if len(t)]
    tokens = pa.concat_arrays(flat or [pa.array([], pa.string())]).dictionary_encode()
    codes = pc.fill_null(tokens.indices, -1).to_numpy(zero_copy_only=False).tolist()
    lengths = [_lengths(x) for x in lists]
    first, second = _split(codes, np.array([n.sum() for n in lengths]))
    return [_split(first, lengths[0]), _split(second, lengths[1])]


def _no_nulls(*lists: pa.Array) -> None:
    if any(x.null_count for x in lists):
        raise TypeError("token lists must not be null")


def _rows(ref: pa.Array, pred: pa.Array) -> Iterator[tuple[list, list]]:
    """The token lists of both sides, row by row."""
    _no_nulls(ref, pred)
    for lo, hi in parts(_lengths(ref) + _lengths(pred), TOKENS_AT_ONCE):
        yield from zip(*_numbered(ref.slice(lo, hi - lo), pred.slice(lo, hi - lo)))


def _sentence_rows(ref: pa.Array, pred: pa.Array) -> Iterator[tuple[list, list]]:
    """The sentences (lists of token lists) of both sides, row by row."""
    _no_nulls(ref, pred)

    def tokens(x):
        upto = np.concatenate(([0], np.cumsum(_lengths(x.flatten()))))
        return np.diff(upto[np.concatenate(([0], np.cumsum(_lengths(x))))])

    for lo, hi in parts(tokens(ref) + tokens(pred), TOKENS_AT_ONCE):
        r, p = ref.slice(lo, hi - lo), pred.slice(lo, hi - lo)
        rs, ps = _numbered(r.flatten(), p.flatten())
        yield from zip(_split(rs, _lengths(r)), _split(ps, _lengths(p)))


@F.arrow_udf(T.DoubleType())
def rouge_l_udf(ref: pa.Array, pred: pa.Array) -> pa.Array:
    return pa.array([lcs_f(r, p) for r, p in _rows(ref, pred)], pa.float64())


@F.arrow_udf(T.DoubleType())
def rouge_lsum_udf(ref: pa.Array, pred: pa.Array) -> pa.Array:
    return pa.array([union_lcs_f(r, p) for r, p in _sentence_rows(ref, pred)], pa.float64())
