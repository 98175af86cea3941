"""Reconstruction and choice metrics (job D) as Spark aggregates.

Input is a pairs table with a reference text column and a prediction column
plus grouping keys (``by``: e.g. dataset, run). Per-row work is a projection
(tokens, overlaps) and the corpus metrics are algebraic sums / means per group,
so each metric is one partial+final aggregate: no per-group collect.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import arrays as A
from vellum.functions import lcs as L
from vellum.functions import text as T
from vellum.functions.overlap import ngram_overlaps, ngram_overlaps_many
from vellum.session import materialize

ROUGE_TYPES = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# --------------------------------------------------------------- token F1 ---
def token_f1(pairs: DataFrame, ref: str = "ref", pred: str = "pred", by: Sequence[str] = (),
             tokenizer: Callable[[Column], Column] = T.pure_tokens) -> DataFrame:
    """Macro precision/recall (means of per-row values) and F1 of the means."""
    rows = token_f1_rows(pairs, ref, pred, by, tokenizer)
    agg = (rows.groupBy(*by) if by else rows.groupBy()).agg(*_f1_aggregates())
    return agg.withColumn("f1", _f(F.col("precision"), F.col("recall")))


def _f1_aggregates() -> list[Column]:
    return [F.avg("_pr").alias("precision"), F.avg("_rc").alias("recall")]


def token_f1_rows(pairs: DataFrame, ref: str, pred: str, keep: Sequence[str],
                  tokenizer: Callable[[Column], Column] = T.pure_tokens) -> DataFrame:
    """Per-row precision ``_pr`` and recall ``_rc``."""
    tok = pairs.select(*keep, tokenizer(F.col(pred)).alias("_p"), tokenizer(F.col(ref)).alias("_l"))
    ov = tok.select(*keep, F.size("_p").alias("_np"), F.size("_l").alias("_nl"),
                    ngram_overlaps("_p", "_l", [1])[0].alias("_ov"))
    either_empty = (F.col("_np") == 0) | (F.col("_nl") == 0)
    same = F.when(F.col("_np") == F.col("_nl"), 1.0).otherwise(0.0)
    return ov.select(
        *keep,
        F.when(either_empty, same).otherwise(F.col("_ov") / F.col("_np")).alias("_pr"),
        F.when(either_empty, same).otherwise(F.col("_ov") / F.col("_nl")).alias("_rc"),
    )


# ------------------------------------------------------------------- BLEU ---
def _bleu_score(max_order: int, smooth: bool = False):
    """(bleu, precisions, brevity penalty, ratio) Columns over summed counts."""
    precs = []
    for n in range(1, max_order + 1):
        m, p = F.col(f"m{n}"), F.col(f"p{n}")
        if smooth:
            precs.append((m + 1.0) / (p + 1.0))
        else:
            precs.append(F.when(p > 0, m / p).otherwise(F.lit(0.0)))
    min_p = F.least(*precs) if len(precs) > 1 else precs[0]
    log_sum = sum((F.log(x) / max_order for x in precs[1:]), F.log(precs[0]) / max_order)
    geo = F.when(min_p > 0, F.exp(log_sum)).otherwise(F.lit(0.0))
    # An empty reference corpus gives a NULL ratio and a score of 0; an empty
    # translation corpus gives a ratio of 0 and a brevity penalty of 0.
    ratio = F.try_divide(F.col("translation_length").cast("double"), F.col("reference_length"))
    bp = (F.when(ratio > 1.0, F.lit(1.0))
          .when(ratio > 0.0, F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
          .otherwise(F.lit(0.0)))
    return F.coalesce(geo * bp, F.lit(0.0)), precs, bp, ratio


def _bleu_finish(agg: DataFrame, by: Sequence[str], max_order: int, smooth: bool) -> DataFrame:
    score, precs, bp, ratio = _bleu_score(max_order, smooth)
    return agg.select(
        *by,
        score.alias("bleu"),
        F.array(*precs).alias("precisions"),
        bp.alias("brevity_penalty"),
        ratio.alias("length_ratio"),
        "translation_length",
        "reference_length",
    )


def bleu_counts(pairs: DataFrame, ref: str = "ref", pred: str = "pred", by: Sequence[str] = (),
                max_order: int = 4, tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    """Summed clipped matches ``m{n}``, possible matches ``p{n}`` and lengths
    for a single reference per row. The overlaps are counted in the row, so no
    n-gram is ever shuffled."""
    per_row = bleu_rows(pairs, ref, pred, by, max_order, tokenizer)
    return (per_row.groupBy(*by) if by else per_row.groupBy()).agg(*_bleu_aggregates(max_order))


def _bleu_aggregates(max_order: int) -> list[Column]:
    aggs = [F.sum("_tl").cast("long").alias("translation_length"),
            F.sum("_rl").cast("long").alias("reference_length")]
    for n in range(1, max_order + 1):
        aggs += [F.sum(f"_m{n}").cast("long").alias(f"m{n}"), F.sum(f"_p{n}").cast("long").alias(f"p{n}")]
    return aggs


def bleu_rows(pairs: DataFrame, ref: str, pred: str, keep: Sequence[str], max_order: int = 4,
              tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    """Per-row lengths ``_tl``, ``_rl``, clipped matches ``_m{n}`` and possible matches ``_p{n}``."""
    tok = pairs.select(*keep, tokenizer(F.col(pred)).alias("_t"), tokenizer(F.col(ref)).alias("_r"))
    counted = tok.select(*keep, F.size("_t").alias("_tl"), F.size("_r").alias("_rl"),
                         ngram_overlaps("_t", "_r", range(1, max_order + 1)).alias("_m"))
    cols = []
    for n in range(1, max_order + 1):
        cols += [F.col("_m")[n - 1].alias(f"_m{n}"), F.greatest(F.col("_tl") - n + 1, F.lit(0)).alias(f"_p{n}")]
    return counted.select(*keep, "_tl", "_rl", *cols)


def bleu_counts_multi(pairs: DataFrame, refs: str = "refs", pred: str = "pred",
                      key: str = "row_id", by: Sequence[str] = (), max_order: int = 4,
                      tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    """Same sums for several references per row (``refs`` is array<string>):
    clipping is against the per-n-gram maximum over references and the
    reference length is the shortest reference. Counted in the row, as for one
    reference; ``key`` is not needed for it and may repeat."""
    tok = pairs.select(*by, tokenizer(F.col(pred)).alias("_t"), F.transform(F.col(refs), tokenizer).alias("_rs"))
    counted = tok.select(*by, F.size("_t").alias("_tl"), F.array_min(F.transform("_rs", F.size)).alias("_rl"),
                         ngram_overlaps_many("_t", "_rs", range(1, max_order + 1)).alias("_m"))
    cols = []
    for n in range(1, max_order + 1):
        cols += [F.coalesce(F.col("_m")[n - 1], F.lit(0)).alias(f"_m{n}"), F.greatest(F.col("_tl") - n + 1, F.lit(0)).alias(f"_p{n}")]
    per_row = counted.select(*by, "_tl", "_rl", *cols)
    return (per_row.groupBy(*by) if by else per_row.groupBy()).agg(*_bleu_aggregates(max_order))


def bleu(pairs: DataFrame, ref: str = "ref", pred: str = "pred", by: Sequence[str] = (),
         max_order: int = 4, smooth: bool = False,
         tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    """Corpus BLEU with its parts (precisions, brevity penalty, length ratio,
    translation and reference length). An empty reference corpus gives a NULL
    ratio instead of a division error."""
    agg = bleu_counts(pairs, ref, pred, by, max_order, tokenizer)
    return _bleu_finish(agg, by, max_order, smooth)


def bleu_multi(pairs: DataFrame, refs: str = "refs", pred: str = "pred", key: str = "row_id",
               by: Sequence[str] = (), max_order: int = 4, smooth: bool = False,
               tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    agg = bleu_counts_multi(pairs, refs, pred, key, by, max_order, tokenizer)
    return _bleu_finish(agg, by, max_order, smooth)


def bleu_1_to_4(pairs: DataFrame, ref: str = "ref", pred: str = "pred", by: Sequence[str] = (),
                tokenizer: Callable[[Column], Column] = T.tok_13a) -> DataFrame:
    """bleu1..bleu4 from ONE pass: the per-order sums do not depend on the
    maximum order, so the four scores are projections of the same aggregate."""
    agg = bleu_counts(pairs, ref, pred, by, 4, tokenizer)
    return agg.select(*by, *[_bleu_score(k)[0].alias(f"bleu{k}") for k in range(1, 5)])


# ------------------------------------------------------------------ ROUGE ---
def rouge_n_prf(overlap: Column, n_pred: Column, n_ref: Column, n: int):
    """(precision, recall, F) Columns of ROUGE-N from the clipped overlap and
    the two token counts."""
    p = overlap / F.greatest(n_pred - n + 1, F.lit(1))
    r = overlap / F.greatest(n_ref - n + 1, F.lit(1))
    return p, r, _f(p, r)


def _rouge_tokens(df: DataFrame, ref: str, pred: str, keep: Sequence[str],
                  tokenizer: Callable[[Column], Column]) -> DataFrame:
    return df.select(*keep, tokenizer(F.col(pred)).alias("_pt"), tokenizer(F.col(ref)).alias("_rt"),
                     F.col(pred).alias("_ptext"), F.col(ref).alias("_rtext"))


def rouge_rows(pairs: DataFrame, ref: str = "ref", pred: str = "pred", keep: Sequence[str] = (),
               rouge_types: Sequence[str] = ROUGE_TYPES,
               tokenizer: Callable[[Column], Column] = T.tok_rouge) -> DataFrame:
    """Per-row ROUGE F scores (the ``use_aggregator=False`` output)."""
    tok = _rouge_tokens(pairs, ref, pred, keep, tokenizer)
    orders = sorted({int(t[5:]) for t in rouge_types if t[5:].isdigit()})
    if orders:
        tok = tok.withColumn("_ov", ngram_overlaps("_pt", "_rt", orders))
    cols = []
    for t in rouge_types:
        if t[5:].isdigit():
            n = int(t[5:])
            cols.append(rouge_n_prf(F.col("_ov")[orders.index(n)], F.size("_pt"), F.size("_rt"), n)[2].alias(t))
        elif t == "rougeL":
            cols.append(L.rouge_l_udf(F.col("_rt"), F.col("_pt")).alias(t))
        elif t == "rougeLsum":
            def sents(c):
                return F.transform(F.filter(F.split(c, "\n"), lambda s: s != ""), tokenizer)
            cols.append(L.rouge_lsum_udf(sents(F.col("_rtext")), sents(F.col("_ptext"))).alias(t))
        else:
            raise ValueError(f"unknown rouge type {t!r}")
    return tok.select(*keep, *cols)


def rouge_rows_multi(pairs: DataFrame, refs: str = "refs", pred: str = "pred",
                     key: str = "row_id", keep: Sequence[str] = (),
                     rouge_types: Sequence[str] = ROUGE_TYPES,
                     tokenizer: Callable[[Column], Column] = T.tok_rouge) -> DataFrame:
    """Several references: each type keeps the best F over the references; a row
    without references keeps its place, with NULL scores."""
    ex = pairs.select(key, *keep, F.col(pred).alias("_pred"), F.explode_outer(refs).alias("_r"))
    ex = ex.select(key, *keep, "_pred", F.coalesce("_r", F.lit("")).alias("_ref"), F.col("_r").isNotNull().alias("_has"))
    per = rouge_rows(ex, "_ref", "_pred", [key, *keep, "_has"], rouge_types, tokenizer)
    return per.groupBy(key, *keep).agg(*[F.max(F.when(F.col("_has"), F.col(t))).alias(t) for t in rouge_types])


def poisson1_cdf() -> list[float]:
    """P(X <= k) of Poisson(1) for k = 0..11: a uniform u draws the number of
    values <= u. Weights above 12, of probability 6e-11 together, count as 12."""
    cdf, term, out = 0.0, math.exp(-1.0), []
    for k in range(12):
        cdf += term
        term /= k + 1
        out.append(cdf)
    return out


def hash_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


# Weights drawn at once in a task (rows x replicates), and bytes of group sums it holds.
_BOOTSTRAP_CELLS, _BOOTSTRAP_HELD = 500_000, 64 << 20
# Increment and multipliers of the splitmix64 generator.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def counter_uniforms(hashes: np.ndarray, first: int, n: int) -> np.ndarray:
    """Random 32-bit integers (len(hashes), n) from a counter-based generator: the
    splitmix64 output of state hash + (b + 1) * increment, for b = first, first + 1, ...
    No state is carried on, so any row and replicate can be drawn anywhere."""
    step, *multipliers = (np.uint64(x) for x in SPLITMIX)
    z = hashes[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * step
    for shift, m in zip((30, 27), multipliers):
        z ^= z >> np.uint64(shift)
        z *= m
    z ^= z >> np.uint64(31)
    return z >> np.uint64(32)


def _row_hashes(digests: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def poisson1_weights(hashes: np.ndarray, n_samples: int) -> np.ndarray:
    """Poisson(1) weight of each row in each replicate."""
    u = counter_uniforms(hashes, 0, n_samples) / 2.0**32
    return np.searchsorted(np.array(poisson1_cdf()), u, side="right").astype(np.float64)


def bootstrap_weights(seed: int, keys: Sequence[str], n_samples: int) -> np.ndarray:
    """``poisson1_weights`` of rows by their keys: the hash of a row is the first
    64 bits of md5(seed:key)."""
    return poisson1_weights(_row_hashes([hashlib.md5(f"{seed}:{k}".encode()).digest()[:8] for k in keys]), n_samples)


def bootstrap_mid(rows: DataFrame, key: str, score_cols: Sequence[str], by: Sequence[str] = (),
                  n_samples: int = 1000, seed: int = 2023) -> DataFrame:
    """Bootstrap interval of the mean of each score column.

    Poisson(1) weights from a counter-based generator over (row, replicate) replace the
    multinomial draw, which keeps replicates independent per row. A task draws the
    weights of a block of rows at once, adds up the (group, replicate) sums of its
    groups and sends those, so neither rows nor shuffle are multiplied by n_samples per
    row; its memory is bounded by the block and the sums it holds. Returns
    low/mid/high (2.5/50/97.5 percentiles of the replicate means).
    """
    by, score_cols = list(by), list(score_cols)
    digest = F.unhex(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 16))
    src = rows.select(*by, digest.alias("_k"), *[F.col(c).cast("double").alias(c) for c in score_cols])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in by]
    schema = ", ".join([*fields, "_b int", "_sw double", *[f"`_s_{c}` double" for c in score_cols]])
    block = max(1, _BOOTSTRAP_CELLS // n_samples)

    def run(batches):
        held: dict = {}  # group -> (its values, sums: weights, then each score)

        def tables():
            for values, sums in held.values():
                out = pd.DataFrame({"_b": np.arange(n_samples, dtype=np.int32), "_sw": sums[0]})
                for c, s in zip(score_cols, sums[1:]):
                    out[f"_s_{c}"] = s
                for c, v in zip(reversed(by), reversed(values)):
                    out.insert(0, c, [v] * n_samples)
                yield out

        for pdf in batches:
            for lo in range(0, len(pdf), block):
                part = pdf.iloc[lo:lo + block].reset_index(drop=True)
                w = poisson1_weights(_row_hashes(part["_k"].tolist()), n_samples)
                scores = np.nan_to_num(part[score_cols].to_numpy(np.float64))
                groups = part.groupby(by, dropna=False, sort=False).indices.values() if by else [np.arange(len(part))]
                for at in groups:
                    values = [part[c].iloc[at[0]] for c in by]
                    name = tuple(None if v is None or v != v else v for v in values)
                    sums = np.vstack([w[at].sum(axis=0), scores[at].T @ w[at]])
                    held[name] = (values, held[name][1] + sums) if name in held else (values, sums)
                if len(held) * n_samples * 8 * (1 + len(score_cols)) > _BOOTSTRAP_HELD:
                    yield from tables()
                    held = {}
        yield from tables()

    per_rep = src.mapInPandas(run, schema).groupBy(*by, "_b").agg(
        *[F.sum(c).alias(c) for c in ("_sw", *[f"_s_{c}" for c in score_cols])])
    means = per_rep.select(*by, *[F.try_divide(F.col(f"_s_{c}"), F.col("_sw")).alias(c)
                                  for c in score_cols])
    q = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    g = means.groupBy(*by) if by else means.groupBy()
    out = g.agg(*[F.percentile(c, q).alias(f"_q_{c}") for c in score_cols])
    sel = []
    for c in score_cols:
        sel += [F.col(f"_q_{c}")[0].alias(f"{c}_low"), F.col(f"_q_{c}")[1].alias(c),
                F.col(f"_q_{c}")[2].alias(f"{c}_high")]
    return out.select(*by, *sel)


def rouge(pairs: DataFrame, ref: str = "ref", pred: str = "pred", key: str = "row_id",
          by: Sequence[str] = (), rouge_types: Sequence[str] = ROUGE_TYPES,
          n_samples: int = 1000, seed: int = 2023) -> DataFrame:
    """Aggregated ROUGE: bootstrap mid of each F score per group."""
    rows = rouge_rows(pairs, ref, pred, [key, *by], rouge_types)
    return bootstrap_mid(rows, key, list(rouge_types), by, n_samples, seed).select(*by, *rouge_types)


# --------------------------------------------------------------- combined ---
def reconstruction_metrics(pairs: DataFrame, ref: str = "ref", pred: str = "pred",
                           key: str = "row_id", by: Sequence[str] = (),
                           n_samples: int = 1000, seed: int = 2023) -> DataFrame:
    """precision, recall, f1, rouge1/2/L/Lsum, bleu1..4 in one wide row per group.

    The pairs are read once: one projection has the numbers of each row for all
    three families (kept in the checkpoint folder), one aggregate sums F1 and
    BLEU, and the bootstrap reads the same rows."""
    keys = list(by) or ["_all"]
    if not by:  # one group: a constant key keeps the two results an equi-join
        pairs = pairs.withColumn("_all", F.lit(0))
    texts = [f"_{ref}", f"_{pred}"]
    rows = pairs.select(*keys, key, F.col(ref).alias(texts[0]), F.col(pred).alias(texts[1]))
    rows = token_f1_rows(rows, *texts, [*keys, key, *texts])
    rows = bleu_rows(rows, *texts, [*rows.columns])
    rows = materialize(rouge_rows(rows, *texts, [c for c in rows.columns if c not in texts]))
    sums = rows.groupBy(*keys).agg(*_f1_aggregates(), *_bleu_aggregates(4))
    sums = sums.withColumn("f1", _f(F.col("precision"), F.col("recall")))
    bleus = [_bleu_score(k)[0].alias(f"bleu{k}") for k in range(1, 5)]
    mid = bootstrap_mid(rows, key, list(ROUGE_TYPES), keys, n_samples, seed).select(*keys, *ROUGE_TYPES)
    out = sums.select(*keys, "precision", "recall", "f1", *bleus).join(mid, keys)
    return out if by else out.drop("_all")


def to_long(wide: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Wide metric row(s) -> long (id..., metric, value) rows."""
    return wide.unpivot(list(id_cols), list(metric_cols), "metric", "value")


# ------------------------------------------------------ choice / model outs ---
def choice_accuracy(scores: DataFrame, group: str, pos: str = "cand_pos", score: str = "score",
                    by: Sequence[str] = ()) -> DataFrame:
    """Fraction of groups whose first arg-max candidate is position 0.

    The arg-max per group is a max_by on (score, -pos): NaN sorts as the
    largest score and ties go to the smallest position."""
    best = scores.groupBy(*by, group).agg(
        F.max_by(F.col(pos), F.struct(F.col(score), -F.col(pos))).alias("_best"))
    g = best.groupBy(*by) if by else best.groupBy()
    return g.agg(F.avg((F.col("_best") == 0).cast("double")).alias("exact_match"))


def nanmean_logit(df: DataFrame, labels: str, values: str, keep: Sequence[str] = ()) -> DataFrame:
    """Mean of ``values`` over positions whose label is not -100; exact zeros
    count as missing (as in the reference); all missing -> NULL."""
    pairs = F.arrays_zip(F.col(labels).alias("l"), F.col(values).alias("v"))
    kept = F.transform(F.filter(pairs, lambda z: (z["l"] != -100) & (z["v"] != 0)),
                       lambda z: z["v"].cast("double"))
    total = F.aggregate(kept, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return df.select(*keep, F.when(F.size(kept) > 0, total / F.size(kept)).alias("mean_logit"))


def perplexity(df: DataFrame, loss: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    """exp(mean loss) per group; a missing loss column is an error."""
    if loss not in df.columns:
        raise KeyError(f"loss column {loss!r} not found")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.exp(F.avg(loss)).alias("perplexity"))
