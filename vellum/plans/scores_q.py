"""Registered queries of job D (reconstruction scoring).

Pairs come from ``conversations``: the reference is a turn, the prediction is
the turn ``k`` steps later in the same conversation (run = k, 1..3), so there
are several runs per dataset as in the reference's repeated generation. The
dataset key is the role of the reference turn.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import results as R
from vellum.operators import scoring as S
from vellum.plans import duck as D
from vellum.session import table

Q: dict = {}
SQL: dict = {}
RUNS = (1, 2, 3)
N_BOOT = 1000
SEED = 2023


def pairs(spark, sf, runs=(1,)):
    """(dataset, run, pair_id, ref, pred): equi-join of a turn with the turn
    ``run`` steps later (keys are unique, so the join cannot skew)."""
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("role").alias("dataset"), F.col("text").alias("ref"))
    b = c.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias("pred"))
    out = None
    for k in runs:
        j = a.join(b, (a.conv_id == b._c) & (b._t == a.turn + k)).select(
            "dataset", F.lit(k).alias("run"),
            F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "ref", "pred")
        out = j if out is None else out.unionByName(j)
    return out


def pairs_sql(runs=(1,)) -> str:
    parts = [f"""SELECT a.role AS dataset, {k} AS run, concat_ws(':', a.conv_id, a.turn) AS pair_id,
       a.text AS ref, b.text AS pred
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + {k}"""
             for k in runs]
    return "\nUNION ALL\n".join(parts)


def overlap_sql(tok_cte: str, keys: str, left: str, right: str) -> str:
    """SQL for per-row multiset overlap of two list columns, by exploding and
    counting both sides (keys = comma list of row key columns)."""
    return f"""(SELECT {keys}, CAST(coalesce(sum(least(pc, lc)), 0) AS BIGINT) AS ov FROM
  (SELECT {keys}, x, count(*) AS pc FROM {tok_cte}, unnest({left}) u(x) GROUP BY ALL) P
  JOIN (SELECT {keys}, x, count(*) AS lc FROM {tok_cte}, unnest({right}) u(x) GROUP BY ALL) L
  USING ({keys}, x) GROUP BY ALL)"""


def r9(c):
    return F.round(c, 9)


# ------------------------------------------------------------ pairing ---
def pair_text_pred(spark, sf):
    p = pairs(spark, sf, RUNS)
    return p.groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("n_pairs"),
                                           F.sum(F.length("ref")).alias("ref_chars"),
                                           F.sum(F.length("pred")).alias("pred_chars"))


Q["pair_text_pred"] = pair_text_pred
SQL["pair_text_pred"] = f"""
SELECT dataset, run, count(*) AS n_pairs, CAST(sum(length(ref)) AS BIGINT) AS ref_chars,
       CAST(sum(length(pred)) AS BIGINT) AS pred_chars
FROM ({pairs_sql(RUNS)}) GROUP BY dataset, run"""
Q["pair_ref_pred"] = pair_text_pred
SQL["pair_ref_pred"] = SQL["pair_text_pred"]


# ------------------------------------------------------------ tokenizers ---
def _tok_counts(fn):
    def q(spark, sf):
        c = table(spark, sf, "conversations").select("role", fn(F.col("text")).alias("t"))
        return c.groupBy("role").agg(F.sum(F.size("t")).alias("n_tokens"),
                                     F.sum(F.size(F.array_distinct("t"))).alias("n_row_distinct"),
                                     F.sum(F.length(F.array_join("t", " "))).alias("n_chars"))
    return q


def _tok_counts_sql(dfn):
    return f"""
SELECT role, CAST(sum(len(t)) AS BIGINT) AS n_tokens,
       CAST(sum(len(list_distinct(t))) AS BIGINT) AS n_row_distinct,
       CAST(sum(length(array_to_string(t, ' '))) AS BIGINT) AS n_chars
FROM (SELECT role, {dfn('text')} AS t FROM conversations) GROUP BY role"""


for _name, _fn, _dfn in [("tok_13a", T.tok_13a, D.tok_13a), ("tok_rouge", T.tok_rouge, D.tok_rouge),
                         ("str_drop_stopwords", T.pure_tokens, D.pure_tokens)]:
    Q[_name] = _tok_counts(_fn)
    SQL[_name] = _tok_counts_sql(_dfn)


def str_strip_punct(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.sum(F.length(T.strip_punct(F.lower("text")))).alias("n_chars"),
                                 F.count_distinct(T.strip_punct("text")).alias("n_distinct"))


Q["str_strip_punct"] = str_strip_punct
SQL["str_strip_punct"] = f"""
SELECT role, CAST(sum(length(translate(lower(text), {D.q(T.PUNCTUATION)}, ''))) AS BIGINT) AS n_chars,
       count(DISTINCT translate(text, {D.q(T.PUNCTUATION)}, '')) AS n_distinct
FROM conversations GROUP BY role"""


def arr_ngrams(spark, sf):
    from vellum.functions import arrays as A
    c = table(spark, sf, "conversations").select("role", T.tok_13a(F.col("text")).alias("t"))
    return c.groupBy("role").agg(*[F.sum(F.size(F.array_distinct(A.ngrams("t", n)))).alias(f"n{n}")
                                   for n in range(1, 5)])


Q["arr_ngrams"] = arr_ngrams
SQL["arr_ngrams"] = f"""
SELECT role, {', '.join(f'CAST(sum(len(list_distinct({D.ngrams("t", n)}))) AS BIGINT) AS n{n}' for n in range(1, 5))}
FROM (SELECT role, {D.tok_13a('text')} AS t FROM conversations) GROUP BY role"""


# ------------------------------------------------------------ token F1 ---
def metric_token_f1(spark, sf):
    f = S.token_f1(pairs(spark, sf, RUNS), by=["dataset", "run"])
    return f.select("dataset", "run", r9(F.col("precision")).alias("precision"),
                    r9(F.col("recall")).alias("recall"), r9(F.col("f1")).alias("f1"))


_F1_SQL = f"""
WITH p AS ({pairs_sql(RUNS)}),
tok AS (SELECT dataset, run, pair_id, {D.pure_tokens('pred')} AS pt, {D.pure_tokens('ref')} AS lt FROM p),
ov AS {overlap_sql('tok', 'dataset, run, pair_id', 'pt', 'lt')},
rowv AS (SELECT t.dataset, t.run,
   CASE WHEN len(pt) = 0 OR len(lt) = 0 THEN (CASE WHEN len(pt) = len(lt) THEN 1.0 ELSE 0.0 END)
        ELSE coalesce(ov.ov, 0) / len(pt) END AS pr,
   CASE WHEN len(pt) = 0 OR len(lt) = 0 THEN (CASE WHEN len(pt) = len(lt) THEN 1.0 ELSE 0.0 END)
        ELSE coalesce(ov.ov, 0) / len(lt) END AS rc
  FROM tok t LEFT JOIN ov USING (dataset, run, pair_id)),
agg AS (SELECT dataset, run, avg(pr) AS precision, avg(rc) AS recall FROM rowv GROUP BY dataset, run)
SELECT dataset, run, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1
FROM agg"""
Q["metric_token_f1"] = metric_token_f1
SQL["metric_token_f1"] = _F1_SQL


def agg_macro_pr(spark, sf):
    return metric_token_f1(spark, sf).select("dataset", "run", "precision", "recall")


Q["agg_macro_pr"] = agg_macro_pr
SQL["agg_macro_pr"] = f"SELECT dataset, run, precision, recall FROM ({_F1_SQL})"


# ------------------------------------------------------------------ BLEU ---
def _bleu_counts_sql(runs=(1,), max_order=4):
    grams = ", ".join(f"{D.ngrams('tt', n)} AS tg{n}, {D.ngrams('rt', n)} AS rg{n}" for n in range(1, max_order + 1))
    ovs = ",\n".join(f"ov{n} AS {overlap_sql('g', 'dataset, run, pair_id', f'tg{n}', f'rg{n}')}"
                     for n in range(1, max_order + 1))
    joins = " ".join(f"LEFT JOIN ov{n} o{n} USING (dataset, run, pair_id)" for n in range(1, max_order + 1))
    sums = ", ".join(f"CAST(sum(coalesce(o{n}.ov, 0)) AS BIGINT) AS m{n}, "
                     f"CAST(sum(greatest(len(tt) - {n} + 1, 0)) AS BIGINT) AS p{n}" for n in range(1, max_order + 1))
    return f"""
WITH p AS ({pairs_sql(runs)}),
tok AS (SELECT dataset, run, pair_id, {D.tok_13a('pred')} AS tt, {D.tok_13a('ref')} AS rt FROM p),
g AS (SELECT dataset, run, pair_id, tt, rt, {grams} FROM tok),
{ovs}
SELECT dataset, run, CAST(sum(len(tt)) AS BIGINT) AS translation_length,
       CAST(sum(len(rt)) AS BIGINT) AS reference_length, {sums}
FROM g {joins} GROUP BY dataset, run"""


def _bleu_score_sql(k: int) -> str:
    precs = [f"(CASE WHEN p{n} > 0 THEN m{n} / p{n} ELSE 0.0 END)" for n in range(1, k + 1)]
    minp = precs[0] if k == 1 else f"least({', '.join(precs)})"
    logs = " + ".join(f"ln({p}) / {k}" for p in precs)
    ratio = "(translation_length::DOUBLE / reference_length)"
    bp = f"(CASE WHEN {ratio} > 1.0 THEN 1.0 WHEN {ratio} > 0 THEN exp(1 - 1.0 / {ratio}) ELSE 0.0 END)"
    return f"(CASE WHEN {minp} > 0 THEN exp({logs}) ELSE 0.0 END) * {bp}"


def agg_bleu_corpus(spark, sf):
    return S.bleu_counts(pairs(spark, sf, RUNS), by=["dataset", "run"])


Q["agg_bleu_corpus"] = agg_bleu_corpus
SQL["agg_bleu_corpus"] = _bleu_counts_sql(RUNS)


def metric_bleu_1_to_4(spark, sf):
    b = S.bleu_1_to_4(pairs(spark, sf, RUNS), by=["dataset", "run"])
    return b.select("dataset", "run", *[r9(F.col(f"bleu{k}")).alias(f"bleu{k}") for k in range(1, 5)])


Q["metric_bleu_1_to_4"] = metric_bleu_1_to_4
SQL["metric_bleu_1_to_4"] = f"""
SELECT dataset, run, {', '.join(f'round({_bleu_score_sql(k)}, 9) AS bleu{k}' for k in range(1, 5))}
FROM ({_bleu_counts_sql(RUNS)})"""


def metric_bleu_parts(spark, sf):
    b = S.bleu(pairs(spark, sf, RUNS), by=["dataset", "run"])
    return b.select("dataset", "run", r9(F.col("bleu")).alias("bleu"),
                    *[r9(F.col("precisions")[i]).alias(f"precision_{i + 1}") for i in range(4)],
                    r9(F.col("brevity_penalty")).alias("brevity_penalty"),
                    r9(F.col("length_ratio")).alias("length_ratio"),
                    "translation_length", "reference_length")


Q["metric_bleu_parts"] = metric_bleu_parts
_ratio = "(translation_length::DOUBLE / reference_length)"
SQL["metric_bleu_parts"] = f"""
SELECT dataset, run, round({_bleu_score_sql(4)}, 9) AS bleu,
       {', '.join(f'round(CASE WHEN p{n} > 0 THEN m{n} / p{n} ELSE 0.0 END, 9) AS precision_{n}' for n in range(1, 5))},
       round(CASE WHEN {_ratio} > 1.0 THEN 1.0 WHEN {_ratio} > 0 THEN exp(1 - 1.0 / {_ratio}) ELSE 0.0 END, 9) AS brevity_penalty,
       round({_ratio}, 9) AS length_ratio, translation_length, reference_length
FROM ({_bleu_counts_sql(RUNS)})"""


def metric_bleu(spark, sf):
    b = S.bleu(pairs(spark, sf, RUNS), by=["dataset", "run"])
    return b.select("dataset", "run", r9(F.col("bleu")).alias("bleu"))


Q["metric_bleu"] = metric_bleu
SQL["metric_bleu"] = f"SELECT dataset, run, round({_bleu_score_sql(4)}, 9) AS bleu FROM ({_bleu_counts_sql(RUNS)})"


def multi_ref_pairs(spark, sf):
    """Prediction = a turn; references = the turns before and after it."""
    c = table(spark, sf, "conversations")
    cur = c.select("conv_id", "turn", F.col("role").alias("dataset"), F.col("text").alias("pred"))
    prv = c.select(F.col("conv_id").alias("_c1"), F.col("turn").alias("_t1"), F.col("text").alias("_r1"))
    nxt = c.select(F.col("conv_id").alias("_c2"), F.col("turn").alias("_t2"), F.col("text").alias("_r2"))
    j = (cur.join(prv, (cur.conv_id == prv._c1) & (prv._t1 == cur.turn - 1))
         .join(nxt, (cur.conv_id == nxt._c2) & (nxt._t2 == cur.turn + 1)))
    return j.select("dataset", F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "pred",
                    F.array("_r1", "_r2").alias("refs"))


_MULTI_SQL = """SELECT c.role AS dataset, concat_ws(':', c.conv_id, c.turn) AS pair_id, c.text AS pred,
       [a.text, b.text] AS refs
FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn + 1"""


def metric_bleu_multi_ref(spark, sf):
    b = S.bleu_multi(multi_ref_pairs(spark, sf), key="pair_id", by=["dataset"])
    return b.select("dataset", r9(F.col("bleu")).alias("bleu"), "translation_length", "reference_length")


def _bleu_multi_sql():
    gl = "list_concat(" + ", ".join(D.ngrams("x", n) for n in range(1, 5)) + ")"
    return f"""
WITH p AS ({_MULTI_SQL}),
tok AS (SELECT dataset, pair_id, {D.tok_13a('pred')} AS tt,
               list_transform(refs, lambda r: {D.tok_13a('r')}) AS rts FROM p),
pg AS (SELECT pair_id, g, count(*) AS cp FROM
        (SELECT pair_id, unnest({gl.replace('x', 'tt')}) AS g FROM tok) GROUP BY ALL),
rg0 AS (SELECT pair_id, ri, g, count(*) AS c FROM
        (SELECT pair_id, ri, unnest({gl.replace('x', 'rt')}) AS g FROM
           (SELECT pair_id, u.rt, u.ri FROM tok, unnest(rts) WITH ORDINALITY AS u(rt, ri))) GROUP BY ALL),
rg AS (SELECT pair_id, g, max(c) AS cr FROM rg0 GROUP BY ALL),
m AS (SELECT pair_id, len(string_split(g, ' ')) AS n, sum(least(cp, cr)) AS mm FROM pg JOIN rg USING (pair_id, g) GROUP BY ALL),
row AS (SELECT t.dataset, t.pair_id, len(tt) AS tl, list_min(list_transform(rts, lambda r: len(r))) AS rl,
   {', '.join(f'(SELECT coalesce(sum(mm), 0) FROM m WHERE m.pair_id = t.pair_id AND m.n = {n}) AS m{n}, greatest(len(tt) - {n} + 1, 0) AS p{n}' for n in range(1, 5))}
   FROM tok t),
agg AS (SELECT dataset, CAST(sum(tl) AS BIGINT) AS translation_length, CAST(sum(rl) AS BIGINT) AS reference_length,
   {', '.join(f'sum(m{n}) AS m{n}, sum(p{n}) AS p{n}' for n in range(1, 5))} FROM row GROUP BY dataset)
SELECT dataset, round({_bleu_score_sql(4)}, 9) AS bleu, translation_length, reference_length FROM agg"""


Q["metric_bleu_multi_ref"] = metric_bleu_multi_ref
SQL["metric_bleu_multi_ref"] = _bleu_multi_sql()


# ------------------------------------------------------------------ ROUGE ---
def _rouge_n_rows_sql(src: str, keys: str) -> str:
    grams = ", ".join(f"{D.ngrams('pt', n)} AS pg{n}, {D.ngrams('rt', n)} AS rg{n}" for n in (1, 2))
    ovs = ",\n".join(f"ov{n} AS {overlap_sql('g', keys, f'pg{n}', f'rg{n}')}" for n in (1, 2))
    sel = []
    for n in (1, 2):
        p = f"(coalesce(o{n}.ov, 0) / greatest(len(pg{n}), 1))"
        r = f"(coalesce(o{n}.ov, 0) / greatest(len(rg{n}), 1))"
        sel.append(f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END AS rouge{n}")
    joins = " ".join(f"LEFT JOIN ov{n} o{n} USING ({keys})" for n in (1, 2))
    return f"""
WITH p AS ({src}),
tok AS (SELECT {keys}, {D.tok_rouge('pred')} AS pt, {D.tok_rouge('ref')} AS rt FROM p),
g AS (SELECT *, {grams} FROM tok),
{ovs}
SELECT {keys}, {', '.join(sel)} FROM g {joins}"""


def metric_rouge_n(spark, sf):
    r = S.rouge_rows(pairs(spark, sf), keep=["dataset", "pair_id"], rouge_types=("rouge1", "rouge2"))
    return r.select("dataset", "pair_id", r9(F.col("rouge1")).alias("rouge1"), r9(F.col("rouge2")).alias("rouge2"))


Q["metric_rouge_n"] = metric_rouge_n
SQL["metric_rouge_n"] = (f"SELECT dataset, pair_id, round(rouge1, 9) AS rouge1, round(rouge2, 9) AS rouge2 "
                         f"FROM ({_rouge_n_rows_sql(pairs_sql(), 'dataset, pair_id')})")


def metric_rouge_l(spark, sf):
    r = S.rouge_rows(pairs(spark, sf), keep=["dataset", "pair_id"], rouge_types=("rougeL",))
    return r.select("dataset", "pair_id", r9(F.col("rougeL")).alias("rougeL"))


def metric_rouge_lsum(spark, sf):
    r = S.rouge_rows(pairs(spark, sf), keep=["dataset", "pair_id"], rouge_types=("rougeL", "rougeLsum"))
    return r.select("dataset", "pair_id", r9(F.col("rougeL")).alias("rougeL"),
                    r9(F.col("rougeLsum")).alias("rougeLsum"))


def _fmeasure_sql(hits: str, n_pred: str, n_ref: str) -> str:
    p, r = f"({hits} / {n_pred})", f"({hits} / {n_ref})"
    return (f"CASE WHEN {n_pred} = 0 OR {n_ref} = 0 THEN 0.0 WHEN {p} + {r} > 0 "
            f"THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END")


def _sent_tokens_sql(src: str, keys: str, col: str, pos: str) -> str:
    """Non-empty newline sentences of ``col``, tokenised, one row each."""
    return f"""(SELECT * FROM (SELECT {keys}, u.i AS {pos}, {D.tok_rouge('u.s')} AS t
  FROM {src}, unnest(list_filter(string_split({col}, chr(10)), lambda s: s <> '')) WITH ORDINALITY AS u(s, i))
  WHERE len(t) > 0)"""


def _rouge_l_rows_sql(src: str, keys: str) -> str:
    """rougeL (LCS of the token lists) and rougeLsum (summary-level union LCS).

    Union-LCS hits: every reference position is taken at most once, so the
    reference counter never runs out and hits = sum over tokens t of
    min(#union-LCS positions holding t, #t in the prediction)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
WITH p AS ({src}),
tok AS (SELECT {keys}, {D.tok_rouge('pred')} AS pt, {D.tok_rouge('ref')} AS rt FROM p),
l AS (SELECT {keys}, len(pt) AS np, len(rt) AS nr, {D.lcs_len('rt', 'pt')} AS n FROM tok),
rs AS {_sent_tokens_sql('p', keys, 'ref', 'ri')},
ps AS {_sent_tokens_sql('p', keys, 'pred', 'ci')},
sx AS (SELECT a.*, b.ci, b.t AS ct FROM rs a JOIN ps b ON {on}),
tb AS (SELECT *, {D.lcs_table('t', 'ct')} AS tab FROM sx),
ix AS (SELECT DISTINCT {keys}, ri, u.k, t[u.k + 1] AS w
       FROM (SELECT *, {D.lcs_backtrack('t', 'ct', 'tab')} AS o FROM tb), unnest(o) AS u(k)),
uc AS (SELECT {keys}, w, count(*) AS uc FROM ix GROUP BY ALL),
pc AS (SELECT {keys}, w, count(*) AS pc FROM ps, unnest(t) AS u(w) GROUP BY ALL),
h AS (SELECT {keys}, sum(least(uc, pc)) AS hits FROM uc JOIN pc USING ({keys}, w) GROUP BY ALL),
m AS (SELECT {keys}, sum(len(t)) AS m FROM rs GROUP BY ALL),
n AS (SELECT {keys}, sum(len(t)) AS n FROM ps GROUP BY ALL)
SELECT {keys}, {_fmeasure_sql('l.n', 'l.np', 'l.nr')} AS rougeL,
       {_fmeasure_sql('coalesce(h.hits, 0)', 'coalesce(n.n, 0)', 'coalesce(m.m, 0)')} AS rougeLsum
FROM l LEFT JOIN h USING ({keys}) LEFT JOIN m USING ({keys}) LEFT JOIN n USING ({keys})"""


Q["metric_rouge_l"] = metric_rouge_l
SQL["metric_rouge_l"] = (f"SELECT dataset, pair_id, round(rougeL, 9) AS rougeL "
                         f"FROM ({_rouge_l_rows_sql(pairs_sql(), 'dataset, pair_id')})")
Q["metric_rouge_lsum"] = metric_rouge_lsum
SQL["metric_rouge_lsum"] = (f"SELECT dataset, pair_id, round(rougeL, 9) AS rougeL, round(rougeLsum, 9) AS rougeLsum "
                            f"FROM ({_rouge_l_rows_sql(pairs_sql(), 'dataset, pair_id')})")


def metric_rouge_multi_ref(spark, sf):
    r = S.rouge_rows_multi(multi_ref_pairs(spark, sf), key="pair_id", keep=["dataset"])
    return r.select("dataset", "pair_id", *[r9(F.col(t)).alias(t) for t in S.ROUGE_TYPES])


Q["metric_rouge_multi_ref"] = metric_rouge_multi_ref
_EXPL = f"SELECT dataset, pair_id || '#' || ri AS rk, pair_id, pred, ref FROM ({_MULTI_SQL}), unnest(refs) WITH ORDINALITY AS u(ref, ri)"
SQL["metric_rouge_multi_ref"] = f"""
SELECT dataset, pair_id, round(max(rouge1), 9) AS rouge1, round(max(rouge2), 9) AS rouge2,
       round(max("rougeL"), 9) AS "rougeL", round(max("rougeLsum"), 9) AS "rougeLsum"
FROM ({_rouge_n_rows_sql(_EXPL, 'dataset, rk, pair_id')}) JOIN ({_rouge_l_rows_sql(_EXPL, 'dataset, rk, pair_id')})
USING (dataset, rk, pair_id) GROUP BY dataset, pair_id"""


def _boot_sql(rows_sql: str, key: str, by: str, cols) -> str:
    w = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(S.poisson1_cdf())) + " ELSE 12 END"
    step, *multipliers = S.SPLITMIX
    mod = f"{1 << 64}::UHUGEINT"
    mixes, z = [], "z0"
    for i, (shift, m) in enumerate(zip((30, 27), multipliers)):
        mixes.append(f"x{i} AS (SELECT *, (xor({z}, {z} >> {shift}) * {m}::UHUGEINT) % {mod} AS z{i + 1} FROM {'x' + str(i - 1) if i else 'x'})")
        z = f"z{i + 1}"
    sums = ", ".join(f"sum(w * {c}) AS s_{c}" for c in cols)
    means = ", ".join(f"s_{c} / sw AS {c}" for c in cols)
    qs = ", ".join(f"quantile_cont({c}, [0.025, 0.5, 0.975]) AS q_{c}" for c in cols)
    outs = ", ".join(f"round(q_{c}[1], 9) AS {c}_low, round(q_{c}[2], 9) AS {c}, round(q_{c}[3], 9) AS {c}_high"
                     for c in cols)
    return f"""
WITH r AS ({rows_sql}),
x AS (SELECT {by}, b, {', '.join(cols)},
             (('0x' || substr(md5(concat_ws(':', '{SEED}', {key})), 1, 16))::UBIGINT::UHUGEINT + (b + 1)::UHUGEINT * {step}::UHUGEINT) % {mod} AS z0
      FROM r, range(0, {N_BOOT}) t(b)),
{', '.join(mixes)},
e AS (SELECT {by}, b, {', '.join(cols)}, {w} AS w FROM (SELECT *, (xor(z2, z2 >> 31) >> 32)::DOUBLE / 4294967296.0 AS u FROM x1)),
rep AS (SELECT {by}, b, sum(w) AS sw, {sums} FROM e GROUP BY {by}, b),
m AS (SELECT {by}, {means} FROM rep WHERE sw > 0),
qq AS (SELECT {by}, {qs} FROM m GROUP BY {by})
SELECT {by}, {outs} FROM qq"""


def agg_rouge_bootstrap(spark, sf):
    """Intervals of all four types, for every dataset and run."""
    rows = S.rouge_rows(pairs(spark, sf, RUNS), keep=["dataset", "run", "pair_id"])
    b = S.bootstrap_mid(rows, "pair_id", S.ROUGE_TYPES, ["dataset", "run"], N_BOOT, SEED)
    return b.select("dataset", "run", *[r9(F.col(c)).alias(c) for c in b.columns if c not in ("dataset", "run")])


Q["agg_rouge_bootstrap"] = agg_rouge_bootstrap


def metric_rouge_aggregate(spark, sf):
    """Bootstrap mid of all four types, for every dataset and run."""
    r = S.rouge(pairs(spark, sf, RUNS), key="pair_id", by=["dataset", "run"], n_samples=N_BOOT, seed=SEED)
    return r.select("dataset", "run", *[r9(F.col(t)).alias(t) for t in S.ROUGE_TYPES])


Q["metric_rouge_aggregate"] = metric_rouge_aggregate


# ------------------------------------------------------- full reconstruction ---
METRICS = ["precision", "recall", "f1", "rouge1", "rouge2", "rougeL", "rougeLsum",
           "bleu1", "bleu2", "bleu3", "bleu4"]


def metric_reconstruction(spark, sf):
    """All three metric families per (dataset, run), as long metric rows."""
    wide = S.reconstruction_metrics(pairs(spark, sf, RUNS), key="pair_id", by=["dataset", "run"],
                                    n_samples=N_BOOT, seed=SEED)
    long = S.to_long(wide, ["dataset", "run"], METRICS)
    return long.select("dataset", "run", "metric", r9(F.col("value")).alias("value"))


Q["metric_reconstruction"] = metric_reconstruction
_RK = "dataset, run, pair_id"
_REC_ROUGE_ROWS = f"""SELECT dataset, run, pair_id, rouge1, rouge2, rougeL, rougeLsum
FROM ({_rouge_n_rows_sql(pairs_sql(RUNS), _RK)}) JOIN ({_rouge_l_rows_sql(pairs_sql(RUNS), _RK)}) USING ({_RK})"""
_REC_WIDE = f"""
SELECT * FROM ({_F1_SQL})
JOIN ({_boot_sql(_REC_ROUGE_ROWS, "pair_id", "dataset, run", ["rouge1", "rouge2", "rougeL", "rougeLsum"])}) USING (dataset, run)
JOIN (SELECT dataset, run, {', '.join(f'{_bleu_score_sql(k)} AS bleu{k}' for k in range(1, 5))}
      FROM ({_bleu_counts_sql(RUNS)})) USING (dataset, run)"""
SQL["agg_rouge_bootstrap"] = _boot_sql(_REC_ROUGE_ROWS, "pair_id", "dataset, run", ["rouge1", "rouge2", "rougeL", "rougeLsum"])
SQL["metric_rouge_aggregate"] = f"""SELECT dataset, run, rouge1, rouge2, "rougeL", "rougeLsum"
FROM ({_boot_sql(_REC_ROUGE_ROWS, "pair_id", "dataset, run", ["rouge1", "rouge2", "rougeL", "rougeLsum"])})"""
SQL["metric_reconstruction"] = f"WITH w AS ({_REC_WIDE})\n" + "\nUNION ALL\n".join(
    f"SELECT dataset, run, '{m}' AS metric, round({m}, 9) AS value FROM w" for m in METRICS)


# ------------------------------------------------------ metric history sinks ---
def _f1_long(spark, sf):
    f = metric_token_f1(spark, sf)
    return S.to_long(f, ["dataset", "run"], ["precision", "recall", "f1"])


def sink_metric_history(spark, sf):
    """Each run's metric rows are appended to a metrics table (as the
    reference appends to its per-dataset history file after every run); the
    history {dataset: {metric: [v_run1, v_run2, ...]}} and the latest value
    are read back from the table."""
    from vellum.sources.writers import scratch_path
    path = scratch_path(spark, "metrics")
    long = _f1_long(spark, sf)
    for k in RUNS:  # two metric families of a run, as separate calls; the first is retried
        run = long.where(F.col("run") == k)
        for family in (["precision", "recall"], ["f1"], ["precision", "recall"]):
            R.append_metrics(run.where(F.col("metric").isin(family)), path)
    return R.metric_history(spark.read.parquet(path))


_F1_LONG_SQL = f"""SELECT dataset, run, metric, value FROM ({_F1_SQL})
  UNPIVOT (value FOR metric IN (precision, recall, f1))"""
Q["sink_metric_history"] = sink_metric_history
SQL["sink_metric_history"] = f"""
SELECT dataset, metric, list(value ORDER BY run) AS history, arg_max(value, run) AS latest, count(*) AS n_runs
FROM ({_F1_LONG_SQL}) GROUP BY dataset, metric"""


def reconstruction_history(spark, sf):
    """Prediction runs scored as they come: two runs in one call, the third in
    another, the second once more; the history of all metrics is read back."""
    from vellum.sources.writers import scratch_path
    path = scratch_path(spark, "reconstruction")
    for runs in (RUNS[:2], RUNS[2:], RUNS[1:2]):
        h = R.score_runs(pairs(spark, sf, runs), path, "ref", "pred", n_samples=N_BOOT, seed=SEED)
    return h.select("dataset", "metric", F.transform("history", lambda x: F.round(x, 9)).alias("history"), r9(F.col("latest")).alias("latest"), "n_runs")


Q["reconstruction_history"] = reconstruction_history
SQL["reconstruction_history"] = f"""
SELECT dataset, metric, list(value ORDER BY run) AS history, arg_max(value, run) AS latest, count(*) AS n_runs
FROM ({SQL['metric_reconstruction']}) GROUP BY dataset, metric"""


def metric_report(spark, sf):
    return R.report(_f1_long(spark, sf))


Q["metric_report"] = metric_report
SQL["metric_report"] = f"""
SELECT dataset, run, metric, value FROM ({_F1_LONG_SQL})"""
