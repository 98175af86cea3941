"""Registered queries of jobs C and E over ``embeddings`` (vec_id, 64 floats,
label 0-9) and ``conversations``.

Attribute inference on ``embeddings``: the attribute is ``label``; candidate
vectors are the label centroids; the ten generated-text vectors of a row are
deterministic md5-seeded perturbations of its embedding (runs 0-9); the
stored-vector variant scores the unperturbed vector once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import arrays as A
from vellum.functions import text as T
from vellum.operators import corpus as C
from vellum.operators import records as B
from vellum.operators import scoring as S
from vellum.operators import sequences as Q_SEQ
from vellum.operators import vectors as V
from vellum.plans import duck as D
from vellum.plans.records_q import ATTRS, S_RENDER, cand_list_sql, s_render
from vellum.session import stored, table
from vellum.sources import writers as W

SEED = 2023
RUNS = 10
NOISE = 0.2
DIM = 64
POOL_DIM = 8
MAX_LEN = 150
EOS = 50256
BATCH = 8
Q: dict = {}
SQL: dict = {}


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _dot_sql(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), "
            f"lambda acc, x: acc + x, 0.0::DOUBLE)")


def _norm_sql(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE), lambda acc, x: acc + x, 0.0::DOUBLE))"


def _normalize_sql(a: str) -> str:
    return f"list_transform({a}, lambda x: x::DOUBLE / greatest({_norm_sql(a)}, 1e-12))"


# ---------------------------------------------------------- vector scalars ---
def vec_dot(spark, sf):
    e = _emb(spark, sf)
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("b"))
    j = a.join(b, b._v == a.vec_id + 1)
    return j.select("vec_id", F.round(A.dot("a", "b"), 9).alias("dot"))


Q["vec_dot"] = vec_dot
SQL["vec_dot"] = f"""SELECT a.vec_id, round({_dot_sql('a.embedding', 'b.embedding')}, 9) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def vec_l2_normalize(spark, sf):
    e = _emb(spark, sf).select("vec_id", A.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", F.round(A.l2_norm("u"), 9).alias("norm"),
                    F.round(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x), 9).alias("sum_u"))


Q["vec_l2_normalize"] = vec_l2_normalize
SQL["vec_l2_normalize"] = f"""SELECT vec_id, round({_norm_sql('u')}, 9) AS norm,
       round(list_reduce(u, lambda acc, x: acc + x, 0.0::DOUBLE), 9) AS sum_u
FROM (SELECT vec_id, {_normalize_sql('embedding')} AS u FROM embeddings)"""


def vec_argmax_first(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", A.argmax_first("embedding").alias("argmax"),
                    A.n_tied_max("embedding").alias("n_tied"))


Q["vec_argmax_first"] = vec_argmax_first
SQL["vec_argmax_first"] = """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax,
       CAST(len(list_filter(embedding, lambda x: x = list_max(embedding))) AS INTEGER) AS n_tied FROM embeddings"""


def embed_encoder_dim(spark, sf):
    e = V.check_dim(_emb(spark, sf), DIM)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size("embedding")).alias("dim"))


Q["embed_encoder_dim"] = embed_encoder_dim
SQL["embed_encoder_dim"] = "SELECT label, count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings GROUP BY label"


def row_count(spark, sf):
    return _emb(spark, sf).groupBy().agg(F.count(F.lit(1)).alias("n_rows"))


Q["row_count"] = row_count
SQL["row_count"] = "SELECT count(*) AS n_rows FROM embeddings"


def _components(c: str):
    """All components of a vector, in millionths, as one text."""
    return [F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",").alias("components")]


def pair_embedding(spark, sf):
    """Vectors attached to document rows by key (vec_id = doc_id)."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    vecs = _emb(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    j = V.attach(docs, vecs, "doc_id")
    return j.select("doc_id", "lang", *_components("embedding"))


Q["pair_embedding"] = pair_embedding
_COMPONENTS_SQL = "array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x::DOUBLE * 1e6) AS BIGINT) AS VARCHAR)), ',') AS components"
SQL["pair_embedding"] = f"""SELECT d.doc_id, d.lang, {_COMPONENTS_SQL}
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"""


def map_with_index(spark, sf):
    """Row i of the table, by label and id, gets vector i, in descending id order:
    a position on both sides, none of them an id."""
    rows = _emb(spark, sf).select(F.col("vec_id").alias("row_id"), "label")
    vecs = _emb(spark, sf).select("vec_id", (-F.col("vec_id")).alias("place"), "embedding")
    j = V.attach_by_position(rows, vecs, ["label", "row_id"], ["place"])
    return j.select("i", "row_id", "label", "vec_id", *_components("embedding"))


Q["map_with_index"] = map_with_index
SQL["map_with_index"] = f"""
SELECT i, row_id, label, vec_id, {_COMPONENTS_SQL}
FROM (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS i, vec_id AS row_id, label FROM embeddings)
JOIN (SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS i, vec_id, embedding FROM embeddings) USING (i)"""


def embed_batch(spark, sf):
    """Whole documents encoded in batches of 100 by the hashed encoder."""
    docs = table(spark, sf, "documents")
    return embed_summary(V.embed(docs, "text", keep=["doc_id", "lang"], dim=DIM))


def embed_summary(v):
    return v.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size("embedding")).alias("dim"),
        F.sum(F.size(F.filter("embedding", lambda x: x != 0))).cast("long").alias("n_nonzero"),
        F.sum(F.size(F.filter("embedding", lambda x: x > 0))).cast("long").alias("n_positive"))


Q["embed_batch"] = embed_batch
# The hashed encoder's bucket (md5 bits mod 64) and sign (top md5 bit) per token,
# summed per document: the twin checks the non-zero and positive components.
_MD5_64 = "md5(u.tok)"
SQL["embed_batch"] = f"""
WITH t AS (SELECT doc_id, lang, (('0x' || substr({_MD5_64}, 15, 2))::INTEGER % {DIM}) AS bucket,
                  CASE WHEN ('0x' || substr({_MD5_64}, 1, 1))::INTEGER >= 8 THEN 1 ELSE -1 END AS sign
           FROM documents, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS u(tok)),
b AS (SELECT doc_id, lang, bucket, sum(sign) AS s FROM t GROUP BY ALL),
per AS (SELECT doc_id, lang, count(*) FILTER (WHERE s <> 0) AS nz, count(*) FILTER (WHERE s > 0) AS pos
        FROM b GROUP BY ALL)
SELECT d.lang, count(*) AS n_rows, CAST({DIM} AS INTEGER) AS dim,
       CAST(sum(coalesce(per.nz, 0)) AS BIGINT) AS n_nonzero, CAST(sum(coalesce(per.pos, 0)) AS BIGINT) AS n_positive
FROM documents d LEFT JOIN per USING (doc_id, lang) GROUP BY d.lang"""


# ---------------------------------------------------------------- pooling ---
def _tokens(spark, sf):
    c = table(spark, sf, "conversations")
    t = c.select("conv_id", "turn", F.posexplode(T.tok_rouge(F.col("text"))).alias("pos", "token"))
    stop = F.array(*[F.lit(w) for w in T.STOPWORDS_EN])
    return t.select("conv_id", "turn", "pos", V.hashed_token_vector(F.col("token"), POOL_DIM).alias("vec"),
                    F.when(F.array_contains(stop, F.col("token")) | ((F.col("conv_id") + F.col("turn")) % 23 == 0), 0).otherwise(1).alias("mask"))


_TOK_SQL = f"""SELECT conv_id, turn, u.pos - 1 AS pos, u.token,
  list_transform(range(0, {POOL_DIM}), lambda d: ('0x' || substr(md5(u.token || ':' || CAST(d AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / {float(2**32)!r} - 0.5) AS vec,
  CASE WHEN list_contains([{', '.join(D.q(w) for w in T.STOPWORDS_EN)}], u.token) OR (conv_id + turn) % 23 = 0 THEN 0 ELSE 1 END AS mask
FROM conversations, unnest({D.tok_rouge('text')}) WITH ORDINALITY AS u(token, pos)"""


def _vec_cols(col):
    return [F.round(F.col(col)[i], 9).alias(f"v{i}") for i in range(POOL_DIM)]


def pool_mean_masked(spark, sf):
    """Stop words are masked, and every token of some turns, which keep their row."""
    p = V.pool_mean_masked(_tokens(spark, sf), ["conv_id", "turn"])
    return p.select("conv_id", "turn", *_vec_cols("embedding"))


Q["pool_mean_masked"] = pool_mean_masked
SQL["pool_mean_masked"] = f"""SELECT conv_id, turn, {', '.join(f'round(avg(vec[{i + 1}]) FILTER (WHERE mask = 1), 9) AS v{i}' for i in range(POOL_DIM))}
FROM ({_TOK_SQL}) GROUP BY conv_id, turn"""


def pool_cls(spark, sf):
    p = V.pool_cls(_tokens(spark, sf), ["conv_id", "turn"])
    return p.select("conv_id", "turn", *_vec_cols("embedding"))


Q["pool_cls"] = pool_cls
SQL["pool_cls"] = f"""SELECT conv_id, turn, {', '.join(f'round(vec[{i + 1}], 9) AS v{i}' for i in range(POOL_DIM))}
FROM ({_TOK_SQL}) WHERE pos = 0"""


def pool_pooler(spark, sf):
    e = _emb(spark, sf).withColumnRenamed("embedding", "pooler_output")
    p = V.pool_pooler(e)
    return p.select("vec_id", *_components("embedding"))


Q["pool_pooler"] = pool_pooler
SQL["pool_pooler"] = f"SELECT vec_id, {_COMPONENTS_SQL} FROM embeddings"


# ---------------------------------------------------- attribute inference ---
def _rows(spark, sf):
    return _emb(spark, sf).select("vec_id", F.col("label").cast("string").alias("label"), "embedding")


def _candidates(spark, sf):
    rows = B.candidate_lists(_rows(spark, sf), "vec_id", "label", SEED)
    return V.candidates_long(rows.withColumnRenamed("vec_id", "row_id"), "row_id", ["label"])


def _centroids(spark, sf):
    c = V.mean_vectors(_rows(spark, sf), ["label"], "embedding")
    return c.select(F.lit("label").alias("attr"), F.col("label").alias("value"), "embedding")


def _run_vectors(spark, sf):
    e = _emb(spark, sf).select(F.col("vec_id").alias("row_id"), "embedding")
    r = e.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"), "embedding")
    noisy = F.transform("embedding", lambda x, i: x.cast("double") + NOISE * (
        S.hash_uniform(F.lit(SEED), F.col("row_id"), F.col("run"), i) - 0.5))
    return r.select("row_id", "run", noisy.alias("embedding"))


def pair_vector_candidates(spark, sf):
    s = V.attribute_scores(_run_vectors(spark, sf), _candidates(spark, sf), _centroids(spark, sf), normalize=True)
    return s.select("row_id", "attr", "run", "cand_pos", F.round("score", 9).alias("score"))


_CAND_SQL = cand_list_sql("SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings", "vec_id", "label")
_U = f"('0x' || substr(md5(concat_ws(':', '{SEED}', vec_id, r, i - 1)), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r}"
_ATTR_BASE = f"""
WITH cand AS ({_CAND_SQL}),
cl AS (SELECT vec_id AS row_id, 'label' AS attr, CAST(u.pos - 1 AS INTEGER) AS cand_pos, u.v AS value
       FROM cand, unnest(cands) WITH ORDINALITY AS u(v, pos)),
cells AS (SELECT label, u.i - 1 AS d, u.x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, i)),
cent AS (SELECT CAST(label AS VARCHAR) AS value, list(m ORDER BY d) AS cv
         FROM (SELECT label, d, avg(x::DOUBLE) AS m FROM cells GROUP BY label, d) GROUP BY label),
tvm AS (SELECT vec_id AS row_id, CAST(r AS INTEGER) AS run,
               list_transform(embedding, lambda x, i: x::DOUBLE + {NOISE} * ({_U} - 0.5)) AS tv
        FROM embeddings, range(0, {RUNS}) t(r)),
tvs AS (SELECT vec_id AS row_id, 0 AS run, list_transform(embedding, lambda x: x::DOUBLE) AS tv FROM embeddings),
sm AS (SELECT cl.row_id, cl.attr, t.run, cl.cand_pos,
              {_dot_sql(_normalize_sql('t.tv'), _normalize_sql('cent.cv'))} AS score
       FROM cl JOIN cent USING (value) JOIN tvm t USING (row_id)),
ss AS (SELECT cl.row_id, cl.attr, t.run, cl.cand_pos, {_dot_sql('t.tv', 'cent.cv')} AS score
       FROM cl JOIN cent USING (value) JOIN tvs t USING (row_id))
"""


def _acc_sql(scores: str) -> str:
    return f"""
, ranked AS (SELECT row_id, attr, run, cand_pos, score,
     row_number() OVER (PARTITION BY row_id, attr, run ORDER BY score DESC, cand_pos) AS rk,
     count(*) FILTER (WHERE score = mx) OVER (PARTITION BY row_id, attr, run) AS nt
   FROM (SELECT *, max(score) OVER (PARTITION BY row_id, attr, run) AS mx FROM {scores}))
SELECT attr, run, avg(CASE WHEN cand_pos = 0 THEN 1.0 ELSE 0.0 END) AS accuracy,
       CAST(sum(CASE WHEN nt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_tied, count(*) AS n_rows
FROM ranked WHERE rk = 1 GROUP BY attr, run"""


Q["pair_vector_candidates"] = pair_vector_candidates
SQL["pair_vector_candidates"] = _ATTR_BASE + "SELECT row_id, attr, run, cand_pos, round(score, 9) AS score FROM sm"


def agg_accuracy(spark, sf):
    s = V.attribute_scores(_run_vectors(spark, sf), _candidates(spark, sf), _centroids(spark, sf), normalize=True)
    a = V.attribute_accuracy(s)
    return a.select("attr", "run", F.round("accuracy", 9).alias("accuracy"), "n_tied", "n_rows")


def _acc_final(scores):
    return _ATTR_BASE + _acc_sql(scores).replace("SELECT attr, run, avg(", "SELECT attr, run, round(avg(", 1) \
        .replace("ELSE 0.0 END) AS accuracy", "ELSE 0.0 END), 9) AS accuracy", 1)


Q["agg_accuracy"] = agg_accuracy
SQL["agg_accuracy"] = _acc_final("sm")


# Inference from texts: the biographies of two datasets (the training split and
# the rest), three attributes, ten texts per row (words r+1.. of the biography),
# prompts of every candidate value. The encoder's raw counts make exact scores.
TEXT_WORDS = 15


def _bio(spark, sf):
    s = stored(s_render(spark, sf))   # read by the texts, the domains and the draws
    return s.withColumn("dataset", F.when(F.col("split") == "train", "train").otherwise("heldout"))


def _bio_candidates(s):
    return B.candidate_lists_multi(s, "row_id", ATTRS, SEED)


def _counts_encoder():
    return V.HashedEncoder(DIM, normalize=False)


def _inferred(s, preds):
    a = V.infer_attributes(preds, stored(_bio_candidates(s)), ATTRS, _counts_encoder, DIM)
    return a.select("dataset", "attr", "run", F.round("accuracy", 9).alias("accuracy"), "n_tied", "n_rows")


def attr_inference_multi(spark, sf):
    s = _bio(spark, sf)
    words = F.split("text", " ", -1)
    runs = s.select("dataset", "row_id", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"), words.alias("w"))
    return _inferred(s, runs.select("dataset", "row_id", "run", F.array_join(F.slice("w", F.col("run") + 1, TEXT_WORDS), " ").alias("text")))


def attr_inference_stored(spark, sf):
    """The biography itself, encoded once per row."""
    s = _bio(spark, sf)
    return _inferred(s, s.select("dataset", "row_id", F.lit(0).alias("run"), "text"))


def sink_attr_results(spark, sf):
    """Results written per dataset, attribute and run, one run retried, and the
    whole table read back."""
    path = W.scratch_path(spark, "attr-results")
    r = stored(attr_inference_multi(spark, sf))
    W.write_attr_results(r, path)
    W.write_attr_results(r.where("run = 3"), path)
    back = spark.read.schema(r.schema).parquet(path)
    return back.select(F.concat_ws("_", "dataset", "attr").alias("name"), "run", "accuracy", "n_rows")


def _token_sums(text: str, keys: str, src: str) -> str:
    """(keys, bucket, s): the hashed encoder's integer components that are not zero."""
    return f"""SELECT {keys}, bucket, sum(sign) AS s FROM (
  SELECT {keys}, ('0x' || substr({_MD5_64}, 15, 2))::INTEGER % {DIM} AS bucket,
         CASE WHEN ('0x' || substr({_MD5_64}, 1, 1))::INTEGER >= 8 THEN 1 ELSE -1 END AS sign
  FROM {src}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS u(tok)) GROUP BY ALL"""


def _inferred_sql(texts: str) -> str:
    lists = "\nUNION ALL ".join(
        f"SELECT row_id, '{a}' AS attr, u.pos - 1 AS cand_pos, u.v AS value FROM ({cand_list_sql(S_RENDER, 'row_id', a)}), "
        f"unnest(cands) WITH ORDINALITY AS u(v, pos)" for a in ATTRS)
    return f"""
WITH bio AS (SELECT *, CASE WHEN split = 'train' THEN 'train' ELSE 'heldout' END AS dataset FROM ({S_RENDER})),
cl AS ({lists}),
texts AS ({texts}),
prompts AS (SELECT DISTINCT attr, value, 'The ' || replace(attr, '_', ' ') || ' is ' || value AS p FROM cl),
pv AS ({_token_sums('p', 'attr, value', 'prompts')}),
tv AS ({_token_sums('t', 'row_id, run', 'texts')}),
dots AS (SELECT cl.row_id, cl.attr, cl.cand_pos, tv.run, sum(tv.s * pv.s) AS d
         FROM cl JOIN pv USING (attr, value) JOIN tv ON tv.row_id = cl.row_id AND tv.bucket = pv.bucket GROUP BY ALL),
scores AS (SELECT texts.dataset, cl.row_id, cl.attr, cl.cand_pos, texts.run, coalesce(d, 0) AS score
           FROM cl JOIN texts USING (row_id) LEFT JOIN dots USING (row_id, attr, cand_pos, run)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, attr, run ORDER BY score DESC, cand_pos) AS rk,
                  count(*) FILTER (WHERE score = mx) OVER (PARTITION BY row_id, attr, run) AS nt
           FROM (SELECT *, max(score) OVER (PARTITION BY row_id, attr, run) AS mx FROM scores))
SELECT dataset, attr, run, round(avg(CASE WHEN cand_pos = 0 THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       CAST(sum(CASE WHEN nt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_tied, count(*) AS n_rows
FROM ranked WHERE rk = 1 GROUP BY dataset, attr, run"""


Q["attr_inference_multi"] = attr_inference_multi
SQL["attr_inference_multi"] = _inferred_sql(f"""
  SELECT dataset, row_id, CAST(r AS INTEGER) AS run, array_to_string(string_split(text, ' ')[r + 1:r + {TEXT_WORDS}], ' ') AS t
  FROM bio, range(0, {RUNS}) x(r)""")
Q["attr_inference_stored"] = attr_inference_stored
SQL["attr_inference_stored"] = _inferred_sql("SELECT dataset, row_id, 0 AS run, text AS t FROM bio")
Q["sink_attr_results"] = sink_attr_results
SQL["sink_attr_results"] = f"SELECT dataset || '_' || attr AS name, run, accuracy, n_rows FROM ({SQL['attr_inference_multi']})"


def _stored_vectors(spark, sf):
    return _emb(spark, sf).select(F.col("vec_id").alias("row_id"), F.lit(0).alias("run"), "embedding")


def metric_choice_accuracy(spark, sf):
    s = V.attribute_scores(_stored_vectors(spark, sf), _candidates(spark, sf), _centroids(spark, sf))
    return S.choice_accuracy(s, "row_id").select(F.round("exact_match", 9).alias("exact_match"))


Q["metric_choice_accuracy"] = metric_choice_accuracy
SQL["metric_choice_accuracy"] = _ATTR_BASE + """
SELECT round(avg(CASE WHEN cand_pos = 0 THEN 1.0 ELSE 0.0 END), 9) AS exact_match FROM (
  SELECT row_id, cand_pos, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand_pos) AS rk FROM ss)
WHERE rk = 1"""


def str_render_prompt(spark, sf):
    c = _candidates(spark, sf)
    p = c.select("row_id", "cand_pos", B.render_prompt(F.col("attr"), F.col("value")).alias("prompt"))
    return p.groupBy("prompt").agg(F.count(F.lit(1)).alias("n_uses"))


Q["str_render_prompt"] = str_render_prompt
SQL["str_render_prompt"] = _ATTR_BASE.split(",\ncells AS")[0] + """
SELECT 'The ' || replace(attr, '_', ' ') || ' is ' || value AS prompt, count(*) AS n_uses FROM cl GROUP BY 1"""


# ------------------------------------------------------------- logits / ppl ---
def agg_nanmean_logit(spark, sf):
    """Embedding components as token scores, labels -100 where negative."""
    e = _emb(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.when(x < 0, -100).otherwise(1))
                               .alias("labels"), "embedding")
    m = S.nanmean_logit(e, "labels", "embedding", ["vec_id"])
    return m.select("vec_id", F.round("mean_logit", 9).alias("mean_logit"))


Q["agg_nanmean_logit"] = agg_nanmean_logit
SQL["agg_nanmean_logit"] = """SELECT vec_id, round(CASE WHEN len(k) > 0 THEN list_reduce(k, lambda a, x: a + x, 0.0::DOUBLE) / len(k) END, 9) AS mean_logit
FROM (SELECT vec_id, list_transform(list_filter(embedding, lambda x: x >= 0 AND x <> 0), lambda x: x::DOUBLE) AS k FROM embeddings)"""


def agg_perplexity(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("split"),
                                           F.log1p(F.abs("value")).alias("loss"))
    p = S.perplexity(ev, "loss", ["split"])
    return p.select("split", F.round("perplexity", 6).alias("perplexity"))


Q["agg_perplexity"] = agg_perplexity
SQL["agg_perplexity"] = """SELECT event_type AS split, round(exp(avg(ln(1 + abs(value)))), 6) AS perplexity
FROM events GROUP BY event_type"""
Q["math_exp_log"] = agg_perplexity
SQL["math_exp_log"] = SQL["agg_perplexity"]


# --------------------------------------------------------- token sequences ---
def seq_truncate_eos_pad(spark, sf):
    """Token ids (md5 of each token) cut to MAX_LEN, EOS appended when shorter,
    right-padded with -100 to the longest sequence of each batch of BATCH
    rows; batches follow the seeded order."""
    c = table(spark, sf, "conversations")
    ids = F.transform(T.tok_rouge(F.col("text")),
                      lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))
    s = c.select("conv_id", "turn", Q_SEQ.truncate_eos(ids, MAX_LEN, EOS).alias("ids"))
    o = C.seeded_order(s, SEED, ["conv_id", "turn"])
    padded = Q_SEQ.pad_batches(o, "ids", F.floor(F.col("ord") / BATCH))
    return padded.select("conv_id", "turn", F.size("ids").alias("length"),
                         F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


Q["seq_truncate_eos_pad"] = seq_truncate_eos_pad
SQL["seq_truncate_eos_pad"] = f"""
WITH s AS (SELECT conv_id, turn,
   list_transform({D.tok_rouge('text')}, lambda t: ('0x' || substr(md5(t), 1, 4))::INTEGER) AS ids0 FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN len(ids0) < {MAX_LEN} THEN list_append(ids0, {EOS}) ELSE ids0[1:{MAX_LEN}] END AS ids
      FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY {D.order_key(SEED, 'conv_id', 'turn')}, conv_id, turn) - 1 AS ord FROM t),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY ord // {BATCH}) AS mx FROM o)
SELECT conv_id, turn, CAST(mx AS INTEGER) AS length,
       CAST(list_reduce(ids, lambda a, x: a + x, 0::BIGINT) + (-100) * (mx - len(ids)) AS BIGINT) AS sum_ids FROM p"""


# ---------------------------------------------------------------- schema ---
def schema_attributes(spark, sf):
    rows = B.candidate_lists(_rows(spark, sf), "vec_id", "label", SEED)
    attrs = V.schema_attributes(rows, exclude=("vec_id", "text", "pred", "embedding"))
    long = rows.unpivot("vec_id", attrs, "attribute", "value")
    return long.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_distinct("value").alias("n_values"))


Q["schema_attributes"] = schema_attributes
SQL["schema_attributes"] = "SELECT 'label' AS attribute, count(*) AS n_rows, count(DISTINCT label) AS n_values FROM embeddings"


def arr_flatten(spark, sf):
    d = table(spark, sf, "documents")
    nested = F.transform(T.split_sentences(F.col("text")), lambda s: T.split_ws(s))
    return d.groupBy("lang").agg(F.sum(F.size(F.flatten(nested))).alias("n_words"))


Q["arr_flatten"] = arr_flatten
SQL["arr_flatten"] = f"""SELECT lang, CAST(sum(len(flatten(list_transform({D.split_sentences('text')}, lambda s: {D.split_ws('s')})))) AS BIGINT) AS n_words
FROM documents GROUP BY lang"""
