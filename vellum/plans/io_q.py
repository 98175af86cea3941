"""Registered queries for sources, sinks, the CSV triage job, the masked-term
job and the streaming entry. Round trips write a table derived from the driver
tables to a scratch folder under the session's checkpoint directory and read it
back through the reader under test."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as PT

from vellum.functions import text as T
from vellum.operators import corpus as C
from vellum.operators import records as B
from vellum.operators import vectors as V
from vellum.plans import duck as D
from vellum.plans import scores_q, vectors_q
from vellum.plans.corpus_q import SPLIT_SIZES, ORDERED_CLEAN_SQL, SQL as CSQL, clean_keys
from vellum.plans.records_q import cand_list_sql
from vellum.session import stored, table
from vellum.sources import readers as RD
from vellum.sources import writers as W
from vellum.streaming import sentences as STR
from vellum.streaming import sinks as SK

SEED = 2023
Q: dict = {}
SQL: dict = {}

DOC_SCHEMA = PT.StructType([
    PT.StructField("doc_id", PT.LongType()), PT.StructField("text", PT.StringType()),
    PT.StructField("lang", PT.StringType()), PT.StructField("source", PT.StringType()),
    PT.StructField("n_chars", PT.LongType())])

_DOC_AGG_SQL = """SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       count(DISTINCT md5(text)) AS n_distinct FROM documents GROUP BY lang"""


def _doc_agg(df):
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"),
                                  F.count_distinct(F.md5("text")).alias("n_distinct"))


# ----------------------------------------------------------------- sources ---
def src_jsonl(spark, sf):
    path = W.scratch_path(spark, "jsonl")
    table(spark, sf, "documents").write.json(path)
    return _doc_agg(RD.read_jsonl(spark, path, DOC_SCHEMA))


Q["src_jsonl"] = src_jsonl
SQL["src_jsonl"] = _DOC_AGG_SQL


def src_json_array(spark, sf):
    path = W.scratch_path(spark, "jsonarr")
    W.write_json_arrays(table(spark, sf, "documents"), path)
    return _doc_agg(RD.read_json_records(spark, path, DOC_SCHEMA))


Q["src_json_array"] = src_json_array
SQL["src_json_array"] = _DOC_AGG_SQL


def src_text_dir(spark, sf):
    """One file per document under lang=.. folders; lines joined back. Distinct texts
    are told by their SHA-256, so that a text is not shuffled to be counted."""
    path = W.scratch_path(spark, "textdir")
    W.write_text_files(table(spark, sf, "documents"), path, "text", ["lang"])
    d = RD.read_text_dir(spark, path)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"),
                                 F.count_distinct(F.sha2("text", 256)).alias("n_distinct"))


Q["src_text_dir"] = src_text_dir
_JOINED = D.strip("replace(regexp_replace(text || chr(10), '\\r\\n?', chr(10), 'g'), chr(10), ' ')")
SQL["src_text_dir"] = f"""SELECT lang, count(*) AS n_docs, CAST(sum(length(j)) AS BIGINT) AS n_chars,
       count(DISTINCT j) AS n_distinct FROM (SELECT lang, {_JOINED} AS j FROM documents) GROUP BY lang"""


def sink_split_table(spark, sf):
    """Sentence splits written partitioned by split, texts fetched for the chosen
    sentences only; the test split read back alone (partition pruning)."""
    path = W.scratch_path(spark, "splits")
    chosen = C.shuffled_splits(clean_keys(spark, sf), SPLIT_SIZES, "_h", ["doc_id", "pos"])
    s = C.sentence_texts(chosen, table(spark, sf, "documents"), sum(SPLIT_SIZES.values()))
    W.write_split_table(s.select("doc_id", "pos", "text", "n_words", "ord", "split"), path)
    t = RD.read_split_table(spark, path, "test")
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"), F.sum(F.length("text")).alias("n_chars"),
                                  F.min("ord").alias("min_ord"), F.max("ord").alias("max_ord"),
                                  F.count_distinct("doc_id").alias("n_docs"))


Q["sink_split_table"] = sink_split_table
SQL["sink_split_table"] = f"""
SELECT 'test' AS split, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       min(ord) AS min_ord, max(ord) AS max_ord, count(DISTINCT doc_id) AS n_docs
FROM ({ORDERED_CLEAN_SQL}) WHERE ord >= {SPLIT_SIZES["train"] + SPLIT_SIZES["valid"]} AND ord < {sum(SPLIT_SIZES.values())}"""


def src_saved_table(spark, sf):
    """Saved split tables: the sentence splits with their test split read back by
    partition pruning, and whole documents in three uneven splits, of which one is
    read alone and the whole table at once."""
    path = W.scratch_path(spark, "saved")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "valid").otherwise("test")
    W.write_split_table(table(spark, sf, "documents").withColumn("split", split), path)
    about = [F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.max("doc_id").alias("max_id")]
    one = RD.read_split_table(spark, path, "valid").agg(*about).select(F.lit("valid alone").alias("split"), "n", "n_chars", "max_id")
    docs = one.union(RD.read_split_table(spark, path).groupBy("split").agg(*about)).select(F.lit("documents").alias("saved"), "*")
    sentences = sink_split_table(spark, sf).select(F.lit("sentences").alias("saved"), "*")
    return sentences.unionByName(docs, allowMissingColumns=True)


Q["src_saved_table"] = src_saved_table
SQL["src_saved_table"] = f"""
SELECT 'sentences' AS saved, split, n, n_words, n_chars, min_ord, max_ord, n_docs, CAST(NULL AS BIGINT) AS max_id
FROM ({SQL["sink_split_table"]})
UNION ALL
SELECT 'documents', part, count(*), NULL, CAST(sum(length(text)) AS BIGINT), NULL, NULL, NULL, max(doc_id)
FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS part FROM documents
      UNION ALL SELECT *, 'valid alone' FROM documents WHERE doc_id % 10 = 8)
GROUP BY part"""


def src_multi_dataset(spark, sf):
    """Three datasets (labels 0-2, 3-5, 6-9), two encoders and two splits under
    one root; one scan selects two of the datasets, one encoder and one split by
    partition filters."""
    root = W.scratch_path(spark, "datasets")
    e = table(spark, sf, "embeddings")
    name = F.when(F.col("label") < 3, "low").when(F.col("label") < 6, "middle").otherwise("high")
    split = F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train")
    encoder = F.explode(F.array(F.lit("hashed"), F.lit("other"))).alias("encoder")
    (e.select("*", name.alias("dataset"), split.alias("split"), encoder)
     .write.partitionBy("encoder", "dataset", "split").parquet(root))
    d = RD.read_datasets(spark, root, ["low", "high"], "hashed", "test")
    return d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("sum_label"))


Q["src_multi_dataset"] = src_multi_dataset
SQL["src_multi_dataset"] = """SELECT CASE WHEN label < 3 THEN 'low' ELSE 'high' END AS dataset, count(*) AS n_rows,
       CAST(sum(label) AS BIGINT) AS sum_label FROM embeddings
WHERE vec_id % 3 = 0 AND (label < 3 OR label >= 6) GROUP BY 1"""


def sink_table(spark, sf):
    path = W.scratch_path(spark, "table")
    W.write_table(table(spark, sf, "documents"), path)
    return _doc_agg(spark.read.parquet(path))


Q["sink_table"] = sink_table
SQL["sink_table"] = _DOC_AGG_SQL


def sink_predictions(spark, sf):
    """All runs kept; the latest run per dataset is what the reference's
    overwritten file would hold."""
    path = W.scratch_path(spark, "preds")
    W.write_predictions(scores_q.pairs(spark, sf, scores_q.RUNS).select("dataset", "run", "pair_id",
                                                                          F.col("ref").alias("text"), "pred"), path)
    latest = RD.read_latest_runs(spark, path, "pair_id string, text string, pred string, dataset string, run int, part string")
    return latest.groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("n_rows"),
                                                F.sum(F.length("pred")).alias("pred_chars"))


Q["sink_predictions"] = sink_predictions
SQL["sink_predictions"] = f"""SELECT dataset, run, count(*) AS n_rows, CAST(sum(length(pred)) AS BIGINT) AS pred_chars
FROM ({scores_q.pairs_sql(scores_q.RUNS)}) p
WHERE run = (SELECT max(run) FROM ({scores_q.pairs_sql(scores_q.RUNS)}) q WHERE q.dataset = p.dataset)
GROUP BY dataset, run"""


def sink_attr_predictions(spark, sf):
    rows = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
                                                    "role", "text")
    preds = scores_q.pairs(spark, sf, scores_q.RUNS).select("pair_id", "run", "pred")
    out = W.attr_predictions(rows, preds, "pair_id")
    return out.select("pair_id", "role", F.size("pred").alias("n_preds"), F.md5(F.array_join("pred", "|")).alias("preds_md5"))


Q["sink_attr_predictions"] = sink_attr_predictions
SQL["sink_attr_predictions"] = f"""SELECT c.pair_id, c.role, CAST(len(p.preds) AS INTEGER) AS n_preds, md5(array_to_string(p.preds, '|')) AS preds_md5
FROM (SELECT concat_ws(':', conv_id, turn) AS pair_id, role FROM conversations) c
JOIN (SELECT pair_id, list(pred ORDER BY run) AS preds FROM ({scores_q.pairs_sql(scores_q.RUNS)}) GROUP BY pair_id) p
USING (pair_id)"""


# ------------------------------------------------------------------ triage ---
CSV_SCHEMA = PT.StructType([
    PT.StructField("row_id", PT.LongType()), PT.StructField("DISPOSITION", PT.StringType()),
    PT.StructField("Heart.Rate", PT.DoubleType()), PT.StructField("SystolicBP", PT.DoubleType()),
    PT.StructField("DistolicBP", PT.DoubleType()), PT.StructField("TriageNote", PT.StringType()),
    PT.StructField("ts", PT.StringType())])
TRIAGE_COLS = ["row_id", "DISPOSITION", "Heart.Rate", "SystolicBP", "DistolicBP", "TriageNote"]
TRIAGE_ATTRS = ["disposition", "heart_rate", "systolic_blood_pressure", "diastolic_blood_pressure"]


def _triage_csv(spark, sf):
    e = table(spark, sf, "events")
    df = e.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type").isin("view", "click"), "D").otherwise(F.upper(F.substring("event_type", 1, 1)))
        .alias("DISPOSITION"),
        F.when(F.pmod("event_id", F.lit(13)) == 0, None).otherwise(F.floor("value").cast("double")).alias("Heart.Rate"),
        (F.lit(90) + F.pmod("user_id", F.lit(60))).cast("double").alias("SystolicBP"),
        F.when(F.pmod("user_id", F.lit(17)) == 0, None).otherwise(F.lit(60) + F.pmod("event_id", F.lit(30)))
        .cast("double").alias("DistolicBP"),
        F.concat(F.lit("  patient "), F.col("event_type"), F.lit("\t event  "), F.col("props"),
                 F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit(".")).otherwise(F.lit("")), F.lit(" "))
        .alias("TriageNote"),
        F.col("ts").cast("string").alias("ts"))
    path = W.scratch_path(spark, "triage")
    (df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return RD.read_csv_columns(spark, path, CSV_SCHEMA, TRIAGE_COLS)


_TRI_SRC = """SELECT event_id AS row_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'D' ELSE upper(substr(event_type, 1, 1)) END AS DISPOSITION,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(value)::DOUBLE END AS heart,
  (90 + user_id % 60)::DOUBLE AS sys,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE (60 + event_id % 30)::DOUBLE END AS dia,
  '  patient ' || event_type || chr(9) || ' event  ' || props || CASE WHEN event_id % 2 = 0 THEN '.' ELSE '' END || ' ' AS note
FROM events"""
_TRI_CLEAN = f"SELECT * FROM ({_TRI_SRC}) WHERE heart IS NOT NULL AND sys IS NOT NULL AND dia IS NOT NULL AND note IS NOT NULL"


def triage_records(spark, sf):
    """Columns renamed (and the source misspelling fixed), disposition code
    mapped, vitals cast to int with a lossless check, note cleaned and
    prefixed with the rendered attributes."""
    d = _triage_csv(spark, sf)
    d = d.select(
        "row_id", F.col("TriageNote").alias("text"),
        B.disposition("DISPOSITION").alias("disposition"),
        B.checked_int(F.col("`Heart.Rate`"), "Heart.Rate").alias("heart_rate"),
        B.checked_int("SystolicBP", "SystolicBP").alias("systolic_blood_pressure"),
        B.checked_int("DistolicBP", "DiastolicBP").alias("diastolic_blood_pressure"))
    body = B.required_final_period(T.collapse_ws(T.strip("text")))
    return d.withColumn("text", B.render_attributes({a: F.col(a) for a in TRIAGE_ATTRS}, body))


_DISP = "CASE WHEN DISPOSITION = 'D' THEN 'discharge' ELSE 'admittance' END"
_BODY = f"{D.collapse_ws(D.strip('note'))}"
_TRI_REC = f"""SELECT row_id, {_DISP} AS disposition, CAST(heart AS INTEGER) AS heart_rate,
  CAST(sys AS INTEGER) AS systolic_blood_pressure, CAST(dia AS INTEGER) AS diastolic_blood_pressure,
  'The disposition is ' || {_DISP} || '. The heart rate is ' || CAST(CAST(heart AS INTEGER) AS VARCHAR)
  || '. The systolic blood pressure is ' || CAST(CAST(sys AS INTEGER) AS VARCHAR)
  || '. The diastolic blood pressure is ' || CAST(CAST(dia AS INTEGER) AS VARCHAR) || '. '
  || CASE WHEN ends_with({_BODY}, '.') THEN {_BODY} ELSE {_BODY} || '.' END AS text
FROM ({_TRI_CLEAN})"""


def src_csv_project_dropna(spark, sf):
    d = _triage_csv(spark, sf)
    return d.groupBy("DISPOSITION").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("`Heart.Rate`").alias("sum_heart"),
                                        F.sum("DistolicBP").alias("sum_dia"))


Q["src_csv_project_dropna"] = src_csv_project_dropna
SQL["src_csv_project_dropna"] = f"""SELECT DISPOSITION, count(*) AS n_rows, sum(heart) AS sum_heart, sum(dia) AS sum_dia
FROM ({_TRI_CLEAN}) GROUP BY DISPOSITION"""


def triage_summary(spark, sf):
    r = triage_records(spark, sf)
    return r.groupBy("disposition").agg(F.count(F.lit(1)).alias("n_rows"),
                                        *[F.sum(a).cast("long").alias(f"sum_{a}") for a in TRIAGE_ATTRS[1:]])


_TRI_SUM_SQL = f"""SELECT disposition, count(*) AS n_rows,
  {', '.join(f'CAST(sum({a}) AS BIGINT) AS sum_{a}' for a in TRIAGE_ATTRS[1:])}
FROM ({_TRI_REC}) GROUP BY disposition"""
for _slug in ("build_table", "case_disposition", "cast_columns"):
    Q[_slug] = triage_summary
    SQL[_slug] = _TRI_SUM_SQL


def triage_text(spark, sf):
    return triage_records(spark, sf).select("row_id", "text")


for _slug in ("str_final_period", "str_render_attributes"):
    Q[_slug] = triage_text
    SQL[_slug] = f"SELECT row_id, text FROM ({_TRI_REC})"


def triage_candidates(spark, sf):
    r = stored(triage_records(spark, sf))   # read by the domains, the draws and the join back
    r = B.candidate_lists_multi(r, "row_id", TRIAGE_ATTRS, SEED)
    return r.select("row_id", *[F.array_join(f"{a}_candidate_list", "|").alias(f"{a}_candidates")
                                for a in TRIAGE_ATTRS])


Q["cand_list_triage"] = triage_candidates
_TJ = " ".join(f"JOIN ({cand_list_sql(_TRI_REC, 'row_id', a)}) c_{a} USING (row_id)" for a in TRIAGE_ATTRS)
SQL["cand_list_triage"] = f"""SELECT row_id, {', '.join(f"array_to_string(c_{a}.cands, '|') AS {a}_candidates" for a in TRIAGE_ATTRS)}
FROM ({_TRI_REC}) base {_TJ}"""


# -------------------------------------------------------------- quarantine ---
def quarantine_jsonl(spark, sf):
    """Documents as JSON lines, some cut off in the middle and some with half a
    character: read with the corrupt-record column, checked, written apart in one
    pass; both outputs are counted."""
    path, out = W.scratch_path(spark, "bad-jsonl"), W.scratch_path(spark, "checked")
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") + F.when(F.col("doc_id") % 19 == 0, 0.5).otherwise(0.0)).alias("n_chars"), "text")
    line = F.to_json(F.struct("doc_id", "lang", "n_chars", "text"))
    line = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    d.select(line.alias("value")).write.text(path)
    schema = PT.StructType().add("doc_id", "long").add("lang", "string").add("n_chars", "double").add("text", "string")
    rows = RD.read_jsonl(spark, path, schema, corrupt=True)
    checks = {"parses": F.col(RD.CORRUPT).isNull(), "whole": F.col("n_chars").isNotNull() & B.lossless_int("n_chars"), "text": F.length("text") > 0}
    W.write_checked(rows, checks, out, {"n_chars": F.col("n_chars").cast("int")})
    good = W.read_checked(spark, out).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("amount")).select(
        F.lit("valid").alias("status"), F.col("lang").alias("part"), "n", "amount")
    bad = W.read_checked(spark, out, W.QUARANTINED).groupBy(F.array_join("reasons", ",").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.length("raw") > 0).cast("int")).cast("long").alias("amount")).select(F.lit("quarantined").alias("status"), "part", "n", "amount")
    return good.unionByName(bad)


Q["quarantine_jsonl"] = quarantine_jsonl
SQL["quarantine_jsonl"] = """
WITH d AS (SELECT *, doc_id % 17 = 0 AS broken, doc_id % 19 = 0 AS half, coalesce(length(text), 0) = 0 AS empty FROM documents)
SELECT 'valid' AS status, lang AS part, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS amount FROM d
WHERE NOT broken AND NOT half AND NOT empty GROUP BY lang
UNION ALL
SELECT 'quarantined', CASE WHEN broken THEN 'parses,whole,text' WHEN half AND empty THEN 'whole,text' WHEN half THEN 'whole' ELSE 'text' END AS part,
       count(*) AS n, count(*) AS amount
FROM d WHERE broken OR half OR empty GROUP BY ALL"""


def quarantine_triage(spark, sf):
    """The triage rows with lossy vitals and empty notes kept apart instead of failing the job."""
    out = W.scratch_path(spark, "checked-triage")
    d = _triage_csv(spark, sf).select(
        "row_id", (F.col("`Heart.Rate`") + F.when(F.col("row_id") % 23 == 0, 0.25).otherwise(0.0)).alias("heart_rate"),
        F.col("SystolicBP").alias("systolic"), F.when(F.col("row_id") % 29 == 0, F.lit(" ")).otherwise(F.col("TriageNote")).alias("note"))
    note = T.collapse_ws(T.strip("note"))
    W.write_checked(d, {"heart_rate": B.lossless_int("heart_rate"), "systolic": B.lossless_int("systolic"), "note": F.length(note) > 0}, out,
                    {"heart_rate": F.col("heart_rate").cast("int"), "systolic": F.col("systolic").cast("int"), "note": T.final_period(note)})
    about = [F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids")]
    good = W.read_checked(spark, out).agg(*about, F.sum(F.length("note")).alias("chars")).select(F.lit("valid").alias("part"), "n", "ids", "chars")
    bad = W.read_checked(spark, out, W.QUARANTINED).withColumn("row_id", F.get_json_object("raw", "$.row_id").cast("long"))
    bad = bad.groupBy(F.array_join("reasons", ",").alias("part")).agg(*about, F.lit(0).cast("long").alias("chars"))
    return good.unionByName(bad.select("part", "n", "ids", "chars"))


Q["quarantine_triage"] = quarantine_triage
SQL["quarantine_triage"] = f"""
WITH d AS (SELECT row_id, row_id % 23 = 0 AS lossy, row_id % 29 = 0 AS empty, {D.collapse_ws(D.strip('note'))} AS body FROM ({_TRI_CLEAN}))
SELECT CASE WHEN lossy AND empty THEN 'heart_rate,note' WHEN lossy THEN 'heart_rate' WHEN empty THEN 'note' ELSE 'valid' END AS part,
       count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids,
       CAST(sum(CASE WHEN lossy OR empty THEN 0 WHEN ends_with(body, '.') THEN length(body) ELSE length(body) + 1 END) AS BIGINT) AS chars
FROM d GROUP BY ALL"""


# ------------------------------------------------------------ masked terms ---
def masked_terms(spark, sf):
    """Masked-term records from ``part``: the mask is filled with the row's
    label, the category is dropped, the label becomes the lower-cased term."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lit(" The part "), F.col("p_name"), F.lit(" is sold under <mask> as <mask>. ")).alias("text"),
        F.col("p_brand").alias("label"), F.col("p_type").alias("category"))
    p = p.withColumn("text", T.strip("text"))
    p = p.withColumn("text", F.replace(F.col("text"), F.lit("<mask>"), F.col("label")))
    p = p.drop("category").withColumnRenamed("label", "legal_term").withColumn("legal_term", F.lower("legal_term"))
    return p


_MASK_SQL = f"""SELECT p_partkey AS row_id,
  replace({D.strip("' The part ' || p_name || ' is sold under <mask> as <mask>. '")}, '<mask>', p_brand) AS text,
  lower(p_brand) AS legal_term FROM part"""


def str_mask_fill(spark, sf):
    return masked_terms(spark, sf).select("row_id", "text", "legal_term")


Q["str_mask_fill"] = str_mask_fill
SQL["str_mask_fill"] = _MASK_SQL


def cand_list_terms(spark, sf):
    r = B.candidate_lists(masked_terms(spark, sf), "row_id", "legal_term", SEED)
    return r.select("row_id", F.array_join("legal_term_candidate_list", "|").alias("candidates"))


Q["cand_list_terms"] = cand_list_terms
SQL["cand_list_terms"] = f"""SELECT row_id, array_to_string(cands, '|') AS candidates
FROM ({cand_list_sql(_MASK_SQL, 'row_id', 'legal_term')})"""


# --------------------------------------------------------------- streaming ---
def stream_sentence_clean(spark, sf):
    """The flagship cleaning run as a Structured Streaming query over the
    documents table read in place (availableNow), then aggregated in batch.
    The source is a glob that names the table, be it a folder or one file."""
    out = W.scratch_path(spark, "stream-out")
    ckpt = W.scratch_path(spark, "stream-ckpt")
    q = STR.run_to_table(spark, f"{sf.rstrip('/')}/documents.parque[t]", DOC_SCHEMA, out, ckpt)
    q.awaitTermination()
    s = spark.read.parquet(out)
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.round(F.avg("n_words"), 9).alias("avg_words"))


Q["stream_sentence_clean"] = stream_sentence_clean
SQL["stream_sentence_clean"] = CSQL["flt_sentence_clean"]


def stream_metric_history(spark, sf):
    """Token F1 of every run from a stream of prediction pairs: micro-batches add
    their sums to a table keyed by batch, and the first batch is written twice."""
    source, out, ckpt = (W.scratch_path(spark, n) for n in ("pair-stream", "f1-sums", "f1-checkpoint"))
    pairs = scores_q.pairs(spark, sf, scores_q.RUNS).select("dataset", "run", "pair_id", "ref", "pred")
    stream = SK.stream_of(pairs, source, ["run", "pair_id"], 3)
    by = ["dataset", "run"]
    SK.idempotent_sink(stream, lambda batch: SK.token_f1_sums(batch, by), out, ckpt).awaitTermination()
    again = stored(spark.read.parquet(out).where(F.col(SK.BATCH) == 0).drop(SK.BATCH))
    SK.write_batch(again, 0, out)
    h = SK.token_f1_history(spark, out, by)
    return h.select(*by, *[scores_q.r9(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


Q["stream_metric_history"] = stream_metric_history
SQL["stream_metric_history"] = scores_q.SQL["metric_token_f1"]


def stream_embed_batch(spark, sf):
    """The batch encoder on a stream of documents, into a table keyed by batch."""
    source, out, ckpt = (W.scratch_path(spark, n) for n in ("doc-stream", "vectors", "vectors-checkpoint"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    stream = SK.stream_of(docs, source, ["doc_id"], 2)
    SK.idempotent_sink(stream, lambda batch: V.embed(batch, "text", ["doc_id", "lang"], dim=vectors_q.DIM), out, ckpt).awaitTermination()
    return vectors_q.embed_summary(spark.read.parquet(out))


Q["stream_embed_batch"] = stream_embed_batch
SQL["stream_embed_batch"] = vectors_q.SQL["embed_batch"]
