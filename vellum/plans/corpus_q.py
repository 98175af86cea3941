"""Registered queries of job A (sentence corpora) over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import corpus as C
from vellum.plans import duck as D
from vellum.session import table

SEED = 2023
# Split sizes of the registered split query: the sample table of the reference
# README (1,000 / 100 / 100); the remainder bands take 100 rows each.
SPLIT_SIZES = {"train": 1000, "valid": 100, "test": 100}
BAND_SIZE = 100
# Shuffle sample of documents: rows 250..299 of the shuffled order.
SLICE = (250, 300)
FIRST_N = 250
# Bracket suffixes injected (chosen by md5 of the sentence key) because the
# driver text holds almost no brackets.
BRACKET_SUFFIXES = ["", "(", ")", "()", "[(])", "{[]}", "(((", ")(", "[", "]", "{}", "{",
                    "}", "([{}])", "(]", "[)"]

Q: dict = {}
SQL: dict = {}


def docs(spark, sf):
    return table(spark, sf, "documents")


def _sentences(spark, sf):
    return C.sentences(docs(spark, sf), keep=["doc_id", "lang", "source"])


def _clean(spark, sf):
    sents = C.sentences(docs(spark, sf), keep=["doc_id", "lang", "source"], n_words="n_words")
    return C.clean_sentences(sents, 8, 128)


SENT_SQL = f"""
  SELECT d.doc_id, d.lang, d.source, CAST(u.pos - 1 AS INTEGER) AS pos, {D.strip('u.raw')} AS text, u.raw
  FROM documents d,
       unnest({D.split_sentences('d.text')}) WITH ORDINALITY AS u(raw, pos)
"""
CLEAN_SQL = f"""
  SELECT s.*, CAST({D.word_count('s.text')} AS INTEGER) AS n_words FROM ({SENT_SQL}) s
  WHERE {D.sentence_clean('s.text')}
"""


# flagship: documents -> sentences -> quality filter -> per language count and mean length
def flt_sentence_clean(spark, sf):
    return _clean(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.round(F.avg("n_words"), 9).alias("avg_words"))


Q["flt_sentence_clean"] = flt_sentence_clean
SQL["flt_sentence_clean"] = f"""
SELECT lang, count(*) AS n_sentences, round(avg(n_words), 9) AS avg_words
FROM ({CLEAN_SQL}) c GROUP BY lang"""


def str_split_sentence(spark, sf):
    s = _sentences(spark, sf)
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"),
                                 F.count_distinct("text").alias("n_distinct"),
                                 F.sum(F.length("text")).alias("n_chars"))


Q["str_split_sentence"] = str_split_sentence
SQL["str_split_sentence"] = f"""
SELECT lang, count(*) AS n_sentences, count(DISTINCT text) AS n_distinct,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM ({SENT_SQL}) s GROUP BY lang"""


def flt_word_count(spark, sf):
    s = _sentences(spark, sf).withColumn("n", T.word_count("text"))
    return s.groupBy("lang").agg(
        F.sum(F.col("n").between(8, 128).cast("int")).cast("long").alias("n_in_band"),
        F.sum((F.col("n") == 0).cast("int")).cast("long").alias("n_empty"),
        F.sum("n").alias("n_words"))


Q["flt_word_count"] = flt_word_count
SQL["flt_word_count"] = f"""
SELECT lang, CAST(sum(CASE WHEN n BETWEEN 8 AND 128 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_band,
       CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
       CAST(sum(n) AS BIGINT) AS n_words
FROM (SELECT lang, {D.word_count('text')} AS n FROM ({SENT_SQL}) s) GROUP BY lang"""


def flt_leading_punct(spark, sf):
    s = _sentences(spark, sf)
    return s.groupBy("lang").agg(
        F.sum(T.starts_with_punct("text").cast("int")).cast("long").alias("n_leading_punct"))


Q["flt_leading_punct"] = flt_leading_punct
SQL["flt_leading_punct"] = f"""
SELECT lang, CAST(sum(CASE WHEN {D.starts_punct('text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_leading_punct
FROM ({SENT_SQL}) s GROUP BY lang"""


def flt_no_newline(spark, sf):
    s = _sentences(spark, sf)
    return s.groupBy("lang").agg(
        F.sum((~F.col("text").contains("\n")).cast("int")).cast("long").alias("n_single_line"))


Q["flt_no_newline"] = flt_no_newline
SQL["flt_no_newline"] = f"""
SELECT lang, CAST(sum(CASE WHEN NOT contains(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS n_single_line
FROM ({SENT_SQL}) s GROUP BY lang"""


def flt_bracket_balanced(spark, sf):
    s = _sentences(spark, sf)
    idx = F.conv(F.substring(C.order_key(SEED, "doc_id", "pos"), 1, 1), 16, 10).cast("int")
    suffixes = F.array(*[F.lit(x) for x in BRACKET_SUFFIXES])
    probe = F.concat(F.col("text"), F.get(suffixes, idx))
    return s.select("lang", T.is_balanced(probe).alias("ok")).groupBy("lang").agg(
        F.sum(F.col("ok").cast("int")).cast("long").alias("n_balanced"),
        F.sum((~F.col("ok")).cast("int")).cast("long").alias("n_unbalanced"))


Q["flt_bracket_balanced"] = flt_bracket_balanced
_SUFFIX_LIST = "[" + ", ".join(D.q(x) for x in BRACKET_SUFFIXES) + "]"
SQL["flt_bracket_balanced"] = f"""
SELECT lang, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_balanced,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_unbalanced
FROM (SELECT lang, {D.balanced('probe')} AS ok FROM (
  SELECT lang, text || {_SUFFIX_LIST}[('0x' || substr({D.order_key(SEED, 'doc_id', 'pos')}, 1, 1))::INTEGER + 1] AS probe
  FROM ({SENT_SQL}) s)) GROUP BY lang"""


def str_strip(spark, sf):
    s = C.sentences(docs(spark, sf), keep=["lang"],
                    splitter=lambda c: F.split(c, "(?<=[.!?])(?=\\s)"))
    # this splitter leaves the white space on the next piece; strip() removes it
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pieces"),
                                 F.sum(F.length("text")).alias("n_chars"))


Q["str_strip"] = str_strip
SQL["str_strip"] = f"""
SELECT lang, count(*) AS n_pieces, CAST(sum(length({D.strip('u.raw')})) AS BIGINT) AS n_chars
FROM documents d,
     unnest(string_split(regexp_replace(d.text, '([.!?])([\\t\\n\\x0B\\f\\r ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS u(raw)
GROUP BY lang"""


def str_split_ws(spark, sf):
    d = docs(spark, sf)
    return d.groupBy("lang").agg(F.sum(T.word_count("text")).alias("n_words"),
                                 F.sum(F.length(T.collapse_ws("text"))).alias("n_chars_collapsed"))


Q["str_split_ws"] = str_split_ws
SQL["str_split_ws"] = f"""
SELECT lang, CAST(sum({D.word_count('text')}) AS BIGINT) AS n_words,
       CAST(sum(length({D.collapse_ws('text')})) AS BIGINT) AS n_chars_collapsed
FROM documents GROUP BY lang"""
Q["str_collapse_ws"] = str_split_ws
SQL["str_collapse_ws"] = SQL["str_split_ws"]


def str_lower(spark, sf):
    d = docs(spark, sf)
    return d.groupBy("lang").agg(F.count_distinct(F.md5(F.lower("text"))).alias("n_distinct_lower"),
                                 F.sum((F.lower("text") == F.col("text")).cast("int")).cast("long")
                                 .alias("n_already_lower"))


Q["str_lower"] = str_lower
SQL["str_lower"] = """
SELECT lang, count(DISTINCT md5(lower(text))) AS n_distinct_lower,
       CAST(sum(CASE WHEN lower(text) = text THEN 1 ELSE 0 END) AS BIGINT) AS n_already_lower
FROM documents GROUP BY lang"""


def str_first_line(spark, sf):
    d = docs(spark, sf)
    return d.groupBy("lang").agg(F.sum(F.length(T.first_line("text"))).alias("first_line_chars"),
                                 F.count_distinct(T.first_line("text")).alias("n_distinct_first"))


Q["str_first_line"] = str_first_line
SQL["str_first_line"] = f"""
SELECT lang, CAST(sum(length({D.first_line('text')})) AS BIGINT) AS first_line_chars,
       count(DISTINCT {D.first_line('text')}) AS n_distinct_first
FROM documents GROUP BY lang"""


def agg_avg_words(spark, sf):
    return _clean(spark, sf).groupBy("source").agg(F.round(F.avg("n_words"), 9).alias("avg_words"),
                                                   F.count(F.lit(1)).alias("n_sentences"))


Q["agg_avg_words"] = agg_avg_words
SQL["agg_avg_words"] = f"""
SELECT source, round(avg(n_words), 9) AS avg_words, count(*) AS n_sentences
FROM ({CLEAN_SQL}) c GROUP BY source"""


def precond_md5_dedup(spark, sf):
    kept = C.md5_dedup(docs(spark, sf))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("sum_id"))


Q["precond_md5_dedup"] = precond_md5_dedup
SQL["precond_md5_dedup"] = """
SELECT lang, count(*) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS sum_id FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text)) GROUP BY lang"""


def smp_seeded_shuffle(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return C.seeded_order(d, SEED, ["doc_id"]).select("doc_id", "ord")


Q["smp_seeded_shuffle"] = smp_seeded_shuffle
SQL["smp_seeded_shuffle"] = f"""
SELECT doc_id, row_number() OVER (ORDER BY {D.order_key(SEED, 'doc_id')}, doc_id) - 1 AS ord
FROM documents"""

_SHUF_SQL = SQL["smp_seeded_shuffle"]


def _keyed_ids(spark, sf):
    return docs(spark, sf).select("doc_id", C.order_key(SEED, "doc_id").alias("_h"))


def smp_first_n(spark, sf):
    return C.ordinal_range(_keyed_ids(spark, sf), 0, FIRST_N, "_h", ["doc_id"]).select("doc_id", "ord")


Q["smp_first_n"] = smp_first_n
SQL["smp_first_n"] = f"SELECT * FROM ({_SHUF_SQL}) WHERE ord < {FIRST_N}"


def smp_range_slice(spark, sf):
    return C.ordinal_range(_keyed_ids(spark, sf), *SLICE, "_h", ["doc_id"]).select("doc_id", "ord")


Q["smp_range_slice"] = smp_range_slice
SQL["smp_range_slice"] = f"SELECT * FROM ({_SHUF_SQL}) WHERE ord >= {SLICE[0]} AND ord < {SLICE[1]}"


def clean_keys(spark, sf):
    """Narrow rows (doc_id, pos, n_words, order key) of the clean sentences: the
    one pass over the texts."""
    return C.stored_keys(_clean(spark, sf).withColumn("_h", C.order_key(SEED, "doc_id", "pos")), "_h", ["doc_id", "pos"], ["n_words"])


ORDERED_CLEAN_SQL = f"""
SELECT c.*, {D.order_key(SEED, 'doc_id', 'pos')} AS h,
       row_number() OVER (ORDER BY {D.order_key(SEED, 'doc_id', 'pos')}, doc_id, pos) - 1 AS ord
FROM ({CLEAN_SQL}) c"""


def split_by_sizes(spark, sf):
    s = C.shuffled_splits(clean_keys(spark, sf), SPLIT_SIZES, "_h", ["doc_id", "pos"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"),
                                  F.min("ord").alias("min_ord"), F.max("ord").alias("max_ord"),
                                  F.count_distinct("doc_id").alias("n_docs"))


Q["split_by_sizes"] = split_by_sizes
_a, _b, _c = SPLIT_SIZES["train"], SPLIT_SIZES["valid"], SPLIT_SIZES["test"]
SQL["split_by_sizes"] = f"""
SELECT split, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS n_words, min(ord) AS min_ord,
       max(ord) AS max_ord, count(DISTINCT doc_id) AS n_docs
FROM (SELECT *, CASE WHEN ord < {_a} THEN 'train' WHEN ord < {_a + _b} THEN 'valid'
                     WHEN ord < {_a + _b + _c} THEN 'test' END AS split
      FROM ({ORDERED_CLEAN_SQL})) WHERE split IS NOT NULL GROUP BY split"""

CAP = sum(SPLIT_SIZES.values())


def smp_prefix_cap(spark, sf):
    capped = C.ordinal_range(clean_keys(spark, sf), 0, CAP, "_h", ["doc_id", "pos"])
    return capped.select("doc_id", "pos", "ord", "n_words")


Q["smp_prefix_cap"] = smp_prefix_cap
SQL["smp_prefix_cap"] = f"SELECT doc_id, pos, ord, n_words FROM ({ORDERED_CLEAN_SQL}) WHERE ord < {CAP}"


def smp_remainder_bucket(spark, sf):
    both = C.remainder_bands(clean_keys(spark, sf), CAP, ["medium", "long"], BAND_SIZE, "_h", ["doc_id", "pos"])
    return both.select("band", "doc_id", "pos", "ord", "band_ord", "n_words")


Q["smp_remainder_bucket"] = smp_remainder_bucket
SQL["smp_remainder_bucket"] = f"""
SELECT band, doc_id, pos, ord, band_ord, n_words FROM (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY ord) - 1 AS band_ord FROM (
    SELECT *, CASE WHEN n_words > 35 AND n_words < 50 THEN 'medium' END AS band
    FROM ({ORDERED_CLEAN_SQL}) WHERE ord >= {CAP}
    UNION ALL
    SELECT *, CASE WHEN n_words > 65 THEN 'long' END AS band
    FROM ({ORDERED_CLEAN_SQL}) WHERE ord >= {CAP}) WHERE band IS NOT NULL)
WHERE band_ord < {BAND_SIZE}"""


def flt_length_band(spark, sf):
    c = _clean(spark, sf)
    return c.groupBy("lang").agg(
        F.sum(C.length_band(F.col("n_words"), "medium").cast("int")).cast("long").alias("n_medium"),
        F.sum(C.length_band(F.col("n_words"), "long").cast("int")).cast("long").alias("n_long"))


Q["flt_length_band"] = flt_length_band
SQL["flt_length_band"] = f"""
SELECT lang, CAST(sum(CASE WHEN n_words > 35 AND n_words < 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_medium,
       CAST(sum(CASE WHEN n_words > 65 THEN 1 ELSE 0 END) AS BIGINT) AS n_long
FROM ({CLEAN_SQL}) c GROUP BY lang"""


def str_split_period(spark, sf):
    p = C.split_period_sentences(docs(spark, sf), keep=["doc_id", "lang"])
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pieces"),
                                 F.sum(F.length("text")).alias("n_chars"),
                                 F.count_distinct("text").alias("n_distinct"))


Q["str_split_period"] = str_split_period
SQL["str_split_period"] = """
SELECT lang, count(*) AS n_pieces, CAST(sum(length(piece)) AS BIGINT) AS n_chars,
       count(DISTINCT piece) AS n_distinct
FROM (SELECT lang, CASE WHEN u.i < len(parts) THEN u.p || '.' ELSE u.p END AS piece
      FROM (SELECT lang, string_split(text, '. ') AS parts FROM documents) d,
           unnest(parts) WITH ORDINALITY AS u(p, i))
GROUP BY lang"""
