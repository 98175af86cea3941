"""The operators of this subpackage bound to the driver's tables: one query
``opN_<name>`` each, with production parameters, over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import centroids, html_text, jaccard_join, licences, mixing, mtree, nn_descent, packing, phrases, quality, recompression, sanitise, suffix_array
from vellum.session import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, column = quality.quality(docs, PIECE_MODEL, BYTE_RANKS, PATTERN, keep=["doc_id"])
    fields = ("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept out_of_band piece_cpt byte_cpt "
              "byte_share entropy").split()
    return judged.select("doc_id", *[F.col(f"{column}.{f}").alias(f) for f in fields])


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(table(spark, sf_dir, "documents"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_documents(table(spark, sf_dir, "documents"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER, PATTERN, added=True)


def op10_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op11_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"))


def op12_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


Q = {f.__name__: f for f in (op1_suffix_array, op2_disclosure, op3_nn_descent, op4_tokeniser_fertility, op5_main_text, op6_licence_automaton, op7_recompression, op8_curriculum_mix,
                             op9_retrieval_packing, op10_divide_skip, op11_mtree, op12_zone_maps, op13_misra_gries)}

def _kmeans_sql(rounds: int) -> str:
    """The rounds written out, one pair of tables each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, vec_id, x, num, d
  FROM (SELECT p.row, p.vec_id, p.x, c.num,
               list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS d
        FROM points p, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, num) = 1)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.num, coalesce(m.x, c.x) AS x
  FROM c{r} c LEFT JOIN (
    SELECT num, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x
    FROM (SELECT num, i, sum(CAST(v AS BIGINT)) AS s, count(*) AS n
          FROM (SELECT num, unnest(x) AS v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY num, i)
    GROUP BY num) m USING (num))""")
    last = f"a{rounds}"
    return """
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS num, x
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM points WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40)),""" + ",".join(steps) + f"""
SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(CAST(d AS BIGINT)) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(CAST(d AS BIGINT)) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} c USING (num)"""


SQL = {
    "op10_divide_skip": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.v), d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN reach r ON d.doc_id = r.u GROUP BY d.doc_id""",
    "op7_recompression": r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.i) AS t, count(*) AS n
  FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i WHERE g.i IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_curriculum_mix": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
ranked AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][rnk % 3 + 1] AS DOUBLE) AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firstfit AS (
  SELECT sum(source_size) - sum(CASE WHEN cap / w < f.r THEN cap ELSE 0 END) AS num,
         sum(CASE WHEN cap / w < f.r THEN 0 ELSE w END) AS den, any_value(f.r) AS r
  FROM weighted, (SELECT min(cap / w) AS r FROM levels WHERE level * w <= cap) f),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST([0.5, 0.0, -0.5][rnk % 3 + 1] AS DOUBLE) AS slope,
         CASE WHEN cap / w < r THEN CAST(cap AS DOUBLE) ELSE w * CAST(num AS DOUBLE) / den END AS target
  FROM weighted, firstfit),
placed AS (
  SELECT s.*, t.source_size, t.target, t.slope, round(t.target) AS words,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN start / target
            ELSE (1 + slope - sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * (start / target), 0))) / (2 * slope) END AS first_position
FROM (
  SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, slope, CAST(start AS DOUBLE) AS start,
         CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size))
              + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) AS taken
  FROM placed)""",
    "op11_mtree": r"""
WITH points AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM points q JOIN points c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
    "op12_zone_maps": _kmeans_sql(centroids.ROUNDS),
    "op13_misra_gries": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
known AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM words, (VALUES (1), (2), (3), (4)) t(size)))
  GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN known h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN known t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase
        FROM (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates)))
  GROUP BY lang, phrase),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(l.phrase)) AS rank
  FROM lowest l LEFT JOIN parts p ON p.lang = l.lang AND p.phrase = l.phrase
  WHERE p.longer IS NULL OR 100 * CAST(p.longer AS HUGEINT) < 80 * CAST(l.a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
