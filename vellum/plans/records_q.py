"""Registered queries of job B (attribute records).

Biography-style nested records are derived from ``customer`` joined to the
fixed-size ``nation`` and ``region`` dimensions: a header/content table with a
name, a birth-date string, a (sometimes multi-valued or marked-up) occupation,
a nationality (missing on every third row) and a segment, plus a tokenized
two-line text. The processing chain then mirrors the reference's biography job.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import records as B
from vellum.plans import duck as D
from vellum.session import stored, table
from vellum.sources import readers as RD

SEED = 2023
ATTRS = ["birth_date", "occupation", "nationality"]
TOP_K = 20
Q: dict = {}
SQL: dict = {}


# ---------------------------------------------------------------- fixture ---
def bio_source(spark, sf):
    c = table(spark, sf, "customer")
    n = F.broadcast(table(spark, sf, "nation"))     # 25 rows at every scale
    r = F.broadcast(table(spark, sf, "region"))     # 5 rows at every scale
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")
    year = (F.lit(1900) + F.pmod(k * 37, F.lit(100))).cast("string")
    m = F.pmod(k, F.lit(5))
    birth = (F.when(m == 0, F.lit("unknown")).when(m == 1, F.concat(F.lit("born "), year))
             .when(m == 2, F.concat(year, F.lit("-"), (year.cast("int") + 1).cast("string")))
             .when(m == 3, F.lit("12345")).otherwise(F.concat(F.lit("march 3 , "), year)))
    seg = F.lower("c_mktsegment")
    reg = F.lower("r_name")
    occ = (F.when(F.pmod(k, F.lit(4)) == 0, F.concat(seg, F.lit(", "), reg))
           .when(F.pmod(k, F.lit(4)) == 1, F.concat(seg, F.lit(" and writer")))
           .when(F.pmod(k, F.lit(4)) == 2, F.concat(seg, F.lit(" -lrb- retired -rrb-")))
           .otherwise(seg))
    occ = F.when(F.pmod(k, F.lit(11)) == 0, F.concat(occ, F.lit(" 2nd"))).otherwise(occ)
    nat = F.lower("n_name")
    name = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")))
    mention = F.when(F.pmod(k, F.lit(8)) == 4, reg).otherwise(seg)
    born = F.when(m == 4, F.concat(F.lit("march 3 , "), year)).otherwise(year)
    natw = F.when(F.pmod(k, F.lit(6)) == 5, F.lit("")).otherwise(F.concat(nat, F.lit(" ")))
    line1 = F.concat(name, F.lit(" -lrb- born "), born, F.lit(" -rrb- is a "), natw, mention,
                     F.lit(" from may ."))
    text = F.concat(line1, F.lit("\n"), F.lit("he worked in "), seg, F.lit(" ."))
    third = F.pmod(k, F.lit(3)) == 0
    header = F.when(third, F.array(*[F.lit(x) for x in ["name", "birth_date", "occupation", "segment"]])) \
        .otherwise(F.array(*[F.lit(x) for x in ["name", "birth_date", "occupation", "nationality", "segment"]]))
    content = F.when(third, F.array(name, birth, occ, seg)).otherwise(F.array(name, birth, occ, nat, seg))
    h1 = F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), k.cast("string"))), 1, 1)
    split = F.when(h1 < "c", "train").when(h1 < "e", "test").otherwise("val")
    return j.select(k.alias("row_id"), split.alias("split"), text.alias("target_text"),
                    F.struct(F.struct(header.alias("column_header"), content.alias("content")).alias("table"))
                    .alias("input_text"))


_K = "c.c_custkey"
_YEAR = f"CAST(1900 + ({_K} * 37) % 100 AS VARCHAR)"
_M = f"({_K} % 5)"
_BIRTH = (f"CASE WHEN {_M} = 0 THEN 'unknown' WHEN {_M} = 1 THEN 'born ' || {_YEAR} "
          f"WHEN {_M} = 2 THEN {_YEAR} || '-' || CAST(CAST({_YEAR} AS INTEGER) + 1 AS VARCHAR) "
          f"WHEN {_M} = 3 THEN '12345' ELSE 'march 3 , ' || {_YEAR} END")
_SEG = "lower(c.c_mktsegment)"
_REG = "lower(r.r_name)"
_OCC0 = (f"CASE WHEN {_K} % 4 = 0 THEN {_SEG} || ', ' || {_REG} WHEN {_K} % 4 = 1 THEN {_SEG} || ' and writer' "
         f"WHEN {_K} % 4 = 2 THEN {_SEG} || ' -lrb- retired -rrb-' ELSE {_SEG} END")
_OCC = f"CASE WHEN {_K} % 11 = 0 THEN ({_OCC0}) || ' 2nd' ELSE {_OCC0} END"
_NAT = "lower(n.n_name)"
_NAME = "lower(replace(c.c_name, '#', ' '))"
_LINE1 = (f"{_NAME} || ' -lrb- born ' || CASE WHEN {_M} = 4 THEN 'march 3 , ' || {_YEAR} ELSE {_YEAR} END "
          f"|| ' -rrb- is a ' || CASE WHEN {_K} % 6 = 5 THEN '' ELSE {_NAT} || ' ' END "
          f"|| CASE WHEN {_K} % 8 = 4 THEN {_REG} ELSE {_SEG} END || ' from may .'")
_H1 = f"substr(md5(concat_ws(':', '{SEED}', CAST({_K} AS VARCHAR))), 1, 1)"
BIO_SQL = f"""
SELECT {_K} AS row_id,
       CASE WHEN {_H1} < 'c' THEN 'train' WHEN {_H1} < 'e' THEN 'test' ELSE 'val' END AS split,
       {_LINE1} || chr(10) || 'he worked in ' || {_SEG} || ' .' AS target_text,
       CASE WHEN {_K} % 3 = 0 THEN ['name', 'birth_date', 'occupation', 'segment']
            ELSE ['name', 'birth_date', 'occupation', 'nationality', 'segment'] END AS hdr,
       CASE WHEN {_K} % 3 = 0 THEN [{_NAME}, {_BIRTH}, {_OCC}, {_SEG}]
            ELSE [{_NAME}, {_BIRTH}, {_OCC}, {_NAT}, {_SEG}] END AS cnt
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


# ------------------------------------------------------------------ chain ---
def s_hub(spark, sf):
    """Split naming of the public copy: ``val`` becomes ``valid``."""
    return RD.rename_hub_splits(bio_source(spark, sf))


S_HUB = f"SELECT row_id, CASE WHEN split = 'val' THEN 'valid' ELSE split END AS split, target_text, hdr, cnt FROM ({BIO_SQL})"

# Place of a row in the union of splits (train, then test, then valid; rows in
# id order inside a split): the first-seen order that breaks count ties.
UNION_ORDER = ["train", "test", "valid"]


def row_place():
    rank = F.when(F.col("split") == UNION_ORDER[0], 0).when(F.col("split") == UNION_ORDER[1], 1).otherwise(2)
    return F.struct(rank.alias("split_rank"), F.col("row_id"))


_RANK_SQL = f"CASE split WHEN '{UNION_ORDER[0]}' THEN 0 WHEN '{UNION_ORDER[1]}' THEN 1 ELSE 2 END"


def s_extract(spark, sf):
    """Rows holding all attributes; attribute columns; nested column dropped;
    ``target_text`` renamed to ``text``."""
    e = B.extract_attributes(s_hub(spark, sf), "input_text.table", ["name"] + ATTRS)
    return e.drop("input_text").withColumnsRenamed({"target_text": "text"})


def _lk(name):
    return f"CASE WHEN list_position(hdr, '{name}') > 0 THEN cnt[list_position(hdr, '{name}')] END"


S_EXTRACT = f"""SELECT row_id, split, target_text AS text, {', '.join(f'{_lk(a)} AS {a}' for a in ['name'] + ATTRS)}
FROM ({S_HUB}) WHERE {' AND '.join(f"list_contains(hdr, '{a}')" for a in ATTRS)}"""


def s_year(spark, sf):
    e = s_extract(spark, sf).withColumn("birth_date", T.extract_year("birth_date"))
    return e.where(F.col("birth_date").isNotNull())


S_YEAR = f"""SELECT * REPLACE (nullif(regexp_extract(birth_date, '\\b(\\d{{4}})\\b', 1), '') AS birth_date)
FROM ({S_EXTRACT}) WHERE nullif(regexp_extract(birth_date, '\\b(\\d{{4}})\\b', 1), '') IS NOT NULL"""


def s_markup(spark, sf):
    return s_year(spark, sf).where(B.occupation_markup_free("occupation"))


S_MARKUP = f"""SELECT * FROM ({S_YEAR}) WHERE NOT contains(occupation, '-lrb-') AND NOT contains(occupation, '-rrb-')
AND NOT regexp_matches(occupation, '[0-9]')"""


def s_pieces(spark, sf):
    s = s_markup(spark, sf)
    pieces = T.split_occupation(F.col("occupation"))
    return s.where(B.any_piece_in(pieces, T.first_line(F.col("text"))))


_PIECES = f"list_transform(string_split_regex(occupation, '; |, |and |/ |&'), lambda p: {D.strip('p')})"
S_PIECES = f"""SELECT * FROM ({S_MARKUP})
WHERE len(list_filter({_PIECES}, lambda p: contains({D.first_line('text')}, p))) > 0"""


def s_first_match(spark, sf):
    s = s_pieces(spark, sf)
    pieces = T.split_occupation(F.col("occupation"))
    return s.withColumn("occupation", B.first_match(pieces, T.first_line(F.col("text"))))


S_FIRST = f"""SELECT * REPLACE (coalesce(list_filter({_PIECES}, lambda p: contains({D.first_line('text')}, p))[1],
                                 {_PIECES}[-1]) AS occupation) FROM ({S_PIECES})"""


def s_nat_line(spark, sf):
    s = s_first_match(spark, sf)
    return s.where(T.first_line(F.col("text")).contains(F.col("nationality")))


S_NAT = f"SELECT * FROM ({S_FIRST}) WHERE contains({D.first_line('text')}, nationality)"


def s_top(spark, sf):
    """Nationality among the 20 most frequent over the union of splits."""
    return B.keep_top_k(s_nat_line(spark, sf), "nationality", TOP_K, first=row_place())


S_TOPLIST = f"""SELECT value, count FROM (
  SELECT nationality AS value, count(*) AS count, min([{_RANK_SQL}, row_id]) AS first
  FROM ({S_NAT}) GROUP BY nationality ORDER BY count DESC, first ASC LIMIT {TOP_K})"""
S_TOP = f"SELECT * FROM ({S_NAT}) WHERE nationality IN (SELECT value FROM ({S_TOPLIST}))"


def s_all_in_text(spark, sf):
    return all_in_text(s_top(spark, sf))


def all_in_text(s):
    line = T.first_line(F.col("text"))
    return s.where(line.contains(F.col("birth_date")) & line.contains(F.col("occupation"))
                   & line.contains(F.col("nationality")))


S_ALL = f"""SELECT * FROM ({S_TOP}) WHERE contains({D.first_line('text')}, birth_date)
AND contains({D.first_line('text')}, occupation) AND contains({D.first_line('text')}, nationality)"""


def ranked_rows(spark, sf):
    """Rows of the biography chain up to the nationality test, written once, and
    the ranked top-20 nationalities (at most 20 strings: a bounded driver value) that
    select among them and are capitalised later."""
    rows = stored(s_nat_line(spark, sf))
    top = B.top_k_values(rows, "nationality", TOP_K, first=row_place())
    return rows, [r["value"] for r in top.collect()]


def s_render(spark, sf):
    rows, ranked = ranked_rows(spark, sf)
    s = all_in_text(rows.where(F.col("nationality").isin(ranked)))
    t = T.untokenize(T.strip(T.first_line(F.col("text"))))
    t = T.capitalize_terms(t, ranked)
    t = T.capitalize_terms(t, T.MONTHS)
    t = T.title_entities(t, F.array("name"))
    return s.withColumn("text", t).drop("name")


def _cap_fold(x, terms_sql):
    return f"list_reduce({terms_sql}, lambda t, w: replace(t, w, upper(w[1]) || lower(w[2:])), {x})"


def _title_sql(x):
    runs = f"regexp_extract_all({x}, '\\pL+|\\PL+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


_UNTOK = (f"replace(replace(replace(replace({D.strip(D.first_line('text'))}, '-lrb- ', '('), ' -rrb-', ')'), "
          f"' ,', ','), ' .', '.')")
_MONTHS = "[" + ", ".join(D.q(m) for m in T.MONTHS) + "]"
_RANKED = f"""(SELECT list(value ORDER BY count DESC, first ASC) FROM (
  SELECT nationality AS value, count(*) AS count, min([{_RANK_SQL}, row_id]) AS first
  FROM ({S_NAT}) GROUP BY nationality ORDER BY count DESC, first ASC LIMIT {TOP_K}))"""
S_RENDER = f"""SELECT * EXCLUDE (name) REPLACE (replace({_cap_fold(_cap_fold(_UNTOK, _RANKED), _MONTHS)}, name, {_title_sql('name')}) AS text)
FROM ({S_ALL})"""


def _stage_summary(df):
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_id"),
                                   *[F.count_distinct(a).alias(f"n_{a}") for a in ATTRS if a in df.columns])


def _stage_summary_sql(src, cols=ATTRS):
    extra = "".join(f", count(DISTINCT {a}) AS n_{a}" for a in cols)
    return f"SELECT split, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS sum_id{extra} FROM ({src}) GROUP BY split"


def src_hub_dataset(spark, sf):
    return s_hub(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_id"))


Q["src_hub_dataset"] = src_hub_dataset
SQL["src_hub_dataset"] = _stage_summary_sql(S_HUB, [])


def agg_header_counts(spark, sf):
    return B.top_k_headers(s_hub(spark, sf), "input_text.table.column_header", TOP_K, first=row_place())


Q["agg_header_counts"] = agg_header_counts
SQL["agg_header_counts"] = f"""SELECT value, count FROM (
  SELECT u.value, count(*) AS count, min([{_RANK_SQL}, row_id, u.pos]) AS first
  FROM ({S_HUB}), unnest(hdr) WITH ORDINALITY AS u(value, pos)
  GROUP BY u.value ORDER BY count DESC, first ASC LIMIT {TOP_K})"""

for _slug, _fn, _sql in [
    ("flt_has_attributes", s_extract, S_EXTRACT),
    ("arr_lookup_by_name", s_extract, S_EXTRACT),
    ("str_extract_year", s_year, S_YEAR),
    ("flt_not_null_year", s_year, S_YEAR),
    ("flt_occupation_markup", s_markup, S_MARKUP),
    ("str_split_multi_sep", s_pieces, S_PIECES),
    ("flt_any_piece_in_first_line", s_pieces, S_PIECES),
    ("flt_value_in_first_line", s_nat_line, S_NAT),
    ("flt_top_k_values", s_top, S_TOP),
    ("semi_top_k", s_top, S_TOP),
    ("flt_all_values_in_text", s_all_in_text, S_ALL),
]:
    Q[_slug] = (lambda f: lambda spark, sf: _stage_summary(f(spark, sf)))(_fn)
    SQL[_slug] = _stage_summary_sql(_sql)


def _with_columns(f):
    """Summary of a stage with the names of its columns."""
    def query(spark, sf):
        df = f(spark, sf)
        return _stage_summary(df).withColumn("columns", F.lit(",".join(sorted(df.columns))))

    return query


def s_drop(spark, sf):
    e = B.extract_attributes(s_hub(spark, sf), "input_text.table", ["name"] + ATTRS)
    return e.drop("input_text")


S_DROP = S_EXTRACT.replace("target_text AS text", "target_text")
# the columns of a stage by rule: what the select lists name
_DROPPED = ",".join(sorted(["row_id", "split", "target_text", "name", *ATTRS]))
_RENAMED = ",".join(sorted(["row_id", "split", "text", "name", *ATTRS]))
Q["drop_columns"] = _with_columns(s_drop)
SQL["drop_columns"] = f"SELECT *, '{_DROPPED}' AS columns FROM ({_stage_summary_sql(S_DROP)})"
Q["rename_columns"] = _with_columns(s_extract)
SQL["rename_columns"] = f"SELECT *, '{_RENAMED}' AS columns FROM ({_stage_summary_sql(S_EXTRACT)})"


def arr_first_match(spark, sf):
    return s_first_match(spark, sf).select("row_id", "split", "occupation")


Q["arr_first_match"] = arr_first_match
SQL["arr_first_match"] = f"SELECT row_id, split, occupation FROM ({S_FIRST})"


def agg_value_counts(spark, sf):
    return B.value_counts(s_nat_line(spark, sf), "nationality")


Q["agg_value_counts"] = agg_value_counts
SQL["agg_value_counts"] = f"SELECT nationality AS value, count(*) AS count FROM ({S_NAT}) GROUP BY nationality"


def topk_most_common(spark, sf):
    return B.top_k_values(s_nat_line(spark, sf), "nationality", TOP_K, first=row_place())


Q["topk_most_common"] = topk_most_common
SQL["topk_most_common"] = S_TOPLIST


def str_render_text(spark, sf):
    return s_render(spark, sf).select("row_id", "split", "text")


Q["map_column"] = str_render_text
SQL["map_column"] = f"SELECT row_id, split, text FROM ({S_RENDER})"


def str_untokenize(spark, sf):
    return s_all_in_text(spark, sf).select("row_id", T.untokenize(T.strip(T.first_line(F.col("text")))).alias("text"))


Q["str_untokenize"] = str_untokenize
SQL["str_untokenize"] = f"SELECT row_id, {_UNTOK} AS text FROM ({S_ALL})"


def str_capitalize_terms(spark, sf):
    rows, ranked = ranked_rows(spark, sf)
    s = all_in_text(rows.where(F.col("nationality").isin(ranked)))
    return s.select("row_id", T.capitalize_terms(T.capitalize_terms(T.first_line(F.col("text")), ranked), T.MONTHS).alias("text"))


Q["str_capitalize_terms"] = str_capitalize_terms
SQL["str_capitalize_terms"] = f"SELECT row_id, {_cap_fold(_cap_fold(D.first_line('text'), _RANKED), _MONTHS)} AS text FROM ({S_ALL})"


def str_title_entities(spark, sf):
    """All entities of a row, in order: the person, then the nationality."""
    s = s_all_in_text(spark, sf)
    return s.select("row_id", T.title_entities(T.first_line(F.col("text")), F.array("name", "nationality")).alias("text"))


Q["str_title_entities"] = str_title_entities
SQL["str_title_entities"] = f"""SELECT row_id, replace(replace({D.first_line('text')}, name, {_title_sql('name')}),
       nationality, {_title_sql('nationality')}) AS text FROM ({S_ALL})"""


def set_union_all(spark, sf):
    """Splits processed apart and concatenated again (union keeps the split
    column, so positional re-splitting is never needed)."""
    s = stored(s_render(spark, sf))   # one run of the chain, whatever the number of splits
    parts = [s.where(F.col("split") == x) for x in ("train", "valid", "test")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_id"))


Q["set_union_all"] = set_union_all
SQL["set_union_all"] = _stage_summary_sql(S_RENDER, [])


def split_preserving(spark, sf):
    """Rows filtered by their contents stay in the split they came from: rows of each
    split before and after, and the smallest and largest row that is left."""
    before = s_hub(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_before"))
    after = s_markup(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_after"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    return before.join(after, "split", "left")


Q["split_preserving"] = split_preserving
SQL["split_preserving"] = f"""SELECT split, n_before, n_after, first_row, last_row
FROM (SELECT split, count(*) AS n_before FROM ({S_HUB}) GROUP BY split)
LEFT JOIN (SELECT split, count(*) AS n_after, min(row_id) AS first_row, max(row_id) AS last_row FROM ({S_MARKUP}) GROUP BY split) USING (split)"""


def agg_distinct_domain(spark, sf):
    s = stored(s_render(spark, sf))   # read once for each attribute
    return s.select(F.lit("occupation").alias("attribute"), F.col("occupation").alias("value")).distinct() \
        .unionByName(s.select(F.lit("nationality").alias("attribute"), F.col("nationality").alias("value")).distinct())


Q["agg_distinct_domain"] = agg_distinct_domain
SQL["agg_distinct_domain"] = f"""SELECT DISTINCT 'occupation' AS attribute, occupation AS value FROM ({S_RENDER})
UNION ALL SELECT DISTINCT 'nationality' AS attribute, nationality AS value FROM ({S_RENDER})"""


Q["distinct"] = agg_distinct_domain
SQL["distinct"] = SQL["agg_distinct_domain"]


# ------------------------------------------------------------- candidates ---
def cand_list_sql(src: str, key: str, col: str, k: int = 10) -> str:
    """Twin of ``candidate_lists``: seeded dense ids of the domain, Floyd draws
    of k ids per row, truth dropped, first k-1 kept, truth prepended."""
    draw = (f"('0x' || substr(md5(concat_ws(':', '{SEED}', '{col}', CAST(s.{key} AS VARCHAR), CAST(j AS VARCHAR))), 1, 15))::BIGINT"
            f" % (j + 1)")
    return f"""
WITH src AS ({src}),
dom AS (SELECT value, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '{col}', value)), value) - 1 AS id
        FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS value FROM src WHERE {col} IS NOT NULL)),
nn AS (SELECT count(*) AS n FROM dom),
kk AS (SELECT CASE WHEN n = 2 THEN 2 ELSE {k} END AS k, n FROM nn),
drawn AS (SELECT s.{key}, CAST(s.{col} AS VARCHAR) AS truth,
          list_reduce(range(kk.n - kk.k, kk.n), lambda acc, j: CASE WHEN list_contains(acc, {draw})
                      THEN list_append(acc, j) ELSE list_append(acc, {draw}) END, []::BIGINT[]) AS ids, kk.k
          FROM src s, kk),
ex AS (SELECT {key}, truth, k, u.id, u.pos FROM drawn, unnest(ids) WITH ORDINALITY AS u(id, pos)),
named AS (SELECT ex.{key}, ex.truth, ex.k, ex.pos, dom.value FROM ex JOIN dom USING (id) WHERE dom.value <> ex.truth)
SELECT {key}, list_prepend(truth, list(value ORDER BY pos)[1:k - 1]) AS cands FROM named GROUP BY {key}, truth, k"""


def cand_list(spark, sf):
    s = stored(s_render(spark, sf))   # read by the domains, the draws and the join back
    s = B.candidate_lists_multi(s, "row_id", ATTRS, SEED)
    return s.select("row_id", "split", *[F.array_join(f"{a}_candidate_list", "|").alias(f"{a}_candidates")
                                         for a in ATTRS])


Q["cand_list"] = cand_list
_CAND_JOIN = " ".join(f"JOIN ({cand_list_sql(S_RENDER, 'row_id', a)}) c_{a} USING (row_id)" for a in ATTRS)
SQL["cand_list"] = f"""SELECT row_id, split, {', '.join(f"array_to_string(c_{a}.cands, '|') AS {a}_candidates" for a in ATTRS)}
FROM ({S_RENDER}) base {_CAND_JOIN}"""
Q["distinct_distractors"] = cand_list
SQL["distinct_distractors"] = SQL["cand_list"]
