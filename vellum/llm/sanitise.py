"""Personal data and information-theoretic sanitisation, in DataFrame
expressions only.

Base spans are the values of four kinds of personal data: leftmost, non
overlapping matches of a pattern, of which those that fail a check are dropped.
The patterns are written so that Java's matcher neither recurses nor rescans a
long run; the tests compare them with the plain patterns.

Every value found is a protected entity e. A term t (run of letters and digits,
lower-cased) of any document that holds it, however far from it, discloses it by
their pointwise mutual information over the documents of the corpus,

    PMI(t, e) = log2( N * n(t, e) / (n(t) * n(e)) ),

n counting documents, relative to all there is to disclose, IC(e) = log2(N / n(e)).
Where PMI reaches ``threshold`` of IC, knowing the term all but tells the
entity, and every place of the term in every document that holds the entity is a
span of its own (kind ``term``). One co-occurrence is no evidence - any rare word of
the only document of an entity would be telling - so a pair needs two different
texts. Terms that many documents use say little and stay. A document without a
protected entity has no such term and is left alone.

Pairs of a document are not enumerated entity by entity and term by term: entities
held by the same documents are one class (their counts are equal), and so are terms
with equal n(t) in the same documents that hold entities. A list of ten thousand
addresses in two copies is one class of entities. Of the classes only pairs with
n(t) <= N^(1-threshold) * n(e)^threshold can reach the threshold (n(t, e) is at most
n(e)), so frequent terms meet only frequent entities.

The texts are matched once; rows with a match are stored where they are and the rest
reads these. Texts travel twice at most: those rows to the list of documents that hold an
entity of two documents or more, and of these the ones that have a telling term. Positions come from the pieces between matches and a running sum over the
matches of a document. Counts are pre-aggregated before their shuffle. Entities and
terms are keys only of counts and of joins against counts; a hot one is split by
Spark's skew join.

Nulls: a null text is the empty text, without spans. A row is identified by its
doc_id (null included) and its text (a 64-bit hash): repeated rows have the same
spans and count as one document for n(e) and n(t, e). An entity that all documents hold
(IC = 0) has no terms. An empty table gives an empty result. Only the two named
columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import stored

#: Kinds in their order, with patterns equal to the plain ones for leftmost non-overlapping search.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))
TERM = "term"
NAMES = [k for k, *_ in KINDS] + [TERM]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

WORD = r"[\p{L}\p{N}]+"
THRESHOLD = 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def luhn(number: Column, most: int = 19) -> Column:
    """Whether a string of at most ``most`` digits passes the Luhn check."""
    back = F.reverse(number)

    def add(i: int) -> Column:
        d = F.coalesce(F.substring(back, i + 1, 1).try_cast("int"), F.lit(0))
        return d if i % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0)

    return reduce(lambda a, b: a + b, [add(i) for i in range(most)]) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    number = digits(value)
    n = F.length(number)
    return (F.when(kind == 1, value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == 2, n.between(12, 19) & luhn(number))
            .when(kind == 3, n.between(9, 15)).otherwise(True))


def entity(kind: Column, value: Column) -> Column:
    """The value in normal form, with its kind."""
    plain = F.when(kind.isin(2, 3), digits(value)).otherwise(F.lower(value))
    return F.concat(kind.cast("string"), F.lit(":"), plain)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def held_documents(rows: DataFrame) -> DataFrame:
    """Rows with a match of a pattern: doc_id, row, text and ``matched``, for each kind
    with a match its index, the matches and the code points before each of them."""
    def of(i: int, pattern: str, sign: str | None) -> Column:
        text = F.col("text")
        might = F.contains(text, F.lit(sign)) if sign else F.lit(True)
        found = F.when(might, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.struct(F.lit(i).alias("kind"), found.alias("found"))

    matched = F.filter(F.array(*[of(i, p, s) for i, (_, p, s) in enumerate(KINDS)]), lambda k: F.size(k["found"]) > 0)
    # behind a generator the filter cannot be pushed below the matching, which would then run twice
    held = rows.select("*", F.explode(F.array(matched)).alias("matched")).where(F.size("matched") > 0)

    def placed(k: Column) -> Column:
        pieces = reduce(lambda rest, i: F.when(k["kind"] == i, F.split("text", F.lit(KINDS[i][1]), -1)).otherwise(rest), range(len(KINDS)), F.lit(None))
        return F.struct(k["kind"].alias("kind"), k["found"].alias("found"), F.transform(pieces, F.length).alias("gaps"))

    return held.select("doc_id", "row", "text", F.transform("matched", placed).alias("matched"))


def base_matches(held: DataFrame) -> DataFrame:
    """doc_id, row, kind (index), start, end, value of the matches that pass their
    check, repeated rows once."""
    once = held.select("doc_id", "row", "matched").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.explode("matched").alias("k"))
    each = once.select("doc_id", "row", "k.kind", "k.found", "k.gaps").select("doc_id", "row", "kind", F.posexplode(F.arrays_zip(
        "found", F.slice("gaps", F.lit(1), F.size("found")).alias("gap"))).alias("i", "m"))
    upto = W.partitionBy("doc_id", "row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.found")).over(upto)
    placed = each.withColumn("end", end).withColumn("value", F.col("m.found")).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(valid(F.col("kind"), F.col("value"))).select("doc_id", "row", "kind", "start", "end", "value")


def terms_of(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lower)


def same_documents(pairs: DataFrame, item: str) -> DataFrame:
    """(item, n, held_by): documents of each item, and a hash of their set."""
    return pairs.groupBy(item).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "row")).alias("a"),
                                   F.bit_xor(F.xxhash64("row", "id", F.lit(1))).alias("b")).select(
        item, "n", F.xxhash64("n", "a", "b").alias("held_by"))


def disclosing(rows: DataFrame, held: DataFrame, matches: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """doc_id, row, start, end of the terms that disclose an entity of their document.
    ``held`` are the rows that may hold one (doc_id, row, text)."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    owners = matches.select(named, "row", entity(F.col("kind"), F.col("value")).alias("entity")).distinct()
    entities = same_documents(owners, "entity").where("n > 1").select("entity", F.col("held_by").alias("e"), F.col("n").alias("n_entity"))
    by_entity = owners.join(entities, "entity").select("id", "row", "e", "n_entity").distinct()

    texts = held.select(named, "row", "text").join(by_entity.select("id", "row").distinct(), ["id", "row"], "left_semi")
    texts = stored(texts.dropDuplicates(["id", "row"]))
    inside = texts.select("id", "row", F.explode(F.array_distinct(terms_of("text"))).alias("term"))
    words = rows.select(F.explode(F.array_distinct(terms_of("text"))).alias("word"))
    n_term = words.groupBy(F.xxhash64("word").alias("term_hash")).agg(F.count("*").alias("n_term"))
    terms = same_documents(inside, "term").where("n > 1").withColumn("term_hash", F.xxhash64("term")).join(n_term, "term_hash")
    terms = terms.select("term", "n_term", F.xxhash64("held_by", "n_term").alias("t"))
    by_term = stored(inside.join(terms, "term"))

    n = F.lit(float(n_docs))
    content = F.log2(n / F.col("n_entity"))
    possible = F.log2(n / F.col("n_term")) >= threshold * content - 1e-9
    pairs = by_entity.join(by_term.select("id", "row", "t", "n_term").distinct(), ["id", "row"]).where((content > 0) & possible)
    known = pairs.groupBy("e", "t", "n_entity", "n_term").agg(F.count("*").alias("n_both"), F.min("row").alias("one"), F.max("row").alias("other"))
    pmi = F.log2(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    telling = known.where((F.col("one") < F.col("other")) & (pmi >= threshold * content)).select("e", "t")
    hits = pairs.join(telling, ["e", "t"]).select("id", "row", "t").distinct()
    chosen = stored(by_term.join(hits, ["id", "row", "t"]).select("id", "row", "term"))

    texts = texts.join(chosen.select("id", "row").distinct(), ["id", "row"], "left_semi")
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    zipped = F.arrays_zip(found.alias("word"), F.transform(F.split("text", WORD, -1), F.length).alias("gap"))
    each = texts.select("id", "row", F.posexplode(zipped).alias("i", "m"))
    upto = W.partitionBy("id", "row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.coalesce(F.length("m.word"), F.lit(0))).over(upto)).select(
        "id", "row", F.lower("m.word").alias("term"), (F.col("end") - F.length("m.word")).alias("start"), "end")
    return each.join(chosen, ["id", "row", "term"]).select(F.col("id").try_cast("long").alias("doc_id"), "row", "start", "end")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, kind (index into NAMES), start, end of all spans."""
    rows = identified(docs, id_col, text_col)
    held = stored(held_documents(rows))
    matches = stored(base_matches(held))
    base = matches.select("doc_id", "row", "kind", "start", "end")
    terms = disclosing(rows, held.select("doc_id", "row", "text"), matches, docs.count(), threshold)
    terms = terms.select("doc_id", "row", F.lit(len(KINDS)).alias("kind"), "start", "end")
    # terms that overlap a base span are part of it
    order = W.partitionBy("doc_id", "row").orderBy("start", "kind")
    is_base = F.col("kind") < len(KINDS)
    earlier = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    later = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    spans = base.union(terms).select("*", earlier.alias("earlier"), later.alias("later"))
    overlaps = (F.coalesce("earlier", F.lit(0)) > F.col("start")) | (F.coalesce("later", F.col("end")) < F.col("end"))
    return spans.where(is_base | ~overlaps).drop("earlier", "later")


def _text(spans: Column) -> Column:
    name = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    spans = find_spans(docs, id_col, text_col, threshold).groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = identified(docs, id_col, text_col).select("doc_id", "row")
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.row") == F.col("s.row")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(every, lambda s: s["kind"] < len(KINDS))

    def count(i: int) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == i)).cast("long")

    return joined.select(F.col("d.doc_id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)],
                         F.sha2(_text(base), 256).alias("base_sha256"), _text(every).alias("spans"), count(len(KINDS)).alias("n_term"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all columns and rows; in the text every base span is
    generalised to its kind in brackets and every disclosing term to [term].
    Spans that overlap are replaced together, under the name of the first."""
    order = W.partitionBy("doc_id", "row").orderBy("start", "kind")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = find_spans(docs, id_col, text_col, threshold).withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order))
    islands = spans.groupBy("doc_id", "row", "island").agg(F.min(F.struct("start", "kind")).alias("f"), F.max("end").alias("end"))
    name = F.array(*[F.lit(f"[{n}]") for n in NAMES])
    cuts = islands.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(
        F.struct(F.col("f.start").alias("start"), "end", F.element_at(name, F.col("f.kind") + 1).alias("name")))).alias("cuts"))
    text = F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit(""))
    joined = docs.alias("d").join(cuts.alias("s"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.doc_id")) & (
        F.xxhash64(text) == F.col("s.row")), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("s.cuts", lambda c: c["end"]))
    parts = F.zip_with(F.slice(starts, F.lit(1), F.size("s.cuts")), F.col("s.cuts"), lambda at, c: F.concat(
        F.substring(text, (at + 1).cast("int"), (c["start"] - at).cast("int")), c["name"]))
    rest = F.substring(text, (F.element_at(starts, -1) + 1).cast("int"), F.length(text))
    clean = F.when(F.col("s.cuts").isNull(), F.col(f"d.`{text_col}`").cast("string")).otherwise(F.concat(F.array_join(parts, ""), rest))
    return joined.select(*[(clean if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
