"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact.

A document is its set of distinct 4-word shingles, named by 64-bit hashes.
Documents with equal sets are one class; everything below is between classes.

* Shingles are ordered: those that HOT documents or more hold come last (marked
  in a bitmap by ``frequent``), by hash inside. Let x and y be linked and o their
  overlap: o >= a(x) = ceil(0.85 |x|). Of the first |x| - a(x) + T shingles of x at
  least T are shared with y (the same for y, in any order that holds for all), with T
  the smaller of ``votes(|x|)`` and ``votes(|y|)``. So only these prefixes are
  indexed, and linked classes meet in T inverted lists. A shingle in fewer documents
  has a short list, and a common one is in a prefix only where a document has
  hardly anything else, so lists and candidates grow as the corpus does.
* Lists with one class are dropped, then classes with too few lists left.
* Search: a class merges its sorted lists and keeps the classes that occur
  often enough; for two given sizes that is more than T (``least_votes``). Its longest lists, up to T - 1 of them, are not merged; the
  count that is asked for falls by their number, and they are probed by binary
  search in the candidate's sorted prefix. What passes is verified on full sets,
  block against block.
* A list longer than LONG is usually a large group of near copies. Where there is
  one, each class first votes for the fullest class of its longest lists; verified
  votes join such a group. The search then only looks for links between
  different groups: lists of one group drop out, and a class searches only if
  some list of its holds a larger group. Every pair in different groups is
  still found, so no component is lost, and no group is ever paired with itself.

Long lists travel in chunks of bounded size. Broadcasts are left to Spark's
size check.

Nulls: a null text is empty; documents without words have an empty set and are
linked with nothing (component_id is their own doc_id). A null doc_id never
becomes a component's id unless all its documents have none. Rows with the same
doc_id are documents of their own with that id. An empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import blocks, key_and_text, mix, stored, stored_with, text_batches, window_hashes, word_hashes
from vellum.llm.frequent import frequent_bitmap, marked
from vellum.llm.graph import components
from vellum.session import fits_broadcast

SHINGLE = 4
PERCENT = 85
#: Documents with a shingle that comes last in the order.
HOT = 16
#: Lists longer than this are long; chunks of lists have about this many entries.
LONG = 64
#: Classes of a part of a candidate component, whose sets are in memory together with another part's.
BLOCK = 128
#: Longest lists in which a class votes before the search (votes save work, the search alone is complete).
VOTE_LISTS = 8

#: Bytes of a document that leaves or stands repeatedly: id, hash, flag.
NOTABLE_BYTES = 24

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def votes(n):
    """Prefix shingles that linked sets of n (or more) shingles must share."""
    return np.maximum(1, n // 10)


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def least_votes(n, m, percent: int):
    """Shingles that the prefixes of linked sets of n and m must share: their overlap is
    o >= ceil(percent (n + m) / (100 + percent)), so at most n - o of the first one's
    n - a(n) + votes(n) prefix shingles are not shared, and the same for the other; both
    prefixes hold the first shared ones."""
    o = -(-percent * (n + m) // (100 + percent))
    return np.minimum(votes(n) + o - least_overlap(n, percent), votes(m) + o - least_overlap(m, percent))


def _votes_column(n):
    return F.greatest(F.lit(1), F.floor(n / 10)).cast("int")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes([t.translate(_FOLD) for t in texts])
    full = window_hashes(h, width)
    out = []
    for at, end in zip(first[:-1].tolist(), first[1:].tolist()):
        n = end - at
        if n >= width:
            out.append(np.unique(full[at:end - width + 1]))
        elif n:  # a sequence shorter than a shingle is hashed as one, apart from full shingles
            out.append(mix(window_hashes(h[at:end], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """Name of a set: equal sets, equal names (signed 64 bits)."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def measured(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (hash of the text, as Spark's xxhash64), n (set size), cls."""
    def run(batches):
        for ids, texts in blocks(batches):
            sets = shingle_sets(texts, width)
            row = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(row), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) for s in sets], pa.int64())], names=["doc_id", "row", "n", "cls"])

    return docs.mapInArrow(run, "doc_id long, row long, n long, cls long")


def hot_shingles(docs: DataFrame, width: int, n_shingles: int) -> np.ndarray:
    """The bitmap of the shingles of HOT documents or more, copies inside a block
    of documents counted once."""
    def hashes(batches):
        for _, texts in blocks(batches):
            sets = {class_of(s): s for s in shingle_sets(texts, width) if len(s)}
            yield np.concatenate([np.empty(0, np.uint64), *sets.values()])

    return frequent_bitmap(docs, hashes, n_shingles, HOT)


def postings(docs: DataFrame, width: int, percent: int, hot) -> DataFrame:
    """(token, cls) rows of the prefixes, once for a class and block of documents.
    ``hot``: the bitmap of the shingles that come last, broadcast."""
    def run(batches):
        for _, texts in blocks(batches):
            sets = {class_of(s): s for s in shingle_sets(texts, width) if len(s)}
            if sets:
                prefixes = []
                for s in sets.values():
                    last = marked(hot.value, s)
                    prefixes.append(np.concatenate([s[~last], s[last]])[:len(s) - least_overlap(len(s), percent) + int(votes(len(s)))])
                token = np.concatenate(prefixes).view(np.int64)
                cls = np.repeat(np.array(list(sets), np.int64), [len(x) for x in prefixes])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls)], names=["token", "cls"])

    return docs.mapInArrow(run, "token long, cls long")


def shared(rows: DataFrame) -> DataFrame:
    """Distinct (token, cls) rows of tokens that two classes or more have."""
    def run(batches):
        token = cls = None  # the last row waits for the next batch
        passed = False      # whether an earlier row has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if token is not None:
                t, c = np.concatenate(([token], t)), np.concatenate(([cls], c))
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
            t, c = t[new], c[new]
            same = t[1:] == t[:-1]
            hit = np.concatenate(([passed], same)) | np.append(same, False)
            token, cls, passed = t[-1], c[-1], bool(hit[-1])
            hit[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(t[hit]), pa.array(c[hit])], names=["token", "cls"])
        if passed:
            yield pa.RecordBatch.from_arrays([pa.array([token]), pa.array([cls])], names=["token", "cls"])

    return rows.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(run, "token long, cls long")


def members(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rep, cls, n, tokens of the classes that may have links -> the same with
    ``full``, their whole sorted set, from the text of one of their documents. A
    repeated row of that document repeats the class: a link found twice is one."""
    def compress(batches):
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "packed", "n_bytes"])

    texts = docs.mapInArrow(compress, "doc_id long, packed binary, n_bytes long")
    joined = rows.join(texts, F.col("rep").eqNullSafe(F.col("doc_id"))).select("cls", "n", "tokens", "packed", "n_bytes")

    def run(batches):
        for batch in batches:
            cls = batch.column(0).to_pylist()
            packed, sizes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            keep, full = [], []
            for i, (c, p, n) in enumerate(zip(cls, packed, sizes)):
                text = pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True) if n else b""
                s = shingle_sets([text], width)[0]
                if class_of(s) == c:  # another document may have the same id
                    keep.append(i)
                    full.append(s.tobytes())
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(full, pa.binary())], names=["cls", "n", "tokens", "full"])

    return joined.mapInArrow(run, "cls long, n long, tokens array<long>, full binary")


def verified(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v, need, probe) - ``probe`` are lists of u that were not
    merged, of which v must hold ``need`` - links that join the components of all
    linked ones.

    Sets travel once for a block, not once for a pair: the classes of a component
    of the candidate graph are dealt into parts of about BLOCK classes, and where
    two parts have pairs, the classes of these pairs meet. A pair whose classes
    the links of its block already join is not checked."""
    near = components(pairs.select("u", "v")).withColumnRenamed("component", "comp")
    parts = near.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    near = near.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meet = lambda a, b: (F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    null = lambda kind: F.lit(None).cast(kind)
    ends = near.select("node", "comp", "part")
    asked = pairs.join(ends.select(F.col("node").alias("u"), "comp", F.col("part").alias("a")), "u").join(
        ends.select(F.col("node").alias("v"), F.col("part").alias("b")), "v")
    asked = asked.select("comp", *meet(F.col("a"), F.col("b")), F.lit(1).alias("kind"), "u", "v", F.col("need").cast("long").alias("need"), "probe",
                         null("binary").alias("full"))
    where = ["comp", "i", "j"]
    needed = asked.select(*where, "u").union(asked.select(*where, "v")).distinct()
    members = needed.join(index.select(F.col("cls").alias("u"), "tokens", "full"), "u").select(
        *where, F.lit(0).alias("kind"), "u", null("long").alias("v"), null("long").alias("need"), F.col("tokens").alias("probe"), "full")

    def run(batches):
        key, held, parent = None, {}, {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            rows = []
            for comp, i, j, kind, u, v, need, probe, full in zip(*(c.to_pylist() for c in batch.columns)):
                if (comp, i, j) != key:
                    key, held, parent = (comp, i, j), {}, {}
                if kind == 0:
                    held[u] = probe, np.frombuffer(full, np.uint64)
                    continue
                if find(u) == find(v):
                    continue
                (_, a), (tokens, b) = held[u], held[v]
                if need > 0 and _common(np.array(probe, np.int64), np.sort(np.array(tokens, np.int64))) < need:
                    continue
                if len(a) > len(b):
                    a, b = b, a
                both = _common(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[find(u)] = find(v)
                    rows.append((u, v))
            rows = np.array(rows, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    met = members.union(asked).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "kind")
    return met.mapInArrow(run, "u long, v long")


def _common(probes: np.ndarray, ordered: np.ndarray) -> int:
    """How many of the probes a binary search finds."""
    if not len(ordered) or not len(probes):
        return 0
    at = np.minimum(np.searchsorted(ordered, probes), len(ordered) - 1)
    return int((ordered[at] == probes).sum())


def voted(entries: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Verified links between each class and the fullest class of its longest
    lists. entries: (token, cls, df) of long lists."""
    ranked = entries.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token")), asc=False).alias("lists"))
    weighed = ranked.select("cls", F.size("lists").alias("w"), F.explode(F.slice("lists", 1, VOTE_LISTS)).alias("l")).select(
        "cls", "w", F.col("l.token").alias("token"))
    lead = weighed.groupBy("token").agg(F.max(F.struct("w", "cls")).alias("lead"))
    ballots = weighed.join(lead, "token").where("cls <> lead.cls").groupBy("cls", F.col("lead.cls").alias("v")).agg(F.count("*").alias("hits"))
    best = ballots.groupBy("cls").agg(F.max(F.struct("hits", "v")).alias("b"))
    pairs = best.select(F.col("cls").alias("u"), F.col("b.v").alias("v"), F.lit(0).alias("need"), F.array().cast("array<long>").alias("probe"))
    return verified(stored(pairs), index, percent)


def _field(name: str):
    return lambda entry: entry[name]


def mixed_lists(entries: DataFrame) -> DataFrame:
    """entries (token, cls, n, df, grp) of the lists that hold two groups or more, with
    ``top``, the list's largest group."""
    sizes = entries.groupBy("token", "grp").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("k", "grp")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    return entries.join(lists.select("token", F.col("top.grp").alias("top")), "token").select("token", "cls", "n", "df", "grp", "top")


def searched(placed: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between different groups by T-occurrence search among ``mixed_lists``."""
    chunks = F.ceil(F.col("df") / LONG).cast("int")
    parts = placed.groupBy("token", F.pmod(F.xxhash64("cls"), chunks).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("cls", F.col("n").cast("int").alias("n"), "grp"))).alias("entries"))
    # arrays of numbers travel lighter than an array of structs
    parts = parts.select("token", *[F.transform("entries", _field(c)).alias(f"y_{c}") for c in ("cls", "n", "grp")])
    # of the long lists of a class the longest, up to T - 1, are left for probing
    mine = placed.groupBy("cls", "n", "grp").agg(
        F.sort_array(F.collect_list(F.struct("df", "token")), asc=False).alias("lists"),
        F.max(F.col("grp") != F.col("top")).alias("asks")).where("asks")
    need = _votes_column(F.ceil(F.col("n") * percent / 100))
    n_long = F.size(F.filter("lists", lambda x: x["df"] > LONG))
    mine = mine.withColumn("t", need).withColumn("skip", F.least(n_long, F.col("t") - 1)).where(F.size("lists") >= F.col("t"))
    probes = mine.select(F.col("cls").alias("u"), F.transform(F.slice("lists", F.lit(1), F.col("skip")), lambda s: s["token"]).alias("probe"))
    queries = mine.select(F.col("cls").alias("x"), F.col("grp").alias("x_grp"), F.col("n").alias("x_n"), "skip",
                          F.explode(F.expr("slice(lists, skip + 1, size(lists) - skip)")).alias("list"))
    found = queries.select("x", "x_grp", "x_n", "skip", F.col("list.token").alias("token")).join(parts, "token")

    def run(batches):
        held = None  # the lists of the last class wait for the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            x = rows[0].column(0).to_numpy()
            open_ = int(np.searchsorted(x, x[-1]))
            held = rows[0].slice(open_)
            if open_:
                yield merge(rows[0].slice(0, open_))
        if held is not None:
            yield merge(held)

    def merge(rows):
        """Merges the sorted lists of each class (a stable sort merges runs) and
        keeps the classes that occur often enough in them."""
        x, grp, n, skip = (rows.column(i).to_numpy() for i in range(4))
        y, m, g = (rows.column(i).flatten().to_numpy() for i in (4, 5, 6))
        of = np.repeat(np.arange(len(x)), pc.list_value_length(rows.column(4)).to_numpy())
        other = g != grp[of]
        y, m, of = y[other], m[other].astype(np.int64), of[other]
        order = np.lexsort((y, x[of]))
        y, m, of = y[order], m[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (y[1:] != y[:-1]) | (x[of[1:]] != x[of[:-1]])))) if len(y) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(y)))
        y, m, of = y[first], m[first], of[first]
        t = least_votes(n[of], m, percent)
        ok = (count + skip[of] >= t) & (percent * np.maximum(n[of], m) <= 100 * np.minimum(n[of], m))
        return pa.RecordBatch.from_arrays([pa.array(x[of][ok]), pa.array(y[ok]), pa.array(np.maximum(0, t - count)[ok].astype(np.int64))],
                                          names=["u", "v", "need"])

    sorted_rows = found.select("x", "x_grp", "x_n", "skip", "y_cls", "y_n", "y_grp").repartition("x").sortWithinPartitions("x")
    pairs = sorted_rows.mapInArrow(run, "u long, v long, need long")
    # a pair that both sides found is one pair
    once = pairs.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min(F.struct("need", "u", "v")).alias("p"))
    return once.select("p.u", "p.v", "p.need").join(probes, "u")


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, n, cls of every document, and cls, rep (smallest doc_id),
    component (the group's internal name) of every class with words."""
    named = key_and_text(docs, id_col, text_col)
    with text_batches(docs.sparkSession):  # a few bytes a document: in files of some MB, not in one for each task that read texts
        rows, total = stored_with(measured(named, width).hint("rebalance"), n=F.sum("n"))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))

    least = _votes_column(F.ceil(F.col("n") * percent / 100))
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(named, width, total["n"] or 0))
    kept = shared(postings(named, width, percent, hot)).groupBy("cls").agg(F.collect_list("token").alias("tokens"))
    kept = kept.join(classes, "cls").where(F.size("tokens") >= least)
    index = stored(members(kept, named, width))
    hot.destroy()  # only the stored index used it; a session that joins often would keep every bitmap

    entries = index.select("cls", "n", "tokens").dropDuplicates(["cls"]).select("cls", "n", F.explode("tokens").alias("token"))
    counted = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    entries, lists = stored_with(entries.join(counted, "token"), longest=F.max("df"))
    links = None
    if (lists["longest"] or 0) > LONG:  # else there is nothing to vote on, and each class is its own group
        links = stored(voted(entries.where(F.col("df") > LONG).select("token", "cls", "df"), index, percent))
        joined = components(links)
        known = index.select("cls").distinct()
        groups = stored(known.join(joined, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("grp")))
        placed = entries.join(groups, "cls")
    else:
        placed = entries.withColumn("grp", F.col("cls"))
    found = verified(stored(searched(stored(mixed_lists(placed)), percent)), index, percent)
    joined = components(stored(found if links is None else links.union(found)))
    return rows, classes.join(joined, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; also row (hash of
    its text) and component (the group's internal name, null without words)."""
    rows, named_class = grouped(docs, id_col, text_col, width, percent)
    smallest = named_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named_class.join(smallest, "component").select("cls", "component", "component_id")
    result = rows.select("doc_id", "row", "n", "cls").join(final, "cls", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         "row", F.when(F.col("n") > 0, F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """``docs`` with all columns, without the documents that are linked with a
    kept one: of a component the one with the smallest doc_id stays (nulls last,
    then by hash of the text), once. Documents without words all stay."""
    rows, named_class = grouped(docs, id_col, text_col, **join)
    rows = rows.where("n > 0").select("doc_id", "row", "cls").join(named_class.select("cls", "component"), "cls").drop("cls")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    judged = rows.groupBy("component", "doc_id", "row").agg(F.count("*").alias("copies")).join(best, "component")
    leaves = ~rank.eqNullSafe(F.col("best"))
    notable, held = stored_with(judged.where(leaves | (F.col("copies") > 1)).select("doc_id", "row", leaves.alias("leaves")), n=F.count(F.lit(1)))
    if fits_broadcast(held["n"], NOTABLE_BYTES):  # then the texts stay where they are
        notable = F.broadcast(notable)
    text = F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit(""))
    joined = docs.alias("d").join(notable.alias("s"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.doc_id")) & (
        F.xxhash64(text) == F.col("s.row")), "left")
    columns = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    once = joined.where("s.leaves is null").select(*columns)
    # repeated rows of a kept document: one of them
    again = joined.where("not s.leaves").select(F.struct(*columns).alias("d"), F.col("s.doc_id").alias("i"), F.col("s.row").alias("r"))
    again = again.groupBy("i", "r").agg(F.first("d").alias("d")).select("d.*")
    return once.union(again)
