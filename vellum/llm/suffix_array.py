"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimisers: positions whose K-word hash is the
smallest of some WINDOW consecutive positions. The choice depends on content
alone, so a passage keeps the same positions wherever it stands, and every
stretch of WINDOW + K - 1 words keeps one. A repeat of ``least`` words therefore
holds a kept suffix near its start, with at least HEAD words of the repeat after
it.

1. Suffixes whose first HEAD words occur once in the corpus are dropped. A block
   of documents counts its own occurrences first, so a passage that a third of
   the documents share costs one row for each block.
2. The rest form the sparse suffix array, in order of their heads. A repeat of
   ``least`` words around a head is a run of so many words before and behind it, and
   there are ``least`` - HEAD + 1 such windows: suffixes of one head that have one of them
   in common repeat it, whatever else lies between them in any order. Heads of up to
   MOST suffixes are compared in memory; the windows of any other are dealt out by
   their own hashes and compared as they pass by, equal surroundings once.
3. The matches of a document are united into maximal passages.

Documents that are equal as a whole are named by their words once and only the
first goes on; the others are repeats as a whole.

Nulls: a null text has no words and no repeat. Null ids take part, as the last
in order. Rows with the same doc_id are one document whose texts lie apart;
equal rows of one doc_id repeat nothing. Repeats inside one document count like
those between documents. An empty table gives an empty result. Only the two
named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import blocks, key_and_text, mix, stored, window_hashes, word_hashes
from vellum.llm.recompression import LAST, first_of_blocks, record_batch, shared_keys, text_parts, word_lists

K = 8
WINDOW = 25
HEAD = 25
LEAST = 50
#: Suffixes compared in memory; a head that has more is compared by its windows.
MOST = 1 << 15

SUFFIXES = "head long, doc long, at int, right binary, left binary"
MATCHES = "doc long, start int, stop int, other long"
WINDOWS = f"key long, {MATCHES}"

#: Factors of the words on both sides of a head in the hash of a window.
_FACTORS = np.random.default_rng(21).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimisers(h: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Kept positions of documents laid one after the other (document d is
    h[first[d]:first[d + 1]]) that have HEAD words to go in their document, of
    documents with ``least`` words."""
    grams = mix(window_hashes(h, K))
    if len(grams) < WINDOW:
        return np.empty(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    start = np.arange(len(best))
    stop = first[np.searchsorted(first, start, side="right")]  # end of the document of each position
    at = np.unique((start + best)[start + WINDOW + K - 1 <= stop])
    owner = np.searchsorted(first, at, side="right")
    return at[(at + HEAD <= first[owner]) & (first[owner] - first[owner - 1] >= least)]


def heads(docs: DataFrame, least: int) -> DataFrame:
    """Head of every kept suffix, once for each block with the documents that have it."""
    def run(batches):
        for ids, texts in blocks(batches):
            h, first = word_hashes(texts)
            at = minimisers(h, first, least)
            if len(at):
                owner = np.array([LAST if i is None else i for i in ids], np.int64)[np.searchsorted(first, at, side="right") - 1]
                yield first_of_blocks(window_hashes(h, HEAD)[at], owner)

    return docs.mapInArrow(run, "key long, doc long, more binary")


def copies(docs: DataFrame, least: int) -> DataFrame:
    """(doc, copies): of documents equal as a whole to another, struct (root, other, n)."""
    def run(batches):
        for ids, texts in blocks(batches):
            rows = [(LAST if i is None else i, xxhash.xxh3_128_digest(b" ".join(w)), len(w))
                    for i, w in zip(ids, (t.split() for t in texts)) if len(w) >= least]
            if rows:
                yield record_batch(list(zip(*rows)), "doc long, root binary, n int")

    # a few bytes a document: in files of some MB, not in one for each task that read texts
    named = stored(docs.mapInArrow(run, "doc long, root binary, n int").hint("rebalance"))
    ends = named.groupBy("root").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    other = F.when(F.col("doc") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    return named.join(ends, "root").groupBy("doc").agg(F.collect_set(F.struct("root", other.alias("other"), "n")).alias("copies"))


def suffixes(joined: DataFrame, least: int) -> DataFrame:
    """Kept suffixes with a shared head, and the words on both sides that can
    decide a repeat: ``least`` - HEAD of them after the head, as many before."""
    side = least - HEAD

    def run(batches):
        for batch in text_parts(batches):
            names = batch.schema.names
            c = {n: batch.column(names.index(n)).to_pylist() for n in ("doc", "words", "n_bytes", "keys", "copies")}
            docs, owner, shared = [], [], []
            for doc, packed, n, keys, same in zip(*c.values()):
                if not keys:
                    continue
                text = pa.decompress(packed, decompressed_size=n, codec="zstd", asbytes=True) if n else b""
                root = xxhash.xxh3_128_digest(text)
                if any(s["root"] == root and s["other"] < doc for s in same or ()):
                    continue  # the first of its copies stands for it
                docs.append(text)
                owner.append(doc)
                shared.append(np.array(keys, np.int64))
            if not docs:
                continue
            h, first = word_hashes(docs)
            at = minimisers(h, first, least)
            head = window_hashes(h, HEAD)[at].view(np.int64)
            hit = np.isin(head, np.concatenate(shared))
            at, head = at[hit], head[hit]
            if not len(at):
                continue
            d = np.searchsorted(first, at, side="right") - 1
            # words beyond a document's ends never match: they are numbered apart
            word = (h >> np.uint64(32)).astype(np.uint32)
            fence = mix(np.array(owner, np.int64).view(np.uint64) + np.uint64(0x51)).astype(np.uint32)
            around = np.arange(side)
            r, l = at[:, None] + HEAD + around, at[:, None] - 1 - around
            n = max(len(h) - 1, 0)
            right = np.where(r < first[d + 1][:, None], word[np.minimum(r, n)], fence[d][:, None] + r.astype(np.uint32))
            left = np.where(l >= first[d][:, None], word[np.maximum(l, 0)], ~fence[d][:, None] - l.astype(np.uint32))
            right, left = right.astype(">u4"), left.astype("<u4")
            yield record_batch([head, np.array(owner, np.int64)[d], (at - first[d]).astype(np.int32),
                                [x.tobytes() for x in right], [x.tobytes() for x in left]], SUFFIXES)

    return joined.where("keys is not null").mapInArrow(run, SUFFIXES)


def partners(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of key, doc and start: whether another (doc, start) has the
    key, and the smallest doc of the others that have it."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(first, append=len(key))
    of = np.repeat(first, count)
    mine = (doc == doc[of]) & (start == start[of])  # the smallest, and rows equal to it
    second = first + np.add.reduceat(mine, first, dtype=np.int64)
    shared = np.repeat(second < first + count, count)
    return shared, np.where(mine, np.repeat(doc[np.minimum(second, len(doc) - 1)], count), doc[of])


def window_keys(head: np.ndarray, right: np.ndarray, left: np.ndarray):
    """Hashes of the windows of each suffix: (words before the head, hashes)."""
    side = right.shape[1]

    def sums(words, factors):
        out = np.zeros((side + 1, len(words)), np.uint64)
        np.cumsum(words.T.astype(np.uint64) * factors[:side, None], axis=0, out=out[1:])
        return out

    behind, before, base = sums(right, _FACTORS), sums(left, _FACTORS[len(_FACTORS) // 2:]), mix(head.view(np.uint64))
    for n in range(side + 1):
        yield n, mix(base + behind[side - n] + before[n] + np.uint64(n)).view(np.int64)


def found_repeats(rows: DataFrame, least: int) -> DataFrame:
    """WINDOWS: MATCHES without a key, one for each suffix that repeats something, and
    the windows of heads with more than MOST suffixes, still to be compared."""
    side = least - HEAD

    def columns(table):
        head, doc, at = (table.column(c).to_numpy() for c in ("head", "doc", "at"))
        right = np.frombuffer(b"".join(table.column("right").to_pylist()), ">u4").reshape(len(head), side)
        left = np.frombuffer(b"".join(table.column("left").to_pylist()), "<u4").reshape(len(head), side)
        return head, doc, at.astype(np.int64), right, left

    def compared(table):
        head, doc, at, right, left = columns(table)
        order = np.lexsort((at, doc))
        head, doc, at, right, left = (x[order] for x in (head, doc, at, right, left))
        most, fewest = np.full(len(doc), -1), np.full(len(doc), side + 1)
        other = np.full(len(doc), np.iinfo(np.int64).max)
        for n, key in window_keys(head, right, left):
            order = np.argsort(key, kind="stable")
            shared, smallest = partners(key[order], doc[order], at[order])
            hit = order[shared]
            most[hit], fewest[hit] = n, np.minimum(fewest[hit], n)
            other[hit] = np.minimum(other[hit], smallest[shared])
        hit = most >= 0
        # all windows of a suffix hold its head, so together they are one passage
        start, stop = (at - most).astype(np.int32)[hit], (at - fewest + least).astype(np.int32)[hit]
        return record_batch([[None] * len(start), doc[hit], start, stop, other[hit]], WINDOWS)

    def windows(table, before, ends):
        """Rows of a head with more than MOST: suffixes with equal words on both sides
        repeat each other whole, and the first of them asks for its windows, those that
        the words after the head can share with the next suffix in order. ``before``: words
        shared with the row before, whether equal to it, the first doc of its equals."""
        head, doc, at, right, left = columns(table)
        ahead = np.cumprod(right[1:] == right[:-1], axis=1).sum(axis=1)
        equal = (ahead == side) & (left[1:] == left[:-1]).all(axis=1)
        copy = np.concatenate(([before[1]], equal))
        run_of = np.maximum.accumulate(np.where(copy, 0, np.arange(len(doc))))
        first = np.where((run_of == 0) & copy[0], before[2], doc[run_of])
        a = np.flatnonzero(equal & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))
        whole, other = np.concatenate([a, a + 1]), np.concatenate([doc[a + 1], first[a + 1]])
        yield record_batch([[None] * len(whole), doc[whole], (at[whole] - side).astype(np.int32), (at[whole] + least).astype(np.int32), other], WINDOWS)
        shared = np.maximum(np.append([before[0]], ahead), np.append(ahead, 0))
        asks = ~copy
        asks[-1] &= ends  # else its next row is still to come
        for n, key in window_keys(head, right, left):
            hit = asks & (shared >= side - n)
            start = (at[hit] - n).astype(np.int32)
            yield record_batch([key[hit], doc[hit], start, start + np.int32(least), [None] * len(start)], WINDOWS)
        return (ahead[-1] if len(ahead) else before[0]), bool(copy[-1]), int(first[-1])

    def run(batches):
        held, n, large, before = [], 0, None, None

        def flush(last: bool):
            nonlocal held, n, large, before
            table = pa.Table.from_batches(held).combine_chunks()
            head = table.column("head").to_numpy()
            lo, hi = 0, len(head) if last else int(np.searchsorted(head, head[-1]))
            if large is not None:
                lo = int(np.searchsorted(head, large, side="right"))
                ends = last or lo < len(head)
                before = yield from windows(table.slice(0, lo), before, ends)
                if not ends:
                    lo, hi = lo - 1, lo - 1  # the last row meets its next one
                else:
                    large = None
            if hi > lo:
                yield compared(table.slice(lo, hi - lo))
            rest = table.slice(max(lo, hi))
            if large is None and rest.num_rows > MOST:
                large = int(head[-1])
                before = yield from windows(rest, (0, False, 0), False)
                rest = rest.slice(rest.num_rows - 1)
            held, n = rest.combine_chunks().to_batches(), rest.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n > MOST:
                yield from flush(False)
        if n:
            yield from flush(True)

    order = rows.repartition("head").sortWithinPartitions("head", "right", "left", "doc", "at")
    return order.mapInArrow(run, WINDOWS)


def window_repeats(rows: DataFrame) -> DataFrame:
    """MATCHES of the rows of ``found_repeats``: those without a key, and of the windows
    that it left those that meet another. Both kinds pass one exchange and are not written
    between, so nothing is found twice."""
    names = [c.split()[0] for c in MATCHES.split(", ")]

    def run(batches):
        held, met = None, False  # the smallest row of the last key, and whether it met another
        for batch in batches:
            known = batch.column("key").null_count  # they come first
            if known:
                yield batch.slice(0, known).select(names)
                batch = batch.slice(known)
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key, doc, start = (table.column(c).to_numpy() for c in ("key", "doc", "start"))
            shared, other = partners(key, doc, start)
            first = int(np.searchsorted(key, key[-1]))
            hit = shared.copy()
            hit[0] &= not met
            met = bool(shared[-1]) or (met and first == 0)
            held = table.slice(first, 1).to_batches()[0]
            if hit.any():
                yield record_batch([doc[hit], start[hit], table.column("stop").to_numpy()[hit], other[hit]], MATCHES)

    dealt = rows.repartition(F.coalesce("key", F.xxhash64("doc", "start")))
    return dealt.sortWithinPartitions("key", "doc", "start").mapInArrow(run, MATCHES)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each maximal passage that stands elsewhere, too: doc_id,
    start and n_words of the passage, other_doc_id (a document that shares a window of
    it, the smallest where heads have up to MOST suffixes), is_first (no smaller one does)."""
    named = key_and_text(docs, id_col, text_col)
    flagged = shared_keys(heads(named, least)).groupBy("doc").agg(F.collect_set("key").alias("keys"))
    same = copies(named, least)
    joined = word_lists(named).join(flagged, "doc", "left").join(same, "doc", "left")
    found = found_repeats(suffixes(joined, least), least)
    whole = same.select("doc", F.explode("copies").alias("c")).select(
        "doc", F.lit(0).alias("start"), F.col("c.n").alias("stop"), F.col("c.other").alias("other"))
    matches = window_repeats(found).union(whole)

    # equal matches of one document, from many suffixes and neighbours, fall together before they are united
    spans = matches.groupBy("doc", "start", "stop").agg(F.min("other").alias("other"))

    def unite(batches):
        doc, open_ = None, None
        for batch in batches:
            out = []
            for d, a, b, o in zip(*(c.to_pylist() for c in batch.columns)):
                if d == doc and a <= open_[1]:
                    open_ = (open_[0], max(open_[1], b), min(open_[2], o))
                    continue
                if doc is not None:
                    out.append((doc, *open_))
                doc, open_ = d, (a, b, o)
            yield record_batch([list(c) for c in zip(*out)] or [[], [], [], []], MATCHES)
        if doc is not None:
            yield record_batch([[doc], [open_[0]], [open_[1]], [open_[2]]], MATCHES)

    united = spans.repartition("doc").sortWithinPartitions("doc", "start", "stop").mapInArrow(unite, MATCHES)
    null = F.lit(None).cast("long")
    return united.select(F.when(F.col("doc") == LAST, null).otherwise(F.col("doc")).alias("doc_id"), F.col("start").cast("long").alias("start"),
                         (F.col("stop") - F.col("start")).cast("long").alias("n_words"),
                         F.when(F.col("other") == LAST, null).otherwise(F.col("other")).alias("other_doc_id"),
                         (F.col("doc") <= F.col("other")).alias("is_first"))
