"""Substring dedup by recompression.

Each round names maximal runs of equal symbols or neighbouring pairs (a, b),
where a's name falls into the left half of the alphabet and b's into the right
half of that round. A name is a hash of what it stands for, so names agree
across all documents without any exchange. Two equal stretches of words get
equal symbols except near their ends, where a symbol depends on words outside;
that dependence is tracked exactly: every symbol knows the interval of words
that forced it to be formed. A symbol inside a window, with its interval, is
therefore found again in every other place where the window's words stand.

1. Every symbol of the last round is counted (key: its name and the words of its
   interval). A window that occurs twice holds only symbols that occur twice. The
   few windows that hold no such symbol are counted by themselves.
2. Windows all of whose symbols are shared are verified: their own words are
   hashed (96 bits), and the smallest (doc_id, start) of each wins.
3. Words covered by a window that is not the first are removed.

Before each exchange a task combines its own rows: a symbol or window that a
task sees many times is one row of the exchange, so a passage that a third of
the documents share costs one row for each block of documents. The exchanges are
sorted and streamed, never collected. Documents equal as a whole share their
root symbol; all but the first are removed whole.

Nulls: a null text has no words: nothing is removed, kept_sha256 is that of the
empty string. A null doc_id comes last in the order. Rows with the same doc_id
and the same words are not earlier than one another; with other words, the
smaller start is the earlier. An empty table gives an empty result. Only the two
named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import _INVERSE, _MULT, blocks, cuts, key_and_text, mix, powers, stored, window_hashes, word_hashes

WINDOW = 20
ROUNDS = 5
#: Odd multipliers that halve the alphabet, one for each round.
_HALVES = [2 * int(x) + 1 for x in np.random.default_rng(7).integers(0, 1 << 62, 64)]
LAST = (1 << 63) - 1
KEYS = "key long, doc long, more binary"
TEXTS = "doc long, doc_id long, words binary, n_bytes long, n_words long"
SEEN = "h long, check int, doc long, start int, n int, known boolean"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Block:
    """Words of several documents, one after the other."""

    def __init__(self, texts: list[bytes], width: int):
        self.h, self.first = word_hashes(texts)
        self.n_words = np.diff(self.first)
        self.n, self.width = len(self.h), width
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        # windows by their first word; those that would leave their document don't count
        fits = self.first[self.doc + 1] - np.arange(self.n) >= width
        self.starts = np.flatnonzero(fits)
        full = window_hashes(self.h, width)
        self.window = full[self.starts] if len(full) else np.empty(0, np.uint64)
        other = window_hashes(mix(self.h ^ np.uint64(0x5851F42D4C957F2D)), width)
        self.check = (other[self.starts] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(other) else np.empty(0, np.int32)

    def symbols(self, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key and interval [lo, hi) of the last round's symbols whose interval
        is inside their document and no longer than a window."""
        n, doc, first = self.n, self.doc, self.first
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        # runs: maximal stretches of one word; the words on both sides end them
        start = np.flatnonzero(np.concatenate(([True], (self.h[1:] != self.h[:-1]) | (doc[1:] != doc[:-1]))))
        size = np.diff(np.append(start, n))
        name = np.where(size > 1, mix(self.h[start] + size.astype(np.uint64)), self.h[start])
        lo, hi, doc = start - 1, start + size + 1, doc[start]
        for r in range(rounds):
            left = (name * np.uint64(_HALVES[r])) >> np.uint64(63) == 0
            same = doc[:-1] == doc[1:]
            pair = same & left[:-1] & ~left[1:]
            opens, closes = np.append(pair, False), np.concatenate(([False], pair))
            # a lone left symbol saw its successor, a lone right one its predecessor (or an end of the document)
            after = np.append(np.where(same, hi[1:], first[doc[:-1] + 1] + 1), n + 1)
            before = np.concatenate(([-1], np.where(same, lo[:-1], first[doc[1:]] - 1)))
            new_hi = np.where(left, np.maximum(hi, after), hi)
            new_lo = np.where(~left & ~closes, np.minimum(lo, before), lo)
            at = np.flatnonzero(opens)
            new_lo[at] = np.minimum(lo[at], lo[at + 1])
            new_name = name.copy()
            new_name[at] = mix(name[at] * np.uint64(_MULT) + name[at + 1] + np.uint64(r + 1))
            keep = ~closes
            name, lo, hi, doc = new_name[keep], new_lo[keep], new_hi[keep], doc[keep]
        inside = (lo >= first[doc]) & (hi <= first[doc + 1]) & (hi - lo <= self.width)
        name, lo, hi = name[inside], lo[inside], hi[inside]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * powers(_MULT, n))))
        words = (total[hi] - total[lo]) * powers(_INVERSE, n)[lo]
        return mix(name + mix(words + (hi - lo).astype(np.uint64))), lo, hi

    def holding(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each window, how many of the intervals it holds."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, np.maximum(hi - self.width, 0), 1)
        np.add.at(edge, lo + 1, -1)
        # an interval near the document's start is also held by windows of the document before; those don't fit
        return np.cumsum(edge)[self.starts]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their document, their interval; windows that hold no symbol are keys themselves."""
        key, lo, hi = self.symbols()
        bare = self.holding(lo, hi) == 0
        at = self.starts[bare]
        key = np.concatenate((key, mix(self.window[bare] + np.uint64(1))))
        lo, hi = np.concatenate((lo, at)), np.concatenate((hi, at + self.width))
        return key, self.doc[lo] if len(lo) else lo, lo, hi, bare

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Indexes of the windows all of whose symbols are shared."""
        key, _, lo, hi, _ = self.keys()
        alone = ~np.isin(key, shared)
        return np.flatnonzero(self.holding(lo[alone], hi[alone]) == 0)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def record_batch(columns: list, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def first_of_blocks(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """KEYS of one block: each key once, with the documents that have it."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    more: list[bytes | None] = [None] * len(first)
    for j in np.flatnonzero(count > 1):
        more[j] = owner[first[j] + 1:first[j] + count[j]].tobytes()
    return record_batch([_signed(key[first]), owner[first], more], KEYS)


def document_keys(docs: DataFrame, width: int) -> DataFrame:
    """KEYS: one row per key and block of documents; ``doc`` is the first
    document of the block that has it, ``more`` the others (8 bytes each)."""
    def run(batches):
        for ids, texts in blocks(batches):
            ids = np.array([LAST if i is None else i for i in ids], np.int64)
            block = Block(texts, width)
            key, doc, *_ = block.keys()
            if not len(key):
                continue
            yield first_of_blocks(key, ids[doc])

    return docs.mapInArrow(run, KEYS)


def shared_keys(keys: DataFrame) -> DataFrame:
    """(doc, key) of the keys that occur twice or more. Rows come sorted by key."""
    def rows(table, hit):
        found = table.filter(pa.array(hit))
        if found.num_rows:
            key, doc = found.column("key").to_numpy(), found.column("doc").to_numpy()
            more = [(k, np.frombuffer(m, np.int64)) for k, m in zip(key, found.column("more").to_pylist()) if m]
            key = np.concatenate([key, *(np.full(len(m), k, np.int64) for k, m in more)])
            doc = np.concatenate([doc, *(m for _, m in more)])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], names=["doc", "key"])

    def run(batches):
        held, held_shared = None, False  # the last row waits for the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            hit = np.concatenate(([held_shared], same)) | np.append(same, False) | table.column("more").is_valid().to_numpy()
            held_shared, hit[-1] = bool(hit[-1]), False
            yield from rows(table, hit)
            held = table.slice(len(key) - 1).combine_chunks().to_batches()[0]
        if held_shared:
            yield from rows(pa.Table.from_batches([held]), np.ones(1, bool))

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, key long")


def word_lists(docs: DataFrame) -> DataFrame:
    """TEXTS: the words of each document, joined by one space and compressed."""
    def run(batches):
        for ids, texts in blocks(batches):
            lists = [t.split() for t in texts]
            joined = [b" ".join(w) for w in lists]
            packed = [pa.compress(j, codec="zstd", asbytes=True) for j in joined]
            yield record_batch([[LAST if i is None else i for i in ids], ids, packed, [len(j) for j in joined], [len(w) for w in lists]], TEXTS)

    return docs.mapInArrow(run, TEXTS)


def roots(docs: DataFrame, width: int) -> DataFrame:
    """(doc, root) of the documents whose words are all those of an earlier one."""
    def run(batches):
        for ids, texts in blocks(batches):
            rows = [(LAST if i is None else i, xxhash.xxh3_128_digest(b" ".join(w)))
                    for i, w in zip(ids, (t.split() for t in texts)) if len(w) >= width]
            if rows:
                yield record_batch(list(zip(*rows)), "doc long, root binary")

    named = stored(docs.mapInArrow(run, "doc long, root binary"))
    first = named.groupBy("root").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return named.join(first, "root").where("doc > first").groupBy("doc").agg(F.collect_set("root").alias("copies"))


def _columns(batch: pa.RecordBatch) -> dict[str, list]:
    return {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _is_copy(text: bytes, copies: list[bytes] | None) -> bool:
    return bool(copies) and xxhash.xxh3_128_digest(text) in copies


def text_parts(batches, size: int = 1_500_000):
    """Batches cut so that a part's texts are some MB."""
    for batch in batches:
        for lo, n in cuts(batch.column(batch.schema.get_field_index("n_bytes")).to_numpy(), size):
            yield batch.slice(lo, n)


def seen_windows(joined: DataFrame, width: int) -> DataFrame:
    """SEEN: for documents with shared keys, the windows that may repeat: once
    for each block (``known`` false), and the block's own repeats as runs of n
    starts (``known`` true)."""
    def run(batches):
        for batch in text_parts(batches):
            cols = _columns(batch)
            texts = {i: _unpack(cols["words"][i], cols["n_bytes"][i]) for i, k in enumerate(cols["keys"]) if k}
            rows = sorted((i for i, t in texts.items() if not _is_copy(t, cols["copies"][i])), key=lambda i: cols["doc"][i])
            if not rows:
                continue
            ids = np.array([cols["doc"][i] for i in rows], np.int64)
            shared = np.unique(np.concatenate([np.array(cols["keys"][i], np.int64) for i in rows])).view(np.uint64)
            block = Block([texts[i] for i in rows], width)
            cand = block.candidates(shared)
            if not len(cand):
                continue
            h, check, at = block.window[cand], block.check[cand], block.starts[cand]
            doc = block.doc[at]
            start = (at - block.first[doc]).astype(np.int32)
            # equal ids are only possible for repeated rows: order by id, then start
            order = np.lexsort((start, ids[doc], check, h))
            h, check, owner, start = h[order], check[order], ids[doc[order]], start[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
            group = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (owner > owner[group]) | (start > start[group])
            once = np.flatnonzero(new)
            yield record_batch([_signed(h[once]), check[once], owner[once], start[once], np.ones(len(once), np.int32),
                          np.zeros(len(once), bool)], SEEN)
            if later.any():
                d, s, c = owner[later], start[later], check[later]
                order = np.lexsort((c, s, d))
                d, s, c = d[order], s[order], c[order]
                # repeated rows may mark a start twice or for other words: one-step runs keep their own check
                begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1))))
                n = np.diff(np.append(begin, len(d))).astype(np.int32)
                spread = _signed(mix(d[begin].view(np.uint64) + s[begin].astype(np.uint64)))
                yield record_batch([spread, c[begin], d[begin], s[begin], n, np.ones(len(begin), bool)], SEEN)

    # rows without keys are left out by the task: a filter here would give this branch a shuffle of texts of its own
    return joined.mapInArrow(run, SEEN)


def later_windows(seen: DataFrame) -> DataFrame:
    """(doc, start, n, check) of the windows that are not the first of theirs.
    Rows come sorted by window, document and start."""
    fields = "doc long, start int, n int, check int"

    def run(batches):
        lead = None  # (h, check, doc, start) that leads the group a batch ends in
        for batch in batches:
            if not batch.num_rows:
                continue
            h, check, doc, start, n, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            new = np.concatenate(([lead is None or (h[0], check[0]) != lead[:2]], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
            slot = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            lead_doc = np.where(slot >= 0, doc[at[slot]] if len(at) else 0, lead[2] if lead else 0)
            lead_start = np.where(slot >= 0, start[at[slot]] if len(at) else 0, lead[3] if lead else 0)
            hit = known | (doc != lead_doc) | (start != lead_start)
            if len(at):
                lead = (h[at[-1]], check[at[-1]], doc[at[-1]], start[at[-1]])
            if hit.any():
                yield record_batch([doc[hit], start[hit], n[hit], check[hit]], fields)

    order = seen.repartition("h").sortWithinPartitions("known", "h", "check", "doc", "start")
    return order.mapInArrow(run, fields)


def remove(joined: DataFrame, width: int) -> DataFrame:
    """RESULT from documents with the marks of their later windows."""
    def run(batches):
        for batch in text_parts(batches):
            cols = _columns(batch)
            out = []
            texts = [_unpack(p, n) for p, n in zip(cols["words"], cols["n_bytes"])]
            copy = [_is_copy(t, c) for t, c in zip(texts, cols["copies"])]
            marked = [i for i, m in enumerate(cols["marks"]) if m and not copy[i]]
            block = Block([texts[i] for i in marked], width)
            check = np.zeros(block.n, np.int32)
            check[block.starts] = block.check
            fits = np.zeros(block.n, bool)
            fits[block.starts] = True
            covered = np.zeros(block.n + 1, np.int64)
            for k, i in enumerate(marked):
                m = np.array([(x["start"], x["n"], x["check"]) for x in cols["marks"][i]], np.int64)
                at, n = m[:, 0] + block.first[k], m[:, 1]
                # the marks of a repeated doc_id may be those of its other row
                ok = (m[:, 0] + n <= block.n_words[k])
                ok[ok] = fits[at[ok]] & (check[at[ok]] == m[ok, 2])
                np.add.at(covered, at[ok], 1)
                np.add.at(covered, at[ok] + n[ok] - 1 + width, -1)
            gone = np.cumsum(covered)[:-1] > 0
            place = {i: k for k, i in enumerate(marked)}
            for i, text in enumerate(texts):
                n_words, kept, removed = cols["n_words"][i], text, 0
                if copy[i]:
                    kept, removed = b"", n_words
                elif i in place:
                    drop = gone[block.first[place[i]]:block.first[place[i] + 1]]
                    removed = int(drop.sum())
                    if removed:
                        words = text.split(b" ")
                        kept = b" ".join([words[j] for j in np.flatnonzero(~drop)])
                out.append((cols["doc_id"][i], n_words, removed, hashlib.sha256(kept).hexdigest()))
            if out:
                yield record_batch(list(zip(*out)), RESULT)

    return joined.mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """RESULT: one row per document."""
    named = key_and_text(docs, id_col, text_col)
    flagged = shared_keys(document_keys(named, width)).groupBy("doc").agg(F.collect_set("key").alias("keys"))
    texts = word_lists(named)
    joined = texts.join(flagged, "doc", "left").join(roots(named, width), "doc", "left")
    marks = later_windows(seen_windows(joined, width)).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "check")).alias("marks"))
    return remove(joined.join(marks, "doc", "left"), width)
