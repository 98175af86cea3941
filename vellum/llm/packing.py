"""Lexical retrieval packing.

Documents are tokenised once. Full windows of a document stand alone; its last,
shorter piece is packed with others. The pieces lie in shards of bounded size
(their number follows the corpus), each with a BM25 inverted index over its
pieces; document frequencies are those of the whole corpus. In a shard, a seed
piece queries the index with its most telling terms, and its unused neighbours
fill its window in order of score. The neighbour that does not fit is cut; its
rest seeds the next window. So windows are full, and what a shard has left at its
end is cut into powers of two, which need no padding.

With an order column (a long; the pipeline's training order) the shards are
consecutive ranges of it instead, and a shard's sequences are numbered by the
mean place of their tokens, so sequence_id follows the order.

The ids are those of the tokenizer file. With ``added`` its added tokens are
recognised inside a text, as the tokenizer does by default; without, their
strings are ordinary text. Its merges are run by a public library several times faster with the same
vocabulary and split rule (the tests compare both on every code point).

Nulls: a null text is the empty text, of one token (the end id); a null doc_id
is passed through. Repeated rows are documents of their own. An empty table
gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import blocks, ranges, stored, text_batches

WINDOW = 1024
END_ID = 0
#: Terms of a seed that are looked up, and BM25's constants.
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: Tokens of a shard, on average.
SHARD_TOKENS = 1_500_000

TOKENS = "doc_id long, place long, doc_tokens long, crcs array<long>, tail binary, df binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """(encoder, vocabulary size, ids of added tokens, their pattern) of a byte-level BPE tokenizer file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    tokens = file.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that strip or want whole words are not supported")
    added = {t["content"]: t["id"] for t in tokens}
    split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
    # byte-level vocabularies write each byte as a printable character: printable ones as themselves, the rest from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max([*vocab.values(), *added.values()]) + 1, added, split


def encode(text: str, path: str, pattern: str, added: bool = False) -> list[int]:
    encoder, _, ids, split = _encoder(path, pattern)
    if not added or split is None or not split.search(text):
        return encoder.encode_ordinary(text)
    # the split keeps the tokens at odd places
    return [i for k, part in enumerate(split.split(text)) for i in ([ids[part]] if k % 2 else encoder.encode_ordinary(part))]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None,
           added: bool = False) -> DataFrame:
    """One row per document (checksums of its full windows, ids of its last
    piece) and one row per partition with the document frequency of every id."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches):
        size = _encoder(path, pattern)[1]
        df = np.zeros(size, np.int64)
        for keys, texts in blocks(batches):
            rows = []
            for key, text in zip(keys, texts):
                ids = np.append(np.asarray(encode(text.decode(), path, pattern, added), np.uint32), np.uint32(END_ID))
                full = len(ids) // WINDOW
                df[np.unique(ids)] += 1
                rows.append((key["doc_id"], key["place"], len(ids), [crc(ids[k * WINDOW:(k + 1) * WINDOW]) for k in range(full)],
                             ids[full * WINDOW:].astype("<u4").tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[None], [None], [None], [None], [None], [df.astype("<i8").tobytes()]], types)], names=names)

    # rows without a place come last
    place = F.lit(None).cast("long") if order_col is None else F.coalesce(F.col(order_col).cast("long"), F.lit((1 << 63) - 1))
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), place.alias("place"))
    return docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, TOKENS)


def document_frequencies(tokenised: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each id (as long as the vocabulary, whatever the
    corpus), and their number. Partitions are added up by Spark."""
    def explode(batches):
        for batch in batches:
            total = None
            for df in batch.column(0).to_pylist():
                counts = np.frombuffer(df, "<i8")
                total = counts.copy() if total is None else total + counts
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = (tokenised.where("df is not null").select("df").mapInArrow(explode, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts, int(counts[END_ID])


class Index:
    """BM25 inverted index over the pieces of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray):
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ids = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        key, tf = np.unique(ids * len(pieces) + owner, return_counts=True)
        term, self.doc = key // max(len(pieces), 1), key % max(len(pieces), 1)
        length = np.array([len(p) for p in pieces], np.float64)
        norm = K1 * (1 - B + B * length / max(length.mean() if len(length) else 1.0, 1.0))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.terms, self.first = np.unique(term, return_index=True)
        self.size = np.diff(np.append(self.first, len(term)))
        self.idf = idf[self.terms]
        by_doc = np.lexsort((-self.weight, self.doc))
        self.doc_slot = np.searchsorted(self.terms, term[by_doc])
        self.doc_first = np.searchsorted(self.doc[by_doc], np.arange(len(pieces) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces that share a query term with the seed, best first."""
        slots = self.doc_slot[self.doc_first[seed]:self.doc_first[seed + 1]]
        slots = slots[self.size[slots] > 1][:QUERY_TERMS]
        at = ranges(self.first[slots], self.size[slots])
        if not len(at):
            return np.empty(0, np.int64)
        score = np.bincount(self.doc[at], self.weight[at], minlength=len(unused))
        hits = np.flatnonzero((score > 0) & unused)
        return hits[np.argsort(-score[hits], kind="stable")]


def pack_shard(pieces: list[np.ndarray], idf: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, start in the piece, length); every token of
    every piece lies in exactly one."""
    index = Index(pieces, idf)
    unused = np.ones(len(pieces), bool)
    windows: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None  # a cut piece and where its rest begins
    nxt = 0
    while True:
        if rest is None:
            while nxt < len(pieces) and not unused[nxt]:
                nxt += 1
            if nxt == len(pieces):
                return windows
            unused[nxt] = False
            rest = (nxt, 0)
        seed, start = rest
        rest = None
        window, room = [(seed, start, len(pieces[seed]) - start)], WINDOW - (len(pieces[seed]) - start)
        near = index.neighbours(seed, unused).tolist() if room else []
        k = 0
        while room:
            if k < len(near):
                doc = near[k]
                k += 1
            else:  # no neighbour is left: the next unused piece
                while nxt < len(pieces) and not unused[nxt]:
                    nxt += 1
                if nxt == len(pieces):
                    break
                doc = nxt
            unused[doc] = False
            take = min(room, len(pieces[doc]))
            window.append((doc, 0, take))
            room -= take
            if take < len(pieces[doc]):
                rest = (doc, take)
        windows.extend([window] if not room else powers_of_two(window))


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A part-filled window cut into sequences whose lengths are powers of two."""
    total = sum(n for *_, n in window)
    out, queue = [], list(window)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        part = []
        while need:
            doc, start, n = queue.pop(0)
            take = min(need, n)
            part.append((doc, start, take))
            need -= take
            if take < n:
                queue.insert(0, (doc, start + take, n - take))
        if part:
            out.append(part)
    return out


def ordered_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with the number of the range of ``place`` they lie in, as shard."""
    cuts = rows.agg(F.percentile_approx("place", [k / shards for k in range(1, shards)], 10_000 + 100 * shards)).first()[0] if shards > 1 else []
    cuts = np.array(cuts if cuts is not None else [], np.int64)

    def run(batches):
        for batch in batches:
            shard = np.searchsorted(cuts, batch.column(batch.schema.get_field_index("place")).to_numpy(), side="right")
            yield batch.append_column("shard", pa.array(shard, pa.int64()))

    return rows.mapInArrow(run, f"{TOKENS.replace(', df binary', '')}, shard long")


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None,
         added: bool = False) -> DataFrame:
    """Pieces of all documents: PIECES. Sequences are numbered by shard, and in
    the order of ``order_col`` (nulls last) where there is one."""
    with text_batches(docs.sparkSession):
        tokenised = stored(tokens(docs, path, pattern, id_col, text_col, order_col, added))
    counts, n_docs = document_frequencies(tokenised)
    idf = np.log1p((n_docs - counts + 0.5) / (counts + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary
    rows = tokenised.where("df is null").drop("df")
    tail_tokens = rows.agg(F.sum(F.octet_length("tail") / 4)).first()[0] or 0
    shards = max(1, int(-(-tail_tokens // SHARD_TOKENS)))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(shard: pa.Table) -> pa.Table:
        key = shard.column("shard")[0].as_py() if shard.num_rows else 0
        doc_ids, sizes = shard.column("doc_id").to_pylist(), shard.column("doc_tokens").to_pylist()
        crcs, tails = shard.column("crcs").to_pylist(), shard.column("tail").to_pylist()
        places = shard.column("place").to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (places[i] or 0, doc_ids[i] is None, doc_ids[i] or 0, tails[i], sizes[i], crcs[i]))
        sequences: list[tuple[float, list[tuple]]] = []  # (mean rank in the order, pieces without their sequence_id)
        rank = dict(zip(order, range(len(order))))
        for i in order:
            for k, c in enumerate(crcs[i]):
                sequences.append((rank[i], [(doc_ids[i], k * WINDOW, WINDOW, c, sizes[i], 0)]))
        order = [i for i in order if tails[i]]
        pieces = [np.frombuffer(tails[i], "<u4").astype(np.int64) for i in order]
        for window in pack_shard(pieces, shared.value):
            offset, parts = 0, []
            for p, start, n in window:
                i = order[p]
                parts.append((doc_ids[i], len(crcs[i]) * WINDOW + start, n, crc(pieces[p][start:start + n]), sizes[i], offset))
                offset += n
            sequences.append((sum(rank[order[p]] * n for p, _, n in window) / offset, parts))
        if order_col is not None:
            sequences.sort(key=lambda s: s[0])
        out = [(*piece[:-1], (key << 32) + k, piece[-1]) for k, (_, parts) in enumerate(sequences) for piece in parts]
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail"), F.lit(shards))) if order_col is None else ordered_shards(rows, shards)
    return keyed.groupBy("shard").applyInArrow(run, PIECES)
