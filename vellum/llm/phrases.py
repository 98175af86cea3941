"""Phrase collocation mining with mergeable Misra-Gries summaries.

Texts are cut into pieces and words (see ``Words``); phrases are the runs of one
to ``longest`` words of a piece, counted for each language. Three rounds of
summaries (words; pairs; longer runs) find every phrase that occurs ``least``
times or more:

1. Tasks combine the hashes of their phrases and send each hash partition its
   share, whose summary (``frequent``) keeps every frequent phrase.
2. Each partition marks its survivors in its segment of a bitmap of fixed size.
   Words and pairs that are not marked rule out the longer runs over them in the
   next round. A bitmap that fills up rules out less and loses nothing.
3. A last pass counts the phrases marked exactly, by their text.

Scores, cuts and containment are joins over the frequent phrases.

Null texts are empty and give nothing; a null language is ``und`` (and joins
documents that say so). Repeated rows and repeated ids count each time: no id is
read. Ties in the ranking end at the phrase's bytes, which are unique in a
language. An empty table, or one without a frequent phrase, gives no rows. Very
long texts are read whole. Only the two named columns are read, so others may have any
name. Phrases are told apart by 64-bit hashes inside a task, by text beyond.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import BLOCK_BYTES, cuts, mix, powers, stored
from vellum.llm.frequent import frequent_bitmap, marked, parts_bits

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Phrases that a task combines before it sends them.
PHRASES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _power_table(base: int):
    known = powers(base, 1 << 16)

    def first(n: int) -> np.ndarray:
        nonlocal known
        if len(known) < n:
            known = powers(base, 2 * n)
        return known[:n]

    return first


class Words:
    """The words of a block of texts: A-Z lower-cased, pieces split at
    ``[.,;:!?\\x0A-\\x0D]`` and words at ``[\\x20\\x09]``."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, power, inverse):
        self.data = b"\n".join(texts).translate(_LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.start) else np.empty(0, np.int64)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.of_text = np.diff(np.searchsorted(self.start, begin))
        self.seed = np.repeat(seeds, self.of_text)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_OF_BYTE[raw] * power(len(raw)), out=total[1:])
        self.word = mix((total[self.end] - total[self.start]) * inverse(len(raw) + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs of n words inside a piece."""
        m = len(self.word) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1:])
        h = self.seed[at] + np.uint64(n)
        for j in range(n):
            h = h * np.uint64(_MULT) + self.word[at + j]
        return at, mix(h)

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.start[i:i + n].tolist(), self.end[i:i + n].tolist()))


def _ruled_in(words: Words, n: int, marks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``grams(n)`` without those that hold a run of an earlier round that is not frequent."""
    at, h = words.grams(n)
    below = max((k for k in marks if k < n and k <= 2), default=0)
    if below:
        i, shorter = words.grams(below)
        good = np.zeros(len(words.word) + 1, bool)
        good[i] = marked(marks[below], shorter)
        keep = np.ones(len(at), bool)
        for j in range(n - below + 1):
            keep &= good[at + j]
        at, h = at[keep], h[keep]
    return at, h


def _blocks(batches):
    """(lang names, Words) of the rows of Arrow batches, a bounded block of text at a time."""
    seeds: dict[str, int] = {}
    power, inverse = _power_table(_MULT), _power_table(_INVERSE)
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for name in set(langs) - seeds.keys():
            seeds[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        for lo, n in cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK_BYTES):
            names = langs[lo:lo + n]
            yield names, Words(texts.slice(lo, n).to_pylist(), np.array([seeds[x] for x in names], np.uint64), power, inverse)


def survivors(texts: DataFrame, orders: tuple[int, ...], marks: dict, bound: int, least: int) -> np.ndarray:
    """The bitmap of the phrases of these ``orders`` that may be frequent.
    ``marks``: bitmaps of earlier rounds, broadcast. ``bound``: words at most."""
    def hashes(batches):
        known = {k: b.value for k, b in marks.items()}
        for _, words in _blocks(batches):
            for n in orders:
                yield _ruled_in(words, n, known)[1]

    return frequent_bitmap(texts, hashes, bound * len(orders), least)


def counted(texts: DataFrame, marks: dict, longest: int, bound: int, least: int) -> DataFrame:
    """(lang, n, phrase, f): exact counts, by their text, of the phrases marked that
    occur ``least`` times; n = 0: all words of the language. A task sends each hash
    partition its phrases of a language as one row, so a phrase meets in one partition."""
    bits = parts_bits(bound * longest, least)
    parts, shift = 1 << bits, np.uint64(64 - bits)

    def run(batches):
        known = {k: b.value for k, b in marks.items()}
        keys, slots, counts, phrases, total = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), [], {}

        def rows(words_of=()):
            out = [(0, name, b"", np.array([n], np.int64).tobytes()) for name, n in words_of]
            edge = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edge)).tolist():
                by_lang: dict[str, list[int]] = {}
                for i in slots[edge[p]:edge[p + 1]].tolist():
                    by_lang.setdefault(phrases[i][0], []).append(i)
                out += [(p, name, b"\n".join(phrases[i][1] for i in own), counts[own].tobytes()) for name, own in by_lang.items()]
            part, lang, lines, f = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array(lines, pa.binary()), pa.array(f, pa.binary())],
                                              names=["part", "lang", "phrases", "f"])

        for names, words in _blocks(batches):
            for name, n in zip(names, words.of_text.tolist()):
                total[name] = total.get(name, 0) + n
            text_of = np.repeat(np.arange(len(names)), words.of_text)
            for n in range(1, longest + 1):
                at, h = _ruled_in(words, n, known)
                own = marked(known[n], h)
                u, first, c = np.unique(h[own], return_index=True, return_counts=True)
                where = np.searchsorted(keys, u)
                old = np.zeros(len(u), bool)
                old[where < len(keys)] = keys[where[where < len(keys)]] == u[where < len(keys)]
                counts[slots[where[old]]] += c[old]
                if not old.all():
                    begin = at[own][first[~old]].tolist()
                    phrases += [(names[text_of[i]], words.phrase(i, n)) for i in begin]
                    slots = np.insert(slots, where[~old], np.arange(len(counts), len(counts) + len(begin)))
                    keys, counts = np.insert(keys, where[~old], u[~old]), np.concatenate([counts, c[~old]])
            if len(keys) > PHRASES:
                yield rows()
                keys, slots, counts, phrases = keys[:0], slots[:0], counts[:0], []
        yield rows(total.items())

    def add(batches):
        total: dict[str, dict[bytes, int]] = {}  # of one hash partition
        for batch in batches:
            for name, lines, f in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = total.setdefault(name, {})
                for phrase, n in zip(lines.split(b"\n"), np.frombuffer(f, np.int64).tolist()):
                    own[phrase] = own.get(phrase, 0) + n
        for name, own in total.items():
            often = [(p, f) for p, f in own.items() if f >= least or not p]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(often), pa.string()), pa.array([p.count(b" ") + 1 if p else 0 for p, _ in often], pa.int32()),
                                              pa.array([p for p, _ in often], pa.binary()), pa.array([f for _, f in often], pa.int64())], names=["lang", "n", "phrase", "f"])

    rows = texts.mapInArrow(run, "part int, lang string, phrases binary, f binary").repartitionById(parts, F.col("part"))
    return rows.mapInArrow(add, "lang string, n int, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, n, phrase, f) of every phrase of at most ``longest`` words that occurs
    ``least`` times in its language, and of n = 0, all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    # a word has a byte and a separator follows it
    bound = texts.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    rounds = [(1,), (2,), tuple(range(3, longest + 1))][:min(longest, 3)]
    marks: dict = {}
    for orders in rounds:
        bitmap = context.broadcast(survivors(texts, orders, marks, int(bound), least))
        marks = marks | {n: bitmap for n in orders}
    return counted(texts, marks, longest, int(bound), least)


def _words(phrase):
    return F.split(phrase, " ")


def _run(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    known = stored(frequencies(docs, text_col, lang_col, least, longest))
    phrases = known.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("n").alias("size"))
    part = known.where("n > 0").select("lang", "phrase", "f")

    words = _words(F.col("phrase"))
    split = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _run(words, F.lit(1), F.col("k")).alias("head"), _run(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    split = split.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    split = split.join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = split.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: _run(words, s, m)))
    inside = phrases.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = known.where("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("a").cast("long").alias("a"),
                                           F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("n").cast("long").alias("n"),
                                           F.col("cut.score").cast("long").alias("score"))
