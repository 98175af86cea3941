"""Quality rules by tokeniser fertility.

Public vocabularies say how a text breaks into tokens: characters per token,
the share of tokens that fall back to single bytes, and the token entropy. Text
in a language has typical values; damaged text (symbol litter, shouting,
endless repeats, wrong encodings) leaves them. The bands are robust statistics
(median and quartiles) of the whole corpus for each language, or for each
script where the language is null, so nothing is tuned to one corpus.

* characters per token of a document of n tokens has the variance
  ``corpus variance + (variance of token lengths) / n``; outside
  ``fertility_z`` of these standard deviations it is rejected, whatever its
  length;
* token entropy is the collision entropy ``-log2 sum c(c-1) / n(n-1)``, whose
  argument is unbiased for every n; it is rejected ``entropy_z`` below the
  median;
* the byte share is rejected above median + ``byte_z`` deviations.

A deviation is never taken below ``floor`` of the median (0.02 for the byte
share), so a language with few or equal documents rejects nothing by accident.

Nulls: a null text is the empty text; it has 0 words and fails the base rules.
A null or unknown language falls back to the script. Repeated rows each get
their own verdict (the same one). An empty table gives an empty result. Other
columns are passed through and never looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, stored, text_batches
from vellum.session import fits_broadcast

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: First and last code point of the letters that name a script.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF),
           ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF),
           ("hangul", 0xAC00, 0xD7AF))

#: Bytes of a row of quartiles with a long language name.
QUARTILE_BYTES = 512
#: Characters of the texts tokenised together (bounds a worker's memory).
CHUNK_CHARS = 100_000

FEATURES = ("script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_byte_tokens long, n_piece_tokens long, byte_cpt double, byte_cpt_var double, piece_cpt double, "
            "piece_cpt_var double, byte_share double, entropy double")
#: Measures with a band: (column, variance of its own estimate, sides, smallest deviation, relative to the median?).
MEASURES = (("byte_cpt", "byte_cpt_var", "both", 0.01, True), ("piece_cpt", "piece_cpt_var", "both", 0.01, True),
            ("byte_share", None, "above", 0.02, False), ("entropy", None, "below", 0.01, True))


@lru_cache(maxsize=4)
def piece_vocabulary(path: str):
    """Sentencepiece model, its piece lengths and which ids are single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    lengths = np.array([1 if sp.is_byte(i) else len(sp.id_to_piece(i)) for i in range(size)], np.float64)
    return sp, lengths, np.array([sp.is_byte(i) for i in range(size)])


@lru_cache(maxsize=4)
def byte_vocabulary(path: str, pattern: str):
    """Byte-level BPE from a rank file and the length of each token in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.float64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def repeated_words(words: list[str]) -> int:
    """Words covered by a WINDOW-word run that the text holds twice or more
    (exact: runs of 2, 4, 8 words are ranked by sorting)."""
    n = len(words)
    ids: dict[str, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n <= WINDOW or len(ids) == n:
        return 0
    step = 1
    while step < WINDOW:
        code = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, count = np.unique(code, return_inverse=True, return_counts=True)
        if len(count) == len(rank):
            return 0
        step *= 2
    starts = np.flatnonzero(count[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def script_of(text: str) -> str:
    """The script of most letters (ties: the first listed)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = [(int(((points >= lo) & (points <= hi)).sum()), -i, name) for i, (name, lo, hi) in enumerate(SCRIPTS)]
    best = max(counts)
    return best[2] if best[0] else "other"


def fertility(texts: list[str], piece_path: str, byte_path: str, pattern: str) -> list[tuple]:
    """Token counts, characters per token with the variance of that estimate,
    byte-fallback share and collision entropy of each text."""
    sp, piece_len, is_byte = piece_vocabulary(piece_path)
    bpe, byte_len = byte_vocabulary(byte_path, pattern)
    out = []
    for text, pieces in zip(texts, sp.encode(texts, num_threads=1)):
        pieces = np.sort(np.array(pieces, np.int64))
        tokens = np.array(bpe.encode_ordinary(text), np.int64)
        n, m, chars = len(tokens), len(pieces), len(text)
        if not n or not m:
            out.append((n, m, None, None, None, None, None, None))
            continue
        edges = np.flatnonzero(np.concatenate(([True], pieces[1:] != pieces[:-1], [True])))
        count = np.diff(edges)
        pairs = max(int((count * (count - 1)).sum()), 1)
        entropy = -np.log2(pairs / (m * (m - 1))) if m > 1 else 0.0
        out.append((n, m, chars / n, float(byte_len[tokens].var()) / n, chars / m, float(piece_len[pieces].var()) / m,
                    float(is_byte[pieces].mean()), float(entropy)))
    return out


def with_features(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, column: str,
                  text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with one struct column of FEATURES (one Arrow pass, no shuffle)."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measure(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in series:
            done = 0
            rows, lo, texts, langs = [], 0, texts.tolist(), langs.tolist()
            for hi, size in enumerate(np.cumsum([len(t) for t in texts]) // CHUNK_CHARS, 1):
                if hi == len(texts) or size > done:
                    done, part = size, texts[lo:hi]
                    tokens = fertility(part, piece_path, byte_path, pattern)
                    rows += [(None if lang else script_of(t), *base_measures(t), *x) for t, lang, x in zip(part, langs[lo:hi], tokens)]
                    lo = hi
            yield pd.DataFrame(rows, columns=names)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(column, measure(text, F.coalesce(lang, F.lit(""))))


def verdicts(measured: DataFrame, column: str, lang_col: str | None = "lang", fertility_z: float = 5.0,
             entropy_z: float = 5.0, byte_z: float = 8.0) -> DataFrame:
    """Adds to the struct ``column`` the fields base_failed, out_of_band (comma
    joined names of the measures outside their band) and kept."""
    f = lambda x: F.col(f"`{column}`.{x}")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    group = F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("language:"), lang)).otherwise(
        F.concat(F.lit("script:"), f("script")))
    base_failed = (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words"))
    keyed = measured.select("*", F.struct(f"`{column}`.*", group.alias("band"), base_failed.alias("base_failed")).alias("_m"))
    keyed = keyed.drop(column).withColumnRenamed("_m", column)

    quartiles = keyed.where(~f("base_failed")).groupBy(f("band").alias("_band")).agg(
        *[F.percentile_approx(f(m), [0.25, 0.5, 0.75], 10_000).alias(f"_q_{m}") for m, *_ in MEASURES])
    # one row per language or script: broadcast after counting them, else a third of all rows may meet in one task
    quartiles = stored(quartiles)
    if fits_broadcast(quartiles.count(), QUARTILE_BYTES):
        quartiles = F.broadcast(quartiles)
    joined = keyed.join(quartiles, f("band") == F.col("_band"), "left")
    outside = []
    for m, var, sides, floor, relative in MEASURES:
        q = F.col(f"_q_{m}")
        low = F.lit(floor) * (q[1] if relative else F.lit(1.0))
        dev = F.greatest((q[2] - q[0]) / 1.349, low)
        if var:
            dev = F.sqrt(dev * dev + f(var))
        z = (f(m) - q[1]) / dev
        limit = {"byte_share": byte_z, "entropy": entropy_z}.get(m, fertility_z)
        bad = {"both": F.abs(z) > limit, "above": z > limit, "below": z < -limit}[sides]
        outside.append(F.when(bad, F.lit(m)))
    out_of_band = F.concat_ws(",", *outside)
    kept = ~f("base_failed") & (out_of_band == "")
    result = F.struct(f"`{column}`.*", out_of_band.alias("out_of_band"), kept.alias("kept"))
    return joined.withColumn("_v", result).select(*[F.col(f"`{c}`") for c in measured.columns if c != column],
                                                  F.col("_v").alias(column))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, text_col: str = "text",
            lang_col: str | None = "lang", keep: list[str] | None = None, **bands) -> tuple[DataFrame, str]:
    """``docs`` with the columns ``keep`` (all if None; the language is always
    kept) and one struct of measures and verdict; also the name of that column.
    The measured rows are written once, because the corpus bands and the
    verdicts both read them."""
    column = free_name(docs, "quality_rules")
    measured = with_features(docs, piece_path, byte_path, pattern, column, text_col, lang_col)
    if keep is not None:
        measured = measured.select(*dict.fromkeys([*keep, *([lang_col] if lang_col else []), column]))
    with text_batches(docs.sparkSession):
        measured = stored(measured)
    return verdicts(measured, column, lang_col, **bands), column
