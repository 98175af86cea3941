"""DuckDB twins of the Python-semantics text expressions, used only to write
the oracle SQL that checks each Spark query. DuckDB's regex engine (RE2) has no
look-around, so a few twins are formulated differently on purpose (an
independent formulation is a better check than a transliteration)."""

from __future__ import annotations

from vellum.functions.text import PUNCTUATION, PY_WHITESPACE, STOPWORDS_EN

WS = "[" + PY_WHITESPACE + "]"
SEP = "\x01"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({split_ws(x)})"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def balanced(x: str) -> str:
    return (
        f"list_reduce(regexp_extract_all({x}, '[\\[\\](){{}}]'), lambda a, c: CASE "
        "WHEN a = '!' THEN '!' WHEN c IN ('(', '[', '{') THEN a || c "
        "WHEN (c = ')' AND right(a, 1) = '(') OR (c = ']' AND right(a, 1) = '[') "
        "OR (c = '}' AND right(a, 1) = '{') THEN left(a, length(a) - 1) ELSE '!' END, '') = ''"
    )


def starts_punct(x: str) -> str:
    return f"regexp_matches({x}, '^[!-/:-@\\[-`{{-~]')"


def sentence_clean(x: str, lo: int = 8, hi: int = 128) -> str:
    return (f"(NOT contains({x}, chr(10)) AND NOT {starts_punct(x)} "
            f"AND {word_count(x)} BETWEEN {lo} AND {hi} AND {balanced(x)})")


def split_sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, {q('([.!?])' + WS + '+')}, {q(chr(92) + '1' + SEP)}, 'g'), {q(SEP)})"


def order_key(seed, *cols: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', '{seed}', {parts}))"


def pure_tokens(x: str) -> str:
    """Lower, drop ASCII punctuation, blank whole-word stop words, split. Word
    runs are matched as runs of [letter digit _]; a run equal to a stop word
    becomes a blank."""
    t = f"translate(lower({x}), {q(PUNCTUATION)}, '')"
    runs = f"regexp_extract_all({t}, '[\\pL\\pN_]+|[^\\pL\\pN_]+')"
    sw = "[" + ", ".join(q(w) for w in STOPWORDS_EN) + "]"
    joined = f"array_to_string(list_transform({runs}, lambda r: CASE WHEN list_contains({sw}, r) THEN ' ' ELSE r END), '')"
    return split_ws(joined)


def tok_rouge(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def tok_13a(x: str) -> str:
    t = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    ent = f"replace(replace(replace(replace({t}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"(' ' || CASE WHEN contains({t}, '&') THEN {ent} ELSE {t} END || ' ')"
    t = f"regexp_replace({t}, '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    t = f"regexp_replace({t}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return split_ws(t)


def ngrams(x: str, n: int) -> str:
    return (f"CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), "
            f"lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END")


def r9(x: str) -> str:
    return f"round({x}, 9)"


def lcs_row(prev: str, x: str, b: str) -> str:
    """Next LCS table row after token ``x`` of the first sequence: cell j is the
    running maximum of max(prev[j], prev[j-1] + 1 when x = b[j])."""
    cand = (f"list_transform(range(1, len({b}) + 1), lambda j: "
            f"greatest(({prev})[j + 1], CASE WHEN {x} = ({b})[j] THEN ({prev})[j] + 1 ELSE 0 END))")
    return f"list_reduce({cand}, lambda m, v: list_append(m, greatest(m[-1], v)), [0])"


def lcs_zero_row(b: str) -> str:
    return f"list_transform(range(0, len({b}) + 1), lambda j: 0)"


def lcs_len(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists (row-by-row fold)."""
    return f"list_reduce({a}, lambda acc, x: {lcs_row('acc', 'x', b)}, {lcs_zero_row(b)})[-1]"


def lcs_table(a: str, b: str) -> str:
    """The whole LCS table as a list of rows (row 0 first)."""
    return (f"list_reduce({a}, lambda t, x: list_append(t, {lcs_row('t[-1]', 'x', b)}), "
            f"[{lcs_zero_row(b)}])")


def lcs_backtrack(a: str, b: str, table: str) -> str:
    """0-based positions in ``a`` of one LCS with ``b``: walk back from the
    last cell, taking a match, else moving along ``b`` only when strictly
    better, else along ``a``."""
    step = (f"CASE WHEN s.i > 0 AND s.j > 0 THEN (CASE "
            f"WHEN ({a})[s.i] = ({b})[s.j] THEN {{'i': s.i - 1, 'j': s.j - 1, 'o': list_append(s.o, s.i - 1)}} "
            f"WHEN ({table})[s.i + 1][s.j] > ({table})[s.i][s.j + 1] THEN {{'i': s.i, 'j': s.j - 1, 'o': s.o}} "
            f"ELSE {{'i': s.i - 1, 'j': s.j, 'o': s.o}} END) ELSE s END")
    init = f"{{'i': CAST(len({a}) AS BIGINT), 'j': CAST(len({b}) AS BIGINT), 'o': []::BIGINT[]}}"
    return f"list_reduce(range(0, len({a}) + len({b})), lambda s, k: {step}, {init}).o"
