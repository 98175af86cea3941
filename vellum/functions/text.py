"""Column -> Column text expressions with Python string semantics.

Spark's ``trim``, ``\\s``, ``initcap`` and ``\\d`` differ from Python's
``strip``/``split``/``title``/``isdigit``. Every operator that must agree with a
Python definition goes through this module, and every function here returns a
plain Catalyst expression (regex, higher-order array functions), so it stays in
whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The 29 code points Python's str.split()/str.strip()/re "\s" treat as white
# space, in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Python's string.punctuation (the 32 printable ASCII punctuation marks).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# English stop-word list of the NLTK corpus, in its published order.
STOPWORDS_EN = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don don't should "
    "should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't "
    "doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn "
    "wasn't weren weren't won won't wouldn wouldn't"
).split()
# Month names capitalised in rendered biographies.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]
# mteval-13a post-tokenizer: (pattern, replacement) applied in this order.
TOK13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# Separators of multi-valued occupations (not word-bounded).
OCCUPATION_SEPARATORS = r"; |, |and |/ |&"
# ---------------------------------------------------------------------------

WS_CLASS = "[" + PY_WHITESPACE + "]"
WORD_CLASS = r"[\p{L}\p{N}_]"
LEADING_PUNCT = r"^[!-/:-@\[-`{-~]"
BRACKETS = r"[\[\](){}]"
SENTENCE_BREAK = r"(?<=[.!?])" + WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def _blanks(c) -> Column:
    """Every white-space character as a blank: ``split`` compiles its pattern for
    each row, and " +" is much shorter than the class of all of them."""
    return F.translate(_c(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))


def strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a set of literal characters."""
    cls = "[" + "".join("\\" + ch if ch in "\\^-[]" else ch for ch in chars) + "]"
    return F.regexp_replace(_c(c), f"^{cls}+|{cls}+\\z", "")


def split_ws(c) -> Column:
    """Python ``str.split()`` (no argument): array of non-empty words."""
    return F.filter(F.split(_blanks(c), " +"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(split_ws(c))


def word_count_stripped(c) -> Column:
    """``len(t.split())`` for a text that is already stripped: no edge white
    space means no empty pieces, so no per-piece filter is needed."""
    return F.when(_c(c) == "", 0).otherwise(F.size(F.split(_blanks(c), " +")))


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', t)``."""
    return F.regexp_replace(_c(c), WS_CLASS + "+", " ")


def first_line(c) -> Column:
    """``t.split('\\n')[0]``."""
    return F.substring_index(_c(c), "\n", 1)


def is_balanced(c) -> Column:
    """Brackets ``[]{}()`` close in order; leftovers count as unbalanced."""
    marks = F.regexp_extract_all(_c(c), F.lit(BRACKETS), 0)

    def push_pop(stack, ch):
        top = F.substring(stack, -1, 1)
        closes = (
            ((ch == ")") & (top == "("))
            | ((ch == "]") & (top == "["))
            | ((ch == "}") & (top == "{"))
        )
        return (
            F.when(stack == "!", stack)
            .when(ch.isin("(", "[", "{"), F.concat(stack, ch))
            .when(closes, stack.substr(F.lit(1), F.length(stack) - 1))
            .otherwise(F.lit("!"))
        )

    return F.aggregate(marks, F.lit(""), push_pop) == ""


def starts_with_punct(c) -> Column:
    return _c(c).rlike(LEADING_PUNCT)


def sentence_clean(c, min_words: int = 5, max_words: int = 128, stripped: bool = False, n_words: Column | None = None) -> Column:
    """Sentence quality predicate: length band, no leading punctuation, no
    newline, balanced brackets (cheap tests first; And short-circuits).
    ``stripped=True`` skips the (idempotent) strip for already-stripped text;
    ``n_words`` is its word count where that is known."""
    s = _c(c) if stripped else strip(c)
    n = word_count_stripped(s) if n_words is None else n_words
    return (
        ~s.contains("\n")
        & ~starts_with_punct(s)
        & n.between(min_words, max_words)
        & is_balanced(s)
    )


def split_sentences(c) -> Column:
    """Default sentence rule: break after ``.``, ``!`` or ``?`` plus white space."""
    return F.split(_c(c), SENTENCE_BREAK)


def split_period(c) -> Column:
    """``t.split('. ')`` with the period put back on every piece but the last."""
    parts = F.split(_c(c), r"\. ")
    head = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.concat(s, F.lit(".")))
    return F.concat(head, F.slice(parts, -1, 1))


def tok_13a(c) -> Column:
    """mteval-13a tokenizer; returns the token array."""
    line = F.replace(_c(c), F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    ent = line
    for src, dst in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        ent = F.replace(ent, F.lit(src), F.lit(dst))
    line = F.when(line.contains("&"), ent).otherwise(line)
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pat, rep in TOK13A_RULES:
        line = F.regexp_replace(line, pat, rep)
    return split_ws(line)


def tok_rouge(c) -> Column:
    """Default ROUGE tokenizer: lower, non ``[a-z0-9]`` runs to blanks, split."""
    t = F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def stopword_pattern(words=None) -> str:
    words = STOPWORDS_EN if words is None else words
    alt = "|".join(words)
    return f"(?<!{WORD_CLASS})(?:{alt})(?!{WORD_CLASS})"


def pure_tokens(c, stopwords=None) -> Column:
    """Token-F1 tokens: lower, drop ASCII punctuation, blank out stop words
    (whole words, Unicode word characters), split on white space."""
    t = F.translate(F.lower(_c(c)), PUNCTUATION, "")
    t = F.regexp_replace(t, stopword_pattern(stopwords), " ")
    return split_ws(t)


def capitalize(c) -> Column:
    """Python ``str.capitalize()``."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def title(c) -> Column:
    """Python ``str.title()``: a letter run starts upper-case, the rest lower."""
    pieces = F.split(_c(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, capitalize), "")


def capitalize_terms(c, terms) -> Column:
    """Replace every occurrence of each term (in order) by its capitalised form,
    also inside longer words; ``terms`` is a Python list or an array Column."""
    arr = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms])
    return F.aggregate(arr, _c(c), lambda t, w: F.replace(t, w, capitalize(w)))


def title_entities(c, entities) -> Column:
    """Replace every occurrence of each entity (array column, in order) by its
    title-cased form; a NULL or empty array leaves the text as it is."""
    found = F.filter(F.coalesce(_c(entities), F.array().cast("array<string>")), lambda e: F.length(e) > 0)
    return F.aggregate(found, _c(c), lambda t, e: F.replace(t, e, title(e)))


def untokenize(c) -> Column:
    """Undo the PTB bracket/punctuation spacing of biography first lines."""
    t = _c(c)
    for src, dst in (("-lrb- ", "("), (" -rrb-", ")"), (" ,", ","), (" .", ".")):
        t = F.replace(t, F.lit(src), F.lit(dst))
    return t


def _python_extra_digits() -> str:
    """Regex class body of the characters Python's ``isdigit`` accepts beyond
    general category Nd (superscripts, circled digits, ...), derived by rule."""
    import unicodedata

    cps = [cp for cp in range(0x110000)
           if chr(cp).isdigit() and unicodedata.category(chr(cp)) != "Nd"]
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:X}}}" + (f"-\\x{{{cps[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


DIGIT_CLASS = "[\\p{Nd}" + _python_extra_digits() + "]"


def has_digit(c) -> Column:
    """Python ``any(ch.isdigit() for ch in t)``."""
    return _c(c).rlike(DIGIT_CLASS)


def extract_year(c) -> Column:
    """First stand-alone run of four decimal digits, else NULL."""
    return F.nullif(F.regexp_extract(_c(c), r"(?U)\b(\d{4})\b", 1), F.lit(""))


def split_occupation(c) -> Column:
    """``re.split('; |, |and |/ |&', t)`` with every piece stripped."""
    return F.transform(F.split(_c(c), OCCUPATION_SEPARATORS), strip)



def final_period(c) -> Column:
    """Append a period unless the text already ends with one."""
    c = _c(c)
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def strip_punct(c) -> Column:
    return F.translate(_c(c), PUNCTUATION, "")
