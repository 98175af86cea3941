"""Python-semantics text expressions against plain-Python models."""

import random
import re
import string

from pyspark.sql import functions as F

from tests.conftest import one_col
from vellum.functions import text as T

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def py_balanced(text):
    opens, closes, stack = "[{(", "]})", []
    for c in text:
        if c in opens:
            stack.append(c)
        elif c in closes:
            if stack and opens[closes.index(c)] == stack[-1]:
                stack.pop()
            else:
                return False
    return len(stack) == 0


def test_whitespace_set_is_python():
    assert sorted(T.PY_WHITESPACE) == sorted(WS)
    assert len(T.PY_WHITESPACE) == 29


def test_strip_split_match_python(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", "é", "1", ",", "."] + WS
    vals = ["", " ", "a", "  a b  "] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
                                        for _ in range(300)]
    df = one_col(spark, vals).select("t", T.strip("t").alias("s"), T.split_ws("t").alias("w"),
                                     T.word_count("t").alias("n"), T.collapse_ws("t").alias("c"))
    for r in df.collect():
        assert r.s == r.t.strip()
        assert list(r.w) == r.t.split()
        assert r.n == len(r.t.split())
        assert r.c == re.sub(r"\s+", " ", r.t)


def test_word_count_edges(spark):
    words = lambda n: " ".join(["w"] * n)
    vals = [words(7), words(8), words(128), words(129), "", "   ", "a b c\u0085d\x1ce"]
    got = [r.n for r in one_col(spark, vals).select(T.word_count("t").alias("n")).collect()]
    assert got == [7, 8, 128, 129, 0, 0, 5]


def test_balanced_edges_and_random(spark):
    fixed = ["a(b[c]{d})", "a)b(", "((a)", "([)]", "", "{}[]()"]
    rnd = random.Random(3)
    vals = fixed + ["".join(rnd.choice("([{}])ab") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    got = [r.b for r in one_col(spark, vals).select(T.is_balanced("t").alias("b")).collect()]
    assert got == [py_balanced(v) for v in vals]
    assert got[:6] == [True, False, False, False, True, True]


def test_leading_punct(spark):
    vals = list(string.punctuation) + ["“q", "éa", "9a", "a"]
    got = [r.p for r in one_col(spark, [v + "x" for v in vals]).select(T.starts_with_punct("t").alias("p")).collect()]
    assert got == [True] * 32 + [False] * 4


def test_sentence_clean(spark):
    ok = "This is a perfectly fine sentence with eight words."
    vals = [ok, "(" + ok, ok + "\nmore", "Too short here.", ok + " (unbalanced"]
    got = [r.c for r in one_col(spark, vals).select(T.sentence_clean("t", 8, 128).alias("c")).collect()]
    assert got == [True, False, False, False, False]


def test_split_period(spark):
    df = one_col(spark, ["", "A. B. C.", "A. "]).select(T.split_period("t").alias("p"))
    got = [list(r.p) for r in df.collect()]
    exp = []
    for v in ["", "A. B. C.", "A. "]:
        parts = v.split(". ")
        exp.append([s + "." for s in parts[:-1]] + [parts[-1]])
    assert got == exp


def test_title_and_capitalize(spark):
    vals = ["john o'neil mc-donald", "3rd street", "ÉCOLE normale"]
    got = [r.x for r in one_col(spark, vals).select(T.title("t").alias("x")).collect()]
    assert got == [v.title() for v in vals]
    df = one_col(spark, ["the mayor met may", "nothing"]).select(T.capitalize_terms("t", T.MONTHS).alias("x"))
    assert [r.x for r in df.collect()] == ["the Mayor met May", "nothing"]


def test_extract_year(spark):
    vals = ["born 1950", "12345", "1950-1960", "١٩٥٠", "n/a"]
    got = [r.y for r in one_col(spark, vals).select(T.extract_year("t").alias("y")).collect()]
    exp = []
    for v in vals:
        m = re.findall(r"\b\d{4}\b", v)
        exp.append(m[0] if m else None)
    assert got == exp


def test_occupation_split_and_digits(spark):
    v = "brand manager, poet and writer, "
    got = one_col(spark, [v]).select(T.split_occupation("t").alias("p")).collect()[0].p
    assert list(got) == [x.strip() for x in re.split("; |, |and |/ |&", v)]
    vals = ["abc", "a2", "x²", "①", "٣"]
    got = [r.d for r in one_col(spark, vals).select(T.has_digit("t").alias("d")).collect()]
    assert got == [any(ch.isdigit() for ch in v) for v in vals]


def py_13a(line):
    """mteval-13a in plain Python: markup and entity clean-up, then the
    module's fixed regex rules with Python replacement syntax, then split."""
    for src, dst in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        line = line.replace(src, dst)
    if "&" in line:
        for src, dst in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            line = line.replace(src, dst)
    line = " " + line + " "
    for pattern, repl in T.TOK13A_RULES:
        line = re.sub(pattern, repl.replace("$", "\\"), line)
    return line.split()


def test_tok_13a(spark):
    vals = ["Hello, world! It's 3.14, ok.", "1-2 a-b 3- x", "&lt;b&gt; &amp;quot;", "cut-\nting",
            "".join(chr(c) for c in range(32, 127))]
    got = [list(r.k) for r in one_col(spark, vals).select(T.tok_13a("t").alias("k")).collect()]
    assert got == [py_13a(v) for v in vals]


def test_tok_rouge(spark):
    vals = ["Hello, World! 3.14", "", "ÉA b_c"]
    got = [list(r.k) for r in one_col(spark, vals).select(T.tok_rouge("t").alias("k")).collect()]
    exp = [[x for x in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", v.lower())) if x] for v in vals]
    assert got == exp


def py_pure_tokens(text):
    """Lower, remove ASCII punctuation, blank stop words as whole Unicode words."""
    table = str.maketrans("", "", string.punctuation)
    cleaned = text.lower().translate(table)
    stop = set(T.STOPWORDS_EN)
    words = re.split(r"(\w+)", cleaned)          # odd positions are word runs
    return "".join(" " if (i % 2 and w in stop) else w for i, w in enumerate(words)).split()


def test_pure_tokens(spark):
    vals = ["The cat, and THE dog!", "don't stop", "d’un éa thé a", "only the a an", ""]
    got = [list(r.k) for r in one_col(spark, vals).select(T.pure_tokens("t").alias("k")).collect()]
    assert got == [py_pure_tokens(v) for v in vals]


def test_final_period_and_untokenize(spark):
    df = one_col(spark, ["done.", "not done", "x -lrb- y -rrb- , z ."])
    got = df.select(T.final_period("t").alias("a"), T.untokenize("t").alias("b")).collect()
    assert [r.a for r in got] == ["done.", "not done.", "x -lrb- y -rrb- , z ."]
    assert got[2].b == "x (y) , z.".replace(" ,", ",")
    assert F is not None


def test_word_count_stripped_equals_python_split(spark):
    """On stripped text, the lambda-free word count equals len(str.split())."""
    import random

    rng = random.Random(3)
    alphabet = ["a", "b", ".", "(", " ", " ", " ", "\t", "\n", "\x1c", "　", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))).strip() for _ in range(400)]
    texts += ["", "a", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(T.word_count_stripped("t").alias("n")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_title_entities_replace_all_in_order(spark):
    rows = [("ann lee met o'neil and ann", ["ann lee", "o'neil", "ann"]), ("x", None), ("x y", []), (None, ["x"]), ("a b", ["", "b"])]
    df = spark.createDataFrame(rows, "t string, e array<string>")
    got = [r.o for r in df.select(T.title_entities("t", "e").alias("o")).collect()]

    def model(t, e):
        for x in e or []:
            t = t.replace(x, x.title()) if x and t is not None else t
        return t

    assert got == [model(t, e) for t, e in rows]
