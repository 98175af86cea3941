"""Metrics against plain-Python models written from the published definitions,
golden values, and metamorphic properties."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_text import py_13a, py_pure_tokens
from vellum.functions import lcs as L
from vellum.operators import scoring as S


def py_ngrams(seg, max_order):
    """Multiset of all n-grams of orders 1..max_order."""
    return collections.Counter(tuple(seg[i:i + n]) for n in range(1, max_order + 1)
                               for i in range(len(seg) - n + 1))


def py_bleu(refs_corpus, preds, max_order=4):
    """Corpus BLEU from its definition: per order, clipped n-gram matches over
    possible n-grams summed over the corpus; geometric mean times the brevity
    penalty (shortest reference length per segment)."""
    match = collections.defaultdict(int)
    total = collections.defaultdict(int)
    hyp_len = ref_len = 0
    for refs, pred in zip(refs_corpus, preds):
        hyp = py_13a(pred)
        ref_toks = [py_13a(r) for r in refs]
        hyp_len += len(hyp)
        ref_len += min(map(len, ref_toks))
        for n in range(1, max_order + 1):
            h = collections.Counter(zip(*[hyp[i:] for i in range(n)]))
            best = collections.Counter()
            for r in ref_toks:
                for g, c in collections.Counter(zip(*[r[i:] for i in range(n)])).items():
                    best[g] = max(best[g], c)
            match[n] += sum(min(c, best[g]) for g, c in h.items())
            total[n] += max(len(hyp) - n + 1, 0)
    precs = [match[n] / total[n] if total[n] else 0.0 for n in range(1, max_order + 1)]
    if min(precs) <= 0:
        return 0.0
    score = math.exp(sum(map(math.log, precs)) / max_order)
    ratio = hyp_len / ref_len
    return score * (1.0 if ratio > 1.0 else math.exp(1 - 1 / ratio))


def py_f1(preds, labels):
    """Macro token precision/recall and the F1 of the two means."""
    ps, rs = [], []
    for p, l in zip(preds, labels):
        pt, lt = collections.Counter(py_pure_tokens(p)), collections.Counter(py_pure_tokens(l))
        np_, nl = sum(pt.values()), sum(lt.values())
        if np_ == 0 or nl == 0:
            ps.append(float(np_ == nl))
            rs.append(float(np_ == nl))
            continue
        common = sum(min(c, lt[t]) for t, c in pt.items())
        ps.append(common / np_)
        rs.append(common / nl)
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    return p, r, (2 * p * r / (p + r) if p + r else 0)


def py_lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def _pairs_df(spark, preds, refs):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip(preds, refs))],
                                 "row_id long, pred string, ref string")


def test_bleu_golden_multi_reference(spark):
    preds = ["hello there general kenobi", "foo bar foobar"]
    refs = [["hello there general kenobi", "hello there!"], ["foo bar foobar"]]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip(preds, refs))],
                               "row_id long, pred string, refs array<string>")
    got = S.bleu_multi(df).collect()[0]
    assert got.bleu == pytest.approx(1.0)
    assert got.bleu == pytest.approx(py_bleu(refs, preds))


def test_bleu_against_model_and_edges(spark):
    rnd = random.Random(11)
    words = "the a cat dog sat on mat , . 3.14 x-y".split()
    preds = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    refs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    preds += ["ab", "a much longer prediction than its reference here", "zzz qqq"]
    refs += ["ab cd ef gh", "short ref", "no overlap at all"]
    df = _pairs_df(spark, preds, refs)
    b = S.bleu_1_to_4(df).collect()[0]
    for k in range(1, 5):
        assert b[f"bleu{k}"] == pytest.approx(py_bleu([[r] for r in refs], preds, k), rel=1e-12, abs=1e-15)
    one = S.bleu(df).collect()[0]
    assert one.bleu == pytest.approx(b.bleu4)
    multi = S.bleu_multi(df.withColumn("refs", F.array("ref"))).collect()[0]
    assert multi.bleu == pytest.approx(one.bleu)


def test_bleu_identity_and_empty_prediction(spark):
    txt = ["a b c d e", "f g h i j k"]
    assert S.bleu(_pairs_df(spark, txt, txt)).collect()[0].bleu == pytest.approx(1.0)
    r = S.bleu(_pairs_df(spark, [""], ["a b c"])).collect()[0]
    assert r.bleu == 0.0 and r.translation_length == 0


def test_token_f1_edges_and_model(spark):
    preds = ["", "", "the cat sat", "a a b", "cat cat cat dog", "only the a"]
    refs = ["", "word", "the cat sat", "a a a", "cat dog dog", "the"]
    got = S.token_f1(_pairs_df(spark, preds, refs)).collect()[0]
    p, r, f = py_f1(preds, refs)
    assert (got.precision, got.recall, got.f1) == pytest.approx((p, r, f))
    same = S.token_f1(_pairs_df(spark, ["x y z"], ["x y z"])).collect()[0]
    assert same.f1 == pytest.approx(1.0)


def test_rouge_golden(spark):
    t = ["hello there", "general kenobi"]
    df = _pairs_df(spark, t, t)
    r = S.rouge(df, n_samples=200).collect()[0]
    for k in S.ROUGE_TYPES:
        assert r[k] == pytest.approx(1.0)


def test_lcs_matches_dynamic_program():
    rnd = random.Random(5)
    for _ in range(500):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        assert L.lcs_length(a, b) == py_lcs_dp(a, b)
        idx = L.lcs_indices(a, b)
        assert len(idx) == py_lcs_dp(a, b) and idx == sorted(idx)


def test_rouge_rows_against_model(spark):
    rnd = random.Random(9)
    words = "alpha beta gamma delta eps".split()
    preds = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    refs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    rows = S.rouge_rows(_pairs_df(spark, preds, refs), keep=["row_id"]).orderBy("row_id").collect()
    for row, p, r in zip(rows, preds, refs):
        pt, rt = p.split(), r.split()
        for n, key in ((1, "rouge1"), (2, "rouge2")):
            pg, rg = py_ngrams(pt, n) - py_ngrams(pt, n - 1), py_ngrams(rt, n) - py_ngrams(rt, n - 1)
            ov = sum((pg & rg).values())
            pp, rr = ov / max(sum(pg.values()), 1), ov / max(sum(rg.values()), 1)
            assert row[key] == pytest.approx(2 * pp * rr / (pp + rr) if pp + rr else 0.0)
        lcs = py_lcs_dp(rt, pt)
        exp_l = 0.0 if not pt or not rt else (2 * (lcs / len(pt)) * (lcs / len(rt)) /
                                              ((lcs / len(pt)) + (lcs / len(rt))) if lcs else 0.0)
        assert row.rougeL == pytest.approx(exp_l)
        assert row.rougeLsum == pytest.approx(row.rougeL)   # no newline: Lsum equals L


def test_registered_rouge_l_queries_against_python(spark):
    """The registered LCS queries (no SQL twin) against brute force on sf0.001."""
    import pandas as pd

    from vellum.plans import scores_q

    conv = pd.read_parquet(f"{SF_SMALL}/conversations.parquet")
    nxt = conv.assign(turn=conv.turn - 1)[["conv_id", "turn", "text"]].rename(columns={"text": "pred"})
    pairs = conv.merge(nxt, on=["conv_id", "turn"])
    got = {r.pair_id: r for r in scores_q.metric_rouge_lsum(spark, SF_SMALL).collect()}
    assert len(got) == len(pairs)
    import re

    def tok(s):
        return [x for x in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", s.lower())) if x]

    for row in pairs.itertuples():
        key = f"{row.conv_id}:{row.turn}"
        rt, pt = tok(row.text), tok(row.pred)
        lcs = py_lcs_dp(rt, pt)
        exp = 0.0 if not lcs else 2 * (lcs / len(pt)) * (lcs / len(rt)) / (lcs / len(pt) + lcs / len(rt))
        assert got[key].rougeL == pytest.approx(round(exp, 9), abs=1e-9)
        ref_s = [tok(s) for s in row.text.split("\n") if s]
        pred_s = [tok(s) for s in row.pred.split("\n") if s]
        assert got[key].rougeLsum == pytest.approx(round(L.union_lcs_f(ref_s, pred_s), 9), abs=1e-9)


def test_union_lcs_model_example():
    ref = [["a", "b", "c"], ["d", "e"]]
    pred = [["a", "x", "c"], ["b", "e"]]
    # union LCS of ref sentence 1 with both predictions covers a, b, c; sentence 2 gets e
    assert L.union_lcs_f(ref, pred) == pytest.approx(L.fmeasure(4 / 5, 4 / 5))


def test_bootstrap_interval_order(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"),
                                   (F.col("id") % 7 / 7.0).alias("s"))
    b = S.bootstrap_mid(rows, "k", ["s"], n_samples=300).collect()[0]
    assert b.s_low <= b.s <= b.s_high
    assert abs(b.s - 3 / 7 * (6 / 6)) < 0.1


def test_choice_accuracy_ties_first(spark):
    rows = [(1, 0, 0.9), (1, 1, 0.9), (2, 0, 0.5), (2, 1, 0.9), (2, 2, 0.9), (3, 0, float("nan")), (3, 1, 5.0)]
    df = spark.createDataFrame(rows, "g long, cand_pos int, score double")
    got = S.choice_accuracy(df, "g").collect()[0].exact_match
    assert got == pytest.approx(2 / 3)   # group 1 tie -> 0, group 2 -> 1, group 3 NaN wins -> 0


def test_nanmean_and_perplexity(spark):
    df = spark.createDataFrame([(1, [1, -100, 1, 1], [2.0, 9.0, 0.0, 4.0]), (2, [-100], [1.0])],
                               "k long, labels array<int>, v array<double>")
    got = {r.k: r.mean_logit for r in S.nanmean_logit(df, "labels", "v", ["k"]).collect()}
    assert got == {1: pytest.approx(3.0), 2: None}
    loss = spark.createDataFrame([(1.0,), (3.0,)], "loss double")
    assert S.perplexity(loss).collect()[0].perplexity == pytest.approx(math.exp(2.0))
    with pytest.raises(KeyError):
        S.perplexity(loss.withColumnRenamed("loss", "x"))


def test_lcs_sql_twin_against_model():
    """The DuckDB twin of ROUGE-L/Lsum (list folds for the LCS table and its
    backtrack, multiset form of the union-LCS hits) against the Python model on
    random multi-sentence pairs with many repeated tokens."""
    import duckdb
    import pandas as pd

    from vellum.plans import scores_q

    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "e"]

    def text():
        return "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 7)))
                         for _ in range(rng.randint(0, 4)))

    df = pd.DataFrame({"dataset": "x", "pair_id": [str(i) for i in range(300)],
                       "ref": [text() for _ in range(300)], "pred": [text() for _ in range(300)]})
    con = duckdb.connect()
    con.register("fixture", df)
    sql = scores_q._rouge_l_rows_sql("SELECT dataset, pair_id, ref, pred FROM fixture", "dataset, pair_id")
    got = {r[1]: r for r in con.sql(sql).fetchall()}
    assert len(got) == len(df)
    for row in df.itertuples():
        rt, pt = row.ref.split(), row.pred.split()
        assert got[row.pair_id][2] == pytest.approx(L.lcs_f(rt, pt), abs=1e-12)
        ref_s = [s.split() for s in row.ref.split("\n") if s]
        pred_s = [s.split() for s in row.pred.split("\n") if s]
        assert got[row.pair_id][3] == pytest.approx(L.union_lcs_f(ref_s, pred_s), abs=1e-12)


def test_lcs_table_and_backtrack_against_plain_dp():
    """The vectorised LCS table equals the textbook recurrence cell by cell, and
    the backtrack picks the same positions as a plain-Python walk."""
    def plain(ref, can):
        t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
        for i in range(1, len(ref) + 1):
            for j in range(1, len(can) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == can[j - 1] else max(t[i - 1][j], t[i][j - 1])
        i, j, out = len(ref), len(can), []
        while i > 0 and j > 0:
            if ref[i - 1] == can[j - 1]:
                out.append(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return t, out[::-1]

    rng = random.Random(5)
    for _ in range(300):
        ref = [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        can = [rng.choice("abcde") for _ in range(rng.randint(0, 15))]
        t, idx = plain(ref, can)
        rows = L.lcs_rows(ref, can)
        assert [[j - (r & ((1 << j) - 1)).bit_count() for j in range(len(can) + 1)] for r in rows] == t
        assert L.lcs_indices(ref, can) == idx


def test_ngram_overlaps_are_exact_multiset_intersections(spark):
    """Counter & Counter of the n-grams, with heavy repeats, empty sides and long runs."""
    from vellum.functions.overlap import ngram_overlaps

    rng = random.Random(13)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 30))])
            for _ in range(200)]
    rows += [([], []), (["a"] * 2000, ["a"] * 1500 + ["b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r.o for r in df.select(ngram_overlaps("a", "b", [1, 2, 4]).alias("o")).collect()]

    def model(a, b, n):
        grams = [collections.Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (a, b)]
        return sum((grams[0] & grams[1]).values())

    assert got[-1] is None
    assert [list(o) for o in got[:-1]] == [[model(a, b, n) for n in (1, 2, 4)] for a, b in rows[:-1]]


def test_union_lcs_of_very_long_sentences():
    """A 20,000-token pair stays within bounded memory."""
    import tracemalloc

    rng = random.Random(3)
    ref = [rng.choice("abcdefgh") for _ in range(20_000)]
    can = [t for t in ref if rng.random() < 0.9]
    tracemalloc.start()
    idx = L.lcs_indices(ref, can)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(idx) == L.lcs_length(ref, can) == len(can) and peak < 200e6


def test_bootstrap_sums_equal_a_plain_loop(spark):
    rows = [(f"k{i}", "g" if i % 3 else None, i / 7, None if i == 4 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, g string, s double, t double").repartition(3)
    w = S.bootstrap_weights(5, [r[0] for r in rows], 101)
    got = {r.g: r for r in S.bootstrap_mid(df, "k", ["s", "t"], ["g"], n_samples=101, seed=5).collect()}
    import numpy as np
    for g in ("g", None):
        at = [i for i, r in enumerate(rows) if r[1] == g]
        means = sorted((w[at, b] * [rows[i][2] for i in at]).sum() / w[at, b].sum() for b in range(101))
        assert got[g].s == pytest.approx(np.median(means))
    assert abs(w.mean() - 1) < 0.05


def test_rouge_multi_reference_all_types_and_no_reference(spark):
    df = spark.createDataFrame([(1, "a b c", ["a b", "x"]), (2, "a b c", []), (3, "a b", None)],
                               "row_id long, pred string, refs array<string>")
    rows = {r.row_id: r for r in S.rouge_rows_multi(df).collect()}
    assert set(rows) == {1, 2, 3}
    one = S.rouge_rows(spark.createDataFrame([(1, "a b c", "a b")], "row_id long, pred string, ref string"), keep=["row_id"]).collect()[0]
    for t in S.ROUGE_TYPES:
        assert rows[1][t] == pytest.approx(one[t]) and rows[2][t] is None and rows[3][t] is None


@pytest.mark.parametrize("most,at_once", [(1 << 62, 2_000_000), (1 << 30, 50), (1 << 12, 300)])
def test_columnar_counts_with_several_references(monkeypatch, most, at_once):
    """Numbers that are ranked when they get too large, batches cut into parts, null lists and tokens."""
    import numpy as np
    import pyarrow as pa

    from vellum.functions import overlap as O

    rng = random.Random(most)
    monkeypatch.setattr(O, "_MOST", most)
    monkeypatch.setattr(O, "TOKENS_AT_ONCE", at_once)

    def tokens():
        return [rng.choice([None, *(f"t{k}" for k in range(rng.choice([1, 5, 40])))]) for _ in range(rng.choice([0, 1, 3, 20, 60]))]

    rows = [(None if i % 37 == 5 else tokens(), None if i % 41 == 3 else [tokens() for _ in range(rng.choice([0, 1, 1, 3]))]) for i in range(200)]
    a, refs = pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.string())))
    orders = (1, 2, 4)
    many, lists = O._lengths(refs), refs.flatten()
    row = np.repeat(np.arange(len(a)), many)
    side = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1
    got = O._counted(a, lists, O._lengths(lists), row, side, O._nulls(a) | O._nulls(refs), orders).to_pylist()

    def grams(x, n):
        return collections.Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))

    def model(x, rs, n):
        best = collections.Counter()
        for r in rs:
            best |= grams(r, n)
        return sum((grams(x, n) & best).values())

    assert got == [None if x is None or rs is None else [model(x, rs, n) for n in orders] for x, rs in rows]


def test_bleu_multi_shuffles_no_ngrams(spark):
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d", "b c d e f"])] * 3, "row_id long, pred string, refs array<string>")
    plan = S.bleu_counts_multi(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    r = S.bleu_counts_multi(df).first()
    assert (r.m1, r.p1, r.m2, r.m4, r.reference_length, r.translation_length) == (15, 15, 12, 6, 12, 15)


@pytest.mark.parametrize("at_once", [1, 5, 1000])
def test_lcs_rows_of_slices_and_empty_lists(at_once, monkeypatch):
    """Whatever rows are read together, and where a side of them has no list or no token."""
    import pyarrow as pa

    monkeypatch.setattr(L, "TOKENS_AT_ONCE", at_once)
    flat = [["a", "b"], [], ["c"], ["b", "a", "b"], []]
    both = list(zip(flat, [["b"], [], [], ["a", "b"], ["x"]]))
    got = [L.lcs_f(r, p) for r, p in L._rows(*(pa.array(list(x), pa.list_(pa.string())) for x in zip(*both)))]
    assert got == [L.lcs_f(r, p) for r, p in both]
    nested = [([["a", "b"], ["c"]], [["c", "a"]]), ([], []), ([[]], [["x"]]), ([], [["x"], ["y"]]), ([["q"]], [])]
    kind = pa.list_(pa.list_(pa.string()))
    for rows in (nested, nested[1:2], nested[3:]):
        got = [L.union_lcs_f(r, p) for r, p in L._sentence_rows(*(pa.array(list(x), kind) for x in zip(*rows)))]
        assert got == [L.union_lcs_f(r, p) for r, p in rows]
