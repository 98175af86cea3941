"""Vector operators: dot/normalise/arg-max, encoder hook, pooling, accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vellum.functions import arrays as A
from vellum.operators import vectors as V
from vellum.session import table


def test_argmax_first_rules(spark):
    rows = [([0.9, 0.9],), ([0.5, 0.9, 0.9],), ([1.0, float("nan"), 2.0],), ([3.0, 3.0, 3.0],)]
    df = spark.createDataFrame(rows, "s array<double>")
    got = [(r.a, r.t) for r in df.select(A.argmax_first("s").alias("a"), A.n_tied_max("s").alias("t")).collect()]
    assert [g[0] for g in got] == [0, 1, 1, 0]
    assert [int(np.argmax(np.array(r[0]))) for r in rows] == [0, 1, 1, 0]
    assert got[0][1] == 2 and got[3][1] == 3


def test_dot_and_normalize_match_numpy(spark):
    e = table(spark, SF_SMALL, "embeddings").limit(50).collect()
    df = spark.createDataFrame([(r.embedding, r.embedding[::-1]) for r in e], "a array<float>, b array<float>")
    got = df.select(A.dot("a", "b").alias("d"), A.l2_normalize("a").alias("u")).collect()
    for r, g in zip(e, got):
        a = np.array(r.embedding, dtype=np.float64)
        assert g.d == pytest.approx(float(a @ a[::-1]), rel=1e-12)
        assert np.allclose(np.array(g.u), a / max(np.linalg.norm(a), 1e-12))


def test_embed_batch_equals_direct_call(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = {r.doc_id: np.array(r.embedding) for r in V.embed(docs, "text", ["doc_id"], dim=32).collect()}
    pdf = docs.toPandas()
    direct = V.HashedEncoder(32)(pdf.text.tolist())
    assert len(got) == len(pdf)
    for i, k in enumerate(pdf.doc_id):
        assert np.allclose(got[k], direct[i])


def test_mean_and_cls_pooling(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [9.0, 9.0]), (1, 2, 1, [3.0, 4.0]), (2, 0, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "doc long, pos int, mask int, vec array<double>")
    mean = {r.doc: r.embedding and list(r.embedding) for r in V.pool_mean_masked(df, ["doc"]).collect()}
    assert mean == {1: [2.0, 3.0], 2: None}   # an all-masked text keeps its row
    cls = {r.doc: list(r.embedding) for r in V.pool_cls(df, ["doc"]).collect()}
    assert cls == {1: [1.0, 2.0], 2: [5.0, 5.0]}


def test_accuracy_invariant_to_positive_scale(spark):
    tv = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 1.0])],
                               "row_id long, run int, embedding array<double>")
    cands = spark.createDataFrame([(r, "c", p, v) for r in (1, 2, 3) for p, v in enumerate(["x", "y"])],
                                  "row_id long, attr string, cand_pos int, value string")
    cv = spark.createDataFrame([("c", "x", [1.0, 0.0]), ("c", "y", [0.0, 1.0])],
                               "attr string, value string, embedding array<double>")
    acc = V.attribute_accuracy(V.attribute_scores(tv, cands, cv)).collect()[0]
    scaled = tv.withColumn("embedding", F.transform("embedding", lambda x: x * 7.5))
    acc2 = V.attribute_accuracy(V.attribute_scores(scaled, cands, cv)).collect()[0]
    assert acc.accuracy == pytest.approx(2 / 3) and acc.n_tied == 1
    assert acc2.accuracy == acc.accuracy


def test_missing_vectors_fail_instead_of_scoring(spark):
    tv = spark.createDataFrame([(1, 0, [1.0, 0.0])], "row_id long, run int, embedding array<double>")
    cands = spark.createDataFrame([(1, "c", 0, "truth"), (1, "c", 1, "wrong")],
                                  "row_id long, attr string, cand_pos int, value string")
    cv = spark.createDataFrame([("c", "wrong", [1.0, 0.0])], "attr string, value string, embedding array<double>")
    with pytest.raises(Exception, match="no vector of candidate"):
        V.attribute_accuracy(V.attribute_scores(tv, cands, cv)).collect()
    # scores that lack the truth's position do not promote the next candidate
    scores = spark.createDataFrame([(1, "c", 0, 1, 0.5), (1, "c", 0, 2, 0.9)],
                                   "row_id long, attr string, run int, cand_pos int, score double")
    assert V.attribute_accuracy(scores).collect()[0].accuracy == 0.0


def test_broadcast_budget_and_shuffle_fallback(spark, monkeypatch):
    """Sizes are measured before broadcasting; with no budget the same
    candidate lists and scores come out of the shuffled joins."""
    import vellum.session as SES
    from vellum.plans import vectors_q as VQ

    assert SES.fits_broadcast(1000, 100)
    assert not SES.fits_broadcast(10**6, 1024 * 8)      # 1e6 prompts x 1,024 doubles

    def run():
        s = V.attribute_scores(VQ._run_vectors(spark, SF_SMALL), VQ._candidates(spark, SF_SMALL),
                               VQ._centroids(spark, SF_SMALL), normalize=True)
        return sorted((r.row_id, r.attr, r.run, r.cand_pos, round(r.score, 12)) for r in s.collect())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = run()
        monkeypatch.setattr(SES, "BROADCAST_MAX_BYTES", 0)
        assert run() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("width", [3, 1024])
def test_mean_vectors_add_up_in_two_levels(spark, monkeypatch, width):
    """Groups spread over tasks and Arrow batches, a hot one, masked ones, null keys and vectors."""
    rng = np.random.default_rng(width)
    rows = []
    for i in range(1200 if width == 3 else 200):
        key = (None if i % 50 == 7 else "hot" if i % 3 == 0 else f"k{i % 11}", i % 2)
        rows.append((*key, 0 if key[0] == "k4" else 1, None if i % 13 == 5 or key == ("k5", 1) else rng.normal(size=width).tolist()))
    df = spark.createDataFrame(rows, "k string, part int, mask int, vec array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.k, r.part): r.embedding for r in V.mean_vectors(df, ["k", "part"], "vec", F.col("mask") == 1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, part, mask, vec in rows:
        want.setdefault((k, part), []).extend([vec] if mask and vec else [])
    assert got.keys() == want.keys()
    for k, vecs in want.items():
        assert (got[k] is None) == (not vecs) and (not vecs or np.allclose(got[k], np.mean(vecs, axis=0)))
    plan = V.mean_vectors(df, ["k"], "vec")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    with pytest.raises(Exception, match="width"):
        V.mean_vectors(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, vec array<double>").repartition(2), ["k"], "vec").collect()
    assert V.mean_vectors(df.limit(0), ["k"], "vec").collect() == []


def _inference(spark):
    values = {"job": ["poet", "king", "baker", "smith"], "land": ["france", "chad", "peru"]}
    rng = np.random.default_rng(2)
    rows, preds = [], []
    for i in range(60):
        job, land = (list(rng.permutation(values[a])) for a in values)
        rows.append((i, [str(x) for x in job[:3]], None if i % 9 == 0 else [str(x) for x in land]))
        preds += [("d", i, r, f"The job is {rng.choice(job[:2])} of {land[r]}") for r in range(2)]
    return (spark.createDataFrame(rows, "row_id long, job_candidate_list array<string>, land_candidate_list array<string>"),
            spark.createDataFrame(preds, "dataset string, row_id long, run int, text string"), rows, preds)


def test_inference_by_matrix_product_equals_a_loop(spark, monkeypatch):
    import vellum.session as SES

    cands, preds, rows, texts = _inference(spark)
    encode = V.HashedEncoder(32, normalize=False)
    lists = {i: {"job": j, "land": n} for i, j, n in rows}
    want = {}
    for d, i, run, text in texts:
        t = encode([text])[0]
        for attr, values in lists[i].items():
            if values is not None:
                s = [float(t @ encode([f"The {attr} is {v}"])[0]) for v in values]
                n = want.setdefault((d, attr, run), [0, 0, 0])
                n[0] += 1
                n[1] += s.index(max(s)) == 0
                n[2] += s.count(max(s)) > 1
    make = lambda: V.HashedEncoder(32, normalize=False)

    def run():
        got = V.infer_attributes(preds, cands, ["job", "land"], make, 32).collect()
        return {(r.dataset, r.attr, r.run): [r.n_rows, round(r.accuracy * r.n_rows), r.n_tied] for r in got}

    assert run() == want
    monkeypatch.setattr(SES, "BROADCAST_MAX_BYTES", 900)  # prompts in several blocks
    assert run() == want
    monkeypatch.undo()
    with pytest.raises(Exception, match="no vector of the row"):
        V.infer_attributes(preds.where("row_id <> 5"), cands, ["job"], make, 32).collect()


def test_products_of_few_and_of_many_prompts():
    rng = np.random.default_rng(1)
    t, p = rng.normal(size=(50, 8)), rng.normal(size=(300, 8))
    for m in (5, 300):
        ids = rng.integers(-1, m, (50, 6))
        got = V.products(t, ids, p[:m])
        want = np.where(ids < 0, np.nan, np.einsum("nd,nkd->nk", t, p[np.maximum(ids, 0)]))
        assert np.allclose(got, want, equal_nan=True)
    best, tied = V.first_best(np.array([[1.0, np.nan, 2.0], [3.0, 3.0, 9.0]]), np.array([[True, True, True], [True, True, False]]))
    assert best.tolist() == [1, 0] and tied.tolist() == [1, 2]


def test_attach_by_position(spark):
    rng = np.random.default_rng(5)
    ids = [int(x) for x in rng.permutation(5000)[:700]]
    rows = spark.createDataFrame([(i, f"r{i}") for i in ids], "k long, name string").repartition(6)
    vecs = spark.createDataFrame([(float(v), [float(v)]) for v in rng.permutation(700)], "v double, embedding array<double>").repartition(4)
    got = V.attach_by_position(rows, vecs, ["k"], ["v"]).collect()
    assert sorted((r.i, r.k, r.v) for r in got) == [(i, k, float(i)) for i, k in enumerate(sorted(ids))]
    with pytest.raises(Exception, match="no counterpart"):
        V.attach_by_position(rows.where("k <> %d" % ids[0]), vecs, ["k"], ["v"]).collect()
    assert V.attach_by_position(rows.limit(0), vecs.limit(0), ["k"], ["v"]).collect() == []
