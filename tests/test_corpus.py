"""Corpus operators: ordinals, splits, bands, dedup, partition invariance."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vellum.operators import corpus as C
from vellum.session import table


def _ids(spark, n, parts):
    return spark.range(n).withColumnRenamed("id", "k").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ordinal_equals_full_sort_and_is_partition_invariant(spark, parts):
    df = C.seeded_order(_ids(spark, 1000, parts), 2023, ["k"])
    got = {r.k: r.ord for r in df.collect()}
    exp = sorted(range(1000), key=lambda k: (hashlib.md5(f"2023:{k}".encode()).hexdigest(), k))
    assert got == {k: i for i, k in enumerate(exp)}


def test_split_by_sizes(spark):
    o = C.seeded_order(_ids(spark, 100, 4), 1, ["k"])
    s = C.split_by_sizes(o, {"train": 60, "valid": 25, "test": 15})
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 60, "valid": 25, "test": 15}
    assert s.select("k").distinct().count() == 100
    less = C.split_by_sizes(o, {"train": 10, "valid": 0, "test": 5})
    assert {r.split: r["count"] for r in less.groupBy("split").count().collect()} == {"train": 10, "test": 5}
    with pytest.raises(ValueError, match="do not fit a table of 100 rows"):
        C.split_by_sizes(o, {"train": 90, "valid": 20, "test": 0})


def test_length_bands_are_strict(spark):
    df = spark.createDataFrame([(n,) for n in (35, 36, 49, 50, 65, 66)], "n int")
    med = [r.n for r in df.where(C.length_band(F.col("n"), "medium")).collect()]
    lng = [r.n for r in df.where(C.length_band(F.col("n"), "long")).collect()]
    assert med == [36, 49] and lng == [66]


def test_md5_dedup_keeps_smallest_id(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, "x"), (4, "z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in C.md5_dedup(df).collect()) == [1, 2, 4]


def test_sentences_and_clean(spark):
    docs = table(spark, SF_SMALL, "documents")
    s = C.sentences(docs, keep=["doc_id"])
    c = C.clean_sentences(s)
    assert c.where(F.col("n_words") < 8).count() == 0
    assert c.where(F.col("text").contains("\n")).count() == 0
    assert s.count() >= docs.count()


def test_join_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("  x \n\ny",), ("",)], "t string")
    got = [r.j for r in df.select(C.join_lines(F.col("t")).alias("j")).collect()]

    def model(content):
        text = ""
        for line in content.splitlines(keepends=True):
            text = text + line.strip("\n") + " "
        return text.strip()

    assert got == [model(v) for v in ["a\nb\n", "  x \n\ny", ""]]


def _keyed(spark, n, seed=7):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 80).cast("int").alias("n_words"))
    return df.withColumn("_h", C.order_key(seed, "k"))


def test_remainder_bands_take_rows_after_cap(spark):
    keyed = _keyed(spark, 3000)
    whole = {r.k: r.ord for r in C.with_ordinal(keyed, "_h", ["k"]).collect()}
    for cap, size in ((100, 20), (0, 5), (2990, 20), (5000, 3), (100, 10_000)):
        rows = C.remainder_bands(keyed, cap, ["medium", "long"], size, "_h", ["k"]).collect()
        for name, ok in (("medium", lambda n: 35 < n < 50), ("long", lambda n: n > 65)):
            want = sorted((o, k) for k, o in whole.items() if o >= cap and ok(k % 80))[:size]
            got = sorted((r.ord, r.k, r.band_ord) for r in rows if r.band == name)
            assert got == [(o, k, i) for i, (o, k) in enumerate(want)]


def test_range_of_an_order_numbers_its_buckets_alone(spark, monkeypatch):
    keyed = _keyed(spark, 2500)
    whole = {r.k: r.ord for r in C.with_ordinal(keyed, "_h", ["k"]).collect()}
    for target in (50_000, 3):
        monkeypatch.setattr(C, "ORDINAL_TARGET_ROWS", target)
        for start, stop in ((0, 10), (1200, 1300), (2490, 9999), (5, 5), (3000, 3001)):
            got = {r.k: r.ord for r in C.ordinal_range(keyed, start, stop, "_h", ["k"]).collect()}
            assert got == {k: o for k, o in whole.items() if start <= o < stop}
    plan = C.ordinal_range(keyed, 0, 10, "_h", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "substring" in below.lower().split("join")[-1] or "Filter" in below


def test_shuffled_splits_equal_splits_of_the_numbered_table(spark):
    keyed = _keyed(spark, 700)
    sizes = {"train": 60, "valid": 0, "test": 15}
    a = C.shuffled_splits(keyed, sizes, "_h", ["k"])
    b = C.split_by_sizes(C.with_ordinal(keyed, "_h", ["k"]), sizes)
    assert sorted((r.k, r.ord, r.split) for r in a.collect()) == sorted((r.k, r.ord, r.split) for r in b.collect())
    with pytest.raises(ValueError):
        C.shuffled_splits(keyed, {"train": 701}, "_h", ["k"])


def test_ordinal_one_and_two_level_prefix_sums(spark):
    """Every bucket width (single running sum up to 4 hex digits, two-level
    sum beyond) gives the rank of (hash, key) in a plain sort."""
    df = spark.range(3000).withColumn("_h", C.order_key(7, "id"))
    exp = [r.id for r in df.orderBy("_h", "id").collect()]
    for digits in (1, 3, 5, 6):
        got = C.with_ordinal(df, "_h", ["id"], bucket_hex=digits).orderBy("ord").collect()
        assert [r.ord for r in got] == list(range(len(exp)))
        assert [r.id for r in got] == exp
    assert C.ordinal_bucket_hex(1_000, 8) == 2            # 32 buckets wanted -> 256
    assert C.ordinal_bucket_hex(5 * 10**11, 1000) == 6    # 1e7 buckets wanted <= 16**6
    assert C.ordinal_bucket_hex(10**20, 8) == C.ORDINAL_MAX_HEX


def test_grouped_ordinal_restarts_per_group(spark):
    """With group keys the ordinal is the rank inside each group, on both the
    one-level and the two-level prefix sum (one group holds most rows)."""
    df = (spark.range(3000).withColumn("_h", C.order_key(11, "id"))
          .withColumn("g", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") / 500).cast("int")))))
    rows = sorted(df.collect(), key=lambda r: (r._h, r.id))
    exp, seen = {}, {}
    for r in rows:
        exp[r.id] = seen.get(r.g, 0)
        seen[r.g] = exp[r.id] + 1
    for digits in (2, 6):
        got = {r.id: r.ord for r in C.with_ordinal(df, "_h", ["id"], bucket_hex=digits, by=["g"]).collect()}
        assert got == exp


def test_boundaries_are_refined_until_their_bucket_is_small(spark, monkeypatch):
    keyed = _keyed(spark, 3000)
    whole = {r.k: r.ord for r in C.with_ordinal(keyed, "_h", ["k"]).collect()}
    monkeypatch.setattr(C, "RANGE_HEX", 1)
    for most in (1, 5, 5000):
        monkeypatch.setattr(C, "BOUNDARY_ROWS", most)
        order = C.HashOrder(keyed, "_h", ["k"])
        assert order.n_rows == 3000
        ranks = [0, 1, 777, 2999]
        for r, b in zip(ranks, order.boundaries(ranks)):
            assert b.before <= r < b.before + b.rows <= 3000 and (b.rows <= most or len(b.prefix) == 1)
        for start, stop in ((0, 3), (776, 1234), (2990, 4000)):
            assert {r.k: r.ord for r in order.range(start, stop).collect()} == {k: o for k, o in whole.items() if start <= o < stop}
    monkeypatch.setattr(C, "BOUNDARY_ROWS", 1)
    same = spark.range(50).select(F.col("id").alias("k"), F.lit("0" * 32).alias("_h"))  # no prefix tells them apart
    assert [r.k for r in C.HashOrder(same, "_h", ["k"]).range(10, 13).orderBy("ord").collect()] == [10, 11, 12]
    assert C.HashOrder(same.limit(0), "_h", ["k"]).range(0, 5).count() == 0


def test_splits_split_the_texts_once_and_fetch_the_chosen_ones(spark):
    rows = [(i, f"  Sentence {i} has some words here now.  Another one {i} follows it in the text! short. " * (1 + i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows + [(60, None), (61, "")], "doc_id long, text string")
    clean = C.clean_sentences(C.sentences(docs, n_words="n_words"), 5, 128).withColumn("_h", C.order_key(1, "doc_id", "pos"))
    keys = C.stored_keys(clean, "_h", ["doc_id", "pos"], ["n_words"])
    assert keys.columns == ["doc_id", "pos", "n_words", "_h"]
    got = C.sentence_texts(C.shuffled_splits(keys, {"train": 20, "test": 9}, "_h", ["doc_id", "pos"]), docs, 29).collect()
    want = {(r.doc_id, r.pos): r.text for r in clean.collect()}
    order = sorted(want, key=lambda k: hashlib.md5(f"1:{k[0]}:{k[1]}".encode()).hexdigest())
    assert {(r.doc_id, r.pos): (r.text, r.ord, r.split) for r in got} == {
        k: (want[k], i, "train" if i < 20 else "test") for i, k in enumerate(order[:29])}
    plan = C.shuffled_splits(keys, {"train": 20}, "_h", ["doc_id", "pos"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan  # texts are not read again
