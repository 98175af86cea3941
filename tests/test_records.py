"""Record operators: lookup, filters, candidate lists, strict casts."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import records as B


def test_lookup_and_has_attributes(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"]), (["b"], ["9"])],
                               "h array<string>, c array<string>")
    got = df.select(B.lookup("h", "c", "a").alias("a"), B.has_attributes("h", ["a", "b"]).alias("ok")).collect()
    assert [(r.a, r.ok) for r in got] == [("1", True), (None, False)]


def test_first_match_and_empty_piece(spark):
    df = spark.createDataFrame([("brand manager, poet and writer", "a poet"),
                                ("painter, ", "nothing here"), ("x, y", "none")], "o string, line string")
    pieces = T.split_occupation(F.col("o"))
    got = df.select(B.first_match(pieces, F.col("line")).alias("m"),
                    B.any_piece_in(pieces, F.col("line")).alias("any")).collect()
    assert [(r.m, r.any) for r in got] == [("poet", True), ("", True), ("y", False)]


def test_markup_filter(spark):
    df = spark.createDataFrame([("poet",), ("poet -lrb- x -rrb-",), ("2nd poet",), ("poet²",)], "o string")
    assert [r.o for r in df.where(B.occupation_markup_free("o")).collect()] == ["poet"]


def _cands(spark, values, k=10):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, v string")
    return df, B.candidate_lists(df, "row_id", "v", 2023, k)


def test_candidates_truth_first_distinct_reproducible(spark):
    values = [f"v{i % 37}" for i in range(300)]
    df, out = _cands(spark, values)
    rows = out.collect()
    dom = set(values)
    for r in rows:
        c = list(r.v_candidate_list)
        assert c[0] == r.v and len(c) == 10 and len(set(c)) == 10 and set(c) <= dom
    again = {r.row_id: list(r.v_candidate_list) for r in B.candidate_lists(df.repartition(5), "row_id", "v").collect()}
    assert again == {r.row_id: list(r.v_candidate_list) for r in rows}


def test_candidates_domain_limits(spark):
    _, out = _cands(spark, [f"d{i}" for i in range(10)] * 3)
    assert all(sorted(r.v_candidate_list) == sorted(f"d{i}" for i in range(10)) for r in out.collect())
    with pytest.raises(ValueError, match="9 distinct"):
        _cands(spark, [f"d{i}" for i in range(9)])
    _, binary = _cands(spark, ["discharge", "admittance", "discharge"])
    assert [list(r.v_candidate_list) for r in binary.orderBy("row_id").collect()] == [
        ["discharge", "admittance"], ["admittance", "discharge"], ["discharge", "admittance"]]


def test_top_k_semi_join(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbcd"], "v string")
    assert sorted(r.v for r in B.keep_top_k(df, "v", 2).collect()) == list("aaabb")


def test_checked_int_and_final_period(spark):
    ok = spark.createDataFrame([(88.0,), (None,)], "x double").select(B.checked_int("x", "x").alias("i"))
    assert [r.i for r in ok.collect()] == [88, None]
    with pytest.raises(Exception, match="lossy int cast"):
        spark.createDataFrame([(88.5,)], "x double").select(B.checked_int("x", "x")).collect()
    with pytest.raises(Exception, match="empty text"):
        spark.createDataFrame([("",)], "t string").select(B.required_final_period("t")).collect()


def test_render(spark):
    df = spark.createDataFrame([("discharge", 88, "Note.")], "disposition string, heart_rate int, t string")
    got = df.select(B.render_attributes({"disposition": F.col("disposition"), "heart_rate": F.col("heart_rate")},
                                        F.col("t")).alias("x"),
                    B.render_prompt("heart_rate", F.col("heart_rate")).alias("p")).collect()[0]
    assert got.x == "The disposition is discharge. The heart rate is 88. Note."
    assert got.p == "The heart rate is 88"


def test_truncate_eos_and_pad(spark):
    from vellum.operators import sequences as Q

    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (0, [7]), (1, [9, 9, 9])], "b int, ids array<int>")
    t = df.withColumn("ids", Q.truncate_eos("ids", 4, 50256))
    right = sorted((r.b, list(r.ids)) for r in Q.pad_batches(t, "ids", F.col("b")).collect())
    assert right == [(0, [1, 2, 3, 4]), (0, [7, 50256, -100, -100]), (1, [9, 9, 9, 50256])]
    left = sorted((r.b, list(r.ids)) for r in Q.pad_batches(t, "ids", F.col("b"), side="left").collect())
    assert left[0] == (0, [-100, -100, 7, 50256])


def test_most_common_ties_in_first_seen_order(spark):
    """Equal counts keep first-seen order (Counter.most_common), not value order;
    header names are first seen at (row place, position in the header)."""
    import collections

    rows = [(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, "c"), (6, "d"), (7, "c")]
    df = spark.createDataFrame(rows, "place int, v string")
    got = [r.value for r in B.top_k_values(df, "v", 3, first=F.col("place")).collect()]
    exp = [v for v, _ in collections.Counter(v for _, v in sorted(rows)).most_common(3)]
    assert got == exp == ["b", "a", "c"]
    hdr = spark.createDataFrame([(1, ["y", "x"]), (2, ["x", "y", "z"]), (3, ["z"])], "place int, h array<string>")
    got = [r.value for r in B.most_common(B.header_counts(hdr, "h", first=F.col("place")), 3).collect()]
    flat = [n for _, h in sorted(hdr.collect()) for n in h]
    assert got == [v for v, _ in collections.Counter(flat).most_common(3)] == ["y", "x", "z"]


def _counted_rows(spark, counts):
    rows = [(v, i) for i, v in enumerate(x for v, n in counts for x in [v] * n)]
    return spark.createDataFrame(rows, "v string, place long").repartition(4)


def test_top_k_by_sketch_is_exact_with_a_near_tie(spark):
    """Frequent values one apart and tied, over thousands of rare ones, more than the sketch tracks."""
    counts = [("a", 900), ("b", 901), ("c", 900), (None, 950), ("d", 899)] + [(f"rare{i}", 1 + i % 3) for i in range(3000)]
    df = _counted_rows(spark, counts)
    whole = B.most_common(B.value_counts(df, "v", F.col("place")), 4).collect()
    assert [(r.value, r["count"]) for r in whole] == [(None, 950), ("b", 901), ("a", 900), ("c", 900)]
    assert B.top_k_values(df, "v", 4, F.col("place"), tracked=200).collect() == whole
    candidates, n, others = B.frequent_candidates(df, "v", 200)
    found = {r.value for r in candidates.collect()}
    assert {"a", "b", "c", "d", None} <= found and len(found) <= 200 and n == df.count()
    left_out = max(c for v, c in counts if v not in found)
    assert left_out <= others < 900


def test_top_k_of_a_flat_distribution_counts_everything(spark):
    counts = [(f"v{i}", 3) for i in range(2000)] + [("top", 4)]
    df = _counted_rows(spark, counts)
    got = B.top_k_values(df, "v", 3, F.col("place"), tracked=100).collect()
    assert [(r.value, r["count"]) for r in got] == [("top", 4), ("v0", 3), ("v1", 3)]
    assert B.top_k_values(df.limit(0), "v", 3).collect() == []
    few = _counted_rows(spark, [("x", 2), ("y", 1)])
    assert [(r.value, r["count"]) for r in B.top_k_values(few, "v", 5).collect()] == [("x", 2), ("y", 1)]


def test_top_k_headers_break_ties_by_first_place(spark):
    rows = [(2, ["b", "a"]), (1, ["c", "a", "b"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "row long, header array<string>")
    got = B.top_k_headers(df, "header", 2, first=F.col("row")).collect()
    assert [(r.value, r["count"]) for r in got] == [("a", 2), ("b", 2)]
    assert got == B.most_common(B.header_counts(df, "header", first=F.col("row")), 2).collect()


def _biographies(spark, n=800, segments=17):
    """Tables of the biography job: customers of ``segments`` market segments."""
    from vellum.sources.writers import scratch_path

    sf = scratch_path(spark, "biographies")
    k = F.col("id")
    customers = spark.range(1, n + 1).select(
        k.alias("c_custkey"), F.format_string("Customer#%09d", k).alias("c_name"), F.pmod(k, F.lit(13)).alias("c_nationkey"),
        F.format_string("SEGMENT%s", F.chr(65 + F.pmod(k, F.lit(segments)))).alias("c_mktsegment"))
    customers.write.parquet(f"{sf}/customer.parquet")
    nations = spark.range(13).select(k.alias("n_nationkey"), F.format_string("NATION%s", F.chr(65 + k)).alias("n_name"), F.pmod(k, F.lit(3)).alias("n_regionkey"))
    nations.write.parquet(f"{sf}/nation.parquet")
    spark.range(3).select(k.alias("r_regionkey"), F.format_string("REGION%s", F.chr(65 + k)).alias("r_name")).write.parquet(f"{sf}/region.parquet")
    return sf


def test_distinct_covers_the_rendered_rows_of_all_splits(spark):
    from vellum.plans import records_q as RQ

    sf = _biographies(spark)
    rows = RQ.s_render(spark, sf).collect()
    assert len({r.split for r in rows}) > 1
    wanted = {(a, r[a]) for r in rows for a in ("occupation", "nationality")}
    got = [tuple(r) for r in RQ.Q["distinct"](spark, sf).select("attribute", "value").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_distinct_distractors_gives_the_lists_of_every_row(spark):
    from vellum.plans import records_q as RQ

    sf = _biographies(spark)
    rows = {r.row_id: r for r in RQ.s_render(spark, sf).collect()}
    got = {r.row_id: r for r in RQ.Q["distinct_distractors"](spark, sf).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        for a in RQ.ATTRS:
            names = r[f"{a}_candidates"].split("|")
            assert names[0] == rows[i][a] and len(names) == len(set(names)) == 10


def test_top_k_of_a_column_named_value(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "value string")
    assert sorted(r.value for r in B.keep_top_k(df, "value", 2).collect()) == ["a", "a", "a", "b", "b"]
