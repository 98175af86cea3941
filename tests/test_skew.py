"""Hot keys: a third of all rows share one text / one attribute value. Results
must stay exact and no shuffle partition may receive the hot group whole."""

import collections

from pyspark.sql import functions as F

from vellum.operators import corpus as C
from vellum.operators import records as B


def _skewed(spark, n=30000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        .alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string")))
        .alias("value"))


def test_ordinal_partitions_stay_balanced_with_identical_texts(spark):
    df = _skewed(spark)
    o = C.seeded_order(df, 2023, ["doc_id"])
    sizes = [r["count"] for r in o.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 30000
    # the hot third is spread over buckets: no partition far above the mean
    assert max(sizes) <= 1.5 * (30000 / len(sizes))
    ords = sorted(r.ord for r in o.select("ord").collect())
    assert ords == list(range(30000))


def test_dedup_hot_copy_group(spark):
    df = _skewed(spark)
    kept = C.md5_dedup(df)
    assert kept.count() == 30000 - (10000 - 1)
    assert kept.where(F.col("text") == "the same text").collect()[0].doc_id == 0


def test_candidates_with_hot_value(spark):
    df = _skewed(spark, 3000)
    out = B.candidate_lists(df, "doc_id", "value", 2023)
    rows = out.collect()
    assert len(rows) == 3000
    firsts = collections.Counter()
    for r in rows:
        c = list(r.value_candidate_list)
        assert c[0] == r.value and len(set(c)) == 10
        firsts[c[1]] += 1
    # distractors are spread over the domain, not stuck on the hot value
    assert firsts["hot"] < 0.1 * 3000


def test_top_k_keeps_hot_value_rows(spark):
    df = _skewed(spark, 3000)
    kept = B.keep_top_k(df, "value", 5)
    assert kept.where(F.col("value") == "hot").count() == 1000
