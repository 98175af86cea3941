"""Readers, writers, result tables and quarantine."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from vellum.operators import corpus as C
from vellum.operators import records as B
from vellum.operators import results as R
from vellum.sources import readers as RD
from vellum.sources import writers as W


def _local(path):
    return path.replace("file:", "")


def test_md5_dedup_both_paths(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 == 0 else None if i % 7 == 0 else f"t{i}") for i in range(60)], "doc_id long, text string")
    broadcast = sorted(r.doc_id for r in C.md5_dedup(df).collect())
    shuffled = sorted(r.doc_id for r in C.md5_dedup(df, broadcast_bytes=0).collect())
    exp = sorted([0, 7] + [i for i in range(60) if i % 3 and i % 7])
    assert broadcast == shuffled == exp


def test_json_array_file_multiline(spark):
    d = tempfile.mkdtemp(prefix="vellum-json-")
    rows = [{"text": "a", "pred": ["x", "y"]}, {"text": "b", "pred": ["z"]}]
    with open(os.path.join(d, "attr_x.json"), "w") as f:
        json.dump(rows, f, indent=2)
    schema = PT.StructType([PT.StructField("text", PT.StringType()),
                            PT.StructField("pred", PT.ArrayType(PT.StringType()))])
    got = RD.read_json_records(spark, d, schema, multiline=True).orderBy("text").collect()
    assert [(r.text, list(r.pred)) for r in got] == [("a", ["x", "y"]), ("b", ["z"])]


def test_json_array_lines_round_trip(spark):
    path = W.scratch_path(spark, "arr")
    df = spark.range(25).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    W.write_json_arrays(df, path)
    back = RD.read_json_records(spark, path, PT.StructType([PT.StructField("id", PT.LongType()),
                                                            PT.StructField("text", PT.StringType())]))
    assert sorted(r.id for r in back.collect()) == list(range(25))


def test_text_dir_universal_newlines(spark):
    d = tempfile.mkdtemp(prefix="vellum-txt-")
    for split, name, content in [("train", "a.txt", "line one\r\nline two\n"), ("val", "b.txt", "  solo  ")]:
        os.makedirs(os.path.join(d, f"split={split}"), exist_ok=True)
        with open(os.path.join(d, f"split={split}", name), "w", newline="") as f:
            f.write(content)
    got = {r.split: r.text for r in RD.rename_hub_splits(RD.read_text_dir(spark, d)).collect()}
    assert got == {"train": "line one line two", "valid": "solo"}


def test_csv_dotted_columns_and_dropna(spark):
    d = tempfile.mkdtemp(prefix="vellum-csv-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("DISPOSITION,Heart.Rate,Other\nD,88.0,1\nA,,2\nA,70.0,\n")
    schema = PT.StructType([PT.StructField("DISPOSITION", PT.StringType()),
                            PT.StructField("Heart.Rate", PT.DoubleType()),
                            PT.StructField("Other", PT.IntegerType())])
    got = RD.read_csv_columns(spark, d, schema, ["DISPOSITION", "Heart.Rate"]).collect()
    assert sorted((r[0], r[1]) for r in got) == [("A", 70.0), ("D", 88.0)]


def test_split_table_pruning(spark):
    path = W.scratch_path(spark, "split")
    df = spark.range(30).select("id", F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    W.write_split_table(df, path)
    t = RD.read_split_table(spark, path, "test")
    assert t.count() == 10
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "test" in plan


def test_metric_history_appends_new_metric(spark):
    path = W.scratch_path(spark, "metrics")
    run1 = spark.createDataFrame([("d", 1, "f1", 0.5)], "dataset string, run int, metric string, value double")
    run2 = spark.createDataFrame([("d", 2, "f1", 0.7), ("d", 2, "bleu4", 0.1)],
                                 "dataset string, run int, metric string, value double")
    R.append_metrics(run1, path)
    R.append_metrics(run2, path)
    R.append_metrics(run2, path)   # a retried run replaces its rows, never doubles them
    hist = {r.metric: (list(r.history), r.latest) for r in R.metric_history(spark.read.parquet(path)).collect()}
    assert hist == {"f1": ([0.5, 0.7], 0.7), "bleu4": ([0.1], 0.1)}
    latest = R.latest_run(spark.read.parquet(path), ["dataset"])
    assert {r.run for r in latest.collect()} == {2}


def test_metric_families_and_splits_of_a_run_stay(spark):
    path = W.scratch_path(spark, "families")
    schema = "dataset string, run int, metric string, value double"
    R.append_metrics(spark.createDataFrame([("d", 1, "f1", 0.5)], schema), path)
    R.append_metrics(spark.createDataFrame([("d", 1, "perplexity", 9.0)], schema), path)
    R.append_metrics(spark.createDataFrame([("d", 1, "f1", 0.4)], schema), path, split="eval")
    R.append_metrics(spark.createDataFrame([("d", 1, "f1", 0.6)], schema), path)   # a retry of one family
    got = sorted((r.split, r.metric, r.value) for r in spark.read.parquet(path).collect())
    assert got == [("eval", "f1", 0.4), ("test", "f1", 0.6), ("test", "perplexity", 9.0)]


def test_predictions_written_in_parts(spark):
    path = W.scratch_path(spark, "parts")
    schema = "dataset string, run int, text string, pred string"
    W.write_predictions(spark.createDataFrame([("d", 1, "a", "x")], schema), path, "0")
    W.write_predictions(spark.createDataFrame([("d", 1, "b", "y")], schema), path, "1")
    W.write_predictions(spark.createDataFrame([("d", 1, "b", "z")], schema), path, "1")
    got = sorted((r.text, r.pred) for r in spark.read.schema(schema).json(path).collect())
    assert got == [("a", "x"), ("b", "z")]


def test_json_arrays_change_no_value(spark):
    import datetime as dt
    schema = "i long, d double, v array<double>, t timestamp, s string"
    rows = [(1, 0.12345678901234567, [1e-12, 0.1 + 0.2], dt.datetime(2020, 1, 2, 3, 4, 5, 678900), 'q"\n'),
            (None, 1e-12, None, None, None), (2**60 + 1, -0.0, [], dt.datetime(1969, 12, 31), "é")]
    path = W.scratch_path(spark, "exact")
    W.write_json_arrays(spark.createDataFrame(rows, schema), path)
    got = [tuple(r) for r in RD.read_json_records(spark, path, schema).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_quarantine_instead_of_raising(spark):
    df = spark.createDataFrame([(88.0,), (88.5,), (None,)], "x double")
    good, bad = B.quarantine(df, B.lossless_int("x"))
    assert sorted((r.x is None, r.x) for r in good.collect()) == [(False, 88.0), (True, None)]
    assert [r.x for r in bad.collect()] == [88.5]


def test_attr_predictions_keep_run_order(spark):
    rows = spark.createDataFrame([(1, "t", [0.1])], "row_id long, text string, embedding array<double>")
    preds = spark.createDataFrame([(1, 2, "b"), (1, 0, "z"), (1, 1, "a")], "row_id long, run int, pred string")
    got = W.attr_predictions(rows, preds).collect()[0]
    assert list(got.pred) == ["z", "a", "b"] and "embedding" not in got.asDict()


@pytest.mark.parametrize("n", [0, 3])
def test_empty_and_small_inputs(spark, n):
    df = spark.createDataFrame([(i, f"doc {i}.") for i in range(n)], "doc_id long, text string")
    assert C.clean_sentences(C.sentences(df)).count() == 0
    assert _local("file:/x") == "/x"


def _files(path):
    out = {}
    for folder, _, names in os.walk(_local(path)):
        found = [n for n in names if n.endswith(".parquet")]
        if found:
            out[os.path.basename(folder)] = len(found)
    return out


def test_files_of_a_split_table_follow_its_size(spark):
    """Splits of 30,000, 200 and 3 rows, spread over 40 tasks: the small ones are one
    file each, the large one several, but far fewer than tasks."""
    split = F.when(F.col("id") < 30_000, "train").when(F.col("id") < 30_200, "valid").otherwise("test")
    df = spark.range(30_203).repartition(40).withColumn("split", split).withColumn("text", F.sha2(F.col("id").cast("string"), 512))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        path = W.scratch_path(spark, "rebalanced")
        W.write_split_table(df, path)
        files = _files(path)
        assert files["split=valid"] == files["split=test"] == 1 and 2 <= files["split=train"] <= 12
        assert RD.read_split_table(spark, path).groupBy("split").count().orderBy("split").collect() == [("test", 3), ("train", 30_000), ("valid", 200)]
        path = W.scratch_path(spark, "clustered")
        W.write_table(df.drop("split"), path, cluster_by=["id"])
        bounds = sorted((r.lo, r.hi) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
        assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and bounds[-1][1] == 30_202
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    path = W.scratch_path(spark, "small")
    W.write_table(df.drop("split"), path)
    assert sum(_files(path).values()) <= 4  # cores: Spark keeps them busy before it joins small files


def test_newest_runs_are_read_by_partition_pruning(spark):
    path = W.scratch_path(spark, "runs")
    for dataset, runs in (("a", 3), ("b", 1)):
        for run in range(1, runs + 1):
            rows = [(f"{dataset}{run}-{i}", "t", "p") for i in range(run)]
            W.write_predictions(spark.createDataFrame(rows, "pair_id string, text string, pred string")
                                .withColumn("dataset", F.lit(dataset)).withColumn("run", F.lit(run)), path)
    schema = "pair_id string, text string, pred string, dataset string, run int, part string"
    latest = RD.read_latest_runs(spark, path, schema)
    assert sorted(r.pair_id for r in latest.collect()) == ["a3-0", "a3-1", "a3-2", "b1-0"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    filters = plan[plan.index("PartitionFilters"):]
    assert "dataset" in filters.split("]")[0] and "run" in filters.split("]")[0]
    files = {f for f in latest.select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert all("run=3" in f or "dataset=b" in f for f in files)
    names = RD.partition_values(spark, path, ["dataset", "run"])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in names


def test_bad_rows_are_quarantined_in_the_pass_that_writes_the_good(spark):
    src, out = W.scratch_path(spark, "lines"), W.scratch_path(spark, "checked")
    lines = ['{"id": 1, "n": 2.0, "t": "a"}', '{"id": 2, "n": 2.5, "t": "b"}', '{"id": 3, "n": ', '{"id": 4, "n": null, "t": ""}', "[]", '{"id": 5, "n": 1e12, "t": "c"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    schema = PT.StructType().add("id", "long").add("n", "double").add("t", "string")
    rows = RD.read_jsonl(spark, src, schema, corrupt=True)
    small = F.abs("n") < 2**31
    checks = {"parses": F.col(RD.CORRUPT).isNull(), "int": F.col("n").isNull() | (small & B.lossless_int(F.when(small, F.col("n")))), "text": F.length("t") > 0}
    W.write_checked(rows, checks, out, {"n": F.col("n").cast("int")})
    good = W.read_checked(spark, out)
    assert good.columns == ["id", "n", "t", RD.CORRUPT] and dict(good.dtypes)["n"] == "int"
    assert [(r.id, r.n, r.t) for r in good.collect()] == [(1, 2, "a")]
    bad = {tuple(r.reasons): json.loads(r.raw) for r in W.read_checked(spark, out, W.QUARANTINED).collect()}
    assert bad[("int",)] in ({"id": 2, "n": 2.5, "t": "b"}, {"id": 5, "n": 1e12, "t": "c"}) and bad[("text",)]["id"] == 4
    assert bad[("parses", "text")][RD.CORRUPT].startswith('{"id": 3')
    assert good.count() + W.read_checked(spark, out, W.QUARANTINED).count() == spark.read.text(src).count() - 1  # "[]" is no record
    pruned = good._jdf.queryExecution().executedPlan().toString()
    assert "status" in pruned[pruned.index("PartitionFilters"):].split("]")[0]


def test_a_replayed_batch_leaves_the_table_equal(spark):
    from vellum.operators import scoring as S
    from vellum.streaming import sinks as SK

    src, out, ckpt = (W.scratch_path(spark, n) for n in ("pairs", "sums", "checkpoint"))
    rows = [("d", i % 2, f"word{i % 5} and more", f"word{i % 7} and less") for i in range(40)]
    pairs = spark.createDataFrame(rows, "dataset string, run int, ref string, pred string")
    pairs.repartition(4).write.parquet(src)
    by = ["dataset", "run"]

    def stream():
        return spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(src)

    SK.idempotent_sink(stream(), lambda b: SK.token_f1_sums(b, by), out, ckpt).awaitTermination()
    batches = sorted(r[SK.BATCH] for r in spark.read.parquet(out).select(SK.BATCH).distinct().collect())
    assert batches == [0, 1, 2, 3]

    def history():
        return sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in SK.token_f1_history(spark, out, by).collect())

    want = sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in S.token_f1(pairs, by=by).collect())
    assert history() == want
    # all progress is lost: a query without it gives every batch again
    SK.idempotent_sink(stream(), lambda b: SK.token_f1_sums(b, by), out, W.scratch_path(spark, "checkpoint")).awaitTermination()
    assert history() == want
    assert sorted(r[SK.BATCH] for r in spark.read.parquet(out).select(SK.BATCH).distinct().collect()) == batches
    SK.write_batch(spark.read.parquet(out).where("batch = 99").drop(SK.BATCH), 2, W.scratch_path(spark, "empty"))  # no rows: no error


def test_saved_tables_hold_sentence_splits_and_documents(spark):
    from vellum.plans import io_q as IQ

    sf = W.scratch_path(spark, "documents-of-sentences")
    words = F.concat_ws(" ", F.lit("These are the words of document"), F.col("id").cast("string"), F.lit("and of its one sentence."))
    spark.range(1500).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{sf}/documents.parquet")
    got = {(r.saved, r.split): r for r in IQ.Q["src_saved_table"](spark, sf).collect()}
    assert set(got) == {("sentences", "test"), *[("documents", x) for x in ("valid alone", "train", "valid", "test")]}
    test = got["sentences", "test"]
    assert (test.n, test.n_docs, test.min_ord, test.max_ord) == (100, 100, 1100, 1199)
    assert [got["documents", x].n for x in ("train", "valid", "test")] == [1200, 150, 150]


def test_text_files_equal_those_of_sparks_writer(spark, monkeypatch):
    rows = [("en", "one\r\ntwo"), ("a/b=c%", " x "), (None, "no language"), ("", "empty language"), ("fr", None), ("fr", ""), ("en", "one\r\ntwo"), ("é {1} [2]^", "ü")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    out = {}
    for local in (True, False):
        if not local:
            monkeypatch.setattr(W, "_local_folder", lambda *_: None)
        path = W.scratch_path(spark, "texts")
        W.write_text_files(df, path, "text", ["lang"])
        back = RD.read_text_dir(spark, path)
        out[local] = sorted((repr(r.lang), r.text, r.file.split("/")[-2]) for r in back.collect())
        assert back.select("file").distinct().count() == len(rows)
    assert out[True] == out[False]


def test_text_files_of_a_local_folder_start_no_process(spark):
    """Hadoop without its native library sets the mode of each file by one, and leaves a checksum file, too."""
    path = W.scratch_path(spark, "texts")
    W.write_text_files(spark.range(50).select(F.col("id").cast("string").alias("text")), path)
    names = os.listdir(W._local_folder(spark, path))
    assert sum(n.endswith(".txt") for n in names) == 50 and not any(n.endswith(".crc") for n in names)


def _folder(files):
    d = tempfile.mkdtemp(prefix="vellum-texts-")
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "wb") as f:
            f.write(content)
    return d


def test_text_dir_keeps_no_file_on_the_driver(spark):
    """Spark's own reader held the status of each file and a place for it in a task there."""
    from vellum.plans import io_q as IQ

    d = _folder({f"split={i % 3}/{i}.txt": b"text %d\n" % i for i in range(600)})
    read = RD.read_text_dir(spark, d)
    assert len(read.inputFiles()) <= 3
    assert sorted((r.split, r.text, r.file) for r in read.collect()) == sorted((i % 3, f"text {i}", f"file://{d}/split={i % 3}/{i}.txt") for i in range(600))

    sf = W.scratch_path(spark, "documents-of-texts")
    lang = F.element_at(F.array(F.lit("de"), F.lit("en")), (F.col("id") % 2 + 1).cast("int"))
    spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("text"), lang.alias("lang")).write.parquet(f"{sf}/documents.parquet")
    out = IQ.Q["src_text_dir"](spark, sf)
    assert len(out.inputFiles()) <= 2
    assert sorted(map(tuple, out.collect())) == [("de", 150, 270, 25), ("en", 150, 270, 25)]


def test_text_dir_by_tasks_equals_sparks_reader(spark, monkeypatch):
    signs = "".join(chr(c) for c in range(33, 127) if chr(c) not in "/:")
    names = [f"a {signs}.txt", "b\u00e9\u4e2d\u00a0\u2028\x7f\x85 z\t", "u_v\u2160\u0301\U0001f600\xb2", "%41"]
    texts = [b"", b"\n", b"a\rb\r\nc\n\nd ", b"\xff\xfe a\x80", b"a\x00b", b"\xef\xbb\xbfbom"]
    odd = {n: t + b"x" for n, t in zip(names, texts)} | {f"t{i}": t for i, t in enumerate(texts)}
    hidden = {"_h": b"h", ".i": b"i", "j._COPYING_": b"j", "_k/l": b"l"}
    folders = [
        odd | hidden | {"nested/a": b"not read without partition columns"},
        {"y=1/d=2024-01-02/a": b"a", "y=__HIVE_DEFAULT_PARTITION__/d=2024-01-03/b": b"b", "y=2/d=2024-01-04/sub/c": b"c", "y=3/d=2024-01-05/empty": b"", "root": b"r"},
        {f"n={i / 2}/x{j}": b"%d" % j for i in range(40) for j in range(i % 3)},
        {"t=2024-01-01 10%3A00%3A00/a": b"a", "t=2024-01-02 11%3A30%3A00/a": b"b", "t=2024-01-02 11%3A30%3A00/_h": b"h"},
        {"y=x{1} [2]^%25?*\\/b c": b"b", "y=2/a.gz/b": b"b"}, {"y=1/a.gz": gzip.compress(b"packed"), "y=2/b": b"b"},
        {"file=1/value2=x/a": b"a"}, {"only/nested": b"n"}, {"empty": b""}, {}]
    paths = [_folder(files) for files in folders]
    paths += [f"{paths[1]}/y=1", f"{paths[2]}/n=*", f"{paths[1]}/y=1/d=2024-01-02/a", f"file:{paths[1]}/", f"file://{paths[0]}"]

    def read():
        monkeypatch.setattr(RD, "BATCH_BYTES", 3)
        return [(d.dtypes, sorted(map(repr, d.collect()))) for d in (RD.read_text_dir(spark, path) for path in paths)]

    tasks = read()
    monkeypatch.setattr(W, "_local_folder", lambda *_: None)
    assert tasks == read()


def test_stream_source_follows_size(spark):
    from vellum.streaming import sinks as SK

    rows = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        path = W.scratch_path(spark, "stream")
        SK.stream_of(rows, path, ["id"], 3)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    parts = spark.read.parquet(path).groupBy(F.input_file_name().alias("file"), "split").count().collect()
    assert len({r.split for r in parts}) == 3 and len(parts) >= 9
    assert max(r["count"] for r in parts) < 8_000 and sum(r["count"] for r in parts) == 40_000
