"""One notion of missing, and draws that reach every row."""

import math

from pyspark.sql import functions as F

from mlframe.operators import sequence, text, tune
from mlframe.operators.ordering import md5_int
from mlframe.session import scratch_path
from mlframe.sources import files


def test_nan_in_stored_tables_is_missing(spark):
    folder = scratch_path(spark, "nan")
    rows = [(1, math.nan, [1.0, math.nan]), (2, 1.0, [2.0, 3.0]), (3, 3.0, None)]
    spark.createDataFrame(rows, "k long, x double, v array<double>").write.parquet(f"{folder}/t.parquet")
    df = files.load_table(spark, folder, "t")
    assert {r.k: r.x for r in df.collect()} == {1: None, 2: 1.0, 3: 3.0}
    assert df.filter("k = 1").first().v == [1.0, None]
    assert files.load_arrays(spark, f"{folder}/t.parquet").filter("x is null").count() == 1
    assert df.agg(F.avg("x")).first()[0] == 2.0


def test_windows_keep_nulls_in_place(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i)) for i in range(6)], "t long, x double")
    got = {r.step: r.x_window for r in sequence.sliding_windows(df, ["x"], "t", 3).collect()}
    assert got == {1: [0.0, 1.0, None], 2: [1.0, None, 3.0], 3: [None, 3.0, 4.0], 4: [3.0, 4.0, 5.0]}
    ahead = {r.step: (r.x_window, r.target) for r in sequence.window_horizon(df, ["x"], "x", "t", 2, 1).collect()}
    assert ahead == {1: ([0.0, 1.0], None), 2: ([1.0, None], 3.0), 3: ([None, 3.0], 4.0), 4: ([3.0, 4.0], 5.0)}


def test_draws_exceed_32_bits(spark):
    top = spark.range(200).select(F.max(md5_int(F.col("id")))).first()[0]
    assert 1 << 58 < top < 1 << 60


def test_failed_candidate_ranks_last(spark):
    frame = tune.result_frame(spark, [{"a": 1}, {"a": 2}, {"a": 3}], [0.5, math.nan, 0.7], [0.0] * 3)
    assert {r.params: r["rank"] for r in frame.collect()} == {"a=3": 1, "a=1": 2, "a=2": 3}


def test_word_vectors_keep_every_id(spark):
    df = spark.createDataFrame([(1, [5, 9, 5]), (2, [])], "k long, ids array<int>")
    got = {r.k: r.features for r in text.bag_of_words(df, "ids", ["k"], 10).collect()}
    assert got[1].size == 10 and dict(zip(got[1].indices.tolist(), got[1].values.tolist())) == {5: 2.0, 9: 1.0}
    assert got[2].numNonzeros() == 0


def test_vocabulary_order_at_the_ends_of_the_keys(spark):
    rows = [(None, "z z null"), (-(1 << 63), "low y"), ((1 << 63) - 1, "high"), (-1, "minus y"), (0, "x nought"), (5, "high x"), (7, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r.word, r.cnt) for r in text.build_vocab(df, "t", "k").orderBy("idx").collect()]
    assert got == [("z", 2), ("y", 2), ("x", 2), ("high", 2), ("null", 1), ("low", 1), ("minus", 1), ("nought", 1)]
    plan = text.build_vocab(df.repartition(2), "t", "k")
    by_struct = text.build_vocab(df.withColumn("k2", F.lit(0)), "t", ["k", "k2"])
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, by_struct.collect()))


def test_word_vectors_take_no_vocabulary_to_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel

    def none_asked(*args, **kw):
        raise AssertionError("a list of all words was made on the driver")
    monkeypatch.setattr(CountVectorizerModel, "from_vocabulary", none_asked)
    df = spark.createDataFrame([(1, "a", [2, 0, None, 2, 11, -1]), (2, None, None), (3, "c", [9] * 30_000)], "k long, y string, ids array<bigint>")
    got = {r.k: (r.y, r.features) for r in text.bag_of_words(df, "ids", ["k", "y"], 10).collect()}
    assert {k: (y, v.size, v.indices.tolist(), v.values.tolist()) for k, (y, v) in got.items()} == {
        1: ("a", 10, [0, 2], [1.0, 2.0]), 2: (None, 10, [], []), 3: ("c", 10, [9], [30_000.0])}
    huge = text.bag_of_words(df, "ids", ["k"], (1 << 31) - 1)
    assert {r.k: r.features.numNonzeros() for r in huge.collect()} == {1: 3, 2: 0, 3: 1}
