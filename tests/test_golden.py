"""Small worked examples with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mlframe.functions import arrays
from mlframe.functions.activations import activation
from mlframe.operators import clean, encode, profile, resample, scale, sequence, split, text, tune
from mlframe.sources import read_csv, write_csv


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1, 11).select(F.col("id").cast("int").alias("x"))


def test_windows_of_five(numbers):
    got = [r["x_window"] for r in sequence.sliding_windows(numbers, ["x"], "x", 5).orderBy("step").collect()]
    assert len(got) == 6 and got[0] == [1, 2, 3, 4, 5] and got[-1] == [6, 7, 8, 9, 10]


def test_window_inputs_and_targets(numbers):
    out = sequence.window_xy(sequence.sliding_windows(numbers, ["x"], "x", 5), "x_window", "a", "b").orderBy("step").collect()
    assert [r["b"] for r in out] == [5, 6, 7, 8, 9, 10] and all(len(r["a"]) == 4 for r in out)


@pytest.mark.parametrize("n,stride", [(400, 1), (400, 7), (288, 1), (289, 144)])
def test_number_of_horizon_windows(spark, n, stride):
    df = spark.range(n).withColumnRenamed("id", "t")
    got = sequence.window_horizon(df, ["t"], "t", "t", 144, 144, stride).count()
    assert got == (n - 288) // stride + (1 if n >= 288 else 0)


@pytest.mark.parametrize("degree,only,row,want", [
    (2, False, (2, 3), [2, 3, 4, 6, 9]),
    (3, False, (2, 3), [2, 3, 4, 6, 9, 8, 12, 18, 27]),
    (2, True, (3, 4, 5), [3, 4, 5, 12, 15, 20]),
    (2, False, (3, 4, 5), [3, 4, 5, 9, 12, 15, 16, 20, 25]),
])
def test_polynomial_order(spark, degree, only, row, want):
    cols = [f"x{i}" for i in range(len(row))]
    df = spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{c} double" for c in cols))
    assert list(encode.polynomial(df, cols, degree, interaction_only=only).first()) == want


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (15.2, 38.7, 60.3, 82.8, 99.9, 2.5, 3.5)], "x double")
    assert [r[0] for r in clean.round_half_even(df, ["x"]).collect()] == [15, 39, 60, 83, 100, 2, 4]


def test_vocabulary_ties_and_sequences(spark):
    df = spark.createDataFrame([(2, "b! a, a"), (1, "The cat, the DOG - the mat."), (3, "a\tzebra")], "i int, t string")
    vocab = text.build_vocab(df, "t", "i")
    assert [r["word"] for r in vocab.orderBy("idx").collect()] == ["the", "a", "cat", "dog", "mat", "b", "zebra"]
    seqs = {r["i"]: r["seq"] for r in text.texts_to_sequences(df, "t", "i", vocab).collect()}
    assert seqs == {1: [1, 3, 1, 4, 1, 5], 2: [6, 2, 2], 3: [2, 7]}
    assert text.vocab_size(vocab).first()[0] == 8
    assert {r["word"]: r["docs"] for r in text.document_counts(df, "t").collect()}["a"] == 2


def test_text_without_known_words_keeps_its_row(spark):
    df = spark.createDataFrame([(1, "x y"), (2, ""), (3, "..."), (4, None), (5, "z x")], "i int, t string")
    vocab = spark.createDataFrame([("x", 1, 1)], "word string, cnt long, idx long")
    got = {r["i"]: r["seq"] for r in text.texts_to_sequences(df, "t", "i", vocab).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [], 5: [1]}


@pytest.mark.parametrize("padding,truncating,want", [
    ("pre", "pre", [[0, 0, 1], [3, 4, 5]]), ("post", "post", [[1, 0, 0], [2, 3, 4]]),
    ("pre", "post", [[0, 0, 1], [2, 3, 4]]), ("post", "pre", [[1, 0, 0], [3, 4, 5]])])
def test_padding(spark, padding, truncating, want):
    df = spark.createDataFrame([([1],), ([2, 3, 4, 5],)], "s array<int>")
    assert [r[0] for r in text.pad_sequences(df, "s", 3, padding, truncating).collect()] == want


def test_long_words_take_the_shuffle_path(spark):
    long = "w" * 200
    df = spark.createDataFrame([(1, f"{long} a"), (2, f"a {long} a")], "i int, t string")
    got = {r["i"]: r["seq"] for r in text.texts_to_sequences(df, "t", "i", text.build_vocab(df, "t", "i")).collect()}
    assert got == {1: [2, 1], 2: [1, 2, 1]}


def test_positional_splits(spark):
    df = spark.range(1, 17)
    parts = split.three_way_split(df, "id", 10, 4).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 10, "validation": 4, "test": 2}
    head, tail = split.head_tail_split(spark.range(1, 11), "id", n_head=7)
    assert (head.count(), tail.count()) == (7, 3) and tail.agg(F.min("id")).first()[0] == 8


@pytest.mark.parametrize("n,size,want", [(100, 32, [32, 32, 32, 4]), (5, 2, [2, 2, 1])])
def test_batches(spark, n, size, want):
    for kw in ({"order_by": "id"}, {"key": "id", "seed": 1}):
        got = split.assign_batches(spark.range(n), size, **kw).groupBy("batch").count().orderBy("batch").collect()
        assert [r["count"] for r in got] == want


def test_augmentation_size(spark):
    out = resample.augment_with_replacement(spark.range(6000), "id", 4000, 1)
    assert out.count() == 10_000 and out.filter("draw > 0").select("draw").distinct().count() == 4000


def test_null_counts_by_column(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, "a", 1.0)], "i int, s string, x double")
    assert {r["column_name"]: r["missing"] for r in profile.null_counts(df).collect()} == {"i": 0, "s": 2, "x": 1}


def test_halving_schedule():
    rounds = tune.halving_schedule(45, 30, 16512, 3)
    assert [(r.candidates, r.rows) for r in rounds] == [(45, 30), (15, 90), (5, 270), (2, 810)]
    assert [(r.candidates, r.rows) for r in tune.halving_schedule(45, 30, 100, 3)] == [(45, 30), (15, 90)]


def test_oversampling_below_the_present_size_is_an_error(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    with pytest.raises(ValueError):
        resample.oversample(df, "id", "y", {0: 5, 1: 10})


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    for how in scale.FITTERS:
        assert all(r["c"] in (0.0, 1.0) for r in scale.scale(df, ["c", "x"], how).collect())
    assert clean.zscore_filter(df, ["c", "x"]).count() == 2


def test_csv_nan_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], "id int, x double")
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), df.schema, key="id")
    assert back.filter("x is null").count() == 2


def test_scratch_is_released(spark):
    import os

    from mlframe.session import materialize, release_scratch

    release_scratch(spark)
    df = materialize(spark.range(5))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 5 and release_scratch(spark) == 1 and not os.path.exists(folder)


def test_activation_values(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (800.0,), (-800.0,)], "x double")
    x = np.array([-2.0, 0.0, 3.0, 800.0, -800.0])
    for name, f in {"relu": np.maximum(x, 0), "mish": x * np.tanh(np.logaddexp(0, x)), "tanh": np.tanh(x)}.items():
        assert np.allclose([r[0] for r in df.select(activation("x", name)).collect()], f)


def test_softmax_survives_large_values(spark):
    df = spark.createDataFrame([(1, 1000.0), (1, 1000.0), (2, -5.0)], "g int, x double")
    assert sorted(r["softmax"] for r in encode.softmax(df, "x", "g").collect()) == [0.5, 0.5, 1.0]


def test_grids(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "a array<int>")
    assert df.select(arrays.flip_grid("a", 3, 2)).first()[0] == [3, 2, 1, 6, 5, 4]
    assert df.select(arrays.flip_grid("a", 3, 2, "vertical")).first()[0] == [4, 5, 6, 1, 2, 3]
    assert df.select(arrays.shift_grid("a", 3, 2, 1, 0)).first()[0] == [1, 1, 2, 4, 4, 5]
    assert df.select(arrays.reshape("a", 3, 2)).first()[0] == [[1, 2], [3, 4], [5, 6]]


def test_unseen_label_is_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",)], "c string")
    got = encode.label_encode(df, "c", fit_on=df.filter("c <> 'z'")).collect()
    assert [r[0] for r in got] == [1, 0, None]


def test_many_labels_are_numbered_on_the_cluster(spark):
    df = spark.range(300).select(F.format_string("k%03d", "id").alias("c"))
    got = encode.label_encode(df, "c", out="n", limit=50).collect()
    assert all(int(r["c"][1:]) == r["n"] for r in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(1, 99), max_size=9), min_size=1, max_size=5), st.integers(1, 8))
def test_padded_length(spark, seqs, maxlen):
    df = spark.createDataFrame([(s,) for s in seqs], "s array<int>")
    assert all(len(r[0]) == maxlen for r in text.pad_sequences(df, "s", maxlen).collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=8))
def test_inverse_scaling(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for how, fit in scale.FITTERS.items():
        params = fit(df, ["x"])
        back = [r[0] for r in scale.inverse_scale(scale.apply_scale(df, params), params).collect()]
        assert np.allclose(back, xs, atol=1e-6), how
