"""Dictionaries of many columns, sparse one-hot, cuts within many labels, translation in place."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mlframe.operators import encode, split, text


@pytest.fixture
def table(spark):
    """A wide text column with a hot value, a number column, nulls, and a column no one encodes."""
    return spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.format_string("v%05d", "id")).alias("a b"),
        (F.col("id") % 7).alias("n"), F.lit("x").alias("_v0"))


def plain(df, col):
    values = sorted({r[0] for r in df.select(f"`{col}`").collect()} - {None})
    return {v: i for i, v in enumerate(values)} | {None: None}


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_ordinals_by_broadcast_and_by_join(table, monkeypatch, room):
    monkeypatch.setattr(encode, "BROADCAST_BYTES", room)
    df = table.drop("_v0")
    a, n = plain(df, "a b"), plain(df, "n")
    got = {r["id"]: r for r in encode.ordinal_encode(df, ["a b", "n"]).collect()}
    assert len(got) == 4000
    for r in df.collect():
        assert (got[r["id"]]["a b"], got[r["id"]]["n"]) == (a[r["a b"]], n[r["n"]])


def test_unseen_values_and_empty_tables(table):
    fit = table.filter("id < 100")
    got = encode.ordinal_encode(table.drop("_v0"), ["a b", "n"], fit_on=fit).filter("id >= 100 AND id % 3 <> 0").select("`a b`").distinct().collect()
    assert [r[0] for r in got] == [None]
    assert encode.ordinal_encode(fit.filter("false").drop("_v0"), ["a b", "n"]).count() == 0


def test_one_dictionary_pass(spark, table):
    """Three figures a column come to the driver, whatever the number of columns, and one aggregate reads the table."""
    wide = table.select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(12)])
    values, _ = encode._values(wide, [f"c{i}" for i in range(12)])
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Range") == 1
    fitted = encode.Dictionaries(wide, [f"c{i}" for i in range(12)])
    assert [fitted.sizes[f"c{i}"][0] for i in range(12)] == list(range(2, 14))


def test_sparse_one_hot_beyond_the_column_limit(table):
    df = table.drop("_v0")
    a, n = plain(df, "a b"), plain(df, "n")
    assert len(a) > 2001
    hot, fitted = encode.one_hot_sparse(df, ["a b", "n"], vector="features")
    width = len(a) - 1 + len(n) - 1
    assert fitted.sizes["a b"][0] == len(a) - 1
    rows = {r["id"]: r for r in hot.select("id", "hot", "features").filter("id < 60").collect()}
    for r in df.filter("id < 60").collect():
        want = [x for x in (a[r["a b"]], len(a) - 1 + n[r["n"]]) if x is not None]
        assert rows[r["id"]]["hot"] == want
        assert rows[r["id"]]["features"].size == width and list(rows[r["id"]]["features"].indices) == want
    assert hot.select(F.size(vector_to_array("features")).alias("s")).filter(f"s <> {width}").isEmpty()
    with pytest.raises(ValueError, match="one_hot_sparse"):
        encode.one_hot(df, "a b")


def test_splits_within_thousands_of_labels(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") < 3000, "big").when(F.col("id") % 50 == 0, None).otherwise(F.col("id").cast("string").substr(1, 4)).alias("c"))
    sizes = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    assert len(sizes) > 1000
    folds = split.stratified_kfold(df, "id", "c", 3, 1).groupBy("c", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 9000
    assert all(r["count"] in (sizes[r["c"]] // 3, -(-sizes[r["c"]] // 3)) for r in folds)
    tests = {r["c"]: r["count"] for r in split.tag_split(df, "id", 0.2, 1, "c").filter("split = 'test'").groupBy("c").count().collect()}
    assert tests == {c: split.test_rows(n, 0.2) for c, n in sizes.items()}


def test_translation_shuffles_no_token(spark):
    df = spark.createDataFrame([(1, "a b a rare"), (2, None), (3, ""), (4, "unknown a")], "i int, t string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("rare", 3)], "word string, idx int")
    whole = text.texts_to_sequences(df, "t", "i", vocab)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    want = {1: [1, 2, 1, 3], 2: [], 3: [], 4: [1]}
    assert {r["i"]: r["seq"] for r in whole.collect()} == want
    assert {r["i"]: r["seq"] for r in text.texts_to_sequences(df, "t", "i", vocab, head=1).collect()} == want
