import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.operators import clean, publish, sequence, split
from mlframe.operators.ordering import global_index, hash_cuts, hash_index, look_ahead_chunks, prefix_sum
from mlframe.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """1500 rows in shuffled order; group 0 holds a third of them."""
    rng = random.Random(3)
    rows = [(i, 0 if i % 3 == 0 else i % 40, rng.randrange(20)) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, grp int, v int").repartition(7)
    return df, sorted(rows)


def test_global_index_follows_the_order(skewed):
    df, rows = skewed
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    got = global_index(df, [F.col("v").desc(), "id"])
    assert {r["id"]: r["row_index"] for r in got.collect()} == want


def test_global_index_per_hot_group(skewed):
    df, rows = skewed
    want, seen = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    got = global_index(df, ["v", "id"], partition_by=["grp"])
    assert {r["id"]: r["row_index"] for r in got.collect()} == want


def test_prefix_sum(skewed):
    df, rows = skewed
    got = {r["id"]: r["s"] for r in prefix_sum(df, {"s": F.col("v")}, ["id"], ["grp"]).collect()}
    run = {}
    for i, g, v in sorted(rows):
        run[g] = run.get(g, 0) + v
        assert got[i] == run[g]


def _hashed(rows, seed):
    return sorted(rows, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())


def test_hash_index(skewed, partitions):
    df, rows = skewed
    want = {r[0]: i + 1 for i, r in enumerate(_hashed(rows, 7))}
    for n in (1, 8, 64):
        got = partitions(n, lambda: {r["id"]: r["row_index"] for r in hash_index(df, "id", 7).collect()})
        assert got == want


@pytest.mark.parametrize("leaf", [1, 5, 5000])
def test_hash_cuts_narrow_to_the_exact_row(skewed, leaf):
    df, rows = skewed
    digests = [hashlib.md5(f"7:{r[0]}".encode()).hexdigest() for r in _hashed(rows, 7)]
    sizes, cuts = hash_cuts(df, "id", 7, lambda s: {0: [1, 700, 1500]}, leaf=leaf)
    assert sizes == {0: 1500}
    assert cuts[0] == {1: digests[0], 700: digests[699], 1500: digests[-1]}


def test_hash_cuts_refuse_a_rank_beyond_the_table(skewed):
    with pytest.raises(ValueError):
        hash_cuts(skewed[0], "id", 7, lambda s: {0: [1501]})


@pytest.mark.parametrize("size,test", [(0.2, 300), (0.3333, 500), (0.001, 2)])
def test_split_sizes_and_disjointness(skewed, size, test):
    df, rows = skewed
    a, b = split.train_test_split(df, "id", size, 1)
    left, right = ({r["id"] for r in x.collect()} for x in (a, b))
    assert len(right) == test and not left & right and len(left | right) == 1500


def test_stratified_folds_are_even_within_each_group(skewed):
    df, rows = skewed
    got = split.stratified_kfold(df, "id", "grp", 4, 2).groupBy("grp", "fold").count().collect()
    for g in {r[1] for r in rows}:
        n = [r["count"] for r in got if r["grp"] == g]
        assert max(n) - min(n) <= 1


def test_split_does_not_depend_on_partitioning(skewed, partitions):
    df, _ = skewed
    runs = [partitions(n, lambda: sorted(r["id"] for r in split.train_test_split(df.repartition(n), "id", 0.2, 5)[1].collect()))
            for n in (1, 8)]
    assert runs[0] == runs[1]


def test_split_plan_has_no_shuffle(skewed):
    df, _ = skewed
    plan = split.tag_split(df.coalesce(2), "id", 0.2, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_null_label_is_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a") for i in range(30)], "id long, c string")
    tagged = split.tag_split(df, "id", 0.2, 1, label="c").groupBy("c", "split").count().collect()
    assert {(r["c"], r["split"]): r["count"] for r in tagged} == {
        (None, "train"): 8, (None, "test"): 2, ("a", "train"): 16, ("a", "test"): 4}


def test_chunks_see_every_following_row(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "step")
    rows = look_ahead_chunks(df, "step", 4, rows=10).collect()
    assert sum(r["_own"] for r in rows) == 100
    inside = {(r["_chunk"], r["step"]) for r in rows}
    for s in range(1, 97):
        assert all(((s - 1) // 10, s + k) in inside for k in range(5))


@pytest.mark.parametrize("chunk", [5, 64, 10_000])
def test_windows_do_not_depend_on_chunks(skewed, chunk):
    df, rows = skewed
    out = sequence.sliding_windows(df, ["v"], "id", 5, 3, "grp", chunk_rows=chunk).collect()
    series = {}
    for r in sorted(rows):
        series.setdefault(r[1], []).append(r)
    want = {s[k][0]: [x[2] for x in s[k:k + 5]] for s in series.values() for k in range(0, len(s) - 4, 3)}
    assert {r["id"]: r["v_window"] for r in out} == want


def test_quantiles_narrow_to_the_exact_value(spark):
    rng = np.random.default_rng(0)
    spread, hot = rng.normal(size=30_000), np.where(rng.random(30_000) < 0.4, 7.0, rng.normal(7, 3, 30_000))
    df = spark.createDataFrame(list(zip(map(float, spread), map(float, hot))), "a double, b double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, small=40)
    assert np.allclose(got["a"], np.quantile(spread, probs), atol=1e-12)
    assert np.allclose(got["b"], np.quantile(hot, probs), atol=1e-12)


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "k string, s int")
    assert {r["k"]: r["rank"] for r in publish.rank_results(df, "s").collect()} == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_compact_column(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i * 10) for i in range(6)], "i int, x int")
    got = clean.compact_column(df, "x", "i", 2).orderBy("i").collect()
    assert [r["x"] for r in got] == [20, 40, 50, None, None, None]
