"""Rank selection against sorting, with composite keys, nulls, times, ties and stretches that need several passes."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mlframe.operators import clean, ranks, split

SCHEMA = "id long, f double, s string, t timestamp, d date, m decimal(10,2), b boolean, other string"


def rows(n=3000):
    r = random.Random(4)
    out = []
    for i in range(n):
        out.append((i, None if i % 50 == 0 else round(r.gauss(0, 2), 1), None if i % 70 == 0 else r.choice("aäzZ中 ") * r.randint(0, 3),
                    datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=r.randrange(500)), datetime.date(2020, 1, 1) + datetime.timedelta(days=r.randrange(40)),
                    Decimal(r.randrange(1000)) / 100, r.random() < 0.5, "x" * 20))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(6)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 64)
    monkeypatch.setattr(ranks, "LEAF", 50)


@pytest.mark.parametrize("order", [["id"], ["f", "id"], ["s", "f", "id"], ["t", "id"], ["d", "b", "id"], ["m", "s", "id"]])
def test_keys_at_ranks(df, small, order):
    want = [r["id"] for r in df.orderBy(*order).select("id").collect()]
    wanted = [1, 2, 700, 1500, 1501, 2999, 3000]
    _, n, found = ranks.rank_keys(df, order, [*wanted, 0, -5, 9000])
    assert n == 3000 and {r: k[-1] for r, k in found.items()} == {r: want[r - 1] for r in wanted}


@pytest.mark.parametrize("order", [["f", "id"], ["t", "id"], ["s", "id"]])
@pytest.mark.parametrize("rank", [0, 1, 60, 2999, 3000, 5000])
def test_cut_is_exact(df, small, order, rank):
    want = [r["id"] for r in df.orderBy(*order).select("id").collect()]
    head, tail = ranks.cut_after(df, order, rank)
    assert sorted(r["id"] for r in head.collect()) == sorted(want[:rank]) and sorted(r["id"] for r in tail.collect()) == sorted(want[rank:])


def test_cut_is_a_filter(df):
    """No exchange, no written copy: the parts are filters of the scan."""
    for part in split.head_tail_split(df.select("id", "f", "other"), ["f", "id"], n_head=1000):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan and "Join" not in plan and "Limit" not in plan


def test_equal_keys_end_the_search(spark, small):
    same = spark.range(2000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id")).alias("k"))
    _, _, found = ranks.rank_keys(same, "k", [1, 1000, 1499, 1600])
    assert {r: k[0] for r, k in found.items()} == {1: 5, 1000: 5, 1499: 5, 1600: 1599}


def test_nan_is_largest(spark, small):
    df = spark.createDataFrame([(i, float("nan") if i % 3 == 0 else float(i)) for i in range(300)], "id long, v double")
    want = [r["id"] for r in df.orderBy("v", "id").collect()]
    head, tail = ranks.cut_after(df, ["v", "id"], 250)
    assert sorted(r["id"] for r in head.collect()) == sorted(want[:250]) and tail.count() == 50


def test_few_rows_are_fetched(spark, monkeypatch):
    """A hundred thousand rows: the stretch is narrowed, only the leaf comes to the driver."""
    monkeypatch.setattr(ranks, "SAMPLE", 256)
    monkeypatch.setattr(ranks, "LEAF", 200)
    big = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).alias("k"))
    order = sorted((i * 7919) % 100_003 for i in range(100_000))
    _, _, found = ranks.rank_keys(big, "k", [1, 33_333, 99_999])
    assert {r: k[0] for r, k in found.items()} == {r: order[r - 1] for r in (1, 33_333, 99_999)}


def test_slices_and_tails_of_empty_tables(df):
    none = df.filter("id < 0")
    assert split.drop_tail(none, "id", 5).count() == 0 and clean.head_n(none, "id", 5).count() == 0
    assert clean.slice_rows(none, "id", 2, -1).count() == 0 and clean.slice_rows(df, "id", -10, -5).count() == 5
    assert split.three_way_split(none, "id", 3, 4).count() == 0
    assert clean.slice_rows(df, "id", 2990, 5000).count() == 10 and clean.slice_rows(df, "id", 10, 10).count() == 0
