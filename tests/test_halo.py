"""Windows over blocks with a halo: series over many slices, short slices, nulls, and what moves."""

import random

import pytest
from pyspark.sql import functions as F

from mlframe.operators import halo, sequence

SCHEMA = "id long, grp string, v double, s string, other string"


def rows(n=1200):
    """A third of the rows are one series; many are short; one has no name."""
    r = random.Random(1)
    out = [(i, "big" if i % 3 == 0 else None if i % 31 == 0 else f"g{r.randint(0, 40)}", None if i % 17 == 0 else float(i), None if i % 5 == 0 else f"s{i}", "x" * 9) for i in range(n)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def series(group=True):
    out = {}
    for r in sorted(rows()):
        out.setdefault(r[1] if group else 0, []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("group,length,stride,block", [(True, 5, 2, 16), (False, 30, 7, 50), (True, 1, 1, 8192), (False, 64, 1, 1)])
def test_windows(df, partitions, parts, group, length, stride, block):
    want = {}
    for s in series(group).values():
        for i in range(0, len(s) - length + 1, stride):
            want[s[i][0]] = (i + 1, [x[2] for x in s[i:i + length]], [x[3] for x in s[i:i + length]])
    got = partitions(parts, lambda: sequence.sliding_windows(df, ["v", "s"], "id", length, stride, "grp" if group else (), block).collect())
    assert len(got) == len(want) and {r["id"]: (r["step"], r["v_window"], r["s_window"]) for r in got} == want


@pytest.mark.parametrize("parts", [1, 40])
@pytest.mark.parametrize("ahead", [1, 90])
def test_values_ahead(df, partitions, parts, ahead):
    """Slices of some 30 rows are shorter than the look-ahead: rows come from several of them."""
    want = {s[i][0]: (s[i][4], i + 1, s[i + ahead][2]) for s in series().values() for i in range(len(s) - ahead)}
    got = partitions(parts, lambda: sequence.lead_target(df, "v", ahead, "id", "grp", "then", 20).collect())
    assert {r["id"]: (r["other"], r["step"], r["then"]) for r in got} == want and len(got) == len(want)


def test_border_rows_by_shuffle(df, partitions, monkeypatch):
    monkeypatch.setattr(halo, "BROADCAST_ROWS", 0)
    got = partitions(9, lambda: sequence.window_horizon(df, ["v"], "v", "id", 4, 3, 1, "grp", 32).collect())
    want = {s[i][0]: ([x[2] for x in s[i:i + 4]], s[i + 6][2]) for s in series().values() for i in range(len(s) - 6)}
    assert {r["id"]: (r["v_window"], r["target"]) for r in got} == want


def test_ordered_rows_move_once(df):
    """What reads the blocks joins tables of a row per slice: no exchange of the blocks, no window, no sort."""
    out = sequence.sliding_windows(df, ["v"], "id", 5, 1, "grp")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "rangepartitioning" not in plan


def test_empty_and_short_tables(df):
    assert sequence.sliding_windows(df.filter("id < 0"), ["v"], "id", 3).count() == 0
    assert sequence.sliding_windows(df.filter("id < 2"), ["v"], "id", 3).count() == 0
    assert [r["v_window"] for r in sequence.sliding_windows(df.filter("id < 3"), ["v"], "id", 3).collect()] == [[None, 1.0, 2.0]]


def test_numbering_across_slices():
    edge = lambda part, n, first, last, run, pos: {"part": part, "n": n, "first": first, "last": last, "last_run": run, "last_pos": pos}
    edges = [edge(0, 5, "a", "a", 0, 4), edge(2, 3, "a", "a", 0, 2), edge(3, 4, "a", "c", 2, 0), edge(4, 2, "d", "d", 0, 1)]
    numbers, follow = halo._borders(edges, 4)
    assert numbers == [(0, 0, 0), (2, 0, 5), (3, 0, 8), (4, 3, 0)]
    assert [f[:4] for f in follow] == [(0, 2, 1, 3), (0, 3, 2, 1), (2, 3, 1, 4), (3, 4, 1, 2)]


def test_nan_is_one_series(spark):
    df = spark.createDataFrame([(i, float("nan") if i < 10 else 1.0) for i in range(20)], "id long, g double")
    assert sequence.lead_target(df, "id", 1, "id", "g", "then", 4).groupBy(F.isnan("g").alias("n")).count().orderBy("n").collect() == [(False, 9), (True, 9)]
