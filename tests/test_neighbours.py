import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.operators import balltree, lsh, resample
from mlframe.operators.neighbours import Search, k_best, knn_classify, knn_regress, nearest


@pytest.fixture(scope="module")
def points(spark):
    """Clustered points with copies; group 0 holds more than a third of them."""
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 20, (6, 3))
    group = np.where(rng.random(600) < 0.4, 0, rng.integers(0, 6, 600))
    x = centre[group] + rng.normal(0, 1, (600, 3))
    x[50:60] = x[40:50]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(group[i])) for i in range(600)], "id long, v array<double>, g int")
    return df.repartition(5), x, group


def brute(x, q, train, k, ok=lambda a, b: True):
    out = {}
    for i in q:
        cand = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in train if ok(i, j))
        out[i] = [j for _, j in cand[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("block", [16, 100, 5000])
def test_equals_brute_force(points, block):
    df, x, _ = points
    got = found(nearest(df.filter("id >= 100"), df.filter("id < 100"), "id", "v", 4, block=block))
    assert got == brute(x, range(100), range(100, 600), 4)


def test_within_group_without_self(points):
    df, x, g = points
    got = found(nearest(df, df, "id", "v", 3, within="g", exclude_self=True, block=40))
    assert got == brute(x, range(600), range(600), 3, lambda a, b: a != b and g[a] == g[b])


def test_fewer_rows_than_neighbours(points):
    df, _, _ = points
    assert nearest(df.filter("id < 3"), df.filter("id >= 590"), "id", "v", 5).count() == 10 * 3


def test_most_pairs_of_clustered_rows_are_skipped(spark):
    """Fifty clusters in eight dimensions: a query block meets few leaves beside its own."""
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 50, (50, 8))
    x = centre[rng.integers(0, 50, 6000)] + rng.normal(0, 1, (6000, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(8)
    search = Search(df.filter("id >= 500"), df.filter("id < 500"), "id", "v", 5, None, False, (), 64)
    met, every = search.row_pairs()
    assert every == 500 * 5500 and met < 0.1 * every
    got = {}
    for r in search.result().orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(x, range(500), range(500, 6000), 5)


def test_leaves_are_small_or_of_equal_rows(spark):
    """One vector makes up a third of the rows; everything else fits its leaf, in two groups."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(900)[:, None] < 0.35, 7.0, rng.normal(0, 3, (900, 2)))
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "id long, v array<double>, g int")
    rows = df.select(balltree.root_of("g").alias("cell"), "id", "v")
    tree = balltree.grow(rows, 20)
    leaves = tree.leaves.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("vectors")).collect()
    assert sum(r["n"] for r in leaves) == 900 and all(r["n"] <= 20 or r["vectors"] == 1 for r in leaves)
    for c in tree.children:
        for r in c.collect():
            inside = [row["v"] for row in tree.leaves.filter(F.col("cell").startswith(r["cell"] + "/") | (F.col("cell") == r["cell"])).collect()] if r["n"] < 30 else []
            assert all(np.sqrt(((np.array(v) - r["centre"]) ** 2).sum()) <= r["radius"] * (1 + 1e-12) for v in inside)


def test_equals_brute_force_by_shuffled_pivots(points, monkeypatch):
    """Pivots too large to be sent to the tasks meet their rows by cell and salt."""
    monkeypatch.setattr(balltree, "TABLE_BYTES", 0)
    monkeypatch.setattr(balltree, "GROUP_ROWS", 100)
    df, x, g = points
    got = found(nearest(df.filter("id >= 100"), df.filter("id < 100"), "id", "v", 4, within="g", block=16))
    assert got == brute(x, range(100), range(100, 600), 4, lambda a, b: g[a] == g[b])


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-3, 1e6), (1e5, 0.0)])
def test_k_best_is_exact_where_matrix_products_round(scale, shift):
    rng = np.random.default_rng(2)
    rows = np.round(rng.normal(0, 2, (300, 5))) * scale + shift
    asked = np.vstack([rows[:40], rng.normal(0, 2, (40, 5)) * scale + shift])
    at, place, gap = k_best(asked, np.full(80, np.inf), rows, 7)
    for i in range(80):
        d = np.sqrt(((rows - asked[i]) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(300), d))[:7]
        mine = at == i
        order = np.lexsort((place[mine], gap[mine]))[:7]
        assert place[mine][order].tolist() == want.tolist() and gap[mine][order].tolist() == d[want].tolist()


def test_query_rows_without_candidates_stay(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, None, "a"), (4, [float("nan"), 0.0], "a")], "id long, v array<double>, g string")
    query = spark.createDataFrame([(11, [0.0, 1.0], "a"), (12, [0.0, 1.0], "b"), (13, [5.0, 0.0], None), (14, None, "a"), (15, [float("inf"), 0.0], "a")], train.schema)
    got = {r["id"]: (r["rank"], r["neighbour"], r["distance"]) for r in nearest(train, query, "id", "v", 3, within="g").collect()}
    assert got == {11: (1, 1, 1.0), 12: (1, None, None), 13: (1, 2, 4.0), 14: (1, None, None), 15: (1, None, None)}
    assert {r["prediction"] for r in knn_classify(train.limit(0), query, "id", "v", "g").collect()} == {None}
    assert nearest(train, query.limit(0), "id", "v", 2).count() == 0


def test_votes_and_means(points):
    df, x, g = points
    train, test = df.filter("id >= 100"), df.filter("id < 100")
    near = brute(x, range(100), range(100, 600), 5)
    for r in knn_classify(train, test, "id", "v", "g", 5).collect():
        votes = [int(g[j]) for j in near[r["id"]]]
        assert r["prediction"] == min(set(votes), key=lambda c: (-votes.count(c), c))
    for r in knn_regress(train, test, "id", "v", "g", 5).collect():
        assert np.isclose(r["prediction"], np.mean([g[j] for j in near[r["id"]]]))


def test_smote_points_lie_between_neighbours_of_the_class(points):
    df, x, g = points
    out = resample.smote(df, "id", "v", "g", 3, "auto", 2)
    sizes = {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}
    assert set(sizes.values()) == {int((g == 0).sum())}
    near = brute(x, range(600), range(600), 3, lambda a, b: a != b and g[a] == g[b])
    for r in out.filter("draw > 0").collect():
        base, p = x[r["id"]], np.array(r["v"])
        assert g[r["id"]] == r["g"]
        gaps = []
        for j in near[r["id"]]:
            d = x[j] - base
            u = np.clip(((p - base) @ d) / max(d @ d, 1e-300), 0, 1)
            gaps.append(np.abs(base + u * d - p).max())
        assert min(gaps) < 1e-9
    assert out.select("id", "draw").distinct().count() == out.count()


def test_smote_refuses_to_shrink_and_single_rows(points, spark):
    df, _, _ = points
    with pytest.raises(ValueError):
        resample.smote(df, "id", "v", "g", 3, {0: 10})
    lone = spark.createDataFrame([(i, [float(i)], 0 if i else 1) for i in range(5)], "id long, v array<double>, g int")
    with pytest.raises(ValueError):
        resample.smote(lone, "id", "v", "g")


def test_smote_categories_come_from_the_neighbours(points):
    df, _, g = points
    df = df.withColumn("c", F.when(F.col("g") % 2 == 0, "even").otherwise("odd"))
    out = resample.smote_nc(df, "id", "v", "g", ["c"], 3, "auto", 2)
    assert out.filter((F.col("c") == "even") != (F.col("g") % 2 == 0)).count() == 0
    assert out.groupBy("g").count().select("count").distinct().count() == 1


def test_draws_are_reproducible(points, partitions):
    df, _, _ = points
    runs = [partitions(n, lambda: sorted(map(tuple, resample.oversample(df.select("id", "g").repartition(n), "id", "g", "auto", 9).collect())))
            for n in (1, 8)]
    assert runs[0] == runs[1]


def test_more_groups_than_rows_of_a_leaf(spark):
    df = spark.createDataFrame([(i, [float(i // 3), 0.0], f"group {i % 1500}") for i in range(4500)], "id long, v array<double>, g string")
    got = nearest(df, df, "id", "v", 2, within="g", exclude_self=True)
    assert got.count() == 9000 and got.filter("neighbour % 1500 <> id % 1500").count() == 0


def test_many_copies_are_no_square_of_pairs(spark):
    """Half of the rows are one vector, and all of them are asked: only the smallest keys of the copies are compared."""
    x = [[1.0, 1.0] if i % 2 else [float(i), -1.0] for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    search = Search(df, df, "id", "v", 3, None, True, (), 64)
    met, every = search.row_pairs()
    assert met < 0.15 * every
    got = {}
    for r in search.result().filter("id % 2 = 1").orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    assert got == {i: [(j, 0.0) for j in (1, 3, 5, 7) if j != i][:3] for i in range(1, 3000, 2)}


def test_probing_finds_most_neighbours(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(0, 4, (60, 12))
    x = centre[rng.integers(0, 60, 4000)] + rng.normal(0, 1, (4000, 12))
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x.tolist())] + [(5000, None, 0)], "id long, v array<double>, g int")
    train, query = df.filter("id >= 400"), df.filter("id < 400 or id = 5000")
    hashing = lsh.fit(train, query, "id", "v", 5)
    found = lsh.approximate_nearest(train, query, "id", "v", 5, hashing, carry=["g"])
    rows = {(r["id"], r["rank"]): r for r in found.collect()}
    exact = nearest(train, query, "id", "v", 5)
    measured = lsh.measured_recall(found, exact, "id").first()
    assert measured["asked"] == 400 and measured["pairs"] == 2000 and measured["recall"] >= 0.9
    for (i, _), r in rows.items():
        if r["neighbour"] is not None:
            assert np.isclose(r["distance"], np.sqrt(((x[i] - x[r["neighbour"]]) ** 2).sum())) and r["g"] == r["neighbour"] % 3
    assert rows[(5000, 1)]["neighbour"] is None
    own = hashing.buckets(x[400:], 0)[:, :, 0]
    probed = hashing.buckets(x[:400], hashing.probes)
    met = np.mean([(own[:, :, None] == p[None]).any(axis=(1, 2)).mean() for p in probed])
    assert met < 0.5  # less than half of the rows are candidates


def test_probes_cross_the_nearest_walls():
    hashing = lsh.Hashing(np.eye(2).reshape(2, 1, 2), np.zeros((1, 2)), 1.0, 1, 1.0)
    keys = hashing.buckets(np.array([[0.1, 0.5], [0.5, 0.9], [-0.9, 0.5], [0.5, 1.5]]), 1)[:, 0]
    assert keys[0, 1] == keys[2, 0] and keys[1, 1] == keys[3, 0]  # one cell down on the first axis, one up on the second


def test_approximate_search_without_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in lsh.approximate_nearest(df.limit(0), df, "id", "v", 2).collect()] == [(1, 1, None, None)]
    assert lsh.approximate_nearest(df, df.limit(0), "id", "v", 2).count() == 0


def test_groups_of_blocks_leave_k_rows_a_query(spark):
    """Blocks that meet many leaves leave k rows a query and group of leaves, and the k closest are among them."""
    x = np.random.default_rng(5).normal(size=(600, 6)).round(1)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    search = Search(df, df, "id", "v", 3, None, True, (), 32)
    assert search._meet_groups().count() <= 3 * 600 * search.groups[1] < search.visits.count() * 32 * 3
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    want = {(i, r + 1, int(j)) for i in range(600) for r, j in enumerate(np.lexsort((np.arange(600), gaps[i]))[:3])}
    assert {(r["id"], r["rank"], r["neighbour"]) for r in search.result().collect()} == want
