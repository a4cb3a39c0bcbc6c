"""Vector codes, whitening and toxicity against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.llm import pq, toxicity, vectors, whiten
from mlframe.llm.queries import QUERIES, training_rows

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label string, row string, code int, s0 long, g_key int, v int"


def table(seed=1, n=600, dim=8, scale=1.0):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(n, dim)) * scale + r.integers(0, 3, n)[:, None], 3)
    v[5] = v[6] = v[7]  # repeated vectors
    rows = [(i, [float(x) for x in x], None if i % 7 == 0 else "big" if i % 3 else f"l{i % 5}") for i, x in enumerate(v)]
    rows += [rows[3], (None, rows[9][1], "big"), (900, None, "big"), (901, [1.0, None] * (dim // 2), None), (902, [math.nan] * dim, "l1"),
             (903, [math.inf] * dim, "l1"), (904, [], "l1"), (905, [1.0], "l1")]
    return [(*row, "x", 1, 2, 3, 4) for row in rows]


def whole(rows, dim=8):
    return [r for r in rows if r[1] and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def nearest(x, books):
    d = ((x[:, None, :] - books[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("width,many", [(4, 256), (1, 40), (3, 1), (16, 100)])
def test_orchard_finds_the_nearest_entry(width, many):
    r = np.random.default_rng(width)
    entries = r.integers(-30, 30, (many, width))  # many ties and equal entries
    tree = pq.Orchard(entries)
    x = r.integers(-40, 40, (500, width))
    got, want = tree.search(x), nearest(x, entries)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_orchard_leaves_most_entries_unmeasured():
    r = np.random.default_rng(3)
    entries = (r.normal(size=(256, 3)) * 1000).astype(np.int64)
    tree, met = pq.Orchard(entries), []
    real = tree.entries

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                met.append(len(at))
            return np.asarray(super().__getitem__(at))

    tree.entries = real.view(Counted)
    x = real[r.integers(0, 256, 400)] + r.integers(-50, 50, (400, 3))
    tree.search(x)
    assert sum(met) < 0.5 * 400 * 256


def test_codes(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    books = pq.fit(df, entries=16, rounds=3)
    kept = sorted(whole(rows), key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in kept])
    want = [x[:, p * 2:p * 2 + 2][np.unique([r[0] for r in kept if r[0] is not None], return_index=True)[1][:16]] for p in range(4)]
    for _ in range(3):
        for p in range(4):
            part = x[:, p * 2:p * 2 + 2]
            code, _ = nearest(part, want[p])
            want[p] = np.array([part[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else want[p][e] for e in range(16)])
    assert all((a == b).all() for a, b in zip(books.parts, want))
    found = [nearest(x[:, p * 2:p * 2 + 2], want[p]) for p in range(4)]
    expect = sorted(("%s" % r[0], "".join("%02x" % f[0][i] for f in found), int(sum(f[1][i] for f in found))) for i, r in enumerate(kept))
    out = pq.compress(df, books)
    assert out.columns == [*df.columns, "code_", "error"]
    assert sorted(("%s" % r[0], r["code_"], r["error"]) for r in out.collect()) == expect
    assert pq.fit(df.limit(0)) is None and pq.compress(df.limit(0), None).count() == 0
    assert pq.compress(df.filter("vec_id is null"), books).count() == 1


def test_huge_components_and_odd_lengths(spark):
    df = spark.createDataFrame([(1, [1e12, -1e300, 0.5]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    books = pq.fit(df)
    got = {r.vec_id: (r.code, r.error) for r in pq.compress(df, books).collect()}
    assert got[1] == ("00000000", 0) and got[2] == got[3]
    fitted = whiten.fit(df)
    assert len(fitted.values) == 1 and whiten.whitened(df, fitted).count() == 3


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_group_totals(spark, monkeypatch, bound):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "a" if i % 2 else "b", i, 1, 2) for i in range(50)] + [(99, "z", 1 << 62, 1, 2)] * 2,
                               "id long, label string, error long, g_total int, g_salt int")
    got = sorted((r.id, r.label or "", r.total) for r in vectors.with_group_total(df, "label", "error", "total", lambda d: d).collect())
    want = {}
    for r in df.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    assert got == sorted((r.id, r.label or "", min(want[r.label], (1 << 63) - 1)) for r in df.collect())


def check_whitened(x, fitted, many):
    n, sums = len(x), x.sum(axis=0)
    assert fitted.n == n and fitted.sums == sums.tolist()
    c = (n * x - sums) / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    assert np.allclose(fitted.values, e[::-1][:many], rtol=1e-12)
    assert np.abs(v @ fitted.axes - fitted.axes * fitted.values).max() < 1e-12 * e[-1]
    assert np.abs(fitted.axes.T @ fitted.axes - np.eye(many)).max() < 1e-12
    assert fitted.identity_error < 1e-10 and math.isclose(fitted.trace, e.sum(), rel_tol=1e-12)


def test_whitening(spark):
    rows = table(2, dim=8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = whole(rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in kept])
    fitted = whiten.fit(df, components=5)
    check_whitened(x, fitted, 5)
    out = whiten.whitened(df, fitted)
    assert out.columns == [*df.columns, "deviation", "whitened"]
    n, sums = len(x), x.sum(axis=0)
    want = {tuple(r[1]): (int(((n * v - sums) ** 2).sum()), ((n * v - sums) / n) @ fitted.axes / np.sqrt(fitted.values)) for r, v in zip(kept, x)}
    got = out.collect()
    assert len(got) == len(kept)
    for r in got:
        deviation, coordinates = want[tuple(r.embedding)]
        assert r.deviation == deviation and np.allclose(r.whitened, coordinates, atol=1e-12)


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    fitted = whiten.fit(one)
    assert len(fitted.values) == 0 and [r.whitened for r in whiten.whitened(one, fitted).collect()] == [[]] * 3
    assert whiten.fit(one.limit(0)) is None and whiten.whitened(one.limit(0), None).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert len(whiten.fit(flat).values) == 1  # dependent and constant coordinates


@pytest.mark.parametrize("size,many", [(120, 6), (40, 32), (200, 12), (3, 3), (1, 1)])
def test_jacobi_davidson(size, many):
    """Clustered and equal eigenvalues, with a subspace far smaller than the space."""
    r = np.random.default_rng(size)
    q = np.linalg.qr(r.normal(size=(size, size)))[0]
    e = np.sort(np.r_[r.uniform(0, 1, size)])[::-1].copy()
    if size > 40:
        e[:4] = 9, 5, 5, 4.9999
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, axes, passes = whiten.leading(lambda u: a @ u, size, many)
    tol = (64 + 4 * size) * whiten.EPS * e[0]
    assert np.abs(values - e[:many]).max() < 10 * tol and np.sqrt(((a @ axes - axes * values) ** 2).sum(axis=0)).max() <= 2 * tol
    assert np.abs(axes.T @ axes - np.eye(many)).max() < 1e-12 and passes < 400


def test_minres_solves_in_step():
    r = np.random.default_rng(0)
    a = np.diag(r.uniform(-2, 5, 12))  # indefinite
    b = r.normal(size=(12, 3))
    assert np.allclose(a @ whiten.minres(lambda m: a @ m, b, 40, 1e-12), b, atol=1e-8)


def test_whiten_query(spark):
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").df()
    x = np.floor(64 * np.array(v.embedding.tolist(), float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:32], axes[:, ::-1][:, :32]
    want = np.abs(c @ axes / np.sqrt(e))
    out = QUERIES["op12_whiten"](spark, FOLDER).toPandas()
    assert len(out) == 32 * n and set(out.component) == set(range(1, 33)) and (out.n == n).all()
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(np.abs(got) - want).max() < 1e-8
    first = out.drop_duplicates("vec_id").sort_values("vec_id")
    assert first.deviation.tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()
    shares = out.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(shares, e / np.trace(c.T @ c / n), rtol=1e-10) and out.identity_error.max() < 1e-10


# --- toxicity ----------------------------------------------------------------------------

BAD = ["zorkface", "grumblewit", "snotrag"]


def toxic_corpus(n=1600, seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choices("aeioubcdlmnprst", k=r.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 120))
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "s", "ish"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, training_rows())
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "score_"]
    truth = dict((i, y) for i, _, y in rows)
    held = [(truth[r.doc_id], r["score_"]) for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(0 <= s <= 1 for _, s in held) and len(held) > 300
    caught = [s >= 0.3 for y, s in held if y]
    false = [s >= 0.3 for y, s in held if not y]
    assert np.mean(caught) > 0.9 and np.mean(false) < 0.05
    again = {r.doc_id: r["score_"] for r in toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(3), labels, training_rows())).collect()}
    assert all(abs(again[r.doc_id] - r["score_"]) < 1e-9 for r in scored.collect())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = toxic_corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(training_rows(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, y, training_rows())).collect()} for y in (labels, turned))
    assert a == b


def test_toxicity_without_text_or_labels(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "fine words"), (4, "fine words"), (None, "a b"), (5, "word " * 50_000 + "x" * 100_000)], schema)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(True))).count() == 0
    one = spark.createDataFrame([(4, 1), (1, 0)], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).collect()]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores) and scores.count(0.5) >= 3


def test_risk_takes_the_prior_off():
    """Features as frequent among unlabelled texts as toxic ones there explain have no clean share left."""
    odds = toxicity.log_odds(np.array([50.0, 50.0]), 100, np.array([50.0, 500.0]), 1000, 0.1)
    assert odds[0] > 4 and abs(odds[1]) < 0.2


def test_toxicity_query(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    rows = QUERIES["op13_toxicity"](spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/documents.parquet'").fetchall()[0][0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    assert set(truth) <= {r.doc_id for r in rows}
