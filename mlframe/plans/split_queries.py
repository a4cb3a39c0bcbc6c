"""Splits, folds, samples, batches, oversampling and neighbours (T, I10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.operators import lsh, neighbours, resample, split
from mlframe.plans.catalog import query, r6


def _hashed(table: str, key: str, seed: int, label: str | None = None, where: str = "TRUE") -> str:
    """CTE r: rows with rn, their place in the hash order (of their label), and n."""
    part = f"PARTITION BY {label}" if label else ""
    order = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key.split(", "))
    return (f"r AS (SELECT *, row_number() OVER ({part} ORDER BY md5('{seed}:' || {order})) AS rn, "
            f"count(*) OVER ({part}) AS n FROM {table} WHERE {where})")


def _u60(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


_FOLD = """CASE WHEN rn <= (n % {k}) * (n // {k} + 1) THEN (rn - 1) // (n // {k} + 1)
                ELSE n % {k} + (rn - 1 - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"""


@query(f"WITH {_hashed('orders', 'o_orderkey', 7)} SELECT o_orderkey, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS split FROM r")
def shuffled_split(t):
    """Exact sizes, tagged without a shuffle."""
    return split.tag_split(t("orders", "o_orderkey"), "o_orderkey", 0.2, 7)


@query("""
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn > n - ceil(0.3 * n)
""")
def tail_as_test(t):
    """The test part of an unshuffled split."""
    return split.train_test_split(t("orders", "o_orderkey", "o_totalprice"), "o_orderkey", 0.3, shuffle=False)[1]


@query("""
SELECT event_id, CASE WHEN rn <= 500 THEN 'train' WHEN rn <= 700 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
""")
def three_way_split(t):
    """T3."""
    return split.three_way_split(t("events", "event_id", "ts"), ["ts", "event_id"], 500, 200).drop("ts")


@query(f"""
WITH {_hashed('orders', 'o_orderkey', 3, 'o_orderpriority')}
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= n - ceil(0.25 * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def stratified_split(t):
    """T4."""
    return split.tag_split(t("orders", "o_orderkey", "o_orderpriority"), "o_orderkey", 0.25, 3, "o_orderpriority")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn > floor(n * 0.8)
""")
def validation_tail(t):
    """T5."""
    return split.validation_tail(t("orders", "o_orderkey"), "o_orderkey", 0.2)[1]


@query(f"WITH {_hashed('events', 'event_id', 1)} SELECT event_id, {_FOLD.format(k=7)} AS fold FROM r")
def folds(t):
    """T6."""
    return split.kfold(t("events", "event_id"), "event_id", 7, 1)


@query(f"WITH {_hashed('events', 'event_id', 1, 'event_type')} SELECT event_id, event_type, {_FOLD.format(k=5)} AS fold FROM r")
def stratified_folds(t):
    """T7."""
    return split.stratified_kfold(t("events", "event_id", "event_type"), "event_id", "event_type", 5, 1)


@query(f"WITH {_hashed('orders', 'o_orderkey', 4, 'o_custkey')} SELECT o_orderkey, o_custkey, {_FOLD.format(k=3)} AS fold FROM r")
def many_label_folds(t):
    """T7 with thousands of labels."""
    return split.stratified_kfold(t("orders", "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 3, 4)


@query(f"""
WITH {_hashed('orders', 'o_orderkey', 6, 'o_custkey')}
SELECT o_orderkey, o_custkey, CASE WHEN rn <= n - ceil(0.25 * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def many_label_split(t):
    """T4 with thousands of labels."""
    return split.tag_split(t("orders", "o_orderkey", "o_custkey"), "o_orderkey", 0.25, 6, "o_custkey")


@query(f"""
WITH {_hashed('orders', 'o_orderkey', 11)} SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM r WHERE rn > n - ceil(0.1 * n)
""")
def blocks_split_together(t):
    """Three blocks split alike, their test parts joined again by key."""
    df = t("orders")
    blocks = [df.select("o_orderkey", c) for c in ("o_totalprice", "o_orderstatus", "o_orderpriority")]
    parts = split.aligned_split(blocks, "o_orderkey", 0.1, 11)
    return split.join_blocks([test for _, test in parts], "o_orderkey")


@query(f"""
WITH {_hashed('orders', 'o_orderkey', 5, 'o_orderstatus', "o_orderstatus IN ('F', 'O')")},
need AS (SELECT o_orderstatus, max(n) AS n, unnest(range(1, CASE o_orderstatus WHEN 'F' THEN 8000 ELSE 6000 END * (SELECT count(*) FROM orders) // 15000 - max(n) + 1)) AS draw
         FROM r GROUP BY o_orderstatus)
SELECT o_orderkey, o_orderstatus, 0 AS draw FROM orders
UNION ALL SELECT r.o_orderkey, r.o_orderstatus, d.draw FROM need d JOIN r ON r.o_orderstatus = d.o_orderstatus
  AND r.rn = 1 + {_u60("'5'", 'd.o_orderstatus', 'd.draw')} % d.n
""")
def oversampled_to_targets(t):
    """Class targets scaled with the table; draws with replacement."""
    df = t("orders", "o_orderkey", "o_orderstatus")
    n = df.count()
    return resample.oversample(df, "o_orderkey", "o_orderstatus", {"F": 8000 * n // 15000, "O": 6000 * n // 15000}, 5)


@query(f"""
WITH {_hashed('labels', 'doc_id', 2, 'toxic')}, top AS (SELECT max(n) AS m FROM r),
need AS (SELECT toxic, max(n) AS n, unnest(range(1, (SELECT m FROM top) - max(n) + 1)) AS draw FROM r GROUP BY toxic)
SELECT doc_id, toxic, 0 AS draw FROM labels
UNION ALL SELECT r.doc_id, r.toxic, d.draw FROM need d JOIN r ON r.toxic = d.toxic AND r.rn = 1 + {_u60("'2'", 'd.toxic', 'd.draw')} % d.n
""")
def oversampled_auto(t):
    """Every class lifted to the largest."""
    return resample.oversample(t("labels", "doc_id", "toxic"), "doc_id", "toxic", "auto", 2)


_VEC = "(SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)"


@query(f"""
WITH {_hashed(_VEC, 'vec_id', 4, 'label')}, top AS (SELECT max(n) AS m FROM r),
need AS (SELECT label, max(n) AS n, unnest(range(1, (SELECT m FROM top) - max(n) + 1)) AS draw FROM r GROUP BY label),
d AS (SELECT label, draw, 1 + {_u60("'4'", 'label', 'draw')} % n AS rn, 1 + {_u60("'4'", 'label', 'draw', "'n'")} % least(5, n - 1) AS rank,
             {_u60("'4'", 'label', 'draw', "'u'")} / 1152921504606846976.0::DOUBLE AS u FROM need),
nn AS (SELECT a.vec_id, b.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
       FROM {_VEC} a JOIN {_VEC} b ON a.label = b.label AND a.vec_id <> b.vec_id),
made AS (SELECT r.vec_id, d.label, d.draw, d.u, r.v AS a, nn.v AS b FROM d JOIN r ON r.label = d.label AND r.rn = d.rn
         JOIN nn ON nn.vec_id = r.vec_id AND nn.rank = d.rank)
SELECT vec_id, label, 0 AS draw, pos - 1 AS pos, round(v[pos], 6) AS cell FROM (SELECT *, unnest(range(1, 65)) AS pos FROM {_VEC})
UNION ALL SELECT vec_id, label, draw, pos - 1, round(a[pos] + u * (b[pos] - a[pos]), 6) FROM (SELECT *, unnest(range(1, 65)) AS pos FROM made)
""")
def smote_points(t):
    """Every class lifted to the largest with interpolated points."""
    out = resample.smote(t("embeddings"), "vec_id", "embedding", "label", 5, "auto", 4)
    return out.select("vec_id", "label", "draw", F.posexplode("embedding").alias("pos", "cell")).withColumn("cell", r6("cell"))


@query()
def smote_mixed_points(t):
    """Numeric cells interpolated, a category voted by the neighbours (rows only)."""
    df = t("events").select("event_id", "event_type", F.array("value", F.col("user_id").cast("double")).alias("v"),
                            F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("week").alias("part"))
    out = resample.smote_nc(df, "event_id", "v", "event_type", ["part"], 5, "auto", 3)
    return out.groupBy("event_type", F.col("draw") > 0, "part").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("(draw > 0)", "made")


@query("""
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 32 AS batch FROM events
""")
def batches_in_order(t):
    """Batches of 32, the last one partial."""
    return split.assign_batches(t("events", "event_id", "ts"), 32, order_by=["ts", "event_id"]).drop("ts")


@query(f"WITH {_hashed('events', 'event_id', 9)} SELECT event_id, (rn - 1) // 100 AS batch FROM r")
def batches_shuffled(t):
    """T12."""
    return split.assign_batches(t("events", "event_id"), 100, key="event_id", seed=9)


@query(f"""
WITH {_hashed('customer', 'c_custkey', 6)}, d AS (SELECT unnest(range(1, (SELECT count(*) FROM customer) // 2 + 1)) AS draw)
SELECT c_custkey, c_acctbal, 0 AS draw FROM customer
UNION ALL SELECT r.c_custkey, r.c_acctbal, d.draw FROM d JOIN r ON r.rn = 1 + {_u60("'6'", 'd.draw')} % r.n
""")
def augmented_with_draws(t):
    """Half as many rows again, drawn with replacement."""
    df = t("customer", "c_custkey", "c_acctbal")
    return resample.augment_with_replacement(df, "c_custkey", df.count() // 2, 6)


@query(f"""
WITH {_hashed('customer', 'c_custkey', 3)}, d AS (SELECT b.bag, unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS draw FROM range(4) b(bag)),
p AS (SELECT bag, 1 + {_u60("3 + bag + 1", 'draw')} % (SELECT count(*) FROM customer) AS rn, count(*) AS times FROM d GROUP BY ALL)
SELECT c_custkey, bag, times FROM r JOIN p USING (rn)
""")
def bagged_draws(t):
    """How often each of four bags draws a row."""
    out = resample.bag_counts(t("customer", "c_custkey"), "c_custkey", 4, 3)
    return out.select("c_custkey", F.posexplode("drawn").alias("bag", "times")).filter("times > 0")


@query("SELECT n_nationkey, unnest(range(1, 4)) AS copy FROM nation")
def rows_replicated(t):
    """Every row three times."""
    return resample.replicate(t("nation", "n_nationkey"), 3)


@query("SELECT p_partkey, unnest(range(1, p_size + 1)) AS copy FROM part")
def rows_replicated_by_column(t):
    """As many copies as a column says."""
    return resample.replicate(t("part", "p_partkey", "p_size"), F.col("p_size")).drop("p_size")


@query(f"WITH {_hashed('documents', 'doc_id', 8)} SELECT doc_id, lang FROM r WHERE rn <= 50")
def sample_of_rows(t):
    """50 distinct rows."""
    return split.sample_k(t("documents", "doc_id", "lang"), "doc_id", 50, 8)


@query("""
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn <= n - 1000
""")
def tail_dropped(t):
    """The last rows in label order go, so the last class becomes rare."""
    return split.drop_tail(t("orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus", "o_orderkey"], 1000)


_TRAIN = f"{_hashed(_VEC, 'vec_id', 5)}, s AS (SELECT *, CASE WHEN rn <= n - ceil(0.25 * n) THEN 'train' ELSE 'test' END AS split FROM r)"
_NEAR = """, nn AS (SELECT q.vec_id, q.label AS truth, t.vec_id AS neighbour, t.label, list_distance(q.v, t.v) AS d,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rank
   FROM (SELECT * FROM s WHERE split = 'test') q JOIN (SELECT * FROM s WHERE split = 'train') t ON q.split <> t.split)"""


def _train_test(t):
    return split.train_test_split(t("embeddings"), "vec_id", 0.25, 5)


@query(f"WITH {_TRAIN}{_NEAR} SELECT vec_id, rank, neighbour, round(d, 6) AS distance FROM nn WHERE rank <= 5")
def nearest_neighbours(t):
    """The 5 closest training rows of each test row; small blocks exercise the block join."""
    train, test = _train_test(t)
    return neighbours.nearest(train, test, "vec_id", "embedding", 5, block=128).withColumn("distance", r6("distance"))


@query(f"""
WITH {_TRAIN}{_NEAR}, votes AS (SELECT vec_id, label, count(*) AS c FROM nn WHERE rank <= 5 GROUP BY ALL)
SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM votes) WHERE r = 1
""")
def neighbour_vote(t):
    """I10."""
    train, test = _train_test(t)
    return neighbours.knn_classify(train, test, "vec_id", "embedding", "label", 5)


@query(f"WITH {_TRAIN}{_NEAR} SELECT vec_id, round(avg(label), 6) AS prediction FROM nn WHERE rank <= 5 GROUP BY vec_id")
def neighbour_mean(t):
    """I10."""
    train, test = _train_test(t)
    return neighbours.knn_regress(train, test, "vec_id", "embedding", "label", 5).withColumn("prediction", r6("prediction"))


@query()
def approximate_neighbours(t):
    """I10, approximate: neighbours by projection hashing; `approximate_recall` measures them."""
    train, test = _train_test(t)
    return lsh.approximate_nearest(train, test, "vec_id", "embedding", 5).withColumn("distance", r6("distance"))


@query(f"WITH {_TRAIN} SELECT count(*) AS asked, 5 * count(*) AS pairs, true AS reached FROM s WHERE split = 'test'")
def approximate_recall(t):
    """I10, approximate: at least 0.9 of the true neighbours of all query rows are found."""
    train, test = _train_test(t)
    found = lsh.approximate_nearest(train, test, "vec_id", "embedding", 5)
    rate = lsh.measured_recall(found, neighbours.nearest(train, test, "vec_id", "embedding", 5), "vec_id")
    return rate.select("asked", "pairs", (F.col("recall") >= 0.9).alias("reached"))
