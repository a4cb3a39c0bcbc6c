"""Projections, filters and missing values (C)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from mlframe.operators import clean
from mlframe.plans.catalog import query, r6


def _gappy(t):
    """lineitem with zero read as missing in discount and tax."""
    return clean.sentinel_to_null(t("lineitem"), 0.0, ["l_discount", "l_tax"])


_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _KEY.split(", ")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
""")
def feature_target_split(t):
    """Features without the target and unwanted columns, targets apart, matched by key."""
    x, y = clean.split_xy(t("orders"), "o_totalprice", drop=["o_orderdate", "o_orderpriority"], key="o_orderkey")
    return x.join(y, "o_orderkey")


@query("SELECT p_partkey, p_retailprice AS target FROM part")
def inferred_target(t):
    """No candidate name is present, so the last column is the target."""
    df = t("part")
    target = clean.infer_target(df, ["target", "label", "y", "Outcome"])
    return df.select("p_partkey", F.col(target).alias("target"))


@query(f"""
SELECT {_KEY}, l_discount, l_tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0
""")
def complete_rows(t):
    """C3."""
    return clean.drop_missing(_gappy(t), ["l_discount", "l_tax"]).select(*_KEYS, "l_discount", "l_tax")


@query(f"""
SELECT {_KEY}, round(coalesce(nullif(l_discount, 0), (SELECT avg(nullif(l_discount, 0)) FROM lineitem)), 6) AS l_discount,
       round(coalesce(nullif(l_tax, 0), (SELECT avg(nullif(l_tax, 0)) FROM lineitem)), 6) AS l_tax
FROM lineitem
""")
def mean_imputed(t):
    """C4 fitted on the same table."""
    df = clean.impute(_gappy(t), ["l_discount", "l_tax"], "mean")
    return df.select(*_KEYS, r6("l_discount").alias("l_discount"), r6("l_tax").alias("l_tax"))


@query(f"""
SELECT {_KEY}, round(coalesce(nullif(l_tax, 0), (SELECT avg(nullif(l_tax, 0)) FROM lineitem WHERE l_returnflag <> 'R')), 6) AS l_tax
FROM lineitem WHERE l_returnflag = 'R'
""")
def mean_imputed_from_train(t):
    """C4: the mean of one part fills the other."""
    df = _gappy(t)
    out = clean.impute(df.filter("l_returnflag = 'R'"), ["l_tax"], "mean", fit_on=df.filter("l_returnflag <> 'R'"))
    return out.select(*_KEYS, r6("l_tax").alias("l_tax"))


@query(f"""
SELECT {_KEY}, round(coalesce(nullif(l_discount, 0), (SELECT quantile_cont(nullif(l_discount, 0), 0.5) FROM lineitem)), 6) AS l_discount
FROM lineitem
""")
def median_imputed(t):
    """Exact median."""
    return clean.impute(_gappy(t), ["l_discount"], "median").select(*_KEYS, r6("l_discount").alias("l_discount"))


@query(f"""
SELECT {_KEY}, coalesce(nullif(l_discount, 0), -1.0::DOUBLE) AS l_discount, coalesce(nullif(l_tax, 0), 0.5::DOUBLE) AS l_tax
FROM lineitem
""")
def constant_filled(t):
    """C6."""
    return clean.fill_constant(_gappy(t), {"l_discount": -1.0, "l_tax": 0.5}).select(*_KEYS, "l_discount", "l_tax")


@query("""
SELECT count(*) AS n, count(nullif(c_custkey, 0)) AS custkeys, count(nullif(c_nationkey, 0)) AS nations,
       count(nullif(c_acctbal, 0)) AS balances FROM customer
""")
def sentinel_everywhere(t):
    """One value means missing in all numeric columns."""
    df = clean.sentinel_to_null(t("customer"), 0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("custkeys"),
                  F.count("c_nationkey").alias("nations"), F.count("c_acctbal").alias("balances"))


@query(f"""
SELECT {_KEY}, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem
""")
def zero_as_missing(t):
    """Named columns only."""
    return clean.sentinel_to_null(t("lineitem"), 0.0, ["l_discount"]).select(*_KEYS, "l_discount", "l_tax")


@query(f"""
SELECT {_KEY}, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS ratio FROM lineitem
""")
def finite_ratio(t):
    """NaN and infinite quotients become 0."""
    quotient = F.when(F.col("l_tax") != 0, F.col("l_discount") / F.col("l_tax")).otherwise(
        F.when(F.col("l_discount") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    df = t("lineitem").withColumn("ratio", quotient)
    return clean.finite_or(df, ["ratio"], 0.0).select(*_KEYS, r6("ratio").alias("ratio"))


@query("""
WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, value FROM events, f WHERE abs((value - m) / s) < 2.0
""")
def outliers_removed(t):
    """C10."""
    return clean.zscore_filter(t("events", "event_id", "value"), ["value"], 2.0)


@query("SELECT event_id, value FROM events")
def outliers_none_left(t):
    """A limit nothing satisfies keeps every row."""
    return clean.zscore_filter(t("events", "event_id", "value"), ["value"], 0.0)


@query("""
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
""")
def first_of_duplicates(t):
    """C11."""
    df = t("events", "event_id", "ts", "user_id", "event_type", "value")
    return clean.dedupe_first(df, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT vec_id, CASE label WHEN 0 THEN 0 WHEN 6 THEN 1 END AS label FROM embeddings WHERE label IN (0, 6)
""")
def two_labels_kept(t):
    """C12."""
    return clean.filter_remap(t("embeddings", "vec_id", "label"), "label", {0: 0, 6: 1})


@query("SELECT vec_id, label FROM embeddings WHERE label IN (0, 6)")
def two_labels_restored(t):
    """The inverse mapping gives the old labels back."""
    mapping = {0: 0, 6: 1}
    kept = clean.filter_remap(t("embeddings", "vec_id", "label"), "label", mapping)
    return clean.remap(kept, "label", clean.invert_mapping(mapping))


@query("SELECT vec_id, label - 1 AS label FROM embeddings")
def shifted_label(t):
    """C13."""
    return clean.shift_label(t("embeddings", "vec_id", "label"), "label", -1)


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
""")
def orders_in_period(t):
    """C14: the bounds are pushed to the scan."""
    df = clean.time_range(t("orders"), "o_orderdate", datetime(1996, 1, 1), datetime(1997, 12, 31))
    return df.select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
     v AS (SELECT value, row_number() OVER (ORDER BY rn) AS rn FROM r WHERE rn > 144)
SELECT r.event_id, v.value FROM r LEFT JOIN v ON r.rn = v.rn
""")
def column_moved_up(t):
    """The first 144 values are blanked and the rest closes the gap."""
    return clean.compact_column(t("events", "event_id", "ts", "value"), "value", ["ts", "event_id"], 144).drop("ts")


@query("""
SELECT o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn > 100 AND rn <= n - 50
""")
def middle_slice(t):
    """All but the first 100 and the last 50 rows."""
    df = t("orders", "o_orderkey", "o_totalprice", "o_orderdate")
    return clean.slice_rows(df, ["o_orderdate", "o_orderkey"], 100, -50).drop("o_orderdate")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 300")
def first_rows(t):
    """C17: as many rows as there are predictions."""
    return clean.head_n(t("orders", "o_orderkey", "o_totalprice"), "o_orderkey", 300)


@query("""
SELECT p_partkey, round_even(p_retailprice, 0) AS whole, round_even(p_size / 4.0::DOUBLE, 1) AS tenth FROM part
""")
def rounded_half_even(t):
    """C18."""
    df = t("part").select("p_partkey", F.col("p_retailprice").alias("whole"), (F.col("p_size") / 4.0).alias("tenth"))
    return clean.round_half_even(clean.round_half_even(df, ["whole"]), ["tenth"], 1)


@query(f"SELECT {_KEY}, CAST(l_discount > 0.05 AS INTEGER) AS flag FROM lineitem")
def thresholded(t):
    """C19."""
    return clean.binarize(t("lineitem"), "l_discount", 0.05, "flag").select(*_KEYS, "flag")


@query("SELECT p_partkey, CAST(CAST(p_size AS FLOAT) / 4 AS DOUBLE) AS size_q, CAST(p_partkey AS DOUBLE) AS key_d FROM part")
def cast_columns(t):
    """C20."""
    df = t("part", "p_partkey", "p_size").withColumn("key_d", F.col("p_partkey"))
    df = clean.cast_numeric(clean.cast_numeric(df, ["p_size"], "float"), ["key_d"], "double")
    return df.select("p_partkey", (F.col("p_size") / 4).cast("double").alias("size_q"), "key_d")


@query("SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS c_acctbal FROM customer")
def clipped_balance(t):
    """C21."""
    return clean.clip(t("customer", "c_custkey", "c_acctbal"), ["c_acctbal"], 0.0, 5000.0)


@query("""
SELECT vec_id, pos - 1 AS pos, round(greatest(0.0::DOUBLE, least(0.1::DOUBLE, CAST(embedding[pos] AS DOUBLE))), 6) AS cell
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
""")
def clipped_cells(t):
    """C21 on array cells."""
    df = t("embeddings", "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = clean.clip(df, ["embedding"], 0.0, 0.1)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "cell")).withColumn("cell", r6("cell"))


@query("SELECT page_id, length(html) AS n_chars FROM pages WHERE url LIKE 'http%' AND length(html) > 0")
def valid_pages(t):
    """Keep the rows a validity predicate accepts."""
    df = clean.filter_valid(t("pages"), F.col("url").startswith("http") & (F.length("html") > 0))
    return df.select("page_id", F.length("html").alias("n_chars"))
