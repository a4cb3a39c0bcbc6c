"""Ranking, sorting, joining predictions, user functions (R, U)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from mlframe.functions import metrics, rowfunc
from mlframe.operators import publish
from mlframe.plans.catalog import query


@query("SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) AS rank FROM part")
def ranked_by_score(t):
    """Best first, equal scores share a rank."""
    return publish.rank_results(t("part", "p_partkey", "p_retailprice"), "p_retailprice")


@query("SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY o_orderpriority")
def ranked_groups(t):
    """R1 on a result table."""
    table = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return publish.rank_results(table, "n")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def sorted_two_ways(t):
    """R2: one key up, the other down."""
    return publish.sort_rows(t("customer", "c_custkey", "c_mktsegment", "c_acctbal"), [("c_mktsegment", True), ("c_acctbal", False)])


@query("""
SELECT l_orderkey, l_suppkey, l_returnflag, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3
""")
def top_three_per_group(t):
    """R3."""
    df = t("lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return publish.top_per_group(df, "l_returnflag", [F.col("l_extendedprice").desc(), "l_orderkey", "l_suppkey"], 3)


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_total(t):
    """Over the whole table."""
    out = publish.running_sum(t("events", "event_id", "ts", "value"), "value", ["ts", "event_id"])
    return out.select("event_id", F.round("running", 4).alias("running"))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events
""")
def running_total_per_group(t):
    """R4 per group."""
    out = publish.running_sum(t("events", "event_id", "ts", "value", "event_type"), "value", ["ts", "event_id"], partition_by=["event_type"])
    return out.select("event_id", F.round("running", 4).alias("running"))


@query("SELECT DISTINCT l_discount FROM lineitem")
def thresholds_sorted(t):
    """R5."""
    return publish.sorted_thresholds(t("lineitem"), "l_discount")


@query("""
SELECT o.o_orderkey, p.pred AS target FROM orders o LEFT JOIN (
  SELECT l_orderkey, round(sum(l_extendedprice), 2) AS pred FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey
""")
def predictions_in_template(t):
    """Predictions by key; rows without one stay."""
    pred = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("pred"))
    return publish.submit(t("orders", "o_orderkey"), pred, "o_orderkey", {"target": "pred"})


@query("SELECT p_partkey, p_size * 2 AS doubled, CAST(p_size > 25 AS INTEGER) AS large FROM part")
def columns_appended(t):
    """R7."""
    out = publish.append_columns(t("part", "p_partkey", "p_size"), {
        "doubled": F.col("p_size") * 2, "large": (F.col("p_size") > 25).cast("int")})
    return out.drop("p_size")


@query("SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def values_of_two_tables(t):
    """R8."""
    return publish.union_values(t("customer").withColumnRenamed("c_nationkey", "nationkey"),
                                t("supplier").withColumnRenamed("s_nationkey", "nationkey"), "nationkey")


@query("SELECT DISTINCT lang FROM documents")
def labels_distinct(t):
    """R9."""
    return publish.distinct_labels(t("documents"), "lang")


@query("SELECT count(DISTINCT p_brand) AS n_labels FROM part")
def labels_counted(t):
    """R9."""
    return publish.label_count(t("part"), "p_brand")


@query("SELECT p_partkey, p_size * p_size + 1 AS mapped FROM part")
def column_function(t):
    """As a column expression."""
    return rowfunc.map_column(t("part", "p_partkey", "p_size"), "p_size", lambda c: c * c + 1, out="mapped").drop("p_size")


@query("SELECT p_partkey, p_size % 3 AS mapped FROM part")
def column_function_pandas(t):
    """As a pandas function."""
    def third(s: pd.Series) -> pd.Series:
        return s % 3
    return rowfunc.map_column(t("part", "p_partkey", "p_size"), "p_size", third, "long", "mapped").drop("p_size")


@query("SELECT p_partkey, length(p_name) AS n_chars, len(string_split(p_name, ' ')) AS n_words FROM part")
def row_function(t):
    """Several named results per row."""
    def measure(name: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_chars": name.str.len(), "n_words": name.str.split(" ").str.len()})
    out = rowfunc.row_features(t("part", "p_partkey", "p_name"), measure, ["p_name"], "n_chars long, n_words long")
    return out.drop("p_name")


@query("""
SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(max(abs(l_extendedprice - l_quantity * 1500)), 4) AS worst
FROM lineitem GROUP BY l_returnflag
""")
def user_metric(t):
    """Own metrics as aggregate expressions, per group."""
    df = t("lineitem").withColumn("p", F.col("l_quantity") * 1500)
    own = {"mae": metrics.mae, "worst": lambda y, p: F.max(F.abs(F.col(y) - F.col(p)))}
    out = rowfunc.user_metrics(df, "l_extendedprice", "p", own, ["l_returnflag"])
    return out.select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("worst", 4).alias("worst"))


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def one_row_to_many(t):
    """U4: a pandas function that returns more rows than it gets."""
    def split_name(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(word=pdf["p_name"].str.split(" ")).explode("word")[["p_partkey", "word"]]
    return rowfunc.one_to_many(t("part", "p_partkey", "p_name"), split_name, "p_partkey long, word string")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 10, 4) AS x10 FROM embeddings")
def column_lambda(t):
    """U1 on a derived column."""
    df = t("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return rowfunc.map_column(df, "x", lambda c: F.round(c * 10, 4), out="x10").drop("x")


