"""Sources and sinks, profiling (S, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.operators import profile
from mlframe.plans.catalog import query, r6
from mlframe.session import scratch_path
from mlframe.sources import load_arrays, load_table, read_csv, save_arrays, write_csv
from mlframe.operators.text import words


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_round_trip(t):
    """Write a table as CSV and read it back with an explicit schema."""
    df = t("customer")
    path = scratch_path(t.spark, "csv")
    write_csv(df, path)
    return read_csv(t.spark, path, df.schema, key="c_custkey")


@query("""
SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_without_key(t):
    """S3: write without the row id."""
    df = t("customer")
    path = scratch_path(t.spark, "csv")
    write_csv(df, path, key="c_custkey", keep_key=False)
    return read_csv(t.spark, path, df.drop("c_custkey").schema)


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def load_sample_table(t):
    """S2."""
    return load_table(t.spark, t.folder, "part").select("p_partkey", "p_size", "p_retailprice")


@query("""
SELECT vec_id, label, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS cell
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
""")
def stored_arrays(t):
    """Store feature arrays and load them again."""
    path = scratch_path(t.spark, "arrays")
    save_arrays(t("embeddings"), path)
    back = load_arrays(t.spark, path)
    return back.select("vec_id", "label", F.posexplode("embedding").alias("pos", "cell")).withColumn(
        "cell", F.col("cell").cast("double"))


@query("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_shape(t):
    """P1."""
    return profile.shape(t("lineitem"))


@query("""
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS non_null, 'bigint' AS type FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey), 'bigint' FROM orders
UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), 'string' FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice), 'double' FROM orders
UNION ALL SELECT 'o_orderdate', count(o_orderdate), 'timestamp_ntz' FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), 'string' FROM orders
""")
def table_info(t):
    """P2."""
    return profile.info(t("orders"))


_DESCRIBE = """
SELECT '{c}' AS column_name, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std,
       CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max
FROM lineitem"""
_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("\nUNION ALL\n".join(_DESCRIBE.format(c=c) for c in _DESCRIBED))
def numeric_summary(t):
    """Describe with exact quartiles."""
    out = profile.describe(t("lineitem", *_DESCRIBED))
    return out.select("column_name", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min",
                      r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), "max")


@query("""
SELECT 'l_orderkey' AS column_name, count(*) FILTER (l_orderkey IS NULL) AS missing FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (nullif(l_discount, 0) IS NULL) FROM lineitem
UNION ALL SELECT 'l_tax', count(*) FILTER (nullif(l_tax, 0) IS NULL) FROM lineitem
""")
def missing_counts(t):
    """P4 (with zero as the missing mark, C8)."""
    from mlframe.operators.clean import sentinel_to_null
    df = sentinel_to_null(t("lineitem", "l_orderkey", "l_discount", "l_tax"), 0.0, ["l_discount", "l_tax"])
    return profile.null_counts(df)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def segment_value_counts(t):
    """P5."""
    return profile.value_counts(t("customer"), "c_mktsegment")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def size_unique_counts(t):
    """P6."""
    return profile.unique_counts(t("part"), "p_size")


@query("""
SELECT o_orderpriority, count(*) AS n,
       round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * CAST(count(*) AS DOUBLE)), 6) AS weight
FROM orders GROUP BY o_orderpriority
""")
def priority_class_weights(t):
    """P7."""
    return profile.class_weights(t("orders"), "o_orderpriority").withColumn("weight", r6("weight"))


@query("""
WITH w AS (SELECT len(list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10),
             repeat(' ', 34)), ' '), lambda x: x <> '')) AS n FROM documents)
SELECT max(n) AS max_len, min(n) AS min_len, round(avg(n), 6) AS mean_len FROM w
""")
def document_length_profile(t):
    """Longest, shortest and mean number of words."""
    df = t.spread("documents", "text").select(words("text").alias("words"))
    return profile.length_profile(df, "words").withColumn("mean_len", r6("mean_len"))


@query("""
SELECT round(CAST(min(list_min(embedding)) AS DOUBLE), 6) AS min_value,
       round(CAST(max(list_max(embedding)) AS DOUBLE), 6) AS max_value FROM embeddings
""")
def embedding_range(t):
    """P9."""
    out = profile.array_range(t("embeddings"), "embedding")
    return out.select(*[r6(F.col(c).cast("double")).alias(c) for c in out.columns])
