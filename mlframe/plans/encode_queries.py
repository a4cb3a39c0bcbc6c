"""Encoding, scaling, feature construction and activations (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.functions import arrays
from mlframe.functions.activations import SELU_ALPHA, SELU_LAMBDA, activation
from mlframe.operators import encode, scale
from mlframe.plans.catalog import cells, query, r6

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _KEY.split(", ")
# every cell of every embedding, 0-based place
_CELLS = ("(SELECT vec_id, label, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS x FROM "
          "(SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))")


@query("""
SELECT event_id, value, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, isodow(ts) - 1 AS weekday,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events
""")
def calendar_features(t):
    """E1."""
    return encode.calendar_features(t("events", "event_id", "ts", "value"), "ts")


@query(f"""
SELECT {_KEY}, round(l_extendedprice / (l_quantity + 0.00001::DOUBLE), 6) AS unit_price,
       round(l_extendedprice * l_discount, 6) AS rebate FROM lineitem
""")
def ratio_features(t):
    """E2."""
    out = encode.ratio_features(t("lineitem"), {"unit_price": ("l_extendedprice", "l_quantity")},
                                {"rebate": ("l_extendedprice", "l_discount")})
    return out.select(*_KEYS, r6("unit_price").alias("unit_price"), r6("rebate").alias("rebate"))


@query("""
SELECT conv_id, turn, coalesce(role, 'none') || ' ' || lower(coalesce(text, 'none')) AS merged FROM conversations
""")
def merged_text(t):
    """E3."""
    out = encode.merge_text(t("conversations"), ["role", "text"], " ", lower=["text"], missing="none", out="merged")
    return out.select("conv_id", "turn", "merged")


@query("""
SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer
""")
def label_encoded(t):
    """E4."""
    return encode.label_encode(t("customer", "c_custkey", "c_mktsegment"), "c_mktsegment", out="code")


@query("""
WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS idx
           FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey < 10))
SELECT c.c_custkey, k.idx AS code FROM customer c LEFT JOIN k USING (c_mktsegment) WHERE c.c_nationkey >= 10
""")
def label_encoded_from_train(t):
    """Classes of the training part encode the other part."""
    df = t("customer", "c_custkey", "c_mktsegment", "c_nationkey")
    out = encode.label_encode(df.filter("c_nationkey >= 10"), "c_mktsegment", fit_on=df.filter("c_nationkey < 10"), out="code")
    return out.select("c_custkey", "code")


@query("""
SELECT nkey, side, dense_rank() OVER (ORDER BY nkey) - 1 AS code FROM (
  SELECT c_nationkey AS nkey, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)
""")
def label_encoded_union(t):
    """E5: classes of the union of two tables."""
    a = t("customer").select(F.col("c_nationkey").alias("nkey"), F.lit("customer").alias("side"))
    b = t("supplier").select(F.col("s_nationkey").alias("nkey"), F.lit("supplier").alias("side"))
    return encode.vstack(*encode.label_encode_union(a, b, "nkey", out="code"))


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def label_decoded(t):
    """Indices back to class names."""
    df = t("customer", "c_custkey", "c_mktsegment")
    classes = encode.fit_labels(df, "c_mktsegment")
    coded = encode.label_encode(df, "c_mktsegment", classes, out="code")
    return encode.label_decode(coded, "code", classes, "segment").select("c_custkey", "segment")


@query("""
SELECT vec_id, CAST(round(embedding[1], 6) AS DOUBLE) AS class_0, CAST(round(embedding[2], 6) AS DOUBLE) AS class_1,
       CAST(round(embedding[3], 6) AS DOUBLE) AS class_2
FROM (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS embedding FROM embeddings)
""")
def scores_by_class_name(t):
    """One output column per class name."""
    out = encode.name_scores(t("embeddings"), "embedding", ["class_0", "class_1", "class_2"], ["vec_id"])
    return out.select("vec_id", *[r6(F.col(c).cast("double")).alias(c) for c in out.columns[1:]])


@query("""
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
       dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders
""")
def ordinal_encoded(t):
    """E7."""
    return encode.ordinal_encode(t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority"),
                                 ["o_orderstatus", "o_orderpriority"])


@query(f"""
SELECT {_KEY}, CAST(l_returnflag = 'A' AS INTEGER) AS "flag_A", CAST(l_returnflag = 'N' AS INTEGER) AS "flag_N",
       CAST(l_returnflag = 'R' AS INTEGER) AS "flag_R" FROM lineitem
""")
def one_hot_columns(t):
    """E8."""
    return encode.one_hot(t("lineitem", *_KEYS, "l_returnflag"), "l_returnflag", "flag")


@query("""
WITH v AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS p, dense_rank() OVER (ORDER BY o_custkey) AS c FROM orders),
n AS (SELECT max(p) AS ps, max(c) AS cs FROM v)
SELECT o_orderkey, p - 1 AS first_one, ps + c - 1 AS second_one, ps + cs AS width FROM v, n
""")
def wide_one_hot(t):
    """Positions of the ones for columns with any number of categories."""
    df = t("orders", "o_orderkey", "o_orderpriority", "o_custkey")
    hot, fitted = encode.one_hot_sparse(df, ["o_orderpriority", "o_custkey"])
    width = sum(n for n, _, _ in fitted.sizes.values())
    return hot.select("o_orderkey", F.get("hot", F.lit(0)).cast("long").alias("first_one"), F.get("hot", F.lit(1)).cast("long").alias("second_one"),
                      F.lit(width).cast("long").alias("width"))


@query("""
SELECT o_orderkey, """ + ", ".join(
    [f"""CAST(o_orderstatus = '{v}' AS INTEGER) AS "o_orderstatus_{v}" """ for v in "FOP"] +
    [f"""CAST(o_orderpriority = '{v}' AS INTEGER) AS "o_orderpriority_{v}" """
     for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]) + " FROM orders")
def one_hot_all_strings(t):
    """E9."""
    return encode.one_hot_auto(t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("""
SELECT vec_id, pos, CAST(label = pos AS INTEGER) AS cell FROM (SELECT vec_id, label, unnest(range(10)) AS pos FROM embeddings)
""")
def one_hot_label_vector(t):
    """E10."""
    return cells(t("embeddings").withColumn("v", arrays.one_hot_vector("label", 10)), "v", "vec_id")


@query(f"""
SELECT vec_id, CAST(min(pos) AS INTEGER) AS best FROM (
  SELECT vec_id, pos, x, max(x) OVER (PARTITION BY vec_id) AS top FROM {_CELLS}) WHERE x = top GROUP BY vec_id
""")
def argmax_of_scores(t):
    """E11."""
    return t("embeddings").select("vec_id", arrays.argmax("embedding").alias("best"))


_SCALED = ["l_quantity", "l_extendedprice"]


def _scaled(t, how):
    out = scale.scale(t("lineitem"), _SCALED, how)
    return out.select(*_KEYS, *[r6(c).alias(c) for c in _SCALED])


def _scaled_sql(expr):
    body = ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in _SCALED)
    return f"SELECT {_KEY}, {body} FROM lineitem"


@query(_scaled_sql("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)"))
def minmax_scaled(t):
    """E12."""
    return _scaled(t, "minmax")


@query(f"""
WITH f AS (SELECT min(l_tax) AS lo, max(l_tax) - min(l_tax) AS span FROM lineitem WHERE l_linestatus = 'F')
SELECT {_KEY}, round((l_tax - lo) / span, 6) AS l_tax FROM lineitem, f WHERE l_linestatus = 'O'
""")
def minmax_scaled_from_train(t):
    """Fitted on one part, applied to the other."""
    df = t("lineitem")
    out = scale.minmax_scale(df.filter("l_linestatus = 'O'"), ["l_tax"], fit_on=df.filter("l_linestatus = 'F'"))
    return out.select(*_KEYS, r6("l_tax").alias("l_tax"))


@query(_scaled_sql("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def standard_scaled(t):
    """E13."""
    return _scaled(t, "standard")


@query(_scaled_sql("{c} / (SELECT max(abs({c})) FROM lineitem)"))
def maxabs_scaled(t):
    """E14."""
    return _scaled(t, "maxabs")


@query(_scaled_sql("({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / "
                   "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def robust_scaled(t):
    """E15."""
    return _scaled(t, "robust")


@query(f"SELECT {_KEY}, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCALED) + " FROM lineitem")
def scaling_undone(t):
    """Scaling and its inverse give the values back."""
    df = t("lineitem")
    params = scale.fit_standard(df, _SCALED)
    back = scale.inverse_scale(scale.apply_scale(df, params), params)
    return back.select(*_KEYS, *[r6(c).alias(c) for c in _SCALED])


@query(f"""
WITH c AS (SELECT * FROM {_CELLS}), f AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM c)
SELECT vec_id, pos, round((x - m) / s, 6) AS cell FROM c, f
""")
def matrix_standardized(t):
    """One mean and deviation over all cells."""
    return cells(scale.global_standardize(t("embeddings"), "embedding"), "embedding", "vec_id").withColumn("cell", r6("cell"))


@query(f"SELECT vec_id, pos, round((x - 0.5::DOUBLE) / 0.5::DOUBLE, 6) AS cell FROM {_CELLS}")
def affine_scaled(t):
    """E18."""
    df = t("embeddings").withColumn("v", arrays.affine("embedding", 0.5, 0.5))
    return cells(df, "v", "vec_id").withColumn("cell", r6("cell"))


@query(f"""
SELECT {_KEY}, round(l_quantity, 6) AS a, round(l_tax, 6) AS b, round(l_quantity * l_quantity, 6) AS aa,
       round(l_quantity * l_tax, 6) AS ab, round(l_tax * l_tax, 6) AS bb FROM lineitem
""")
def polynomial_degree_2(t):
    """E19."""
    df = t("lineitem").withColumnsRenamed({"l_quantity": "a", "l_tax": "b"})
    out = encode.polynomial(df, ["a", "b"], 2, keep=_KEYS)
    return out.select(*_KEYS, *[r6(out[c]).alias(c.replace("*", "")) for c in out.columns if c not in _KEYS])


@query(f"""
SELECT {_KEY}, 1.0::DOUBLE AS bias, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(a * b, 6) AS ab, round(a * c, 6) AS ac,
       round(b * c, 6) AS bc, round(a * b * c, 6) AS abc
FROM (SELECT *, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem)
""")
def polynomial_interactions(t):
    """Degree 3, products of different columns only, with bias."""
    df = t("lineitem").withColumnsRenamed({"l_quantity": "a", "l_discount": "b", "l_tax": "c"})
    out = encode.polynomial(df, ["a", "b", "c"], 3, bias=True, interaction_only=True, keep=_KEYS)
    return out.select(*_KEYS, *[r6(out[c]).alias(c.replace("*", "")) for c in out.columns if c not in _KEYS])


@query(f"""
WITH u AS (SELECT *, (CAST('0x' || substr(md5('7:' || vec_id || ':' || pos || ':0'), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u0,
                     (CAST('0x' || substr(md5('7:' || vec_id || ':' || pos || ':1'), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u1
           FROM {_CELLS})
SELECT vec_id, pos, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
       x + 0.1::DOUBLE * sqrt(-2.0::DOUBLE * ln(u0)) * cos(6.283185307179586::DOUBLE * u1))), 6) AS cell FROM u
""")
def noisy_cells(t):
    """Gaussian noise on every cell, clipped to 0..1."""
    out = scale.add_noise(t("embeddings"), "embedding", 0.1, 7, "vec_id")
    return cells(out, "embedding", "vec_id").withColumn("cell", r6("cell"))


@query(f"SELECT vec_id, pos // 8 AS row, pos % 8 AS col, round(x, 6) AS cell FROM {_CELLS}")
def reshaped_grid(t):
    """64 cells as an 8 x 8 grid."""
    df = t("embeddings").select("vec_id", F.posexplode(arrays.reshape("embedding", 8, 8)).alias("row", "line"))
    return df.select("vec_id", "row", F.posexplode("line").alias("col", "cell")).withColumn("cell", r6(F.col("cell").cast("double")))


@query(f"SELECT vec_id, pos, round(x, 6) AS cell FROM {_CELLS}")
def flattened_grid(t):
    """And back."""
    df = t("embeddings").withColumn("v", arrays.flatten(arrays.reshape("embedding", 8, 8)))
    return cells(df, "v", "vec_id").withColumn("cell", r6(F.col("cell").cast("double")))


@query(f"""
SELECT a.vec_id, a.pos, round(a.x, 6) AS first, round(b.x, 6) AS second
FROM {_CELLS} a JOIN {_CELLS} b ON a.vec_id = b.vec_id AND b.pos = a.pos + 32 WHERE a.pos < 32
""")
def columns_to_rows(t):
    """Two feature vectors turned into rows of two features."""
    df = t("embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))
    out = encode.columns_to_rows(df, ["first", "second"], ["vec_id"])
    return out.select("vec_id", "pos", *[r6(F.col(c).cast("double")).alias(c) for c in ("first", "second")])


@query(f"""
SELECT vec_id, pos, round(x, 6) AS cell FROM {_CELLS} UNION ALL SELECT vec_id, 64, CAST(label AS DOUBLE) FROM embeddings
""")
def blocks_side_by_side(t):
    """The label appended to the feature block."""
    joined = arrays.hstack([F.col("embedding").cast("array<double>"), F.array(F.col("label").cast("double"))])
    return cells(t("embeddings").withColumn("v", joined), "v", "vec_id").withColumn("cell", r6("cell"))


@query("""
SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier
""")
def stacked_rows(t):
    """E24."""
    return encode.vstack(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
                         t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query(f"""
WITH v AS (SELECT event_id, value / 100.0::DOUBLE - 1.0::DOUBLE AS x FROM events)
SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(greatest(x, 0), 6) AS relu,
       round(x / (1 + exp(-x)), 6) AS silu, round(x * tanh(ln(1 + exp(x))), 6) AS mish,
       round(CASE WHEN x > 0 THEN x ELSE 1.5::DOUBLE * (exp(x) - 1) END, 6) AS elu,
       round({SELU_LAMBDA}::DOUBLE * CASE WHEN x > 0 THEN x ELSE {SELU_ALPHA}::DOUBLE * (exp(x) - 1) END, 6) AS selu,
       round(CASE WHEN x > 0 THEN x ELSE 0.01::DOUBLE * x END, 6) AS leaky_relu FROM v
""")
def activations(t):
    """E25."""
    df = t("events").select("event_id", (F.col("value") / 100.0 - 1.0).alias("x"))
    params = {"elu": {"alpha": 1.5}}
    names = ["sigmoid", "tanh", "relu", "silu", "mish", "elu", "selu", "leaky_relu"]
    return df.select("event_id", *[r6(activation("x", n, **params.get(n, {}))).alias(n) for n in names])


@query("""
SELECT event_id, round(exp(value - m) / sum(exp(value - m)) OVER (PARTITION BY user_id), 6) AS softmax
FROM (SELECT event_id, user_id, value / 100.0::DOUBLE AS value, max(value / 100.0::DOUBLE) OVER (PARTITION BY user_id) AS m FROM events)
""")
def softmax_per_user(t):
    """E26."""
    df = t("events").select("event_id", "user_id", (F.col("value") / 100.0).alias("value"))
    return encode.softmax(df, "value", "user_id").select("event_id", r6("softmax").alias("softmax"))


@query(f"SELECT vec_id, (pos // 8) * 8 + 7 - pos % 8 AS pos, round(x, 6) AS cell FROM {_CELLS}")
def flipped_left_right(t):
    """E27."""
    return _grid(t, arrays.flip_grid("embedding", 8, 8, "horizontal"))


@query(f"SELECT vec_id, (7 - pos // 8) * 8 + pos % 8 AS pos, round(x, 6) AS cell FROM {_CELLS}")
def flipped_top_bottom(t):
    """E27."""
    return _grid(t, arrays.flip_grid("embedding", 8, 8, "vertical"))


@query(f"""
SELECT c.vec_id, g.pos, round(c.x, 6) AS cell FROM {_CELLS} c JOIN (
  SELECT pos, greatest(0, least(7, pos // 8 + 1)) * 8 + greatest(0, least(7, pos % 8 - 2)) AS src FROM (SELECT unnest(range(64)) AS pos)
) g ON c.pos = g.src
""")
def shifted_grid(t):
    """Two cells right and one up, edges repeated."""
    return _grid(t, arrays.shift_grid("embedding", 8, 8, 2, -1))


def _grid(t, expr):
    df = t("embeddings").withColumn("v", expr)
    return cells(df, "v", "vec_id").withColumn("cell", r6(F.col("cell").cast("double")))
