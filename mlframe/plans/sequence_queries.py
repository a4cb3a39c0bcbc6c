"""Sliding windows and shifted targets (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.operators import sequence
from mlframe.plans.catalog import cells, query

_ORDER = ["ts", "event_id"]
_SEEN = ["event_id", "ts", "user_id", "value"]
_SERIES = "s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"
_WHOLE = "s AS (SELECT event_id, 0 AS user_id, value, row_number() OVER (ORDER BY ts, event_id) AS step FROM events)"
_PARTS = "s AS (SELECT p_partkey AS event_id, 0 AS user_id, p_retailprice AS value, row_number() OVER (ORDER BY p_partkey) AS step FROM part)"


def _windows(series: str, t: int, stride: int, need: int | None = None, last: int | None = None) -> str:
    """Long-form windows w(event_id, step, pos, cell) over a series CTE."""
    need = need or t
    return (f"WITH {series}, w AS (SELECT a.user_id, a.event_id, a.step, b.step - a.step AS pos, b.value AS cell FROM s a "
            f"JOIN s b ON a.user_id = b.user_id AND b.step BETWEEN a.step AND a.step + {t - 1} "
            f"JOIN s l ON l.user_id = a.user_id AND l.step = a.step + {need - 1} WHERE (a.step - 1) % {stride} = 0)")


@query(_windows(_SERIES, 5, 2) + " SELECT event_id, step, pos, cell FROM w")
def windows_per_user(t):
    """Windows of 5 rows every 2 rows, per user."""
    out = sequence.sliding_windows(t("events", *_SEEN), ["value"], _ORDER, 5, 2, "user_id")
    return cells(out, "value_window", "event_id", "step")


@query(_windows(_WHOLE, 12, 6) + " SELECT event_id, step, pos, cell FROM w")
def windows_over_table(t):
    """The whole table as one series, cut into small chunks."""
    out = sequence.sliding_windows(t("events", *_SEEN), ["value"], _ORDER, 12, 6, chunk_rows=1000)
    return cells(out, "value_window", "event_id", "step")


@query(_windows(_PARTS, 5, 1) + " SELECT event_id AS p_partkey, max(cell) FILTER (pos = 4) AS y, round(sum(cell) FILTER (pos < 4), 6) AS x_sum FROM w GROUP BY ALL")
def window_inputs_and_target(t):
    """The last step of a window is its target."""
    out = sequence.sliding_windows(t("part", "p_partkey", "p_retailprice"), ["p_retailprice"], "p_partkey", 5)
    out = sequence.window_xy(out, "p_retailprice_window")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return out.select("p_partkey", "y", F.round(total, 6).alias("x_sum"))


@query(_windows(_WHOLE, 10, 1) + """
, n AS (SELECT max(step) - 3 AS lim FROM w)
SELECT event_id, round(sum(cell) FILTER (pos < 3), 6) AS x_sum, round(sum(cell) FILTER (pos >= 7), 6) AS y_sum
FROM w, n WHERE step <= lim GROUP BY event_id
""")
def sequence_to_sequence(t):
    """First 3 steps to last 3 steps, the last 3 windows held out."""
    out = sequence.sliding_windows(t("events", *_SEEN), ["value"], _ORDER, 10)
    out = sequence.window_seq2seq(out, "value_window", "value_window", 3)
    train, _ = sequence.hold_out_tail(out, "step", 3)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)
    return train.select("event_id", total("x").alias("x_sum"), total("y").alias("y_sum"))


@query(_windows(_WHOLE, 10, 1) + " SELECT event_id, step, pos, cell FROM w WHERE step = (SELECT max(step) FROM w) AND pos < 3")
def forecast_window(t):
    """The very last window feeds the forecast."""
    out = sequence.sliding_windows(t("events", *_SEEN), ["value"], _ORDER, 10)
    out = sequence.window_seq2seq(out, "value_window", "value_window", 3)
    _, last = sequence.hold_out_tail(out, "step", 3)
    return cells(last, "x", "event_id", "step")


@query(_windows(_SERIES, 6, 1, 7) + """
SELECT w.event_id, round(sum(w.cell), 6) AS x_sum, s.value AS target
FROM w JOIN s ON s.user_id = w.user_id AND s.step = w.step + 6 GROUP BY w.event_id, s.value
""")
def window_then_next(t):
    """The target is the row after the window."""
    out = sequence.window_next(t("events", *_SEEN), ["value"], "value", _ORDER, 6, "user_id")
    total = F.aggregate("value_window", F.lit(0.0), lambda s, v: s + v)
    return out.select("event_id", F.round(total, 6).alias("x_sum"), "target")


@query(_windows(_WHOLE, 36, 4, 72) + """
SELECT w.event_id, round(sum(w.cell), 6) AS x_sum, s.value AS target
FROM w JOIN s ON s.step = w.step + 71 GROUP BY w.event_id, s.value
""")
def window_with_horizon(t):
    """Windows of 36 rows, the target 36 rows later, every 4 rows."""
    out = sequence.window_horizon(t("events", *_SEEN), ["value"], "value", _ORDER, 36, 36, 4, chunk_rows=2000)
    total = F.aggregate("value_window", F.lit(0.0), lambda s, v: s + v)
    return out.select("event_id", F.round(total, 6).alias("x_sum"), "target")


@query(f"WITH {_WHOLE} SELECT a.event_id, a.value, b.value AS target FROM s a JOIN s b ON b.step = a.step + 144")
def value_ahead(t):
    """The value 144 rows ahead."""
    out = sequence.lead_target(t("events", "event_id", "ts", "value"), "value", 144, _ORDER, out="target")
    return out.select("event_id", "value", "target")


@query("""
WITH a AS (SELECT value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events),
     p AS (SELECT value * 0.9::DOUBLE + 1 AS pred, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error')
SELECT count(*) AS n, round(sqrt(avg(pow(value - pred, 2))), 6) AS rmse FROM a JOIN p USING (rn) WHERE rn <= 144
""")
def tail_score(t):
    """The last 144 rows of two tables matched by position."""
    df = t("events")
    pred = df.filter("event_type <> 'error'").withColumn("pred", F.col("value") * 0.9 + 1)
    out = sequence.score_tail(df, pred, 144, _ORDER, "value", "pred")
    return out.select("n", F.round("rmse", 6).alias("rmse"))
