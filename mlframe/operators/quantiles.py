"""Exact interpolated quantiles without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    small: int = 200_000) -> dict[str, list[float | None]]:
    """{column: [quantile, ...]}, linear interpolation between ranks, nulls ignored.

    The built-in exact aggregate keeps one entry per distinct value in one task, so it
    serves columns with at most about `small` of them. Other columns are narrowed: a
    sketch brackets each wanted rank, exact counts confirm the bracket, and only the
    distinct values of a bracket that has become small are brought back.
    """
    sizes = df.agg(*[F.count(c).alias(f"n_{c}") for c in cols],
                   *[F.approx_count_distinct(c, 0.05).alias(f"d_{c}") for c in cols]).first()
    counts = {c: sizes[f"n_{c}"] for c in cols}
    short = [c for c in cols if min(counts[c], 1.25 * sizes[f"d_{c}"]) <= small]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for i in range(0, len(short), 4):  # four columns per pass bound the aggregate's memory
        row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(c)
                       for c in short[i:i + 4]]).first().asDict()
        out.update({c: list(q) if q is not None else [None] * len(probs) for c, q in row.items()})
    long = [c for c in cols if c not in short]
    if long:
        ranks = {(c, f(p * (counts[c] - 1))) for c in long for p in probs for f in (math.floor, math.ceil)}
        found = _values_at(df.select(*[F.col(c).cast("double").alias(c) for c in long]), sorted(ranks), small)
        for c in long:
            out[c] = []
            for p in probs:
                at = p * (counts[c] - 1)
                lo, hi = found[(c, math.floor(at))], found[(c, math.ceil(at))]
                out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def _inside(c: str, lo: float | None, hi: float | None):
    cond = F.col(c).isNotNull()
    if lo is not None:
        cond = cond & (F.col(c) > lo)
    if hi is not None:
        cond = cond & (F.col(c) < hi)
    return cond


def _values_at(df: DataFrame, targets: list[tuple[str, int]], small: int,
               accuracy: int = 10_000) -> dict[tuple[str, int], float]:
    """The value at each (column, 0-based rank) of the sorted columns.

    A bracket is an open interval; a value that stands at its end is counted apart, so
    a value held by very many rows is either the answer or drops out.
    """
    sizes = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    out: dict[tuple[str, int], float] = {}
    open_ = {t: (None, None, 0, sizes[t[0]]) for t in targets}  # lo, hi, rows before, rows inside
    margin = 2 / accuracy
    while wide := [t for t in open_ if open_[t][3] > small]:
        shared: dict = {}  # targets of one bracket share a sketch
        for t in wide:
            shared.setdefault((t[0], *open_[t][:2]), []).append(t)
        picks, near = [], {}
        for i, ((c, lo, hi), ts) in enumerate(shared.items()):
            at = []
            for t in ts:
                q = (t[1] - open_[t][2]) / open_[t][3]
                near[t] = (f"q{i}", len(at))
                at += [F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))]
            picks.append(F.percentile_approx(F.when(_inside(c, lo, hi), F.col(c)), F.array(*at), accuracy).alias(f"q{i}"))
        sketch = df.agg(*picks).first()
        ends = {t: tuple(sketch[q][i:i + 2]) for t, (q, i) in near.items()}
        checks = []
        for i, t in enumerate(wide):
            (a, b), (lo, hi, _, _), v = ends[t], open_[t], F.col(t[0])
            checks += [F.count(F.when(_inside(t[0], lo, hi) & (v < a), 1)).alias(f"left{i}"),
                       F.count(F.when(v == a, 1)).alias(f"at_a{i}"),
                       F.count(F.when((v > a) & (v < b), 1)).alias(f"mid{i}"),
                       F.count(F.when(v == b, 1)).alias(f"at_b{i}")]
        seen = df.agg(*checks).first()
        for i, t in enumerate(wide):
            a, b = ends[t]
            lo, hi, before, inside = open_[t]
            edges = [(lo, a, seen[f"left{i}"], None), (None, None, seen[f"at_a{i}"], a)]
            if b > a:
                edges += [(a, b, seen[f"mid{i}"], None), (None, None, seen[f"at_b{i}"], b)]
            edges.append((b, hi, inside - sum(e[2] for e in edges), None))
            for low, high, n, value in edges:
                if t[1] < before + n:
                    if value is None:
                        open_[t] = (low, high, before, n)
                    else:
                        out[t] = value
                        del open_[t]
                    break
                before += n
    for c in df.columns:
        spans: dict = {}
        for t in (t for t in open_ if t[0] == c):
            lo, hi, before, _ = open_[t]
            if (lo, hi) not in spans:
                spans[(lo, hi)] = sorted(
                    (r[c], r["count"]) for r in df.filter(_inside(c, lo, hi)).groupBy(c).count().collect())
            rest = t[1] - before
            for value, n in spans[(lo, hi)]:
                if rest < n:
                    out[t] = value
                    break
                rest -= n
    return out
