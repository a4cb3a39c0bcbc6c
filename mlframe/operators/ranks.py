"""Exact rank selection: the keys that stand at given places of the value order, found by splitters and counts.

A sample of the keys gives two splitters around each wanted place; one pass counts the rows below and between them.
What lies between is some hundredths of the rows, and the next sample is drawn there. A few such passes over the key
columns alone leave a stretch that is sorted and fetched. Nothing else of the table is read, moved or written: cutting
at a key is a filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.ordering import as_list

SAMPLE = 4096  # keys sampled per open stretch and pass
LEAF = 8192  # keys of a stretch that are fetched
_BITS = 30


def _plain(col: Column, kind: T.DataType) -> Column:
    """A key whose literal is exact: times as integers, everything else as it is."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    return col


@dataclass(frozen=True)
class Order:
    """The value order of a table by some of its columns, nulls first, as Spark sorts."""

    columns: list[str]
    kinds: list[T.DataType]

    @staticmethod
    def of(df: DataFrame, order_by) -> Order:
        names = [str(c) for c in as_list(order_by)]
        return Order(names, [df.schema[c].dataType for c in names])

    def key(self) -> Column:
        return F.struct(*[_plain(F.col(c), k).alias(f"k{i}") for i, (c, k) in enumerate(zip(self.columns, self.kinds))])

    def literal(self, key: Row, shape: T.StructType) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, shape.fields)])

    def upto(self, df: DataFrame, key: Row | None) -> Column:
        """Rows that stand at `key` or before it; none for None. The first column is compared apart as well, for the scan."""
        if key is None:
            return F.lit(False)
        shape = df.select(self.key().alias("k")).schema["k"].dataType
        whole = self.key() <= self.literal(key, shape)
        kind, name, first = self.kinds[0], self.columns[0], key[0]
        if first is None or isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) or first != first:
            return whole
        return whole & (F.col(name).isNull() | (F.col(name) <= F.lit(first).cast(kind)))


@dataclass
class _Stretch:
    """Keys after `low` up to `high` (None: no bound), `before` rows up to low, `inside` rows in it."""

    low: Row | None
    high: Row | None
    before: int
    inside: int


def rank_keys(df: DataFrame, order_by, ranks: Callable[[int], Sequence[int]] | Sequence[int], total: int | None = None) -> tuple[Order, int, dict[int, Row]]:
    """(order, rows, {rank: key}): the keys at the given 1-based ranks, or those that `ranks(rows)` names.

    Ranks below 1 or beyond the rows are left out. Keys must be unique; of equal keys the one key stands for all.
    Passes and what the driver holds depend on the number of ranks only (SAMPLE or LEAF keys a rank).
    """
    order = Order.of(df, order_by)
    keys = df.select(order.key().alias("k"))
    shape = keys.schema["k"].dataType
    n = keys.count() if total is None else total
    wanted = sorted({int(r) for r in (ranks(n) if callable(ranks) else ranks) if 1 <= r <= n})
    at = {r: _Stretch(None, None, 0, n) for r in wanted}
    found: dict[int, Row] = {}

    def within(s: _Stretch) -> Column:
        cond = F.lit(True)
        if s.low is not None:
            cond = cond & (F.col("k") > order.literal(s.low, shape))
        if s.high is not None:
            cond = cond & (F.col("k") <= order.literal(s.high, shape))
        return cond

    def sampled(stretches: list[_Stretch], seed: int) -> list[list[Row]]:
        """Sorted sample of every stretch (all its keys if these are few), in one pass."""
        tags = []
        for i, s in enumerate(stretches):
            share = 1.0 if s.inside <= LEAF else SAMPLE / s.inside
            take = within(s)
            if share < 1:
                take = take & (F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << _BITS)) < int(share * (1 << _BITS)))
            tags.append(F.when(take, F.lit(i)))
        out: list[list[Row]] = [[] for _ in stretches]
        for r in keys.withColumn("tag", F.explode(F.array_compact(F.array(*tags)))).orderBy("tag", "k").collect():
            out[r["tag"]].append(r["k"])
        return out

    seed = 0
    while at:
        distinct = {id(s): s for s in at.values()}
        stretches = list(distinct.values())
        lists = dict(zip(distinct, sampled(stretches, seed)))
        seed += 1
        brackets: dict[int, tuple[Row | None, Row | None]] = {}
        for r, s in list(at.items()):
            keys_here, place = lists[id(s)], r - s.before
            if s.inside <= LEAF:
                found[r] = keys_here[place - 1]
                del at[r]
                continue
            m = len(keys_here)
            middle, slack = place / s.inside * m, 4 * math.sqrt(max(m, 1)) / 2 + 1
            lo, hi = math.floor(middle - slack), math.ceil(middle + slack)
            brackets[r] = (keys_here[lo] if lo >= 0 and m else s.low, keys_here[hi] if hi < m else s.high)
        if not at:
            break
        # one pass counts what lies up to either splitter
        exprs = []
        for r, (lo, hi) in brackets.items():
            for name, key in (("lo", lo), ("hi", hi)):
                hit = F.lit(name == "hi") if key is None else F.col("k") <= order.literal(key, shape)
                exprs.append(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(f"{name}{r}"))
        counts = keys.agg(*exprs).first()
        same: dict[tuple, _Stretch] = {}
        for r, (lo, hi) in brackets.items():
            s, low, high = at[r], counts[f"lo{r}"], counts[f"hi{r}"]
            if r <= low:  # the sample missed: what is below the splitter stays
                lo, hi, low, high = s.low, lo, s.before, low
            elif r > high:
                lo, hi, low, high = hi, s.high, high, s.before + s.inside
            if hi is not None and (hi == lo or (high - low == s.inside and lists[id(s)] and lists[id(s)][0] == lists[id(s)][-1])):
                found[r] = hi  # only equal keys are left
                del at[r]
                continue
            at[r] = same.setdefault((lo, hi), _Stretch(lo, hi, low, high - low))
    return order, n, found


def cut_after(df: DataFrame, order_by, rank: int | Callable[[int], int], total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows at places 1 to `rank` of the value order, the rows behind); `rank` may depend on the number of rows."""
    order, n, found = rank_keys(df, order_by, (lambda n: [rank(n)]) if callable(rank) else [rank], total)
    place = rank(n) if callable(rank) else rank
    if place >= n:
        return df, df.filter(F.lit(False))
    head = order.upto(df, found.get(place))
    return df.filter(head), df.filter(~head)
