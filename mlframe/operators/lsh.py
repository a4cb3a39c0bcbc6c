"""Approximate nearest neighbours by p-stable projection hashing with several probes.

A table of the index hashes a row to the cells floor((a.x + b) / w) of a few random projections (normal, so distances
keep their distribution); rows that share all cells share a bucket. A query looks into its own bucket and into those
across the nearest cell walls. Numbers of tables, projections and probes and the width w are fitted on a bounded sample
of queries with their true neighbours, for the wanted recall at the least number of candidates; every row is indexed.
Rows of a bucket are compared block by block as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.balltree import finite, lists
from mlframe.operators.neighbours import BLOCK, _blocks, _compare, nearest

ASKED, SEEN = 256, 4096  # sampled queries with their true neighbours, and sampled rows that tell candidates
PROJECTIONS, WIDTHS, MOST_TABLES = (2, 4, 8, 12, 16), (1.0, 2.0, 4.0), 32
REPEATED = 1 << 14  # rows a task makes at a time, a row once for every bucket
MARGIN = 0.04  # recall aimed at beyond the wanted one, as the sample is small


@dataclass(frozen=True)
class Hashing:
    """`axes` (length x tables x projections), `shifts` (tables x projections), width of a cell, probes beside the own bucket."""

    axes: np.ndarray
    shifts: np.ndarray
    width: float
    probes: int
    expected_recall: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """Position on every projection, in cells: rows x tables x projections."""
        length, tables, many = self.axes.shape
        return (x @ self.axes.reshape(length, -1)).reshape(len(x), tables, many) / self.width + self.shifts

    def buckets(self, x: np.ndarray, probes: int = 0) -> np.ndarray:
        """Bucket keys: rows x tables x (1 + probes); the probes cross the nearest walls first."""
        at = self.places(x)
        cell = np.floor(at).astype(np.int64)
        keys = [_key(cell)]
        if probes:
            part = at - cell
            cost = np.concatenate([part, 1 - part], axis=2)
            order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            many = cell.shape[2]
            for p in range(order.shape[2]):
                axis, up = order[:, :, p] % many, order[:, :, p] >= many
                moved = cell.copy()
                np.put_along_axis(moved, axis[:, :, None], np.take_along_axis(cell, axis[:, :, None], 2) + np.where(up, 1, -1)[:, :, None], 2)
                keys.append(_key(moved))
        return np.stack(keys, axis=2)


def _key(cells: np.ndarray) -> np.ndarray:
    """64 bits of table and cells, scrambled; buckets that clash only add candidates."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, cells.shape[1] + 1, dtype=np.uint64), cells.shape[:2]).copy()
        for j in range(cells.shape[2]):
            key = (key ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def choose(asked: np.ndarray, true: np.ndarray, seen: np.ndarray, recall: float, seed: int = 0) -> Hashing:
    """The hashing with the fewest candidates among `seen` that finds the share `recall` of `true` (queries x k x length)."""
    length, best = asked.shape[1], None
    scale = float(np.median(np.sqrt(((true - asked[:, None, :]) ** 2).sum(axis=2)))) or 1.0
    for many in PROJECTIONS:
        for factor in WIDTHS:
            rng = np.random.default_rng([seed, many, int(factor * 8)])
            axes, shifts = rng.normal(size=(length, MOST_TABLES, many)), rng.uniform(size=(MOST_TABLES, many))
            full = Hashing(axes, shifts, factor * scale, 0, 0.0)
            for probes in (0, many, 2 * many):
                own = full.buckets(asked, probes)  # queries x tables x probes
                hit = (full.buckets(true.reshape(-1, length))[:, :, 0].reshape(*true.shape[:2], MOST_TABLES)[:, :, :, None] == own[:, None]).any(axis=3)
                reached = np.logical_or.accumulate(hit, axis=2).mean(axis=(0, 1))
                enough = np.flatnonzero(reached >= min(1.0, recall + MARGIN))
                if not len(enough):
                    continue
                tables = int(enough[0]) + 1
                other, met = full.buckets(seen)[:, :tables, 0], 0.0
                for i in range(len(asked)):
                    met += (other[:, :, None] == own[i, :tables][None]).any(axis=2).sum(axis=1).mean()
                cost = met / len(asked) + 1e-4 * tables * (1 + probes)  # candidates a row, repeats counted, and looking up
                if best is None or cost < best[0]:
                    best = cost, Hashing(axes[:, :tables], shifts[:tables], factor * scale, probes, float(reached[enough[0]]))
    # nothing reaches it: one bucket for all rows
    return best[1] if best else Hashing(np.zeros((length, 1, 1)), np.full((1, 1), 0.5), 1.0, 0, 1.0)


def _hash_order(df: DataFrame, key: str, n: int, total: int, seed: int) -> DataFrame:
    """About n rows, drawn by a hash of the key."""
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(min(1.0, 1.5 * n / max(1, total)) * (1 << 30))
    return df.filter(share).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def fit(train: DataFrame, query: DataFrame, key: str, vec: str, k: int, recall: float = 0.9, exclude_self: bool = False, seed: int = 0) -> Hashing | None:
    """Hashing for the k nearest rows at the wanted recall, from at most ASKED queries and SEEN rows."""
    usable = [df.select(key, F.col(vec).cast("array<double>").alias(vec)).filter(finite(vec)) for df in (train, query)]
    sizes = [df.count() for df in usable]
    asked = _hash_order(usable[1], key, ASKED, sizes[1], seed)
    near = nearest(usable[0].withColumn("_near", F.col(vec)), asked, key, vec, k, exclude_self=exclude_self, carry=["_near"])
    true = near.filter("neighbour is not null").groupBy(key).agg(F.collect_list("_near").alias("near"))
    rows = asked.join(true, key).select(vec, "near").collect()
    full = max((len(r["near"]) for r in rows), default=0)
    rows = [r for r in rows if len(r["near"]) == full]
    if not rows:
        return None
    seen = [r[vec] for r in _hash_order(usable[0], key, SEEN, sizes[0], seed + 1).select(vec).collect()]
    return choose(np.array([r[vec] for r in rows]), np.array([r["near"] for r in rows]), np.array(seen), recall, seed)


def _bucketed(rows: DataFrame, hashing: Hashing, probes: int) -> DataFrame:
    """Rows once per bucket, `cell` naming it."""
    step = max(1, REPEATED // (hashing.axes.shape[1] * (1 + probes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                keys = hashing.buckets(lists(batch.column("v")), probes).reshape(batch.num_rows, -1)
                repeated = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(str).tolist(), pa.string()), *repeated.columns], ["cell", *batch.schema.names])

    return rows.mapInArrow(run, T.StructType([T.StructField("cell", T.StringType()), *rows.schema.fields]))


def approximate_nearest(train: DataFrame, query: DataFrame, key: str, vec: str, k: int, hashing: Hashing | None = None, recall: float = 0.9,
                        exclude_self: bool = False, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, rank, neighbour, distance, carried columns) as `nearest` gives it, with about the wanted share of the true neighbours.

    Distances are exact. Of equal vectors the k + 1 smallest keys are indexed, as no query can want more of them. A query
    row that meets nobody, or whose vector is null or not finite, stays with rank 1 and a null neighbour.
    """
    hashing = hashing or fit(train, query, key, vec, k, recall, exclude_self)
    taken = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.struct(F.lit(0).alias("none"))

    def side(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), *more).filter(finite("v"))

    rows, asked = side(train, taken.alias("carry")), side(query)
    schema = T.StructType([T.StructField("id", query.schema[key].dataType), T.StructField("neighbour", train.schema[key].dataType),
                           T.StructField("distance", T.DoubleType()), T.StructField("carry", rows.schema["carry"].dataType)])
    if hashing is None:
        found = train.sparkSession.createDataFrame([], schema)
    else:
        copies = Window.partitionBy("v").orderBy("id")
        rows = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
        t = _blocks(_bucketed(rows, hashing, 0), block, "carry").select("cell", F.col("ids").alias("t_ids"), F.col("cells").alias("t_cells"), F.col("carry").alias("t_carry"))
        q = _blocks(_bucketed(asked, hashing, hashing.probes).withColumn("reach", F.lit(float("inf"))), block, "reach")
        q = q.select("cell", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("reach").alias("q_reach"))
        zero = F.array_repeat(F.lit(0.0), hashing.axes.shape[0])
        met = q.join(t, "cell").withColumns({"centre": zero, "radius": F.lit(float("inf"))}).drop("cell")
        found = met.mapInArrow(_compare(k, exclude_self), schema).groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.any_value("carry").alias("carry"))
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = query.select(F.col(key).alias("_asked")).join(best, F.col("_asked") == F.col("id"), "left")
    return out.select(F.col("_asked").alias(key), F.coalesce("rank", F.lit(1)).alias("rank"), "neighbour", "distance",
                      *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)])


def measured_recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(asked, pairs, recall): query rows, true neighbours and the share of these that were found."""
    true = exact.filter("neighbour is not null").select(key, "neighbour")
    hit = true.join(found.select(key, "neighbour").withColumn("_hit", F.lit(1)), [key, "neighbour"], "left")
    return hit.agg(F.count_distinct(key).alias("asked"), F.count(F.lit(1)).alias("pairs"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


__all__ = ["Hashing", "approximate_nearest", "choose", "fit", "measured_recall"]
