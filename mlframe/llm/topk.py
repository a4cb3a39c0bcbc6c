"""Exact top-k inner products with one KD-tree per shard.

Rows are dealt to shards by hash. A shard sorts its vectors into a KD-tree by median splits of the widest
side, each node with the tight box of its vectors. A query walks a tree best first: the node whose box
allows the highest score comes next, and the walk ends when no box left can reach the k-th best score.
The walk runs in two rounds: first in one shard per query, which gives a k-th score close to the final
one, then in all the others with that score carried along. Queries meet shards in blocks, so the work is
queries x shards and every task is bounded by a shard and a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlframe.session import materialize

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEAF = 64
SCALE = 1024
SAFE = float(1 << 53)
NONE = -(1 << 63)  # no k-th score known yet
LOW, HIGH = NONE + 1, (1 << 63) - 1  # scores beyond these are set to them


def fixed_point(vector: str | Column) -> Column:
    """floor(1024 x) of each component, x as double; null unless the vector is whole and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)))


def held(scores: np.ndarray) -> np.ndarray:
    """Python integers kept within the 64-bit range; doubles are exact and far inside it."""
    return np.minimum(np.maximum(scores, LOW), HIGH) if scores.dtype == object else scores


class KDTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.order = np.arange(len(ids))
        self.child: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        low, high = [], []

        def grow(lo: int, hi: int) -> int:
            part = rows[self.order[lo:hi]]
            node = len(self.span)
            self.span.append((lo, hi))
            self.child.append(None)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            if hi - lo > LEAF and (low[node] < high[node]).any():
                axis = int(np.argmax(high[node] - low[node]))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], mid)]
                self.child[node] = (grow(lo, lo + mid), grow(lo + mid, hi))
            return node

        grow(0, len(ids))
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[self.order], rows[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """queries x nodes: the highest score that a point of the node's box can have."""
        return held(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor_score: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but `own` that reach `floor_score`; ties go to smaller ids."""
        best: list[tuple] = []  # smallest first, as (score, -id)
        todo = [(-bound[0], 0)]
        while todo:
            reach, node = heapq.heappop(todo)
            if (best[0][0] if len(best) == k else floor_score) > -reach:
                break
            if self.child[node] is not None:
                for c in self.child[node]:
                    heapq.heappush(todo, (-bound[c], c))
                continue
            lo, hi = self.span[node]
            score = held(self.rows[lo:hi] @ query)
            least = best[0][0] if len(best) == k else floor_score
            for j in np.flatnonzero(score >= least):
                if (i := int(self.ids[lo + j])) != own:
                    item = (int(score[j]), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


def exact(matrix: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every product sum is then exact, else as Python integers."""
    top = float(np.abs(matrix).max(initial=0)) * float(np.abs(other).max(initial=0)) * matrix.shape[1]
    kind = np.float64 if top < SAFE else object
    return matrix.astype(kind), other.astype(kind)


def _stacked(df: DataFrame, group: str, *more: str) -> DataFrame:
    """One row per (dim, group): the members' ids and vectors, side by side."""
    members = F.sort_array(F.collect_list(F.struct("id", *more, "v")))
    got = df.groupBy("dim", group).agg(members.alias("m"))
    return got.select("dim", group, F.col("m.id").alias("ids"), *[F.col(f"m.{c}").alias(c) for c in more], F.flatten("m.v").alias("cells"))


def _walk(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, rows = None, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                queries = np.asarray(r.qcells, np.int64).reshape(len(r.qids), r.dim)
                if shard != (r.dim, r.shard):
                    shard, rows, tree = (r.dim, r.shard), np.asarray(r.cells, np.int64).reshape(len(r.ids), r.dim), None
                data, queries = exact(rows, queries)
                if tree is None or tree.rows.dtype != data.dtype:
                    tree = KDTree(np.asarray(r.ids, np.int64), data)
                bound, out = tree.bounds(queries), []
                for q, query, b, least in zip(r.qids, queries, bound, r.least):
                    out += [(q, i, s) for s, i in tree.search(query, b, int(q), k, int(least))]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows, ranked; a task keeps its own k best before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products.

    Components become floor(1024 x). Rows without a key and vectors that are null, empty or hold a null or
    non-finite component take no part; vectors of different length do not meet. Every row is a candidate, also
    those that repeat a key, except for queries of its own key; queries that repeat a key are asked once, with the
    smallest vector. Fewer than k candidates give them all, an empty table none. Scores that leave the 64-bit range are
    set to its ends, and are ties there.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias("id"), fixed_point(vector).alias("v")).filter("id is not null and v is not null")
        return df.withColumn("dim", F.size("v"))

    rows = materialize(cleaned(vectors), "kd-rows")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    # by the row's place in the stored table: rows of one key are dealt out as any others
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    shard = materialize(_stacked(rows, "shard"), "kd-shards")
    asked = cleaned(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumns({"home": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "least": F.lit(NONE)})
    asked = materialize(asked, "kd-queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def meet(q: DataFrame, targets: Column) -> DataFrame:
        """Query blocks at the shards they are sent to; both sides are keyed by shard and dealt out by block."""
        q = q.withColumns({"at": F.explode(targets), "block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")})
        q = q.groupBy("dim", "at", "block").agg(F.sort_array(F.collect_list(F.struct("id", "least", "v"))).alias("m"))
        q = q.select(F.col("dim").alias("qdim"), "at", F.col("m.id").alias("qids"), F.col("m.least").alias("least"), F.flatten("m.v").alias("qcells"))
        met = q.join(shard, (q["qdim"] == shard["dim"]) & (q["at"] == shard["shard"]))
        met = met.select("dim", "shard", "ids", "cells", "qids", "least", "qcells")
        return met.mapInPandas(_walk(k), "query_id long, vec_id long, score long")

    first = materialize(_best(meet(asked, F.array("home")), k), "kd-home")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    carried = asked.join(kth, "id", "left").withColumn("least", F.coalesce("kth", F.lit(NONE)))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    rest = meet(carried, others)
    both = first.select("query_id", "vec_id", "score").unionByName(rest)
    return _best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
