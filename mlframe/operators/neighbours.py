"""Exact nearest neighbours by a ball tree and a distributed block join.

The training rows form a ball tree (see `balltree`), the query rows are sent down to the leaf they would lie in. The first
round compares each query with its own leaf and so finds a k-th distance close to the final one. The second round walks
the tree with blocks of queries: a cell is entered only if its ball reaches into the k-th distance of some query of the
block. Blocks and leaves are dealt to groups of some GROUP rows, and a task takes one group of each side: a block is sent once
for all the leaves of a group, queries too far from a leaf are passed over, the rest is a matrix product, and only the k best
per query and group leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mlframe.operators.balltree import BallTree, finite, grow, lists, root_of
from mlframe.session import materialize

BLOCK = 1024
GROUP = 1 << 14  # rows of a group of blocks: what a task holds of either side
PAIRS = 1 << 16  # pairs of rows measured at a time
LOOSE, TINY = 1 + 1e-9, 1e-12  # bounds are taken a little wider than computed
EPS = np.finfo(float).eps


def k_best(queries: np.ndarray, reach: np.ndarray, rows: np.ndarray, k: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) places of at least the k + spare closest rows of each query within its `reach`.

    Distances come from a matrix product first; what may belong to the best is measured again, plainly.
    """
    shift = rows.mean(axis=0)
    a, b = queries - shift, rows - shift
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    slack = 8 * (rows.shape[1] + 8) * EPS * (np.sqrt(aa) + np.sqrt(bb.max(initial=0.0))) ** 2
    need = min(k + spare, len(rows))
    kth = np.partition(rough, need - 1, axis=1)[:, need - 1]
    limit = np.minimum(kth, (reach * LOOSE + TINY) ** 2) + 2 * slack
    at, place = np.nonzero(rough <= limit[:, None])
    gaps = [np.sqrt(((queries[at[lo:lo + PAIRS]] - rows[place[lo:lo + PAIRS]]) ** 2).sum(axis=1)) for lo in range(0, len(at), PAIRS)]
    return at, place, np.concatenate(gaps) if gaps else np.zeros(0)


def _first_k(at: np.ndarray, place: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (gap, place) of each query, by query and rank."""
    order = np.lexsort((place, gap, at))
    start = np.searchsorted(at[order], at[order])
    return order[np.arange(len(order)) - start < k]


def _pairs(q_ids: pa.Array, y: np.ndarray, reach: np.ndarray, t_ids: pa.Array, x: np.ndarray, centre: np.ndarray, radius: float, k: int,
           exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) places of the k closest rows of a ball for each query that reaches it, by query and rank."""
    near = np.flatnonzero(~(np.sqrt(((y - centre) ** 2).sum(axis=1)) - radius > reach * LOOSE + TINY))
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    by_key = pc.sort_indices(t_ids).to_numpy()  # equal distances go to the smaller key
    at, place, gap = k_best(y[near], reach[near], x[by_key], k, int(exclude_self))
    at, place = near[at], by_key[place]
    if exclude_self:
        other = ~pc.equal(q_ids.take(pa.array(at)), t_ids.take(pa.array(place))).to_numpy(zero_copy_only=False).astype(bool)
        at, place, gap = at[other], place[other], gap[other]
    rank = np.empty(len(by_key), np.int64)
    rank[by_key] = np.arange(len(by_key))
    best = _first_k(at, rank[place], gap, k)
    return at[best], place[best], gap[best]


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _compare(k: int, exclude_self: bool):
    """Blocks of queries against blocks of rows; see `_meet` for the columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                q_ids, t_ids, carry = get("q_ids"), get("t_ids"), get("t_carry")
                y, x = _numbers(get("q_cells")).reshape(len(q_ids), -1), _numbers(get("t_cells")).reshape(len(t_ids), -1)
                at, place, gap = _pairs(q_ids, y, _numbers(get("q_reach")), t_ids, x, _numbers(get("centre")), batch.column("radius")[i].as_py(), k, exclude_self)
                if len(at):
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), t_ids.take(pa.array(place)), pa.array(gap), carry.take(pa.array(place))],
                                                     ["id", "neighbour", "distance", "carry"])
    return run


def _compare_groups(k: int, exclude_self: bool, found: pa.Schema):
    """A group of query blocks (each with the cells it `meets`) against a group of row blocks; a query's reach shrinks on the way."""
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        col = lambda table, name: table.column(name).combine_chunks()
        if not asked.num_rows or not rows.num_rows:
            return found.empty_table()
        of_cell: dict[str, list[int]] = {}
        for j, cell in enumerate(rows.column("cell").to_pylist()):
            of_cell.setdefault(cell, []).append(j)
        t_ids, t_cells, t_carry, centres, radii = (col(rows, c) for c in ("t_ids", "t_cells", "t_carry", "centre", "radius"))
        q_ids, q_cells, q_reach, meets = (col(asked, c) for c in ("q_ids", "q_cells", "q_reach", "meets"))
        out = []
        for i in range(asked.num_rows):
            ids, reach = q_ids[i].values, _numbers(q_reach[i].values).copy()
            y = _numbers(q_cells[i].values).reshape(len(ids), -1)
            at, gap, key, carry = np.zeros(0, np.int64), np.zeros(0), t_ids.values.slice(0, 0), t_carry.values.slice(0, 0)
            for j in (j for cell in meets[i].as_py() for j in of_cell.get(cell, ())):
                names, x = t_ids[j].values, _numbers(t_cells[j].values)
                more, place, far = _pairs(ids, y, reach, names, x.reshape(len(names), -1), _numbers(centres[j].values), radii[j].as_py(), k, exclude_self)
                if not len(more):
                    continue
                at, gap = np.concatenate([at, more]), np.concatenate([gap, far])
                key = pa.concat_arrays([key, names.take(pa.array(place))])
                carry = pa.concat_arrays([carry, t_carry[j].values.take(pa.array(place))])
                rank = np.empty(len(key), np.int64)
                rank[pc.sort_indices(key).to_numpy()] = np.arange(len(key))
                best = _first_k(at, rank, gap, k)
                at, gap, key, carry = at[best], gap[best], key.take(pa.array(best)), carry.take(pa.array(best))
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True))  # where a query has k rows by now, none further counts
                full = last[np.bincount(at, minlength=len(ids))[at[last]] >= k]
                reach[at[full]] = np.minimum(reach[at[full]], gap[full])
            out.append(pa.Table.from_arrays([ids.take(pa.array(at)), key, pa.array(gap, pa.float64()), carry], names=found.names))
        return pa.concat_tables(out)
    return run


def _blocks(rows: DataFrame, block: int, *values: str) -> DataFrame:
    """Rows of a cell side by side, about `block` of them a row: (cell, part, ids, cells, n, one array per value)."""
    crowded = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).filter("parts > 1")
    parted = rows.join(crowded, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    m = F.collect_list(F.struct("id", "v", *values)).alias("m")
    return parted.groupBy("cell", "part").agg(m, F.count(F.lit(1)).alias("n")).select(
        "cell", "part", "n", F.col("m.id").alias("ids"), F.flatten("m.v").alias("cells"), *[F.col(f"m.{v}").alias(v) for v in values])


def _walk(need: int):
    """One step down the tree for blocks of queries; children that no query of the block reaches end here.

    Queries with a k-th distance give the block its `near` reach from its centre. The others are bounded by the balls
    that together hold enough rows: `bound` from the centre, twice their own distance to it (`far`) on top.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, names, leaf, bounds = [], [], [], []
            far, near, bound = (batch.column(c).to_pylist() for c in ("far", "near", "bound"))
            for i in range(batch.num_rows):
                centre = batch.column("middle")[i].values.to_numpy(zero_copy_only=False)
                balls = batch.column("balls")[i].values
                radius, n = (balls.field(c).to_numpy(zero_copy_only=False) for c in ("radius", "n"))
                gap = np.sqrt(((lists(balls.field("centre")) - centre) ** 2).sum(axis=1))
                order = np.argsort(gap + radius, kind="stable")
                enough = np.flatnonzero(np.cumsum(n[order]) >= need)
                if len(enough):
                    bound[i] = min(bound[i], float((gap + radius)[order[enough[0]]]))
                reach = max(near[i], far[i] + bound[i])
                into = np.flatnonzero(~(gap - radius > reach * LOOSE + TINY))
                keep += [i] * len(into)
                bounds += [bound[i]] * len(into)
                names.append(balls.field("cell").take(pa.array(into)))
                leaf.append(balls.field("leaf").take(pa.array(into)))
            at = pa.array(keep, pa.int64())
            kept = [batch.column(c).take(at) for c in ("home", "q_part", "middle", "near", "far")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bounds, pa.float64()), pa.concat_arrays(names), pa.concat_arrays(leaf)],
                                             ["home", "q_part", "middle", "near", "far", "bound", "node", "leaf"])
    return run


_STEP = "home string, q_part int, middle array<double>, near double, far double, bound double, node string, leaf boolean"


def visits(tree: BallTree, blocks: DataFrame, need: int) -> DataFrame:
    """(home, q_part, cell): the leaves beside its own that a block of queries has to be compared with."""
    front = blocks.select(F.col("cell").alias("home"), F.col("part").alias("q_part"), "middle", "near", "far",
                          F.lit(float("inf")).alias("bound"), F.substring_index("cell", "/", 1).alias("node"))
    found = None
    for children in tree.children:
        balls = children.groupBy(F.col("parent").alias("node")).agg(F.collect_list(F.struct("cell", "centre", "radius", "n", "leaf")).alias("balls"))
        step = materialize(front.join(balls, "node").mapInArrow(_walk(need), _STEP), "tree-walk")
        met = step.filter(F.col("leaf") & (F.col("node") != F.col("home"))).select("home", "q_part", F.col("node").alias("cell"))
        found = met if found is None else found.unionByName(met)
        front = step.filter(~F.col("leaf")).drop("leaf")
    return found


class Search:
    """The k closest training rows of each query row, in two rounds; `visits` and the blocks tell what the second one compares."""

    def __init__(self, train: DataFrame, query: DataFrame, key: str, vec: str, k: int, within: str | None, exclude_self: bool,
                 carry: Sequence[str], block: int):
        self.k, self.exclude_self = k, exclude_self
        taken = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.struct(F.lit(0).alias("none"))

        def side(df: DataFrame, *more: Column) -> DataFrame:
            rows = df.select(root_of(within).alias("cell"), F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), *more)
            return rows.filter(finite("v"))

        self.tree = grow(side(train, taken.alias("carry")), block)
        asked = side(query).withColumn("dist", F.lit(None).cast("double"))
        asked = materialize(self.tree.place(asked, self.tree.rows), "placed")
        self.found = T.StructType([T.StructField("id", query.schema[key].dataType), T.StructField("neighbour", train.schema[key].dataType),
                                   T.StructField("distance", T.DoubleType()), T.StructField("carry", self.tree.leaves.schema["carry"].dataType)])
        cells = None
        for c in self.tree.children:
            part = c.filter("leaf").select("cell", "centre", "radius", F.col("n").alias("rows"))
            cells = part if cells is None else cells.unionByName(part)
        if cells is None:  # no training row
            self.t_blocks = self.q_blocks = self.visits = None
            self.first = train.sparkSession.createDataFrame([], self.found)
            return
        rows, spare = self.tree.leaves, k + int(exclude_self)
        copies = cells.filter((F.col("radius") == 0) & (F.col("rows") > spare)).select("cell")
        if not copies.isEmpty():  # equal rows are equally far from any query, which can want no more than the smallest keys
            smallest = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
            few = rows.join(copies, "cell", "left_semi").withColumn("copy", smallest).filter(F.col("copy") <= spare).drop("copy")
            rows = rows.join(copies, "cell", "left_anti").unionByName(few)
        self.t_blocks = materialize(_blocks(rows, block, "carry").join(cells, "cell"), "row-blocks")
        open_ended = asked.withColumn("reach", F.lit(float("inf")))
        own = _blocks(open_ended, block, "reach").withColumn("home", F.col("cell"))
        self.first = materialize(self._best(self._meet(own)), "own-leaf")
        kth = self.first.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")).filter(F.col("n") >= k).drop("n")
        carried = asked.join(kth, "id", "left").withColumn("reach", F.coalesce("kth", F.lit(float("inf"))))
        blocks = _blocks(carried.drop("kth"), block, "dist", "reach")
        closed = F.zip_with("dist", "reach", lambda d, r: F.when(r < float("inf"), d + r))
        still = F.zip_with("dist", "reach", lambda d, r: F.when(r < float("inf"), None).otherwise(2 * d))
        lowest = F.lit(float("-inf"))
        blocks = blocks.join(cells.select("cell", F.col("centre").alias("middle")), "cell").withColumns({
            "near": F.coalesce(F.array_max(closed), lowest), "far": F.coalesce(F.array_max(still), lowest)})
        self.q_blocks = materialize(blocks, "query-blocks")
        self.visits = visits(self.tree, self.q_blocks, k + int(exclude_self))
        self.cores = train.sparkSession.sparkContext.defaultParallelism
        self.groups = [max(math.ceil(n / GROUP), math.ceil(math.sqrt(2 * self.cores))) for n in (asked.count(), self.tree.rows)]

    def _meet_groups(self) -> DataFrame:
        """The visits, a group of query blocks beside a group of row blocks in a task."""
        q_group = F.pmod(F.xxhash64("home", "q_part"), F.lit(self.groups[0])).cast("int").alias("q_group")
        t_group = F.pmod(F.xxhash64("cell"), F.lit(self.groups[1])).cast("int").alias("t_group")
        met = materialize(self.visits.select("home", "q_part", "cell", q_group, t_group), "visits")
        asked = self.q_blocks.select(F.col("cell").alias("home"), F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"),
                                     F.col("reach").alias("q_reach"))
        asked = met.groupBy("home", "q_part", "q_group", "t_group").agg(F.collect_list("cell").alias("meets")).join(asked, ["home", "q_part"]).drop("home", "q_part")
        rows = self.t_blocks.select("cell", F.col("ids").alias("t_ids"), F.col("cells").alias("t_cells"), F.col("carry").alias("t_carry"), "centre", "radius")
        rows = met.select("cell", F.col("q_group").alias("for_q"), F.col("t_group").alias("own")).distinct().join(rows, "cell")
        run = _compare_groups(self.k, self.exclude_self, to_arrow_schema(self.found))
        # few bytes stand for much work, so the number of tasks is not left to the sizes
        tasks = min(math.prod(self.groups), max(2 * self.cores, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        asked, rows = asked.repartition(tasks, "q_group", "t_group"), rows.repartition(tasks, "for_q", "own")
        return asked.groupBy("q_group", "t_group").cogroup(rows.groupBy("for_q", "own")).applyInArrow(run, self.found)

    def _meet(self, queries: DataFrame) -> DataFrame:
        """Query blocks (with the `cell` to compare with) beside the row blocks of that cell, compared in the tasks."""
        q = queries.select("cell", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("reach").alias("q_reach"))
        t = self.t_blocks.select("cell", F.col("ids").alias("t_ids"), F.col("cells").alias("t_cells"), F.col("carry").alias("t_carry"), "centre", "radius")
        return q.join(t, "cell").drop("cell").mapInArrow(_compare(self.k, self.exclude_self), self.found)

    def _best(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("id").orderBy("distance", "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def result(self) -> DataFrame:
        """(id, neighbour, distance, carry, rank), rows with at least one neighbour."""
        if self.visits is None:
            return self._best(self.first)
        second = self._meet_groups()
        return self._best(self.first.drop("rank").unionByName(second))

    def row_pairs(self) -> tuple[int, int]:
        """(pairs of rows in blocks that meet, all pairs of a query and a training row of the tree)."""
        if self.visits is None:
            return 0, 0
        t = self.t_blocks.groupBy("cell").agg(F.sum("n").alias("rows"))
        q = self.q_blocks.select(F.col("cell").alias("home"), F.col("part").alias("q_part"), F.col("n").alias("asked"))
        own = q.join(t, F.col("home") == F.col("cell")).select("asked", "rows")
        others = self.visits.join(q, ["home", "q_part"]).join(t, "cell").select("asked", "rows")
        met = own.unionByName(others).agg(F.sum(F.col("asked") * F.col("rows"))).first()[0] or 0
        return met, (q.agg(F.sum("asked")).first()[0] or 0) * self.tree.rows


def nearest(train: DataFrame, query: DataFrame, key: str, vec: str, k: int, within: str | None = None,
            exclude_self: bool = False, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, rank, neighbour, distance, carried columns): the k closest training rows of each query row.

    Euclidean; ties go to the smaller neighbour key. `within` restricts neighbours to rows of the same group,
    `exclude_self` leaves out the row with the query's own key, `carry` brings columns of the neighbour along. Keys are
    unique. A vector that is null, empty or holds a cell that is no finite number is nobody's neighbour. A query row with
    such a vector, or without any row to compare with, stays with rank 1 and a null neighbour.
    """
    found = Search(train, query, key, vec, k, within, exclude_self, carry, block).result()
    named = [F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)]
    out = query.select(F.col(key).alias("_asked")).join(found, F.col("_asked") == F.col("id"), "left")
    return out.select(F.col("_asked").alias(key), F.coalesce("rank", F.lit(1)).alias("rank"), "neighbour", "distance", *named)


def knn_classify(train: DataFrame, query: DataFrame, key: str, vec: str, label: str, k: int = 5,
                 exclude_self: bool = False, **kw) -> DataFrame:
    """Majority label of the k nearest rows, the smallest label on ties; null without a neighbour."""
    nn = nearest(train, query, key, vec, k, exclude_self=exclude_self, carry=[label], **kw)
    votes = nn.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("prediction"))


def knn_regress(train: DataFrame, query: DataFrame, key: str, vec: str, target: str, k: int = 5,
                exclude_self: bool = False, **kw) -> DataFrame:
    """Mean target of the k nearest rows; null without a neighbour."""
    nn = nearest(train, query, key, vec, k, exclude_self=exclude_self, carry=[target], **kw)
    return nn.groupBy(key).agg(F.avg(target).alias("prediction"))
