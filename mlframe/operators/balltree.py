"""A ball tree over the rows of a table, grown level by level on the cluster.

Every cell (at first: every group) with more rows than a leaf holds is split by some of its own rows, drawn by hash,
and by the row furthest from its centre, so that a cell of many equal rows and one other row is split as well. A row goes
to the closest pivot of its cell. The pivots of a level are sent to the tasks as long as their bytes are few; deeper levels
meet their rows through a shuffle on cell and salt. Nothing about single cells is looped over on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlframe.session import materialize

FAN = 32  # children of a cell at most, the one around the furthest row apart
LEVELS = 40
TABLE_BYTES = 32 << 20  # pivots of a level that are sent to every task
GROUP_ROWS = 1 << 17  # rows of a cell that meet its pivots in one task beyond that


def root_of(group: str | None) -> Column:
    """The name of a row's first cell: one per group value, nulls together. A name holds no slash."""
    if group is None:
        return F.lit("-")
    return F.coalesce(F.concat(F.lit("g"), F.hex(F.col(group).cast("string"))), F.lit("null"))


def finite(vec: str) -> Column:
    """Whether a vector is there and all its cells are numbers."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vec) > 0), F.lit(False))


def lists(col: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _moved(cells: list[str], dist: np.ndarray, x: np.ndarray, at: np.ndarray, pivots: np.ndarray) -> None:
    """Send the rows `at` to the closest pivot: a step down in `cells`, the distance in `dist`."""
    mine = x[at] - pivots.mean(axis=0)
    centre = pivots - pivots.mean(axis=0)
    which = np.empty(len(at), np.int64)
    for lo in range(0, len(at), 4096):
        part = mine[lo:lo + 4096]
        which[lo:lo + 4096] = ((centre ** 2).sum(axis=1) - 2 * part @ centre.T).argmin(axis=1)
    dist[at] = np.sqrt(((x[at] - pivots[which]) ** 2).sum(axis=1))
    for i, w in zip(at.tolist(), which.tolist()):
        cells[i] = f"{cells[i]}/{w}"


def _with(batch, cells: list[str], dist: np.ndarray):
    put = {"cell": pa.array(cells, pa.string()), "dist": pa.array(dist, pa.float64())}
    return [put.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]


def sent(pivots: DataFrame) -> dict[str, np.ndarray] | None:
    """The pivots of each cell for the tasks, None if they are too many bytes."""
    size = pivots.agg(F.sum(F.size("pivots") * F.size(F.get("pivots", F.lit(0)))) * 8).first()[0] or 0
    if size > TABLE_BYTES:
        return None
    return {r["cell"]: np.array(r["pivots"]) for r in pivots.select("cell", "pivots").collect()}


def descend(rows: DataFrame, pivots: DataFrame, table: dict[str, np.ndarray] | None, most: int) -> DataFrame:
    """One level down for the rows whose `cell` has pivots; `cell` and `dist` (to the centre of the cell) are replaced.

    `table` is `sent(pivots)`; `most` is the number of rows a cell can have.
    """
    if table is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, x = batch.column("cell").dictionary_encode(), lists(batch.column("v"))
                cells, dist = batch.column("cell").to_pylist(), batch.column("dist").to_numpy(zero_copy_only=False).copy()
                place = names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    if name in table:
                        _moved(cells, dist, x, np.flatnonzero(place == i), table[name])
                yield pa.RecordBatch.from_arrays(_with(batch, cells, dist), batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    salts = max(1, math.ceil(most / GROUP_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    dealt = pivots.select("cell", "pivots").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns("salt").combine_chunks()
        if not left.num_rows or not right.num_rows:
            return left
        cells, dist = left.column("cell").to_pylist(), left.column("dist").to_numpy().copy()
        x = lists(left.column("v").combine_chunks())
        _moved(cells, dist, x, np.arange(len(x)), np.array(right.column("pivots")[0].as_py()))
        return pa.Table.from_arrays(_with(left, cells, dist), names=left.schema.names)

    return salted.groupBy("cell", "salt").cogroup(dealt.groupBy("cell", "salt")).applyInArrow(meet, rows.schema)


@dataclass
class BallTree:
    """`leaves`: the rows with their leaf `cell`; per level the pivots of the cells split there and the children made.

    A child has `cell`, `parent`, `centre`, `n` rows, `radius` (of the largest distance to the centre) and `leaf`.
    """

    leaves: DataFrame
    pivots: list[tuple[DataFrame, dict[str, np.ndarray] | None]] = field(default_factory=list)
    children: list[DataFrame] = field(default_factory=list)
    rows: int = 0

    def place(self, rows: DataFrame, most: int) -> DataFrame:
        """Other rows, sent down the same way; a row of a group without cells stays at its root."""
        for pivots, table in self.pivots:
            rows = descend(rows, pivots, table, most)
        return rows


def _split_by(rows: DataFrame, level: int, leaf: int) -> DataFrame:
    """(cell, pivots) of every cell of `rows`: one row for each leaf it will fill, FAN at most, and the furthest row."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max_by("v", F.col("dist")).alias("far"), F.max("dist").alias("radius"))
    wanted = F.least(F.lit(FAN), F.ceil(F.col("n") / leaf)).cast("int")
    first = Window.partitionBy("cell").orderBy("draw", "v")
    drawn = rows.select("cell", "v", F.xxhash64(F.lit(level), "id").alias("draw")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= FAN)
    listed = drawn.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("m"))  # FAN rows at most
    both = listed.join(sizes, "cell")
    chosen = F.slice(F.col("m.v"), F.lit(1), wanted)
    chosen = F.when(F.col("radius") > 0, F.concat(chosen, F.array("far"))).otherwise(chosen)
    return both.select("cell", F.array_distinct(chosen).alias("pivots"))


def grow(rows: DataFrame, leaf: int) -> BallTree:
    """The tree of `rows` (cell: the root, id, v, other columns): leaves hold `leaf` rows at most, or rows that are all equal."""
    rows = materialize(rows.withColumn("dist", F.lit(None).cast("double")), "tree-rows")
    tree, done = BallTree(rows), []
    tree.rows = most = rows.count()
    for level in range(LEVELS if tree.rows else 0):
        pivots = materialize(_split_by(rows, level, leaf), "tree-pivots")
        table = sent(pivots)
        rows = materialize(descend(rows, pivots, table, most), "tree-rows")
        centres = pivots.select(F.col("cell").alias("parent"), F.posexplode("pivots").alias("no", "centre")).withColumn("cell", F.concat_ws("/", "parent", F.col("no").cast("string")))
        stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
        last = F.lit(level == LEVELS - 1)
        children = materialize(stats.join(centres.drop("no"), "cell").withColumn("leaf", (F.col("n") <= leaf) | (F.col("radius") == 0) | last), "tree-cells")
        tree.pivots.append((pivots, table))
        tree.children.append(children)
        left, most = children.filter(~F.col("leaf")).agg(F.count(F.lit(1)), F.max("n")).first()
        if not left:
            break
        still = children.filter(~F.col("leaf")).select("cell")
        done.append(rows.join(still, "cell", "left_anti"))
        rows = rows.join(still, "cell", "left_semi")
    for part in done:
        rows = rows.unionByName(part)
    tree.leaves = rows
    return tree
