"""Look-ahead over ordered tables with one exchange.

The rows are range-partitioned on series and order; each slice is cut, while it is written, into blocks that hold some
thousand rows and the rows that follow them (the halo). Only the last blocks of a slice lack rows, and these are the
first rows of the next slices: a table of (slices x look-ahead) rows joins them. Windows and leads are then made block
by block, without moving the ordered rows again. A series may span any number of slices; many short ones share a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.ordering import as_list
from mlframe.session import materialize

BLOCK_ROWS = 8192
BROADCAST_ROWS = 100_000  # border rows that are sent to every task


def _changes(rows: pa.RecordBatch, keys: Sequence[int], before: list | None) -> np.ndarray:
    """Where a row belongs to another series than the row before it (nulls are equal)."""
    out = np.zeros(rows.num_rows, dtype=bool)
    for place, i in enumerate(keys):
        col = rows.column(i)
        null = pc.is_null(col).to_numpy(zero_copy_only=False)
        if len(col) > 1:
            differ = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), False).to_numpy(zero_copy_only=False)
            if pa.types.is_floating(col.type):
                nan = pc.fill_null(pc.is_nan(col), False).to_numpy(zero_copy_only=False)
                differ = differ & ~(nan[1:] & nan[:-1])
            out[1:] |= differ | (null[1:] != null[:-1])
        if before is not None and len(col):
            out[0] |= not (before[place] == col[0].as_py() or (before[place] != before[place] and col[0].as_py() != col[0].as_py()))
    return out


def _cut(keys: Sequence[int], ahead: int, block: int):
    """Sorted rows of a slice to blocks; `run` numbers the series of the slice, `pos` the rows of a series."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, runs, at, before = TaskContext.get().partitionId(), 0, 0, 0, None
        held: list[tuple[pa.StructArray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def joined():
            return pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

        def made(rows, series, pos, lo, own):
            hi = min(lo + own + ahead, len(rows))
            one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), a.slice(lo, hi - lo) if kind is None else pa.array(a[lo:hi], kind))
            first, last = rows.slice(lo, 1), rows.slice(lo + own - 1, 1)
            pick = lambda r: pa.StructArray.from_arrays([r.field(i) for i in keys], [f"k{j}" for j in range(len(keys))]) if keys else pa.array([{"k0": 0}], pa.struct([("k0", pa.int32())]))
            cols = [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([own], pa.int32()), pa.array([lo + own + ahead > len(rows)]), pick(first), pick(last),
                    pa.array([int(series[lo + own - 1])], pa.int64()), pa.array([int(pos[lo + own - 1])], pa.int64()),
                    one(rows, None), one(series, pa.int64()), one(pos, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["part", "no", "own", "open", "first", "last", "last_run", "last_pos", "rows", "runs", "places"])

        for batch in batches:
            if not batch.num_rows:
                continue
            turn = _changes(batch, keys, before)
            series = runs + np.cumsum(turn)
            start = np.maximum.accumulate(np.where(turn, np.arange(len(turn)), 0))
            pos = np.arange(len(turn)) - start + np.where(series == runs, at, 0)
            held.append((pa.StructArray.from_arrays(batch.columns, batch.schema.names), series, pos))
            runs, at, before = int(series[-1]), int(pos[-1]) + 1, [batch.column(i)[batch.num_rows - 1].as_py() for i in keys]
            waiting += batch.num_rows
            if waiting >= block + ahead:
                rows, series, pos = joined()
                lo = 0
                while len(rows) - lo >= block + ahead:
                    yield made(rows, series, pos, lo, block)
                    no, lo = no + 1, lo + block
                held, waiting = [(rows.slice(lo), series[lo:], pos[lo:])], len(rows) - lo
        if waiting:
            rows, series, pos = joined()
            for lo in range(0, len(rows), block):
                yield made(rows, series, pos, lo, min(block, len(rows) - lo))
                no += 1
    return run


def _borders(edges: Sequence, ahead: int) -> tuple[list[tuple], list[tuple]]:
    """From one row per slice: (part, base, offset) numbering its series and the rows of its first one through the whole
    table, and (part, next part, order, rows to take, base, offset) naming the rows that follow it."""
    numbers, base, offset, before = [], 0, 0, None
    for e in edges:
        if before is not None:
            goes_on = e["first"] == before["last"] or str(e["first"]) == str(before["last"])
            base = base + before["last_run"] + (0 if goes_on else 1)
            offset = before["last_pos"] + 1 + (offset if before["last_run"] == 0 else 0) if goes_on else 0
        numbers.append((e["part"], base, offset))
        before = e
    follow = []
    for i, e in enumerate(edges):
        left, j = ahead, i + 1
        while left > 0 and j < len(edges):
            take = min(left, edges[j]["n"])
            follow.append((e["part"], edges[j]["part"], j - i, take, numbers[j][1], numbers[j][2]))
            left, j = left - take, j + 1
    return numbers, follow


def look_ahead(df: DataFrame, order_by, partition_by, ahead: int, make: Callable[[pa.StructArray, np.ndarray], list[pa.Array]],
               added: Sequence[T.StructField], stride: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """The rows with `ahead` more rows of their series behind them, every `stride`-th of a series, with `step` and `added` columns.

    `make(rows, at)` gets rows in order (a struct of the columns of `df`, as c0, c1, ...) and the places of the first
    rows of windows; places up to `at + ahead` are there. `step` is the 1-based place in the series.
    """
    spark, names = df.sparkSession, df.columns
    keys = [*as_list(partition_by), *as_list(order_by)]
    block = max(block, ahead, 1)
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    series = [names.index(p) for p in as_list(partition_by)]
    row = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    key = T.StructType([T.StructField(f"k{j}", df.schema[i].dataType) for j, i in enumerate(series)] or [T.StructField("k0", T.IntegerType())])
    long = T.ArrayType(T.LongType())
    blocked = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("own", T.IntegerType()), T.StructField("open", T.BooleanType()),
                            T.StructField("first", key), T.StructField("last", key), T.StructField("last_run", T.LongType()), T.StructField("last_pos", T.LongType()),
                            T.StructField("rows", T.ArrayType(row)), T.StructField("runs", long), T.StructField("places", long)])
    blocks = materialize(laid.mapInArrow(_cut(series, ahead, block), blocked), "halo")
    edges = blocks.groupBy("part").agg(F.sum("own").alias("n"), F.min_by("first", "no").alias("first"), F.max_by("last", "no").alias("last"),
                                       F.max_by("last_run", "no").alias("last_run"), F.max_by("last_pos", "no").alias("last_pos")).orderBy("part").collect()  # a row per slice
    numbers, follow = _borders(edges, ahead)
    numbered = spark.createDataFrame(numbers, "part int, base long, offset long")
    needs = spark.createDataFrame(follow, "to int, part int, order int, take int, n_base long, n_offset long")
    heads = blocks.filter("no = 0").select("part", *[F.slice(c, 1, ahead).alias(c) for c in ("rows", "runs", "places")]) if ahead else blocks.filter("false").select("part", "rows", "runs", "places")
    runs = F.transform("runs", lambda r: r + F.col("n_base"))
    places = F.zip_with("places", "runs", lambda p, r: p + F.when(r == 0, F.col("n_offset")).otherwise(0))
    taken = needs.join(heads, "part").select("to", F.struct("order", *[F.slice(c, F.lit(1), F.col("take")).alias(n) for n, c in (("rows", F.col("rows")), ("runs", runs), ("places", places))]).alias("m"))
    tails = taken.groupBy("to").agg(F.array_sort(F.collect_list("m"), lambda a, b: a["order"] - b["order"]).alias("m")).select(
        F.col("to").alias("part"), *[F.flatten(f"m.{c}").alias(f"t_{c}") for c in ("rows", "runs", "places")])
    if len(edges) * ahead <= BROADCAST_ROWS:
        tails = F.broadcast(tails)
    body = ["own", "rows", "runs", "places", "base", "offset"]
    whole = blocks.join(F.broadcast(numbered), "part")  # a row per slice
    nothing = [F.lit(None).cast(tails.schema[f"t_{c}"].dataType).alias(f"t_{c}") for c in ("rows", "runs", "places")]
    closed = whole.filter(~F.col("open")).select(*body, *nothing)
    ending = whole.filter("open").join(tails, "part", "left").select(*body, "t_rows", "t_runs", "t_places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                own, base, offset = (batch.column(c)[i].as_py() for c in ("own", "base", "offset"))
                rows, runs, places = get("rows"), get("runs").to_numpy(), get("places").to_numpy()
                places, runs = places + np.where(runs == 0, offset, 0), runs + base
                if batch.column("t_rows")[i].is_valid:
                    lack = max(0, own + ahead - len(rows))
                    rows = pa.concat_arrays([rows, get("t_rows").slice(0, lack)])
                    runs, places = np.concatenate([runs, get("t_runs").to_numpy()[:lack]]), np.concatenate([places, get("t_places").to_numpy()[:lack]])
                last = min(own, len(rows) - ahead)
                at = np.arange(max(0, last))
                at = at[(runs[at] == runs[at + ahead]) & (places[at] % stride == 0)]
                if len(at):
                    first = rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([first, pa.array(places[at] + 1, pa.int64()), *make(rows, at)], ["row", "step", *[f.name for f in added]])

    out = closed.unionByName(ending).mapInArrow(run, T.StructType([T.StructField("row", row), T.StructField("step", T.LongType()), *added]))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "step", *[f.name for f in added])


def windows_of(place: int, length: int) -> Callable[[pa.StructArray, np.ndarray], pa.Array]:
    """The `length` values of a column from each place on, nulls in their places."""
    def make(rows: pa.StructArray, at: np.ndarray) -> pa.Array:
        values = rows.field(place).take(pa.array((at[:, None] + np.arange(length)).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * length, pa.int32()), values)
    return make


def value_at(place: int, ahead: int) -> Callable[[pa.StructArray, np.ndarray], pa.Array]:
    return lambda rows, at: rows.field(place).take(pa.array(at + ahead))
