"""Vector codes by product quantisation, nearest codebook entries found by Orchard's search.

Vectors of integers are cut into parts; each part position has a codebook of a few hundred entries. An entry
keeps the list of all other entries by rising distance. A search stands at the best entry known and reads its
list: by the triangle inequality no entry further from it than twice its own distance to the part can be as
near, so the list ends there. An entry that is nearer becomes the place to stand and its list is read instead;
entries met before are marked and not measured again. Tasks search many rows at a time, a few places of the
list a step. Fitting is one pass over the table a round: tasks send the sums of their parts by entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import packed, row_type, unpacked
from mlframe.llm.vectors import common_length, floored, matrix, summed_rows

SCALE = 1024
ROWS = 2048  # rows a task searches at a time
STEP = 16  # places of a neighbour list read a step
FAR = np.iinfo(np.int64).max


def largest(length: int) -> int:
    """The largest component: four times the squared distance of two whole vectors still is a 64-bit integer."""
    return math.isqrt((1 << 58) // max(1, length))


class Orchard:
    """Nearest entries by squared distance, the lower index of equally near ones."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(gap, axis=1, kind="stable")
        self.near = np.pad(order, ((0, 0), (0, STEP)))
        self.reach = np.pad(np.take_along_axis(gap, order, axis=1), ((0, 0), (0, STEP)), constant_values=FAR)
        self.starts = np.arange(0, len(entries), STEP)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        many = len(self.entries)
        first = ((x[:, None, :] - self.entries[self.starts][None, :, :]) ** 2).sum(axis=2)
        best = first.argmin(axis=1)
        here, least = self.starts[best], first[np.arange(len(x)), best]
        seen = np.zeros((len(x), many), dtype=bool)
        seen[:, self.starts] = True
        place = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            at = (here[todo][:, None], place[todo][:, None] + np.arange(STEP))
            other, reach = self.near[at], self.reach[at]
            within = reach <= 4 * least[todo][:, None]
            r, c = np.nonzero(within & ~seen[todo[:, None], other])
            met = other[r, c]
            seen[todo[r], met] = True
            dist = np.full(other.shape, FAR)
            dist[r, c] = ((x[todo[r]] - self.entries[met]) ** 2).sum(axis=1)
            low = dist.min(axis=1)
            index = np.where(dist == low[:, None], other, many).min(axis=1)
            better = (low < least[todo]) | ((low == least[todo]) & (index < here[todo]))
            moved = todo[better]
            here[moved], least[moved], place[moved] = index[better], low[better], 0
            place[todo[~better]] += STEP
            todo = todo[better | within[:, -1]]
        return here, least


@dataclass(frozen=True)
class Codebooks:
    """Entries (integers) of each part position, and where the parts of a vector start and end."""

    parts: list[np.ndarray]
    cuts: list[int]

    @property
    def length(self) -> int:
        return self.cuts[-1]

    def digest(self) -> str:
        """sha256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for p in self.parts for v in p.ravel()).encode()).hexdigest()

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts entry indexes, rows x parts squared distances)."""
        trees = [Orchard(p) for p in self.parts]
        code, error = np.zeros((len(x), len(trees)), np.int64), np.zeros((len(x), len(trees)), np.int64)
        for lo in range(0, len(x), ROWS):
            for p, (tree, a, b) in enumerate(zip(trees, self.cuts, self.cuts[1:])):
                code[lo:lo + ROWS, p], error[lo:lo + ROWS, p] = tree.search(x[lo:lo + ROWS, a:b])
        return code, error


def _least_ids(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64)
        for batch in batches:
            best = np.unique(np.concatenate([best, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(best)], ["id"])
    return run


def _part_sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(p) for p in books.parts], [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in batches:
            x = matrix(batch.column(0), books.length)
            code, _ = books.codes(x)
            for p, (a, b) in enumerate(zip(books.cuts, books.cuts[1:])):
                order = np.argsort(code[:, p], kind="stable")
                used, start = np.unique(code[order, p], return_index=True)
                if len(used):
                    sums[p][used] += np.add.reduceat(x[order, a:b], start, axis=0)
                    counts[p] += np.bincount(code[:, p], minlength=len(counts[p]))
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                             ["part", "entry", "n", "sums"])
    return run


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks after `rounds` rounds of assigning all parts and moving each entry to floor(sum / count) of its parts.

    They start as the parts of the `entries` smallest keys (integers; of a repeated key the smallest vector; rows
    without a key start none). An entry without parts stays. None if no row takes part, see `compress`.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits tells 256 entries apart")
    whole = vectors.select(F.col(key).cast("long").alias("id"), floored(vector, SCALE, largest(1)).alias("v")).filter("v is not null")
    length = common_length(whole)
    most = largest(length)
    rows = (vectors.select(F.col(key).cast("long").alias("id"), floored(vector, SCALE, most).alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") == length)))
    ids = [r[0] for r in rows.select("id").filter("id is not null").mapInArrow(_least_ids(entries), "id long").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return None
    start = sorted(rows.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).collect())
    first = np.array([r["v"] for r in start], np.int64)
    cuts = [i * length // parts for i in range(parts + 1)]
    books = Codebooks([first[:, a:b].copy() for a, b in zip(cuts, cuts[1:])], cuts)
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_part_sums(books), "part int, entry int, n long, sums array<long>")
        moved = [p.copy() for p in books.parts]
        for r in summed_rows(found, ["part", "entry"], "sums", width, "decimal(38,0)").collect():  # at most parts x entries rows
            moved[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(moved[r["part"]].shape[1])]
        books = Codebooks(moved, cuts)
    return books


def compress(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with `code` (two hex digits a part) and `error` (squared distances summed over parts).

    Components become floor(1024 x), held within +-`largest`. Rows whose vector is null, empty, of another length than
    the codebooks (the most frequent one when they were fitted) or holds a null or non-finite component are left out.
    Ties go to the lower index, repeated rows are coded alike and stay, other columns pass through untouched whatever
    their names; an empty table gives an empty one.
    """
    length = books.length if books else 0
    kept = packed(vectors, v=floored(vector, SCALE, largest(length))).filter(F.col("v").isNotNull() & (F.size("v") == length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = books.codes(matrix(batch.column(1), length))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string()),
                                              pa.array(error.sum(axis=1))], ["row", "code", "error"])

    out = kept.mapInArrow(run, f"row {row_type(vectors)}, code string, error long")
    return unpacked(out, vectors, code=F.col("code"), error=F.col("error"))
