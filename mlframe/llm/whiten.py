"""Whitening of vectors: leading eigenvectors of their covariance by a block Jacobi-Davidson method.

The covariance is never formed. It is met only as a product with a few vectors at a time, which is one pass over
the table: every task multiplies its centred rows twice and sends a matrix of (length x vectors). The driver holds
such matrices only. A subspace grows by corrections: for each open Ritz pair the equation
(I - QQ')(V - e)(I - QQ') t = -r, Q the wanted Ritz vectors, is solved roughly by MINRES, all pairs in step, so that
one pass serves all of them. Rayleigh-Ritz on the subspace gives the next pairs; a pair whose residual is down to
double precision is locked and everything else kept orthogonal to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import packed, row_type, unpacked
from mlframe.llm.vectors import common_length, floored, matrix, summed_rows
from mlframe.session import materialize

SCALE, SHIFT = 64, 1_000_000
MOST = 1 << 61  # largest component before the shift
INNER, SLACK = 6, 0.05  # steps of MINRES at most, and the share of a residual that ends them
GUARD = 4  # vectors beyond the wanted ones in the first block
OUTER = 60
EPS = np.finfo(float).eps
LONG = (1 << 63) - 1


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = INNER, slack: float = SLACK) -> np.ndarray:
    """Approximate solutions of apply(x) = b for a symmetric operator, one system a column, all columns in step."""
    norm = lambda m: np.sqrt((m * m).sum(axis=0))
    over = lambda a, d: np.divide(a, d, out=np.zeros(np.broadcast(a, d).shape), where=d > 0)
    size = norm(b)
    v, before, beta = over(b, size), np.zeros_like(b), np.zeros_like(size)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_before, sin, sin_before = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    left = size.copy()
    for _ in range(steps):
        z = apply(v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - beta * before
        beta_next = norm(z)
        diagonal = cos * alpha - cos_before * sin * beta
        above, top = sin * alpha + cos_before * cos * beta, sin_before * beta
        rho = np.hypot(diagonal, beta_next)
        w, w_before = over(v - top * w_before - above * w, rho), w
        cos_before, sin_before = cos, sin
        cos, sin = over(diagonal, rho), over(beta_next, rho)
        x = x + cos * left * w
        left = -sin * left
        before, v, beta = v, over(z, beta_next), beta_next
        if (np.abs(left) <= slack * size).all():
            break
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of `new` add to the orthonormal `against`."""
    scale = np.sqrt((new * new).sum(axis=0))
    new = new[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
    if not new.shape[1]:
        return new
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-10]
    for q in against:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0]


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, many: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes) of the `many` largest eigenpairs of a symmetric matrix met only through `product`.

    All residuals end below `(64 + 4 size) * eps` of the largest value; otherwise an error is raised.
    """
    many = min(many, size)
    room = min(size, 3 * many + 2 * GUARD)
    passes = 0

    def times(m):
        nonlocal passes
        passes += 1
        return product(m)

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, many + GUARD))))[0]
    image = times(basis)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    for _ in range(OUTER):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y  # Ritz vectors first to last
        want = many - locked.shape[1]
        part = image[:, :want]
        residual = part - basis[:, :want] * theta[:want]
        residual = residual - locked @ (locked.T @ residual)
        tol = (64 + 4 * size) * EPS * max(abs(theta[0]), np.abs(values).max(initial=0.0))
        done = np.sqrt((residual ** 2).sum(axis=0)) <= tol
        rest = np.r_[np.flatnonzero(~done), np.arange(want, basis.shape[1])]
        locked, values = np.hstack([locked, basis[:, :want][:, done]]), np.r_[values, theta[:want][done]]
        if locked.shape[1] >= many:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order], passes
        basis, image, residual, shift = basis[:, rest], image[:, rest], residual[:, ~done], theta[:want][~done]
        frame = np.hstack([locked, basis[:, :len(shift)]])
        project = lambda m: m - frame @ (frame.T @ m)  # noqa: B023, E731
        if locked.shape[1] + basis.shape[1] < size:
            step = minres(lambda m: project(times(project(m)) - project(m) * shift), -project(residual))  # noqa: B023
            if locked.shape[1] + basis.shape[1] + step.shape[1] > room < size:
                keep = len(shift) + GUARD
                basis, image = basis[:, :keep], image[:, :keep]
            new = _orthonormal(step, locked, basis)[:, :size - locked.shape[1] - basis.shape[1]]
        else:
            new = basis[:, :0]
        if not new.shape[1]:  # nothing to add: look at the same space anew, with fresh products
            basis = _orthonormal(basis, locked)
            image = times(basis)
            continue
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    raise RuntimeError(f"{many - locked.shape[1]} eigenpairs short of double precision after {OUTER} rounds")


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S (exact integers); eigenvalues, unit eigenvectors in columns; trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def length(self) -> int:
        return len(self.sums)


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of each component, exact: 64-bit integers if they hold it, else Python's."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base)]
    y = x - np.array(base, np.int64)
    if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
        return n * y - np.array(rest, np.int64)
    return y.astype(object) * n - np.array(rest, object)


def _deviations(spread: np.ndarray) -> list[int]:
    """Sum of squares of each row, at most the largest long."""
    if int(np.abs(spread).max(initial=0)) ** 2 * spread.shape[1] > LONG:
        spread = spread.astype(object)
    return [min(LONG, int(d)) for d in (spread * spread).sum(axis=1)]


def _sums(length: int):
    """Sums of the components, upper and lower half apart, so that no sum leaves 64 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(length, np.int64), np.zeros(length, np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), length)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            cells = pa.array([high.tolist(), low.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([n, n], pa.int64()), cells], ["half", "n", "cells"])
    return run


def _blocks(length: int, n: int, sums: list[int]):
    """Centred rows, some 4 MB a block."""
    step = max(1, (1 << 19) // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), length)
            for lo in range(0, len(x), step):
                centred = _spread(x[lo:lo + step], n, sums).astype(float) / n
                yield pa.RecordBatch.from_arrays([pa.array([centred.tobytes()], pa.binary()), pa.array([float((centred ** 2).sum())])], ["cells", "squares"])
    return run


def _gram(length: int, right: np.ndarray, inner: np.ndarray | None):
    """Row sums of left' (x right) over all rows x, left being x itself or x inner, as (place, n, cells)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for cells in batch.column(0):
                x = np.frombuffer(cells.as_buffer()).reshape(-1, length)
                left = x if inner is None else np.hstack([x @ inner, np.ones((len(x), 1))])
                total = total + left.T @ (x @ right)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([1] * len(total), pa.int64()),
                                              pa.array(total.tolist(), pa.list_(pa.float64()))], ["place", "n", "cells"])
    return run


def _collected(blocks: DataFrame, length: int, right: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
    parts = blocks.select("cells").mapInArrow(_gram(length, right, inner), "place int, n long, cells array<double>")
    rows = summed_rows(parts, ["place"], "cells", right.shape[1], "double").collect()  # one row per component
    out = np.zeros((len(rows), right.shape[1]))
    for r in rows:
        out[r["place"]] = [r[f"s{i}"] for i in range(right.shape[1])]
    return out


def _integers(vector: str) -> Column:
    return F.transform(floored(vector, SCALE, MOST), lambda c: c + F.lit(SHIFT))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """The leading components of all rows that take part, see `whitened`; None if there are none.

    A component whose eigenvalue is not above rounding (constant or dependent coordinates, fewer rows than
    components) cannot be scaled to variance one and is left out.
    """
    rows = vectors.select(_integers(vector).alias("v")).filter("v is not null")
    length = common_length(rows)
    rows = rows.filter(F.size("v") == length)
    halves = {r["half"]: r for r in summed_rows(rows.mapInArrow(_sums(length), "half int, n long, cells array<long>"),
                                                ["half"], "cells", length, "decimal(38,0)").collect()}
    if not halves:
        return None
    n = halves[0]["n"]
    sums = [(int(halves[0][f"s{i}"]) << 32) + int(halves[1][f"s{i}"]) for i in range(length)]
    blocks = materialize(rows.mapInArrow(_blocks(length, n, sums), "cells binary, squares double"), "centred")
    trace = blocks.agg(F.sum("squares")).first()[0] / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((length, 0)), 0.0, 0.0, 0)
    values, axes, passes = leading(lambda u: _collected(blocks, length, u) / n, length, components)
    sound = values > (64 + 4 * length) * EPS * values[0]
    values, axes = values[sound], axes[:, sound]
    scaled = axes / np.sqrt(values)
    moments = _collected(blocks, length, scaled, scaled) / n  # second moments of the whitened rows, then their means
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
    return Whitening(n, sums, values, axes, trace, float(np.abs(covariance - np.eye(len(values))).max()), passes)


def whitened(vectors: DataFrame, fitted: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with `deviation` (sum of (n x - S)^2, at most the largest long) and `whitened` (one double a component).

    Components become x = floor(64 c) + 1000000 (64 c held within +-2^61). Rows whose vector is null, empty, of another
    length than most vectors or holds a null or non-finite entry are left out. Repeated rows stay, ties of eigenvalues give
    some basis of their space, other columns pass through whatever their names; an empty table gives an empty one.
    """
    length = fitted.length if fitted else 0
    kept = packed(vectors, v=_integers(vector)).filter(F.col("v").isNotNull() & (F.size("v") == length))
    scaled = fitted.axes / np.sqrt(fitted.values) if fitted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = _spread(matrix(batch.column(1), length), fitted.n, fitted.sums)
            out = (spread.astype(float) / fitted.n) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(spread), pa.int64()),
                                              pa.array(list(out), pa.list_(pa.float64()))], ["row", "deviation", "whitened"])

    out = kept.mapInArrow(run, f"row {row_type(vectors)}, deviation long, whitened array<double>")
    return unpacked(out, vectors, deviation=F.col("deviation"), whitened=F.col("whitened"))
