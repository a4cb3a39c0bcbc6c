"""Logistic regression of two classes over more features than the driver can hold.

MLlib keeps some thirty vectors as long as the features on the driver: coefficients, gradients and the history of
L-BFGS. Here all of them stay in the span of the gradients' data parts, X'r for the residuals r of each iterate, so the
driver works with their few coordinates and with the products between them, and takes the same steps as MLlib: the same
standardised and centred features, penalty, line search and stops.

The rows lie in parts of some million cells. An iteration sends the sums of each part, feature by feature, to groups of
features, which add them up and send every part the totals it asked for; the part turns them into XX'r for its own rows.
Features that only one part has stay there.
Groups grow in number with the features, and nothing as long as features or rows passes the driver or a broadcast.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasRegParam, HasTol
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mlframe.session import materialize

CELLS = 1_000_000  # cells of a part; a longer row is a part of its own
ROWS = 16_384      # rows of a partition of parts, where the cores have two each
ENTRIES = 500_000  # sums a group of features adds up, one for each part and feature
HISTORY = 10       # steps that L-BFGS remembers

# names of the arrays of a part: ends of its rows among the cells, place of each cell's feature in `ids`, value of each cell
_PARTS = "part bigint, n int, width int, cells binary"
_SENT = "part bigint, grp int, ids binary, sums binary"


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter, HasRegParam, HasTol):
    def _defaults(self) -> None:
        self._setDefault(maxIter=100, regParam=0.0, tol=1e-6)


# --- parts and groups --------------------------------------------------------------------

def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed value."""
    made = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays.values()]
    batch, sink = pa.RecordBatch.from_arrays(made, names=list(arrays)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Scalar) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
    return {name: col.flatten().to_numpy(zero_copy_only=False) for name, col in zip(batch.schema.names, batch.columns)}


def _numbers(packed: pa.Scalar, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), dtype)


def _cells(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells before each row and in all, feature, value) of a column of sparse or dense vectors."""
    if vectors.null_count:
        raise ValueError("a vector is null")
    kind, indices, values = (pc.struct_field(vectors, f) for f in ("type", "indices", "values"))
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    feature = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    sparse = np.repeat(kind.to_numpy(zero_copy_only=False) == 0, sizes)
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return ends, feature, values.flatten().to_numpy(zero_copy_only=False)


def _parts(df: DataFrame, features: str, kept: Sequence[str]) -> DataFrame:
    """(part, n, width, cells, rows): stretches of rows with the cells of their vectors; `rows` holds the kept columns."""
    schema = T._parse_datatype_string(_PARTS).add("rows", T.ArrayType(T.StructType([df.schema[c] for c in kept])))

    def made(part: int, held: list) -> pa.RecordBatch:
        rows = pa.concat_arrays([r for r, _, _, _ in held])
        ids, place = np.unique(np.concatenate([f for _, _, f, _ in held]), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([s for _, s, _, _ in held]))])
        cells = _pack(ends=ends, ids=ids.astype(np.int32), place=place.astype(np.int32), x=np.concatenate([x for _, _, _, x in held]))
        values = [pa.array([part]), pa.array([len(rows)], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([cells], pa.binary())]
        return pa.RecordBatch.from_arrays([*values, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["part", "n", "width", "cells", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends, feature, value = _cells(batch.column(batch.num_columns - 1))
            rows, a = pa.StructArray.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]), 0
            while a < batch.num_rows:  # rows until the part is full
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(ends, ends[a] + CELLS - size))))
                at = slice(ends[a], ends[b])
                held.append((rows.slice(a, b - a), np.diff(ends[a:b + 1]), feature[at].astype(np.int32), value[at]))
                size, a = size + int(ends[b] - ends[a]), b
                if size >= CELLS:
                    yield made(part, held)
                    part, held, size = part + 1, [], 0
        if held:
            yield made(part, held)
    return df.select(*kept, features).mapInArrow(run, schema)


def _values(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, numbers as Python's and all else as Arrow's."""
    for i in range(batch.num_rows):
        row = {name: col[i] for name, col in zip(batch.schema.names, batch.columns)}
        yield {name: v.as_py() if pa.types.is_integer(v.type) else v for name, v in row.items()}


def _each(df: DataFrame, schema: str, use: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows made from rows one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in _values(batch):
                made = list(use(v))
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=out)
    out = to_arrow_schema(T._parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def _sent(part: int, ids: np.ndarray, sums: np.ndarray, groups: int) -> Iterator[dict]:
    """The sums of a part (one row or several for each feature) on their way to the groups of their features."""
    grp = ids % groups
    order = np.argsort(grp, kind="stable")
    cuts = np.searchsorted(grp[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[g]:cuts[g + 1]]
        yield {"part": part, "grp": int(g), "ids": _pack(steps=np.diff(ids[at], prepend=np.int32(0))), "sums": np.ascontiguousarray(sums[..., at]).tobytes()}


def _features(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(packed)["steps"], dtype=np.int32)


def _merge(table: pa.Table, lines: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(features, places of each sender's features among them, totals) of a group."""
    ids = [_features(v) for v in table["ids"]]
    known, place = np.unique(np.concatenate(ids), return_inverse=True)
    sums = np.concatenate([_numbers(v).reshape(lines, -1) for v in table["sums"]], axis=1)
    totals = np.stack([np.bincount(place, weights=s, minlength=len(known)) for s in sums])
    return known, np.split(place, np.cumsum([len(i) for i in ids])[:-1]), totals


def _totals(sent: DataFrame, lines: int, groups: int, pieces: int) -> DataFrame:
    """Every part's share of the totals over all parts, (part, totals): per group its number and the sums in the order they were sent."""
    def run(table: pa.Table) -> pa.Table:
        _, places, totals = _merge(table, lines)
        return pa.table({"part": table["part"], "grp": table["grp"], "sums": pa.array([np.ascontiguousarray(totals[:, p]).tobytes() for p in places], pa.binary())})
    return _back(_grouped(sent, groups).applyInArrow(run, "part bigint, grp int, sums binary"), pieces)


def _grouped(sent: DataFrame, groups: int) -> GroupedData:
    return sent.repartition(groups, "grp").groupBy("grp")


def _back(answers: DataFrame, pieces: int) -> DataFrame:
    """The answers to each part, placed where the part is stored."""
    return answers.repartition(pieces, "part").groupBy("part").agg(F.collect_list(F.struct("grp", "sums")).alias("totals"))


def _pieces(spark: SparkSession, rows: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, rows // ROWS)


def _spread(totals: pa.Scalar, ids: np.ndarray, groups: int, lines: int = 1) -> np.ndarray:
    """The totals a part got back, in the order of its features."""
    got = sorted(((v["grp"], v["sums"]) for v in totals.as_py() or []), key=lambda v: v[0])
    out = np.empty((lines, len(ids)))
    if got:
        out[:, np.argsort(ids % groups, kind="stable")] = np.concatenate([np.frombuffer(s).reshape(lines, -1) for _, s in got], axis=1)
    return out


def _by_feature(c: dict, weights: np.ndarray) -> np.ndarray:
    """Numbers of the cells of a part, summed by feature."""
    return np.bincount(c["place"], weights=weights, minlength=len(c["ids"]))


def _row_of(c: dict) -> np.ndarray:
    return np.repeat(np.arange(len(c["ends"]) - 1), np.diff(c["ends"]))


def _by_part(big: DataFrame, small: DataFrame) -> DataFrame:
    """The stored parts, which stay where they are, with what came for them."""
    return big.join(small.hint("shuffle_hash"), "part", "left")


# --- the fit -----------------------------------------------------------------------------

class WideLogistic(Estimator, _Shared):
    """Labels 0 and 1; an intercept, an L2 penalty on standardised features."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction",
                 maxIter=100, regParam=0.0, tol=1e-6):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> WideLogisticModel:
        label = F.col(self.getLabelCol()).cast("double")
        sizes = {r["y"]: r["n"] for r in df.groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
        if not sizes or not set(sizes) <= {0.0, 1.0}:
            raise ValueError("labels must be 0 or 1")
        if len(sizes) == 1:  # nothing to tell apart
            empty = df.sparkSession.createDataFrame([], "grp int, ids binary, coef binary")
            return self._copyValues(WideLogisticModel(empty, 1, math.inf if 1.0 in sizes else -math.inf))
        return self._copyValues(_Fit(self, df.select(label.alias("y"), F.col(self.getFeaturesCol()).alias("features")), sizes).run())


class _Fit:
    """One fit. A vector as long as the features is a list of coordinates: of X'r for each iterate so far, and its intercept.

    Features are meant standardised and centred. `gram` holds the products of the X'r, `means` what centring takes off XX'r.
    """

    def __init__(self, est: WideLogistic, df: DataFrame, sizes: dict):
        self.est, self.n, self.ones = est, sum(sizes.values()), sizes[1.0]
        self.spark = df.sparkSession
        most = est.getMaxIter() + 1
        self.size, self.gram, self.means = most, np.zeros((most, most)), np.zeros(most)
        self.points: list[np.ndarray] = []  # the iterate of each X'r
        self.rests: list[float] = []        # and what its residuals add up to
        self.store(df)

    def store(self, df: DataFrame) -> None:
        """The parts, placed by part, with the mean and the inverse variance of their features, kept on disk; beside them labels and margins."""
        pieces = self.pieces = _pieces(self.spark, self.n)
        raw = _parts(df.coalesce(pieces), "features", ["y"]).repartition(pieces, "part").persist(StorageLevel.DISK_ONLY)
        entries = raw.agg(F.sum("width")).first()[0]
        groups = self.groups = max(1, min(self.spark.sparkContext.defaultParallelism, entries // 1000), -(-entries // ENTRIES))
        n = float(self.n)

        def moments(v: dict) -> Iterator[dict]:
            c = _unpack(v["cells"])
            yield from _sent(v["part"], c["ids"], np.stack([*(_by_feature(c, w) for w in (c["x"], c["x"] ** 2)), np.ones(len(c["ids"]))]), groups)

        def scaled(v: dict) -> Iterator[dict]:
            c = _unpack(v["cells"])
            s1, s2, parts = _spread(v["totals"], c["ids"], groups, 3)
            yield {"part": v["part"], "cells": _pack(**c, mean=s1 / n, inverse=_inverse(s1, s2, n), shared=np.flatnonzero(parts > 1).astype(np.int32))}

        def labels(v: dict) -> Iterator[dict]:
            y = pc.struct_field(v["rows"].values, "y").to_numpy(zero_copy_only=False)
            yield {"part": v["part"], "n": len(y), "y": y.tobytes(), "z": b""}
        back = _totals(_each(raw.select("part", "cells"), _SENT, moments), 3, groups, pieces)
        done = _each(_by_part(raw.select("part", "cells"), back), "part bigint, cells binary", scaled)
        self.stored = done.repartition(pieces, "part").persist(StorageLevel.DISK_ONLY)
        self.state = materialize(_each(raw.select("part", "rows"), "part bigint, n int, y binary, z binary", labels), "margins")
        self.stored.count()
        raw.unpersist()

    # coordinates

    def inner(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a[:-1] @ self.gram @ b[:-1] + a[-1] * b[-1])

    def penalty(self, a: np.ndarray, b: np.ndarray) -> float:
        return self.est.getRegParam() * float(a[:-1] @ self.gram @ b[:-1])

    def weights(self, a: np.ndarray) -> tuple[list[float], float]:
        """What to multiply XX'r with and to add, for the margins of a vector."""
        k = len(self.points)
        return a[:k].tolist(), float(a[-1] - a[:k] @ self.means[:k])

    def margins(self, a: np.ndarray) -> Callable[[dict], np.ndarray]:
        at, more = self.weights(a)
        k = len(at)
        return lambda v: np.asarray(at) @ _numbers(v["z"]).reshape(-1, v["n"])[:k] + more

    # passes over the rows

    def along(self, x: np.ndarray, d: np.ndarray, t: float) -> tuple[float, float, float]:
        """(loss, slope, sum of residuals) at x + t d; reads the margins only."""
        start, step = self.margins(x), self.margins(d)

        def sums(v: dict) -> Iterator[dict]:
            y, away = _numbers(v["y"]), step(v)
            m = start(v) + t * away
            r = _sigmoid(m) - y
            yield {"loss": float(np.sum(np.logaddexp(0.0, m) - y * m)), "slope": float(r @ away), "rest": float(r.sum())}
        loss, slope, rest = _each(self.state, "loss double, slope double, rest double", sums).agg(F.sum("loss"), F.sum("slope"), F.sum("rest")).first()
        at = x + t * d
        return loss / self.n + 0.5 * self.penalty(at, at), slope / self.n + self.penalty(at, d), rest

    def gradient(self, x: np.ndarray, rest: float) -> np.ndarray:
        """The gradient at `x`, whose residuals add up to `rest`: X'r joins the coordinates, its products the table."""
        k, groups, at = len(self.points), self.groups, self.margins(x)

        def residuals(v: dict) -> np.ndarray:
            return _sigmoid(at(v)) - _numbers(v["y"])

        def sums(v: dict) -> Iterator[dict]:
            c = _unpack(v["cells"])
            yield from _sent(v["part"], c["ids"][c["shared"]], _by_feature(c, c["x"] * residuals(v)[_row_of(c)])[c["shared"]], groups)

        def products(v: dict) -> Iterator[dict]:
            c, r = _unpack(v["cells"]), residuals(v)
            total = _by_feature(c, c["x"] * r[_row_of(c)])  # right where no other part has the feature
            total[c["shared"]] = _spread(v["totals"], c["ids"][c["shared"]], groups)[0]
            u = (total - c["mean"] * rest) * c["inverse"]
            z = np.append(_numbers(v["z"]), np.bincount(_row_of(c), weights=c["x"] * u[c["place"]], minlength=v["n"])).reshape(-1, v["n"])
            yield {"part": v["part"], "n": v["n"], "y": v["y"].as_py(), "z": z.tobytes(), "sum": float(z[-1].sum()), "g": (z @ r).tolist()}
        here = self.stored.select("part", "cells")
        back = _totals(_each(_by_part(here, self.state), _SENT, sums), 1, groups, self.pieces)
        self.state = materialize(_each(_by_part(_by_part(here, back), self.state), "part bigint, n int, y binary, z binary, sum double, g array<double>", products), "margins")
        made = self.state.agg(F.sum("sum"), *[F.sum(F.get("g", F.lit(i))) for i in range(k + 1)]).first()
        self.state = self.state.select("part", "n", "y", "z")
        self.means[k] = made[0] / self.n
        self.gram[k, :k + 1] = self.gram[:k + 1, k] = np.array(made[1:]) - self.means[:k + 1] * rest
        self.points.append(x)
        self.rests.append(rest)
        out = self.est.getRegParam() * x
        out[k] += 1.0 / self.n
        out[-1] = rest / self.n
        return out

    def run(self) -> WideLogisticModel:
        x = np.zeros(self.size + 1)
        x[-1] = math.log(self.ones / (self.n - self.ones))
        share = self.ones / self.n
        value = first = -(share * math.log(share) + (1 - share) * math.log(1 - share))
        grad, tol = self.gradient(x, 0.0), self.est.getTol()
        steps: deque = deque(maxlen=HISTORY)  # (step, change of the gradient), the newest first
        recent, failed, done = deque([math.inf], maxlen=20), False, 0
        while True:
            if done >= self.est.getMaxIter() or (len(recent) > 1 and abs(value - max(recent)) <= tol * abs(first)):
                break
            if math.sqrt(self.inner(grad, grad)) <= max(tol * abs(value), 1e-8):
                break
            try:
                d = self.direction(grad, steps)
                t, at, rest = self.search(x, d, value, self.inner(grad, d), 1.0 if done else 1.0 / math.sqrt(self.inner(d, d)))
                if t * math.sqrt(self.inner(grad, grad)) < 1e-10:
                    raise ArithmeticError("the step is too small")
            except ArithmeticError:
                if failed:
                    break
                failed = True
                steps.clear()
                continue
            done += 1
            new = x + t * d
            if done < self.est.getMaxIter():
                slope = self.gradient(new, rest)
                steps.appendleft((new - x, slope - grad))
                grad = slope
            x, value = new, at
            recent.append(value)
        return self.model(x)

    def direction(self, grad: np.ndarray, steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """L-BFGS, its two loops over coordinates."""
        d, taken, scale = grad.copy(), [], 1.0
        if steps:
            scale = self.inner(*steps[0]) / self.inner(steps[0][1], steps[0][1])
            if not scale >= 0:
                raise ArithmeticError("no curvature")
        for s, y in steps:
            rho = self.inner(s, y)
            a = self.inner(s, d) / rho
            taken.append((s, y, rho, a))
            d = d - a * y
        d = d * scale
        for s, y, rho, a in reversed(taken):
            d = d + (a - self.inner(y, d) / rho) * s
        return -d

    def search(self, x: np.ndarray, d: np.ndarray, value: float, slope: float, t: float) -> tuple[float, float, float]:
        """(step, loss, sum of residuals) under the strong Wolfe conditions, by the rule of MLlib's line search."""
        if not slope <= 0:
            raise ArithmeticError("not downhill")

        def at(t: float) -> tuple:
            loss, dd, rest = self.along(x, d, t)
            return t, loss, dd, rest

        def zoom(low: tuple, high: tuple) -> tuple:
            for _ in range(10):
                c = at(_between(high, low) if low[0] > high[0] else _between(low, high))
                if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                    high = c
                    continue
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
            raise ArithmeticError("no step between")

        low = (0.0, value, slope, 0.0)
        for i in range(10):
            c = at(t)
            if not math.isfinite(c[1]):
                t /= 2
                continue
            if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
                c = zoom(low, c)
            elif abs(c[2]) > 0.9 * abs(slope):
                if c[2] < 0:
                    low, t = c, t * 1.5
                    continue
                c = zoom(c, low)
            return c[0], c[1], c[3]
        raise ArithmeticError("no step found")

    def model(self, x: np.ndarray) -> WideLogisticModel:
        """The coefficients of the features as they come, from the weighted residuals of all iterates; a stored table."""
        groups, n, k = self.groups, float(self.n), len(self.points)
        points, rest, (weight, more) = [self.weights(p) for p in self.points], float(x[:k] @ self.rests), self.weights(x)

        def sums(v: dict) -> Iterator[dict]:
            c, y = _unpack(v["cells"]), _numbers(v["y"])
            z, a = _numbers(v["z"]).reshape(k, -1), np.zeros(len(y))
            for w, (at, up) in zip(weight, points):
                a += w * (_sigmoid(np.asarray(at) @ z + up) - y)
            yield from _sent(v["part"], c["ids"], np.stack([_by_feature(c, w) for w in (c["x"] * a[_row_of(c)], c["x"], c["x"] ** 2)]), groups)

        def solved(table: pa.Table) -> pa.Table:
            ids, _, (t, s1, s2) = _merge(table, 3)
            coef = (t - s1 / n * rest) * _inverse(s1, s2, n)
            return pa.table({"grp": table["grp"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "coef": pa.array([coef.tobytes()], pa.binary())})
        sent = _each(_by_part(self.stored, self.state), _SENT, sums)
        made = materialize(_grouped(sent, groups).applyInArrow(solved, "grp int, ids binary, coef binary"), "coefficients")
        self.stored.unpersist()
        return WideLogisticModel(made, groups, more)


class WideLogisticModel(Model, _Shared):
    """An intercept and a stored table of coefficients: per group the features, ascending, and a number for each."""

    def __init__(self, coefficients: DataFrame, groups: int, intercept: float):
        super().__init__()
        self._defaults()
        self.coefficients, self.groups, self.intercept = coefficients, groups, intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        """The rows with MLlib's three columns, stored; without the vectors, which would travel along."""
        kept, groups, start = [c for c in df.columns if c != self.getFeaturesCol()], self.groups, self.intercept
        pieces = _pieces(df.sparkSession, df.count())
        parts = _parts(df.coalesce(pieces), self.getFeaturesCol(), kept).repartition(pieces, "part").persist(StorageLevel.DISK_ONLY)

        def asked(v: dict) -> Iterator[dict]:
            ids = _unpack(v["cells"])["ids"]
            yield from _sent(v["part"], ids, np.zeros((0, len(ids))), groups)

        def answered(asked: pa.Table, held: pa.Table) -> pa.Table:
            known, coef = (np.concatenate([_numbers(v, t) for v in held[c]] or [np.zeros(0, t)]) for c, t in (("ids", np.int32), ("coef", np.float64)))
            answers = []
            for v in asked["ids"]:
                ids = _features(v)
                place = np.searchsorted(known, ids)
                found = np.append(known, -1)[place] == ids
                answers.append(np.where(found, np.append(coef, 0.0)[place], 0.0).tobytes())
            return pa.table({"part": asked["part"], "grp": asked["grp"], "sums": pa.array(answers, pa.binary())})

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v in _values(batch):
                    c = _unpack(v["cells"])
                    coef = _spread(v["totals"], c["ids"], groups)[0]
                    m = start + np.bincount(_row_of(c), weights=c["x"] * coef[c["place"]], minlength=len(c["ends"]) - 1)
                    yield pa.RecordBatch.from_arrays([*v["rows"].values.flatten(), pa.array(m)], names=[*kept, "_margin"])
        requests = _each(parts.select("part", "cells"), _SENT, asked)
        answers = _grouped(requests, groups).cogroup(self.coefficients.groupBy("grp")).applyInArrow(answered, "part bigint, grp int, sums binary")
        schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("_margin", T.DoubleType())])
        done = materialize(_by_part(parts.select("part", "cells", "rows"), _back(answers, pieces)).mapInArrow(scored, schema), "scored")
        parts.unpersist()
        m = F.col("_margin")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        return done.select(*[F.col(f"`{c}`") for c in kept], array_to_vector(F.array(-m, m)).alias(self.getRawPredictionCol()),
                           array_to_vector(F.array(1.0 - p, p)).alias(self.getProbabilityCol()), (p > 0.5).cast("double").alias(self.getPredictionCol()))


def _inverse(s1: np.ndarray, s2: np.ndarray, n: float) -> np.ndarray:
    """The inverse variance of features from their sums and sums of squares; 0 for a constant one, which takes no part."""
    spread = n * s2 - s1 * s1
    return np.divide(n * (n - 1), spread, out=np.zeros_like(spread), where=spread > 0)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two ends of a step, away from both."""
    (a, fa, da, _), (b, fb, db, _) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = math.sqrt(max(d1 * d1 - da * db, 0.0))
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a))
