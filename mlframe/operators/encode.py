"""Encoding and feature construction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.ordering import global_index
from mlframe.session import materialize

CLASS_LIMIT = 10_000  # class tables up to this many rows are broadcast,
CLASS_BYTES = 1024  # fitted on the driver if no class is longer than this,
BROADCAST_BYTES = 32 << 20  # and broadcast up to this many bytes of classes
HOT_SHARE = 1_000  # a value of more than one in so many rows is looked up by broadcast
SALTS = 1024  # parts over which rows without a look-up are dealt in a look-up join


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """month, day, hour, weekday (Monday = 0) and is_weekend in place of the timestamp."""
    weekday = F.weekday(ts)
    return df.select(
        *[c for c in df.columns if c != ts],
        F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"),
        weekday.alias("weekday"), weekday.isin(5, 6).cast("int").alias("is_weekend"))


def ratio_features(df: DataFrame, ratios: Mapping[str, tuple[str, str]] = {},
                   products: Mapping[str, tuple[str, str]] = {}, eps: float = 1e-5) -> DataFrame:
    """new = a / (b + eps) and new = a * b."""
    new = {n: F.col(a) / (F.col(b) + F.lit(eps)) for n, (a, b) in ratios.items()}
    new.update({n: F.col(a) * F.col(b) for n, (a, b) in products.items()})
    return df.withColumns(new)


def merge_text(df: DataFrame, cols: Sequence[str], sep: str = " ", lower: Sequence[str] = (),
               missing: str = "", out: str = "text") -> DataFrame:
    """Text columns joined with a separator, some lower-cased, missing ones replaced."""
    def part(c):
        filled = F.coalesce(F.col(c), F.lit(missing))
        return F.lower(filled) if c in lower else filled
    pieces = [part(c) for c in cols]
    joined = [x for p in pieces for x in (F.lit(sep), p)][1:]
    return df.withColumn(out, F.concat(*joined))


def fit_labels(df: DataFrame, col: str, limit: int = CLASS_LIMIT) -> DataFrame:
    """Class table (class, idx): values in ascending order, numbered from 0.

    Few short classes become a local table; more than `limit`, or longer ones, are numbered on the cluster.
    """
    values = df.select(F.col(col).alias("class")).filter(F.col("class").isNotNull()).distinct()
    short = F.when(_bytes("class") <= CLASS_BYTES, F.col("class"))
    head = [r[0] for r in values.select(short).limit(limit + 1).collect()]
    if len(head) <= limit and None not in head:
        schema = T.StructType([T.StructField("class", df.schema[col].dataType), T.StructField("idx", T.IntegerType())])
        return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(sorted(head))], schema)
    return global_index(values, "class", "_n").select("class", (F.col("_n") - 1).cast("int").alias("idx"))


def _bytes(col: str) -> Column:
    return F.octet_length(F.col(col).cast("string"))


def _classes_for(classes: DataFrame, limit: int) -> DataFrame:
    """The class table (value column first), broadcast if its rows and its bytes are within bounds."""
    value = classes.columns[0]
    n, size = classes.select(_bytes(value).alias("b")).limit(limit + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(classes) if n <= limit and (size or 0) <= BROADCAST_BYTES else classes


def label_encode(df: DataFrame, col: str, classes: DataFrame | None = None, fit_on: DataFrame | None = None,
                 out: str | None = None, limit: int = CLASS_LIMIT) -> DataFrame:
    """Class index of `col`, fitted on `fit_on` (default `df`); unseen values become null."""
    if classes is None:
        classes = fit_labels(df if fit_on is None else fit_on, col, limit)
    table = _classes_for(classes.select(F.col("class").alias("_class"), F.col("idx").alias("_idx")), limit)
    joined = df.join(table, F.col(col) == F.col("_class"), "left")
    name = out or col
    if name == col:
        return joined.select(*[F.col("_idx").alias(c) if c == col else F.col(c) for c in df.columns])
    return joined.select(*[F.col(c) for c in df.columns], F.col("_idx").alias(name))


def label_encode_union(train: DataFrame, test: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables encoded with the classes of their union."""
    classes = fit_labels(train.select(col).unionByName(test.select(col)), col)
    return label_encode(train, col, classes, out=out), label_encode(test, col, classes, out=out)


def label_decode(df: DataFrame, idx: str, classes: DataFrame, out: str, limit: int = CLASS_LIMIT) -> DataFrame:
    table = _classes_for(classes.select(F.col("class").alias(out), F.col("idx").alias("_idx")), limit)
    return df.join(table, F.col(idx) == F.col("_idx"), "left").select(*[F.col(c) for c in df.columns], out)


def name_scores(df: DataFrame, probs: str, class_names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A probability array spread over one column per class name."""
    return df.select(*keep, *[F.element_at(probs, i + 1).alias(c) for i, c in enumerate(class_names)])


def _values(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """(no, k0, k1, ..., n): every value of column `cols[no]` with its rows, in one aggregate; and the slot of each column.

    Columns of one type share a value slot, so values keep their type and order. Nulls are left out.
    """
    kinds = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols))
    slot = {c: f"k{kinds.index(df.schema[c].dataType.simpleString())}" for c in cols}
    entries = [F.struct(F.lit(no).alias("no"), *[(F.col(f"`{c}`") if slot[c] == f"k{i}" else F.lit(None).cast(t)).alias(f"k{i}")
                                                 for i, t in enumerate(kinds)]) for no, c in enumerate(cols)]
    slots = [f"k{i}" for i in range(len(kinds))]
    flat = df.select(F.inline(F.array(*entries))).filter(F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(1)) for k in slots]).isNotNull())
    return flat.groupBy("no", *slots).agg(F.count(F.lit(1)).alias("n")), slot


class Dictionaries:
    """Numbered values of several columns: `table` (no, k0, ..., n, idx), `slot` and `sizes` {column: (values, bytes, rows)}.

    The values come from one aggregate over the table and are numbered from 0 in ascending order per column,
    all columns at once, in slices of the value order; the numbered table is written once. Nothing but three
    figures per column comes to the driver.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str]):
        self.cols = list(cols)
        values, self.slot = _values(df, self.cols)
        slots = sorted(set(self.slot.values()), key=lambda k: int(k[1:]))
        indexed = global_index(values, slots, "idx", partition_by="no")
        self.table = materialize(indexed.withColumn("idx", (F.col("idx") - 1).cast("int")), "dictionary")
        size = F.coalesce(*[_bytes(k) for k in slots])
        got = self.table.groupBy("no").agg(F.count(F.lit(1)), F.sum(size), F.sum("n")).collect()
        self.sizes = {c: (0, 0, 0) for c in self.cols} | {self.cols[r[0]]: (r[1], r[2], r[3]) for r in got}

    def encode(self, df: DataFrame, out: Mapping[str, str]) -> DataFrame:
        """`df` with the index of each column of `out` under the name it gives; unseen values and nulls become null.

        The smallest dictionaries are broadcast while their bytes stay within BROADCAST_BYTES together. Of the
        others the values of many rows are (at most HOT_SHARE a column), and only the rest of the rows is
        looked up by a shuffle join; rows with nothing to look up are dealt evenly.
        """
        room, whole = BROADCAST_BYTES, set()
        for c in sorted(out, key=lambda c: self.sizes[c][1]):
            weight = self.sizes[c][1] + 16 * self.sizes[c][0]
            if weight <= room:
                room -= weight
                whole.add(c)
        names = list(df.columns)
        df = df.select("*", *[F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(out)])
        for i, c in enumerate(out):
            table = self.table.filter(F.col("no") == self.cols.index(c)).select(
                F.col(self.slot[c]).alias(f"_k{i}"), F.col("idx").alias(f"_i{i}"), F.col("n").alias(f"_n{i}"))
            v, k, x = F.col(f"_v{i}"), F.col(f"_k{i}"), F.col(f"_i{i}")
            if c in whole:
                df = df.join(F.broadcast(table.drop(f"_n{i}")), v == k, "left").drop(f"_k{i}")
                continue
            hot = (F.col(f"_n{i}") * HOT_SHARE > self.sizes[c][2]) & (_bytes(f"_k{i}") <= CLASS_BYTES)
            top = table.filter(hot).select(F.col(f"_k{i}").alias("_hk"), F.col(f"_i{i}").alias("_hi"))
            df = df.join(F.broadcast(top), v == F.col("_hk"), "left").drop("_hk")
            sought = v.isNotNull() & F.col("_hi").isNull()
            # a salt of its own for rows that seek nothing: null keys would all meet in one task
            df = df.withColumn("_salt", F.when(sought, F.lit(0)).otherwise(1 + F.monotonically_increasing_id() % SALTS))
            df = df.withColumn(f"_v{i}", F.when(sought, v))
            rest = table.filter(~hot).drop(f"_n{i}").withColumn("_ks", F.lit(0).cast("long"))
            df = df.join(rest, (v == k) & (F.col("_salt") == F.col("_ks")), "left")
            df = df.withColumn(f"_i{i}", F.coalesce("_hi", x)).drop("_hi", "_salt", "_ks", f"_k{i}")
        made = {name: F.col(f"_i{i}") for i, name in enumerate(out.values())}
        return df.select(*[made.pop(c, F.col(f"`{c}`")).alias(c) for c in names], *[x.alias(c) for c, x in made.items()])


def ordinal_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Several columns label-encoded at once, with one dictionary pass for all of them."""
    return Dictionaries(df if fit_on is None else fit_on, cols).encode(df, {c: c for c in cols})


def _flags(df: DataFrame, found: Mapping[str, Sequence], prefix: Mapping[str, str] = {}) -> DataFrame:
    flags = [F.coalesce((F.col(f"`{c}`") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix.get(c, c)}_{v}")
             for c, values in found.items() for v in values]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in found], *flags)


def _categories(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list]:
    """The sorted categories of each column, from one job; more than `limit` of a column are an error."""
    values, slot = _values(df, cols)
    keys = sorted(set(slot.values()))
    short = F.coalesce(*[_bytes(k) for k in keys]) <= CLASS_BYTES
    rows = values.select("no", short.alias("short"), *[F.when(short, F.col(k)).alias(k) for k in keys])
    found = {c: [] for c in cols}
    for r in rows.limit(limit * len(cols) + 1).collect():
        found[cols[r["no"]]].append(r[slot[cols[r["no"]]]])
    for c, got in found.items():
        if len(got) > limit or None in got:
            raise ValueError(f"{c} has more than {limit} categories, or very long ones; use one_hot_sparse")
    return {c: sorted(got) for c, got in found.items()}


def one_hot(df: DataFrame, col: str, prefix: str | None = None, categories: Sequence | None = None,
            limit: int = 2_000) -> DataFrame:
    """`col` replaced by one 0/1 column per category, named prefix_value; see `one_hot_sparse` for wide columns."""
    found = {col: categories} if categories is not None else _categories(df, [col], limit)
    return _flags(df, found, {col: prefix or col})


def one_hot_auto(df: DataFrame, skip: Sequence[str] = (), limit: int = 2_000) -> DataFrame:
    """Every string column one-hot encoded, no category dropped; the categories come from one job."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return _flags(df, _categories(df, strings, limit)) if strings else df


def one_hot_sparse(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, out: str = "hot",
                   vector: str | None = None) -> tuple[DataFrame, Dictionaries]:
    """`cols` replaced by the positions of their ones, `out` array<int>, for any number of categories.

    Position = categories of the columns before + index of the value; nulls and unseen values have none.
    With `vector`, a sparse vector of that name is added for the estimators. The second result holds the
    dictionaries, that is, which value each position stands for.
    """
    fitted = Dictionaries(df if fit_on is None else fit_on, cols)
    keep = [c for c in df.columns if c not in cols]
    coded = fitted.encode(df, {c: f"_hot{i}" for i, c in enumerate(cols)})
    sizes, ahead, at = [fitted.sizes[c][0] for c in cols], 0, []
    for i, n in enumerate(sizes):
        at.append(F.col(f"_hot{i}") + ahead)
        ahead += n
    coded = coded.select(*[F.col(f"`{c}`") for c in keep], *[f"_hot{i}" for i in range(len(cols))], F.array_compact(F.array(*at)).alias(out))
    if vector is not None:
        coded = _sparse_vector(coded, sizes, vector)
    return coded.drop(*[f"_hot{i}" for i in range(len(cols))]), fitted


def _sparse_vector(df: DataFrame, sizes: Sequence[int], out: str) -> DataFrame:
    """One sparse vector of the index columns _hot0, _hot1, ...; an index that is null has no one."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    used = [i for i, n in enumerate(sizes) if n > 0]
    filled = df.withColumns({f"_hf{i}": F.coalesce(F.col(f"_hot{i}"), F.lit(sizes[i])).cast("double") for i in used})
    # fitted on the known sizes: the index behind the last one means none, and its place is dropped
    top = df.sparkSession.range(1).select(*[F.lit(float(sizes[i] - 1)).alias(f"_hf{i}") for i in used])
    names = [f"_hv{i}" for i in used]
    encoder = OneHotEncoder(inputCols=[f"_hf{i}" for i in used], outputCols=names, handleInvalid="keep", dropLast=True).fit(top)
    joined = VectorAssembler(inputCols=names, outputCol=out).transform(encoder.transform(filled))
    return joined.drop(*names, *[f"_hf{i}" for i in used])


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, bias: bool = False,
               interaction_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """All products up to `degree`, by degree and then in column order (x1, x2, x1², x1x2, x2²...)."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = [F.lit(1.0).alias("bias")] if bias else []
    for d in range(1, degree + 1):
        for combo in pick(cols, d):
            product = reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in combo])
            terms.append(product.alias("*".join(combo)))
    return df.select(*keep, *terms)


def columns_to_rows(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays (one per feature) turned into one row per position."""
    zipped = F.posexplode(F.arrays_zip(*arrays))
    flat = df.select(*keep, zipped.alias("pos", "_row"))
    return flat.select(*keep, "pos", *[F.col("_row")[a].alias(a) for a in arrays])


def vstack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def softmax(df: DataFrame, col: str, partition_by, out: str = "softmax") -> DataFrame:
    """exp(x - max) / sum over each group.

    Group maxima and sums are aggregates joined back, so a very large group is not
    gathered in one task.
    """
    part = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    x = F.col(col).cast("double")
    tops = df.groupBy(*part).agg(F.max(x).alias("_top"))
    shifted = _join_back(df, tops, part).withColumn("_e", F.exp(x - F.col("_top")))
    sums = shifted.groupBy(*part).agg(F.sum("_e").alias("_sum"))
    both = _join_back(shifted, sums, part)
    return both.select(*[F.col(c) for c in df.columns], (F.col("_e") / F.col("_sum")).alias(out))


def _join_back(df: DataFrame, stats: DataFrame, part: Sequence[str]) -> DataFrame:
    renamed = stats.select(*[F.col(p).alias(f"_g_{p}") for p in part],
                           *[c for c in stats.columns if c not in part])
    cond = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_g_{p}")) for p in part])
    return df.join(renamed, cond).drop(*[f"_g_{p}" for p in part])
