"""Oversampling, SMOTE and augmentation.

Every draw is md5 of (seed, class, draw number): draws are generated on the cluster and
meet their rows through an index join, so nothing is looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.operators.encode import fit_labels
from mlframe.operators.neighbours import nearest
from mlframe.operators.ordering import hash_index, md5_int

MAX_CLASSES = 1000
_DRAWS = float(1 << 60)


def class_sizes(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    return dict(sorted((r[0], r[1]) for r in rows))


def wanted_extra(sizes: Mapping, targets: Mapping | str) -> dict:
    """Rows to add per class; 'auto' lifts every class to the largest. Shrinking is an error."""
    if targets == "auto":
        targets = dict.fromkeys(sizes, max(sizes.values()))
    for c, t in targets.items():
        if t < sizes.get(c, 0) or c not in sizes:
            raise ValueError(f"class {c!r} has {sizes.get(c, 0)} rows, cannot oversample to {t}")
    return {c: targets[c] - n for c, n in sizes.items() if c in targets and targets[c] > n}


def _by_class(label: Column, values: Mapping) -> Column:
    out = None
    for c, v in values.items():
        out = F.when(label == F.lit(c), F.lit(v)) if out is None else out.when(label == F.lit(c), F.lit(v))
    return out


def _draws(spark: SparkSession, extra: Mapping, sizes: Mapping, label: str, kind: str, seed: int) -> DataFrame:
    """(label, draw, _i): draw 1.. within the class and the 1-based row it picks."""
    ends, upto = [], 0
    for c, n in extra.items():
        ends.append((c, upto, upto + n))
        upto += n
    cls, start = None, None
    for c, lo, hi in ends:
        cond = F.col("id") < hi
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
        start = F.when(cond, F.lit(lo)) if start is None else start.when(cond, F.lit(lo))
    base = spark.range(upto).select(cls.cast(kind).alias(label), (F.col("id") - start + 1).alias("draw"))
    pick = md5_int(F.lit(seed), F.col(label), F.col("draw")) % _by_class(F.col(label), {c: sizes[c] for c in extra})
    return base.withColumn("_i", pick + 1)


def oversample(df: DataFrame, key: str, label: str, targets: Mapping | str = "auto", seed: int = 0) -> DataFrame:
    """All rows (draw 0) and rows drawn with replacement (draw 1..) up to each class's target."""
    sizes = class_sizes(df, label)
    extra = wanted_extra(sizes, targets)
    original = df.withColumn("draw", F.lit(0).cast("long"))
    if not extra:
        return original
    pool = hash_index(df.filter(F.col(label).isin(list(extra))), key, seed, "_i", [label])
    draws = _draws(df.sparkSession, extra, sizes, label, df.schema[label].dataType.simpleString(), seed)
    return original.unionByName(pool.join(draws, [label, "_i"]).select(*df.columns, "draw"))


def _synthetic(df: DataFrame, key: str, vec: str, label: str, k: int, targets, seed: int,
               space: str | None = None, carry: Sequence[str] = ()):
    """(draws with base row, neighbour table) shared by both SMOTE forms."""
    sizes = class_sizes(df, label)
    extra = wanted_extra(sizes, targets)
    lonely = [c for c in extra if sizes[c] < 2]
    if lonely:
        raise ValueError(f"classes {lonely} have a single row and no neighbour")
    if not extra:
        return None, None
    pool = df.filter(F.col(label).isin(list(extra)))
    indexed = hash_index(pool, key, seed, "_i", [label])
    draws = _draws(df.sparkSession, extra, sizes, label, df.schema[label].dataType.simpleString(), seed)
    ranks = _by_class(F.col(label), {c: min(k, sizes[c] - 1) for c in extra})
    draws = draws.withColumns({
        "rank": (md5_int(F.lit(seed), F.col(label), F.col("draw"), F.lit("n")) % ranks + 1).cast("int"),
        "_u": md5_int(F.lit(seed), F.col(label), F.col("draw"), F.lit("u")) / F.lit(_DRAWS)})
    drawn = indexed.join(draws, [label, "_i"]).drop("_i")
    bases = indexed.join(draws, [label, "_i"], "left_semi")
    near = nearest(pool, bases, key, space or vec, k, within=label, exclude_self=True, carry=carry)
    return drawn, near


def smote(df: DataFrame, key: str, vec: str, label: str, k: int = 5, targets: Mapping | str = "auto",
          seed: int = 0) -> DataFrame:
    """Rows (draw 0) and points between a drawn row and one of its k nearest rows of the class.

    (key, draw) identifies a row; a synthetic row carries its base row's key.
    """
    df = df.select(key, label, F.col(vec).cast("array<double>").alias(vec))
    original = df.withColumn("draw", F.lit(0).cast("long"))
    drawn, near = _synthetic(df, key, vec, label, k, targets, seed, carry=[vec])
    if drawn is None:
        return original
    other = near.select(key, "rank", F.col(vec).alias("_other"))
    made = drawn.join(other, [key, "rank"]).withColumn(
        vec, F.zip_with(vec, "_other", lambda a, b: a + F.col("_u") * (b - a)))
    return original.unionByName(made.select(*df.columns, "draw"))


def smote_nc(df: DataFrame, key: str, vec: str, label: str, categorical: Sequence[str], k: int = 5,
             targets: Mapping | str = "auto", seed: int = 0) -> DataFrame:
    """SMOTE with categorical columns: they take the most frequent value among the neighbours.

    For distances a category mismatch weighs as much as the median deviation of the
    numeric cells.
    """
    df = df.select(key, label, F.col(vec).cast("array<double>").alias(vec), *categorical)
    cells = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.stddev_samp("x").alias("s"))
    weight = cells.agg(F.median("s")).first()[0] / 2 ** 0.5  # one row per numeric feature
    flags = []
    for c in categorical:
        values = [r["class"] for r in fit_labels(df, c).orderBy("idx").collect()]
        flags.append(F.array(*[F.when(F.col(c) == F.lit(v), F.lit(weight)).otherwise(F.lit(0.0)) for v in values]))
    spaced = df.withColumn("_space", F.concat(F.col(vec), *flags))
    original = df.withColumn("draw", F.lit(0).cast("long"))
    drawn, near = _synthetic(spaced, key, vec, label, k, targets, seed, "_space", [vec, *categorical])
    if drawn is None:
        return original
    modes = near.groupBy(key).agg(*[F.mode(c, True).alias(f"_m_{c}") for c in categorical])
    other = near.select(key, "rank", F.col(vec).alias("_other"))
    made = drawn.join(other, [key, "rank"]).join(modes, key).withColumn(
        vec, F.zip_with(vec, "_other", lambda a, b: a + F.col("_u") * (b - a)))
    made = made.withColumns({c: F.col(f"_m_{c}") for c in categorical})
    return original.unionByName(made.select(*df.columns, "draw"))


def draw_with_replacement(df: DataFrame, key, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement, numbered by `draw`."""
    total = df.count()
    draws = df.sparkSession.range(1, n + 1).select(
        F.col("id").alias("draw"), (md5_int(F.lit(seed), F.col("id")) % F.lit(total) + 1).alias("_i"))
    return hash_index(df, key, seed, "_i").join(draws, "_i").drop("_i")


def bag_counts(df: DataFrame, key, bags: int, seed: int = 0, out: str = "drawn") -> DataFrame:
    """The rows that some bag draws, with how often each bag draws them (an array, `bags` long).

    A bag is as many draws with replacement as there are rows: exact multinomial counts. Draws are counted by place
    before they meet a row, places are given to keys alone, and the table itself moves once for all bags.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total = df.count()
    bag, draw = F.floor(F.col("id") / F.lit(max(1, total))).cast("int"), F.col("id") % F.lit(max(1, total)) + 1
    draws = df.sparkSession.range(total * bags).select(bag.alias("bag"), draw.alias("draw"))
    place = (md5_int(F.lit(seed) + F.col("bag") + 1, F.col("draw")) % F.lit(max(1, total)) + 1).alias("_i")
    times = F.array(*[F.count_if(F.col("bag") == b) for b in range(bags)]).alias(out)
    counts = draws.select("bag", place).groupBy("_i").agg(times)
    drawn = hash_index(df.select(*keys), keys, seed, "_i").join(counts, "_i").drop("_i")
    return df.join(drawn, keys).select(*df.columns, out)


def augment_with_replacement(df: DataFrame, key, n: int, seed: int = 0) -> DataFrame:
    """All rows (draw 0) and n rows drawn with replacement (draw 1..n)."""
    return df.withColumn("draw", F.lit(0).cast("long")).unionByName(draw_with_replacement(df, key, n, seed))


def replicate(df: DataFrame, n: int | Column, out: str = "copy") -> DataFrame:
    """Each row n times, `out` counting the copies from 1; n may be a column."""
    times = F.lit(n) if isinstance(n, int) else n
    return df.filter(times > 0).withColumn(out, F.explode(F.sequence(F.lit(1), times.cast("int"))))
