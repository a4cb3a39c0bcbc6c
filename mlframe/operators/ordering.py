"""Row numbers, running sums and cut points over whole tables.

Two orders are offered. *Hash order* (md5 of seed and key) is uniform by nature,
so it is numbered per hash prefix and needs no copy of the data. *Value order*
follows the given columns: the table is range-partitioned on them, written once,
and partition totals are added as offsets. Neither moves a table, or one hot
group of it, into a single task. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlframe.session import materialize

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def as_list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def md5_key(key, seed: int) -> Column:
    """md5 of `seed:key`, the same digest in any engine."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in as_list(key)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def md5_int(*parts: Column) -> Column:
    """First 60 bits of the md5 of the `:`-joined parts, as a bigint in 0..2^60-1."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _prefix_digits(spark: SparkSession) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(5, math.ceil(math.log(4 * parts, 16))))


def _exclusive_sum(value: Column, partition_by: Sequence[str], order: str) -> Column:
    w = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))
    w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def hash_index(df: DataFrame, key, seed: int, out: str = "row_index",
               partition_by: Sequence[str] = ()) -> DataFrame:
    """Number rows 1..n in md5 order, per `partition_by` group if given."""
    part = as_list(partition_by)
    digits = _prefix_digits(df.sparkSession)
    keyed = df.withColumn("_h", md5_key(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = keyed.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *[F.col(p).alias(f"_o_{p}") for p in part], F.col("_b").alias("_ob"),
        _exclusive_sum(F.col("_n"), part, "_b").alias("_off"))
    cond = F.col("_b") == F.col("_ob")
    for p in part:
        cond = cond & F.col(p).eqNullSafe(F.col(f"_o_{p}"))
    local = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h")))
    return local.join(offsets, cond).select(
        *[F.col(c) for c in df.columns], (F.col("_off") + F.col("_rn")).cast("long").alias(out))


def label_cuts(df: DataFrame, key, seed: int, label: str, ranks: Callable[[Column], Sequence[Column]], digits: int = 4) -> DataFrame:
    """(_c, _n, _cuts): per value of `label`, its rows and the md5 digests that stand at some ranks of its hash order.

    `ranks(n)` gives ascending 1-based ranks for a label of n rows; rank 0 gives the empty digest. Label and key
    alone are read: rows are counted per label and digest prefix, and only the prefixes that hold a wanted
    rank are put in order. Labels may be any number; a label of a third of all rows lies in 16^digits parts.
    Nothing comes to the driver.
    """
    keyed = df.select(F.col(label).alias("_c"), md5_key(key, seed).alias("_h")).withColumn("_b", F.substring("_h", 1, digits))
    sizes = keyed.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_m"))
    whole = F.sum("_m").over(Window.partitionBy("_c"))
    sizes = materialize(sizes.select("_c", "_b", "_m", whole.alias("_n"), _exclusive_sum(F.col("_m"), ["_c"], "_b").alias("_off")), "cut-sizes")
    steps = F.array(*[r.cast("long") for r in ranks(F.col("_n"))])
    inside = F.filter(steps, lambda r: (r > F.col("_off")) & (r <= F.col("_off") + F.col("_m")))
    held = materialize(sizes.select(F.col("_c").alias("_wc"), F.col("_b").alias("_wb"), "_off", inside.alias("_want")).filter(F.size("_want") > 0), "cut-parts")
    near = keyed.join(held, F.col("_c").eqNullSafe(F.col("_wc")) & (F.col("_b") == F.col("_wb")))
    place = F.col("_off") + F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h"))
    at = near.withColumn("_rank", place).filter(F.array_contains("_want", F.col("_rank")))
    found = at.groupBy(F.col("_c").alias("_fc")).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_h"))).alias("_at"))
    labels = sizes.select("_c", "_n").distinct().join(found, F.col("_c").eqNullSafe(F.col("_fc")), "left")
    cuts = F.transform(steps, lambda r: F.when(r == 0, F.lit("")).otherwise(F.try_element_at("_at", r)))
    return materialize(labels.select("_c", "_n", cuts.alias("_cuts")), "cuts")


def hash_cuts(df: DataFrame, key, seed: int, ranks: Callable[[dict], Mapping], leaf: int = 5000):
    """The md5 digests standing at given ranks of the hash order.

    `ranks(sizes)` gets {0: row count} and returns {0: [rank, ...]} (1-based).
    Returns (sizes, {0: {rank: digest}}). Each pass reads the key only and
    brings back at most 4096 prefix counts per open target, the last one `leaf` digests each or 100,000 in all, so a
    split needs no shuffle of the table: the caller filters on the digest. Two passes find one cut of 400 million rows.
    """
    keyed = df.select(md5_key(key, seed).alias("_h"))
    width, scope, sizes, targets = 3, keyed, {}, None
    while True:
        rows = scope.groupBy(F.substring("_h", 1, width).alias("_p")).count().collect()
        buckets = sorted((r["_p"], r["count"]) for r in rows)
        if targets is None:
            sizes = {0: sum(n for _, n in buckets)} if buckets else {}
            targets = [(c, rank, rank, "") for c, rs in ranks(sizes).items() for rank in rs]
        wanted, narrowed = {}, []
        for c, rank, rest, prefix in targets:
            for p, n in (b for b in buckets if b[0].startswith(prefix)):
                if rest <= n:
                    narrowed.append((c, rank, rest, p))
                    wanted[p] = n
                    break
                rest -= n
            else:
                raise ValueError(f"rank {rank} is beyond the {sizes[c]} rows of {c!r}")
        targets = narrowed
        scope = keyed.filter(F.substring("_h", 1, width).isin(sorted(wanted)))
        if sum(wanted.values()) <= max(100_000, leaf * len(wanted)) or width >= 30:
            break
        width += 3
    cuts: dict = {c: {} for c in sizes}
    if targets:
        found: dict = {}
        for r in scope.collect():
            found.setdefault(r["_h"][:width], []).append(r["_h"])
        for c, rank, rest, p in targets:
            cuts[c][rank] = sorted(found[p])[rest - 1]
    return sizes, cuts


def range_layout(df: DataFrame, order_by, partition_by: Sequence[str] = ()) -> DataFrame:
    """A written copy of `df` in value order, with `_part` (its slice) and `_pos` (place in it)."""
    keys = [*as_list(partition_by), *as_list(order_by)]
    laid = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_mid", F.monotonically_increasing_id()))
    mid = F.col("_mid")
    return (materialize(laid, "ordered")
            .withColumn("_part", F.shiftright(mid, _POS_BITS))
            .withColumn("_pos", mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
            .drop("_mid"))


def _with_offsets(laid: DataFrame, totals: DataFrame, part: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Join to each slice (and group) what the slices before it add up to."""
    offsets = totals.select(
        F.col("_part").alias("_o_part"), *[F.col(p).alias(f"_o_{p}") for p in part],
        *[_exclusive_sum(F.col(s), part, "_part").alias(f"_off_{s}") for s in sums],
        *[c for c in totals.columns if c.startswith("_start")])
    cond = F.col("_part") == F.col("_o_part")
    for p in part:
        cond = cond & F.col(p).eqNullSafe(F.col(f"_o_{p}"))
    if not part:  # one row per slice: bounded by the number of partitions
        offsets = F.broadcast(offsets)
    return laid.join(offsets, cond)


def global_index(df: DataFrame, order_by, out: str = "row_index",
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Number rows 1..n in value order, per `partition_by` group if given."""
    part = as_list(partition_by)
    laid = range_layout(df, order_by, part)
    totals = laid.groupBy("_part", *part).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    joined = _with_offsets(laid, totals, part, ["_n"])
    index = F.col("_off__n") + F.col("_pos") - F.col("_start") + 1
    return joined.select(*[F.col(c) for c in df.columns], index.cast("long").alias(out))


def prefix_sum(df: DataFrame, sums: Mapping[str, Column], order_by,
               partition_by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums in value order, per `partition_by` group if given."""
    part = as_list(partition_by)
    staged = df.select("*", *[c.alias(f"_v_{o}") for o, c in sums.items()])
    laid = range_layout(staged, order_by, part)
    w = Window.partitionBy("_part", *part).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.groupBy("_part", *part).agg(*[F.sum(f"_v_{o}").alias(o) for o in sums])
    local = laid.select("*", *[F.sum(f"_v_{o}").over(w).alias(f"_run_{o}") for o in sums])
    joined = _with_offsets(local, totals, part, list(sums))
    return joined.select(*[F.col(c) for c in df.columns],
                         *[(F.col(f"_off_{o}") + F.col(f"_run_{o}")).alias(o) for o in sums])


def look_ahead_chunks(df: DataFrame, index: str, after: int, rows: int = 50_000) -> DataFrame:
    """Cut long ordered series into `_chunk`s that also hold the next `after` rows.

    `_own` marks a row in its home chunk. Windows over (series, _chunk) then see every
    row they need while one long series spreads over many tasks.
    """
    rows = max(rows, after + 1)
    home = F.floor((F.col(index) - 1) / rows).cast("long")
    place = (F.col(index) - 1) % rows
    chunks = F.when((home > 0) & (place < after), F.array(home, home - 1)).otherwise(F.array(home))
    return (df.withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == home))
