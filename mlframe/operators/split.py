"""Splits, folds, samples and batches.

Random choices order rows by md5 of (seed, key): the same rows are chosen whatever the
partitioning. Exact sizes come from cut points in that order, so tagging a table is a
filter on one expression and shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.operators.ordering import as_list, global_index, hash_cuts, hash_index, label_cuts, md5_key
from mlframe.operators.ranks import cut_after, rank_keys


def test_rows(n: int, test_size: float) -> int:
    """Rows of the test part: the fraction rounded up."""
    return math.ceil(round(test_size * n, 9))


def _cut_part(h: Column, sizes_in_order: Sequence[tuple[str | int, int]], cuts: Mapping[int, str]) -> Column:
    """Name of the stretch of the hash order that holds the row."""
    out, upto, last = None, 0, sizes_in_order[-1][0]
    for name, n in sizes_in_order[:-1]:
        upto += n
        if n > 0:
            cond = h <= F.lit(cuts[upto])
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(last) if out is None else out.otherwise(F.lit(last))


def _tag(df: DataFrame, key, seed: int, plan, out: str) -> DataFrame:
    """Tag rows by `plan(n)` = [(name, size), ...] along the hash order."""
    def ranks(sizes):
        want = {}
        for c, n in sizes.items():
            steps, upto = [], 0
            for _, m in plan(n)[:-1]:
                upto += m
                if m > 0:
                    steps.append(upto)
            want[c] = steps
        return want

    sizes, cuts = hash_cuts(df, key, seed, ranks)
    h = md5_key(key, seed)
    if not sizes:  # no rows
        return df.withColumn(out, F.lit(plan(0)[-1][0]))
    return df.withColumn(out, _cut_part(h, plan(sizes[0]), cuts[0]))


def _tag_within(df: DataFrame, key, seed: int, label: str, names: Sequence, upto, out: str) -> DataFrame:
    """Tag the rows of each label along its hash order: `upto(n)` holds the last ranks of all parts but the last.

    The cuts stand in a table with a row per label, joined by label: Spark broadcasts it while it is small.
    """
    cuts = label_cuts(df, key, seed, label, upto)
    h = md5_key(key, seed)
    place = F.size(F.filter("_cuts", lambda c: c < h))
    tagged = df.join(cuts, F.col(label).eqNullSafe(F.col("_c")), "left").withColumn(out, F.element_at(F.array(*map(F.lit, names)), place + 1))
    return tagged.drop("_c", "_n", "_cuts")


def tag_split(df: DataFrame, key, test_size: float = 0.25, seed: int = 0, label: str | None = None,
              out: str = "split") -> DataFrame:
    """Shuffled train / test tag with exact sizes, within each label if one is named."""
    def plan(n):
        t = test_rows(n, test_size)
        return [("train", n - t), ("test", t)]
    if label is None:
        return _tag(df, key, seed, plan, out)
    return _tag_within(df, key, seed, label, ["train", "test"], lambda n: [n - F.ceil(F.round(n * F.lit(float(test_size)), 9))], out)


def train_test_split(df: DataFrame, key, test_size: float = 0.25, seed: int = 0, shuffle: bool = True,
                     order_by=None) -> tuple[DataFrame, DataFrame]:
    """(train, test); without shuffling the test part is the tail of the row order."""
    if shuffle:
        tagged = tag_split(df, key, test_size, seed)
        return tuple(tagged.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    return head_tail_split(df, order_by or key, test_size=test_size)


def stratified_split(df: DataFrame, key, label: str, test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    tagged = tag_split(df, key, test_size, seed, label)
    return tuple(tagged.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def three_way_split(df: DataFrame, order_by, n1: int, n2: int, out: str = "split") -> DataFrame:
    """Rows tagged by position: first n1 `train`, next n2 `validation`, the rest `test`."""
    order, n, found = rank_keys(df, order_by, [n1, n1 + n2])

    def upto(rank):
        return F.lit(True) if rank >= n else order.upto(df, found.get(rank))
    return df.withColumn(out, F.when(upto(n1), "train").when(upto(n1 + n2), "validation").otherwise("test"))


def head_tail_split(df: DataFrame, order_by, test_size: float | None = None, n_head: int | None = None):
    """(head, tail) in the row order, at a row number or a fraction."""
    return cut_after(df, order_by, (lambda n: n - test_rows(n, test_size)) if n_head is None else n_head)


def validation_tail(df: DataFrame, order_by, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(fit rows, validation rows): the last fraction of the rows, the fit part rounded down."""
    return cut_after(df, order_by, lambda n: int(round(n * (1.0 - fraction), 9)))


def _fold_plan(k: int):
    def plan(n):
        return [(i, n // k + (1 if i < n % k else 0)) for i in range(k)]
    return plan


def kfold(df: DataFrame, key, k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 whose sizes differ by at most one."""
    return _tag(df, key, seed, _fold_plan(k), out)


def stratified_kfold(df: DataFrame, key, label: str, k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds 0..k-1, near equal within each label."""
    # the first n % k folds hold one row more
    return _tag_within(df, key, seed, label, list(range(k)),
                       lambda n: [F.floor(n / k) * i + F.least(F.lit(i), n % k) for i in range(1, k)], out)


def aligned_split(blocks: Sequence[DataFrame], key: str, test_size: float = 0.25, seed: int = 0):
    """The same rows of every block go to train or test; each block keeps its own columns.

    The digest depends on the key alone, so the cut found on the first block serves all
    blocks without a join.
    """
    n = {}

    def ranks(sizes):
        n.update(sizes)
        return {c: [m - test_rows(m, test_size)] for c, m in sizes.items()}

    _, cuts = hash_cuts(blocks[0], key, seed, ranks)
    cut = next(iter(cuts[0].values()))
    h = md5_key(key, seed)
    return [(b.filter(h <= cut), b.filter(h > cut)) for b in blocks]


def join_blocks(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Aligned blocks side by side, matched on the key."""
    return reduce(lambda a, b: a.join(b, key), blocks)


def assign_batches(df: DataFrame, size: int, order_by=None, key=None, seed: int | None = None,
                   out: str = "batch") -> DataFrame:
    """Batch number 0.. of fixed-size batches, the last one partial; shuffled if a seed is given."""
    if seed is None:
        indexed = global_index(df, order_by, "_row")
    else:
        indexed = hash_index(df, key, seed, "_row")
    return indexed.withColumn(out, F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")


def sample_k(df: DataFrame, key, k: int, seed: int = 0) -> DataFrame:
    """k distinct rows: the first k of the hash order."""
    def ranks(sizes):
        return {c: [min(k, n)] for c, n in sizes.items()}
    sizes, cuts = hash_cuts(df, key, seed, ranks)
    if not sizes:
        return df
    return df.filter(md5_key(key, seed) <= F.lit(next(iter(cuts[0].values()))))


def drop_tail(df: DataFrame, order_by, n: int) -> DataFrame:
    """All but the last n rows."""
    return cut_after(df, order_by, lambda total: total - n)[0]


__all__ = ["aligned_split", "as_list", "assign_batches", "drop_tail", "head_tail_split", "join_blocks", "kfold",
           "sample_k", "stratified_kfold", "stratified_split", "tag_split", "three_way_split", "train_test_split",
           "validation_tail"]
