"""Connected components by repeated contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of `edges` (columns a, b): comp is the smallest id it is linked with.

    Each round hooks every node to its smallest neighbour, renames both ends of the links and drops
    loops and repeats. Stars vanish in one round and chains shrink by a constant factor. The rounds'
    tables are written to the shared folder, so the plan stays short and a lost executor costs little.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    names = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "cc-hook")
        if names is None:
            names = hook.select(F.col("a").alias("id"), F.col("to").alias("comp"))
        else:
            names = names.join(hook, names["comp"] == hook["a"], "left").select("id", F.coalesce("to", "comp").alias("comp"))
        names = materialize(names, "cc-names")
        left = edges.join(hook, "a").select(F.col("to").alias("x"), "b")
        right = left.join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        edges = materialize(right.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc-edges")
    return names if names is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
