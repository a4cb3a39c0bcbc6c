"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks of about equal size by a hash of key and text, so the block
number is a random permutation of the source. A source contributes its blocks whole, in that order,
up to its target: every block in each full pass, a prefix in the last one, and behind it every document
that still fits, in order, to the end of the source. The blocks a source gives are its exact quota. A binary tree over the
output shards then splits the vector of quotas: at each node the left half's share is one multivariate
hypergeometric draw, so shards are random, disjoint and sum to the quotas. Inside a shard the
documents are put in hash order.

The driver holds one row per source and at most `max_blocks` block totals plus one per source; the
number of blocks stops growing there and blocks grow instead. Documents never pass through it.
Rows equal in key and text move together, so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlframe.llm.common import fresh, word_count
from mlframe.session import materialize

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[float, ...] = (5, 2, 1)  # in turn, over the sources by code point, null last
    share: float = 1.5  # words of the mix over words of the input
    cap: float = 2.0  # a source gives at most so many times its words
    block_words: int = 4096
    max_blocks: int = 1 << 20
    shard_words: int = 1 << 20
    max_shards: int = 4096
    seed: int = 11


def targets(sizes: list[int], spec: MixSpec = MixSpec()) -> list[float]:
    """Words to take from each source: shares by weight, the excess over the cap dealt out again."""
    weight = [spec.weights[i % len(spec.weights)] for i in range(len(sizes))]
    left, target, open_ = spec.share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > spec.cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = spec.cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def split_quotas(quota: np.ndarray, shards: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sources, blocks of each) per shard: the leaves of the splitting tree over `quota`."""
    leaves: list = [None] * shards
    stack = [(0, shards, np.flatnonzero(quota), quota[quota > 0].astype(np.int64))]
    while stack:
        lo, hi, ids, have = stack.pop()
        if hi - lo == 1:
            leaves[lo] = (ids, have)
            continue
        mid = (lo + hi) // 2
        n = int(have.sum())
        left = n * (mid - lo) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals") if n else have
        for a, b, part in ((lo, mid, drawn), (mid, hi, have - drawn)):
            stack.append((a, b, ids[part > 0], part[part > 0]))
    return leaves


@dataclass(frozen=True)
class Names:
    size: str
    hash: str
    no: str
    block: str
    draws: str


def _measured(docs: DataFrame, key: str, text: str, size: str | None, spec: MixSpec) -> tuple[DataFrame, Names]:
    n = Names(*(fresh(docs, f"mix_{x}") for x in ("size", "hash", "no", "block", "draws")))
    words = F.col(size).cast("long") if size else word_count(text)
    return docs.withColumns({n.size: words, n.hash: F.xxhash64(F.lit(spec.seed), F.col(key), F.col(text))}), n


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            size: str | None = None, spec: MixSpec = MixSpec()) -> tuple[DataFrame, pd.DataFrame, Names]:
    """(`docs` with their size and draws, the sources with size and target, names of the added columns).

    What a source gives falls short of its target by less than the smallest document it could still give.
    A draw is (pass, shard); a document is in the mix once per draw. Null or empty text has size 0 and
    follows its block; a null source is a source of its own; an empty table gives an empty plan.
    `size` names a column to use in place of the word count.
    """
    spark = docs.sparkSession
    full, n = _measured(docs, key, text, size, spec)
    slim = materialize(full.select(F.col(source).alias("source"), F.col(n.size).alias("size"), F.col(n.hash).alias("h")), "mix")

    rows = slim.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    cat = pd.DataFrame({"source": pd.Series([r.source for r in rows], dtype=object), "source_size": [r.size for r in rows]})
    cat["target"] = targets(cat["source_size"].tolist(), spec)
    width = max(spec.block_words, math.ceil(cat["source_size"].sum() / spec.max_blocks))
    cat["blocks"] = [max(1, math.ceil(s / width)) for s in cat["source_size"]]
    cat["no"] = np.arange(len(cat))

    sources = spark.createDataFrame(
        [(s, int(i), int(b)) for s, i, b in zip(cat["source"], cat["no"], cat["blocks"])], "s_source string, s_no int, s_blocks long")

    def placed(df: DataFrame, src: str, h: str, no: str, block: str) -> DataFrame:
        name, number, count = (fresh(df, c) for c in sources.columns)  # the input may have columns of these names
        joined = df.join(F.broadcast(sources.toDF(name, number, count)), F.col(src).eqNullSafe(F.col(name)), "left")
        return joined.withColumns({no: F.col(number), block: F.pmod(F.col(h), F.col(count))}).drop(name, number, count)

    blocks = placed(slim, "source", "h", "no", "block")
    got = blocks.groupBy("no", "block").agg(F.sum("size").alias("size")).toPandas().sort_values(["no", "block"])
    first = np.concatenate([[0], np.cumsum(cat["blocks"])]).astype(np.int64)
    words = np.zeros(first[-1], np.int64)
    if len(got):
        words[first[got["no"].to_numpy(np.int64)] + got["block"].to_numpy(np.int64)] = got["size"]

    # passes of each source: all blocks, or a prefix that ends inside the edge block
    full_pass, edge, rest = {}, {}, {}
    for i, (size_, target) in enumerate(zip(cat["source_size"], cat["target"])):
        full_pass[i] = int(target // size_) if size_ else 1
        rest[i] = target - full_pass[i] * size_ if size_ else 0.0
        sums = np.cumsum(words[first[i]:first[i + 1]])
        edge[i] = int(np.searchsorted(sums, rest[i], side="right")) if rest[i] > 0 else 0
    at = [(i, e, float(rest[i] - words[first[i]:first[i] + e].sum())) for i, e in edge.items() if rest[i] > 0 and e < cat["blocks"][i]]
    partial = _edge_parts(blocks, at)

    rng = np.random.default_rng(spec.seed)
    given, quota = [], np.zeros(len(cat), np.int64)
    for i in range(len(cat)):
        b, more = int(cat["blocks"][i]), np.array(partial.get(i, []), np.int64).reshape(-1, 4)
        number = np.concatenate([np.tile(np.arange(b), full_pass[i]), np.arange(edge[i]), more[:, 0]])
        turn = np.concatenate([np.repeat(np.arange(full_pass[i]), b), np.full(edge[i] + len(more), full_pass[i])])
        whole = len(number) - len(more)
        low = np.concatenate([np.full(whole, LOWEST), more[:, 1]])
        high = np.concatenate([np.full(whole, HIGHEST), more[:, 2]])
        most = np.concatenate([np.full(whole, HIGHEST), more[:, 3]])
        order = rng.permutation(len(number))
        given.append((number[order], turn[order], low[order], high[order], most[order]))
        quota[i] = len(number)
    shards = int(min(spec.max_shards, max(1, math.ceil(cat["target"].sum() / spec.shard_words)), max(1, quota.sum())))
    used, table = np.zeros(len(cat), np.int64), []
    for shard, (ids, counts) in enumerate(split_quotas(quota, shards, rng)):
        for i, c in zip(ids.tolist(), counts.tolist()):
            number, turn, low, high, most = (x[used[i]:used[i] + c] for x in given[i])
            table.append(pd.DataFrame({"b_no": i, "b_block": number, "b_pass": turn, "b_shard": shard, "b_low": low, "b_high": high, "b_most": most}))
            used[i] += c
    schema = "b_no int, b_block long, b_pass int, b_shard int, b_low long, b_high long, b_most long"
    table = spark.createDataFrame(pd.concat(table), schema) if table else spark.createDataFrame([], schema)
    table = table.groupBy("b_no", "b_block").agg(F.sort_array(F.collect_list(F.struct("b_pass", "b_shard", "b_low", "b_high", "b_most"))).alias("b_draws"))

    out = placed(full, source, n.hash, n.no, n.block)
    at = [fresh(out, c) for c in table.columns]
    out = out.join(F.broadcast(table.toDF(*at)), (F.col(n.no) == F.col(at[0])) & (F.col(n.block) == F.col(at[1])), "left")
    kept = F.filter(at[2], lambda d: F.col(n.hash).between(d["b_low"], d["b_high"]) & (F.coalesce(n.size, F.lit(0)) <= d["b_most"]))
    draws = F.transform(kept, lambda d: F.struct(d["b_pass"].alias("pass"), d["b_shard"].alias("shard")))
    out = out.withColumn(n.draws, F.coalesce(draws, F.array().cast("array<struct<pass:int,shard:int>>")))
    cat.attrs["shards"] = shards
    return out.drop(*at), cat, n


def _edge_parts(blocks: DataFrame, at: list[tuple[int, int, float]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """(block, lowest hash, highest hash, largest size) of what each source gives beyond its whole blocks.

    The order goes on from the edge block, over documents that fit the gap alone: whole blocks of them, then of the
    block that is too much the longest prefix. The document behind that is passed over, and the rest of the
    order is gone through again with the smaller gap, until nothing in it fits.
    """
    spark, out = blocks.sparkSession, {}
    open_ = {i: (e, LOWEST, words) for i, e, words in at}
    sized = blocks.filter("size > 0")
    while open_:
        rows = [(i, e, h, math.floor(gap)) for i, (e, h, gap) in open_.items()]
        state = F.broadcast(spark.createDataFrame(rows, "e_no int, e_block long, e_h long, e_most long"))
        behind = (F.col("block") > F.col("e_block")) | ((F.col("block") == F.col("e_block")) & (F.col("h") >= F.col("e_h")))
        fit = sized.join(state, F.col("no") == F.col("e_no")).filter(behind & (F.col("size") <= F.col("e_most")))
        got = fit.groupBy("no", "block").agg(F.sum("size").alias("size")).toPandas().sort_values(["no", "block"])
        cuts = []
        for i, of in got.groupby("no"):
            e, h, gap = open_[i]
            number, sums = of["block"].to_numpy(np.int64), np.cumsum(of["size"].to_numpy(np.int64))
            whole = int(np.searchsorted(sums, gap, side="right"))
            out.setdefault(i, []).extend((int(b), h if b == e else LOWEST, HIGHEST, math.floor(gap)) for b in number[:whole])
            if whole < len(number):
                cuts.append((int(i), int(number[whole]), float(gap - (sums[whole - 1] if whole else 0))))
        before, open_ = open_, {}
        if not cuts:
            break
        cut = F.broadcast(spark.createDataFrame(cuts, "c_no int, c_block long, c_gap double"))
        edge = fit.join(cut, (F.col("no") == F.col("c_no")) & (F.col("block") == F.col("c_block")))
        edge = edge.groupBy("no", "h", "c_gap").agg(F.sum("size").alias("size"))
        order = Window.partitionBy("no").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("upto", F.sum("size").over(order)).withColumn("fits", F.col("upto") <= F.col("c_gap"))
        ends = edge.groupBy("no").agg(F.max(F.when(F.col("fits"), F.col("upto"))).alias("words"), F.min(F.when(~F.col("fits"), F.col("h"))).alias("h"))
        ends = {r.no: (r.words, r.h) for r in ends.collect()}
        for i, b, gap in cuts:
            (e, h, first), (words, stop) = before[i], ends[i]
            if words:
                out.setdefault(i, []).append((b, h if b == e else LOWEST, stop - 1, math.floor(first)))
            open_[i] = (b, stop + 1, gap - (words or 0)) if stop < HIGHEST else (b + 1, LOWEST, gap - (words or 0))
    return out


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix: the columns of `docs` once per draw, with `mix_pass` and `mix_shard`, shuffled inside each shard."""
    plan, cat, n = planned(docs, key, text, source, spec=spec)
    turn, shard, one = fresh(docs, "mix_pass"), fresh(docs, "mix_shard"), fresh(plan, "mix_draw")
    out = plan.withColumn(one, F.explode(n.draws)).withColumns({turn: F.col(f"{one}.pass"), shard: F.col(f"{one}.shard")})
    order = F.xxhash64(F.lit(spec.seed + 1), F.col(n.hash), F.col(turn))
    out = out.repartition(cat.attrs["shards"], shard).sortWithinPartitions(F.col(shard), order)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], turn, shard)
