"""Line dedup by content-defined chunks of lines, in built-in functions only.

A text's lines are hashed, and a hash rolling over each pair of neighbouring line hashes ends a chunk
where it falls on one value in `DIVISOR`. The ends depend on two lines only, so a line put in or taken
out moves at most the chunks around it. Chunks with two or more lines that are not blank are counted
over the whole corpus by hash; of those that repeat, the bytes of all texts of a hash are compared and every
occurrence but the first (smallest key, then position) is removed.

The counts travel as hashes and are summed before the shuffle. The texts move twice: to the repeated hashes,
and to the list of what each document loses. They are compared by the least and greatest text of a hash, so only
a hash that stands for several texts needs its texts a third time. Joins are merges at any size.
A chunk that a third of all documents share is one row per task after partial aggregation, and the join
that marks its occurrences deals it over `SALTS` parts per repeated chunk.

That is `dedup_lines`, the form with an SQL twin. It leaves what lies in no whole countable chunk:
single-line chunks and the ends of a passage. `dedup_runs` removes repeated runs of lines whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import WORD, fresh
from mlframe.session import materialize

DIVISOR = 3
SALTS = 16


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with `value` computed once per row, however often lambdas below refer to it.

    Projections in a row are merged, which would put the whole expression into each lambda.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _laid(df: DataFrame, text: str) -> DataFrame:
    """`df` with ld_lines and ld_spans, array<struct<lo, hi>>: the lines (lo, hi] of each chunk."""
    df = _once(df, "ld_lines", F.split(F.col(text), "\n", -1))
    hashes, size = F.transform("ld_lines", F.md5), F.size("ld_lines")
    before = F.concat(F.array(F.lit("")), F.slice(hashes, F.lit(1), size - 1))
    rolled = F.zip_with(before, hashes, lambda a, b: F.conv(F.substring(F.md5(F.concat(a, b)), 1, 7), 16, 10).cast("int"))
    marked = F.filter(F.transform(rolled, lambda x, i: F.when(x % DIVISOR == 0, i + 1)), lambda i: i.isNotNull())
    df = _once(df, "ld_ends", F.array_union(marked, F.array(size)))
    starts = F.concat(F.array(F.lit(0)), F.slice("ld_ends", F.lit(1), F.size("ld_ends") - 1))
    return _once(df, "ld_spans", F.zip_with(starts, F.col("ld_ends"), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))))


def _digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _part(span: Column) -> Column:
    return F.slice("ld_lines", span["lo"] + 1, span["hi"] - span["lo"])


def _chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chunk with at least two lines that are not blank: ld_id, ld_text, no, chunk, hash."""
    df = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("ld_id"), F.xxhash64(text).alias("ld_text"), F.col(text).alias("text"))
    parts = F.transform("ld_spans", lambda s: F.struct(
        (F.size(F.filter(_part(s), lambda x: x.rlike(WORD))) > 1).alias("whole"), F.array_join(_part(s), "\n").alias("chunk")))
    df = _laid(df, "text").select("ld_id", "ld_text", F.posexplode(parts).alias("no", "part")).filter("part.whole")
    return df.select("ld_id", "ld_text", "no", F.col("part.chunk").alias("chunk"), _digest(F.col("part.chunk")).alias("hash"))


def removed_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ld_id, ld_text, nos): the numbers of the chunks to remove, per document that loses any."""
    chunks = _chunks(docs, key, text)
    often = chunks.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    often = materialize(often, "ld-often")
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("ld_id", "no"), F.lit(SALTS)).cast("int")
    hits = materialize(chunks.withColumn("salt", salt).join(salted.hint("merge"), ["hash", "salt"], "left_semi"), "ld-hits")
    # equal bytes, not equal hashes; order by key (null first), text, place
    place = F.struct(F.col("ld_id").isNotNull().alias("has"), F.col("ld_id"), F.col("ld_text"), F.col("no"))
    byte = F.min("chunk") == F.max("chunk")
    first = materialize(hits.groupBy("hash").agg(F.min(place).alias("first"), byte.alias("equal")), "ld-first")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    slim = hits.select("hash", "salt", place.alias("place"))
    gone = slim.join(first.filter("equal").select("hash", "first", salts.alias("salt")).hint("merge"), ["hash", "salt"])
    gone = gone.filter("place <> first").select("place")
    mixed = first.filter("NOT equal").select("hash")
    if not mixed.isEmpty():  # one hash for several texts: those are told apart by the texts themselves
        odd = hits.join(mixed, "hash", "left_semi")
        each = odd.groupBy("hash", "chunk").agg(F.min(place).alias("first")).withColumn("salt", salts)
        gone = gone.unionByName(odd.withColumn("place", place).join(each, ["hash", "chunk", "salt"]).filter("place <> first").select("place"))
    return gone.groupBy("place.ld_id", "place.ld_text").agg(F.collect_set("place.no").alias("nos"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated chunks taken out of `text`, plus `n_lines` and `n_removed` (long).

    Null text stays null with 0 lines; empty text is one blank line. Rows equal in key and text are one
    document and keep the same lines. A document may end up empty; no row is dropped.
    """
    gone = materialize(removed_chunks(docs, key, text), "ld-gone")
    # numbered names keep the input's columns apart from working ones
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cut = docs.toDF(*at.values()).withColumns({"id": F.col(at[key]), "text": F.col(at[text]), "hash": F.xxhash64(at[text])})
    cut = cut.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("ld_id")) & (F.col("hash") == F.col("ld_text")), "left")
    hit = F.col("nos").isNotNull()
    cut = _laid(cut, "text")
    left = F.array_except(F.sequence(F.lit(0), F.size("ld_spans") - 1), F.col("nos"))
    cut = _once(cut, "ld_left", F.when(hit, F.flatten(F.transform(left, lambda k: _part(F.get(F.col("ld_spans"), k))))))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("ld_lines")).cast("long")
    gone_lines = F.when(hit, F.size("ld_lines") - F.size("ld_left")).otherwise(0).cast("long")
    body = F.when(hit, F.array_join("ld_left", "\n")).otherwise(F.col("text"))
    cols = [(body if c == text else F.col(name)).alias(c) for c, name in at.items()]
    return cut.select(*cols, total.alias(fresh(docs, "n_lines")), gone_lines.alias(fresh(docs, "n_removed")))


def _paired(df: DataFrame, text: str) -> DataFrame:
    """`df` with ld_lines and ld_pairs, array<struct<lo, hi>>: neighbouring lines that are not blank, counted from 1."""
    df = _once(df, "ld_lines", F.split(F.col(text), "\n", -1))
    df = _once(df, "ld_full", F.filter(F.transform("ld_lines", lambda x, i: F.when(x.rlike(WORD), i + 1)), lambda i: i.isNotNull()))
    size = F.greatest(F.size("ld_full") - 1, F.lit(0))
    ends = F.slice("ld_full", F.lit(1), size), F.slice("ld_full", F.lit(2), size)
    return _once(df, "ld_pairs", F.zip_with(*ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))))


def _lines(pair: Column) -> Column:
    return F.slice("ld_lines", pair["lo"], pair["hi"] - pair["lo"] + 1)


def removed_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ld_id, ld_text, lines): the numbers of the lines to remove, per document that loses any. See `dedup_runs`.

    Pairs travel as SHA-256 digests of their bytes, one row of about 60 bytes per pair, so no text is shuffled here.
    """
    df = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("ld_id"), F.xxhash64(text).alias("ld_text"), F.col(text).alias("text"))
    pairs = F.transform("ld_pairs", lambda p: F.struct(F.unhex(F.sha2(F.array_join(_lines(p), "\n"), 256)).alias("digest"), p.alias("at")))
    slim = _paired(df, "text").select("ld_id", "ld_text", F.posexplode(pairs).alias("no", "pair"))
    slim = materialize(slim.select("ld_id", "ld_text", "no", "pair.digest", "pair.at"), "ld-pairs")
    place = F.struct(F.col("ld_id").isNotNull().alias("has"), F.col("ld_id"), F.col("ld_text"), F.col("no"))
    # counted before the first places are sought: most pairs stand once
    often = materialize(slim.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "ld-often")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("ld_id", "no"), F.lit(SALTS)).cast("int")
    hits = slim.withColumn("salt", salt).join(often.withColumn("salt", salts).hint("merge"), ["digest", "salt"], "left_semi")
    hits = materialize(hits, "ld-hits")
    first = materialize(hits.groupBy("digest").agg(F.min(place).alias("first")), "ld-first")
    gone = hits.withColumn("place", place).join(first.withColumn("salt", salts).hint("merge"), ["digest", "salt"])
    same = F.col("ld_id").eqNullSafe(F.col("first.ld_id")) & (F.col("ld_text") == F.col("first.ld_text"))
    # the pair next to the first one shares a line with it: "a a a" holds "a a" once
    gone = gone.filter((F.col("place") != F.col("first")) & ~(same & (F.col("no") == F.col("first.no") + 1)))
    return gone.groupBy("ld_id", "ld_text").agg(F.collect_set("at").alias("pairs")).select(
        "ld_id", "ld_text", F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.sequence(p["lo"], p["hi"])))).alias("lines"))


def dedup_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the repeated runs of lines in `text`, plus `n_lines` and `n_removed` (long).

    A line goes if it lies in a run of two or more lines that are not blank, with the blank lines between
    them, whose bytes (compared by SHA-256) also stand earlier (smaller key, null first, then text hash, then
    place), not overlapping. So every repeated run goes to its true ends, and the first occurrence of a line stays.
    Any such run is made of pairs of neighbouring lines that stand earlier, so pairs are all that is looked
    up. Null, empty and equal rows are treated as in `dedup_lines`.
    """
    gone = materialize(removed_pairs(docs, key, text), "ld-gone")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cut = docs.toDF(*at.values()).withColumns({"id": F.col(at[key]), "text": F.col(at[text]), "hash": F.xxhash64(at[text])})
    cut = cut.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("ld_id")) & (F.col("hash") == F.col("ld_text")), "left")
    cut = _once(cut, "ld_lines", F.split("text", "\n", -1))
    hit = F.col("lines").isNotNull()
    left = F.array_except(F.sequence(F.lit(1), F.size("ld_lines")), F.col("lines"))
    cut = _once(cut, "ld_left", F.when(hit, F.transform(left, lambda k: F.get(F.col("ld_lines"), k - 1))))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("ld_lines")).cast("long")
    gone_lines = F.when(hit, F.size("lines")).otherwise(0).cast("long")
    body = F.when(hit, F.array_join("ld_left", "\n")).otherwise(F.col("text"))
    cols = [(body if c == text else F.col(name)).alias(c) for c, name in at.items()]
    return cut.select(*cols, total.alias(fresh(docs, "n_lines")), gone_lines.alias(fresh(docs, "n_removed")))
