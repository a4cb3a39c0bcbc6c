"""Word counts, vocabularies and id sequences over whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.functions.arrays import pad_sequence
from mlframe.operators.ordering import as_list, global_index
from mlframe.session import materialize

# Characters that separate words besides the space.
SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

HEAD_WORDS = 200_000  # the most frequent words, held by every worker
HEAD_CHARS = 64       # and only words up to this length, which bounds the broadcast in bytes


def _pieces(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.translate(F.lower(t), SEPARATORS, " " * len(SEPARATORS)), " ", -1)


def words(text: str | Column) -> Column:
    """array<string>: lower-cased, separators blanked, split on the space, empty parts dropped."""
    return F.array_remove(_pieces(text), "")


def tokens(df: DataFrame, text: str, key) -> DataFrame:
    """(key, pos, word) for each word; pos grows along the text (blank parts use up numbers)."""
    key = as_list(key)
    return df.select(*key, F.posexplode(_pieces(text)).alias("pos", "word")).filter(F.col("word") != "")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(_pieces(text)).alias("word")).filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def document_counts(df: DataFrame, text: str) -> DataFrame:
    """In how many texts each word occurs."""
    return (df.select(F.explode(F.array_distinct(words(text))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("docs")))


def build_vocab(df: DataFrame, text: str, order_by) -> DataFrame:
    """(word, cnt, idx): idx 1.. by falling count, ties by first occurrence in row order."""
    order_by = as_list(order_by)
    if len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, T.IntegralType):
        # key and position as one number, which is aggregated by hashing where a struct is sorted; a null key stands first
        start = F.coalesce(F.col(order_by[0]).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31)
        placed = tokens(df.select(start.cast("decimal(38,0)").alias("_start"), text), text, "_start")
        place = (F.col("_start") + F.col("pos")).cast("decimal(38,0)")
        seen = placed.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.min(place).alias("_f0"))
        return global_index(seen, [F.col("cnt").desc(), "_f0"], "idx").select("word", "cnt", "idx")
    first = F.min(F.struct(*order_by, "pos")).alias("first")
    seen = tokens(df, text, order_by).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), first)
    flat = seen.select("word", "cnt", *[F.col("first")[c].alias(f"_f{i}") for i, c in enumerate([*order_by, "pos"])])
    firsts = [f"_f{i}" for i in range(len(order_by) + 1)]
    return global_index(flat, [F.col("cnt").desc(), *firsts], "idx").select("word", "cnt", "idx")


def cap_vocab(vocab: DataFrame, num_words: int) -> DataFrame:
    """The words with idx below `num_words`."""
    return vocab.filter(F.col("idx") < num_words)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Size of an index-addressed table: largest index + 1."""
    return vocab.agg((F.max("idx") + 1).alias("vocab_size"))


def texts_to_sequences(df: DataFrame, text: str, key, vocab: DataFrame, out: str = "seq",
                       head: int = HEAD_WORDS) -> DataFrame:
    """(key, out): known word ids in text order; unknown words are dropped, a null text gives no ids.

    A text is translated in one pass where it lies: the index follows frequency, so the `head` most frequent
    short words (bounded in rows and bytes) stand in a sorted array on each worker. Only what is left over,
    words outside the head, is exploded and joined to the rest of the vocabulary, and only their texts are
    joined back; keys must be unique.
    """
    key = as_list(key)
    in_head = (F.col("idx") <= head) & (F.length("word") <= HEAD_CHARS)
    top = vocab.filter(in_head).select("word", F.col("idx").cast("long").alias("idx")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(top)
    cut = df.select(*key, words(text).alias("_w"))
    schema = T.StructType([*[cut.schema[k] for k in key], T.StructField("_ids", T.ArrayType(T.LongType())), T.StructField("_left", T.ArrayType(T.StringType()))])
    coded = cut.mapInArrow(_translate(shared), schema)
    idx = vocab.schema["idx"].dataType.simpleString()
    ids = F.coalesce("_ids", F.array().cast("array<bigint>"))
    rest = vocab.filter(~in_head).select("word", "idx")
    if rest.isEmpty():
        return coded.select(*key, F.array_compact(ids).cast(f"array<{idx}>").alias(out))
    coded = materialize(coded, "translated")
    # _left holds a word where _ids holds none
    rare = coded.select(*key, F.posexplode("_left").alias("pos", "word")).filter(F.col("word").isNotNull())
    found = rare.join(rest, "word").groupBy(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(key)]).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.col("idx").cast("long")))).alias("_found"))
    both = coded.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(key)]), "left")
    filled = F.when(F.col("_found").isNull(), ids).otherwise(F.transform(ids, lambda x, i: F.coalesce(x, F.try_element_at("_found", i))))
    return both.select(*key, F.array_compact(filled).cast(f"array<{idx}>").alias(out))


def _translate(shared):
    """Batches of (key..., words) to (key..., ids, words without an id), list by list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known, ids = table["word"].combine_chunks(), table["idx"].combine_chunks()
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, size = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
            place = pc.index_in(flat.cast(known.type), value_set=known)
            ends = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False))]).astype(np.int32)
            left = pc.if_else(pc.is_null(place), flat, pa.scalar(None, flat.type))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part) for part in (ids.take(place), left)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_ids", "_left"])
    return run


def pad_sequences(df: DataFrame, arr: str, maxlen: int, padding: str = "pre", truncating: str = "pre",
                  out: str | None = None) -> DataFrame:
    return df.withColumn(out or arr, pad_sequence(arr, maxlen, padding, truncating))


def drop_long(df: DataFrame, arr: str, maxlen: int) -> DataFrame:
    """Only sequences shorter than `maxlen`."""
    return df.filter(F.size(arr) < maxlen)


def cap_ids(df: DataFrame, arr: str, num_words: int, unknown: int | None = 2) -> DataFrame:
    """Ids at or above `num_words` become `unknown`, or are dropped if it is None."""
    if unknown is None:
        return df.withColumn(arr, F.filter(arr, lambda t: t < num_words))
    return df.withColumn(arr, F.transform(arr, lambda t: F.when(t < num_words, t).otherwise(F.lit(unknown))))


def token_stream(df: DataFrame, arr: str, key) -> DataFrame:
    """One row per id, (key, pos, idx): ordering by key and pos gives the single stream."""
    return df.select(*as_list(key), F.posexplode(arr).alias("pos", "idx"))


def bag_of_words(df: DataFrame, arr: str, keep: Sequence[str], size: int, out: str = "features") -> DataFrame:
    """Sparse word-count vectors of an id column, for the classifiers; an id is its own position, below `size`.

    Ids are counted a batch of rows at a time and the cells stored; they are read back as vectors, so nothing that
    grows with the vocabulary passes the driver.
    """
    none = F.array().cast("array<bigint>")
    ids = df.select(*keep, F.coalesce(F.col(arr).cast("array<bigint>"), none).alias("_ids"))
    kept = [ids.schema[k] for k in keep]
    cells = ids.mapInArrow(_count_ids(max(1, size), out), T.StructType([*kept, T.StructField(out, VectorUDT.sqlType())]))
    return materialize(cells, "vectors", T.StructType([*kept, T.StructField(out, VectorUDT())]))


def _count_ids(size: int, out: str):
    """Batches of (kept..., ids) to (kept..., cells of a sparse vector): sorted ids below `size` and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(batch.num_columns - 1), batch.num_rows
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            known = (ids >= 0) & (ids < size)
            cell, times = np.unique(rows[known] * size + ids[known], return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(n + 1) * size).astype(np.int32))
            made = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array((cell % size).astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(times.astype(np.float64)))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], out])
    return run
