"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
#: `bytes.split()` cuts at exactly these six, so tasks split encoded text with it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; null counts as no word."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with `stem` that `df` does not have (names clash without regard to case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, **cols: Column) -> DataFrame:
    """All columns of `docs` as one struct `row`, beside working columns: no name of the input can clash with these."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in cols.items()])


def row_type(docs: DataFrame) -> str:
    """The type of `row`, as a schema string for functions that pass it through."""
    return packed(docs).schema["row"].dataType.simpleString()


def unpacked(df: DataFrame, docs: DataFrame, put: dict[str, Column] | None = None, **extra: Column) -> DataFrame:
    """The columns of `docs` back from `row`, some replaced by `put`, and `extra` ones under names not taken."""
    put = put or {}
    cols = [(put[c] if c in put else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return df.select(*cols, *[c.alias(fresh(docs, name)) for name, c in extra.items()])


#: Spark and Arrow type of what `map_text` functions return.
LONG, DOUBLE, BOOL, STRING, BINARY = ("long", pa.int64()), ("double", pa.float64()), ("boolean", pa.bool_()), ("string", pa.string()), ("binary", pa.binary())


MAP_ROWS = 512  # texts that a task holds at a time beside their Arrow batch
BATCH_ROWS = 1024  # rows of an Arrow batch after `small_batches`, at most
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have this session's Arrow batches hold at most BATCH_ROWS rows; a smaller setting stays.

    Whole texts run to kilobytes. At Spark's 10,000 rows a batch is some 30 MB, held several times over
    outside the heap of the executor and in each of its workers. Results do not depend on it.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory to the system, where it has one (glibc)."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Return the free memory that Arrow and the C library keep: idle workers share the machine with later stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_held: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable[[], object]):
    """The large model of this worker process, made by `build`. There is one at a time: another key drops it first.

    Workers are used again by later stages, which would otherwise run beside the models of all earlier ones.
    """
    if key not in _held:
        _held.clear()
        gc.collect()  # models hold caches that refer back to them
        release()
        _held[key] = build()
    return _held[key]


def map_text(docs: DataFrame, text: str, fn, fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """`row` (see `packed`) and `fields`, computed in tasks by `fn(list of texts) -> list of columns`.

    The input's columns pass through as Arrow data, untouched.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, MAP_ROWS):
                row = batch.column(0).slice(lo, MAP_ROWS)
                made = fn(row.field(at).to_pylist())
                made = [pa.array(values, kind) for values, (_, kind) in zip(made, fields.values())]
                yield pa.RecordBatch.from_arrays([row, *made], ["row", *fields])
            release()

    return packed(docs).mapInArrow(run, ", ".join([f"row {row_type(docs)}", *(f"{n} {t}" for n, (t, _) in fields.items())]))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys (shifts and odd multipliers, invertible)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


class Cache(dict):
    """key -> compute(key), holding at most twice `most` entries: the older half goes when the newer is full."""

    def __init__(self, compute, most: int = 100_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_word_hashes = Cache(word_hash)


def hashed_words(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word of an encoded text, in order."""
    words = text.split() if text else []
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
