"""Token ids on disk: every document compressed by itself under one shared zstandard dictionary.

Format. A table of segments in document order, each with `part`, `seg`, the documents' keys, the token
count and the byte offset of each document in `body`, and the hash of the dictionary. `body` holds one
zstandard frame per document over its ids as little-endian unsigned integers of `width` bytes. The
dictionary stands in a table of its own beside them, as does the number of ids in front of each part. A
segment also holds the number of ids before it in its part, and its least and greatest key. A
reader of one document takes its segment, cuts `body` at the offset and inflates that frame only.

Segments are rows that Spark writes and commits, so files appear whole or not at all in any store.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.llm.bpe import FrontEnd
from mlframe.llm.common import Cache
from mlframe.session import materialize

END = 2
SAMPLE_DOCS = 2048  # documents that train the dictionary, at most
SAMPLE_CHARS = 4096  # of each of them, at most: the dictionary serves short documents
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 1 << 20
PART_BYTES = 64 << 20  # of texts in a part, about
LEVEL = 3


class Encoder:
    """Ids of whole texts from the tokenizers library, word by word.

    The pre-tokenizer drops white space and never joins across it, so a text's ids are its words' ids in
    order, and words come from a bounded cache.
    """

    def __init__(self, path: str):
        self.front = FrontEnd(path)
        self.model = self.front.tokenizer.model
        self.width = 2 if self.front.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.bytes = [i.to_bytes(self.width, "little") for i in range(1 + max(self.front.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.word = Cache(self.fresh, 400_000)
        self.piece = Cache(self.tokenized, 200_000)  # words in several forms and the stops behind them share their pieces

    def tokenized(self, piece: str) -> bytes:
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(piece)])

    def fresh(self, word: bytes) -> bytes:
        return b"".join([self.bytes[p] if isinstance(p, int) else self.piece[p] for p in self.front.parts(word)])

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.word.__getitem__, text.encode().split())) if text else b""


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def dictionary_sample(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[str], int]:
    """The SAMPLE_DOCS texts of at most SAMPLE_CHARS characters that come first in hash order, and an estimate of all texts' bytes.

    A pass keeps the rows below a hash bound that should hold eight times as many; only if it holds too few
    is the bound raised. Their hashes come to the driver, then the texts that are wanted.
    """
    rows, share = docs.count(), 0.0
    hashed = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"),
                         F.when(F.length(text).between(1, SAMPLE_CHARS), F.col(text)).alias("text"))
    while True:
        share = min(1.0, max(8 * SAMPLE_DOCS / max(rows, 1), 8 * share))
        bound = (1 << 63) - 1 if share == 1.0 else int(share * 2.0 ** 64) - (1 << 63)
        near = materialize(hashed.filter(F.col("h") <= F.lit(bound)), "token-sample")
        fit = near.filter("text IS NOT NULL")
        hashes = [r.h for r in fit.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]
        if len(hashes) == SAMPLE_DOCS or share == 1.0:
            break
    seen = near.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    size = rows * (seen.bytes or 0) // max(seen.n, 1)
    wanted = fit.filter(F.col("h") <= F.lit(hashes[-1])).orderBy("h", "text").limit(SAMPLE_DOCS) if hashes else None
    return [r.text for r in wanted.collect()] if hashes else [], size


def train_dictionary(texts: list[str], path: str) -> bytes:
    """A dictionary from the ids of sample texts.

    Too few or too short samples make their own bytes the dictionary; without any it is empty.
    """
    import zstandard

    coder = encoder(path)
    end = END.to_bytes(coder.width, "little")
    samples = [coder.ids(t) + end for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("ahead", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("width", pa.int32()), ("dictionary_hash", pa.int64()),
                     ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("body", pa.binary())])
SEGMENT_SQL = "part int, seg int, ahead long, least long, most long, width int, dictionary_hash long, keys array<long>, counts array<int>, offsets array<long>, body binary"


def write_ids(docs: DataFrame, out: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text (null: empty), each with END appended, under `out`, in ascending `key` order.

    Null keys come first; rows of one key are in the order of a hash of their texts. An empty text is END alone,
    a text of any length is one frame, and an empty table leaves no segment. The number of parts follows the texts' bytes.
    """
    import zstandard
    import xxhash

    spark = docs.sparkSession
    texts, size = dictionary_sample(docs, key, text)
    dictionary = train_dictionary(texts, path)
    check = xxhash.xxh3_64_intdigest(dictionary) >> 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, seg, end = TaskContext.get().partitionId(), 0, END.to_bytes(coder.width, "little")
        keys, counts, frames, held, ahead = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            offsets = [0, *accumulate(map(len, frames))][:-1]
            least, most = (min((k for k in keys if k is not None), default=None), max((k for k in keys if k is not None), default=None))
            row = [part], [seg], [ahead], [least], [most], [coder.width], [check], [keys], [counts], [offsets], [b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SEGMENT)], schema=SEGMENT)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.ids(t.as_py()) + end
                frame = squeeze.compress(ids)
                keys.append(k)
                counts.append(len(ids) // coder.width)
                frames.append(frame)
                held += len(frame)
                if held >= SEGMENT_BYTES:
                    yield segment()
                    ahead += sum(counts)
                    keys, counts, frames, held, seg = [], [], [], 0, seg + 1
        if keys:
            yield segment()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    laid = rows.repartitionByRange(parts, "key", tie).sortWithinPartitions("key", tie, "text")
    laid.mapInArrow(pack, SEGMENT_SQL).write.parquet(f"{out}/segments")
    spark.createDataFrame([(bytearray(dictionary), check)], "dictionary binary, dictionary_hash long").write.parquet(f"{out}/dictionary")
    ids = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    parts = spark.read.parquet(f"{out}/segments").groupBy("part").agg(F.sum(ids).alias("n")).orderBy("part").collect()
    before = accumulate([0, *(r.n for r in parts)])
    base = [(r.part, b) for r, b in zip(parts, before)]
    spark.createDataFrame(base, "part int, base long").write.parquet(f"{out}/parts")


FOUND = "key long, start long, n_tokens long, ids binary"


def read_ids(spark: SparkSession, out: str, key: int | None = None) -> DataFrame:
    """(key, start, n_tokens, ids) of each document, or of those with one `key`, from the files alone.

    `start` is the number of ids of all documents before it; `ids` are little-endian unsigned 32-bit
    integers. A dictionary that does not match the segments' hash is an error. Each segment knows how many
    ids stand before it in its part, so only a row per part is joined (by broadcast) and ids never move.
    With `key`, the files skip segments whose range of keys leaves it out, and only its frames are inflated.
    """
    book = spark.read.parquet(f"{out}/dictionary").first()
    dictionary, check = bytes(book.dictionary), book.dictionary_hash

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary_hash"] != check:
                    raise ValueError("the segments were written with another dictionary")
                rows, start, body = [], r["base"] + r["ahead"], memoryview(r["body"])
                for k, n, a, b in zip(r["keys"], r["counts"], r["offsets"], [*r["offsets"][1:], len(body)]):
                    if key is None or k == key:
                        ids = np.frombuffer(inflate.decompress(body[a:b]), f"<u{r['width']}").astype("<u4").tobytes()
                        rows.append((k, start, n, ids))
                    start += n
                for at in range(0, len(rows), 1024):
                    cols, kinds = zip(*rows[at:at + 1024]), [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["key", "start", "n_tokens", "ids"])

    segments = spark.read.parquet(f"{out}/segments")
    if key is not None:
        segments = segments.filter((F.col("least") <= key) & (F.col("most") >= key))
    base = spark.read.parquet(f"{out}/parts")
    return segments.join(F.broadcast(base), "part").mapInArrow(unpack, FOUND)
