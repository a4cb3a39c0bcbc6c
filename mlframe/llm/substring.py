"""Exact removal of repeated word spans with a compacted De Bruijn graph.

Every window of `SPAN` words is an edge of the De Bruijn graph over the corpus. Windows are not shuffled
one by one: neighbouring windows that share their minimizer (the smallest hash among their runs of `SEED`
words) form one nonbranching piece, cut at the same words wherever the passage stands, so pieces compact
the graph inside the tasks and the minimizer is the key under which equal windows must meet.

1. A minimizer that occurs once is done with. The other pieces are counted by (minimizer, content), and one
   that occurs twice repeats with all its windows.
2. A window may also repeat in two different pieces of one minimizer, at the ends of a shared passage.
   Only minimizers with two or more different pieces are opened: one occurrence of each piece is looked
   up at its source coordinates and its windows are counted one by one.
3. The repeated pieces are joined back to all their coordinates, glued to spans per document and cut out.

Keys are pairs of 64-bit hashes with independent parts (minimizer and content, or two bases), computed
from 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import hashed_words, mix64, packed, unpacked
from mlframe.session import materialize

SPAN, SEED = 35, 8
REACH = SPAN - SEED + 1  # seeds in a window
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
CHUNK_WORDS = 200_000


class Slices:
    """Hashes of slices of a word sequence from running sums of powers."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            back = np.full(len(words) + 1, pow(int(base), -1, 1 << 64), np.uint64)
            fore = np.full(len(words) + 1, base, np.uint64)
            back[0] = fore[0] = 1
            self.fore, back = np.multiply.accumulate(fore), np.multiply.accumulate(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * back[:-1])])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[hi] - self.sums[lo]) * self.fore[lo] + (hi - lo).astype(np.uint64))


def pieces(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimizer, content) of all pieces of joined texts of `size` words each."""
    doc = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    if len(words) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = Slices(words, BASES[0])
    at = np.arange(len(words) - SEED + 1)
    seed = sums.of(at, at + SEED)
    place = np.arange(len(words) - SPAN + 1)
    place = place + np.lib.stride_tricks.sliding_window_view(seed, REACH).argmin(axis=1)
    inside = np.flatnonzero(doc[:len(place)] == doc[SPAN - 1:])  # windows within one text
    if not len(inside):
        return pieces(words[:0], size[:0])
    fresh = np.concatenate([[True], (place[inside][1:] != place[inside][:-1]) | (doc[inside][1:] != doc[inside][:-1])])
    lo = inside[fresh]
    n = np.diff(np.concatenate([np.flatnonzero(fresh), [len(inside)]]))
    return doc[lo], lo - start[doc[lo]], n, seed[place[lo]], sums.of(lo, lo + n + SPAN - 1)


def _chunked(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= 6 * CHUNK_WORDS or i == len(texts) - 1:
            yield lo, i + 1
            lo, held = i + 1, 0


PIECE = {"id": pa.int64(), "th": pa.int32(), "start": pa.int32(), "n": pa.int32(), "m": pa.int64(), "e": pa.int64()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(2).to_pylist()]
        for lo, hi in _chunked(texts):
            words = [hashed_words(t) for t in texts[lo:hi]]
            doc, start, n, m, e = pieces(np.concatenate(words), np.array([len(w) for w in words]))
            take = pa.array(doc + lo)
            cols = [batch.column(0).take(take), batch.column(1).take(take), start, n, m.view(np.int64), e.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, PIECE.values())], list(PIECE))


WINDOW = {"id": pa.int64(), "th": pa.int32(), "pos": pa.int32(), "once": pa.bool_(), "w1": pa.int64(), "w2": pa.int64()}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the listed pieces; columns id, th, text, list of (start, n, once)."""
    for batch in batches:
        for at, (text, opened) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            words = hashed_words(text.encode())
            n = np.array([p["n"] for p in opened])
            pos = np.repeat([p["start"] for p in opened], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = [Slices(words, b).of(pos, pos + SPAN).view(np.int64) for b in BASES]
            owner = pa.array(np.full(len(pos), at))
            cols = [batch.column(0).take(owner), batch.column(1).take(owner), pos, np.repeat([p["once"] for p in opened], n), *hashes]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, WINDOW.values())], list(WINDOW))


def _sql(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'long' if t == pa.int64() else 'int' if t == pa.int32() else 'boolean'}" for k, t in kinds.items())


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, spans): for each document the [lo, hi) word ranges that stand elsewhere too; th is a hash of its text."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.hash(text).alias("th"), F.col(text).alias("text"))
    piece = materialize(rows.mapInArrow(_pieces, _sql(PIECE)), "db-pieces")
    live = piece.groupBy("m").agg(F.count("*").alias("c"), F.min("e").alias("lo"), F.max("e").alias("hi")).filter("c > 1")
    # stored, so that the join has plain exchanges on both sides and a minimizer with very many pieces can be split
    live = materialize(live.select("m", (F.col("lo") != F.col("hi")).alias("open")), "db-often")
    piece = materialize(piece.join(live, "m"), "db-live")
    first = F.min(F.struct("id", "th", "start"))
    kinds = piece.groupBy("m", "e").agg(F.count("*").alias("c"), F.first("n").alias("n"), first.alias("at"), F.first("open").alias("open"))
    kinds = materialize(kinds, "db-kinds")

    opened = kinds.filter("open")
    opened = opened.groupBy("at.id", "at.th").agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "n", (F.col("c") == 1).alias("once"))).alias("opened"))
    opened = opened.withColumnsRenamed({"id": "oid", "th": "oth"})
    met = rows.join(opened, F.col("id").eqNullSafe(F.col("oid")) & (F.col("th") == F.col("oth"))).select("id", "th", "text", "opened")
    window = materialize(met.mapInArrow(_windows, _sql(WINDOW)), "db-windows")
    again = window.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2")
    ends = window.filter("once").join(again, ["w1", "w2"], "left_semi").select("id", "th", F.col("pos").alias("lo"), (F.col("pos") + SPAN).alias("hi"))

    often = kinds.filter("c > 1").select("m", "e")
    whole = piece.join(often, ["m", "e"], "left_semi").select("id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (SPAN - 1)).alias("hi"))
    spans = whole.unionByName(ends).groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return spans.withColumn("spans", _glued())


def _glued():
    """Overlapping and touching ranges, in order, as one."""
    def step(done, r):
        last = F.element_at(done, -1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (r["lo"] <= F.try_element_at(done, F.lit(-1))["hi"]), joined).otherwise(F.concat(done, F.array(r)))
    return F.aggregate("spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)"), step)


def cut_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated spans cut out of `text` (kept words joined by one blank), n_words and n_removed.

    All occurrences go, the first included; windows are judged on the input. Null text stays null and a text
    shorter than a window loses nothing; every kept text is its words joined by one blank. Rows equal in key
    and text repeat each other. An empty table gives an empty result.
    """
    spans = materialize(repeated_spans(docs, key, text), "db-spans").withColumnsRenamed({"id": "sid", "th": "sth"})
    found = packed(docs, id=F.col(key).cast("long"), th=F.hash(text), text=F.col(text))
    found = found.join(spans, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left").select("row", "text", "spans")
    at = found.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for t, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = t.encode().split() if t else []
                size = len(words)
                for r in reversed(ranges or []):
                    del words[r["lo"]:r["hi"]]
                texts.append(None if t is None else b" ".join(words).decode())
                n.append(size)
                removed.append(size - len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                                             ["row", "kept", "n_words", "n_removed"])

    made = found.mapInArrow(cut, f"row {at}, kept string, n_words long, n_removed long")
    return unpacked(made, docs, {text: F.col("kept")}, n_words=F.col("n_words"), n_removed=F.col("n_removed"))
