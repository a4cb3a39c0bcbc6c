"""Near duplicates by DartMinHash: hashed darts, banded joining, exact check, connected classes.

Signature. Every element (a run of five words) owns a strip of unit area per unit of weight and time.
Darts fall on the strips as a Poisson process drawn from hashes of (element, weight cell, time slice),
so equal elements of two texts get the same darts. A dart is thrown into one of `k` coordinates and a
coordinate keeps its earliest dart. About k ln k + 2k darts per text fill all coordinates whatever its
length; texts with an empty one extend their time. Two texts agree on a coordinate with probability
equal to their weighted Jaccard similarity.

Candidates. `bands` x `rows` coordinates give bucket keys. At similarity 0.8 a pair shares no bucket with
probability (1 - 0.8^5)^24 < 1e-4. Inside a bucket no pairs are spelled out: one member is compared
with the rest, links join classes, and only members outside the first member's class become
further pivots (1, 32, 1024, ... a round) until no two members of different classes are uncompared. Pairs
that cannot reach the threshold by their elements found nowhere else, or by the bits in which their sketches
differ (`sketches`), are left out inside the join. Each comparison counts the shared elements of both whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import hashed_words, mix64, release
from mlframe.llm.components import components
from mlframe.session import materialize

BANDS, ROWS, SHINGLE, THRESHOLD = 24, 5, 5, 0.8
DOC_BITS = np.uint64(12)  # documents of one chunk, at most 4096
CHUNK_WORDS = 200_000
SLACK = 1e-9  # for similarities that equal the threshold
GROUP = 1000  # pairs that share one copy of a pivot's elements
SKETCH = [f"s{i}" for i in range(16)]  # 64 bits each


def shingled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count) of the distinct five-word runs of up to 4096 texts, sorted by both.

    A text of one to four words has one element made of all of them; one without words has none.
    """
    words = [hashed_words(t) for t in texts]
    size = np.array([len(w) for w in words])
    flat = mix64(np.concatenate(words)) if size.sum() else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    with np.errstate(over="ignore"):
        run = np.zeros(len(flat), np.uint64)
        for i in range(SHINGLE):
            shifted = np.concatenate([flat[i:], np.zeros(min(i, len(flat)), np.uint64)])
            inside = np.arange(len(flat)) + i < (start + size)[doc]
            run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, shifted, np.uint64(1))
        keep = np.arange(len(flat)) <= np.maximum(start, start + size - SHINGLE)[doc]
        code = (doc[keep].astype(np.uint64) << (np.uint64(64) - DOC_BITS)) | (mix64(run[keep]) >> DOC_BITS)
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(code)]]))
    code = code[first]
    return (code >> (np.uint64(64) - DOC_BITS)).astype(np.int64), code & ((np.uint64(1) << (np.uint64(64) - DOC_BITS)) - np.uint64(1)), count


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k identities of the earliest dart per coordinate; texts without elements get zeros.

    `weight` holds positive numbers; strips of a fractional weight are cut at their upper end.
    """
    total = np.bincount(doc, weights=weight, minlength=docs)
    earliest, identity = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint64)
    horizon = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    open_ = total > 0
    golden = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while open_.any():
            chosen = np.flatnonzero(open_[doc])
            slices = np.ceil(horizon[doc[chosen]]).astype(np.int64)
            cells = np.ceil(weight[chosen]).astype(np.int64)
            n = slices * cells
            at = np.repeat(chosen, n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            piece, cell = nth // np.repeat(cells, n), nth % np.repeat(cells, n)
            seed = mix64(element[at] + mix64(piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + cell.astype(np.uint64) + np.uint64(1)))
            owner, width = doc[at], weight[at] - cell
            end = np.minimum(piece + 1.0, horizon[owner])
            time, step = piece.astype(np.float64), np.uint64(0)
            while len(seed):
                step += np.uint64(1)
                draw = mix64(seed + step * golden)
                time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                live = time < end
                seed, owner, width, end, time = seed[live], owner[live], width[live], end[live], time[live]
                dart = mix64(draw[live] ^ golden)
                hit = (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24 < width
                spot = owner[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
                np.minimum.at(earliest, spot, time[hit])
                won = time[hit] == earliest[spot]
                identity[spot[won]] = dart[hit][won]
            open_ &= np.isinf(earliest.reshape(docs, k)).any(axis=1)
            earliest.reshape(docs, k)[open_] = np.inf
            horizon[open_] *= 2
    return identity.reshape(docs, k)


def band_keys(identity: np.ndarray) -> np.ndarray:
    """One signed bucket key per band."""
    with np.errstate(over="ignore"):
        parts = identity.reshape(len(identity), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
        for i in range(ROWS):
            key = mix64(key * np.uint64(31) + parts[:, :, i])
    return key.astype(np.int64)


def sketches(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int) -> np.ndarray:
    """docs x 16 signed words: bit i tells whether a text has an odd weight of elements of hash class i.

    Each bit in which two texts differ is an element that the texts do not share, or more of it in one than
    in the other. So the bits that differ are at most the weight of all such elements, whatever the texts.
    """
    out, bits = np.empty((docs, len(SKETCH)), np.int64), 64 * len(SKETCH)
    edge = np.searchsorted(doc, np.arange(0, docs + 512, 512))
    for at, a, b in zip(range(0, docs, 512), edge, edge[1:]):
        size = min(512, docs - at)
        place = (doc[a:b] - at) * bits + (element[a:b].astype(np.uint64) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(place, weights=count[a:b], minlength=size * bits).astype(np.int64) & 1
        out[at:at + size] = np.packbits(odd.astype(np.uint8).reshape(size, bits), axis=1).view(np.int64)
    return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most 4096 texts and about `CHUNK_WORDS` words."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > 6 * CHUNK_WORDS or i - lo == 1 << int(DOC_BITS)):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _sign(weighted: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]
            for lo, hi in _chunks(texts):
                doc, element, count = shingled(texts[lo:hi])
                weight = count.astype(np.float64) if weighted else np.ones(len(count))
                keys = band_keys(dart_signatures(doc, element, weight, hi - lo, BANDS * ROWS))
                n = np.bincount(doc, weights=weight, minlength=hi - lo).astype(np.int64)
                yield pd.DataFrame({"id": batch["id"].to_numpy()[lo:hi], "h1": batch["h1"].to_numpy()[lo:hi], "h2": batch["h2"].to_numpy()[lo:hi],
                                    "n": n, "keys": [row if c else row[:0] for row, c in zip(keys, n)]})
            release()
    return run


def _features(weighted: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            for lo, hi in _chunks(texts):
                doc, element, count = shingled(texts[lo:hi])
                sketch = sketches(doc, element, count if weighted else np.ones(len(count)), hi - lo)
                element = element.astype(np.uint32) if not weighted else element
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pd.DataFrame({"id": batch["id"].to_numpy()[lo:hi],
                                    "items": [np.sort(element[a:b]).tobytes() for a, b in zip(edge, edge[1:])],
                                    "counts": [count[a:b].astype(np.uint32).tobytes() if weighted else b"" for a, b in zip(edge, edge[1:])],
                                    **{name: sketch[:, i] for i, name in enumerate(SKETCH)}})
            release()
    return run


def _similar(weighted: bool, threshold: float):
    kind = np.uint64 if weighted else np.uint32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y, cx, cy in zip(batch["x"], batch["y"], batch["cx"], batch["cy"]):
                a, b = np.frombuffer(x, kind), np.frombuffer(y, kind)
                if weighted:
                    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    ca, cb = np.frombuffer(cx, np.uint32).astype(np.int64), np.frombuffer(cy, np.uint32).astype(np.int64)
                    both, size = int(np.minimum(ca[i], cb[j]).sum()), int(ca.sum() + cb.sum())
                else:
                    pos = np.searchsorted(a, b)
                    both, size = int((a[np.minimum(pos, len(a) - 1)] == b).sum()), len(a) + len(b)
                linked.append(both + SLACK >= threshold * (size - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})
            release()
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    weighted: bool = False) -> DataFrame:
    """(key, class_id, exact_id) per document: the smallest keys of its near-duplicate class and of its exact copies.

    `key` is an integer column. With `weighted`, elements count as often as they occur; otherwise once.
    Exact copies fall together first, null text equals empty text, and texts without words are alike only
    if equal. A row with a null key stays with null classes. Rows of one key are one document, so
    the classes of their texts are joined; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), body.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "text"), "h2": F.xxhash64(F.lit(2), "text")})
    signed = materialize(rows.select("id", "h1", "h2", "text").mapInPandas(
        _sign(weighted), "id long, h1 long, h2 long, n long, keys array<long>"), "dart")
    reps = signed.filter("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    reps = materialize(reps, "dart-reps")
    member = materialize(_shared(reps), "dart-buckets")
    needed = reps.join(member.select("rep").distinct(), "rep", "left_semi").select("rep", "h1", "h2")
    whole = rows.join(needed, (rows["id"] == needed["rep"]) & (rows["h1"] == needed["h1"]) & (rows["h2"] == needed["h2"]), "left_semi")
    whole = whole.dropDuplicates(["id", "h1", "h2"]).select("id", "text")
    features = materialize(whole.mapInPandas(_features(weighted), "id long, items binary, counts binary" + "".join(f", {s} long" for s in SKETCH)), "dart-items")

    member = materialize(_bounded(member, features, weighted, threshold), "dart-open")

    links = names = None
    seen = spark.createDataFrame([], "a long, b long")
    done = spark.createDataFrame([], "key long, pivot long")
    width = 1
    while True:
        pairs, pivots = _pairs(member, names, done, width, threshold)
        if names is not None and pivots.isEmpty():
            break
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti") if names is not None else pairs, "dart-pairs")
        if names is None or not pairs.isEmpty():
            found = materialize(_check(pairs, features, weighted, threshold), "dart-checked").filter("linked").select("a", "b")
            links = found if links is None else links.unionByName(found)
            if names is None or not found.isEmpty():
                names = components(links)
        done = done.unionByName(pivots)
        seen = seen.unionByName(pairs.select("a", "b"))
        width *= 32
    known = reps.join(names, reps["rep"] == names["id"], "left").select("h1", "h2", "rep", F.coalesce("comp", "rep").alias("class_id"))
    out = signed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    has = F.col("id").isNotNull()
    return out.select(F.col("id").alias(key), F.when(has, F.col("class_id")).alias("class_id"), F.when(has, F.col("rep")).alias("exact_id"))


def _shared(reps: DataFrame) -> DataFrame:
    """(key, rep, n, size, rank) for the buckets with two or more representatives.

    `rank` orders pivots: the text whose buckets hold the most others first, as the original among edited
    copies does, which links them all in one round; then by key.
    """
    member = reps.select("rep", "n", F.explode("keys").alias("key"))
    live = member.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    member = materialize(member.join(live, "key").select("key", "rep", "n", "size"), "dart-live")
    weight = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    return member.join(weight, "rep").select("key", "rep", "n", "size", F.struct(F.col("weight"), (-F.col("rep")).alias("low")).alias("rank"))


def _bounded(member: DataFrame, features: DataFrame, weighted: bool, threshold: float) -> DataFrame:
    """`member` with `sketch` and `u`, the weight of a text's elements that no other candidate has.

    These can't be shared, so x and y share at most min(n_x - u_x, n_y - u_y) of at least
    max(n_x + u_y, n_y + u_x). Texts that by this bound reach the threshold with nobody leave here.
    """
    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                found = [np.frombuffer(x, np.uint64 if weighted else np.uint32) for x in part["items"]]
                counts = [np.frombuffer(c, np.uint32) for c in part["counts"]] if weighted else [np.ones(len(f), np.uint32) for f in found]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), [len(f) for f in found]), "c": np.concatenate(counts).astype(np.int64),
                                    "item": np.concatenate(found).astype(np.uint64).view(np.int64)})

    item = features.select("id", "items", "counts").mapInPandas(items, "id long, c long, item long")
    alone = item.groupBy("item").agg(F.count("*").alias("texts"), F.min("id").alias("id"), F.min("c").alias("c")).filter("texts = 1")
    alone = alone.groupBy("id").agg(F.sum("c").alias("u")).withColumnRenamed("id", "uid")
    known = features.select("id", F.struct(*SKETCH).alias("sketch")).join(alone, F.col("id") == alone["uid"], "left")
    known = known.select("id", "sketch", F.coalesce("u", F.lit(0)).alias("u"))
    out = member.join(known, member["rep"] == known["id"]).drop("id")
    return out.filter(F.col("n") - F.col("u") + SLACK >= threshold * F.col("n"))


def _pairs(member: DataFrame, names: DataFrame | None, done: DataFrame, width: int,
           threshold: float) -> tuple[DataFrame, DataFrame]:
    """Comparisons still open: each bucket's next pivots against its members of other classes."""
    if names is None:
        pivots = materialize(member.groupBy("key").agg(F.max_by("rep", "rank").alias("pivot"), F.max_by("n", "rank").alias("pn"), F.max_by("u", "rank").alias("pu"), F.max_by("sketch", "rank").alias("psketch")), "dart-pivots")
        pairs = member.join(pivots, "key").filter("rep <> pivot")
    else:
        now = member.join(names, member["rep"] == names["id"], "left").select("key", "rep", "n", "u", "sketch", "size", "rank", F.coalesce("comp", "rep").alias("comp"))
        home = now.groupBy("key").agg(F.max_by("comp", "rank").alias("home"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        now = materialize(now.join(home.select("key", "home"), "key"), "dart-open")
        outside = now.filter("comp <> home").join(done, (now["key"] == done["key"]) & (now["rep"] == done["pivot"]), "left_anti")
        turn = F.pmod(F.xxhash64("rep"), F.lit(width))
        pivots = outside.groupBy("key", turn.alias("turn")).agg(F.max(F.struct("rank", "rep", "n", "u", "comp", "sketch")).alias("p"))
        pivots = materialize(pivots.select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.u").alias("pu"), F.col("p.comp").alias("pcomp"), F.col("p.sketch").alias("psketch")), "dart-pivots")
        pairs = now.join(pivots, "key").filter("comp <> pcomp")
    pairs = pairs.filter(
        F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu")) + SLACK >= threshold * F.greatest(F.col("n") + F.col("pu"), F.col("pn") + F.col("u")))
    # texts that differ by d of the weight n + pn reach it if d (1 + threshold) is at most (n + pn) (1 - threshold)
    apart = sum((F.bit_count(F.col(f"sketch.{s}").bitwiseXOR(F.col(f"psketch.{s}"))) for s in SKETCH[1:]),
                F.bit_count(F.col(f"sketch.{SKETCH[0]}").bitwiseXOR(F.col(f"psketch.{SKETCH[0]}"))))
    pairs = pairs.filter(apart * (1 + threshold) <= (F.col("n") + F.col("pn")) * (1 - threshold) + 2 * SLACK)
    pairs = pairs.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b"), F.ceil(F.col("size") / GROUP).alias("groups"))
    return pairs.groupBy("a", "b").agg(F.max("groups").alias("groups")), pivots.select("key", "pivot")


def _check(pairs: DataFrame, features: DataFrame, weighted: bool, threshold: float) -> DataFrame:
    """The similarity of each pair from the elements of both whole texts.

    Many pairs share their smaller member; its elements come in one copy per `GROUP` pairs, so that no
    task gets all of them.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.col("groups")))
    copies = pairs.select("b", "part").distinct().join(features.select(F.col("id").alias("b"), F.col("items").alias("y"), F.col("counts").alias("cy")), "b")
    left = pairs.select("a", "b", "part").join(features.select(F.col("id").alias("a"), F.col("items").alias("x"), F.col("counts").alias("cx")), "a")
    both = left.join(copies, ["b", "part"])
    return both.select("a", "b", "x", "y", "cx", "cy").mapInPandas(_similar(weighted, threshold), "a long, b long, linked boolean")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of its class, once each, and the rows without a key."""
    found = near_duplicates(docs, key, text).filter(F.col(key).isNotNull() & (F.col("class_id") == F.col(key))).select(F.col(key).alias("nd_keep")).distinct()
    kept = docs.join(found, F.col(key) == F.col("nd_keep"), "left_semi")
    return kept.dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))
