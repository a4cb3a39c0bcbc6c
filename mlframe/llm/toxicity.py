"""Toxicity by non-negative positive-unlabelled learning.

Only texts confirmed as toxic are taken as labelled; everything else, a sample of all texts, is unlabelled and holds
toxic ones at the rate of the class prior. A text is the set of its hashed words, word beginnings and 5-grams of
letters. Two learners share the corrected risk: each feature gets log odds against the unlabelled frequency with the
prior's share of positives taken off (never below nothing), a word has the mean of its strongest odds, and a small
network on the strongest words of a text minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the difference turns negative the step goes the
other way, so that the network cannot fit the unlabelled toxic texts as clean. Texts that the network learns from
are read with odds from the other folds of the sample; any text gets the mean score over the odds of all folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import DOUBLE, map_text, mix64, unpacked
from mlframe.session import materialize

BUCKETS = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
GRAM = 5
STARTS = (3, 5, 6)
LONG_WORD = 48  # longer words are hashed one by one and not kept
WORDS = 8192  # words hashed at a time
KEPT = 300_000  # words a worker keeps
POOLS = (1, 2, 3, 5, 10)
STRONGEST = 5  # features that speak for a word
WIDTH = len(POOLS) + 3
SMOOTH = 0.5
FOLDS = 4  # folds of the sample
RARE = 2  # features of fewer sampled texts weigh nothing


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: confirmed toxic texts, and unlabelled ones, at most; the default class prior."""

    positives: int = 8192
    unlabelled: int = 24576
    prior: float = 0.1
    seed: int = 0


_KEYS = mix64(np.arange(1, 65, dtype=np.uint64))  # odd enough multipliers of the letters of a piece


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & np.uint64(BUCKETS - 1)).astype(np.int32)


def word_features(words: list[str]) -> np.ndarray:
    """Buckets of the features of each word, a row a word; BUCKETS where there is none.

    Columns: the whole word, its beginnings of STARTS letters, its GRAM-letter pieces, both ends marked.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - start[word]
    pieces = np.maximum(size - GRAM + 1, 0)
    base = 1 + len(STARTS)
    out = np.full((len(words), base + int(pieces.max(initial=0))), BUCKETS, np.int32)
    out[:, 0] = _bucket(np.add.reduceat(codes * mix64(place.astype(np.uint64) + np.uint64(1000)), start))
    padded = np.append(codes, np.zeros(max(STARTS) + 1, np.uint64))
    for i, k in enumerate(STARTS):
        has = np.flatnonzero(size >= k + 2)
        h = np.full(len(has), k, np.uint64)
        for j in range(k + 1):
            h = h + padded[start[has] + j] * _KEYS[16 + j]
        out[has, 1 + i] = _bucket(h)
    at = np.flatnonzero(place < pieces[word])
    h = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        h = h + padded[at + j] * _KEYS[j]
    out[word[at], base + place[at]] = _bucket(h)
    return out


def _short_and_long(words: set[str]) -> tuple[list[str], list[str]]:
    short = [w for w in words if len(w) <= LONG_WORD]
    return short, [w for w in words if len(w) > LONG_WORD] if len(short) < len(words) else []


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text, ascending; none if it has no letter."""
    short, long = _short_and_long(set(LETTERS.findall((text or "").lower())))
    parts = [word_features(short[lo:lo + WORDS]).ravel() for lo in range(0, len(short), WORDS)] + [word_features([w]).ravel() for w in long]
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
    return found[found < BUCKETS]


class Words:
    """The distinct words of texts, each by the mean of its strongest log odds, in every one of the given tables of odds."""

    def __init__(self, odds: list[np.ndarray]):
        self.odds = np.vstack([np.stack(odds, axis=1), np.full((1, len(odds)), -np.inf, np.float32)])
        self.places: dict[str, int] = {}
        self.scores = np.zeros((KEPT, len(odds)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        features = word_features(words)
        top = min(STRONGEST, features.shape[1])
        mine = np.partition(self.odds[features], features.shape[1] - top, axis=1)[:, features.shape[1] - top:]
        there = np.isfinite(mine)
        return np.where(there, mine, 0).sum(axis=1) / there.sum(axis=1)

    def known(self, words: set[str]) -> None:
        """Score the words that are not known yet; all are forgotten before they get too many."""
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > KEPT:
            self.places, new = {}, list(words)
        for lo in range(0, len(new), WORDS):
            part, at = new[lo:lo + WORDS], len(self.places)
            self.scores[at:at + len(part)] = self.word_scores(part)
            self.places.update(zip(part, range(at, at + len(part))))

    def pooled(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """What the network sees of each text, a row per table of odds: means of its strongest words, how many it has and
        how many point to toxic. None for a text without a letter."""
        out: list[np.ndarray | None] = []
        sets = [_short_and_long(set(LETTERS.findall((t or "").lower()))) for t in texts]
        lo = 0
        while lo < len(texts):
            hi, every = lo, set()
            while hi < len(texts) and (hi == lo or len(every) + len(sets[hi][0]) <= KEPT // 2):
                every.update(sets[hi][0])
                hi += 1
            many = len(every) > KEPT  # one text with more words than are kept
            if not many:
                self.known(every)
            for short, long in sets[lo:hi]:
                if not short and not long:
                    out.append(None)
                    continue
                if many:
                    parts = [self.word_scores(short[i:i + WORDS]) for i in range(0, len(short), WORDS)]
                else:
                    parts = [self.scores[np.fromiter(map(self.places.__getitem__, short), np.int64, len(short))]]
                mine = np.concatenate([*parts, *(self.word_scores([w]) for w in long)]).T
                n = mine.shape[1]
                most = min(n, POOLS[-1])
                top = -np.sort(-np.partition(mine, n - most, axis=1)[:, n - most:], axis=1)
                means = np.cumsum(top, axis=1)
                some = [np.full(len(mine), n), (mine > 1).sum(axis=1), (mine > 3).sum(axis=1)]
                out.append(np.column_stack([*(means[:, min(k, most) - 1] / min(k, most) for k in POOLS), *map(np.log1p, some)]))
            lo = hi
        return out


def log_odds(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int, prior: float) -> np.ndarray:
    """Log odds per feature of toxic against clean texts, the clean rate being what the prior leaves of the unlabelled one."""
    clean = np.maximum(unlabelled / max(1, n_unlabelled) - prior * positive / max(1, n_positive), 0) / (1 - prior)
    odds = np.log((positive + SMOOTH) / (clean * n_positive + SMOOTH))
    return np.where(positive + unlabelled >= RARE, odds, 0.0).astype(np.float32)


@dataclass
class Network:
    """One hidden layer, trained on the non-negative risk by Adam on the whole sample."""

    hidden: int = 6
    steps: int = 1500
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 1
    weights: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(x @ a + b)
        return h, 1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        x, n = (both - self.mean) / self.scale, len(positive)
        rng = np.random.default_rng(self.seed)
        self.weights = [rng.normal(0, 0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 0.5, self.hidden),
                        np.array([np.log(prior / (1 - prior))])]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for t in range(1, self.steps + 1):
            h, s = self._forward(x)
            p, u = s[:n], s[n:]
            as_clean = lambda q: -np.log1p(-np.minimum(q, 1 - 1e-12)).mean()
            if as_clean(u) >= prior * as_clean(p):
                g = np.r_[np.full(n, -prior / n), u / len(u)]
            else:
                g = np.r_[prior * p / n, -u / len(u)]
            back = np.outer(g, self.weights[2]) * (1 - h * h)
            grads = [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
            rate = self.rate * (1 - t / (self.steps + 1))
            for i, grad in enumerate(grads):
                grad = grad + self.decay * self.weights[i] * (i % 2 == 0)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                self.weights[i] = self.weights[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1]


@dataclass(frozen=True)
class Model:
    """What scoring needs; without odds (no confirmed toxic text) every text gets the prior."""

    prior: float
    odds: list[np.ndarray] | None = None
    network: Network | None = None
    words: Words | None = field(default=None, compare=False)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.odds is None:
            return out
        if self.words is None:
            object.__setattr__(self, "words", Words(self.odds))  # once a worker
        found = self.words.pooled(texts)
        some = [i for i, f in enumerate(found) if f is not None]
        if some:
            out[some] = self.network.score(np.concatenate([found[i] for i in some])).reshape(len(some), -1).mean(axis=1)
        return out


def _drawn(ids: DataFrame, most: int, seed: int) -> list[int]:
    """At most `most` keys, the first in the order of a hash; twice that many at most come to the driver, unless the table is small."""
    n = ids.count()
    h = F.xxhash64(F.lit(seed), "id")
    kept = ids if n <= 2 * most else ids.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 1.5 * most / n))
    rows = sorted((r["h"], r["id"]) for r in kept.select("id", h.alias("h")).collect())
    return [i for _, i in rows[:most]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per feature, apart by kind and fold: column n<i> for i = FOLDS * kind + fold."""
    got = np.zeros((2 * FOLDS, BUCKETS), np.int32)
    for batch in batches:
        for kind, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            got[FOLDS * kind + fold, text_features(text)] += 1
    at = np.flatnonzero(got.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c[at]) for c in got]], ["feature", *[f"n{i}" for i in range(2 * FOLDS)]])


def _pooled_rows(odds: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words([o]) for o in odds]
        for batch in batches:
            _, fold, text = (batch.column(i).to_pylist() for i in range(3))
            x: list[list[float]] = [[0.0] * WIDTH for _ in text]
            for f, known in enumerate(words):
                mine = [i for i, g in enumerate(fold) if g == f]
                for i, p in zip(mine, known.pooled([text[i] for i in mine])):
                    if p is not None:
                        x[i] = p[0].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["kind", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: Sample | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the texts of `docs` and the labels of `labels` that meet `usable` (a condition on the key, an integer).

    Keys labelled 1 anywhere are confirmed. The prior is their share of all labelled keys; if none is labelled
    otherwise it is `sample.prior`. The sample is bounded by `Sample`, drawn by a hash of the key; of a repeated key one
    text is read. The drawn keys, at most a few ten thousand, are broadcast, so only drawn texts move.
    """
    sample = sample or Sample()
    spark = docs.sparkSession
    known = (labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
             .groupBy("id").agg(F.max(F.when(F.col("y") == 1, 1).otherwise(0)).alias("y")))
    known = materialize(known, "labels")
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = positive / n if 0 < positive < n else sample.prior if positive else 0.0
    if not positive:
        return Model(prior)
    toxic = _drawn(known.filter("y = 1").select("id"), sample.positives, sample.seed)
    every = docs.filter(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"))
    other = _drawn(every, sample.unlabelled, sample.seed + 1)
    drawn = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in other], "id long, kind int")
    texts = docs.filter(usable).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    # of a repeated key the text with the smallest hash; a partial result per task
    texts = texts.groupBy("id", "kind").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(sample.seed + 2), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    texts = materialize(texts.filter("text is not null").select("kind", fold, "text").repartition(spark.sparkContext.defaultParallelism), "toxicity-sample")
    size = np.zeros(2 * FOLDS, np.int64)
    for r in texts.groupBy("kind", "fold").count().collect():
        size[FOLDS * r["kind"] + r["fold"]] = r["count"]
    if not size[:FOLDS].sum() or not size[FOLDS:].sum():
        return Model(prior)
    cols = [f"n{i}" for i in range(2 * FOLDS)]
    counted = texts.mapInArrow(_counts, ", ".join(["feature long", *(f"{c} int" for c in cols)])).groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols])
    table = counted.filter(sum((F.col(c) for c in cols[1:]), F.col(cols[0])) >= RARE).toArrow()  # at most BUCKETS rows
    counts = np.zeros((2 * FOLDS, BUCKETS))
    counts[:, table["feature"].to_numpy()] = np.stack([table[c].to_numpy() for c in cols])

    def odds(folds: list[int]) -> np.ndarray:
        other, mine = list(folds), [FOLDS + f for f in folds]
        return log_odds(counts[mine].sum(axis=0), size[mine].sum(), counts[other].sum(axis=0), size[other].sum(), prior)

    held_out = [odds([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)]
    rows = texts.mapInArrow(_pooled_rows(held_out), "kind int, x array<double>").toArrow()
    x, kind = np.stack(rows["x"].to_numpy()), rows["kind"].to_numpy()
    order = np.lexsort((*x.T, kind))  # the same sums in every run
    x, kind = x[order], kind[order]
    network = Network().fit(x[kind == 1], x[kind == 0], prior)
    return Model(prior, held_out, network)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score`, 0 to 1, from each whole text alone.

    A null or empty text and one without a letter get the class prior, as every text does if nothing toxic was confirmed.
    Repeated texts score alike; very long ones count each feature once; other columns pass through whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 16 MB
    fields = {"score": DOUBLE}
    return unpacked(map_text(docs, text, lambda texts: [held.value.score(texts)], fields), docs, score=F.col("score"))
