"""Language identification by cross-parsing entropy.

Each language keeps a bounded sample of labelled text in a suffix automaton. A text is parsed greedily
into the longest phrases that occur in a language's sample; the fewer phrases it takes, the closer the
text is to the language. With c phrases, n characters and a sample of m characters the cost is
c log2(m) / n bits per character, and the language with the least cost wins.

Texts are cut into pieces of `PIECE` characters (a phrase ends at a cut), and all pieces of a batch walk
the automata of all languages in step, one table look-up per character.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlframe.llm.common import DOUBLE, STRING, held, map_text, unpacked

SAMPLE_CHARS = 24_000  # of each language, at most
SAMPLE_DOCS = 64  # of each language, at most
ALPHABET = 62  # most frequent letters of the samples; 0 is any non-letter, 1 any other letter
PIECE = 1024
LANES = 4096  # pieces that walk together
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """states x width next states (0 is the start, -1 no such substring) of all substrings of `codes`."""
    most = 2 * len(codes) + 2
    step = np.full((most, width), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and step[p, c] == -1:
            step[p, c] = now
            p = link[p]
        if p != -1:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step[copy] = step[q]
                link[q] = link[now] = copy
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
        last = now
    return step[:len(length)]


class Parser:
    """The languages' automata in one table, with a phrase count for each step taken."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        seen = Counter(c for _, text in samples for c in text.lower() if c.isalpha())
        common = sorted(seen, key=lambda c: (-seen[c], c))[:ALPHABET]
        self.width = len(common) + 2
        self.code = np.where(letters(), 1, 0).astype(np.uint8)
        for i, c in enumerate(common):
            self.code[ord(c)] = i + 2
            if len(c.upper()) == 1:
                self.code[ord(c.upper())] = i + 2
        self.names = [name for name, _ in samples]
        self.bits, tables, self.start = [], [], []
        base = 0
        for _, text in samples:
            codes = self.code[points(text)]
            step = suffix_automaton(codes, self.width)
            root = np.where(step[0] < 0, 0, step[0])
            # where no substring goes on, a new phrase starts with this character; the start state is met
            # only before the first character and behind one that no substring has
            ends = step < 0
            ends[0] = True
            to = np.where(ends, root[None, :], step)
            tables.append(((to + base) * self.width * 2 + ends).ravel())
            self.start.append(base * self.width * 2)
            self.bits.append(np.log2(max(2, len(codes))))
            base += len(step)
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """languages x pieces: phrases that each piece of character codes takes. Longest pieces first."""
        size = np.array([len(p) for p in pieces])
        grid = np.zeros((size[0], len(pieces)), np.int32)
        for i, p in enumerate(pieces):
            grid[:len(p), i] = p
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(pieces), axis=1)
        count = np.zeros(state.shape, np.int32)
        alive = len(pieces)
        for row, chars in enumerate(grid):
            while size[alive - 1] <= row:
                alive -= 1
            now = self.table[(state[:, :alive] >> 1) + chars[:alive]]
            count[:, :alive] += now & 1
            state[:, :alive] = now
        return count

    def costs(self, texts: list[str]) -> np.ndarray:
        """texts x languages: bits per character."""
        pieces, owner, size = [], [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            codes = self.code[points(t)]
            size[i] = len(codes)
            for at in range(0, len(codes), PIECE):
                pieces.append(codes[at:at + PIECE])
                owner.append(i)
        total = np.zeros((len(texts), len(self.names)))
        order = sorted(range(len(pieces)), key=lambda j: -len(pieces[j]))
        for at in range(0, len(order), LANES):
            part = order[at:at + LANES]
            np.add.at(total, np.array([owner[j] for j in part]), self.phrases([pieces[j] for j in part]).T)
        return total * np.array(self.bits)[None, :] / np.maximum(size, 1)[:, None]


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One per worker process."""
    return held(("langid", samples), lambda: Parser(samples))


def labelled_sample(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) from the rows where `train` holds: at most SAMPLE_DOCS rows and SAMPLE_CHARS characters a language.

    Rows come in the order of a hash of key and text, so the sample is the same in every run and does not
    grow with the table. Of a longer text the first SAMPLE_CHARS characters are learned from. Each task keeps its best rows per language before the shuffle.
    """
    rows = docs.filter(train).select(F.col(lang).alias("lang"), F.substring(text, 1, SAMPLE_CHARS).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = rows.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_DOCS).collect()
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.nth)):
        out[r.lang] = (out.get(r.lang, "") + "\n" + r.text)[:SAMPLE_CHARS]
    return tuple(sorted(out.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, the winner's share of the inverse costs (0 to 1).

    Null text and text without a letter give `und` and 0; so does an empty sample. Ties go to the first
    language by name. Repeated rows get equal results.
    """
    def predict(texts: list[str | None]) -> list:
        model = parser(samples)
        texts = [t or "" for t in texts]
        fit = [i for i, t in enumerate(texts) if samples and t and letters()[points(t)].any()]
        name, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        if fit:
            cost = np.maximum(model.costs([texts[i] for i in fit]), 1e-12)
            name[fit] = np.array(model.names, dtype=object)[cost.argmin(axis=1)]
            score[fit] = (1 / cost.min(axis=1)) / (1 / cost).sum(axis=1)
        return [name, score]

    made = map_text(docs, text, predict, {"lang_pred": STRING, "score": DOUBLE})
    return unpacked(made, docs, lang_pred=F.col("lang_pred"), score=F.col("score"))
