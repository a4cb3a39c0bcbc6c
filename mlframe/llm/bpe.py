"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A text is normalised and cut by the tokenizer's own front end, word by word. The merges run in a
transducer that reads one symbol at a time. Two facts make it stream: a sequence of tokens is what the
merge list makes of its symbols exactly if it makes every two neighbours of themselves; and a prefix has
one such sequence. So the transducer needs, per prefix, only the last token: the one that fits behind the
last token of the prefix in front of it. A later token starts at most `lookahead` symbols back, that being
the longest token the merge list can build; once the token chains of the last `lookahead` prefixes agree
on a boundary, everything in front of it is final and is emitted, and the buffer is cut there.

That last token is the transducer's state, and it depends on the prefix alone. Pieces that fit the buffer
many times over and share their beginnings therefore share states: `Merges.state` keeps those of
prefixes, and only those that a boundary may fall on are asked for. Longer pieces are streamed (`settled`).

Decoding is a state machine over ids as well: one step per id, a partial character carried over.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import BINARY, LONG, STRING, Cache, held, map_text, unpacked

NEVER = 1 << 62
CACHED_CHARS = 64  # longer words are encoded afresh, so the cache stays small
STOPS = ".,!?;:#$%&*|"  # signs behind a word that the short way of the front end knows
STOP_BYTES = STOPS.encode()
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Merges:
    """The merge list: symbols, tokens by their symbols, and the pairs that stay apart."""

    def __init__(self, model: dict):
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        glue = lambda a, b: a + b
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[glue(a, b)]) for r, (a, b) in enumerate(pairs)}
        self.made = {self.ids[glue(a, b)]: (r, self.ids[a], self.ids[b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for token in self.ids.values():
            self.spell(token)
        self.size = {t: len(s) for t, s in self.symbols.items()}
        #: Ends of tokens -> token, or -1 where the end alone is none: inside a word, and at its end.
        self.inner, self.final = {}, {}
        for name, t in self.ids.items():
            if self.merge(self.symbols[t]) == [t]:
                at_end = self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix)
                table, name = (self.final, name.removesuffix(self.suffix)) if at_end else (self.inner, name)
                table[name] = t
                for i in range(1, len(name)):
                    table.setdefault(name[i:], -1)
        self.final = self.final if self.suffix else self.inner
        #: The sufficient lookahead of the merge list, in symbols.
        self.lookahead = max(map(len, [*self.inner, *self.final]), default=1)
        self.apart = Cache(self.stay_apart, 200_000)
        self.state = Cache(partial(self.ending, find=self.inner.get), 100_000)

    def stay_apart(self, pair: int) -> bool:
        """Whether two tokens side by side stay as they are.

        Undo their merges, the latest first, and look at the two tokens that touch. Their own rule would have
        come first if it stands before the merge that ends either of them; on a tie the left place goes first.
        """
        a, b, a_ends, b_ends = pair >> 32, pair & 0xFFFFFFFF, NEVER, NEVER
        while True:
            rule = self.rank.get((a, b))
            if rule and rule[0] < a_ends and rule[0] <= b_ends:
                return False
            a_made, b_made = self.made.get(a), self.made.get(b)
            if a_made is None and b_made is None:
                return True
            if b_made is None or (a_made is not None and a_made[0] > b_made[0]):
                a_ends, a = a_made[0], a_made[2]
            else:
                b_ends, b = b_made[0], b_made[1]

    def ending(self, prefix: str, find) -> int:
        """The last token of a prefix: the longest that fits behind the last token of the prefix in front of it."""
        fits, end = [], len(prefix)
        for start in range(end - 1, max(end - self.lookahead, 0) - 1, -1):
            token = find(prefix[start:])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
        for start, token in reversed(fits):
            if not start or self.apart[self.state[prefix[:start]] << 32 | token]:
                return token
        raise ValueError("the merge list does not build its tokens from single symbols")

    def short(self, piece: str) -> list[int]:
        """Ids of a pre-token of at most CACHED_CHARS symbols (states call each other), as `transduce` gives them."""
        out = [self.ending(piece, self.final.get)]
        end = len(piece) - self.size[out[0]]
        while end:
            out.append(self.state[piece[:end]])
            end -= self.size[out[-1]]
        return out[::-1]

    def spell(self, token: int) -> tuple[int, ...]:
        """The symbols of a token, by undoing its merges."""
        if token not in self.symbols:
            todo, out = [token], []
            while todo:
                t = todo.pop()
                if t in self.made:
                    todo += reversed(self.made[t][1:])
                else:
                    out.append(t)
            self.symbols[token] = tuple(out)
        return self.symbols[token]

    def merge(self, symbols) -> list[int]:
        """Plain merging of a short sequence: always the earliest rule in the list, leftmost first."""
        out = list(symbols)
        while len(out) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
            if best is None:
                break
            (_, new), i = best
            out[i:i + 2] = [new]
        return out


class FrontEnd:
    """The tokenizer's own normaliser and pre-tokenizer, on words, and its added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normal, self.cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # if it lower-cases letters and parts them from the stops behind them, plain words need no call of it
        self.simple = self.full("Qwertyuiopasdfghjklzxcvbnm" + STOPS) == ["qwertyuiopasdfghjklzxcvbnm", STOPS]
        # the same for letters of two bytes, if it spells these byte by byte
        wide = "".join(map(chr, range(0xC0, 0x100))).replace("\u00d7", "").replace("\u00f7", "")
        self.latin = self.simple and self.full(wide + "A" + STOPS) == [spelled(wide.lower() + "a"), STOPS]
        # leftmost, then longest; such plain words hold none of them if each has another sign
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.plain = self.simple and all(LATIN.sub("", a).strip(STOPS) for a in self.added)

    def full(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [p for p, _ in self.cut.pre_tokenize_str(text)] if self.cut else [text]

    def letters(self, core: bytes) -> str | None:
        """The pre-token of a run of letters alone, or None if the front end has to be asked."""
        if core.isalpha():
            return core.lower().decode()
        if self.latin and LATIN.fullmatch(text := core.decode()):
            return spelled(text.lower())
        return None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without white space and added tokens."""
        if self.simple:
            core = text.rstrip(STOPS)
            if (lower := self.letters(core.encode())) is not None:
                return [lower, text[len(core):]] if len(core) < len(text) else [lower]
        return self.full(text)

    def parts(self, word: bytes) -> list[str | int]:
        """Pre-tokens of a word and ids of the added tokens in it, leftmost and longest first."""
        if self.plain:
            core = word.rstrip(STOP_BYTES)
            if (lower := self.letters(core)) is not None:
                return [lower] if len(core) == len(word) else [lower, word[len(core):].decode()]
        text, out, at = word.decode(), [], 0
        for hit in self.marks.finditer(text) if self.marks else ():
            if hit.start() > at:
                out += self.pieces(text[at:hit.start()])
            out.append(self.added[hit.group()])
            at = hit.end()
        return out + self.pieces(text[at:]) if at < len(text) else out


def transduce(m: Merges, piece: str, hold: int | None = None) -> Iterator[int]:
    """Ids of one pre-token, read symbol by symbol; at most about `hold` symbols wait at a time."""
    return chain.from_iterable(settled(m, piece, hold))


def settled(m: Merges, piece: str, hold: int | None = None) -> Iterator[list[int]]:
    """The ids of `transduce`, in the blocks that become final together."""
    hold = hold or 8 * m.lookahead
    base, before, last = 0, -1, []  # what is emitted ends at base, in token before; last[j]: last token of piece[:base + j + 1]
    size, apart, total, reach, find = m.size, m.apart, len(piece), m.lookahead, m.inner.get

    def bounds(end: int) -> list[int]:
        out = [end]
        while end > base:
            end -= size[last[end - base - 1]]
            out.append(end)
        return out

    def taken(upto: int) -> list[int]:
        out = []
        while upto > base:
            out.append(last[upto - base - 1])
            upto -= size[out[-1]]
        return out[::-1]

    for end in range(1, total + 1):
        if end == total:
            find = m.final.get
        fits, start = [], end - 1
        stop = end - reach if end - reach > base else base
        while start >= stop:
            token = find(piece[start:end])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
            start -= 1
        for start, token in reversed(fits):
            ahead = last[start - base - 1] if start > base else before
            if ahead < 0 or apart[ahead << 32 | token]:
                last.append(token)
                break
        else:
            raise ValueError("the merge list does not build its tokens from single symbols")
        if end - base >= hold and end < total:
            common = set(bounds(end))
            for e in range(max(base + 1, end - reach + 1), end):
                common &= set(bounds(e))
            if (upto := max(common)) > base:
                yield (out := taken(upto))
                del last[:upto - base]
                base, before = upto, out[-1]
    yield taken(total)


class Codec:
    """Encoder and decoder for a tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.front = FrontEnd(path)
        self.merges = Merges(spec["model"])
        self.names = {i: t for t, i in spec["model"]["vocab"].items()}
        self.names.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.piece = Cache(self.fresh, 120_000)
        self.word = Cache(self.encode_word, 200_000)

    def fresh(self, piece: str) -> bytes:
        """Ids of a pre-token; one too long for the cache streams."""
        if len(piece) <= CACHED_CHARS:
            ids = self.merges.short(piece)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([struct.pack(f"<{len(ids)}I", *ids) for ids in settled(self.merges, piece)])

    def encode_piece(self, piece: str | int) -> bytes:
        if isinstance(piece, int):
            return struct.pack("<I", piece)
        return self.piece[piece] if len(piece) <= CACHED_CHARS else self.fresh(piece)

    def encode_word(self, word: bytes) -> bytes:
        """Ids of a text without white space."""
        return b"".join(map(self.encode_piece, self.front.parts(word)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        words = text.encode().split() if text else []
        if max(map(len, words), default=0) <= CACHED_CHARS:
            return b"".join(map(self.word.__getitem__, words))
        return b"".join([self.word[w] if len(w) <= CACHED_CHARS else self.encode_word(w) for w in words])

    def decode(self, ids: bytes, step: int = 4096) -> str:
        """The text of ids, special tokens included, `step` ids at a time.

        Without a decoder in the file the token strings are joined by blanks, as the library does; with the
        byte-level one their bytes are put together, and bytes that are no character become U+FFFD.
        """
        numbers, out = np.frombuffer(ids, "<u4"), []
        carry = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(numbers), step):
            names = map(self.names.__getitem__, numbers[at:at + step].tolist())
            if self.decoder == "ByteLevel":
                out.append(carry.decode(b"".join(map(token_bytes, names))))
            else:
                out.append(" " * (at > 0) + " ".join(names))
        return "".join(out) + carry.decode(b"", True)


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def letter_table() -> dict[int, str]:
    return {b: c for c, b in byte_letters().items()}


def spelled(text: str) -> str:
    """A text in the letters that stand for its bytes."""
    return text.encode().decode("latin-1").translate(letter_table())


def token_bytes(name: str) -> bytes:
    table = byte_letters()
    return bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()


def codec(path: str) -> Codec:
    """One per worker process."""
    return held(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """`docs` with `ids` (binary, little-endian unsigned 32-bit) and `n_tokens` of each whole text; null counts as empty.

    With `decoded`, also the text that these ids decode to, from the same pass: each function that maps
    batches has Python workers of its own, and a second one would load the vocabulary once more.
    """
    def run(texts: list[str | None]) -> list:
        coder = codec(path)
        coded = [coder.encode(t) for t in texts]
        return [coded, [len(c) // 4 for c in coded], *([[coder.decode(c) for c in coded]] if decoded else [])]

    fields = {"ids": BINARY, "n_tokens": LONG, **({"decoded": STRING} if decoded else {})}
    return unpacked(map_text(docs, text, run, fields), docs, **{name: F.col(name) for name in fields})


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`docs` with `decoded`, the text of the ids; null ids give empty text."""
    def run(coded: list[bytes | None]) -> list:
        return [[codec(path).decode(c or b"") for c in coded]]

    made = map_text(docs, ids, run, {"decoded": STRING})
    return unpacked(made, docs, decoded=F.col("decoded"))
