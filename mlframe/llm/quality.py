"""Quality rules, line first: judge each line, drop the failing ones, then judge what the document lost.

A line fails as
* navigation: at most `NAV_WORDS` words, no sentence end, and a separator or a menu word in it;
* boilerplate: at most `BOILER_WORDS` words and a phrase of the list in it;
* punctuation: over half of its characters other than blanks are neither letters nor digits.
A document is rejected if the failing lines hold more than `MOST_LOST` of its word characters, or if
no line is left.
"""

from __future__ import annotations

import re
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import BOOL, LONG, STRING, map_text, unpacked

NAV_WORDS, BOILER_WORDS, MOST_LOST = 12, 40, 0.5
END = re.compile(r"""[.!?…。！？]["'”’»)\]]*$""")
NAV = re.compile(r"[|>»›•·]|\b(home|menu|login|log in|sign in|sign up|search|next|previous|contact us|about us|site map)\b", re.I)
BOILER = re.compile(r"all rights reserved|terms of (use|service)|privacy policy|cookie|copyright|©|enable javascript|"
                    r"subscribe to|click here|share (this|on)|powered by|lorem ipsum", re.I)
SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS, REPEAT_PERCENT, RUN = 50, 50, 3


def bad_line(line: str) -> str | None:
    """The rule that a line with a word fails, or None."""
    words = len(line.encode().split())
    body = "".join(line.split())
    if sum(map(str.isalnum, body)) * 2 < len(body):
        return "punctuation"
    if words <= NAV_WORDS and not END.search(line.rstrip()) and NAV.search(line):
        return "navigation"
    if words <= BOILER_WORDS and BOILER.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < RUN + 1:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[which] > 1
    cover = np.zeros(len(words), bool)
    for i in range(RUN):
        cover[i:len(hit) + i] |= hit
    return int(cover.sum())


def measure(text: str) -> tuple[int, int, int, int, int, bool, bool, str]:
    """(words, their characters, symbols, duplicate lines, repeated words, base_failed, kept, cleaned text)."""
    words = text.encode().split()
    lines, seen, duplicates, left, chars, lost = text.split("\n"), set(), 0, [], 0, 0
    for line in lines:
        parts = line.encode().split()
        if not parts:
            left.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        size = len(b"".join(parts).decode())
        chars += size
        if bad_line(line):
            lost += size
        else:
            left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    kept = not failed and lost <= MOST_LOST * chars
    return len(words), chars, len(SYMBOL.findall(text)), duplicates, repeated, failed, kept, "\n".join(left)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept, clean_text.

    Null text counts as empty (and stays null in clean_text): no words, failed, not kept. Each row is judged by
    itself, so repeated rows get equal results and other columns pass through.
    """
    fields = {"n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG,
              "base_failed": BOOL, "kept": BOOL, "clean_text": STRING}

    def verdicts(texts: list[str | None]) -> list:
        columns = [list(c) for c in zip(*(measure(t or "") for t in texts))] or [[] for _ in fields]
        columns[-1] = [None if t is None else c for t, c in zip(texts, columns[-1])]
        return columns

    made = map_text(docs, text, verdicts, fields)
    return unpacked(made, docs, **{n: F.col(n) for n in fields})
