"""Secret scanning with one deterministic automaton for all rules.

The rules' regexes are parsed by the standard library, turned into one nondeterministic automaton over
bytes that may start anywhere, made deterministic by subset construction and minimised by partition
refinement. A text is one pass of table look-ups over its bytes. Each accepting state names the rules
of which a match may end there; as every rule ends in a repeated class, a run of such states ends where
the match ends. From there a small automaton of the reversed rule, read backwards, finds the leftmost
start. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import map_text, unpacked

KEYWORDS = "(password|passwd|secret|token|api_?key)"
ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYWORDS)

#: kind -> (regex over bytes, least length of its last group). The first three are the base kinds.
#: The automaton counts only four characters of `hex`: a longer count would multiply with the states of all other rules.
RULES: dict[str, tuple[str, int]] = {
    "assign": (ANY_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA([A-Z0-9]+)", 16),
    "hex": (r"([0-9a-f]{4}[0-9a-f]*)", 24),
    "forge": (r"gh[opsur]_([A-Za-z0-9]+)", 36),
    "chat": (r"xox[abprs]-([A-Za-z0-9-]+)", 10),
    "webtoken": (r"eyJ[A-Za-z0-9_-]+\.eyJ([A-Za-z0-9_.-]+)", 20),
    "private": (r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY(-----+)", 5),
    "mapkey": (r"AIza([A-Za-z0-9_-]+)", 35),
}
BASE = ("assign", "access", "hex")


class Graph:
    """A nondeterministic automaton: byte sets on edges, plus empty edges."""

    def __init__(self):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def node(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, tree, at: int, backwards: bool) -> int:
        """Append a parsed regex after node `at`; the node in which it ends."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            kind = str(op)
            if kind in ("LITERAL", "IN"):
                end = self.node()
                self.step[at].append((byte_set(kind, arg), end))
                at = end
            elif kind == "SUBPATTERN":
                at = self.add(arg[-1], at, backwards)
            elif kind == "BRANCH":
                end = self.node()
                for branch in arg[1]:
                    self.free[self.add(branch, at, backwards)].append(end)
                at = end
            elif kind == "MAX_REPEAT":
                at = self.repeat(*arg, at, backwards)
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return at

    def repeat(self, low: int, high: int, body, at: int, backwards: bool) -> int:
        for _ in range(low):
            at = self.add(body, at, backwards)
        end = self.node()
        if str(high) == "MAXREPEAT":
            self.free[at].append(end)
            self.free[self.add(body, end, backwards)].append(end)
            return end
        for _ in range(high - low):
            self.free[at].append(end)
            at = self.add(body, at, backwards)
        self.free[at].append(end)
        return end

    def closed(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def byte_set(kind: str, arg) -> frozenset:
    if kind == "LITERAL":
        return frozenset([arg])
    out: set[int] = set()
    for op, x in arg:
        if str(op) not in ("LITERAL", "RANGE"):
            raise ValueError(f"not supported in a class: {op}")
        out |= {x} if str(op) == "LITERAL" else set(range(x[0], x[1] + 1))
    return frozenset(out)


def automaton(regexes: list[str], backwards: bool = False) -> tuple[bytes, np.ndarray, list[int]]:
    """(class of each byte, states x classes next states, bit mask of accepted rules per state), minimal.

    State 0 is the start. Forwards a match may start anywhere; backwards it starts at the first byte read.
    """
    graph, final = Graph(), {}
    start = graph.node()
    for i, r in enumerate(regexes):
        final[graph.add(re._parser.parse(r.encode()), start, backwards)] = 1 << i
    sets = {chars for edges in graph.step for chars, _ in edges}
    kinds: dict[tuple, int] = {}
    byte_class = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [byte_class.index(c) for c in range(len(kinds))]

    number, rows = {graph.closed([start]): 0}, []
    for now in (todo := list(number)):
        row = []
        for byte in sample:
            target = {end for n in now for chars, end in graph.step[n] if byte in chars}
            nxt = graph.closed(target if backwards else target | {start})
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({final[n] for n in s if n in final}) for s in number])
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = np.sort(np.unique(part, return_index=True)[1])  # by first appearance, so the start stays 0
    name = np.empty(len(first), np.int64)
    name[part[first]] = np.arange(len(first))
    return byte_class, name[part[table[first]]], [int(a) for a in accepts[first]]


@cache
def compiled(kinds: tuple[str, ...]):
    """The scanner: (byte classes, flat next-state list, first state, first accepting entry, masks, reversed rules).

    States are multiples of the class count, and accepting ones come last, so one comparison tells them.
    """
    byte_class, table, masks = automaton([RULES[k][0] for k in kinds])
    order = sorted(range(len(masks)), key=lambda s: masks[s] > 0)
    width, name = table.shape[1], np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    flat = (name[table[order]] * width).ravel().tolist()
    back = []
    for k in kinds:
        classes, t, m = automaton([RULES[k][0]], backwards=True)
        stuck = next((s for s in range(len(t)) if not m[s] and (t[s] == s).all()), -1)
        back.append((classes, t.tolist(), m, stuck))
    return byte_class, flat, int(name[0]) * width, width * sum(m == 0 for m in masks), [masks[s] for s in order], back


def scan(data: bytes, kinds: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all matches in bytes, sorted; leftmost and not overlapping within a kind.

    A match whose last group is too short is dropped but stays used up, as a regex search would have it.
    """
    byte_class, flat, state, accepting, masks, back = compiled(kinds)
    width, hits = len(flat) // len(masks), []
    for i, c in enumerate(data.translate(byte_class)):
        state = flat[state + c]
        if state >= accepting:
            hits.append((i, masks[state // width]))
    found, used = [], [0] * len(kinds)
    for j, (i, mask) in enumerate(hits):
        if j + 1 < len(hits) and hits[j + 1][0] == i + 1:
            mask &= ~hits[j + 1][1]
        for k in range(len(kinds)) if mask else ():
            if mask >> k & 1:
                classes, table, final, stuck = back[k]
                s, at, start = 0, i, None
                while at >= used[k] and s != stuck:
                    s = table[s][classes[data[at]]]
                    start = at if final[s] else start
                    at -= 1
                if start is not None:
                    used[k] = i + 1
                    regex, least = RULES[kinds[k]]
                    if len(re.fullmatch(regex.encode(), data[start:i + 1]).groups()[-1]) >= least:
                        found.append((start, k, i + 1))
    return sorted(found)


def find_secrets(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """`docs` with `secrets`: array<struct<kind, start, end>> over each whole text, by start, then kind as listed.

    Null and empty texts have none. Other columns pass through, whatever their names.
    """
    def spans(texts: list[str | None]) -> list:
        out = []
        for t in texts:
            data = (t or "").encode()
            got = scan(data, kinds)
            if got and len(data) > len(t):
                got = [(len(data[:a].decode()), k, len(data[:b].decode())) for a, k, b in got]
            out.append([{"kind": kinds[k], "start": a, "end": b} for a, k, b in got])
        return [out]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made = map_text(docs, text, spans, {"spans": ("array<struct<kind:string,start:long,end:long>>", kind)})
    return unpacked(made, docs, secrets=F.col("spans"))
