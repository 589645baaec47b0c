"""Secret scans: all rules in one deterministic automaton over bytes, in one pass.

Every rule's regular expression becomes part of one nondeterministic automaton
behind "any bytes"; subset construction makes it deterministic, partition
refinement minimises it, and the result is one flat transition array (state + byte
-> state).  A pass over a text's UTF-8 bytes looks up one entry a byte and tells
where some rule first accepts.  From there the rule's reversed automaton finds the
leftmost start, and its anchored one the longest end.  Conditions that regular
expressions state badly (least lengths) are exact checks on the found span.

The tables are built once on the driver from the fixed rules and shipped with the
task: their size depends on the rules alone.  In the common automaton a rule ends
where it first accepts (its last loop is left to the anchored one), which keeps the
product of the rules' states small.

Spans are code points, end exclusive, leftmost and non-overlapping per rule.
Defined cases: null text counts as empty; no finding gives zero counts, an empty
``spans`` and the digest of the empty string.  Repeated rows each give a row; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    #: Of a found span's text: whether it counts.  A span that fails is used up all the same.
    keep: Callable[[bytes], bool] = lambda found: True


def _value_is_long(found: bytes) -> bool:
    return len(re.search(rb"[:=] *[\"']?([A-Za-z0-9+/_.=-]+)$", found)[1]) >= 8


# The three rules that every scan has, in the order of their kinds.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", _value_is_long),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What this scan adds.
ADDED = (
    Rule("pem", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 20),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", lambda m: len(m) >= 39),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m) >= 40),
)
RULES = BASE + ADDED


# --- From a pattern to a nondeterministic automaton -------------------------------------------


class _Parser:
    """Literals, escapes, classes, groups, ``(?i:...)``, alternation and ``? * + {n} {n,} {n,m}``.

    A node is ("set", bytes), ("cat", nodes), ("alt", nodes) or ("rep", node, least, most or None).
    """

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.s}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                m = re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.s, self.i)
                self.i = m.end()
                least = int(m[1])
                node = ("rep", node, least, int(m[3]) if m[3] else None if m[2] else least)
            else:
                self.i += 1
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.peek()
        if c == "(":
            fold = self.fold
            for opening, sets in (("(?i:", True), ("(?:", fold), ("(", fold)):
                if self.s.startswith(opening, self.i):
                    self.i += len(opening)
                    self.fold = sets
                    break
            node = self.alternatives()
            self.fold = fold
            self.i += 1
            return node
        if c == "[":
            return ("set", self.klass())
        return ("set", self.folded({self.char()}))

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())}
        return frozenset(found)

    def klass(self) -> frozenset[int]:
        self.i += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.i += 1
        return self.folded(found)


class _Nfa:
    def __init__(self):
        self.silent: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.silent.append([])
        self.steps.append([])
        return len(self.steps) - 1

    def add(self, node, start: int, backwards: bool) -> int:
        """Build ``node`` behind ``start``; its last state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in reversed(node[1]) if backwards else node[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                first = self.state()
                self.silent[start].append(first)
                self.silent[self.add(option, first, backwards)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start, backwards)
        if most is None:
            loop, end = self.state(), self.state()
            self.silent[start] += [loop]
            self.silent[loop].append(end)
            self.silent[self.add(inner, loop, backwards)].append(loop)
            return end
        end = self.state()
        self.silent[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start, backwards)
            self.silent[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state + byte]``; states are multiples of 256; ``accepts[state >> 8]`` is a mask of rules."""

    step: tuple[int, ...]
    start: int
    accepts: tuple[int, ...]
    dead: int


def _shortest(node):
    """``node`` without the free repetitions at its end: it accepts where ``node`` first does."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if node[0] == "rep" and node[3] is None and node[2]:
        return ("rep", node[1], node[2], node[2])
    return node


def compile_rules(rules, backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One minimal deterministic automaton for all rules' patterns; ``anywhere``: behind any bytes, up to the first accept."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, rule in enumerate(rules):
        first = nfa.state()
        nfa.silent[root].append(first)
        tree = _Parser(rule.pattern).parse()
        ends[nfa.add(_shortest(tree) if anywhere else tree, first, backwards)] = 1 << k
    if anywhere:
        nfa.steps[root].append((frozenset(range(256)), root))

    def closed(states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in nfa.silent[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    # Bytes that no rule tells apart share a column while the subsets are built.
    marks: dict[int, list[int]] = {b: [] for b in range(256)}
    for k, chosen in enumerate({c for steps in nfa.steps for c, _ in steps}):
        for b in chosen:
            marks[b].append(k)
    kinds: dict[tuple, int] = {}
    of_byte = [kinds.setdefault(tuple(marks[b]), len(kinds)) for b in range(256)]
    sample = [of_byte.index(k) for k in range(len(kinds))]
    numbers = {closed([root]): 0}
    order, table = list(numbers), []
    for subset in order:
        row = []
        for b in sample:
            after = closed({t for s in subset for chosen, t in nfa.steps[s] if b in chosen})
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        table.append(row)
    accepts = [sum({ends[s] for s in subset if s in ends}) for subset in order]
    # Minimisation: refine the partition by what is accepted until rows agree in every block.
    block = accepts
    while True:
        names: dict[tuple, int] = {}
        refined = [names.setdefault((block[i], *(block[t] for t in row)), len(names)) for i, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = refined
    count = len(names)
    flat, masks = [0] * (256 * count), [0] * count
    for i, row in enumerate(table):
        masks[refined[i]] = accepts[i]
        for b in range(256):
            flat[256 * refined[i] + b] = 256 * refined[row[of_byte[b]]]
    dead = next((256 * s for s in range(count) if not masks[s] and all(t == 256 * s for t in flat[256 * s : 256 * s + 256])), -1)
    return Automaton(tuple(flat), 256 * refined[0], tuple(masks), dead)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    all: Automaton
    loud: frozenset[int]
    back: tuple[Automaton, ...]
    ahead: tuple[Automaton, ...]


@cache
def scanner() -> Scanner:
    """The tables of ``RULES``, once a process."""
    common = compile_rules(RULES, anywhere=True)
    loud = frozenset(256 * i for i, m in enumerate(common.accepts) if m)
    return Scanner(RULES, common, loud, tuple(compile_rules([r], backwards=True) for r in RULES), tuple(compile_rules([r]) for r in RULES))


def find_spans(data: bytes, tables: Scanner) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes, by start and then rule."""
    step, state, marks = tables.all.step, tables.all.start, tables.all.accepts
    loud = tables.loud
    used = [0] * len(tables.rules)
    found = []
    at = 0
    for byte in data:
        state = step[state + byte]
        at += 1
        if state in loud:
            mask = marks[state >> 8]
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if at <= used[k]:
                    continue
                back = tables.back[k]
                s, first, i = back.start, -1, at
                while i > used[k] and s != back.dead:
                    i -= 1
                    s = back.step[s + data[i]]
                    if back.accepts[s >> 8]:
                        first = i
                if first < 0:
                    continue
                ahead = tables.ahead[k]
                s, last = ahead.start, at
                for i in range(first, len(data)):
                    s = ahead.step[s + data[i]]
                    if ahead.accepts[s >> 8]:
                        last = i + 1
                    elif s == ahead.dead:
                        break
                used[k] = last
                if tables.rules[k].keep(data[first:last]):
                    found.append((first, last, k))
    found.sort(key=lambda f: (f[0], f[2]))
    return found


def text_spans(text: str | None, tables: Scanner) -> list[tuple[int, int, int]]:
    """:func:`find_spans` in code points."""
    data = (text or "").encode()
    found = find_spans(data, tables)
    if not found or len(data) == len(text):
        return found
    places = sorted({p for a, b, _ in found for p in (a, b)})
    point, last, chars = {}, 0, 0
    for p in places:
        chars += len(data[last:p].decode())
        point[p], last = chars, p
    return [(point[a], point[b], k) for a, b, k in found]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, findings), a row per document; findings are (kind, start, end, base)."""
    base = len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            each = [[{"kind": RULES[k].name, "start": a, "end": b, "base": k < base} for a, b, k in text_spans(t.as_py(), tables)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, kind)], ["doc_id", "findings"])

    return doc_columns(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(run, "doc_id bigint, findings array<struct<kind:string,start:int,end:int,base:boolean>>")


def mask_secrets(text: str | None) -> str:
    """The text with every finding replaced by its kind in brackets."""
    text = text or ""
    out, last = [], 0
    for a, b, k in text_spans(text, scanner()):
        if a >= last:
            out += [text[last:a], f"[{RULES[k].name}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
