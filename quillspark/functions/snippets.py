"""Snippets around query terms.

``smart_snippet`` respects sentences and marks terms; it is a pandas UDF, for the top
rows only.  ``window_snippet`` is a plain window, as Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[.!?]\s+")
_SPACE = re.compile(r"\s+")
_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")


def sentence_start(text: str, position: int, back: int = 200) -> int:
    """Where the sentence around ``position`` begins: behind the last sentence end in reach,
    else behind the first gap past a quarter of it, else as far back as it reaches."""
    low = max(0, position - back)
    part = text[low:position]
    if ends := [m.end() for m in _SENTENCE.finditer(part)]:
        return low + ends[-1]
    gap = next((m for m in _SPACE.finditer(part) if m.start() >= len(part) // 4), None)
    return low + gap.end() if gap else low


def sentence_end(text: str, position: int, ahead: int = 200) -> int:
    """The same forwards: the first sentence end, else the last gap within three quarters."""
    part = text[position : position + ahead]
    if found := _SENTENCE.search(part):
        return position + found.end()
    gaps = [m.start() for m in _SPACE.finditer(part) if m.start() <= 3 * len(part) // 4]
    return min(position, len(text)) + (gaps[-1] if gaps else len(part))


def sentence_snippet(text: str, at: int, length: int, most: int = 300, context: int = 100) -> str:
    start = sentence_start(text, max(0, at - context), context)
    end = sentence_end(text, min(len(text), at + length + context), context)
    if end - start > most:
        middle = at + length // 2
        start, end = max(0, middle - most // 2), middle + most // 2
    return text[start:end].strip()


def highlight(snippet: str, terms: Sequence[str], marks: tuple[str, str] = ("[[", "]]"), most: int = 3) -> str:
    """Mark the first ``most`` matches, longer ones first where they start together; links stay as they are."""
    found = sorted(((m.start(), m.end()) for t in terms if t and len(t) >= 2 for m in re.finditer(re.escape(t), snippet, re.I)), key=lambda s: (s[0], -s[1]))
    links = [m.span() for m in _LINK.finditer(snippet)]
    chosen: list[tuple[int, int]] = []
    for a, b in found:
        if len(chosen) == most:
            break
        if not any(a < d and b > c for c, d in [*links, *chosen]):
            chosen.append((a, b))
    out, last = [], 0
    for a, b in chosen:
        out += [snippet[last:a], marks[0], snippet[a:b], marks[1]]
        last = b
    return "".join([*out, snippet[last:]])


def build_snippet(text: str | None, terms: Sequence[str], most: int = 300, context: int = 100, marks: tuple[str, str] = ("[[", "]]")) -> str:
    """Around the first match of any term, else the text's head."""
    if not text:
        return ""
    low = text.lower()
    found = [(at, -i, len(t)) for i, t in enumerate(terms) if t and (at := low.find(t.lower())) >= 0]
    if not found:
        return text[:most].strip()
    at, _, length = min(found, key=lambda f: (f[0], -f[1]))
    return highlight(sentence_snippet(text, at, length, most, context), terms, marks)


def smart_snippet(most: int = 200, context: int = 100, html: bool = False):
    marks = ("<mark>", "</mark>") if html else ("[[", "]]")

    @F.pandas_udf("string")
    def snippet(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([build_snippet(t, [] if w is None else list(w), most, context, marks) for t, w in zip(text, terms)], dtype=object)

    return snippet


def window_snippet(text: Column, terms: Sequence[str], most: int = 200, edge: int = 30) -> Column:
    """``most`` characters around the first match, cut at words near its ends, with dots where text is left out."""
    n = F.length(text)
    head = F.when(n > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    if not terms:
        return head
    places = [F.when(F.instr(F.lower(text), t.lower()) > 0, F.instr(F.lower(text), t.lower()) - 1) for t in terms]
    at = F.least(*places) if len(places) > 1 else places[0]
    low = F.greatest(at - most // 2, F.lit(0))
    over = low + most > n
    start = F.when(over, F.greatest(n - most, F.lit(0))).otherwise(low)
    stop = F.least(low + most, n)
    cut = F.substring(text, start + 1, stop - start)
    first = F.instr(cut, " ") - 1
    tail = F.when((first >= 0) & (first < edge), F.substring(cut, first + 2, n)).otherwise(cut)
    begun = F.when(start > 0, F.concat(F.lit("..."), tail)).otherwise(cut)
    size = F.length(begun)
    last = size - F.instr(F.reverse(begun), " ")
    ended = F.when((F.instr(begun, " ") > 0) & (last > size - edge), F.substring(begun, F.lit(1), last)).otherwise(begun)
    return F.when(at.isNull(), head).when(stop < n, F.concat(ended, F.lit("..."))).otherwise(begun)
