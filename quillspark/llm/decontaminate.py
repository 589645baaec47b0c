"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by ``RATE`` * m edits, e in all.  It is cut into
e + 1 pieces; e edits leave one of them whole, so every occurrence holds a piece
exactly.  The pieces of a block of items form one Aho-Corasick automaton; a document
is passed through it once.  Hits on one item that imply nearly the same place merge,
and each place is verified by Myers' bit-parallel distance between the whole item and
the best fitting stretch of the text.

Texts and items are compared lower-cased, as words joined by one space; what isn't a
letter, digit or underscore separates words.

Items are taken in blocks of ``BLOCK`` characters: the automaton that goes to the
executors has a proven size, however large the benchmark; each further block is one
more pass.  A document's work grows with its own hits only; nothing is exchanged.

Defined cases: an item too short to differ counts where it is whole words, not inside
of one; a null or empty text holds nothing; items without a word, or a null,
match nothing; an item that occurs often in a document is one row, its best place.
Repeated documents each give their rows, repeated items too (under each item_id).
Empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, text_of

#: Edits per character of an item that still count as the item.
RATE = 0.08
#: Characters of items in one automaton.
BLOCK = 4_000_000
_WORD = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length that make up the item."""
    n = min(edits + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to the item; the first of equals."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (~(xh | vp) & full)
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        # A match may start anywhere: no carry enters the first row.
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = hn | (~(xv | hp) & full)
        vn = hp & xv
        if score < best:
            best, end = score, at
    return best, end


def automaton(items: list[tuple[int, str]], rate: float = RATE):
    """Of (number, normalised item): every piece -> its (number, offset)s."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, item in items:
        for offset, piece in pieces(item, budget(item, rate)):
            places.setdefault(piece, []).append((k, offset))
    found = ahocorasick.Automaton()
    for piece, at in places.items():
        found.add_word(piece, (len(piece), tuple(at)))
    found.make_automaton()
    return found


def matches(text: str, found, items: dict[int, str], rate: float = RATE) -> dict[int, tuple[int, int, int]]:
    """number -> (distance, start, end) of the best place of each item in a normalised text."""
    starts: dict[int, list[int]] = {}
    for last, (size, at) in found.iter(text):
        for k, offset in at:
            starts.setdefault(k, []).append(last + 1 - size - offset)
    out = {}
    for k, implied in starts.items():
        item = items[k]
        e = budget(item, rate)
        implied.sort()
        best = None
        low = high = implied[0]
        for s in [*implied[1:], None]:
            if s is not None and s - high <= e:
                high = s
                continue
            a, b = max(0, low - e), min(len(text), high + len(item) + e)
            if not e and (text[max(0, a - 1) : a].strip() or text[b : b + 1].strip()):
                low = high = s
                continue
            distance, end = myers(item, text[a:b])
            if distance <= e and (best is None or distance < best[0]):
                back, length = myers(item[::-1], text[a : a + end][::-1])
                best = (distance, a + end - (length if back == distance else len(item)), a + end)
            low = high = s
        if best:
            out[k] = best
    return out


def _blocks(items: list[tuple], size: int) -> list[list[tuple]]:
    out, used = [[]], 0
    for item in items:
        if out[-1] and used + len(item[-1]) > size:
            out.append([])
            used = 0
        out[-1].append(item)
        used += len(item[-1])
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits, allowed, start, end): a row per document and item it
    holds; start and end count characters of the normalised text."""
    parts = []
    for part in _item_blocks(benchmark, block):
        ids = {k: i for k, i, _ in part}
        parts.append(_find_block(doc_columns(docs, ("doc_id", "bigint"), ("text", "string")), [(k, t) for k, _, t in part], ids, rate))
    return reduce(DataFrame.unionAll, parts)


def _item_blocks(benchmark: DataFrame, block: int) -> list[list[tuple[int, int, str]]]:
    """(number, item_id, normalised text) of the items that have a word, in blocks; one block at least."""
    rows = doc_columns(benchmark, ("item_id", "bigint"), ("text", "string")).toLocalIterator()
    items = ((k, r["item_id"], normalised(r["text"])) for k, r in enumerate(rows))
    return _blocks([x for x in items if x[2]], block)


def _find_block(docs: DataFrame, part: list[tuple[int, str]], ids: dict[int, int], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((part, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids = shared.value
        items, found = dict(part), automaton(part, rate)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if items and (clean := normalised(text.as_py())):
                    out += [(doc_id, ids[k], d, budget(items[k], rate), a, b) for k, (d, a, b) in matches(clean, found, items, rate).items()]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], ["doc_id", "item_id", "edits", "allowed", "start", "end"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, edits int, allowed int, start bigint, end bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with all their columns.

    A document is judged where it is read: a filter for each block, no join.
    """
    for part in _item_blocks(benchmark, block):
        if part:
            docs = docs.filter(~_holds(docs, [(k, t) for k, _, t in part], rate)(text_of()))
    return docs


def _holds(docs: DataFrame, part: list[tuple[int, str]], rate: float):
    shared = docs.sparkSession.sparkContext.broadcast(part)

    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, found = dict(shared.value), automaton(shared.value, rate)
        for batch in texts:
            yield batch.map(lambda t: bool(matches(normalised(t), found, items, rate))).astype(bool)

    return holds
