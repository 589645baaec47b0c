"""Texts analyzed in Arrow batches: each distinct word of a batch is finished once, not each word of a text.

For analyzers that know what stands between their words (``Analyzer.gaps``).  A record is one
row, so its postings are complete where it is read and nothing is exchanged for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillspark.functions.analysis import Analyzer

#: Bytes of text that are analyzed together, and rows that are given on together.
SLICE, ROWS = 1 << 24, 1 << 16


@dataclass
class Words:
    """The words of some texts: text number, place and term number of each; each text's length; the terms."""

    rows: np.ndarray
    places: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray
    terms: list[str]


def words(texts: pa.Array, analyzer: Analyzer) -> Words:
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), analyzer.gaps)
    coded = lists.flatten().dictionary_encode()
    finish, gone, found = analyzer.finish_word, set(analyzer.stop_words), {}
    number = np.full(len(coded.dictionary), -1, np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        low = word.lower()
        if low and low not in gone:
            number[i] = found.setdefault(finish(low) if finish else low, len(found))
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    numbers = number[coded.indices.to_numpy()] if len(number) else np.empty(0, np.int64)
    rows, numbers = rows[numbers >= 0], numbers[numbers >= 0]
    lengths = np.bincount(rows, minlength=len(texts))
    places = np.arange(len(rows)) - (np.cumsum(lengths) - lengths)[rows]
    return Words(rows, places, numbers, lengths, list(found))


@dataclass
class Groups:
    """Postings by term, then text: the places of posting i are places[starts[i]:starts[i + 1]]."""

    numbers: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    @property
    def tf(self) -> np.ndarray:
        return np.diff(self.starts)


def grouped(w: Words, wanted: np.ndarray | None = None) -> Groups:
    """Postings of all terms, or of those whose number is marked in ``wanted``."""
    rows, places, numbers = w.rows, w.places, w.numbers
    if wanted is not None:
        held = wanted[numbers]
        rows, places, numbers = rows[held], places[held], numbers[held]
    key = numbers * max(len(w.lengths), 1) + rows
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return Groups(numbers[order][first], rows[order][first], np.r_[first, len(key)], places[order])


def slices(batch: pa.RecordBatch, texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded size of text; one row at least."""
    size = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(n)), 0), np.int64) for n in texts)
    ends = np.cumsum(size)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def run(records: DataFrame, texts: Sequence[str], each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` on every slice of the records."""

    def batches(parts):
        for batch in parts:
            for part in slices(batch, texts):
                out = each(part)
                for i in range(0, out.num_rows if out is not None else 0, ROWS):
                    yield out.slice(i, ROWS)

    return records.mapInArrow(batches, schema)


def marked(terms: list[str], keep: Callable[[str], bool] | None) -> np.ndarray | None:
    return None if keep is None else np.fromiter((keep(t) for t in terms), bool, len(terms))


def postings(records: DataFrame, fields: dict[str, Analyzer], positions: bool, keep: frozenset[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(*carry, field, term, doc_id, tf, doc_length, positions?) of records (*carry, doc_id, a text a field)."""
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    own = [*carry, "doc_id"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), f"field string, term string, doc_id {types['doc_id']}, tf int, doc_length int", *(["positions array<int>"] if positions else [])])
    names = [*carry, "field", "term", "doc_id", "tf", "doc_length", *(["positions"] if positions else [])]

    def each(part):
        out = []
        for name, analyzer in fields.items():
            w = words(part.column(name), analyzer)
            g = grouped(w, marked(w.terms, None if keep is None else keep.__contains__))
            rows = pa.array(g.rows)
            columns = {c: part.column(c).take(rows) for c in own}
            columns["field"] = pa.array([name]).take(pa.array(np.zeros(len(g.rows), np.int64)))
            columns["term"] = pa.array(w.terms, pa.string()).take(pa.array(g.numbers))
            columns["tf"], columns["doc_length"] = pa.array(g.tf.astype(np.int32)), pa.array(w.lengths[g.rows].astype(np.int32))
            if positions:
                columns["positions"] = pa.ListArray.from_arrays(pa.array(g.starts.astype(np.int32)), pa.array(g.places.astype(np.int32)))
            out.append(pa.RecordBatch.from_arrays([columns[n] for n in names], names))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(b.num_rows for b in out) else None

    return run(records, list(fields), each, schema)


def lengths(records: DataFrame, fields: dict[str, Analyzer], carry: Sequence[str]) -> DataFrame:
    """(*carry, field, length): a row a record and field."""
    types = {f.name: f.dataType.simpleString() for f in records.schema}

    def each(part):
        out = []
        for name, analyzer in fields.items():
            w = words(part.column(name), analyzer)
            out.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array([name] * part.num_rows), pa.array(w.lengths.astype(np.int32))], [*carry, "field", "length"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if part.num_rows else None

    return run(records, list(fields), each, ", ".join([*(f"`{c}` {types[c]}" for c in carry), "field string, length int"]))


def counts(records: DataFrame, fields: dict[str, Analyzer], keep: Callable[[str], bool] | None = None, terms: bool = True) -> DataFrame:
    """(field, term, n, total) in parts to be summed: a term's documents, and under a null term all documents with their words."""

    def each(part):
        out = []
        for name, analyzer in fields.items():
            w = words(part.column(name), analyzer)
            out.append((name, None, part.num_rows, int(w.lengths.sum())))
            if terms:
                g = grouped(w, marked(w.terms, keep))
                df = np.bincount(g.numbers, minlength=len(w.terms))
                out += [(name, w.terms[i], int(df[i]), 0) for i in np.flatnonzero(df)]
        field, term, n, total = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(field), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["field", "term", "n", "total"])

    return run(records, list(fields), each, "field string, term string, n bigint, total bigint")
