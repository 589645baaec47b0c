"""Exact substring deduplication: super-k-mers dealt to their minimiser's bucket.

A window is ``WINDOW`` consecutive words; its minimiser is the least hash of the
``MINIMISER``-word sequences in it.  Equal windows have equal minimisers, so
consecutive windows with one minimiser travel together as one packed string (a
super-k-mer) to that minimiser's bucket, where sorting counts windows exactly.

1. Count minimisers over all documents (8 bytes each, partially aggregated).  Those
   that occur twice set a bit in a bitmap of fixed size, ``FILTER_BITS``, the only
   thing broadcast.  Other windows can't have a twin and don't travel.  A second
   bitmap marks those that occur more than ``HOT`` times.  A saturated bitmap lets
   more travel, or by the other way of step 3; the result is the same.
2. Documents without a candidate are done where they are read.  Of the others the
   packed strings and the words go, with a row number, to a table in the shared folder.
3. A bucket's strings are streamed in key order and its windows sorted; it holds
   ``HOT`` places at most.  Strings of hotter minimisers fold first where they are
   equal (a passage in a third of all rows is one string), and each of their windows
   is dealt and counted by its own 128-bit digest, so no task holds a hot bucket.
4. Spans go back to their documents by row number.

Defined cases: null text has no words; texts shorter than a window lose nothing;
repeated rows are texts of their own, each the other's copy.  Rows with a null or
repeated doc_id are told apart by row number.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, written

WINDOW, MINIMISER = 35, 8
FILTER_BITS = 27
#: Windows in one packed string; places of a minimiser above which its windows are dealt one by one.
PACKED, HOT = 128, 1000
_ROWS = 2000


def minimisers(words: list[bytes], window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all ``size``-word sequences, the minimiser of every window)."""
    n = len(words) - size + 1
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(29)
    span, least = 1, rolled
    want = window - size + 1
    while 2 * span <= want:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if want > span:
        least = np.minimum(least[: n - want + 1], least[want - span :])
    return rolled, least


def _count_keys(docs: DataFrame, window: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                if len(words) >= window:
                    rolled, least = minimisers(words, window, size)
                    key = np.unique(least[np.flatnonzero(np.diff(least, prepend=~least[:1]))])
                    rolled.sort()
                    keys.append(key)
                    counts.append(np.searchsorted(rolled, key, "right") - np.searchsorted(rolled, key))
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or none).view(np.int64)), pa.array(np.concatenate(counts or none).astype(np.int64))], ["key", "n"])

    return docs.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def _bitmaps(keys: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' low bits, of all and of the hot ones, as 64-bit words; at most 2^(bits-6) rows reach the driver."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 AS int))")
    rows = keys.select(F.shiftright(at, 6).cast("int").alias("w"), bit.alias("b"), F.when(F.col("n") > hot, bit).otherwise(0).alias("h")).groupBy("w").agg(F.bit_or("b").alias("b"), F.bit_or("h").alias("h")).toArrow()
    out = []
    for name in "bh":
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows.column("w").to_numpy()] = rows.column(name).to_numpy().astype(np.int64).view(np.uint64)
        out.append(words)
    return tuple(out)


def _has(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


_TRAVEL = "kind int, uid bigint, doc_id bigint, n_words bigint, sha string, words binary, key bigint, hot boolean, start int, n int, packed binary"


def _travelling(docs: DataFrame, bitmaps, bits: int, window: int, size: int) -> DataFrame:
    """Documents that are done (kind 0), words of the others (2) and their packed strings (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        (table, hot_table), mask = bitmaps.value, np.uint64((1 << bits) - 1)
        schema = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("words", pa.binary()), ("key", pa.int64()), ("hot", pa.bool_()), ("start", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())])
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                uid += 1
                some = False
                if len(words) >= window:
                    _, least = minimisers(words, window, size)
                    low = least & mask
                    at = np.flatnonzero(_has(table, low))
                    if len(at):
                        some = True
                        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(least[at]) != 0)) + 1
                        for run_of in np.split(at, cut):
                            hot = bool(_has(hot_table, low[run_of[:1]])[0])
                            for i in range(int(run_of[0]), int(run_of[-1]) + 1, PACKED):
                                n = min(PACKED, int(run_of[-1]) + 1 - i)
                                packed = b" ".join(words[i : i + n + window - 1])
                                rows.append((1, uid, None, None, None, None, int(least[i].astype(np.int64)), hot, i, n, packed))
                                if len(rows) >= _ROWS:
                                    yield batch_of()
                                    rows = []
                all_words = b" ".join(words)
                rows.append((2, uid, doc_id, len(words), None, all_words, None, None, None, None, None) if some else (0, uid, doc_id, len(words), hashlib.sha256(all_words).hexdigest(), None, None, None, None, None, None))
                if len(rows) >= _ROWS:
                    yield batch_of()
                    rows = []
        if rows:
            yield batch_of()

    return docs.mapInArrow(run, _TRAVEL)


def _windows(packed: bytes, n: int, window: int) -> list[bytes]:
    ends = np.cumsum([len(w) + 1 for w in packed.split(b" ")]).tolist()
    starts = [0, *ends]
    return [packed[starts[i] : ends[i + window - 1] - 1] for i in range(n)]


def _runs(marks: list[bool]) -> list[int]:
    """[start, end, start, end ...] of the true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(marks, np.int8), [0]])))
    return edges.tolist()


def _bucket_runs(strings: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """Of one bucket's (packed string, windows): the windows that occur twice, by sorting all of them."""
    each = [(w, i, j) for i, (packed, n) in enumerate(strings) for j, w in enumerate(_windows(packed, n, window))]
    each.sort()
    marks = [[False] * n for _, n in strings]
    for (w, i, j), (v, k, m) in zip(each, each[1:]):
        if w == v:
            marks[i][j] = marks[k][m] = True
    return [_runs(m) for m in marks]


_SPANS = "uid bigint, start int, runs array<int>"


def _cold(placed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def done() -> None:
            if len(group) > 1 or group and group[0][2] > 1:
                out.extend((r[0], r[1], x) for r, x in zip(group, _bucket_runs([(r[3], r[2]) for r in group], window)) if x)

        def batch_of() -> pa.RecordBatch:
            u, i, x = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(i, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["uid", "start", "runs"])

        for batch in batches:
            for k, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    done()
                    key, group = k, []
                    if len(out) >= _ROWS:
                        yield batch_of()
                        out.clear()
                group.append(r)
        done()
        if out:
            yield batch_of()

    return placed.select("key", "uid", "start", "n", "packed").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, _SPANS)


def _hot(placed: DataFrame, window: int) -> DataFrame:
    """Each window goes to a place of its own; equal strings fold first and come back by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for string, uses, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [hashlib.blake2b(w, digest_size=16).digest() for w in _windows(packed, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array([string] * n), pa.array([uses] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())], ["string", "uses", "i", "w"])

    string = F.sha2("packed", 256).alias("string")
    folded = placed.select(string, "n", "packed").groupBy("string", "n", "packed").agg(F.count("*").alias("uses")).select("string", "uses", "n", "packed")
    each = folded.mapInArrow(run, "string string, uses bigint, i int, w binary")
    twice = each.groupBy("w").agg(F.sum("uses").alias("c")).filter("c > 1").select("w")
    found = each.join(twice, "w", "left_semi").groupBy("string").agg(F.flatten(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.array(i, i + 1))).alias("runs"))
    return placed.select("uid", "start", string).join(found, "string").select("uid", "start", "runs")


def _shorten(words: list[bytes], spans: list[tuple[int, int]], window: int) -> tuple[int, bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b + window - 1] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return int(out.sum()), b" ".join([w for w, x in zip(words, out.tolist()) if not x])


def remove_repeats(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256), a row per document.

    kept_text is null where nothing was removed: the document's own words stay.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs, ("doc_id", "bigint"), ("text", "string"))
    bitmaps = spark.sparkContext.broadcast(_bitmaps(_count_keys(docs, window, size), bits, hot))
    table = written(_travelling(docs, bitmaps, bits, window, size), "windows")
    done = table.filter("kind = 0").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), F.col("sha").alias("kept_sha256"))
    placed = table.filter("kind = 1")
    found = _cold(placed.filter("NOT hot"), window).unionAll(_hot(placed.filter("hot"), window))
    spans = found.groupBy("uid").agg(F.collect_list(F.struct("start", "runs")).alias("spans"))
    texts = table.filter("kind = 2").select("uid", "doc_id", "words").join(spans, "uid", "left").select("doc_id", "words", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, joined, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = joined.as_py().split(b" ")
                at = [(s["start"] + a, s["start"] + b) for s in spans.as_py() or [] for a, b in zip(s["runs"][::2], s["runs"][1::2])]
                n, kept = _shorten(words, at, window)
                out.append((doc_id, len(words), n, kept.decode() if n else None, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return done.unionAll(texts.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"))
