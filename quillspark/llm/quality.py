"""Quality classifier: naive Bayes features under a linear support vector machine.

* Features are indicators of n-grams (1 to 3) over word forms: a word's form is its
  runs of small letters, capitals, digits and each other character (with a mark for
  doubled ones), and a word that repeats the one before has a form of its own; and of
  n-grams (1 and 2) over the words themselves, in small letters.
* Each indicator is scaled by its log-count ratio between the classes (naive Bayes),
  rows have length one, and a linear model with hinge loss is fitted to them by dual
  coordinate descent, the classes weighted to equal parts.
* A logistic curve through the margins, fitted on the same rows, gives the score.

Fitted on a bounded sample: the ``SAMPLE`` labelled rows with the least hash of their
id, as many as hold ``GRAMS`` n-grams together; of rows that share an id the text with
the least hash counts.  Only their ids are broadcast.  N-grams are counted where their
rows are; the driver gets those of ``_MIN_ROWS`` rows or more, and each row's places in
them as one Arrow table that is read in place.
Scoring is one pass over the texts without an exchange.  Ids, languages, sources and
labels are no inputs of a score.

Defined cases: null text counts as empty, which is a form of its own; an id with
several labels counts with the least one; labels other than 0 and 1 are ignored.
Without labels every score is 0.5; with one class only, that class's share.
Rows without id are scored and never held out.  Repeated rows each give a row; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_columns, new_path, remove, text_of, written

#: Labelled rows that the model is fitted on at most.
SAMPLE = 12_000
#: Distinct n-grams of all those rows together; the driver holds 4 bytes for each that counts.
GRAMS = 50_000_000
#: Least score that isn't rejected.
ACCEPT = 0.3
FOLDS = 5
_MIN_ROWS, _SMOOTH, _COST, _ROUNDS = 3, 1.0, 1.0, 30
_RUN = re.compile(r"([a-zß-öø-ÿ]+)|([A-ZÀ-ÖØ-Þ]+)|([0-9]+)|(([^\w\s])\5*)|(\w)|(.)", re.S)
_SAME = zlib.crc32(b"=")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def form(word: str) -> str:
    """The runs of a word: a, A, 0, x (other letters), or a sign, with + where it is doubled."""
    return "".join("a" if m[1] else "A" if m[2] else "0" if m[3] else m[5] + "+" * (len(m[4]) > 1) if m[4] else "x" for m in _RUN.finditer(word))


class _Forms(dict):
    """word -> hash of its form, 32 bits, and of itself in small letters, 32 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = zlib.crc32(form(word).encode()) << 32 | zlib.crc32(word.lower().encode())
        return found


_forms = _Forms()


def ngrams(text: str | None) -> np.ndarray:
    """The distinct n-gram hashes of a text, sorted."""
    words = (text or "").split()
    both = np.fromiter(map(_forms.__getitem__, words), np.uint64, len(words))
    ids, own = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    if len(words) > 1:
        ids[1:][np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)] = _SAME
    ids = np.concatenate([[np.uint64(1)], ids + np.uint64(3), [np.uint64(2)]])
    pairs = (ids[:-1] * _STEP) ^ (ids[1:] + np.uint64(1 << 40))
    triples = (pairs[:-1] * _STEP) ^ (ids[2:] + np.uint64(1 << 41))
    own_pairs = (own[:-1] * _STEP) ^ (own[1:] + np.uint64(1 << 43))
    return np.unique(np.concatenate([ids, pairs, triples, own + np.uint64(1 << 42), own_pairs]))


@dataclass(frozen=True)
class Model:
    """Sorted n-gram hashes with their weight and squared scale, and the score's curve."""

    grams: np.ndarray
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        if not len(self.grams):
            return self.shift
        found = ngrams(text)
        at = np.searchsorted(self.grams, found)
        at = at[at < len(self.grams)] if len(at) and at[-1] >= len(self.grams) else at
        at = at[self.grams[at] == found[: len(at)]]
        margin = self.bias + float(self.weight[at].sum()) / math.sqrt(float(self.square[at].sum()) or 1.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.shift))))


def _descend(rows: list[np.ndarray], square: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, each row's dual between 0 and its cost.

    A row holds the places of its n-grams; its values there are the ratios over the root
    of ``square``'s sum.  Kept are the weights times the ratios, so no row needs values
    of its own; the bias belongs to a value of one in every row.
    """
    rng = np.random.default_rng(7)
    u, bias, alpha = np.zeros(len(square)), 0.0, np.zeros(len(rows))
    scale = np.array([1 / math.sqrt(float(square[at].sum()) or 1.0) for at in rows])
    norms = np.array([float(square[at].sum()) for at in rows]) * scale**2 + 1
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            slope = y[i] * (scale[i] * float(u[at].sum()) + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                most = max(most, abs(slope) if 0 < new < cost[i] else abs(new - alpha[i]) * norms[i])
                move = (new - alpha[i]) * y[i]
                alpha[i] = new
                u[at] += move * scale[i] * square[at]
                bias += move
        if most < 1e-3:
            break
    return u, bias


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (target - p))
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(grams: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of (distinct sorted n-grams, label 0 or 1) rows."""
    found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_counts=True)
    vocabulary = found[counts >= min(_MIN_ROWS, len(labels))]
    return fit_places(vocabulary, [_places(vocabulary, g) for g in grams], labels)


def _places(vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where a row's n-grams stand in the vocabulary, as far as they do."""
    at = np.searchsorted(vocabulary, grams)
    inside = at < len(vocabulary)
    at, grams = at[inside], grams[inside]
    return at[vocabulary[at] == grams].astype(np.int32)


def fit_places(vocabulary: np.ndarray, places: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of rows that hold the n-grams at their places."""
    none = np.zeros(0)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), none, none, 0.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    y = np.where(labels > 0, 1.0, -1.0)
    in_class = []
    for sign in (1, -1):
        count = np.full(len(vocabulary), _SMOOTH)
        for at, s in zip(places, y):
            if s == sign:
                count[at] += 1  # a row's n-grams are distinct
        in_class.append(count / count.sum())
    ratio = np.log(in_class[0] / in_class[1])
    share = {s: (y == s).mean() for s in (1.0, -1.0)}
    u, bias = _descend(places, ratio**2, y, np.array([_COST / (2 * share[s]) for s in y]), _ROUNDS)
    margins = np.array([float(u[at].sum()) / math.sqrt(float((ratio[at] ** 2).sum()) or 1.0) + bias for at in places])
    return Model(vocabulary, u, ratio**2, bias, *_curve(margins, y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents that aren't held out."""
    named = doc_columns(labels, ("doc_id", "bigint"), ("quality", "int")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    chosen = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = doc_columns(docs, ("doc_id", "bigint"), ("text", "string")).join(F.broadcast(chosen), "doc_id").select("doc_id", text_of().alias("text"), "quality")
    # One text an id, folded before the exchange: ids that many rows share stay small.
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @F.pandas_udf("binary")
    def grams(text: pd.Series) -> pd.Series:
        return text.map(lambda t: ngrams(t).tobytes())

    folder = new_path(docs.sparkSession, "quality-sample")
    rows = written(texts.select("doc_id", "quality", grams("text").alias("g"), F.xxhash64("doc_id").alias("nth")), "quality-sample", folder)
    # At most ``sample`` rows, so one task sums up their sizes.
    order = Window.orderBy("nth", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.select("doc_id", "nth", F.sum(F.octet_length("g") / 8).over(order).alias("n")).filter(F.col("n") <= GRAMS).select("doc_id", "nth").orderBy("nth", "doc_id").tail(1)
    if kept:
        rows = rows.filter((F.col("nth") < kept[0].nth) | ((F.col("nth") == kept[0].nth) & (F.col("doc_id") <= kept[0].doc_id)))
    else:
        rows = rows.limit(0)
    least = min(_MIN_ROWS, rows.count())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_views(batch.column(0), np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["gram", "n"])

    frequent = rows.select("g").mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("gram")
    vocabulary = np.sort(frequent.toArrow().column("gram").to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def places(g: pd.Series) -> pd.Series:
        return g.map(lambda x: _places(shared.value, np.frombuffer(x, np.uint64)).tobytes())

    got = rows.select("doc_id", "quality", places("g").alias("at")).toArrow()
    remove(docs.sparkSession, folder)
    ids, at = got.column("doc_id").to_numpy(), [x for chunk in got.column("at").chunks for x in _views(chunk, np.int32)]
    order = np.argsort(ids)
    return fit_places(vocabulary, [at[i] for i in order], got.column("quality").to_numpy()[order])


def _views(column: pa.Array, kind: type) -> Iterator[np.ndarray]:
    """Each binary value as numbers, in the column's own memory."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    size = np.dtype(kind).itemsize
    for a, b in zip(ends, ends[1:]):
        yield np.frombuffer(column.buffers()[2], kind, (b - a) // size, a) if b > a else np.zeros(0, kind)


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return text.map(model.score).astype(float)

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document."""
    model = fit(docs, labels, sample)
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(model, F.col("text")).alias("score"))
    return each.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    return docs.filter(score(fit(docs, labels, sample), F.col("text")) >= ACCEPT)
