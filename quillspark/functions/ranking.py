"""Scoring formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formulas.
K1, B = 1.2, 0.75
K1_FEDERATED = 1.5
LONGEST = 4.0  # a document counts as at most so many times the average length
FLOOR = 1e-6
FUZZY_DISCOUNT = 0.8
PHRASE_BONUS = 1.5


def idf(df: Column, total: Column) -> Column:
    ratio = (total - df + 0.5) / (df + 0.5)
    smoothed = F.greatest(F.log(F.greatest(ratio, F.lit(FLOOR)) + FLOOR) + 1, F.lit(FLOOR))
    return F.when(total <= 0, 0.0).otherwise(smoothed)


def bm25(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    ratio = F.least(length / F.greatest(average, F.lit(1e-9)), F.lit(LONGEST))
    return F.when(tf <= 0, 0.0).otherwise(tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio)))


def classic_idf(df: Column, total: Column) -> Column:
    """May be negative."""
    return F.log((total - df + 0.5) / (df + 0.5))


def classic_bm25(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / average)))


def phrase_factor(span: Column, terms: Column) -> Column:
    """1.5 where the terms stand together, falling to 1 where they spread over three times their number."""
    scatter = span / terms
    falling = F.greatest(F.lit(1.0), PHRASE_BONUS - (scatter - 1) * (PHRASE_BONUS - 1) / 2)
    return F.when(span.isNull(), 1.0).when(span <= terms, PHRASE_BONUS).when(scatter >= 3, 1.0).otherwise(falling)


def federated_score(score: Column, best: Column, boost: Column) -> Column:
    return boost + score / best * 0.3 + score / (score + 100) * 0.2


def allowed_edits(term: Column) -> Column:
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance; ``most + 1`` for anything beyond, the other's length where one is empty."""
    near = F.levenshtein(a, b, most)
    return F.when((a == "") | (b == ""), F.greatest(F.length(a), F.length(b))).when(near < 0, most + 1).otherwise(near)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, norms over the whole vectors; zero for an empty or zero vector."""

    def total(of):
        return F.aggregate(of, F.lit(0.0), lambda s, x: s + x)

    n = F.least(F.size(a), F.size(b))
    dot = total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0) | (norm == 0), 0.0).otherwise(dot / norm)


def percentile_by_index(values: Column, p: float) -> Column:
    """The element number int(n * p) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(p)).cast("int"), F.size(ordered) - 1))
