"""Vector similarity among rows of the same host or label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, on either side of a comparison; asked vectors that are multiplied at once.
BLOCK, AT_ONCE = 1 << 15, 128


def similar(rows: DataFrame, asked: DataFrame, threshold: float, limit: int, key: str = "vec_id", host: str = "label") -> DataFrame:
    """(query_id, key, similarity, rank, confident) for ``asked(query_id, q, q_label)``.

    Candidates meet by equal host.  A host's vectors are dealt to blocks of a bounded size, two blocks
    are compared by one matrix product a task, and each gives on the best of a query alone: all pairs
    are compared, none is a row.
    """
    left = asked.select("query_id", F.col("q").cast("array<double>").alias("v"), F.col("q_label").alias("h")).filter("h IS NOT NULL AND NOT exists(v, x -> x IS NULL)" if limit > 0 else "false")
    right = rows.select(F.col(key).alias("key"), F.col("v").cast("array<double>").alias("v"), F.col(host).alias("h")).filter("h IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    # A row a host: how many blocks each side has.
    blocks = [t.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for t, n in ((left, "a"), (right, "b"))]
    blocks = blocks[0].join(blocks[1], "h")
    own, other = F.pmod(F.xxhash64("query_id"), F.col("a")), F.pmod(F.xxhash64("key"), F.col("b"))
    left = left.join(F.broadcast(blocks), "h").select("h", own.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), "query_id", "v")
    right = right.join(F.broadcast(blocks), "h").select("h", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), other.cast("int").alias("j"), "key", "v")
    types = [asked.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()]
    pairs = left.groupBy("h", "i", "j").cogroup(right.groupBy("h", "i", "j")).applyInArrow(lambda a, b: _best(a, b, threshold, limit), f"query_id {types[0]}, key {types[1]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "key")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", F.col("key").alias(key), "similarity", "rank", F.lit(True).alias("confident"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, zeros behind shorter ones; a null one is empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(vectors.flatten())
    return out


def _best(asked: pa.Table, rows: pa.Table, threshold: float, limit: int) -> pa.Table:
    """The ``limit`` best rows of each asked vector, by the similarity's six decimals, then by key."""
    rows = rows.sort_by("key")
    vectors = [t["v"].combine_chunks() for t in (asked, rows)]
    width = max((pc.max(pc.list_value_length(v)).as_py() or 0 for v in vectors if len(v)), default=0)
    a, b = (_matrix(v, width) for v in vectors)
    na, nb = (np.sqrt((m * m).sum(1)) for m in (a, b))
    queries, places, values = [], [], []
    for start in range(0, len(a) if len(b) else 0, AT_ONCE):
        norm = na[start : start + AT_ONCE, None] * nb
        with np.errstate(invalid="ignore", divide="ignore"):
            found = np.where(norm == 0, 0.0, (a[start : start + AT_ONCE] @ b.T) / norm)
        # Not a number is more than any number, as in Spark's order.
        shown = np.where(np.isnan(found), np.inf, np.floor(found * 1e6 + 0.5))
        held = ~(found < threshold)
        shown[~held] = -np.inf
        if len(b) > limit:
            held &= shown >= np.partition(shown, len(b) - limit, axis=1)[:, len(b) - limit, None]
        query, place = np.nonzero(held)
        order = np.lexsort((place, -shown[query, place], query))
        query, place = query[order], place[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        query, place = query[nth < limit], place[nth < limit]
        queries.append(query + start)
        places.append(place)
        values.append(found[query, place])
    at, of = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (queries, places))
    value = np.concatenate(values) if values else np.empty(0)
    return pa.table({"query_id": asked["query_id"].take(pa.array(at)), "key": rows["key"].take(pa.array(of)), "similarity": pa.array(value)})


def cache_lookup(asked: DataFrame, fresh: DataFrame, stale: DataFrame, near: DataFrame, offline: bool = False) -> DataFrame:
    """(url, page, source): a fresh copy, else offline a stale one, else a similar page, else null: to be fetched."""
    rows = asked.join(fresh.select("url", F.col("page").alias("p1")), "url", "left").join(stale.select("url", F.col("page").alias("p2")), "url", "left").join(near.select("url", F.col("page").alias("p3")), "url", "left")
    second = F.col("p2") if offline else F.lit(None).cast("string")
    source = F.when(F.col("p1").isNotNull(), "fresh").when(second.isNotNull(), "stale").when(F.col("p3").isNotNull(), "semantic").otherwise("fetch")
    return rows.select("url", F.coalesce("p1", second, "p3").alias("page"), source.alias("source"))
