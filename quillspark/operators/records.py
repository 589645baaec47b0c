"""Records of documents: lookups, fingerprints, audits, staged merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.urls import lookup_candidates


def _plain(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))


def by_url(documents: DataFrame, asked: DataFrame, key: str = "page_id") -> DataFrame:
    """(asked, documents' columns): the document with just this url, else with the same but for
    case and slashes at the end; the least key where there are several."""
    each = asked.select("asked").distinct()
    exact = each.join(documents, each["asked"] == documents["url"]).withColumn("__how", F.lit(0))
    loose = each.join(documents, _plain(each["asked"]) == _plain(documents["url"])).withColumn("__how", F.lit(1))
    order = Window.partitionBy("asked").orderBy("__how", key)
    return exact.unionAll(loose).withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth", "__how")


def fetch(documents: DataFrame, asked: DataFrame, key: str = "page_id") -> DataFrame:
    """(asked, documents' columns): the stored document of each asked url, by the first of its
    candidates that there is; the least key where there are several."""
    each = asked.select("asked").distinct()
    named = each.select("asked", F.posexplode(lookup_candidates(F.col("asked"))).alias("__how", "__url"))
    found = named.join(documents, named["__url"] == documents["url"])
    order = Window.partitionBy("asked").orderBy("__how", key)
    return found.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth", "__how", "__url")


def fingerprints(records: DataFrame, group: str, key: str, values: Sequence[str], form: str = "") -> DataFrame:
    """(group, documents, fingerprint): SHA-256 over each group's sorted ``key:digest`` lines.

    Texts are digested where they are read; only 64 characters a document are exchanged
    and gathered, per group.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values)), 256)
    lines = records.select(group, F.struct(F.col(key).alias("k"), digest.alias("h")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat_ws(":", x.k.cast("string"), x.h)), "\n")
    text = F.concat(F.lit(form), joined) if form else joined
    return lines.groupBy(group).agg(F.count("*").alias("documents"), F.sha2(text, 256).alias("fingerprint"))


def audit(now: DataFrame, segments: DataFrame, group: str) -> DataFrame:
    """(group, status, needs_rebuild): fingerprints of the documents against those of the segments."""
    both = now.select(group, F.col("fingerprint").alias("now")).join(segments.select(group, F.col("fingerprint").alias("built")), group, "full")
    status = F.when(F.col("now").isNull(), "error").when(F.col("built").isNull() | (F.col("built") != F.col("now")), "stale").otherwise("ok")
    return both.select(group, status.alias("status"), (status == "stale").alias("needs_rebuild"))


def worst_status(status: DataFrame) -> DataFrame:
    """(status, exit_code) of all: error over stale over ok."""
    code = F.max(F.when(F.col("status") == "error", 3).when(F.col("status") == "stale", 2).otherwise(0))
    return status.agg(F.coalesce(code, F.lit(0)).alias("exit_code")).withColumn("status", F.when(F.col("exit_code") == 3, "error").when(F.col("exit_code") == 2, "stale").otherwise("ok"))


def all_healthy(parts: DataFrame, flag: str = "healthy") -> DataFrame:
    return parts.agg(F.when(F.coalesce(F.bool_and(flag), F.lit(True)), "healthy").otherwise("degraded").alias("status"))


def clean_up(metadata: DataFrame, files: DataFrame, allowed: Column, path: str = "path", key: str = "url") -> DataFrame:
    """Each metadata row with why it goes: disallowed, missing its file, or a repeated target; null stays."""
    known = files.select(F.col(path).alias("__file")).distinct()
    rows = metadata.join(known, metadata[path] == known["__file"], "left")
    order = Window.partitionBy(path).orderBy(key)
    nth = F.row_number().over(order)
    why = F.when(~allowed, "disallowed").when(F.col("__file").isNull(), "missing").when(F.col("__nth") > 1, "duplicate")
    return rows.withColumn("__nth", nth).withColumn("reason", why).drop("__file", "__nth")


def snapshot(files: DataFrame, group: str) -> DataFrame:
    """(group, files, bytes, newest, newest_path, signature) of (group, path, size, modified)."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), F.col("modified").cast("string"))
    return files.groupBy(group).agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.max("modified").alias("newest"),
        F.max_by("path", F.struct("modified", "path")).alias("newest_path"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"),
    )


def freshness(documents: DataFrame, group: str) -> DataFrame:
    """(group, state, updated, evidence): known if all documents have a time, partial if some have."""
    some = F.count("updated")
    sources = F.collect_set("evidence")
    return documents.groupBy(group).agg(
        F.when((F.count("*") > 0) & (some == F.count("*")), "known").when(some > 0, "partial").otherwise("unknown").alias("state"),
        F.max("updated").alias("updated"),
        F.when(F.size(sources) == 1, F.get(sources, 0)).otherwise("document_timestamps").alias("evidence"),
    )


def parity(stored: DataFrame, tracked: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(stored, tracked, drift, within): two counts against each other."""
    both = stored.agg(F.count("*").alias("stored")).crossJoin(tracked.agg(F.count("*").alias("tracked")))  # two rows of one
    drift = F.abs(F.col("stored") - F.col("tracked")) / F.greatest("tracked", F.lit(1))
    return both.withColumn("drift", drift).withColumn("within", drift <= tolerance)
