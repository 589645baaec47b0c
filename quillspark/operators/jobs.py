"""Index jobs over tenants, and the leases that keep two of them apart.

Tenants are a handful at hand; their documents are tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.index import Index
from quillspark.sources import segments
from quillspark.sources.config import Deployment

#: The least time a lease lasts, in seconds.
LEAST_LEASE = 60


def chosen(records: DataFrame, *, paths: Sequence[str] = (), allowed: Column | None = None, since: Column | None = None, modified: str = "modified_at", path: str = "path", group: str | None = None, limit: int | None = None) -> DataFrame:
    """The records with ``why``: null for those to index, else what they are left out for.

    In this order: ``not_asked`` (paths are given, and it isn't among them), ``filtered``
    (its url isn't allowed), ``unchanged`` (not modified after ``since``; a null on either
    side counts as changed), ``over_limit`` (of each group, the first ``limit`` by path stay;
    there a path names one record of its group).
    """
    why = F.when(~F.coalesce(F.col(path).isin(*paths), F.lit(False)), "not_asked") if paths else F.lit(None).cast("string")
    if allowed is not None:
        why = F.coalesce(why, F.when(~F.coalesce(allowed, F.lit(False)), "filtered"))
    if since is not None:
        why = F.coalesce(why, F.when(F.col(modified) <= since, "unchanged"))
    rows = records.withColumn("why", why)
    if limit is None:
        return rows
    left = rows.filter("why IS NULL")
    order = F.col(path).asc_nulls_last()
    if group:
        # The planner cuts each partition to ``limit`` rows a group before it exchanges them.
        nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
        first = left.withColumn("__nth", nth).filter(F.col("__nth") <= limit).drop("__nth")
    else:
        first = left.orderBy(order).limit(limit)
    keys = [c for c in (group, path) if c]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    rest = left.alias("a").join(first.select(*keys).alias("b"), same, "left_anti").withColumn("why", F.lit("over_limit"))
    return first.unionByName(rest).unionByName(rows.filter("why IS NOT NULL"))


def counts(rows: DataFrame, group: str) -> DataFrame:
    """(group, indexed, skipped) of rows that :func:`chosen` judged."""
    return rows.groupBy(group).agg(F.count_if(F.col("why").isNull()).alias("indexed"), F.count("why").alias("skipped"))


def reindex(spark: SparkSession, deployment: Deployment, records: Callable[[str], DataFrame], build: Callable[[DataFrame], Index], folder: str, created: str, *, tenants: Sequence[str] = (), dry_run: bool = False, keep: int = 1, **choice) -> list[dict]:
    """Index the named tenants, or all whose search is on: a segment each, below ``folder/codename``.

    ``records`` gives a tenant's table by codename.  A segment's name is its corpus'
    fingerprint, so an unchanged tenant writes nothing.  A dry run says what would be
    done.  A choice by ``since`` or ``paths`` replaces those documents in the segment
    that is there.  One tenant's failure doesn't stop the others; its error is in its row.
    """
    out = []
    for tenant in deployment.selected(tenants):
        told = {"tenant": tenant.codename, "indexed": 0, "skipped": 0, "segment": None, "written": False, "error": None}
        out.append(told)
        if not tenant.search.enabled or tenant.allow_index_builds is False:
            told["error"] = "index builds are off"
            continue
        try:
            judged = chosen(records(tenant.codename), **choice)
            row = judged.agg(F.count_if(F.col("why").isNull()).alias("indexed"), F.count("why").alias("skipped")).first()
            told |= row.asDict()
            if dry_run or not row.indexed:
                continue
            part = judged.filter("why IS NULL").drop("why")
            at = f"{folder}/{tenant.codename}"
            old = segments.load(spark, at) if choice.get("paths") or choice.get("since") is not None else None
            index = segments.merge(old, part, build) if old else build(part)
            name = segments.segment_id(part, index.schema)
            # Stored documents are cut short, so a merged segment is named by what it was made from.
            told["segment"] = hashlib.sha256(f"{segments.manifest(spark, at)['latest_segment_id']}:{name}".encode()).hexdigest() if old else name
            told["written"] = segments.save(index, at, told["segment"], created)
            segments.prune(spark, at, most=keep)
        except Exception as e:  # reported in the tenant's row; the next tenant goes on
            told["error"] = f"{type(e).__name__}: {e}"
    return out


def acquire(locks: DataFrame, asks: DataFrame, now: Column, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(locks after, answers) when owners ask for named leases.

    ``locks`` and the locks after: (name, owner, acquired_at, expires_at).  ``asks``:
    (name, owner, refreshed), where ``refreshed`` says that the work was done within its
    schedule's gap.  Answers: (name, owner, status, holder).  A lease that runs is
    ``contended``; one that ran out goes, and is asked anew unless the work was refreshed
    (``stale``).  Of several owners that ask at once the least gets it.
    """
    live = locks.filter(F.col("expires_at") > now)
    first = asks.groupBy("name").agg(F.min(F.when(~F.coalesce("refreshed", F.lit(False)), F.col("owner"))).alias("first_asker"))
    held = locks.select("name", F.col("owner").alias("held_by"), (F.col("expires_at") > now).alias("runs"))
    # Refreshed work only spares the run where a lease ran out: with no lease at all it is granted.
    free = asks.groupBy("name").agg(F.min("owner").alias("any_asker"))
    each = asks.join(held, "name", "left").join(first, "name").join(free, "name")
    winner = F.when(F.col("runs"), None).when(F.col("held_by").isNotNull(), F.col("first_asker")).otherwise(F.col("any_asker"))
    spared = F.col("held_by").isNotNull() & ~F.coalesce("runs", F.lit(False)) & F.coalesce("refreshed", F.lit(False))
    each = each.withColumn("winner", winner)
    status = F.when(F.col("owner") == F.col("winner"), "acquired").when(spared, "stale").otherwise("contended")
    holder = F.when(F.col("runs"), F.col("held_by")).otherwise(F.col("winner"))
    answers = each.select("name", "owner", status.alias("status"), holder.alias("holder"))
    until = now + F.make_dt_interval(secs=F.lit(max(seconds, LEAST_LEASE)))
    new = answers.filter("status = 'acquired'").select("name", "owner", now.alias("acquired_at"), until.alias("expires_at")).dropDuplicates(["name"])
    asked = asks.select("name").distinct()
    stale = locks.filter(F.col("expires_at") <= now).join(asked, "name", "left_anti")
    return live.unionByName(stale).unionByName(new), answers


def release(locks: DataFrame, done: DataFrame) -> DataFrame:
    """The locks without those that their own owner gives back: ``done`` is (name, owner)."""
    return locks.join(done.select("name", "owner"), ["name", "owner"], "left_anti").select("name", "owner", "acquired_at", "expires_at")
