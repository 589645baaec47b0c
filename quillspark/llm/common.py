"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.parallel import spread


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only in local mode, where driver
    and executors are one process, a folder of this machine serves where that is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{tables_dir(spark)}/{what}-{uuid.uuid4().hex}"


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are, below the shared folder."""
    return f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored."""
    remove(spark, tables_dir(spark))


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, and a
    lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`written` made, through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_of(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def doc_columns(df: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
    """Only the named columns, as (name, type); extra columns go.  A small input is dealt over all cores."""
    return spread(df.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in wanted)))


#: Keys that :func:`without_keys` broadcasts at most, of about 70 bytes each.
FEW = 2_000_000


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_keys(docs: DataFrame, gone: DataFrame, mark: Column, few: int = FEW) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``mark`` are in the written table
    ``gone(doc_id, mark, one)``; of rows whose key has ``one`` a single one stays.

    Up to ``few`` keys are broadcast and rows taken out where they are read; beyond
    that number both sides are dealt by key.
    """
    i, m, gi, gm = unused(docs, "id", "mark", "gone_id", "gone_mark")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*columns, F.col("doc_id").cast("bigint").alias(i), mark.alias(m))

    def keyed(part: DataFrame) -> DataFrame:
        part = part.select(F.col("doc_id").alias(gi), F.col("mark").alias(gm))
        return F.broadcast(part) if part.count() <= few else part

    same = F.col(i).eqNullSafe(F.col(gi)) & (F.col(m) == F.col(gm))
    out = named.join(keyed(gone), same, "left_anti").select(*columns)
    again = gone.filter("one")
    if not again.isEmpty():
        # An aggregate with partial folding: rows that repeat a million times meet in no task.
        out = out.unionAll(named.join(keyed(again), same, "left_semi").dropDuplicates([i, m]).select(*columns))
    return out


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
