"""Small inputs on many cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its input is so small that a scan makes fewer splits than that.

    A file of one row group is read by one task; work on its texts would be too.  The
    size is the optimizer's estimate, so nothing runs; larger inputs stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    return df.repartition(cores) if size < cores * least else df
