from quillspark.llm import common


def test_intermediate_tables_can_be_removed(spark):
    path = common.new_path(spark, "numbers")
    assert path.startswith(common.tables_dir(spark) + "/") and spark.sparkContext.applicationId in path
    assert common.written(spark.range(5), "numbers", path).count() == 5
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(p)
    common.remove(spark, path)
    assert not fs.exists(p)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, ID_ int, Mark int")
    assert common.unused(df, "id", "mark", "other") == ["id__", "mark_", "other"]


def test_keys_are_taken_out_by_id_and_mark(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "d"), (2, "d")], "doc_id bigint, text string")
    gone = common.written(spark.createDataFrame([(1, "a", False), (None, "c", True)], "doc_id bigint, mark string, one boolean"), "gone")
    for few in (0, 10):
        got = common.without_keys(docs, gone, F.col("text"), few).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "b"), ("2", "d"), ("2", "d"), ("None", "c")]
