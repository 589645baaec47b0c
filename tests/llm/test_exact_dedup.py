import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspark.llm import exact_dedup as ed

DOCS = "doc_id bigint, text string, __id string, mark string"


def test_chunks_join_to_the_text(spark):
    rng = random.Random(1)
    texts = ["", "a", "\n", "x" * 20_000, "é漢😀\r\n" * 900] + ["".join(rng.choice("etaoin shrdlu\n.") for _ in range(rng.randrange(9000))) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", ed.chunks(F.col("text"), 64, 256).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.text
        assert all(len(c) <= 512 for c in r.c)
    assert any(len(r.c) > 5 for r in rows)


def test_cuts_follow_the_content(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("etaoin shrdlu\n.ABCDE") for _ in range(60_000))
    a, b = (set(r.c) for r in spark.createDataFrame([(text,), ("one more start " + text,)], "text string").select(ed.chunks(F.col("text")).alias("c")).collect())
    assert len(a & b) > 0.8 * len(a)


def check(spark, rows, **kw):
    got = ed.exact_groups(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS), **kw).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) <= {1}


ROWS = [(1, "same"), (9, "same"), (4, "same"), (2, None), (3, ""), (None, "same"), (5, "Same"), (6, " same"), (7, "x" * 5000), (8, "x" * 5000), (10, "twice"), (10, "twice"), (None, "alone"), (11, "x" * 5001)]


def test_groups(spark):
    check(spark, ROWS)


def test_collisions_never_merge(spark):
    weak = lambda c: F.struct(F.lit(1).alias("h"))  # noqa: E731  every chunk collides
    check(spark, ROWS, identifier=weak)


def test_empty(spark):
    assert ed.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_drop(spark):
    got = ed.drop_exact_copies(spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("9", "same"), ("5", "Same"), ("6", " same"), ("8", "x" * 5000), ("10", "twice"), ("None", "alone"), ("11", "x" * 5001)])
    assert [r.doc_id for r in got if not r.text] == [3]


def test_drop_keeps_clashing_columns_and_deals_many_keys(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS * 2] + [(None, "n", "x", "y")] * 3, DOCS)
    want = sorted((str(i), t or "") for i, t in [(9, "same"), (5, "Same"), (6, " same"), (8, "x" * 5000), (10, "twice"), (None, "alone"), (11, "x" * 5001), (3, ""), (None, "n")])
    for few in (0, 1000):
        got = ed.drop_exact_copies(docs, few=few).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == want
        assert {(r["__id"], r.mark) for r in got} == {("x", "y")}


def test_no_text_is_exchanged(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], DOCS)
    plan = ed.drop_exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin", plan)


def test_no_python_in_the_plan(spark):
    plan = ed.exact_groups(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
