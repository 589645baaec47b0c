import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import schedule, text
from quillspark.operators import index as ix
from quillspark.operators import jobs
from quillspark.operators import search as se
from quillspark.operators import tenants as tn
from quillspark.sources import config, segments

NOW = dt.datetime(2024, 6, 1)
SCHEMA = (ix.Field("body"),)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("text", "after", "due"),
    [
        ("0 2 * * 1", "2024-01-31 10:30", "2024-02-05 02:00"),
        ("0 */6 * * *", "2024-01-31 18:00", "2024-02-01 00:00"),
        ("59 23 31 12 *", "2024-01-01 00:00", "2024-12-31 23:59"),
        ("0 0 29 feb *", "2024-02-29 00:00", "2028-02-29 00:00"),
        ("15,45 8-9 1 * fri", "2024-01-31 10:30", "2024-02-01 08:15"),
        ("0 0 * * 5-7", "2024-02-03 12:00", "2024-02-04 00:00"),
        ("10/20 0 * * *", "2024-02-03 00:10", "2024-02-03 00:30"),
    ],
)
def test_next_run(text, after, due):
    assert schedule.Cron(text).next(dt.datetime.fromisoformat(after)) == dt.datetime.fromisoformat(due)


def test_schedules_of_columns_and_gaps(spark):
    rows = spark.createDataFrame([(NOW,), (None,)], "t timestamp_ntz")
    assert [r[0] for r in rows.select(schedule.next_run("30 4 * * *", F.col("t"))).collect()] == [dt.datetime(2024, 6, 1, 4, 30), None]
    assert [r[0] for r in rows.select(schedule.next_run(None, F.col("t"))).collect()] == [None, None]
    assert schedule.interval_hours(None, NOW) == 24 and schedule.interval_hours("*/5 * * * *", NOW) == 1 and schedule.interval_hours("0 0 * * sun", NOW) == 168
    for odd in ("", "x", "* * * *", "60 * * * *", "0 0 31 2 *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.Cron(odd)


def test_wrapped_lines(spark):
    given = ["", "short  stays", "aaa bbb ccc ddd", "  spaces   go  here ", "toolongaword x", "ää ää ää ää", None]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select(text.wrapped(F.col("t"), 12).alias("w")).collect()
    assert [r.w for r in rows] == [[""], ["short  stays"], ["aaa bbb ccc", "ddd"], ["spaces go", "here"], ["toolongaword", "x"], ["ää ää", "ää ää"], None]


def test_choice_of_records(spark):
    rows = [("a", "t", True, 1), ("b", "t", False, 9), ("c", "t", True, 9), ("d", "t", True, None), ("e", "u", None, 9), ("f", "t", True, 9)]
    r = spark.createDataFrame(rows, "path string, g string, ok boolean, modified_at int")
    told = {x.path: x.why for x in jobs.chosen(r, paths=["a", "b", "c", "d", "e"], allowed=F.col("ok"), since=F.lit(5), group="g", limit=1).collect()}
    assert told == {"a": "unchanged", "b": "filtered", "c": None, "d": "over_limit", "e": "filtered", "f": "not_asked"}
    assert {x.path for x in jobs.chosen(r, limit=2).filter("why IS NULL").collect()} == {"a", "b"}
    assert jobs.chosen(r.limit(0), limit=1).count() == 0
    assert {tuple(x) for x in jobs.counts(jobs.chosen(r, allowed=F.col("ok")), "g").collect()} == {("t", 4, 1), ("u", 0, 1)}


def test_reindex(spark, tmp_path):
    site = {"docs_name": "x", "docs_entry_url": "http://x"}
    d = config.parse_deployment(json.dumps({"tenants": [{"codename": "one", **site}, {"codename": "two", **site, "search": {"enabled": False}}, {"codename": "lost", **site}]}))
    corpus = {"one": [(1, "a", "red fox"), (2, "b", "blue bird")]}
    folder = f"file://{tmp_path}/x"

    def run(**more):
        return jobs.reindex(spark, d, lambda c: spark.createDataFrame(corpus[c], "doc_id int, path string, body string"), lambda r: ix.build(r, SCHEMA), folder, "now", **more)

    first = run(dry_run=True)
    assert [(r["tenant"], r["indexed"], r["segment"]) for r in first] == [("one", 2, None), ("two", 0, None), ("lost", 0, None)]
    assert "off" in first[1]["error"] and "KeyError" in first[2]["error"] and segments.segments(spark, f"{folder}/one") == []
    built = run(tenants=["one"])[0]
    assert built["written"] and not run(tenants=["one"])[0]["written"]
    corpus["one"][1] = (2, "b", "green frog")
    again = run(tenants=["one"], paths=["b"])[0]
    assert (again["indexed"], again["skipped"], again["written"]) == (1, 1, True) and segments.segments(spark, f"{folder}/one") == [again["segment"]]
    index = segments.load(spark, f"{folder}/one")
    found = se.ask(index, {1: "fox", 2: "frog", 3: "bird"}, fuzzy=False).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (2, 2)}


def test_leases(spark):
    hour = dt.timedelta(hours=1)
    locks = spark.createDataFrame([("runs", "x", NOW - hour, NOW + hour), ("over", "x", NOW - 2 * hour, NOW - hour), ("spared", "x", NOW - 2 * hour, NOW), ("other", "x", NOW - 2 * hour, NOW - hour)], "name string, owner string, acquired_at timestamp_ntz, expires_at timestamp_ntz")
    asks = spark.createDataFrame([("runs", "b", False), ("over", "c", None), ("over", "b", False), ("spared", "b", True), ("new", "b", True)], "name string, owner string, refreshed boolean")
    after, answers = jobs.acquire(locks, asks, now(), 10)
    assert {tuple(r) for r in answers.collect()} == {("runs", "b", "contended", "x"), ("over", "b", "acquired", "b"), ("over", "c", "contended", "b"), ("spared", "b", "stale", None), ("new", "b", "acquired", "b")}
    kept = {r["name"]: (r.owner, r.expires_at) for r in after.collect()}
    assert kept == {"runs": ("x", NOW + hour), "over": ("b", NOW + hour / 60), "new": ("b", NOW + hour / 60), "other": ("x", NOW - hour)}
    done = spark.createDataFrame([("new", "b"), ("runs", "b")], "name string, owner string")
    assert {r["name"] for r in jobs.release(after, done).collect()} == {"runs", "over", "other"}


def test_descriptions(spark):
    t = tn.tenants_of(spark.createDataFrame([("b", "B", "of b"), ("a", "A", "of a")], "codename string, display_name string, description string"))
    assert [tuple(r) for r in tn.listing(t).collect()] == [("a", "A - of a"), ("b", "B - of b")]
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "codename string")
    counts = spark.createDataFrame([("b", 3)], "codename string, documents bigint")
    assert {(r.codename, r.found, r.display_name, r.documents) for r in tn.describe(t, asked, counts).collect()} == {("a", True, "A", 0), ("z", False, None, 0)}
    assert tn.describe(t, asked).count() == 2
