import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import analysis, ranking, snippets
from quillspark.operators import index as ix
from quillspark.operators import search as se
from quillspark.sources import segments

SCHEMA = (ix.Field("title", ix.TEXT, 2.5), ix.Field("body"))
DOCS = "doc_id int, title string, body string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    words = ["route", "routing", "server", "servers", "token", "auth", "config", "page", "index", "alpha", "beta", "configuration"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(3))), " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(n)]


def brute(docs, query, expand_with=None):
    """BM25F by plain loops."""
    n = len(docs)
    scores = Counter()
    for f, boost in ((1, 2.5), (2, 1.0)):
        lists = {d[0]: analysis.standard_terms(d[f]) for d in docs}
        average = sum(map(len, lists.values())) / n
        base = list(dict.fromkeys(analysis.standard_terms(query)))
        if expand_with:
            base += sorted({s for t in base for s in expand_with.get(t, [t])} - set(base))
        for t in base:
            df = sum(t in x for x in lists.values())
            for i, x in lists.items():
                if tf := x.count(t):
                    idf = max(math.log(max((n - df + 0.5) / (df + 0.5), 1e-6) + 1e-6) + 1, 1e-6)
                    scores[i] += boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * min(len(x) / max(average, 1e-9), 4)))
    return scores


def test_scores_against_plain_loops(spark):
    from quillspark.functions.synonyms import synonym_map

    docs = corpus()
    index = ix.build(spark.createDataFrame(docs, DOCS), SCHEMA)
    queries = ["routing servers", "auth token", "config config page", "nothing here", ""]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    for expand in (False, True):
        got = se.search(index, table, 100, expand=expand, fuzzy=False, phrase=False).collect()
        for q, text in enumerate(queries):
            want = brute(docs, text, synonym_map() if expand else None)
            assert {r.doc_id: r.score for r in got if r.query_id == q} == pytest.approx(dict(want))
            ranks = [(round(r.score, 6), -r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
            assert ranks == sorted(ranks, reverse=True)
    assert se.search(index, table, 0).count() == 0


def test_fuzzy_and_phrase(spark):
    docs = [(1, "", "serializer fields"), (2, "", "fields of another serializer"), (3, "", "unrelated words")]
    index = ix.build(spark.createDataFrame(docs, DOCS), SCHEMA)
    asked = spark.createDataFrame([(1, "serailizer"), (2, "serializer fields")], "query_id int, text string")
    close = se.fuzzy_terms(se.query_terms(asked, index, False), index.vocabulary).collect()
    assert [(r.term, r.matched, r.distance) for r in close if r.field == "body"] == [("serailize", "serialize", 2)]
    plain = {(r.query_id, r.doc_id): r.score for r in se.search(index, asked, 5, expand=False, phrase=False).collect()}
    near = {(r.query_id, r.doc_id): r.score for r in se.search(index, asked, 5, expand=False).collect()}
    assert near[2, 1] == pytest.approx(plain[2, 1] * 1.5)
    assert near[2, 2] == pytest.approx(plain[2, 2] * 1.375)
    assert near[1, 1] == pytest.approx(plain[1, 1]) and (1, 1) in plain


def test_ask_is_search(spark):
    index = ix.build(spark.createDataFrame(corpus(7), DOCS), SCHEMA)
    asked = {1: "routing servers", 2: "tokn cofig", 3: "auth", 4: "", 5: "zzzzzzzz"}
    table = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    want = {(r.query_id, r["rank"], r.doc_id): r.score for r in se.search(index, table, 5).collect()}
    assert {(r.query_id, r["rank"], r.doc_id): r.score for r in se.ask(index, asked, 5).collect()} == pytest.approx(want)
    assert se.ask(index, {1: ""}, 5).count() == 0


def test_min_span(spark):
    def span(**positions):
        rows = [(1, t, p) for t, ps in positions.items() for p in ps]
        return se.min_spans(spark.createDataFrame(rows, "d int, term string, position int"), ["d"]).first().span

    assert span(a=[0], b=[1], c=[2]) == 3
    assert span(a=[0], b=[5]) == 6
    assert span(a=[0, 10], b=[2, 15]) == 3
    assert span(a=[4]) == 1
    rng = random.Random(3)
    import itertools

    for _ in range(10):
        p = {t: sorted(rng.sample(range(60), rng.randrange(1, 6))) for t in "abc"}
        assert span(**p) == min(max(c) - min(c) + 1 for c in itertools.product(*p.values()))


def test_formulas(spark):
    assert one(spark, ranking.idf(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, ranking.bm25(F.lit(0), F.lit(3), F.lit(2.0))) == 0.0
    assert [one(spark, ranking.allowed_edits(F.lit("x" * n))) for n in (1, 2, 3, 5, 6, 20)] == [0, 0, 1, 1, 2, 2]
    assert one(spark, ranking.edit_distance(F.lit("kitten"), F.lit("sitting"), 5)) == 3
    assert one(spark, ranking.edit_distance(F.lit("short"), F.lit("muchlonger"), 2)) == 3
    assert one(spark, ranking.edit_distance(F.lit("abc"), F.lit(""), 1)) == 3
    assert [one(spark, ranking.phrase_factor(F.lit(s), F.lit(2))) for s in (2, 4, 6)] == [1.5, 1.25, 1.0]
    assert one(spark, ranking.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0)))) == pytest.approx(1.0)
    assert one(spark, ranking.percentile_by_index(F.array(*map(F.lit, range(10))), 0.95)) == 9


def test_length_stats(spark):
    rows = spark.createDataFrame([("a", 4), ("a", None), ("a", -2), ("b", None)], "field string, length int")
    assert {r.field: (r.documents, r.total_terms, r.average) for r in ix.length_stats(rows).collect()} == {"a": (3, 2, 2 / 3), "b": (1, 0, 0.0)}
    assert {r.field: (r.documents, r.total_terms, r.average) for r in ix.clipped_length_stats(rows).collect()} == {"a": (2, 4, 2.0), "b": (0, 0, 0.0)}


def test_segments(spark, tmp_path):
    folder = f"file://{tmp_path}/segments"
    records = spark.createDataFrame(corpus(), DOCS)
    name = segments.segment_id(records, SCHEMA)
    assert name == segments.segment_id(records.repartition(5), SCHEMA) != segments.segment_id(records.filter("doc_id > 0"), SCHEMA)
    index = ix.build(records, SCHEMA)
    assert segments.load(spark, folder) is None
    assert segments.save(index, folder, name, "2024-01-01") is True
    assert segments.save(index, folder, name, "2025-01-01") is False
    m = segments.manifest(spark, folder)
    assert (m["latest_segment_id"], m["created_at"], m["doc_count"]) == (name, "2024-01-01", 40)
    asked = spark.createDataFrame([(1, "routing servers")], "query_id int, text string")
    stored = segments.load(spark, folder)
    assert stored.schema == index.schema
    assert se.search(stored, asked, 5).collect() == se.search(index, asked, 5).collect()
    segments.save(index, folder, "other", "2024-02-01")
    assert segments.prune(spark, folder, keep=["other"]) == [name]
    assert segments.segments(spark, folder) == ["other"]


def test_merge_is_a_rebuild(spark):
    docs = corpus(5, 12)
    changed = [(3, "token", "token page"), (20, "new", "route route")]
    build = lambda rows: ix.build(rows, SCHEMA)
    merged = segments.merge(build(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(changed, DOCS), build)
    whole = build(spark.createDataFrame([d for d in docs if d[0] != 3] + changed, DOCS))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(merged.postings.select("field", "term", "doc_id", "tf", "positions")) == key(whole.postings.select("field", "term", "doc_id", "tf", "positions"))
    assert key(merged.field_stats) == key(whole.field_stats)


def test_snippets():
    assert "[[Configuration]]" in snippets.build_snippet("The Configuration is important", ["configuration"])
    out = snippets.highlight("serialize serializer serializers", ["serialize", "serializer", "serializers"])
    assert out.count("[[") == out.count("]]") == 3 and "[[[[" not in out
    assert snippets.highlight("see [api](http://api) and api", ["api"]) == "see [api](http://api) and [[api]]"
    assert snippets.build_snippet("", ["x"]) == snippets.build_snippet(None, []) == ""
    text = "First one. " + "word " * 60 + "needle here. Last sentence follows."
    got = snippets.build_snippet(text, ["needle"], 200, 50)
    assert "[[needle]]" in got and len(got) <= 204


def test_legacy_counts_repeats_of_a_single_term(spark):
    index = ix.build(spark.createDataFrame([(1, "", "a1 b1"), (2, "", "b1 c1")], DOCS), SCHEMA)
    asked = spark.createDataFrame([(1, "a1")], "query_id int, text string")
    row = se.legacy_search(index, asked).first()
    assert row.doc_id == 1 and row.score == pytest.approx(math.log(1.5 / 1.5))


def test_federated(spark):
    from quillspark.plans.search_queries import federated_search

    rows = federated_search(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["rank"] <= 10 for r in rows)


def test_postings_are_made_where_records_are_read(spark):
    docs = [(1, None, "It's a b1 b1"), (2, "", "--"), (3, "The İx ΑΣ. x_1", None), (4, "ab " * 7, "walking walked, walks " * 3)]
    index = ix.build(spark.createDataFrame(docs, DOCS), SCHEMA)
    plan = index.postings._jdf.queryExecution().optimizedPlan().toString() + index.postings._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    want = {}
    for i, title, body in docs:
        for field, text in (("title", title), ("body", body)):
            found = [t for t in one(spark, analysis.analyze()(F.lit(text or "")))]
            for p, t in enumerate(found):
                want.setdefault((field, t, i, len(found)), []).append(p)
    got = {(r.field, r.term, r.doc_id, r.doc_length): (r.tf, r.positions) for r in index.postings.collect()}
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_a_scan_is_a_search(spark):
    from quillspark.operators import scan

    docs = [*corpus(11, 150), (150, None, None), (151, "token", "auth token auth server"), *((200 + i, "", "alpha beta alpha") for i in range(70))]
    records = spark.createDataFrame(docs, DOCS).repartition(7)
    asked = spark.createDataFrame(list(enumerate(["routing servers", "tokn cofig", "auth token", "alpha beta", "zzzzzzzz", ""])), "query_id int, text string")
    index = ix.build(records, SCHEMA).__class__(SCHEMA, *(t.cache() for t in (lambda i: (i.postings, i.documents, i.field_stats, i.vocabulary))(ix.build(records, SCHEMA))))
    for options in ({}, {"expand": False, "fuzzy": False, "phrase": False}, {"k": 60, "boosts": {"body": 2.0}}):
        k = options.get("k", 5)
        rest = {n: v for n, v in options.items() if n != "k"}
        found = scan.rank(records, SCHEMA, asked, k, **rest)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan  # no posting meets a query as a row
        want = {(r.query_id, r["rank"], r.doc_id): r.score for r in se.search(index, asked, k, **rest).collect()}
        assert want and {(r.query_id, r["rank"], r.doc_id): r.score for r in found.collect()} == pytest.approx(want)
    want = se.fuzzy_terms(se.query_terms(asked, index), index.vocabulary).collect()
    assert want and sorted(scan.typos(records, SCHEMA, asked).collect()) == sorted(want)


def test_similar_by_blocks(spark, monkeypatch):
    from quillspark.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 8)
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)] if i % 6 else [1.0, 0.0, 0.0, 0.0], i % 2 if i < 50 else None) for i in range(55)]
    vectors += [(60, [0.0] * 4, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, [2.0], 0), (63, None, 0)]
    rows = spark.createDataFrame(vectors, "vec_id int, v array<double>, label int")
    asked = rows.filter("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "v AS q", "label AS q_label")
    pairs = rows.join(asked, F.col("label") == F.col("q_label")).select("query_id", "vec_id", ranking.cosine(F.col("q"), F.col("v")).alias("s")).filter("s >= 0.1").collect()
    want = {}
    for q in {r.query_id for r in pairs}:
        own = sorted(((-round(r.s, 6), r.vec_id, r.s) for r in pairs if r.query_id == q))[:5]
        want |= {(q, n, v): s for n, (_, v, s) in enumerate(own, 1)}
    found = similarity.similar(rows, asked, 0.1, 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r["rank"], r.vec_id): r.similarity for r in found.collect()} == pytest.approx(want)
