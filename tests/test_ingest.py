import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import records as rec
from quillspark.operators import tenants as tn
from quillspark.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_headings_and_excerpt(spark):
    md = "# One [¶](#one)\n\ntext  here\nmore\n\n## Two   words\n### Three\n####### no\n```\n# In a fence\n```\n"
    assert one(spark, md, lambda c: text.headings(c, (1,))) == ["One", "In a fence"]
    assert one(spark, md, lambda c: text.headings(c, (2,))) == ["Two words"]
    assert one(spark, md, lambda c: text.headings(c, (3, 4, 5, 6))) == ["Three"]
    assert one(spark, md, text.excerpt) == "text here more"
    assert one(spark, "# only\n", text.excerpt) == "" == one(spark, "", text.excerpt)


def test_front_matter(spark):
    doc = "-----\nurl: https://a.b/c\ntitle: 'A: title'\n-----\n# Body\n"
    row = one(spark, doc, text.front_matter)
    assert row["fields"] == {"url": "https://a.b/c", "title": "A: title"} and row["body"] == "# Body\n"
    for plain in ("no block", "-----\n[broken\n-----\nx"):
        row = one(spark, plain, text.front_matter)
        assert row["fields"] == {} and row["body"] == plain
    fields = F.create_map(*(F.lit(x) for x in ("b", "2", "a", "plain text", "c", "x: y", "d", "it's")))
    out = one(spark, "# x", lambda c: text.with_front_matter(fields, c))
    assert out == "-----\na: plain text\nb: '2'\nc: 'x: y'\nd: 'it''s'\n-----\n# x"
    assert one(spark, out, text.front_matter)["fields"] == {"a": "plain text", "b": "2", "c": "x: y", "d": "it's"}


def test_front_matter_with_lists_and_maps(spark):
    doc = "-----\ntags:\n  - one\n  - two words\nmeta:\n  k: 1\nflag: true\na: 1\na: 2\n-----\nbody"
    fields = one(spark, doc, text.front_matter)["fields"]
    assert fields == {"tags": '["one", "two words"]', "meta": '{"k": 1}', "flag": "true", "a": "2"}
    assert one(spark, fields["tags"], text.tags) == ["one", "two words"]
    assert one(spark, "single", text.tags) == ["single"] and one(spark, None, text.tags) == []
    assert text._plain_fields("a: 1\n# note\nb: 'x y'") == {"a": "1", "b": "x y"} and text._plain_fields("- item") is None


def test_paths_of_urls(spark):
    path = lambda u, q=False: one(spark, u, lambda c: urls.markdown_path(c, q))
    assert path("https://docs.djangoproject.com/en/5.2/intro/tutorial01/") == "docs.djangoproject.com/en/5.2/intro/tutorial01.md"
    assert path("https://docs.python.org/3/library/asyncio.html") == "docs.python.org/3/library/asyncio.html.md"
    assert path("https://example.com") == "example.com/index.md"
    assert path("https://e.com/a/b.md?x=1") == "e.com/a/b.md"
    assert path("https://e.com:80/My%20Dir/__X__/v1.2?x") == "e.com-80/my-dir/x/v1.2.md"
    assert path("https://e.com/x?b=2&a=1+z&c=", True) == "e.com/x__q__a_1-z__b_2.md"
    assert path("https://e.com/x?k=" + "v" * 100, True).startswith("e.com/x__q__hash_") and len(path("https://e.com/x?k=" + "v" * 100, True)) == 32
    assert path("https://e.com/" + "y" * 300) == "truncated-" + __import__("hashlib").sha256(("e.com/" + "y" * 300 + ".md").encode()).hexdigest()[:16] + "/" + "y" * 300 + ".md"
    assert one(spark, "https://docs.djangoproject.com/en/5.2/intro/tutorial01/", urls.metadata_path) == "__docs_metadata/docs.djangoproject.com/en/5.2/intro/tutorial01.meta.json"
    assert one(spark, "https://d.com/x?a&b=%20~*", lambda c: urls.canonical(c, True)) == "https://d.com/x/?b=+~%2A"


def test_language(spark):
    assert [one(spark, u, text.language) for u in ("http://x/ja/a", "http://de.x/a", "http://x/zh-cn/a", "http://x/", None)] == ["ja", "de", "zh", "en", "en"]
    assert one(spark, "http://x/ja/", lambda c: text.language(c, F.lit(" EN-us1 "))) == "en-us"


def test_markdown(spark):
    assert one(spark, "a\n\n\n\nb   c\t d\n", text.clean_markdown) == "a\n\nb c d"
    assert one(spark, "﻿a    b\r\n\r\n\r\n  x   `   y\n```   k", text.direct_markdown) == "a  b\n\n  x  `   y\n```   k\n"
    assert one(spark, "  \n", text.direct_markdown) == ""


def test_html(spark):
    html = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><script>x<1</script><h1>Top <b>one</b></h1><!-- c --><p>text</p><a href='/x#y'>l</a></body></html>"
    assert one(spark, html, text.html_title) == "A &amp; B"
    assert one(spark, html, text.html_text) == "Top\none\ntext\nl"
    assert one(spark, html, lambda c: text.html_headings(c, 1)) == ["Top one"]
    assert one(spark, html, text.html_links) == ["/x"]


def test_urls(spark):
    assert one(spark, "https://Docs.Example.com/Page#section", urls.canonical) == "https://docs.example.com/Page/"
    assert one(spark, "https://d.com/guide.html?b=2&a=1", urls.canonical) == "https://d.com/guide.html"
    assert one(spark, "https://d.com/x?b=2&a=1", lambda c: urls.canonical(c, True)) == "https://d.com/x/?a=1&b=2"
    assert one(spark, "https://d.com", urls.canonical) == "https://d.com/"
    assert one(spark, "https://d.com/a/b.html", urls.markdown_mirror) == "https://d.com/a/b.md"
    assert one(spark, "https://d.com/a/b.png", urls.markdown_mirror) is None
    assert one(spark, "https://d.com/A-b_c#F", urls.semantic_slug) == "/a b c #f"
    long = one(spark, "https://d.com/" + "/".join(["segment"] * 80), urls.markdown_path)
    assert len(long.split("/")) == 3 and len(long.split("/")[1]) == 16
    a, b = (one(spark, u, urls.file_name) for u in ("https://d.com/x?b=1&a=2&rg=9#z", "https://d.com/x/?a=2&b=1"))
    assert a == b


def test_allowed(spark):
    f = lambda c: urls.allowed(c, ["http://a"], ["http://a/x"])
    assert [one(spark, u, f) for u in ("http://a/b", "http://a/x/y", "http://b", "", None)] == [True, False, False, False, False]
    assert one(spark, "", lambda c: urls.allowed_for_index(c)) is True
    assert one(spark, "", lambda c: urls.allowed_for_index(c, ["http"])) is False


def test_folder(spark, tmp_path):
    docs = tmp_path / "docs folder"
    (docs / "guide").mkdir(parents=True)
    (docs / ".git").mkdir()
    (docs / "__docs_metadata" / "guide").mkdir(parents=True)
    (docs / "guide" / "a.md").write_text("# Alpha\n\nBody of a.")
    (docs / "b.rst").write_text("-----\ntitle: Beta\nlanguage: DE\n-----\nBody of b.")
    (docs / ".git" / "c.md").write_text("no")
    (docs / "d.png").write_text("no")
    (docs / "__docs_metadata" / "guide" / "a.meta.json").write_text(json.dumps({"url": "https://x.org/guide/a", "title": "", "metadata": {"markdown_rel_path": "guide/a.md", "last_fetched_at": "2024-05-01T00:00:00+00:00"}}))
    (docs / "__docs_metadata" / "gone.meta.json").write_text(json.dumps({"url": "https://x.org/gone", "title": "Gone", "metadata": {"markdown_rel_path": "gone.md"}}))
    folder = f"file://{docs}"
    both = files.with_metadata(files.document_files(spark, folder), files.metadata_files(spark, folder))
    assert {(r.rel_path, r.error) for r in both.collect()} == {("guide/a.md", None), ("b.rst", None), ("gone.md", "missing file")}
    got = {r.doc_id: r for r in files.records(both).collect()}
    assert (got["guide/a.md"].url, got["guide/a.md"].title, got["guide/a.md"].timestamp) == ("https://x.org/guide/a", "Alpha", 1714521600)
    assert (got["b.rst"].url, got["b.rst"].title, got["b.rst"].language, got["b.rst"].excerpt) == ("file://b.rst", "Beta", "de", "Body of b.")


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a/2</loc></url></urlset>')
    path = f"file://{tmp_path}/s.xml"
    assert {(r.url, str(r.lastmod)[:10]) for r in files.sitemap(spark, path).collect()} == {("https://a/1", "2024-01-02"), ("https://a/2", "None")}
    none = spark.createDataFrame([], "path string, sha256 string")
    now = files.changed_sitemaps(spark, path, none)
    assert now.count() == 1 and files.changed_sitemaps(spark, path, now).count() == 0


def test_store(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    files.write_documents(spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, body string"), folder)
    files.write_documents(spark.createDataFrame([("u2", "c"), ("u3", "d")], "url string, body string"), folder)
    files.delete_documents(spark, folder, spark.createDataFrame([("u1",)], "url string"))
    assert {tuple(r) for r in files.read_documents(spark, folder).collect()} == {("u2", "c"), ("u3", "d")}


def test_audits(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "g string, fingerprint string")
    built = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "g string, fingerprint string")
    status = rec.audit(now, built, "g")
    assert {(r.g, r.status) for r in status.collect()} == {("a", "ok"), ("b", "stale"), ("c", "error"), ("d", "stale")}
    assert rec.worst_status(status).first().exit_code == 3
    meta = spark.createDataFrame([("u1", "p1"), ("u2", "p1"), ("u3", "p9"), ("x", "p2")], "url string, path string")
    found = spark.createDataFrame([("p1",), ("p2",)], "path string")
    why = {r.url: r.reason for r in rec.clean_up(meta, found, F.col("url") != "x").collect()}
    assert why == {"u1": None, "u2": "duplicate", "u3": "missing", "x": "disallowed"}


def test_tenants(spark):
    t = tn.tenants_of(spark.createDataFrame([("react-native", "React Native", "mobile"), ("react", "React", "ui")], "codename string, display_name string, description string"))
    asked = spark.createDataFrame([(1, "react native navigation"), (2, "raect")], "query_id int, query string")
    best = {r.query_id: r.codename for r in tn.find(t, asked).collect() if r["rank"] == 1}
    assert best[2] == "react"
    score = tn.command_line_score(F.col("query"), F.col("codename"), F.col("display_name"), F.col("description"))
    got = {(r.query_id, r.codename): r.s for r in t.crossJoin(asked).select("query_id", "codename", score.alias("s")).collect()}
    assert got[1, "react-native"] == pytest.approx(1.02) and got[1, "react"] == pytest.approx(1.01)
    assert got[2, "react"] == pytest.approx(0.1)


def test_acronyms_at_a_start(spark, tmp_path):
    from quillspark.plans.ingest_queries import keyword_extract

    rows = [(1, "One end. SS follows the API.\nJWT too. THE end"), (2, None)]
    spark.createDataFrame(rows, "item_id int, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.acronyms for r in keyword_extract(spark, f"file://{tmp_path}").collect()}
    assert got == {1: "SS API JWT", 2: ""}
    assert spark.range(1).select(text.acronyms(F.lit(rows[0][1])).alias("a")).first().a == ["API"]
