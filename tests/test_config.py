import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tenants as tn
from quillspark.sources import config, docc


def deployment(**more):
    return json.dumps({"infrastructure": {"search_max_segments": 4}, "tenants": [{"codename": "aa", "docs_name": "A", "docs_entry_url": "http://x, http://y", **more}]})


def test_tenants(spark, tmp_path):
    t = config.parse_tenants(deployment(search={"ranking": {"bm25_k1": 2.0}, "boosts": {"title": 4}}, refresh_schedule="0 2 * * mon", test_queries={"natural": ["how"], "words": ["x"]}))[0]
    assert t.docs_entry_url == ("http://x", "http://y") and t.search.ranking.bm25_k1 == 2.0 and t.search.boosts.title == 4 and t.synced
    assert t.search.snippet.fragment_char_limit == 240 and t.max_crawl_pages == 10000
    (tmp_path / "d.json").write_text(deployment())
    d = config.read_deployment(spark, f"file://{tmp_path}/d.json")
    assert d.infrastructure == {"search_max_segments": 4} and [x.codename for x in d.selected()] == ["aa"]
    assert d.tenant("zz") is None and not d.tenant("aa").synced
    with pytest.raises(ValueError):
        d.selected(["aa", "zz"])
    row = config.tenant_table(spark, [t]).first()
    assert row.url_prefixes == ["http://x", "http://y"] and row.test_queries == ["how", "x"]


@pytest.mark.parametrize(
    "odd",
    [{"nope": 1}, {"search": {"ranking": {"bm25_k1": 9}}}, {"search": {"x": 1}}, {"search": {"snippet": {"style": "loud"}}}, {"search": {"boosts": {"title": 6}}}, {"source_type": "ftp"}]
    + [{"source_type": "git"}, {"source_type": "filesystem"}, {"docs_entry_url": ""}, {"refresh_schedule": "daily"}, {"max_crawl_pages": 0}, {"codename": "A"}, {"docs_name": ""}],
)
def test_tenants_that_are_refused(odd):
    with pytest.raises(ValueError):
        config.parse_tenants(deployment(**odd))


def test_deployments_that_are_refused():
    whole = json.loads(deployment())
    for odd in ({"more": 1}, {"infrastructure": {"port": 1}}, {"infrastructure": {"operation_mode": "away"}}, {"tenants": []}, {"tenants": whole["tenants"] * 2}):
        with pytest.raises(ValueError):
            config.parse_deployment(json.dumps(whole | odd))


def test_overlay(spark):
    found = spark.createDataFrame([("a", "on disk", 3), ("b", "on disk", 4)], "codename string, name string, docs int")
    some = spark.createDataFrame([("a", "named"), ("c", None)], "codename string, name string")
    assert {tuple(r) for r in tn.overlay(found, some).collect()} == {("a", "named", 3), ("c", None, None)}
    assert tn.overlay(found, some.limit(0)).count() == 2


def test_docc(spark):
    page = {"metadata": {"title": "View"}, "abstract": [{"type": "text", "text": "Shows "}, {"type": "codeVoice", "code": "x"}], "references": {"r": {"title": "Other", "url": "/o"}}, "primaryContentSections": [{"content": [{"type": "heading", "level": 2, "text": "Use"}, {"type": "paragraph", "inlineContent": [{"type": "reference", "identifier": "r"}]}, {"type": "unorderedList", "items": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "one"}]}]}]}]}], "topicSections": [{"title": "More", "identifiers": ["r"]}]}
    rows = spark.createDataFrame([(json.dumps(page),), ("no json",), (None,)], "p string").select(docc.markdown(F.col("p")).alias("m")).collect()
    assert rows[0].m == "# View\n\nShows `x`\n\n## Use\n\n[Other](/o)\n\n- one\n\n## More\n\n- [Other](/o)\n"
    assert rows[1].m is None and rows[2].m is None
