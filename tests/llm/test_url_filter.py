from quillspark.llm import url_filter as uf

PAGES = "page_id bigint, url string, rule string, host string"


def test_split():
    assert uf.split_url(None) == uf.split_url("a.org/x") == uf.split_url("") == ("", "")
    assert uf.split_url("HTTP://Ex.ORG/A?b#c") == ("ex.org", "/A")
    assert uf.split_url("x://h?q") == ("h", "")
    assert uf.split_url("x://a/b://c/d") == ("a", "/b://c/d")


def longest(url, rules=uf.HOST_RULES):
    """Every rule tried on the url."""
    host, path = uf.split_url(url)
    return max((r for r in rules if uf.fits(r, host, path)), key=lambda r: len(r[1] + r[2]), default=None)


def test_rules():
    assert longest("http://example.org/es/1") == ("block", "example.org", "/es/")
    assert longest("http://a.example.org/en/12") == ("block", "example.org", "/en/1")
    assert longest("http://badexample.org/es/1") == ("allow", "org", "/")
    assert longest("http://x.org") is None
    assert longest("http://com/fr/") == ("allow", "com", "/fr/")
    assert longest("http://x.com/de/1") == ("block", "com", "/de/")


def test_tokens_of_rules():
    assert uf.rule_tokens(("block", "example.org", "/en/1")) == ("example", "org", "en")
    assert uf.rule_tokens(("block", "org", "/")) == ("org",)
    assert uf.rule_tokens(("block", "a-b.org", "/x_Y/z.")) == ("a", "b", "org", "x", "y", "z")
    assert uf.rule_tokens(("allow", "", "/e")) == uf.rule_tokens(("allow", "", "")) == ()


def test_rarest_token():
    rules = [p.tokens for p in uf.PATTERNS]
    index = uf.index_rules({"spam": 9, "farm": 2, "cheap": 0, "pills": 1} | dict.fromkeys({t for p in uf.PATTERNS for t in p.tokens} - {"spam", "farm", "cheap", "pills"}, 5), rules)
    assert 0 in index["farm"] and "spam" not in index
    assert 1 in index["cheap"]
    assert uf.index_rules({}, [(), ()]) == {"": [0, 1]}


def test_rules_of_a_table_against_every_rule(spark):
    import random

    rnd = random.Random(3)
    labels, parts = ["a", "b", "shop", "org", "com", "x-1"], ["en", "es", "1", "12", "Q", "é", "a_b"]
    rows = [(k, rnd.choice(["allow", "block"]), ".".join(rnd.choices(labels, k=rnd.randint(1, 3))), "/" + "/".join(rnd.choices(parts, k=rnd.randint(0, 2))), None, None) for k in range(60)]
    rows += [(60, "block", "", "/zz", None, None), (61, "block", None, None, r"[?&]ref=x", ["ref", "x"]), (62, "allow", None, None, r"#top$", None)]
    table = spark.createDataFrame(rows, "nth int, verdict string, host string, path string, regex string, tokens array<string>")
    hosts, patterns = uf.read_rules(table)
    assert len(hosts) == 61 and [p.tokens for p in patterns] == [("ref", "x"), ()]
    urls = ["HTTP://" + ".".join(rnd.choices(labels, k=rnd.randint(1, 4))).upper() + "/" + "/".join(rnd.choices(parts, k=rnd.randint(0, 3))) + rnd.choice(["", "?ref=x", "#top", "/"]) for _ in range(400)]
    urls += ["a.org?ref=x", "", None, "://", "://org/", "http://K.org/Kx"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for r in uf.judge_urls(pages, hosts, patterns).collect():
        fit = longest(urls[r.page_id], hosts)
        if fit:
            assert (r.rule, r.verdict) == (fit[1] + fit[2], fit[0])
        else:
            low = (urls[r.page_id] or "").lower()
            assert r.rule is None and r.verdict == ("block" if "?ref=x" in low else "allow")
    assert uf.judge_urls(pages, (), ()).filter("verdict = 'allow' AND rule IS NULL").count() == len(urls)


def test_judge(spark):
    rows = [(1, "http://www.cheap-pills.example.net/en/1", "", ""), (2, None, "", ""), (3, "http://shop.net/cheap/pills", "", ""), (4, "http://free-bets.example.org/x", "", ""), (4, "http://free-bets.example.org/x", "", ""), (None, "http://a.net/?sessionid=0123456789abcdef0", "", "")]
    got = {r.page_id: r for r in uf.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1].verdict == "block" and got[1].rule is None and got[1].pattern
    assert got[2].verdict == "allow" and got[2].host == ""
    assert got[3].verdict == "allow"
    assert got[4].verdict == "allow" and got[4].rule == "org/"
    assert got[None].verdict == "block"
    assert uf.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_patterns_hold_their_tokens():
    samples = ["https://spam-farm.a", "https://x.cheap-pills.b", "ftp://free-bets.c/", "a://adult-x9.d", "a://b/?sessionid=00112233445566778", "a://b/wp-login.php", "a://b/robots.txt"]
    import re
    for p, s in zip(uf.PATTERNS, samples):
        assert re.search(p.regex, s) and set(p.tokens) <= set(re.findall(r"[a-z0-9]+", s))
