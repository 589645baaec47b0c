"""Queries over ingest: urls, html, headings, languages, keywords, audits and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import analysis, ranking, text, urls
from quillspark.operators import tenants as tn
from quillspark.operators import records as rec
from quillspark.operators import similarity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def url_allow(spark, sf_dir):
    p = _pages(spark, sf_dir)
    rules = (["https://www.", "http://blog."], ["https://www.cheap-pills"])
    return p.select("page_id", urls.allowed(F.col("url"), *rules).alias("crawl"), urls.allowed_for_index(F.col("url"), *rules).alias("record"))


def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


def url_path(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.url_path(F.col("url")).alias("path"))


def url_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.file_name(F.col("url")).alias("file"))


def url_markdown_path(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.markdown_path(u).alias("markdown"), urls.metadata_path(u).alias("metadata"))


def url_markdown_query(spark, sf_dir):
    """Paths with the query in the name, of urls with one more parameter."""
    bare = F.regexp_replace("url", "#.*$", "")
    u = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("b+c=%C3%A9+x&a=1&empty="))
    return _pages(spark, sf_dir).select("page_id", urls.markdown_path(u, True).alias("markdown"), urls.canonical(u, True).alias("canonical"))


def url_mirror(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.markdown_mirror(F.col("url")).alias("mirror"))


def url_slug(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.semantic_slug(F.col("url")).alias("slug"), urls.public_prefix(F.col("url")).alias("prefix"), urls.is_asset(F.col("url")).alias("asset"))


def language_detect(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.language(F.col("url")).alias("language"))


def html_extract(spark, sf_dir):
    h = F.col("html")
    body = text.html_text(h)
    return _pages(spark, sf_dir).select("page_id", text.html_title(h).alias("title"), F.array_join(text.html_headings(h, 1), "\n").alias("h1"), F.length(body).alias("chars"), text.enough_words(body).alias("accepted"))


def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.html_title(F.col("html")).alias("title"))


def link_frontier(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", F.explode(text.html_links(F.col("html"))).alias("link"))
    return p.groupBy("link").agg(F.count_distinct("page_id").alias("pages"))


def headings_extract(spark, sf_dir):
    """Headings and excerpts of a markdown form of the documents: the first line as a heading."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), F.coalesce("text", F.lit(""))).alias("md"))
    return d.select("doc_id", F.array_join(text.headings(F.col("md"), (1,)), "\n").alias("h1"), text.excerpt(F.col("md")).alias("excerpt"))


def doc_by_url(spark, sf_dir):
    p = _pages(spark, sf_dir)
    wanted = p.filter("page_id % 7 = 0").select(F.concat(F.upper(F.regexp_replace("url", "/+$", "")), F.lit("/")).alias("asked"))
    return rec.by_url(p, wanted).select("asked", "page_id")


def keyword_extract(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    b = _read(spark, sf_dir, "benchmark")
    join = lambda a: F.array_join(a, " ")
    return b.select("item_id", join(text.acronyms(t, starts=True)).alias("acronyms"), join(text.technical_nouns(t)).alias("nouns"), join(text.technical_terms(t)).alias("terms"), join(text.verb_forms(t)).alias("verbs"))


def query_analyze(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(text.query_words(F.coalesce("text", F.lit(""))), " ").alias("words"))


def dedupe_canonical(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("key", F.lower(urls.canonical(F.col("url"))))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("page_id"))
    return p.withColumn("nth", nth).filter("nth = 1").select("key", "page_id")


def corpus_fingerprint(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("source", F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rec.fingerprints(d, "source", "doc_id", ["text"]).select("source", "documents", "fingerprint")


def orphan_audit(spark, sf_dir):
    d, lab = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("orphans"))


def query_mining(spark, sf_dir):
    t = _read(spark, sf_dir, "documents").select("source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return tn.frequent_words(t, "source", "title", 6)


def tenant_find(spark, sf_dir):
    t = tn.tenants_of(_read(spark, sf_dir, "nation").select(F.lower("n_name").alias("codename"), F.col("n_name").alias("display_name"), F.concat(F.lit("documents of region "), F.col("n_regionkey").cast("string")).alias("description")))
    asked = spark.createDataFrame([(1, "nation_7"), (2, "nation_12 guide"), (3, "natoin 3"), (4, "region 2")], "query_id int, query string")
    return tn.find(t, asked).select("query_id", "rank", "codename", F.round("score", 6).alias("score"))


def cosine_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    return similarity.similar(e, asked, threshold=0.1, limit=5).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def character_embedding(spark, sf_dir):
    p = _pages(spark, sf_dir)
    v = text.character_vector()(urls.semantic_slug(F.col("url")))
    return p.select("page_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))


def clean_text(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", F.sha2(text.clean_markdown(text.html_text(F.col("html"))), 256).alias("clean_sha"), F.sha2(text.direct_markdown(text.html_text(F.col("html"))), 256).alias("direct_sha"))


_HOST = r"regexp_extract(url, '://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1))"
_U = "u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)"
_SLASHED = f"CASE WHEN string_split(rtrim({_PATH}, '/'), '/')[-1] LIKE '%.%' OR {_PATH} LIKE '%/' THEN {_PATH} ELSE {_PATH} || '/' END"
_ISFILE = r"regexp_matches(lower({p}), '\.(html|htm|pdf|txt|xml|json|yaml|yml|md|rst)$')"
_CANON = f"{_SCHEME} || lower({_HOST}) || CASE WHEN {_PATH} = '' THEN '/' WHEN {_ISFILE.format(p=_PATH)} OR {_PATH} LIKE '%/' THEN {_PATH} ELSE {_PATH} || '/' END"
# A query's pairs, decoded and sorted, and encoded again as a form's.
_DECODED = "list_sort(list_transform(list_filter(string_split({q}, '&'), lambda x: regexp_matches(x, '=.')), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(x[strpos(x, '=') + 1:], '+', ' '))}}))"
_ENCODED = "array_to_string(list_transform({d}, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&')"
_PAIRS = _ENCODED.format(d=f"list_filter({_DECODED.format(q=_QUERY)}, lambda x: x.k <> 'rg')")


def _safe(part):
    """A part of a path as a folder's name."""
    cleaned = f"regexp_replace(regexp_replace(regexp_replace(replace(lower(url_decode({part})), ' ', '-'), '[^a-z0-9._-]', '_', 'g'), '[-_]+', '-', 'g'), '^[-_.]+|[-_.]+$', '', 'g')"
    return f"list_transform([{cleaned}], lambda n: CASE WHEN n = '' THEN 'index' WHEN length(n) > 100 THEN n[:91] || '-' || sha256(n[101:])[:8] ELSE n END)[1]"


def _stored(query):
    """CTEs that end in ``named(page_id, url, path)``: where each url's text is stored."""
    suffix = "''"
    if query:
        suffix = f"list_transform([array_to_string(list_transform({_DECODED.format(q=_QUERY)}, lambda x: {_safe('x.k')} || '_' || {_safe('x.v')}), '__')], lambda j: CASE WHEN j = '' THEN '' WHEN length('__q__' || j) <= 80 THEN '__q__' || j ELSE '__q__hash_' || sha256(j)[:12] END)[1]"
    return f"""s AS (SELECT page_id, url, {_safe(f'lower({_HOST})')} AS host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts, {suffix} AS suffix FROM u),
        n AS (SELECT page_id, url, host, list_transform(parts[:-2], lambda x: {_safe('x')}) AS folders, coalesce(parts[-1], 'index') AS last, suffix FROM s),
        f AS (SELECT page_id, url, host, folders, CASE WHEN last LIKE '%.md' THEN last[:-4] || suffix || '.md' WHEN lower(last) LIKE '%.md' THEN last || suffix ELSE last || suffix || '.md' END AS name FROM n),
        w AS (SELECT *, array_to_string(list_concat([host], folders, [name]), '/') AS whole FROM f),
        named AS (SELECT page_id, url, CASE WHEN length(whole) <= 200 THEN whole WHEN len(folders) = 0 THEN 'truncated-' || sha256(whole)[:16] || '/' || name ELSE host || '/' || sha256(array_to_string(folders, '/'))[:16] || '/' || name END AS path FROM w)"""


def _starts(prefixes):
    return " OR ".join(f"starts_with(url, '{p}')" for p in prefixes)


_ALLOW = f"(({_starts(['https://www.', 'http://blog.'])}) AND NOT ({_starts(['https://www.cheap-pills'])}))"
_LANG = " ".join(f"WHEN contains(lower(url), '{m}') THEN '{c}'" for m, c in text.LANGUAGE_MARKS)
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.KEYWORD_STOPS) + "]"
_ACR = "[" + ", ".join(f"'{w}'" for w in text.NOT_ACRONYMS) + "]"


_WORDCHARS = r"\p{L}\p{N}_"


def _whole(pattern, of="t", chars=r"[\p{L}\p{N}_]+"):
    """Runs of letters, digits and underscores of any script that match the pattern as a whole."""
    return f"list_filter(regexp_extract_all({of}, '{chars}'), lambda x: regexp_matches(x, '^(?:{pattern})$'))"


_VERBS = " || ".join(_whole(v + r"[\p{L}\p{N}_]+", "lower(t)") for v in text.VERB_STEMS)

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_UNESCAPED = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_DROPPED = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg"))
_BODY_TEXT = f"""bare AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is){_DROPPED}', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM u),
        body AS (SELECT page_id, html, CASE WHEN regexp_extract(h, '(?is)<body[^>]*>(.*)', 1) <> '' THEN regexp_extract(h, '(?is)<body[^>]*>(.*)', 1) ELSE h END AS h FROM bare),
        shown AS (SELECT page_id, html, array_to_string(list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: {_TRIM.format(x=_UNESCAPED.format(x='x'))}), lambda x: x <> ''), chr(10)) AS body FROM body)"""

SQL = {
    "url_allow": f"WITH {_U} SELECT page_id, url <> '' AND {_ALLOW} AS crawl, CASE WHEN trim(url) = '' THEN false ELSE {_ALLOW} END AS record FROM u",
    "url_canonical": f"WITH {_U} SELECT page_id, {_CANON} AS canonical FROM u",
    "url_path": f"WITH {_U} SELECT page_id, {_PATH} AS path FROM u",
    "url_hash": f"WITH {_U} SELECT page_id, sha256({_SCHEME} || {_HOST} || {_SLASHED} || CASE WHEN {_PAIRS} <> '' THEN '?' || {_PAIRS} ELSE '' END) || '.md' AS file FROM u",
    "url_markdown_path": f"WITH {_U}, {_stored(False)} SELECT page_id, path AS markdown, '__docs_metadata/' || regexp_replace(path, '\\.[^./]*$', '.meta.json') AS metadata FROM named",
    "url_markdown_query": f"WITH u0 AS (SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS url FROM pages), u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b+c=%C3%A9+x&a=1&empty=' AS url FROM u0), {_stored(True)} SELECT page_id, path AS markdown, {_CANON} || list_transform([{_ENCODED.format(d=_DECODED.format(q=_QUERY))}], lambda x: CASE WHEN x = '' THEN '' ELSE '?' || x END)[1] AS canonical FROM named",
    "url_mirror": f"""WITH {_U}, m AS (SELECT page_id, {_SCHEME} AS head, {_HOST} AS host, rtrim({_PATH}, '/') AS bare FROM u),
        x AS (SELECT *, string_split(bare, '/')[-1] AS last, lower(regexp_extract(string_split(bare, '/')[-1], '\\.([^.]*)$', 1)) AS ext FROM m)
        SELECT page_id, CASE WHEN head IN ('http://', 'https://') AND host <> '' AND bare <> '' AND NOT regexp_matches(bare, '[\\s<>\\[\\]()]|%20|%5B|%3C') THEN
            head || host || CASE WHEN bare LIKE '%.md' THEN bare WHEN NOT contains(last, '.') THEN bare || '.md' WHEN ext IN ('html', 'htm', 'ipynb') THEN regexp_replace(bare, '\\.[^.]*$', '') || '.md' END END AS mirror FROM x""",
    "html_extract": f"""WITH {_U}, {_BODY_TEXT} SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
        array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), lambda x: {_TRIM.format(x="regexp_replace(" + _UNESCAPED.format(x="regexp_replace(x, '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g')")}), lambda x: x <> ''), chr(10)) AS h1,
        length(body)::INTEGER AS chars, len(regexp_split_to_array({_TRIM.format(x='body')}, '\\s+')) >= 150 AS accepted FROM shown""",
    "clean_text": f"""WITH {_U}, {_BODY_TEXT},
        c AS (SELECT page_id, body, regexp_replace(regexp_replace(regexp_replace(body, '(?m)^[ \\t\\x0b\\x0c\\r]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g') AS clean, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM shown),
        l AS (SELECT page_id, body, clean, list_transform(ls, lambda x: CASE WHEN {_TRIM.format(x='x')} = '' THEN '' ELSE x END) AS ls FROM c),
        k AS (SELECT page_id, body, clean, list_filter(ls, lambda x, i: x <> '' OR i = 1 OR ls[greatest(i - 1, 1)] <> '') AS ls FROM l),
        d AS (SELECT page_id, body, clean, array_to_string(list_transform(ls, lambda x: regexp_extract(x, '^ *') || CASE WHEN starts_with(ltrim(x, ' '), '```') THEN ltrim(x, ' ') ELSE regexp_replace(ltrim(x, ' '), '([^` ]|^) {{3,}}', '\\1  ', 'g') END), chr(10)) AS direct FROM k)
        SELECT page_id, sha256({_TRIM.format(x='clean')}) AS clean_sha, sha256(CASE WHEN {_TRIM.format(x='body')} = '' THEN '' WHEN direct LIKE '%' || chr(10) THEN direct ELSE direct || chr(10) END) AS direct_sha FROM d""",
    "character_embedding": f"""WITH {_U}, s AS (SELECT page_id, url, lower(trim(translate({_PATH}, '-_', '  '))) AS p, regexp_extract(url, '#(.*)$', 1) AS ref FROM u),
        g AS (SELECT page_id, CASE WHEN ref <> '' THEN trim(p || ' #' || lower(ref)) WHEN p <> '' THEN p ELSE lower(url) END AS slug FROM s),
        h AS (SELECT page_id, CASE WHEN {_TRIM.format(x='slug')} = '' THEN 'unknown' ELSE {_TRIM.format(x='slug')} END AS slug FROM g),
        v AS (SELECT page_id, list_transform(range(16), lambda b: list_sum(list_transform(range(b, greatest(length(slug), b + 1), 16), lambda i: CASE WHEN regexp_matches(slug[i + 1], '[\\p{{L}}\\p{{N}}]') THEN unicode(slug[i + 1]) ELSE 0 END))::DOUBLE) AS v FROM h),
        n AS (SELECT page_id, v, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 1.0 ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END AS norm FROM v)
        SELECT page_id, list_transform(v, lambda x: round(x / norm, 6)) AS embedding FROM n""",
    "language_detect": f"WITH {_U} SELECT page_id, CASE {_LANG} ELSE 'en' END AS language FROM u",
    "html_title": f"WITH {_U} SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM u",
    "link_frontier": f"""WITH {_U}, l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=["'']([^"''#]+)', 1)) AS link FROM u) SELECT link, count(DISTINCT page_id) AS pages FROM l GROUP BY link""",
    "doc_by_url": f"WITH {_U}, w AS (SELECT upper(rtrim(url, '/')) || '/' AS asked FROM u WHERE page_id % 7 = 0) SELECT DISTINCT asked, (SELECT min(page_id) FROM u WHERE lower(rtrim(u.url, '/')) = lower(rtrim(w.asked, '/'))) AS page_id FROM w",
    "keyword_extract": f"""WITH b AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark)
        SELECT item_id,
               array_to_string(list_filter({_whole('[A-Z]{2,6}')}, lambda x: NOT list_contains({_ACR}, x)), ' ') AS acronyms,
               array_to_string(list_filter({_whole('[a-z][a-z0-9]{2,}', 'lower(t)')}, lambda x: NOT list_contains({_STOPS}, x) AND length(x) > 3), ' ') AS nouns,
               array_to_string({_whole('[a-z]+_[a-z_]+')} || {_whole('[A-Z][a-z]+[A-Z][a-zA-Z]+')} || {_whole('[a-z]+-[a-z-]+', chars='[\\p{L}\\p{N}_-]+')}, ' ') AS terms,
               array_to_string({_VERBS}, ' ') AS verbs
        FROM b""",
    "query_analyze": f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^{_WORDCHARS}]+'), lambda x: x <> '' AND NOT list_contains({_STOPS}, x)), ' ') AS words FROM benchmark",
    "url_slug": f"""WITH {_U}, s AS (SELECT page_id, url, lower(trim(translate({_PATH}, '-_', '  '))) AS p, regexp_extract(url, '#(.*)$', 1) AS ref FROM u),
        g AS (SELECT page_id, url, CASE WHEN ref <> '' THEN trim(p || ' #' || lower(ref)) ELSE p END AS slug FROM s)
        SELECT page_id, CASE WHEN slug <> '' THEN slug ELSE lower(url) END AS slug, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/@]*@', '\1') AS prefix, regexp_matches({_PATH}, '{urls.ASSETS}') AS asset FROM g""",
    "headings_extract": r"""WITH l AS (SELECT doc_id, list_transform(string_split('# ' || coalesce(text, ''), chr(10)), lambda x: trim(x)) AS ls FROM documents),
        m AS (SELECT doc_id, ls, list_transform(ls, lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '```')) AS ok FROM l),
        f AS (SELECT doc_id, ls, ok, coalesce(list_position(ok, true), 0) AS p FROM m),
        r AS (SELECT doc_id, ls[1] AS head, p, ls[p:] AS rest, coalesce(list_position(ok[p:], false), 0) AS stop FROM f)
        SELECT doc_id, trim(regexp_replace(head[2:], '\s+', ' ', 'g')) AS h1,
               CASE WHEN p = 0 THEN '' ELSE trim(regexp_replace(array_to_string(CASE WHEN stop > 0 THEN rest[:stop - 1] ELSE rest END, ' '), '\s+', ' ', 'g'))[:320] END AS excerpt
        FROM r""",
    "dedupe_canonical": f"WITH {_U} SELECT lower({_CANON}) AS key, min(page_id) AS page_id FROM u GROUP BY 1",
    "corpus_fingerprint": "WITH d AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT source, count(*) AS documents, sha256(string_agg(doc_id::VARCHAR || ':' || h, chr(10) ORDER BY doc_id, h)) AS fingerprint FROM d GROUP BY source",
    "orphan_audit": "SELECT source, count(*) AS orphans FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source",
    "query_mining": f"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+')) AS word FROM documents),
        c AS (SELECT source, word, count(*) AS uses FROM w WHERE length(word) >= 4 AND NOT list_contains({_STOPS}, word) GROUP BY ALL)
        SELECT source, word, uses, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY uses DESC, word) AS rank FROM c) WHERE rank <= 6""",
    "tenant_find": """WITH t AS (SELECT lower(n_name) AS codename, lower(n_name) AS display, 'documents of region ' || n_regionkey AS descr FROM nation),
        q(query_id, query) AS (VALUES (1, 'nation_7'), (2, 'nation_12 guide'), (3, 'natoin 3'), (4, 'region 2')),
        f AS (SELECT query_id, query, codename, unnest([codename, display, descr]) AS field, unnest([3.0, 2.5, 1.5]) AS weight FROM t, q),
        terms AS (SELECT *, unnest(string_split(query, ' ')) AS term FROM f),
        s AS (SELECT query_id, query, codename, field, weight, term,
                CASE WHEN contains(field, term) THEN 0.8
                     ELSE coalesce((SELECT max(0.7 - 0.2 * levenshtein(term, w)) FROM unnest(regexp_split_to_array(field, '[-_ ]+')) AS x(w) WHERE length(term) >= 3 AND length(w) >= 3 AND levenshtein(term, w) <= 2), 0) END AS one FROM terms),
        g AS (SELECT query_id, codename, CASE WHEN contains(field, query) THEN weight ELSE avg(one) * weight END AS score FROM s GROUP BY query_id, query, codename, field, weight),
        b AS (SELECT query_id, codename, least(max(score), 1.0) AS score FROM g GROUP BY ALL)
        SELECT query_id, rank, codename, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, codename) AS rank FROM b WHERE score > 0.1) WHERE rank <= 10""",
    "cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS similarity FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 20 = 0)
        SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, vec_id) AS rank FROM s WHERE similarity >= 0.1) WHERE rank <= 5""",
}

NAMES = ("url_allow", "url_canonical", "url_path", "url_hash", "url_markdown_path", "url_markdown_query", "url_mirror", "url_slug", "language_detect", "html_extract", "html_title", "link_frontier", "headings_extract", "doc_by_url", "keyword_extract", "query_analyze", "dedupe_canonical", "corpus_fingerprint", "orphan_audit", "query_mining", "tenant_find", "cosine_topk", "character_embedding", "clean_text")
FUNCTIONS = {n: globals()[n] for n in NAMES}
