"""Queries over the steps of a crawl, lookups, stored values, metrics and text bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import processing as pr
from quillspark.operators import records as rec
from quillspark.operators import scan
from quillspark.plans import ingest_queries as iq
from quillspark.plans import search_queries as sq
from quillspark.plans import state_queries as stq
from quillspark.streaming import events as stream

_read = stq._read
_now = stq._now
RULES = (["https://", "http://blog."], ["https://www.cheap-pills", "https://news"])


def _pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def _cycle(spark, sf_dir):
    """Urls of the event log with what a cycle's fetches gave: every tenth isn't allowed, every sixth had no page."""
    u, key = stq._urls(spark, sf_dir), F.col("canonical_url")
    came = {
        "retry_count": F.col("failure_count").cast("int"),
        "allowed": key % 10 != 0,
        "page": F.when(key % 6 != 0, "p"),
        "from_cache": key % 2 == 0,
        "error": F.when(key % 17 == 0, "TimeoutError"),
        "failure_reason": F.when(key % 12 == 0, "http_404"),
        "lastmod": F.when(key % 5 == 1, F.col("first_seen_at")),
    }
    return u.withColumns(came)


def process_state(spark, sf_dir):
    return pr.process(_cycle(spark, sf_dir), _now(), 24 * 20)[0]


def process_events(spark, sf_dir):
    return pr.process(_cycle(spark, sf_dir), _now(), 24 * 20)[1].drop("event_at")


def mark_failed(spark, sf_dir):
    u = stq._urls(spark, sf_dir).select("canonical_url", "last_status", "next_due_at", F.col("failure_count").cast("int").alias("retry_count"), F.lit(None).cast("string").alias("last_failure_reason"))
    failed = u.filter("canonical_url % 3 = 0").select("canonical_url", F.lit("gone").alias("reason"))
    return pr.mark_failed(u, failed, _now())


def events_applied(spark, sf_dir):
    """Urls that are known (those of even number) after the whole log."""
    e = stq._events(spark, sf_dir)
    old = e.filter("canonical_url % 2 = 0").groupBy("canonical_url").agg(F.lit("success").alias("last_status"), F.min("event_at").alias("last_event_at"), F.lit(1).alias("cache_hit_count"))
    return pr.apply_events(old, e)


def blacklist_sweep(spark, sf_dir):
    """How many pages, tracked urls and files below folders the rules take away."""
    p = _pages(spark, sf_dir)
    _, gone = pr.sweep(p, urls.allowed(F.col("url"), *RULES))
    files = p.select(urls.markdown_path(F.col("url")).alias("path"))
    folders = pr.swept_folders(files, ["https://www.example.org/en", "https://news.example.com/"])
    _, old = pr.sweep(stq._urls(spark, sf_dir), F.col("canonical_url") % 4 != 0)
    counts = [d.agg(F.lit(kind).alias("kind"), F.count("*").alias("removed")) for kind, d in (("documents", gone), ("folders", folders), ("urls", old))]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def entry_redirects(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", "url")
    third, ninth = F.col("page_id") % 3 == 0, F.col("page_id") % 9 == 0
    probes = p.filter(third).select("url", F.concat(F.lit("https://moved.example.org/"), F.col("page_id") % 50).alias("final_url"), ninth.alias("blocked"))
    return pr.resolve_entries(p, probes, lambda u: urls.allowed(u, *RULES))


def kv_upsert(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("at"), "event_id")
    return pr.put_values(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


def sources_unchanged(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    before = d.filter("NOT (source = 'src1' AND modified % 7 = 0) AND source <> 'src2'")
    return pr.unchanged(rec.snapshot(d, "source"), rec.snapshot(before, "source"), "source")


def bounded_content(spark, sf_dir):
    b = text.bounded(F.coalesce("text", F.lit("")), 500)
    return _read(spark, sf_dir, "documents").select("doc_id", b.alias("b")).select("doc_id", "b.truncated", "b.original_chars", "b.returned_chars", "b.original_bytes", "b.returned_bytes", "b.sha256")


def excerpt_lines(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.first_lines(F.coalesce("text", F.lit("")), 200).alias("excerpt"))


def log_redaction(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", text.redacted(F.col("lang"), F.coalesce("text", F.lit("")), ["DE", "fr"], 100).alias("shown"))


def url_include(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.included(u, ["/EN/", "blog", ""]).alias("included"), urls.non_empty(urls.url_path(u)).alias("path"))


def block_detection(spark, sf_dir):
    from quillspark.sources import files

    status = (F.col("page_id") % 7 * 1 + 400).cast("int")
    page = F.concat(F.when(F.col("page_id") % 5 == 0, "<TITLE>Sorry</title> Google").when(F.col("page_id") % 5 == 1, "g-recaptcha automated queries").otherwise(""), F.col("html"))
    return _pages(spark, sf_dir).select("page_id", files.blocked(status, page).alias("blocked"), files.usable_probe(F.when(F.col("page_id") % 2 == 0, 200).otherwise(204), page).alias("usable"))


def sitemap_lastmod(spark, sf_dir):
    e = stq._events(spark, sf_dir)
    u = stq._urls(spark, sf_dir).select("canonical_url", F.col("canonical_url").cast("string").alias("url"))
    entries = e.filter("canonical_url % 2 = 1").select(F.col("canonical_url").cast("string").alias("url"), F.col("event_at").alias("lastmod"), F.col("event_id").alias("nth"))
    return pr.with_lastmod(u, entries)


def cleanup_summary(spark, sf_dir):
    return pr.cleanup_summary(_read(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("size")), F.col("source").isin("src1", "src3"))


def schedule_gap(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderdate").alias("at"))
    return pr.schedule_gap(o, "tenant", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("tenant", F.round("hours", 6).alias("hours"))


def tenant_listing(spark, sf_dir):
    """All tenants by name, and those without an event first, then the newest, numbered by place."""
    n = _read(spark, sf_dir, "nation").select(F.lower("n_name").alias("codename"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("last_event"))
    ranked = pr.newest_first(n, F.col("last_event")).limit(1000).select(F.collect_list("codename").alias("names"))
    return ranked.select(F.posexplode("names").alias("place", "codename"))


def search_metrics(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", F.abs("value").alias("latency_ms"), (F.col("event_id") % 5).alias("results"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    m = pr.search_metrics(e, "event_type")
    return m.select("event_type", "held", F.round("mean", 6).alias("mean"), "p95", "p99", "most", "searches", F.round("slow_rate", 6).alias("slow_rate"), F.round("empty_rate", 6).alias("empty_rate"))


def bloom_filter(spark, sf_dir):
    bits, hashes = pr.bloom_size(1000, 0.01)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pr.bloom_places(F.col("p_name"), bits, hashes), lambda x: x.cast("string")), " ").alias("bits"))


def fetch_documents(spark, sf_dir):
    """Pages by their url as a reader may write it: with or without a slash, with a fragment."""
    p = _pages(spark, sf_dir)
    odd = F.col("page_id") % 3
    asked = p.select(F.when(odd == 0, F.concat("url", F.lit("#top"))).when(odd == 1, F.regexp_replace("url", "/+$", "")).otherwise(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"))).alias("asked"))
    return rec.fetch(p, asked).select("asked", "page_id", F.sha2("html", 256).alias("body_sha"))


def search_stored(spark, sf_dir):
    """The full search's rows with what is stored of their documents."""
    rows = scan.rank_documents(sq._records(spark, sf_dir), sq._TWO, sq._queries(spark), 10, fields=("title", "body"))
    return rows.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "title", F.length("body").alias("body_chars"))


def streaming_state_machine(spark, sf_dir):
    """Every url's last state after the log ran through the stream's state machine."""
    rows = stream.drained(stream.url_state_machine(stream.event_stream(spark, f"{sf_dir}/events.parquet")), "update")
    last = rows.groupBy("canonical_url").agg(F.max_by(F.struct("last_status", "retry_count", "next_due_at"), F.struct(F.col("last_status") != "pending", "next_due_at")).alias("s"))
    return last.select("canonical_url", F.col("s.retry_count").alias("retry_count"), F.col("s.next_due_at").cast("timestamp_ntz").alias("next_due_at"))


_KIND = "CASE event_type WHEN 'view' THEN 'fetch_success' WHEN 'click' THEN 'cache_hit' WHEN 'signup' THEN 'crawl_discovered' WHEN 'purchase' THEN 'fetch_success' WHEN 'error' THEN 'fetch_failure' END"
_E = f"e AS (SELECT event_id, ts AS event_at, user_id AS canonical_url, {_KIND} AS event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events)"
_DUE = "({at} + to_days(CASE WHEN {seen} IS NULL THEN 7 WHEN floor(date_diff('second', {seen}, {at}) / 86400.0) < 7 THEN 1 WHEN floor(date_diff('second', {seen}, {at}) / 86400.0) < 30 THEN 7 ELSE 30 END))"
_RETRY = "({at} + to_hours(CAST(least(power(2.0, least({n}, 40) - 1), 720.0) AS INTEGER)))"
_URLS = f"""{_E}, l AS (SELECT canonical_url, arg_max(status, (event_at, event_id)) AS s, max(event_at) AS last_at, min(event_at) AS first_seen, count(*) FILTER (status = 'failed') AS failures FROM e GROUP BY 1),
    urls AS (SELECT canonical_url, CASE WHEN s = 'failed' THEN 'failed' WHEN canonical_url % 5 = 0 THEN 'pending' ELSE 'success' END AS last_status, first_seen, last_at,
             {_DUE.format(at='last_at', seen='(CASE WHEN canonical_url % 3 = 0 THEN first_seen END)')} AS next_due_at, failures::INTEGER AS retry_count FROM l)"""
_AT = f"TIMESTAMP '{stq._NOW}'"
_CYCLE = f"""WITH {_URLS}, c AS (SELECT *, CASE WHEN canonical_url % 10 = 0 THEN 'skip_filtered'
        WHEN last_status = 'success' AND date_diff('second', last_at, {_AT}) / 3600.0 < 480 THEN 'skip_recent'
        WHEN canonical_url % 17 = 0 THEN 'process_error' WHEN canonical_url % 6 = 0 THEN 'fetch_failure' WHEN canonical_url % 2 = 0 THEN 'cache_hit' ELSE 'fetch_success' END AS outcome,
        CASE WHEN canonical_url % 5 = 1 THEN first_seen END AS lastmod FROM urls),
    d AS (SELECT *, outcome IN ('cache_hit', 'fetch_success') AS came, outcome IN ('fetch_failure', 'process_error') AS lost,
        CASE WHEN outcome = 'process_error' THEN 'TimeoutError' WHEN outcome = 'fetch_failure' THEN CASE WHEN canonical_url % 12 = 0 THEN 'http_404' ELSE 'PageFetchFailed' END END AS why FROM c)"""
_HOSTED = "regexp_extract(url, '://([^/?#]*)', 1)"
_ALLOWED = "(url <> '' AND (starts_with(url, 'https://') OR starts_with(url, 'http://blog.')) AND NOT (starts_with(url, 'https://www.cheap-pills') OR starts_with(url, 'https://news')))"
_PAGES = "p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)"


SQL = {
    "process_state": f"""{_CYCLE} SELECT canonical_url, CASE WHEN came THEN 'success' WHEN lost THEN 'failed' ELSE last_status END AS last_status, CASE WHEN came THEN {_AT} ELSE last_at END AS last_fetched_at,
        CASE WHEN came THEN {_DUE.format(at=_AT, seen='lastmod')} WHEN lost THEN {_RETRY.format(at=_AT, n='(retry_count + 1)')} ELSE next_due_at END AS next_due_at,
        CASE WHEN came THEN 0 WHEN lost THEN retry_count + 1 ELSE retry_count END::INTEGER AS retry_count, why AS last_failure_reason FROM d WHERE outcome <> 'skip_filtered'""",
    "process_events": f"""{_CYCLE} SELECT canonical_url, 'process_start' AS event_type, 'ok' AS status, NULL AS reason FROM d WHERE outcome <> 'skip_filtered'
        UNION ALL SELECT canonical_url, outcome, CASE WHEN lost THEN 'failed' ELSE 'ok' END, CASE outcome WHEN 'skip_filtered' THEN 'filtered_by_rules' WHEN 'skip_recent' THEN 'recently_fetched' ELSE why END FROM d""",
    "mark_failed": f"""WITH {_URLS} SELECT canonical_url, CASE WHEN canonical_url % 3 = 0 THEN 'failed' ELSE last_status END AS last_status,
        CASE WHEN canonical_url % 3 = 0 THEN {_RETRY.format(at=_AT, n='(retry_count + 1)')} ELSE next_due_at END AS next_due_at,
        (CASE WHEN canonical_url % 3 = 0 THEN retry_count + 1 ELSE retry_count END)::INTEGER AS retry_count, CASE WHEN canonical_url % 3 = 0 THEN 'gone' END AS last_failure_reason FROM urls""",
    "events_applied": f"WITH {_E} SELECT canonical_url, CASE WHEN canonical_url % 2 = 0 THEN 'success' ELSE 'pending' END AS last_status, max(event_at) AS last_event_at, count(*) FILTER (event_type = 'cache_hit') + CASE WHEN canonical_url % 2 = 0 THEN 1 ELSE 0 END AS cache_hit_count FROM e GROUP BY canonical_url",
    "entry_redirects": f"""WITH {_PAGES}, r AS (SELECT url, min(CASE WHEN page_id % 3 = 0 AND page_id % 9 <> 0 THEN 'https://moved.example.org/' || (page_id % 50) END) AS final_url FROM p GROUP BY url),
        f AS (SELECT coalesce(final_url, url) AS url FROM r) SELECT DISTINCT url FROM f WHERE {_ALLOWED}""",
    "kv_upsert": "SELECT event_type AS kind, user_id::VARCHAR AS key, arg_max(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS value, max(ts) AS at FROM events GROUP BY ALL",
    "sources_unchanged": "SELECT DISTINCT source, CASE source WHEN 'src1' THEN 'changed' WHEN 'src2' THEN 'new' ELSE 'unchanged' END AS status FROM documents",
    "bounded_content": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, length(t) > 500 AS truncated, length(t)::INTEGER AS original_chars, least(length(t), 500)::INTEGER AS returned_chars, strlen(t)::INTEGER AS original_bytes, strlen(t[:500])::INTEGER AS returned_bytes, sha256(t[:500]) AS sha256 FROM d",
    "excerpt_lines": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '' AND NOT starts_with(x, '#'))[:5] AS ls FROM d),
        j AS (SELECT doc_id, CASE WHEN len(ls) > 0 THEN array_to_string(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ') ELSE t END AS x FROM k)
        SELECT doc_id, CASE WHEN length(x) > 200 THEN x[:200] || '...' ELSE x END AS excerpt FROM j""",
    "log_redaction": "WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN lower(lang) IN ('de', 'fr') THEN '[REDACTED]' WHEN length(t) > 100 THEN t[:100] || '...' ELSE t END AS shown FROM d",
    "url_include": f"WITH {_PAGES} SELECT page_id, regexp_matches(url, '(?i)/en/') OR regexp_matches(url, '(?i)blog') AS included, nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM p",
    "block_detection": f"""WITH {_PAGES}, x AS (SELECT page_id, 400 + page_id % 7 AS s, CASE WHEN page_id % 5 = 0 THEN '<TITLE>Sorry</title> Google' WHEN page_id % 5 = 1 THEN 'g-recaptcha automated queries' ELSE '' END || html AS h FROM p),
        m AS (SELECT page_id, s, h, lower(h[:8192]) AS t FROM x),
        b AS (SELECT page_id, s, h, contains(t, 'google.com/sorry') OR contains(t, 'our systems have detected unusual traffic') OR contains(t, 'unusual traffic from your computer network') OR contains(t, 'to continue, please type the characters below')
                OR (contains(t, '<title>sorry') AND contains(t, 'google')) OR (contains(t, 'attention required! | cloudflare') AND contains(t, 'ray id'))
                OR (contains(t, 'recaptcha') AND (contains(t, 'unusual traffic') OR contains(t, 'automated queries'))) AS hit FROM m)
        SELECT page_id, hit OR s IN (403, 407, 408, 425, 429, 500, 502, 503, 504) AS blocked, page_id % 2 = 0 AND strlen(h) > 100 AND NOT hit AS usable FROM b""",
    "sitemap_lastmod": f"WITH {_E} SELECT canonical_url, canonical_url::VARCHAR AS url, CASE WHEN canonical_url % 2 = 1 THEN arg_max(event_at, event_id) END AS lastmod FROM e GROUP BY canonical_url",
    "cleanup_summary": "SELECT count(*) FILTER (source IN ('src1', 'src3')) AS deleted_files, coalesce(sum(n_chars) FILTER (source IN ('src1', 'src3')), 0)::BIGINT AS deleted_bytes, count(*) FILTER (NOT source IN ('src1', 'src3')) AS kept_files, coalesce(sum(n_chars) FILTER (NOT source IN ('src1', 'src3')), 0)::BIGINT AS kept_bytes FROM documents",
    "schedule_gap": """WITH d AS (SELECT DISTINCT o_custkey AS tenant, o_orderdate AS run FROM orders), n AS (SELECT tenant, run, row_number() OVER (PARTITION BY tenant ORDER BY run) AS r FROM d WHERE run > TIMESTAMP '1997-01-01'),
        g AS (SELECT a.tenant, date_diff('second', a.run, b.run) / 3600.0 AS h FROM n a JOIN n b ON a.tenant = b.tenant AND a.r = 1 AND b.r = 2)
        SELECT t.tenant, round(coalesce(greatest(h, 1.0), 24.0), 6)::DOUBLE AS hours FROM (SELECT DISTINCT tenant FROM d) t LEFT JOIN g USING (tenant)""",
    "tenant_listing": "WITH n AS (SELECT lower(n_name) AS codename, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS last_event FROM nation) SELECT (row_number() OVER (ORDER BY last_event IS NOT NULL, last_event DESC, codename) - 1)::INTEGER AS place, codename FROM n",
    "search_metrics": """WITH e AS (SELECT event_type, abs(value) AS v, event_id % 5 AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
        t AS (SELECT event_type, count(*) AS searches, avg((v > 10)::INTEGER) AS slow_rate, avg((n = 0)::INTEGER) AS empty_rate FROM e GROUP BY 1),
        h AS (SELECT event_type, list_sort(list(v)) AS l, avg(v) AS mean FROM e WHERE r <= 1000 GROUP BY 1)
        SELECT event_type, len(l)::INTEGER AS held, round(mean, 6) AS mean, l[floor(len(l) * 0.95)::INTEGER + 1] AS p95, l[floor(len(l) * 0.99)::INTEGER + 1] AS p99, l[-1] AS most, searches, round(slow_rate, 6) AS slow_rate, round(empty_rate, 6) AS empty_rate FROM h JOIN t USING (event_type)""",
    "bloom_filter": """WITH s AS (SELECT p_partkey, unnest(range(6)) AS i, md5(p_name || unnest(range(6))::VARCHAR) AS h FROM part),
        c AS (SELECT p_partkey, i, list_transform([1, 9, 17, 25], lambda k: ('0x' || h[k:k + 7])::BIGINT) AS w FROM s)
        SELECT p_partkey, string_agg((((((w[1] % 9585) * 4294967296 + w[2]) % 9585 * 4294967296 + w[3]) % 9585 * 4294967296 + w[4]) % 9585)::VARCHAR, ' ' ORDER BY i) AS bits FROM c GROUP BY p_partkey""",
    "search_stored": f"WITH r AS ({sq.SQL['search_full']}) SELECT query_id, rank, doc_id, score, split_part(coalesce(text, ''), chr(10), 1)[:512] AS title, least(length(coalesce(text, '')), 4096)::INTEGER AS body_chars FROM r JOIN documents USING (doc_id)",
    "streaming_state_machine": f"""WITH RECURSIVE {_E}, m AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY event_at, event_id) AS r FROM e WHERE status = 'failed' OR event_type IN ('fetch_success', 'cache_hit')),
        f AS (SELECT canonical_url, r, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS n, CASE WHEN status = 'failed' THEN event_at + INTERVAL 1 HOUR ELSE event_at + INTERVAL 7 DAY END AS due FROM m WHERE r = 1
              UNION ALL SELECT m.canonical_url, m.r, CASE WHEN status = 'failed' THEN f.n + 1 ELSE 0 END, CASE WHEN status = 'failed' THEN event_at + to_hours(CAST(least(power(2.0, least(f.n + 1, 40) - 1), 720.0) AS INTEGER)) ELSE event_at + INTERVAL 7 DAY END FROM f JOIN m ON m.canonical_url = f.canonical_url AND m.r = f.r + 1)
        SELECT canonical_url, arg_max(n, r)::INTEGER AS retry_count, arg_max(due, r) AS next_due_at FROM f GROUP BY canonical_url""",
}

_ASKED = "CASE page_id % 3 WHEN 0 THEN url || '#top' WHEN 1 THEN rtrim(url, '/') ELSE rtrim(url, '/') || '/' END"
SQL["fetch_documents"] = f"""WITH {_PAGES}, a AS (SELECT DISTINCT {_ASKED} AS url FROM p),
    c AS (SELECT url AS asked, rtrim(regexp_replace(url, '#.*$', ''), '/') AS bare, {iq._CANON} AS canon FROM a),
    l AS (SELECT asked, unnest([asked, bare, bare || '/', canon, bare || '.html', bare || '/index.html', bare || '.md']) AS u, unnest(range(7)) AS how FROM c),
    f AS (SELECT asked, page_id, html, row_number() OVER (PARTITION BY asked ORDER BY how, page_id) AS r FROM l JOIN p ON p.url = l.u)
    SELECT asked, page_id, sha256(html) AS body_sha FROM f WHERE r = 1"""
SQL["blacklist_sweep"] = f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), {iq._stored(False)}
    SELECT 'documents' AS kind, count(*) FILTER (NOT {_ALLOWED}) AS removed FROM u
    UNION ALL SELECT 'folders', count(*) FILTER (starts_with(path, 'www.example.org/en/') OR starts_with(path, 'news.example.com/')) FROM named
    UNION ALL SELECT 'urls', count(DISTINCT user_id) FILTER (user_id % 4 = 0) FROM events"""

NAMES = tuple(SQL)
FUNCTIONS = {n: globals()[n] for n in NAMES}
