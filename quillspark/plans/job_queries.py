"""Queries over index jobs, leases, schedules and tenants' descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import schedule, text
from quillspark.operators import jobs
from quillspark.operators import tenants as tn
from quillspark.plans import state_queries as stq

_read = stq._read
_now = stq._now


def index_selection(spark, sf_dir):
    """Orders as files of a repository by priority: what an index run with all its choices takes or leaves out."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    judged = jobs.chosen(o, allowed=F.col("o_orderstatus") != "P", since=F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"), modified="o_orderdate", path="o_orderkey", group="o_orderpriority", limit=100)
    return judged.select("o_orderkey", F.coalesce("why", F.lit("index")).alias("why"))


def index_counts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return jobs.counts(jobs.chosen(d, allowed=F.col("lang") == "en", path="doc_id"), "source")


def lease_grants(spark, sf_dir):
    """Suppliers ask for their nation's lease: some have none, some ran out, some still run."""
    n = _read(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0")
    until = F.when(F.col("n_nationkey") % 2 == 0, _now() - F.expr("INTERVAL 1 HOUR")).otherwise(_now() + F.expr("INTERVAL 1 HOUR"))
    locks = n.select(F.col("n_nationkey").alias("name"), F.lit(0).cast("bigint").alias("owner"), (_now() - F.expr("INTERVAL 2 HOURS")).alias("acquired_at"), until.alias("expires_at"))
    asks = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("owner"), (F.col("s_suppkey") % 3 == 0).alias("refreshed"))
    return jobs.acquire(locks, asks, _now(), 900)[1]


def schedule_next(spark, sf_dir):
    """When a job that runs on Mondays at two would run after each event."""
    return _read(spark, sf_dir, "events").select("event_id", schedule.next_run("0 2 * * mon", F.col("ts")).alias("next_at"))


def _tenants(spark, sf_dir):
    return tn.tenants_of(_read(spark, sf_dir, "nation").select(F.lower("n_name").alias("codename"), F.col("n_name").alias("display_name"), F.concat(F.lit("documents of region "), F.col("n_regionkey").cast("string")).alias("description")))


def tenant_list(spark, sf_dir):
    return tn.listing(_tenants(spark, sf_dir))


def tenant_describe(spark, sf_dir):
    """What is known of every nation and of every region, which are no tenants, with the number of customers."""
    asked = _tenants(spark, sf_dir).select("codename").unionAll(_read(spark, sf_dir, "region").select(F.lower("r_name")))
    nations = _read(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("codename"))
    counts = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("documents"))
    rows = tn.describe(_tenants(spark, sf_dir), asked, nations.join(counts, "n_nationkey"))
    return rows.select("codename", "found", "display_name", "description", "documents")


def word_wrap(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", text.wrapped(F.coalesce("text", F.lit(""))).alias("lines"))
    return b.select("item_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("wrapped"))


_N = f"TIMESTAMP '{stq._NOW}'"
SQL = {
    "index_selection": """WITH j AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'filtered' WHEN o_orderdate <= TIMESTAMP '1995-06-01' THEN 'unchanged' END AS w FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, w IS NULL ORDER BY o_orderkey) AS n FROM j)
        SELECT o_orderkey, coalesce(w, CASE WHEN n <= 100 THEN 'index' ELSE 'over_limit' END) AS why FROM r""",
    "index_counts": "SELECT source, count(*) FILTER (lang = 'en') AS indexed, count(*) FILTER (lang IS DISTINCT FROM 'en') AS skipped FROM documents GROUP BY source",
    "lease_grants": """WITH a AS (SELECT s_nationkey AS name, s_suppkey AS owner, s_suppkey % 3 = 0 AS fresh, CASE WHEN s_nationkey % 3 = 0 THEN 'none' WHEN s_nationkey % 2 = 0 THEN 'over' ELSE 'runs' END AS lock FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        w AS (SELECT *, CASE lock WHEN 'none' THEN min(owner) OVER (PARTITION BY name) WHEN 'over' THEN min(owner) FILTER (NOT fresh) OVER (PARTITION BY name) END AS winner FROM a)
        SELECT name, owner, CASE WHEN owner = winner THEN 'acquired' WHEN lock = 'over' AND fresh THEN 'stale' ELSE 'contended' END AS status, CASE WHEN lock = 'runs' THEN 0 ELSE winner END AS holder FROM w""",
    "schedule_next": "SELECT event_id, date_trunc('week', ts - INTERVAL 2 HOUR)::TIMESTAMP + INTERVAL 170 HOUR AS next_at FROM events",
    "tenant_list": "SELECT lower(n_name) AS codename, n_name || ' - documents of region ' || n_regionkey AS description FROM nation",
    "tenant_describe": """SELECT lower(n_name) AS codename, true AS found, n_name AS display_name, 'documents of region ' || n_regionkey AS description, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents FROM nation
        UNION ALL SELECT DISTINCT lower(r_name), false, NULL, NULL, 0 FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation)""",
    "word_wrap": r"""WITH b AS (SELECT item_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words FROM benchmark),
        f AS (SELECT item_id, CASE WHEN strlen(t) <= 76 THEN t WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda a, w: CASE WHEN strlen(split_part(a, chr(10), -1)) + 1 + strlen(w) <= 76 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS wrapped, strlen(t) > 76 AS cut FROM b)
        SELECT item_id, CASE WHEN cut THEN len(wrapped) - len(replace(wrapped, chr(10), '')) + 1 ELSE 1 END::INTEGER AS n_lines, wrapped FROM f""",
}

NAMES = tuple(SQL)
FUNCTIONS = {n: globals()[n] for n in NAMES}
