"""Tenant discovery: matching queries to the tenants' descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text


def tenants_of(rows: DataFrame) -> DataFrame:
    """Tenant rows with all their columns: what is missing is empty."""
    have = set(rows.columns)
    blank = {"display_name": F.lit(""), "description": F.lit(""), "source_type": F.lit("")}
    lists = {"url_prefixes": F.array().cast("array<string>"), "test_queries": F.array().cast("array<string>")}
    return rows.select("*", *(c.alias(n) for n, c in (blank | lists).items() if n not in have))


def _fields() -> Column:
    # What each field of a tenant weighs.
    single = [F.struct(F.lower(n).alias("text"), F.lit(w).alias("weight")) for n, w in (("codename", 3.0), ("display_name", 2.5), ("description", 1.5), ("source_type", 0.5))]
    many = [F.transform(n, lambda x: F.struct(F.lower(x).alias("text"), F.lit(1.0).alias("weight"))) for n in ("url_prefixes", "test_queries")]
    return F.concat(F.array(*single), *many)


def _term_score(term: Column, field: Column) -> Column:
    words = F.filter(F.split(F.translate(field, "-_", "  "), r"\s+"), lambda w: F.length(w) >= 3)
    near = F.transform(words, lambda w: F.when((F.length(term) >= 3) & (F.levenshtein(term, w, 2) >= 0), 0.7 - F.levenshtein(term, w, 2) * 0.2).otherwise(0.0))
    return F.when(F.contains(field, term), 0.8).otherwise(F.coalesce(F.array_max(near), F.lit(0.0)))


def match_score(query: Column) -> Column:
    """How well a tenant row fits a query, at most 1."""
    low = F.lower(query)
    terms = F.filter(F.split(low, r"\s+"), lambda t: t != "")

    def field(f):
        total = F.aggregate(F.transform(terms, lambda t: _term_score(t, f.text)), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.contains(f.text, low), f.weight).otherwise(F.coalesce(total / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0)) * f.weight)

    return F.least(F.coalesce(F.array_max(F.transform(_fields(), field)), F.lit(0.0)), F.lit(1.0))


def find(tenants: DataFrame, queries: DataFrame, least: float = 0.1, k: int = 10) -> DataFrame:
    """(query_id, rank, codename, score): tenants above ``least``.

    Tenants are configuration, a table of bounded size: the stated queries meet all of
    them, and what remains is ranked per query.
    """
    scored = tenants.crossJoin(queries).withColumn("score", match_score(F.col("query"))).filter(F.col("score") > least)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "codename")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def command_line_score(query: Column, codename: Column, display: Column, description: Column) -> Column:
    """The second implementation's score: exact name, name tokens, display tokens, description, then typos."""
    low, name = F.lower(query), F.lower(codename)
    asked = F.filter(F.split(low, r"\s+"), lambda t: t != "")

    def parts(c):
        return F.filter(F.split(F.lower(c), r"[-_ /.]+"), lambda t: t != "")

    def held(tokens):
        return F.size(F.filter(tokens, lambda t: F.array_contains(asked, t)))

    own, shown = parts(codename), parts(display)
    ratio = held(own) / F.nullif(F.size(own), F.lit(0))
    whole = F.rlike(F.concat(F.lit(" "), low, F.lit(" ")), F.concat(F.lit(r"[ -]\Q"), name, F.lit(r"\E[ -]")))
    by_name = F.when(ratio >= 1, 1.0 + held(own) * 0.01).when(whole, 1.0).otherwise(F.coalesce(ratio, F.lit(0.0)) * 0.9)
    by_display = F.coalesce(held(shown) / F.nullif(F.size(shown), F.lit(0)), F.lit(0.0)) * 0.85
    about = F.lower(F.coalesce(description, F.lit("")))
    by_text = F.coalesce(F.size(F.filter(asked, lambda t: F.contains(about, t))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)) * 0.5
    best = F.greatest(by_name, by_display, by_text)
    typos = F.flatten(F.transform(F.filter(asked, lambda t: F.length(t) >= 3), lambda t: F.transform(F.filter(own, lambda o: F.length(o) >= 3), lambda o: F.levenshtein(t, o, 2))))
    close = F.array_min(F.filter(typos, lambda d: d > 0))
    return F.when(low == name, 1.0).when(best < 0.3, F.greatest(best, F.coalesce(0.3 - close * 0.1, F.lit(0.0)))).otherwise(best)


def frequent_words(titles: DataFrame, group: str, column: str, k: int = 6) -> DataFrame:
    """(group, word, uses, rank): the words that a group's titles use most."""
    words = titles.select(group, F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    words = words.filter((F.length("word") >= 4) & ~F.col("word").isin(*text.KEYWORD_STOPS))
    counts = words.groupBy(group, "word").agg(F.count("*").alias("uses"))
    order = Window.partitionBy(group).orderBy(F.desc("uses"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def labels(tenants: DataFrame) -> DataFrame:
    """Tenants with ``hosts``, ``sections`` and a ``summary`` from their url prefixes."""
    prefixes = F.col("url_prefixes")
    hosts = F.array_distinct(F.filter(F.transform(prefixes, lambda u: F.try_parse_url(u, F.lit("HOST"))), lambda h: h.isNotNull()))

    def section(u):
        parts = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda p: p.rlike("[A-Za-z]") & ~p.isin("latest", "stable", "en"))
        return F.get(parts, F.size(parts) - 1)

    sections = F.array_distinct(F.filter(F.transform(prefixes, section), lambda s: s.isNotNull()))
    summary = F.concat_ws("; ", F.concat(F.col("display_name"), F.lit(" documentation")), F.array_join(hosts, ", "), F.array_join(sections, ", "))
    return tenants.select("*", hosts.alias("hosts"), sections.alias("sections"), summary.alias("summary"))


def overlay(found: DataFrame, configured: DataFrame) -> DataFrame:
    """Tenants on disk with what their configuration says; where there is one, others drop out.

    Both have a ``codename``; columns of the configuration win where they aren't null.
    """
    both = sorted(set(found.columns) & set(configured.columns) - {"codename"})
    only = [c for c in found.columns if c not in (*both, "codename")]
    more = [c for c in configured.columns if c not in (*both, "codename")]
    joined = found.alias("f").join(configured.alias("c"), "codename", "full")
    some = configured.agg(F.count("*").alias("__some"))
    rows = joined.select("codename", *(F.coalesce(f"c.{c}", f"f.{c}").alias(c) for c in both), *(F.col(f"f.{c}") for c in only), *(F.col(f"c.{c}") for c in more))
    named = configured.select("codename", F.lit(True).alias("__named"))
    return rows.crossJoin(some).join(named, "codename", "left").filter("__some = 0 OR __named").drop("__some", "__named")  # one row


def listing(tenants: DataFrame) -> DataFrame:
    """(codename, description) of all tenants by codename; the description begins with the display name."""
    return tenants.select("codename", F.concat_ws(" - ", "display_name", "description").alias("description")).orderBy("codename")


def describe(tenants: DataFrame, asked: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All that is known of each asked codename, once each: ``found`` is false for one that isn't a tenant.

    ``documents``: (codename, documents) where counts are at hand; none counts as zero.
    """
    rows = asked.select("codename").distinct().join(tenants.withColumn("__there", F.lit(True)), "codename", "left")
    rows = rows.withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")
    if documents is None:
        return rows
    return rows.join(documents.select("codename", "documents"), "codename", "left").fillna(0, ["documents"])
