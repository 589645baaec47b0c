"""Ranked search over an index: one plan scores any number of queries together.

Queries are a table (query_id, text).  They are analyzed by the same expressions as
the documents; terms join the postings, scores are summed per query and document, and
a rank per query cuts to the top.  Query terms are broadcast only where adaptive
execution sees that they are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import analysis, ranking, snippets, synonyms
from quillspark.operators.index import Field, Index


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score") -> DataFrame:
    """The k best documents of each query, with their rank.  Scores that agree to six decimals tie, by doc_id."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 6)), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def terms_of(queries: DataFrame, schema: Sequence[Field], expand: bool = True) -> DataFrame:
    """(term): all that a batch of queries asks an index of this schema for."""
    return query_terms(queries, Index(tuple(schema), None, None, None, None), expand).select("term")


def query_terms(queries: DataFrame, index: Index, expand: bool = True, table: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(query_id, field, term, term_idx, is_base).

    Terms are distinct per field, in order; synonyms follow, sorted.  Which terms are
    base terms is told by the number of base terms of the body, in every field.
    """
    names = [f.name for f in index.text_fields]
    rows = queries.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''")
    rows = rows.select("query_id", *(analysis.analyze(f.analyzer).words(F.col("text")).alias(f.name) for f in index.text_fields))
    rows = rows.select("query_id", *(_finished(f).alias(f.name) for f in index.text_fields))
    count = F.size("body") if "body" in names else F.lit(0)
    pairs = [F.struct(F.lit(n).alias("field"), (synonyms.expand_terms(F.col(n), table) if expand else F.col(n)).alias("terms")) for n in names]
    each = rows.select("query_id", count.alias("base_count"), F.explode(F.array(*pairs)).alias("f"))
    return each.select("query_id", "f.field", F.posexplode("f.terms").alias("term_idx", "term"), "base_count").select("query_id", "field", "term", "term_idx", (F.col("term_idx") < F.col("base_count")).alias("is_base"))


def _finished(field) -> Column:
    """A column of a field's query words as distinct terms."""
    step = analysis.analyze(field.analyzer).finish_sql
    done = f"transform(`{field.name}`, w -> {step('w')})" if step else f"`{field.name}`"
    return F.expr(f"filter(array_distinct({done}), t -> t <> '')")


def _pieces(text: Column, n: Column, edits: int, shift: int = 0) -> list[Column]:
    """``edits + 1`` pieces of a text, each with its number, cut by the length ``n``."""
    step = F.floor(n / (edits + 1)).cast("int")
    last = n - edits * step
    found = [(0, F.left(text, step))] if not shift else []
    if edits == 2:
        found.append((1, F.substring(text, step + 1 + shift, step)))
    if not shift:
        found.append((edits, F.right(text, last)))
    return [F.struct(F.lit(edits).alias("edits"), n.cast("int").alias("n"), F.lit(i).alias("part"), p.alias("piece")) for i, p in found]


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, field, term, matched, df, distance): for base terms without a posting in their
    field, the nearest term of its vocabulary.

    Candidates meet on a piece of the word: cut in one piece more than the edits allowed,
    a word has a piece that no edit touched.  It is the other's head, its tail, or (of
    three) the middle one, moved by one place at most as both other pieces have one edit.
    The edit distance runs on those pairs alone.
    """
    missing = terms.filter("is_base").join(vocabulary.select("field", "term"), ["field", "term"], "left_anti")
    edits = ranking.allowed_edits(F.col("term"))
    near = missing.select("query_id", "field", "term", edits.alias("most")).filter("most > 0")
    near = near.select("*", F.explode(F.sequence(F.length("term") - F.col("most"), F.length("term") + F.col("most"))).alias("m"))
    term, m = F.col("term"), F.col("m")
    two = [p for shift in (0, -1, 1) for p in _pieces(term, m, 2, shift)]
    near = near.select("query_id", "field", "term", F.explode(F.when(F.col("most") == 1, F.array(*_pieces(term, m, 1))).otherwise(F.array(*two))).alias("key"))
    word, size = F.col("term"), F.length("term")
    pieces = F.explode(F.array(*_pieces(word, size, 1), *_pieces(word, size, 2))).alias("key")
    words = vocabulary.select("field", F.col("term").alias("matched"), "df", pieces)
    pairs = near.select("query_id", "field", "term", "key.*").join(words.select("field", "matched", "df", "key.*"), ["field", "edits", "n", "part", "piece"])
    distance = F.when(F.col("edits") == 1, F.levenshtein("term", "matched", 1)).otherwise(F.levenshtein("term", "matched", 2))
    close = pairs.withColumn("distance", distance).filter("distance >= 0")
    best = close.groupBy("query_id", "field", "term").agg(F.min(F.struct("distance", F.lower("matched").alias("low"), "matched", "df")).alias("best"))
    return best.select("query_id", "field", "term", "best.matched", "best.df", "best.distance")


def resolve(index: Index, terms: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(query_id, field, term, matched, df, discount): what each query term stands for in the vocabulary."""
    known = index.vocabulary.join(terms, ["field", "term"]).select("query_id", "field", "term", F.col("term").alias("matched"), "df", F.lit(1.0).alias("discount"))
    if fuzzy:
        close = fuzzy_terms(terms, index.vocabulary)
        known = known.unionAll(close.select("query_id", "field", "term", "matched", "df", F.lit(ranking.FUZZY_DISCOUNT).alias("discount")))
    return known


def contributions(index: Index, known: DataFrame, *, boosts: Mapping[str, float] | None = None, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
    """(query_id, doc_id, field, term, contribution): what each resolved term adds to a document's score."""
    weights = {f.name: f.boost for f in index.text_fields} if boosts is None else boosts
    weight = F.coalesce(*(F.when(F.col("field") == n, F.lit(float(w))) for n, w in weights.items()), F.lit(1.0))
    hits = index.postings.select("field", F.col("term").alias("matched"), "doc_id", "tf", "doc_length").join(known, ["field", "matched"])
    hits = hits.join(F.broadcast(index.field_stats), "field")  # one row a field of the schema
    length = F.coalesce(F.when(F.col("doc_length") > 0, F.col("doc_length")), F.col("tf"))
    total = F.greatest(F.col("documents"), F.lit(1))
    value = ranking.idf(F.col("df"), total) * ranking.bm25(F.col("tf"), length, F.col("average"), k1, b) * weight * F.col("discount")
    return hits.select("query_id", "doc_id", "field", "term", value.alias("contribution"))


def score(index: Index, terms: DataFrame, *, fuzzy: bool = False, **options) -> DataFrame:
    """(query_id, doc_id, score)."""
    return contributions(index, resolve(index, terms, fuzzy), **options).groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("score"))


def min_spans(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, span, terms): the shortest stretch that holds every term of a group.

    ``positions``: (*keys, term, position).  At each position the stretch from the least
    of the terms' last places to here is a candidate.
    """
    # One fold over a group's sorted places keeps the last place of every term: linear in the places.
    numbered = positions.withColumn("t", F.dense_rank().over(Window.partitionBy(*keys).orderBy("term")) - 1)
    groups = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("places"), (F.max("t") + 1).alias("terms"))

    def step(state, place):
        last = F.transform(state.last, lambda old, i: F.when(i == place.t, place.position).otherwise(old))
        span = F.when(F.exists(last, lambda p: p.isNull()), None).otherwise(place.position - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state.best, span).alias("best"))

    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(none, F.col("terms")).alias("last"), none.alias("best"))
    return groups.select(*keys, F.aggregate("places", start, step, lambda s: s.best).alias("span"), "terms")


def phrase_rerank(index: Index, queries: DataFrame, scored: DataFrame, limit: int) -> DataFrame:
    """Scores with the bonus for documents whose query terms stand together.

    Only the best ``min(max(5 * limit, 50), 500)`` documents of a query are looked at,
    so a query's positions are bounded; a query that repeats a term gets no bonus.
    """
    body = next((f for f in index.text_fields if f.name == "body"), None)
    if body is None:
        return scored
    cut = min(max(5 * limit, 50), 500)
    best = top(scored, cut).select("query_id", "doc_id")
    analyzer = analysis.analyze(body.analyzer)
    asked = queries.select("query_id", analyzer.words(F.trim(F.coalesce("text", F.lit("")))).alias("w"))
    if analyzer.finish_sql:
        asked = asked.select("query_id", F.expr(f"transform(w, x -> {analyzer.finish_sql('x')})").alias("w"))
    asked = asked.filter((F.size("w") >= 2) & (F.size(F.array_distinct("w")) == F.size("w")))
    asked = asked.select("query_id", F.size("w").alias("asked"), F.explode("w").alias("term"))
    body_postings = index.postings.filter("field = 'body'").select("term", "doc_id", "positions")
    held = body_postings.join(asked, "term").join(best, ["query_id", "doc_id"], "left_semi")
    whole = held.withColumn("held", F.count("*").over(Window.partitionBy("query_id", "doc_id"))).filter("held = asked")
    spans = min_spans(whole.select("query_id", "doc_id", "term", F.explode("positions").alias("position")), ["query_id", "doc_id"])
    joined = scored.join(spans, ["query_id", "doc_id"], "left")
    return joined.select("query_id", "doc_id", (F.col("score") * ranking.phrase_factor(F.col("span"), F.col("terms"))).alias("score"))


def search(index: Index, queries: DataFrame, k: int = 20, *, expand: bool = True, fuzzy: bool = True, phrase: bool = True, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the primary engine.  k of zero or less gives nothing."""
    scored = score(index, query_terms(queries, index, expand), boosts=boosts, fuzzy=fuzzy)
    if phrase:
        scored = phrase_rerank(index, queries, scored, k)
    return top(scored, max(k, 0)).select("query_id", "rank", "doc_id", "score")


def ask(index: Index, queries: Mapping[int, str], k: int = 20, *, expand: bool = True, fuzzy: bool = True, phrase: bool = True, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """:func:`search` for a few queries at hand.

    The queries' terms, bounded by their text, are resolved on the driver, so the steps
    that nothing needs (typos, phrases) aren't planned, and a stored segment is read
    by the terms alone.
    """
    spark = index.postings.sparkSession
    table = local_rows(spark, list(queries.items()), "query_id int, text string")
    # Analysis of a local table is folded by the optimizer: no job runs.
    words = table.select("query_id", *(analysis.analyze(f.analyzer).words(F.trim(F.coalesce("text", F.lit("")))).alias(f.name) for f in index.text_fields))
    terms = []
    for row in words.select("query_id", *(_finished(f).alias(f.name) for f in index.text_fields)).collect():
        base = {f.name: row[f.name] for f in index.text_fields}
        count = len(base.get("body", ()))
        for name, own in base.items():
            every = synonyms.expand_list(own) if expand else own
            terms += [(row.query_id, name, t, i, i < count) for i, t in enumerate(every)]
    schema = "query_id int, field string, term string, term_idx int, is_base boolean"
    vocabulary = {(r.field, r.term): r.df for r in index.vocabulary.filter(F.col("term").isin(sorted({t[2] for t in terms}))).collect()} if terms else {}
    known = [(q, field, t, t, vocabulary[field, t], 1.0) for q, field, t, _, _ in terms if (field, t) in vocabulary]
    if fuzzy and (lost := [t for t in terms if t[4] and (t[1], t[2]) not in vocabulary]):
        known += _typos(index.vocabulary, lost)
    used = sorted({k[3] for k in known})
    postings = index.postings.filter(F.col("term").isin(used))
    rows = local_rows(spark, known, "query_id int, field string, term string, matched string, df bigint, discount double")
    scored = contributions(replace(index, postings=postings), F.broadcast(rows), boosts=boosts).groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("score"))
    cut = min(max(5 * k, 50), 500)
    best = top(scored, max(k, cut if phrase else 0, 0)).select("query_id", "doc_id", "score").collect()
    factor = _phrase_factors(index, table, terms, best) if phrase else {}
    ranked = []
    for q in {r.query_id for r in best}:
        own = sorted(((-round(r.score * factor.get((q, r.doc_id), 1.0), 6), r.doc_id, r.score * factor.get((q, r.doc_id), 1.0)) for r in best if r.query_id == q), key=lambda x: x[:2])
        ranked += [(q, i, doc_id, score) for i, (_, doc_id, score) in enumerate(own[: max(k, 0)], 1)]
    return local_rows(spark, ranked, f"query_id int, rank int, doc_id {index.postings.schema['doc_id'].dataType.simpleString()}, score double")


def _typos(vocabulary: DataFrame, lost: Sequence[tuple]) -> list[tuple]:
    """The nearest term of the vocabulary for each of a few terms: one scan, filtered by distance."""
    edits = {t[2]: 0 if len(t[2]) <= 2 else 1 if len(t[2]) <= 5 else 2 for t in lost}

    def close(t):
        e = edits[t[2]]
        return (F.col("field") == t[1]) & F.length("term").between(len(t[2]) - e, len(t[2]) + e) & (F.levenshtein("term", F.lit(t[2]), e) >= 0)

    asked = [t for t in lost if edits[t[2]]]
    if not asked:
        return []
    one_of_each = {(t[1], t[2]): t for t in asked}
    hits = [F.when(close(t), F.struct(F.lit(i).alias("i"), F.levenshtein("term", F.lit(t[2])).alias("d"))) for i, t in enumerate(one_of_each.values())]
    rows = vocabulary.select("term", "df", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("term", "df", "hit.*")
    best: dict[int, tuple] = {}
    for r in rows.groupBy("i").agg(F.min(F.struct("d", F.lower("term").alias("low"), "term", "df")).alias("b")).collect():
        best[r.i] = r.b
    number = {key: i for i, key in enumerate(one_of_each)}
    return [(t[0], t[1], t[2], best[i].term, best[i].df, ranking.FUZZY_DISCOUNT) for t in asked if (i := number[t[1], t[2]]) in best]


def _phrase_factors(index: Index, queries: DataFrame, terms: Sequence[tuple], best: Sequence) -> dict:
    """(query_id, doc_id) -> the phrase factor of a few queries' best documents, at most 500 a query."""
    body = next((f for f in index.text_fields if f.name == "body"), None)
    if body is None or not best:
        return {}
    step = analysis.analyze(body.analyzer).finish_sql
    words = queries.select("query_id", analysis.analyze(body.analyzer).words(F.trim(F.coalesce("text", F.lit("")))).alias("w"))
    asked = {r.query_id: r.w for r in words.select("query_id", F.expr(f"transform(w, x -> {step('x')})" if step else "w").alias("w")).collect()}
    asked = {q: w for q, w in asked.items() if len(w) >= 2 and len(set(w)) == len(w)}
    docs = {r.doc_id for r in best if r.query_id in asked}
    if not docs:
        return {}
    every = sorted({t for w in asked.values() for t in w})
    held = index.postings.filter((F.col("field") == "body") & F.col("term").isin(every) & F.col("doc_id").isin(sorted(docs)))
    places: dict = {}
    for r in held.select("term", "doc_id", "positions").collect():
        places.setdefault(r.doc_id, {})[r.term] = r.positions
    spans = []
    for n, r in enumerate(best):
        own = places.get(r.doc_id, {})
        if all(t in own for t in asked.get(r.query_id, [None])):
            spans.append((n, shortest_span([own[t] for t in asked[r.query_id]]), len(asked[r.query_id])))
    factor = local_rows(queries.sparkSession, spans, "n int, span int, terms int").select("n", ranking.phrase_factor(F.col("span"), F.col("terms")).alias("f"))
    return {(best[r.n].query_id, best[r.n].doc_id): r.f for r in factor.collect()}


def shortest_span(places: Sequence[Sequence[int]]) -> int:
    """Of the stretches that hold a place of every term the shortest one's length."""
    last: dict[int, int] = {}
    best = None
    for place, term in sorted((p, t) for t, own in enumerate(places) for p in own):
        last[term] = place
        if len(last) == len(places):
            span = place - min(last.values()) + 1
            best = span if best is None else min(best, span)
    return best


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows at hand as a local table."""
    names = [c.split()[0] for c in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})").select(*columns)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def with_documents(ranked: DataFrame, documents: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked rows with their stored fields; documents that aren't stored drop out."""
    return ranked.join(documents, "doc_id")


def search_documents(index: Index, queries: DataFrame, k: int = 20, fields: Sequence[str] = ("url", "title"), **options) -> DataFrame:
    """(query_id, rank, doc_id, score, fields that are stored, snippet): :func:`search` with its documents."""
    return ranked_documents(search(index, queries, k, **options), index, queries, fields)


def ranked_documents(ranked: DataFrame, index: Index, queries: DataFrame, fields: Sequence[str] = ("url", "title")) -> DataFrame:
    """Ranked rows with their documents' stored fields and a snippet."""
    terms = query_terms(queries, index, expand=False).filter("field = 'body'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term_idx", "term"))).alias("__t"))
    rows = with_documents(ranked, index.documents).join(terms, "query_id", "left")
    have = [f for f in fields if f in index.documents.columns]
    words = F.coalesce(F.transform("__t", lambda x: x.term), F.array().cast("array<string>"))
    return rows.withColumn("__terms", words).select("query_id", "rank", "doc_id", "score", *have, snippets.smart_snippet(200, 100)("body", "__terms").alias("snippet"))


def legacy_search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score): the body-only engine without expansion.

    Its inverse frequency may be negative.  A single-term query counts repeats of the
    term; longer ones count each term once.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    words = analysis.analyze(None)(text)
    asked = queries.select("query_id", F.explode(F.when(F.size(words) > 1, F.array_distinct(words)).otherwise(words)).alias("term"))
    stats = index.field_stats.filter("field = 'body'").select("documents", "average")
    body = index.vocabulary.filter("field = 'body'").select("term", "df")
    hits = index.postings.filter("field = 'body'").select("term", "doc_id", "tf", "doc_length").join(asked.join(body, "term"), "term").crossJoin(F.broadcast(stats))  # one row
    length = F.coalesce(F.when(F.col("doc_length") > 0, F.col("doc_length")), F.col("average"))
    value = ranking.classic_idf(F.col("df"), F.col("documents")) * ranking.classic_bm25(F.col("tf"), length, F.col("average"))
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))
    return top(scored, k).select("query_id", "rank", "doc_id", "score")


def federated_search(postings: DataFrame, vocabulary: DataFrame, stats: DataFrame, terms: DataFrame, boosts: Mapping[str, float], tenants: DataFrame | None = None, per_tenant: int = 5, total: int = 10) -> DataFrame:
    """(query_id, rank, tenant, doc_id, score) over many tenants in one plan.

    All tables carry a ``tenant``; ``terms`` is (query_id, field, term); ``tenants`` gives
    (query_id, tenant, boost).  Each tenant's best documents are normalised by its best
    score and merged.
    """
    per_tenant = min(per_tenant if per_tenant > 0 else 5, 100)
    weight = F.coalesce(*(F.when(F.col("field") == n, F.lit(float(w))) for n, w in boosts.items()), F.lit(1.0))
    hits = postings.join(vocabulary.join(terms, ["field", "term"]), ["tenant", "field", "term"]).join(stats, ["tenant", "field"])
    length = F.coalesce(F.when(F.col("doc_length") > 0, F.col("doc_length")), F.floor("average"))
    value = ranking.idf(F.col("df"), F.col("documents")) * ranking.bm25(F.col("tf"), length, F.col("average"), ranking.K1_FEDERATED) * weight
    scored = hits.groupBy("query_id", "tenant", "doc_id").agg(F.sum(value).alias("raw"))
    order = Window.partitionBy("query_id", "tenant").orderBy(F.desc(F.round("raw", 6)), "doc_id")
    best = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_tenant)
    best = best.withColumn("most", F.max("raw").over(Window.partitionBy("query_id", "tenant"))).filter("most > 0")
    if tenants is not None:
        best = best.join(tenants, ["query_id", "tenant"], "left")
    boost = F.coalesce("boost", F.lit(0.0)) if tenants is not None else F.lit(0.0)
    merged = best.withColumn("score", ranking.federated_score(F.col("raw"), F.col("most"), boost))
    final = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "tenant", "doc_id")
    return merged.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= total).select("query_id", "rank", "tenant", "doc_id", "score")
