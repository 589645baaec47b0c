"""The positional inverted index as tables.

``build`` plans these from a table of records; nothing is collected:

* postings (field, term, doc_id, tf, doc_length, positions)
* documents: the stored fields, shortened, and each field's length
* field_stats (field, documents, total_terms, average): over all documents
* vocabulary (field, term, df)

A record is one row with an id of its own.  Where a field's analyzer knows what stands between
words, its postings are made where the record is read, in Arrow batches, and only the
vocabulary's partial counts are exchanged.  Other fields' tokens are exploded and grouped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import analysis
from quillspark.operators import batches
from quillspark.operators.parallel import spread

TEXT, KEYWORD, NUMERIC, STORED = "text", "keyword", "numeric", "stored"
#: Characters of a stored field.
STORED_CHARS = {"body": 4096, "excerpt": 640, "title": 512}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = TEXT
    boost: float = 1.0
    analyzer: str | None = None


# The default schema, in the order in which fields are scored.
DEFAULT_SCHEMA = (
    Field("url", KEYWORD),
    Field("url_path", TEXT, 1.5, "path"),
    Field("title", TEXT, 2.5),
    Field("headings_h1", TEXT, 2.5),
    Field("headings_h2", TEXT, 2.0),
    Field("headings", TEXT, 1.5),
    Field("body", TEXT, 1.0),
    Field("path", KEYWORD, 1.5),
    Field("tags", KEYWORD, 1.5),
    Field("excerpt", STORED),
    Field("language", KEYWORD),
    Field("timestamp", NUMERIC),
)


@dataclass(frozen=True)
class Index:
    schema: tuple[Field, ...]
    postings: DataFrame
    documents: DataFrame
    field_stats: DataFrame
    vocabulary: DataFrame

    @property
    def text_fields(self) -> list[Field]:
        return [f for f in self.schema if f.kind == TEXT]


def profile(schema: Sequence[Field], analyzer: str | None) -> tuple[Field, ...]:
    """A schema whose text fields all use another analyzer, the path's too."""
    if analyzer in (None, "default"):
        return tuple(schema)
    analysis.analyze(analyzer)
    return tuple(Field(f.name, f.kind, f.boost, analyzer) if f.kind == TEXT else f for f in schema)


def analyzer_of(field: Field) -> analysis.Analyzer:
    return analysis.analyze(field.analyzer if field.kind == TEXT else "keyword")


def field_words(records: DataFrame, schema: Sequence[Field], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, field, words): every indexed field's words before their last step, in one scan."""
    fields = [f for f in schema if f.kind != STORED]
    pairs = [F.struct(F.lit(f.name).alias("field"), analyzer_of(f).words(F.coalesce(F.col(f.name).cast("string"), F.lit(""))).alias("words")) for f in fields]
    used = records.select(F.col(doc_id).alias("doc_id"), *(F.col(f.name) for f in fields if f.name != doc_id))
    return spread(used).select("doc_id", F.explode(F.array(*pairs)).alias("f")).select("doc_id", "f.field", "f.words")


def postings_of(words: DataFrame, schema: Sequence[Field], positions: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """Postings from (doc_id, field, words): words are finished after they are exploded.

    With ``asked(term)`` only those terms' postings, taken before anything is grouped.
    """
    each = words.select("doc_id", "field", F.size("words").alias("doc_length"), F.posexplode("words").alias("position", "word"))
    term = "word"
    steps: dict = {}
    for f in schema:
        if f.kind != STORED and (step := analyzer_of(f).finish_sql):
            steps.setdefault(step, []).append(f"'{f.name}'")
    for step, names in steps.items():
        term = f"CASE WHEN field IN ({', '.join(names)}) THEN {step('word')} ELSE {term} END"
    term = F.expr(term)
    each = each.select("field", term.alias("term"), "doc_id", "doc_length", "position")
    if asked is not None:
        each = each.join(asked.select("term").distinct(), "term", "left_semi")
    found = [F.count("*").cast("int").alias("tf"), F.max("doc_length").alias("doc_length")]
    if positions:
        found.append(F.array_sort(F.collect_list("position")).alias("positions"))
    return each.groupBy("field", "term", "doc_id").agg(*found)


def length_stats(lengths: DataFrame) -> DataFrame:
    """(field, documents, total_terms, average) from (field, length or null): the average is over all documents."""
    rows = lengths.groupBy("field").agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_terms"))
    return rows.withColumn("average", F.when(F.col("documents") > 0, F.col("total_terms") / F.col("documents")).otherwise(0.0))


def clipped_length_stats(lengths: DataFrame) -> DataFrame:
    """The same over documents that have the field, negative lengths as zero."""
    rows = lengths.groupBy("field").agg(F.count("length").alias("documents"), F.coalesce(F.sum(F.greatest("length", F.lit(0))), F.lit(0)).alias("total_terms"))
    return rows.withColumn("average", F.when(F.col("documents") > 0, F.col("total_terms") / F.col("documents")).otherwise(0.0))


def stored_documents(records: DataFrame, schema: Sequence[Field], doc_id: str = "doc_id") -> DataFrame:
    """Stored fields as text; long ones shortened."""

    def stored(name):
        value = F.col(name).cast("string")
        return F.substring(value, 1, STORED_CHARS[name]).alias(name) if name in STORED_CHARS else value.alias(name)

    have = set(records.columns)
    return records.select(F.col(doc_id).alias("doc_id"), *(stored(f.name) for f in schema if f.name in have and f.name != doc_id))


def fields_of(records: DataFrame, schema: Sequence[Field]) -> tuple[Field, ...]:
    """The schema's fields that the records have."""
    have = set(records.columns)
    return tuple(f for f in schema if f.name in have)


def build(records: DataFrame, schema: Sequence[Field] = DEFAULT_SCHEMA, doc_id: str = "doc_id", positions: bool = True, asked: DataFrame | None = None) -> Index:
    """Plan an index of records that have ``doc_id`` and some of the schema's fields.

    ``asked(term)`` narrows postings and vocabulary to the terms of a batch of queries:
    scores are the same, but a word of the corpus that nobody asks for isn't grouped.
    """
    schema = fields_of(records, schema)
    fields = in_batches(schema)
    rest = tuple(f for f in schema if f.kind != STORED and f.name not in fields)
    parts = []
    if fields:
        rows = texts_of(records, fields, doc_id)
        keep = None if asked is None else few_terms(asked)
        found = batches.postings(rows, fields, positions, keep)
        if asked is not None and keep is None:
            found = found.join(asked.select("term").distinct(), "term", "left_semi").select(found.columns)
            terms = found.groupBy("field", "term").agg(F.count("*").alias("df"))
        else:
            terms = batches.counts(rows, fields, None if keep is None else keep.__contains__).filter("term IS NOT NULL").groupBy("field", "term").agg(F.sum("n").alias("df"))
        parts.append((found, stats_of(batches.counts(rows, fields, terms=False)), terms))
    if rest:
        words = field_words(records, rest, doc_id)
        found = postings_of(words, rest, positions, asked)
        size = F.size("words")
        stats = length_stats(words.select("field", F.when(size > 0, size).alias("length")))
        # Counted by the postings' own columns, so that both plans share one exchange of the postings.
        held = F.col("tf") + F.col("doc_length") + (F.size("positions") if positions else F.lit(0))
        parts.append((found, stats, found.groupBy("field", "term").agg(F.count_if(held > 0).alias("df"))))
    postings, stats, vocabulary = parts[0] if len(parts) == 1 else (a.unionByName(b) for a, b in zip(*parts))
    return Index(schema, postings, stored_documents(records, schema, doc_id), stats, vocabulary)


def in_batches(schema: Sequence[Field]) -> dict[str, analysis.Analyzer]:
    """The fields that Arrow batches can analyze."""
    return {f.name: analyzer_of(f) for f in schema if f.kind != STORED and analyzer_of(f).gaps}


def texts_of(records: DataFrame, fields: Sequence[str], doc_id: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(*carry, doc_id, a text a field)."""
    return spread(records.select(*carry, F.col(doc_id).alias("doc_id"), *(F.col(f).cast("string").alias(f) for f in fields if f != doc_id)))


#: Terms that are given to every task; more are joined.
FEW = 200_000


def few_terms(asked: DataFrame, most: int = FEW) -> frozenset[str] | None:
    """The asked terms, or None if there are more than a task can hold."""
    found = [r.term for r in asked.select("term").distinct().limit(most + 1).collect()]
    return frozenset(found) if len(found) <= most else None


def stats_of(counts: DataFrame) -> DataFrame:
    """(field, documents, total_terms, average) from the batches' counts."""
    rows = counts.filter("term IS NULL").groupBy("field").agg(F.sum("n").alias("documents"), F.sum("total").alias("total_terms"))
    return rows.withColumn("average", F.when(F.col("documents") > 0, F.col("total_terms") / F.col("documents")).otherwise(0.0))


def first_by_key(records: DataFrame, key: str, *order) -> DataFrame:
    """One record a key, the first in ``order``: later ones are rejected as repeated."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return records.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
