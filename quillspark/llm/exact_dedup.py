"""Exact deduplication by content-defined chunk recipes, all in DataFrame functions.

1. A text is cut into chunks where its own characters say so (three character
   classes in a row after a least size), so an insertion moves few cuts.
2. Chunks are deduplicated to identifiers: (two 64-bit hashes, length).  The
   dictionary of distinct chunk texts *verifies* them: an identifier with more
   than one text is a collision.
3. A document's recipe is its ordered list of identifiers.  Recipes, about 3 %
   of the text, are what is grouped and joined; long texts aren't moved again.
4. Documents with a chunk whose identifier collided get a strong digest of the
   text in front of their recipe, so a collision never merges unlike texts.

Defined cases: a null text counts as empty, and all empty texts are equal.  Of
equal texts the row with the largest doc_id stays; null is smaller than any id.
Rows that repeat both id and text count in ``group_size`` and exactly one of them
stays.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, doc_columns, text_of, without_keys, written

MIN_CHARS, MAX_CHARS = 512, 8192


def _class(step: int) -> str:
    """About every fifth printable Latin-1 character, chosen by a multiplicative rule."""
    chosen = [c for c in range(32, 256) if c * step % 251 % 5 == 0]
    return "[" + "".join(f"\\u{c:04x}" for c in chosen) + "]"


def cut_pattern(least: int = MIN_CHARS, most: int = MAX_CHARS) -> str:
    """A chunk: at least ``least`` characters up to the next cut or the end, ``most`` at most."""
    cut = "".join(_class(s) for s in (37, 101, 173))
    return f"(?s).{{{least},{most - 1}}}?(?:(?<={cut})|\\z)|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(cut_pattern(least, most)), F.lit(0))


def strong_identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.xxhash64(F.lit(7), chunk).alias("g"), F.length(chunk).alias("n"))


def chunk_dictionary(docs: DataFrame, identifier=strong_identifier, **sizes) -> DataFrame:
    """(id, chunk, uses): every distinct chunk text once.

    Partial aggregation folds copies before the exchange, so a chunk that a third
    of all documents hold travels once per map task.
    """
    each = docs.select(F.explode(chunks(text_of(), **sizes)).alias("chunk"))
    return each.groupBy(identifier(F.col("chunk")).alias("id"), "chunk").agg(F.count("*").alias("uses"))


def collided(docs: DataFrame, identifier=strong_identifier, **sizes) -> DataFrame:
    """(id): identifiers that stand for more than one chunk text."""
    return chunk_dictionary(docs, identifier, **sizes).select("id").groupBy("id").agg(F.count("*").alias("texts")).filter("texts > 1").select("id")


def recipe_rows(docs: DataFrame, identifier=strong_identifier, **sizes) -> DataFrame:
    """(doc_id, text_sha256, recipe, keep_id, group_size, same): a row per id and text;
    ``same`` is the number of rows that repeat both."""
    docs = doc_columns(docs, ("doc_id", "bigint"), ("text", "string"))
    recipes = docs.select("doc_id", F.transform(chunks(text_of(), **sizes), identifier).alias("recipe"), text_digest().alias("text_sha256"))
    # A collided identifier is split by the digest of the whole text: its recipes differ unless the texts agree.
    bad = collided(docs, identifier, **sizes)
    marked = (
        recipes.select("text_sha256", F.explode(F.array_distinct("recipe")).alias("id"))
        .join(bad, "id", "left_semi")
        .select("text_sha256")
        .distinct()
    )
    if bad.limit(1).count():
        guards = marked.select("text_sha256", F.col("text_sha256").alias("guard"))
        recipes = recipes.join(guards, "text_sha256", "left").withColumn("guard", F.coalesce("guard", F.lit("")))
    else:
        recipes = recipes.withColumn("guard", F.lit(""))
    recipes = recipes.withColumn("r", F.xxhash64("recipe", "guard"))
    # Repeated rows fold into a count before anything else.
    key = ["r", "recipe", "guard"]
    rows = recipes.groupBy("doc_id", *key, "text_sha256").agg(F.count("*").alias("same"))
    groups = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("same").alias("group_size"))
    return rows.join(groups, key).drop("r", "guard")


def text_digest() -> Column:
    return F.sha2(F.encode(text_of(), "utf-8"), 256)


def exact_groups(docs: DataFrame, identifier=strong_identifier, **sizes) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks), a row per document."""
    rows = recipe_rows(docs, identifier, **sizes)
    each = rows.select("doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").alias("n_chunks"), F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("nth"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", "n_chunks")


def drop_exact_copies(docs: DataFrame, few: int = FEW) -> DataFrame:
    """The documents that :func:`exact_groups` keeps, with all their columns; a
    row that repeats another's id and text goes as well.

    Texts aren't exchanged: what is written is the keys of the rows that go, an id
    and 60 bits of the digest, see :func:`~quillspark.llm.common.without_keys`.
    """

    def mark(sha256: Column) -> Column:
        return F.conv(F.substring(sha256, 1, 15), 16, 10).cast("bigint")

    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = recipe_rows(docs).filter(~stays | (F.col("same") > 1)).select("doc_id", mark(F.col("text_sha256")).alias("mark"), stays.alias("one"))
    return without_keys(docs, written(gone, "exact-copies"), mark(text_digest()), few)
