"""Document text functions as Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a language in a URL, in the order they are tried.
LANGUAGE_MARKS = (
    ("/ja/", "ja"),
    ("/jp/", "ja"),
    ("/zh/", "zh"),
    ("/zh-cn/", "zh"),
    ("/zh-tw/", "zh"),
    ("/ko/", "ko"),
    ("/de/", "de"),
    ("/fr/", "fr"),
    ("/es/", "es"),
    ("/pt/", "pt"),
    ("/ru/", "ru"),
    ("/it/", "it"),
    ("/en/", "en"),
    ("ja.", "ja"),
    ("jp.", "ja"),
    ("zh.", "zh"),
    ("ko.", "ko"),
    ("de.", "de"),
    ("fr.", "fr"),
)
# Words left out of keywords, capitals that aren't acronyms, and verb stems.
KEYWORD_STOPS = tuple("the and for with that this from have will are was were been being you your can should would could may might must than then them they their there where when what which who why how about".split())
NOT_ACRONYMS = tuple("THE AND FOR WITH HOW WHAT WHEN WHERE THAT THIS FROM HAVE WILL".split())
VERB_STEMS = tuple("creat updat delet retriev validat serializ authentica authoriz configur deploy instal enabl disabl".split())


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_heading(text: Column) -> Column:
    """Without a pilcrow link at its end, spaces collapsed."""
    return collapse(F.regexp_replace(strip(text), r"(?U)\s*\[¶\]\(.*?\)$", ""))


def headings(markdown: Column, levels: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> Column:
    """The headings of some levels, in order, as an array.  Code fences aren't left out."""
    found = F.regexp_extract_all(markdown, F.lit(r"(?mdU)^#{1,6}\s+.+$"), F.lit(0))
    of_level = F.filter(found, lambda h: F.length(F.regexp_extract(h, "^#+", 0)).isin(*levels))
    texts = F.transform(of_level, lambda h: clean_heading(F.regexp_replace(h, r"(?U)^#{1,6}\s+", "")))
    return F.filter(texts, lambda t: t != "")


def excerpt(markdown: Column, most: int = 320) -> Column:
    """The first paragraph that isn't a heading or a fence line, on one line."""
    lines = F.transform(F.split(markdown, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    marked = F.transform(lines, lambda s: F.when((s == "") | s.startswith("#") | s.startswith("```"), "").otherwise(s))
    start = F.array_position(F.transform(marked, lambda s: s != ""), True)
    rest = F.slice(marked, F.greatest(start, F.lit(1)).cast("int"), F.size(marked))
    stop = F.array_position(rest, "")
    block = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(rest)
    return F.when(start > 0, F.substring(collapse(F.array_join(block, " ")), 1, most)).otherwise("")


def title(given: Column, front: Column, markdown: Column, stem: Column) -> Column:
    """Metadata, else front matter, else the first heading, else the file's stem."""
    first = F.get(F.concat(headings(markdown, (1,)), headings(markdown, (2,)), headings(markdown, (3, 4, 5, 6))), 0)

    def some(c):
        return F.when(strip(c) != "", c)

    return F.coalesce(some(given), some(front), first, strip(F.replace(stem, F.lit("-"), F.lit(" "))))


def language(url: Column, given: Column | None = None) -> Column:
    """What is given, else the first mark in the URL, else English."""
    chain = F.lit("en")
    low = F.lower(url)
    for mark, code in reversed(LANGUAGE_MARKS):
        chain = F.when(F.contains(low, F.lit(mark)), code).otherwise(chain)
    chain = F.coalesce(chain, F.lit("en"))
    if given is None:
        return chain
    return F.when(strip(given) != "", F.substring(F.lower(strip(given)), 1, 5)).otherwise(chain)


def clean_markdown(text: Column) -> Column:
    """Blank runs to one blank line, space runs to one space."""
    lines = F.regexp_replace(text, r"(?m)^[ \t\x0b\x0c\r]+$", "")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def direct_markdown(text: Column) -> Column:
    """Without a byte order mark and carriage returns; blank runs to one; in lines that aren't
    fences, three spaces or more to two unless a backtick stands before them; a line end at the end."""
    body = F.replace(F.regexp_replace(text, "^﻿+", ""), F.lit("\r\n"), F.lit("\n"))
    lines = F.transform(F.split(body, "\n", -1), lambda s: F.when(strip(s) == "", "").otherwise(s))

    def spaced(s):
        indent = F.regexp_extract(s, "^ *", 0)
        rest = F.regexp_replace(s, "^ *", "")
        return F.when(rest.startswith("```"), s).otherwise(F.concat(indent, F.regexp_replace(rest, "(?<!`) {3,}", "  ")))

    kept = F.filter(lines, lambda s, i: (s != "") | (i == 0) | (F.get(lines, i - 1) != ""))
    out = F.array_join(F.transform(kept, spaced), "\n")
    return F.when(strip(body) == "", "").when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def html_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """The body's text pieces, one a line, without scripts, styles, comments and drawings."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    body = F.regexp_extract(bare, r"(?is)<body[^>]*>(.*)", 1)
    pieces = F.transform(F.split(F.when(body != "", body).otherwise(bare), r"<[^>]*>"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def unescape(text: Column) -> Column:
    """The common character references."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def html_headings(html: Column, level: int) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: collapse(unescape(F.regexp_replace(h, r"<[^>]*>", "")))), lambda h: h != "")


def html_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"'#]+)"""), F.lit(1)))


def enough_words(text: Column, least: int = 150) -> Column:
    return F.size(F.split(strip(text), r"\s+")) >= least


def slug_title(url: Column) -> Column:
    """The last part of a URL's path as a title."""
    last = F.element_at(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""), -1)
    return F.initcap(F.translate(F.regexp_replace(F.coalesce(last, F.lit("")), r"\.[A-Za-z0-9]+$", ""), "-_", "  "))


def acronyms(text: Column, starts: bool = False) -> Column:
    """Two to six capitals; with ``starts`` those that begin a sentence or a line too."""
    within = "" if starts else r"(?<!\. )(?<!\n)"
    found = F.regexp_extract_all(text, F.lit(rf"(?U){within}\b([A-Z]{{2,6}})\b"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*NOT_ACRONYMS))


def technical_nouns(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z0-9]{2,}\b"), F.lit(0))
    return F.filter(found, lambda w: (~w.isin(*KEYWORD_STOPS)) & (F.length(w) > 3))


def technical_terms(text: Column) -> Column:
    """Names with underscores, with inner capitals, and hyphenated ones."""
    patterns = (r"(?U)\b[a-z]+_[a-z_]+\b", r"(?U)\b[A-Z][a-z]+[A-Z][a-zA-Z]+\b", r"(?U)\b[a-z]+-[a-z-]+\b")
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns))


def verb_forms(text: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b{v}\w+\b"), F.lit(0)) for v in VERB_STEMS))


def query_words(text: Column) -> Column:
    parts = F.split(F.lower(text), r"(?U)\W+")
    return F.filter(parts, lambda t: (t != "") & (~t.isin(*KEYWORD_STOPS)))


_BLOCK = r"(?s)\A-----\s*\n(.*?)\n-----\s*\n"


def front_matter(content: Column) -> Column:
    """struct(fields, body): the YAML block between lines of five dashes at the head.

    Values are text; lists and maps are JSON text.  A block that isn't a YAML map counts as
    part of the body.  Only rows with a block are parsed.
    """

    @F.pandas_udf("map<string,string>")
    def parsed(block: pd.Series) -> pd.Series:
        return block.map(_yaml_fields)

    block = F.nullif(F.regexp_extract(content, _BLOCK, 1), F.lit(""))
    none = F.create_map().cast("map<string,string>")

    def chosen(fields):
        rest = F.regexp_replace(content, _BLOCK, "")
        return F.when(fields.isNotNull(), F.struct(fields.alias("fields"), rest.alias("body"))).otherwise(F.struct(none.alias("fields"), content.alias("body")))

    return F.get(F.transform(F.array(parsed(block)), chosen), 0)


def _yaml_fields(block: str | None) -> dict[str, str] | None:
    """A block's fields as text; None where it isn't a map."""
    if block is None:
        return None
    try:
        import yaml
    except ImportError:
        return _plain_fields(block)
    try:
        found = yaml.safe_load(block) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None

    def shown(v):
        if isinstance(v, (list, dict)):
            return json.dumps(v, ensure_ascii=False, default=str, sort_keys=True)
        return str(v).lower() if isinstance(v, bool) else "" if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)

    return {str(k): shown(v) for k, v in found.items()}


def _plain_fields(block: str) -> dict[str, str] | None:
    """Without a YAML library: lines of a key and a value, which may be quoted."""
    out = {}
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        found = re.match(r"([\w.-]+):(?:\s+(.*))?$", line.rstrip())
        if not found:
            return None
        value = (found[2] or "").strip()
        out[found[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def with_front_matter(fields: Column, body: Column) -> Column:
    """The text with its fields in front, sorted by name, as YAML; values that YAML would read as something else are quoted."""

    def shown(v):
        plain = v.rlike(r"^[A-Za-z0-9_/.(][^\n#'\"]*$") & ~v.rlike(r": |:$|\s$") & ~v.rlike(r"(?i)^(true|false|yes|no|on|off|null|~|[-+.0-9][0-9_.eE+:-]*)$") & ~v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
        quoted = F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
        lined = F.to_json(F.array(v))
        escaped = F.substring(lined, F.lit(2), F.length(lined) - 2)
        return F.when(v.contains("\n"), escaped).when(plain, v).otherwise(quoted)

    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e.key, F.lit(": "), shown(e.value)))
    head = F.concat(F.lit("-----\n"), F.array_join(entries, "\n"), F.lit("\n-----\n"))
    return F.when(F.size(fields) > 0, F.concat(head, body)).otherwise(body)


def tags(value: Column) -> Column:
    """An array of tags from a field: the items of a JSON list, or the text as one tag."""
    items = F.from_json(value, "array<string>")
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).when(value.startswith("[") & items.isNotNull(), items).otherwise(F.array(value))


def truncated(value: Column, most: int) -> Column:
    """The first characters, with three dots where there are more."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def first_lines(markdown: Column, most: int = 320, lines: int = 5, without_headings: bool = True) -> Column:
    """The first lines that aren't blank (or headings), trimmed, on one line."""
    kept = F.filter(F.split(markdown, "\n", -1), lambda x: (strip(x) != "") & (~x.startswith("#") if without_headings else F.lit(True)))
    joined = F.array_join(F.transform(F.slice(kept, 1, lines), strip), " ")
    return truncated(F.when(F.size(kept) > 0, joined).otherwise(markdown if without_headings else F.lit("")), most)


def redacted(key: Column, value: Column, secret: Sequence[str], most: int = 500) -> Column:
    """A log's value: hidden under some keys, cut where it is long."""
    return F.when(F.lower(key).isin([s.lower() for s in secret]), "[REDACTED]").otherwise(truncated(value, most))


def bounded(content: Column, most: int) -> Column:
    """struct(text, truncated, original_chars, returned_chars, original_bytes, returned_bytes, sha256) of a content's first characters."""
    cut = F.left(content, F.lit(most))
    size = F.length(content)
    return F.struct(
        cut.alias("text"),
        (size > most).alias("truncated"),
        size.alias("original_chars"),
        F.least(size, F.lit(most)).alias("returned_chars"),
        F.octet_length(content).alias("original_bytes"),
        F.octet_length(cut).alias("returned_bytes"),
        F.sha2(F.encode(cut, "utf-8"), 256).alias("sha256"),
    )


def character_vector(buckets: int = 16):
    """A light embedding of a text: code points summed by place modulo ``buckets``, of length one."""

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t):
            low = (t or "").lower().strip() or "unknown"
            v = [0.0] * buckets
            for i, c in enumerate(low):
                if c.isalnum():
                    v[i % buckets] += ord(c)
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            return [x / norm for x in v]

        return text.map(one)

    return embed


def wrapped(text: Column, width: int = 76) -> Column:
    """A text's words in lines of at most ``width`` bytes, as an array; longer words stand alone.

    A text that fits is one line as it is; null gives null.
    """

    def lines(value: str) -> list[str]:
        if len(value.encode()) <= width:
            return [value]
        out, used = [], width
        for word in value.split():
            size = len(word.encode())
            if used + 1 + size <= width:
                out[-1].append(word)
                used += 1 + size
            else:
                out.append([word])
                used = size
        return [" ".join(line) for line in out]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lines, na_action="ignore")

    return run(text)
