"""Pieces of DuckDB SQL that several queries' oracles share.  Written apart from the
Column expressions, so that each can find the other's errors."""

from __future__ import annotations

from quillspark.functions.analysis import STOP_WORDS, SUFFIX_RULES

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def stem(word: str) -> str:
    cases = []
    for suffix, put in SUFFIX_RULES:
        cases.append(f"WHEN suffix({word}, '{suffix}') AND length({word}) - {len(suffix)} >= 2 THEN {word}[:length({word}) - {len(suffix)}] || '{put}'")
    return "CASE " + " ".join(cases) + f" ELSE {word} END"


def words(text: str, pattern: str = r"[\p{L}\p{N}_'']+") -> str:
    """Lower-cased tokens without stop words."""
    return f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: lower(x)), lambda x: NOT list_contains({STOPS}, x))"


def tokens(source: str, fields: dict[str, str], key: str = "doc_id", extra: str = "") -> str:
    """CTEs: lens(key, field, len) and toks(key, field, pos, term) of stemmed terms."""
    parts = " UNION ALL ".join(f"SELECT {key}{extra}, '{f}' AS field, {words(f'coalesce({e}, '+chr(39)*2+')')} AS w FROM {source}" for f, e in fields.items())
    return f"""
        raw AS ({parts}),
        lens AS (SELECT {key}{extra}, field, CASE WHEN len(w) > 0 THEN len(w) END AS len FROM raw),
        each AS (SELECT {key}{extra}, field, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM raw),
        toks AS (SELECT {key}{extra}, field, pos, {stem('t')} AS term FROM each)"""


IDF = "greatest(ln(greatest((n - df + 0.5) / (df + 0.5), 1e-6) + 1e-6) + 1, 1e-6)"


def bm25(k1: float = 1.2) -> str:
    return f"(tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * least(dl / greatest(avg_len, 1e-9), 4.0))))"
