"""Text analyzers as Column expressions, each with a plain Python twin.

``analyze(name)`` gives a function from a text Column to an array of terms.  All of it
runs in the JVM: one regular expression, array filters and a chain of suffix rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, and the stemmer's suffix rules in the order they are tried.
STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
SUFFIX_RULES = (
    ("ization", "ize"),
    ("ational", "ate"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("iveness", "ive"),
    ("tional", "tion"),
    ("biliti", "ble"),
    ("lessli", "less"),
    ("entli", "ent"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("abli", "able"),
    ("alli", "al"),
    ("ator", "ate"),
    ("alism", "al"),
    ("aliti", "al"),
    ("ousli", "ous"),
    ("ration", "rate"),
    ("ation", "ate"),
    ("ness", ""),
    ("ment", ""),
    ("ance", "an"),
    ("ence", "en"),
    ("able", ""),
    ("ible", ""),
    ("ingly", ""),
    ("edly", ""),
    ("ing", ""),
    ("ed", ""),
    ("ly", ""),
    ("es", ""),
    ("s", ""),
)

WORDS = r"[\p{L}\p{N}_']+"
CODE = r"(?U)\w+(?:[._]\w+)*"
ASCII_WORDS = r"[0-9A-Za-z_]+"



def stem_sql(word: str) -> str:
    """:func:`stem` as SQL text over a named column: one parsed expression in place of hundreds of calls."""
    by_last: dict[str, str] = {}
    for suffix, put in reversed(SUFFIX_RULES):
        n = len(suffix)
        cut = f"left({word}, length({word}) - {n})"
        cut = f"concat({cut}, '{put}')" if put else cut
        rest = by_last.get(suffix[-1], word)
        by_last[suffix[-1]] = f"CASE WHEN endswith({word}, '{suffix}') AND length({word}) >= {n + 2} THEN {cut} ELSE {rest} END"
    # Endings are compared by bytes; taking the last character would count all of them.
    cases = " ".join(f"WHEN endswith({word}, '{letter}') THEN {rules}" for letter, rules in by_last.items())
    return f"CASE {cases} ELSE {word} END"


def stem(word: Column) -> Column:
    """The first rule whose suffix leaves two characters or more; else the word.  ``word`` is lower case.

    Rules that end in different letters exclude each other, so the last letter picks
    the few rules that are tried, in their order.
    """
    size = F.length(word)
    by_last: dict[str, Column] = {}
    for suffix, put in reversed(SUFFIX_RULES):
        cut = F.left(word, size - len(suffix))
        cut = F.concat(cut, F.lit(put)) if put else cut
        by_last[suffix[-1]] = F.when(F.endswith(word, F.lit(suffix)) & (size >= len(suffix) + 2), cut).otherwise(by_last.get(suffix[-1], word))
    last, chain = F.right(word, F.lit(1)), word
    for letter, rules in by_last.items():
        chain = F.when(last == letter, rules).otherwise(chain)
    return chain


@dataclass(frozen=True)
class Analyzer:
    """``words`` cuts a text to an array; ``finish``, if any, is applied to each word.

    Kept apart so that an index can finish words after exploding them, in generated
    code; calling the analyzer does both on the array.
    """

    words: Callable[[Column], Column]
    finish: Callable[[Column], Column] | None = None
    #: ``finish`` as SQL text over a named column.
    finish_sql: Callable[[str], str] | None = None
    #: What stands between words (RE2), for texts analyzed in Arrow batches, with ``finish`` for one string and the words left out.
    gaps: str | None = None
    finish_word: Callable[[str], str] | None = None
    stop_words: Sequence[str] = ()

    def __call__(self, text: Column) -> Column:
        found = self.words(text)
        return F.transform(found, self.finish) if self.finish else found


_BY_LAST = {letter: [r for r in SUFFIX_RULES if r[0][-1] == letter] for letter in {s[-1] for s, _ in SUFFIX_RULES}}


def stem_word(word: str) -> str:
    """:func:`stem` for one string."""
    word = word.lower()
    for suffix, put in _BY_LAST.get(word[-1:], ()):
        if word.endswith(suffix) and len(word) >= len(suffix) + 2:
            return word[: len(word) - len(suffix)] + put
    return word


def tokens(text: Column, pattern: str, stop_words: Sequence[str] | None = STOP_WORDS) -> Column:
    """Lower-cased matches of ``pattern`` without stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    if not stop_words:
        return found
    gone = [w.lower() for w in stop_words]
    return F.filter(found, lambda t: ~t.isin(gone))


def standard(text: Column, *, stop_words: Sequence[str] | None = STOP_WORDS, stemming: bool = True) -> Column:
    found = tokens(text, WORDS, stop_words)
    return F.transform(found, stem) if stemming else found


def path(text: Column) -> Column:
    """Parts between slashes; a text without a slash is analyzed as words."""
    parts = F.filter(F.split(F.lower(text), "/"), lambda p: p != "")
    return F.when(F.contains(text, F.lit("/")), parts).otherwise(standard(text))


_GAPS = r"[^\pL\pN_']+"
STANDARD = Analyzer(lambda c: tokens(c, WORDS), stem, stem_sql, _GAPS, stem_word, STOP_WORDS)
UNSTEMMED = Analyzer(lambda c: tokens(c, WORDS), gaps=_GAPS, stop_words=STOP_WORDS)
#: Keeps dotted and underscored names whole.
CODE_FRIENDLY = Analyzer(lambda c: tokens(c, CODE))
KEYWORD = Analyzer(lambda c: F.filter(F.array(c), lambda x: x != ""))
#: The command line's own: ASCII words.
COMMAND_LINE = Analyzer(lambda c: tokens(c, ASCII_WORDS), stem, stem_sql, "[^0-9A-Za-z_]+", stem_word, STOP_WORDS)

_ANALYZERS: dict[str, Analyzer] = {
    "default": STANDARD,
    "english": STANDARD,
    "english-nostem": UNSTEMMED,
    "aggressive-stem": STANDARD,
    "code-friendly": CODE_FRIENDLY,
    "keyword": KEYWORD,
    "path": Analyzer(path),
    "command-line": COMMAND_LINE,
}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    _ANALYZERS[name.lower()] = analyzer


def analyze(name: str | None = None) -> Analyzer:
    """An analyzer by name, in any case; None is the default."""
    try:
        return _ANALYZERS[(name or "default").lower()]
    except KeyError:
        raise ValueError(f"unknown analyzer {name!r}; there are {sorted(_ANALYZERS)}") from None


def standard_terms(text: str, *, stop_words: Sequence[str] | None = STOP_WORDS, stemming: bool = True) -> list[str]:
    """:func:`standard` for one string."""
    gone = {w.lower() for w in stop_words or ()}
    found = [t.lower() for t in re.findall(r"[\w']+", text)]
    return [stem_word(t) if stemming else t for t in found if t not in gone]
