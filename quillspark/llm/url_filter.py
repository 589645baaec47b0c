"""URL filters: rules indexed by their rarest literal token.

A pattern rule names tokens (runs of a-z and 0-9) that every url it matches holds; a
rule by host and path has those of its host and the whole ones of its path.  One pass
counts these tokens over all urls; a rule is filed under the one that fewest urls
hold.  Judging a url looks its tokens up in that index, and only the rules found there
are tried.  Rules by host and path come first: the longest that fits decides; else the
first pattern rule in list order; else allow.  Both lists are parameters; :func:`read_rules`
takes them from a table.

What reaches the driver is a count per literal token, bounded by the rules; the rules
and their index go to the executors with the code.

Defined cases: a null url, or one without ``://``, has an empty host and path and is
allowed, unless a pattern matches the url as it stands.  A rule without a token is
tried on every url.  Of equally long rules that fit the first in the list decides.
Repeated rows each give a row; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns

# The host and path rules.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Pattern:
    verdict: str
    regex: str
    #: Tokens of every url that the expression matches (in the url's lower-cased form).
    tokens: tuple[str, ...]


PATTERNS = (
    Pattern("block", r"^[a-z]+://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    Pattern("block", r"^[a-z]+://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    Pattern("block", r"^[a-z]+://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    Pattern("block", r"^[a-z]+://([^/?#]*\.)?adult-[a-z0-9]+\.", ("adult",)),
    Pattern("block", r"[?&]sessionid=[0-9a-f]{16,}", ("sessionid",)),
    Pattern("block", r"/wp-login\.php($|[?#])", ("wp", "login", "php")),
    Pattern("allow", r"/robots\.txt($|[?#])", ("robots", "txt")),
)
_TOKEN = r"[a-z0-9]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def fits(rule: tuple[str, str, str], host: str, path: str) -> bool:
    """Whether a (verdict, host, path) rule fits a url: its host or a subdomain, its path or what is below."""
    _, h, p = rule
    return path.startswith(p) and (host == h or host.endswith("." + h))


def rule_tokens(rule: tuple[str, str, str]) -> tuple[str, ...]:
    """Tokens of every url that a host and path rule fits: those that the url can't extend."""
    _, host, path = rule
    inner = re.match(r".*[^A-Za-z0-9]|", path, re.DOTALL)[0]  # a last token may go on in the url
    return tuple(dict.fromkeys(re.findall(_TOKEN, f"{host}/{inner}".translate(_LOWER))))


def read_rules(table: DataFrame) -> tuple[tuple[tuple[str, str, str], ...], tuple[Pattern, ...]]:
    """(host rules, patterns) of a rule table (nth, verdict, host, path, regex, tokens), in the order of nth.

    A row with a regex is a pattern.  Rules are few beside urls: each is read by the driver.
    """
    rows = table.select("nth", "verdict", "host", "path", "regex", "tokens").orderBy("nth", "verdict", "host", "path", "regex").collect()
    hosts = tuple((r.verdict, r.host or "", r.path or "") for r in rows if r.regex is None)
    return hosts, tuple(Pattern(r.verdict, r.regex, tuple(r.tokens or ())) for r in rows if r.regex is not None)


def token_counts(pages: DataFrame, rules: Sequence[Sequence[str]]) -> dict[str, int]:
    """How many urls hold each literal token of the rules' tokens."""
    wanted = sorted({t for tokens in rules for t in tokens})
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit(_TOKEN), F.lit(0)))
    each = pages.select(F.explode(found).alias("t"))
    known = pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    rows = each.join(F.broadcast(known), "t").groupBy("t").count().collect()
    return dict.fromkeys(wanted, 0) | {r["t"]: r["count"] for r in rows}


def index_rules(counts: dict[str, int], rules: Sequence[Sequence[str]]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; under the empty string those without a token."""
    index: dict[str, list[int]] = {}
    for k, tokens in enumerate(rules):
        index.setdefault(min(tokens, key=lambda t: (counts[t], -len(t), t), default=""), []).append(k)
    return index


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern), a row per page; pattern is the
    expression that decided, where one did."""
    pages = doc_columns(pages, ("page_id", "bigint"), ("url", "string"))
    # Host rules are numbered first, patterns after them.
    tokens = [rule_tokens(r) for r in host_rules] + [p.tokens for p in patterns]
    index, n = index_rules(token_counts(pages, tokens), tokens), len(host_rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p.regex) for p in patterns]
        word = re.compile(_TOKEN)
        for batch in batches:
            out = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, path = split_url(url)
                low = (url or "").lower()
                # The url's own tokens and those of its ASCII lower-cased form: no letter's case hides a rule.
                held = {*word.findall(low), *word.findall((url or "").translate(_LOWER)), ""}
                candidates = sorted(k for t in held for k in index.get(t, ()))
                fit = max((host_rules[k] for k in candidates if k < n and fits(host_rules[k], host, path)), key=lambda r: len(r[1] + r[2]), default=None)
                rule, verdict, pattern = (fit[1] + fit[2], fit[0], None) if fit else (None, "allow", None)
                if not fit and url:
                    for k in candidates:
                        if k >= n and compiled[k - n].search(low):
                            verdict, pattern = patterns[k - n].verdict, patterns[k - n].regex
                            break
                out.append((page_id, host, path, rule, verdict, pattern))
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(columns)], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, pattern string")
