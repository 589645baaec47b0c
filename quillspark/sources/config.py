"""Deployment files: shared settings, tenants, and how their documents are indexed and scheduled.

Strict: keys that aren't known are errors, numbers have ranges, and schedules must parse.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.schedule import Cron

SOURCES = ("online", "filesystem", "git")
PROFILES = ("default", "aggressive-stem", "code-friendly")
# The ranges that numbers of a deployment file may have.
RANGES = {
    "bm25_k1": (0.5, 3.0),
    "bm25_b": (0.1, 1.0),
    "fragment_char_limit": (80, 2000),
    "max_fragments": (1, 5),
    "surrounding_context_chars": (40, 800),
    "cache_pin_seconds": (0, 3600),
    "git_sync_interval_minutes": (5, 1440),
    "max_crawl_pages": (1, float("inf")),
    "snippet_surrounding_chars": (200, 3000),
}
# The shared settings.  They set up servers and logs, which aren't part of a data engine.
INFRASTRUCTURE = (
    "mcp_host",
    "mcp_port",
    "default_client_model",
    "max_concurrent_requests",
    "uvicorn_workers",
    "uvicorn_limit_concurrency",
    "log_level",
    "log_profile",
    "log_profiles",
    "observability_collector",
    "search_include_stats",
    "operation_mode",
    "trusted_hosts",
    "https_redirect",
    "allow_index_builds",
    "http_timeout",
    "search_timeout",
    "default_snippet_surrounding_chars",
    "crawler_playwright_first",
    "crawler_proxy_attempt_timeout_seconds",
    "fallback_extractor_url",
    "search_max_segments",
    "sync_concurrency_limit",
    "article_proxies",
    "article_extractor_fallback",
)


def _in_range(part) -> None:
    for f in fields(part):
        low, high = RANGES.get(f.name, (None, None))
        value = getattr(part, f.name)
        if low is not None and value is not None and not low <= value <= high:
            raise ValueError(f"{f.name} is {value}; it may be {low} to {high}")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is {value}; it may be {', '.join(allowed)}")


@dataclass(frozen=True)
class Ranking:
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    __post_init__ = _in_range


@dataclass(frozen=True)
class Snippet:
    style: str = "plain"
    fragment_char_limit: int = 240
    max_fragments: int = 2
    surrounding_context_chars: int = 120

    def __post_init__(self):
        _one_of("style", self.style, ("plain", "html"))
        _in_range(self)


@dataclass(frozen=True)
class Boosts:
    title: float = 2.5
    headings_h1: float = 2.5
    headings_h2: float = 2.0
    headings: float = 1.5
    body: float = 1.0
    code: float = 1.2
    path: float = 1.5
    url: float = 1.5

    def __post_init__(self):
        if any(not 0 <= getattr(self, f.name) <= 5 for f in fields(self)):
            raise ValueError("boosts may be 0 to 5")


@dataclass(frozen=True)
class Search:
    enabled: bool = True
    engine: str = "bm25"
    analyzer_profile: str = "default"
    boosts: Boosts = field(default_factory=Boosts)
    snippet: Snippet = field(default_factory=Snippet)
    ranking: Ranking = field(default_factory=Ranking)
    suggestions_enabled: bool = False
    cache_pin_seconds: float = 0.0

    def __post_init__(self):
        _one_of("engine", self.engine, ("bm25",))
        _one_of("analyzer_profile", self.analyzer_profile, PROFILES)
        _in_range(self)


@dataclass(frozen=True)
class Tenant:
    codename: str
    docs_name: str
    source_type: str = "online"
    description: str | None = None
    docs_root_dir: str | None = None
    git_repo_url: str | None = None
    git_branch: str = "main"
    git_subpaths: tuple[str, ...] = ()
    git_strip_prefix: str | None = None
    git_auth_token_env: str | None = None
    git_sync_interval_minutes: int | None = None
    docs_sitemap_url: tuple[str, ...] = ()
    docs_entry_url: tuple[str, ...] = ()
    url_whitelist_prefixes: tuple[str, ...] = ()
    url_blacklist_prefixes: tuple[str, ...] = ()
    fetch_user_agent: str | None = None
    markdown_url_suffix: str | None = None
    canonicalize_discovered_markdown_urls: bool = False
    preserve_query_strings: bool = True
    refresh_schedule: str | None = None
    max_crawl_pages: int = 10000
    enable_crawler: bool = False
    semantic_cache_enabled: bool = True
    article_proxies: str | None = None
    snippet_surrounding_chars: int = 1000
    search: Search = field(default_factory=Search)
    allow_index_builds: bool | None = None
    test_queries: dict[str, list[str]] | None = None

    def __post_init__(self):
        if not re.fullmatch(r"[a-z][a-z0-9_-]{1,63}", self.codename):
            raise ValueError(f"codename {self.codename!r} isn't 2 to 64 of a-z, 0-9, _ and -, a letter first")
        if not 1 <= len(self.docs_name) <= 200 or len(self.description or "") > 1000:
            raise ValueError(f"{self.codename}: docs_name has 1 to 200 characters, description 1000 at most")
        _one_of("source_type", self.source_type, SOURCES)
        _in_range(self)
        needed = {"filesystem": self.docs_root_dir, "git": self.git_repo_url and self.git_subpaths, "online": self.docs_sitemap_url or self.docs_entry_url}
        if not needed[self.source_type]:
            raise ValueError(f"{self.codename}: a {self.source_type} tenant must say where its documents are")
        if self.git_auth_token_env and not re.fullmatch(r"[A-Z_][A-Z0-9_]*", self.git_auth_token_env):
            raise ValueError(f"{self.codename}: git_auth_token_env names an environment variable")
        if self.refresh_schedule:
            Cron(self.refresh_schedule)

    @property
    def synced(self) -> bool:
        """Only online tenants with a schedule are synced by it."""
        return self.source_type == "online" and self.refresh_schedule is not None


@dataclass(frozen=True)
class Deployment:
    infrastructure: dict
    tenants: tuple[Tenant, ...]

    def tenant(self, codename: str) -> Tenant | None:
        return next((t for t in self.tenants if t.codename == codename), None)

    def selected(self, codenames=()) -> list[Tenant]:
        """The named tenants in the order asked for, or all; a name that isn't there is an error."""
        if odd := [c for c in codenames if not self.tenant(c)]:
            raise ValueError(f"unknown tenants: {', '.join(odd)}")
        return [self.tenant(c) for c in codenames] or list(self.tenants)


def _list(value) -> tuple[str, ...]:
    if isinstance(value, str):
        value = value.split(",")
    return tuple(x for x in (p.strip() for p in value or ()) if x)


def _known(row: dict, names) -> dict:
    if odd := sorted(set(row) - set(names)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return row


def _make(kind, row: dict, **parts):
    row = dict(_known(row, [f.name for f in fields(kind)]))
    for name, make in parts.items():
        if name in row:
            row[name] = make(row[name])
    return kind(**row)


def _search(row: dict) -> Search:
    return _make(Search, row, boosts=lambda r: _make(Boosts, r), snippet=lambda r: _make(Snippet, r), ranking=lambda r: _make(Ranking, r))


_LISTS = ("git_subpaths", "docs_sitemap_url", "docs_entry_url", "url_whitelist_prefixes", "url_blacklist_prefixes")


def parse_deployment(text: str) -> Deployment:
    """A deployment file: shared settings and at least one tenant, each codename once."""
    whole = _known(json.loads(text), ("infrastructure", "tenants"))
    shared = _known(whole.get("infrastructure", {}), INFRASTRUCTURE)
    _one_of("operation_mode", shared.get("operation_mode", "online"), ("online", "offline"))
    tenants = tuple(_make(Tenant, row, search=_search, **dict.fromkeys(_LISTS, _list)) for row in whole["tenants"])
    names = [t.codename for t in tenants]
    if not names or len(set(names)) < len(names):
        raise ValueError("a deployment has tenants, each codename once")
    return Deployment(shared, tenants)


def parse_tenants(text: str) -> list[Tenant]:
    return list(parse_deployment(text).tenants)


def read_deployment(spark: SparkSession, path: str) -> Deployment:
    return parse_deployment("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_tenants(spark: SparkSession, path: str) -> list[Tenant]:
    return list(read_deployment(spark, path).tenants)


def tenant_table(spark: SparkSession, tenants: list[Tenant]) -> DataFrame:
    """The tenants as rows for discovery.  Test queries of all kinds are one list."""
    rows = []
    for t in tenants:
        asked = [q for kind in (t.test_queries or {}).values() for q in kind]
        rows.append((t.codename, t.docs_name, t.description or "", t.source_type, list(t.url_whitelist_prefixes or t.docs_entry_url), asked))
    return spark.createDataFrame(rows, "codename string, display_name string, description string, source_type string, url_prefixes array<string>, test_queries array<string>")
