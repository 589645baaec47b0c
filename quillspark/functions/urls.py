"""URL functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that make a path a file, and text in a path that isn't a link.
DOCUMENT_SUFFIXES = ("html", "htm", "ipynb")
FILE_EXTENSIONS = (".html", ".htm", ".pdf", ".txt", ".xml", ".json", ".yaml", ".yml", ".md", ".rst")
METADATA_FOLDER = "__docs_metadata"
#: Characters of a path, of one of its parts, and of a query's part of a name.
MOST_PATH, MOST_PART, MOST_QUERY = 200, 100, 80
ASSETS = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|map|woff2?|ttf|eot|pdf|zip|gz|tgz|mp4|webm|mp3)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def url_path(url: Column) -> Column:
    return part(url, "PATH")


def _split(url: Column) -> tuple[Column, Column, Column, Column]:
    """(scheme with //, host, path, query) without the fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    host = F.when(head != "", F.regexp_extract(rest, r"^[^/?]*", 0)).otherwise("")
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.lower(head), host, F.regexp_extract(tail, r"^[^?]*", 0), F.regexp_extract(tail, r"\?(.*)$", 1)


def has_extension(path: Column) -> Column:
    """Whether the last part has a dot."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1).contains(".")


def is_file(path: Column) -> Column:
    """Whether a path ends like a file of a known kind."""
    return reduce(lambda a, b: a | b, (F.endswith(F.lower(path), F.lit(e)) for e in FILE_EXTENSIONS))


def unquote(text: Column) -> Column:
    """Percent escapes decoded; a percent sign that isn't one of them stays."""
    return F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def quote(text: Column) -> Column:
    """As in a form: spaces as plus, all but letters, digits and ``_.-~`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """The (key, value) pairs of a query, decoded and sorted; those without a value are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("=."))

    def pair(p):
        p = F.replace(p, F.lit("+"), F.lit("%20"))
        return F.struct(unquote(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("key"), unquote(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value"))

    return F.array_sort(F.transform(parts, pair))


def _joined_query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(quote(p.key), F.lit("="), quote(p.value))), "&")


def _parameters(path: Column) -> tuple[Column, Column]:
    """A path without, and the parameters with their semicolon, of its last part."""
    found = F.regexp_extract(path, "^(?:.*/)?[^/;]*(;[^/]*)$", 1)
    return F.left(path, F.length(path) - F.length(found)), found


def canonical(url: Column, keep_query: bool = False) -> Column:
    """Host in lower case, no fragment, a slash at the end unless the path is a file of a known
    kind; the query decoded, sorted and encoded again, or gone."""
    head, host, path, query = _split(url)
    bare, parameters = _parameters(path)
    whole = F.when(bare == "", "/").when(is_file(bare) | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))
    out = F.concat(head, F.lower(host), whole, parameters)
    if not keep_query:
        return out
    ordered = _joined_query(query_pairs(query))
    return F.when(ordered != "", F.concat(out, F.lit("?"), ordered)).otherwise(out)


def file_name(url: Column) -> Column:
    """A name from the SHA-256 of the url without fragment and ``rg`` parameter, its parameters sorted."""
    head, host, path, query = _split(url)
    bare, parameters = _parameters(path)
    whole = F.when(has_extension(bare) | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))
    ordered = _joined_query(F.filter(query_pairs(query), lambda p: p.key != "rg"))
    full = F.concat(head, host, whole, parameters, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.concat(F.sha2(full, 256), F.lit(".md"))


def safe_part(part: Column, empty: str = "index") -> Column:
    """A part of a path as a folder's name: decoded, in lower case, dashes for what isn't a letter,
    digit or dot; a part too long ends in a hash of what was cut."""
    name = F.replace(F.lower(unquote(part)), F.lit(" "), F.lit("-"))
    name = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9._-]", "_"), "[-_]+", "-")
    name = F.regexp_replace(name, "^[-_.]+|[-_.]+$", "")
    digest = F.left(F.sha2(F.substring(name, MOST_PART + 1, 1 << 20), 256), F.lit(8))
    name = F.when(F.length(name) > MOST_PART, F.concat(F.left(name, F.lit(MOST_PART - 9)), F.lit("-"), digest)).otherwise(name)
    return F.when(name != "", name).otherwise(empty)


def _query_suffix(query: Column) -> Column:
    names = F.transform(query_pairs(query), lambda p: F.concat(safe_part(p.key), F.lit("_"), safe_part(p.value)))

    def bounded(joined):
        suffix = F.concat(F.lit("__q__"), joined)
        return F.when(joined == "", "").when(F.length(suffix) <= MOST_QUERY, suffix).otherwise(F.concat(F.lit("__q__hash_"), F.left(F.sha2(joined, 256), F.lit(12))))

    return let(F.array_join(names, "__"), bounded)


def markdown_path(url: Column, keep_query: bool = False) -> Column:
    """Where a url's text is stored: its host and the parts of its path as folders, the last part as ``.md`` file.

    A file's own ending stays (``page.html.md``).  With ``keep_query`` the parameters are
    part of the name.  In a path too long the folders between host and file are a hash.
    """

    def named(u):
        _, host, path, query = _split(u)
        parts = F.filter(F.split(_parameters(path)[0], "/"), lambda p: p != "")
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("index"))
        name = F.when(F.endswith(F.lower(last), F.lit(".md")), last).otherwise(F.concat(last, F.lit(".md")))
        if keep_query:
            suffix = _query_suffix(query)
            name = F.when(name.endswith(".md"), F.concat(F.left(name, F.length(name) - 3), suffix, F.lit(".md"))).otherwise(F.concat(name, suffix))
        folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.struct(safe_part(host).alias("host"), F.transform(folders, lambda x: safe_part(x)).alias("folders"), name.alias("file"))

    def bounded(p):
        whole = F.concat_ws("/", F.array(p.host), p.folders, F.array(p.file))
        # Two parts have no folders between; three or more have.
        short = F.when(F.size(p.folders) == 0, F.concat(F.lit("truncated-"), F.left(F.sha2(whole, 256), F.lit(16)))).otherwise(
            F.concat(p.host, F.lit("/"), F.left(F.sha2(F.array_join(p.folders, "/"), 256), F.lit(16)))
        )
        return F.when(F.length(whole) > MOST_PATH, F.concat(short, F.lit("/"), p.file)).otherwise(whole)

    return let(let(canonical(url, keep_query), named), bounded)


def metadata_path(url: Column, keep_query: bool = False) -> Column:
    """Beside it, below a folder of its own: the last ending is ``.meta.json``."""
    return F.concat(F.lit(METADATA_FOLDER + "/"), F.regexp_replace(markdown_path(url, keep_query), r"\.[^./]*$", ".meta.json"))


def markdown_mirror(url: Column, suffix: str = ".md", keep_query: bool = False) -> Column:
    """The url of a page's markdown twin; null for what isn't a document's url."""
    head, host, path, query = _split(url)
    bare = F.regexp_replace(path, "/+$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    extension = F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    stripped = F.when(last.contains("."), F.when(extension.isin(*DOCUMENT_SUFFIXES), F.regexp_replace(bare, r"\.[^.]*$", ""))).otherwise(bare)
    target = F.when(bare.endswith(suffix), bare).otherwise(F.concat(stripped, F.lit(suffix)))
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("") if keep_query else F.lit("")
    odd = bare.rlike(r"[\s<>\[\]()]|%20|%5B|%3C")
    return F.when(head.isin("http://", "https://") & (host != "") & (bare != "") & ~odd, F.concat(head, host, target, tail))


def semantic_slug(url: Column) -> Column:
    path = F.lower(F.trim(F.translate(url_path(url), "-_", "  ")))
    ref = part(url, "REF")
    slug = F.when(ref != "", F.trim(F.concat(path, F.lit(" #"), F.lower(ref)))).otherwise(path)
    return F.when(slug != "", slug).otherwise(F.lower(url))


def public_prefix(url: Column) -> Column:
    """Without user, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-z]+://)[^/@]*@", "$1")


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def _any_prefix(url: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(url, F.lit(p)) for p in prefixes), F.lit(False))


def allowed(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Some prefix of ``include`` (all, if none is given) and none of ``exclude``; an empty url isn't allowed."""
    url = F.coalesce(url, F.lit(""))
    inside = _any_prefix(url, include) if include else F.lit(True)
    return (url != "") & inside & ~_any_prefix(url, exclude)


def allowed_for_index(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """The same for records, whose url may be empty when nothing is asked for."""
    url = F.trim(F.coalesce(url, F.lit("")))
    return F.when(url == "", F.lit(not include)).otherwise(allowed(url, include, exclude))


def is_asset(url: Column) -> Column:
    return url_path(url).rlike(ASSETS)


def codename(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def included(url: Column, patterns: Sequence[str] = ()) -> Column:
    """Whether some pattern is found in the url, in any case; all, if none is given."""
    some = [p for p in patterns if p]
    return reduce(lambda a, b: a | b, (F.rlike(url, F.lit(f"(?i){p}")) for p in some), F.lit(False)) if some else F.lit(True)


def non_empty(value: Column) -> Column:
    """Null for what is empty."""
    return F.nullif(value, F.lit(""))


def lookup_candidates(url: Column) -> Column:
    """The urls under which a document may be stored, the best first: as it is, with and without a
    slash at the end, canonical, as a file."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    return F.array_distinct(F.array(url, bare, F.concat(bare, F.lit("/")), canonical(url), F.concat(bare, F.lit(".html")), F.concat(bare, F.lit("/index.html")), F.concat(bare, F.lit(".md"))))
