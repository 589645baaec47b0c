"""Documentation archives in DocC's JSON as markdown."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _inline(parts, references: dict) -> str:
    out = []
    for p in parts or []:
        kind, inner = p.get("type"), _inline(p.get("inlineContent"), references)
        match kind:
            case "text":
                out.append(p.get("text", ""))
            case "codeVoice":
                out.append(f"`{p.get('code', '')}`")
            case "emphasis":
                out.append(f"*{inner}*")
            case "strong":
                out.append(f"**{inner}**")
            case "reference":
                target = references.get(p.get("identifier"), {})
                out.append(f"[{target.get('title', p.get('identifier', ''))}]({target.get('url', '')})")
            case "link":
                out.append(f"[{p.get('title', '')}]({p.get('destination', '')})")
            case _:
                out.append(inner)
    return "".join(out)


def _blocks(content, references: dict, depth: int = 0) -> list[str]:
    out = []
    for b in content or []:
        match b.get("type"):
            case "heading":
                out.append("#" * min(int(b.get("level", 2)), 6) + " " + b.get("text", ""))
            case "paragraph":
                out.append("  " * depth + _inline(b.get("inlineContent"), references))
            case "codeListing":
                out.append("\n".join([f"```{b.get('syntax') or ''}", *b.get("code", []), "```"]))
            case "unorderedList" | "orderedList" as kind:
                for i, item in enumerate(b.get("items", []), 1):
                    mark = "-" if kind == "unorderedList" else f"{i}."
                    lines = _blocks(item.get("content"), references, depth)
                    out.append("  " * depth + f"{mark} " + "\n".join(lines).strip())
            case "aside":
                out.append("> " + " ".join(_blocks(b.get("content"), references)))
            case "table":
                rows = [[" ".join(_blocks(cell, references)) for cell in row] for row in b.get("rows", [])]
                if rows:
                    head = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
                    out.append("\n".join(head + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
            case _:
                out += _blocks(b.get("content"), references, depth)
    return out


def render(payload: str | None) -> str | None:
    """Markdown of one page's JSON; null for what isn't JSON."""
    try:
        page = json.loads(payload or "")
    except ValueError:
        return None
    references = page.get("references") or {}
    out = ["# " + ((page.get("metadata") or {}).get("title") or "Untitled")]
    if abstract := _inline(page.get("abstract"), references):
        out.append(abstract)
    for section in page.get("primaryContentSections") or []:
        if declared := section.get("declarations"):
            out += ["```\n" + "".join(t.get("text", "") for t in d.get("tokens", [])) + "\n```" for d in declared]
        out += _blocks(section.get("content"), references)
    for group in page.get("topicSections") or []:
        out.append("## " + (group.get("title") or "Topics"))
        out += [f"- [{references.get(i, {}).get('title', i)}]({references.get(i, {}).get('url', '')})" for i in group.get("identifiers", [])]
    return "\n\n".join(out) + "\n"


def markdown(payload: Column) -> Column:
    """:func:`render` of a column."""

    @F.pandas_udf("string")
    def rendered(payload: pd.Series) -> pd.Series:
        return payload.map(render)

    return rendered(payload)
