"""Index documents: headed lists of links, with an optional description after each."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import markdown
from .markdown import Inline


@dataclass(frozen=True)
class Entry:
    heading: str
    title: str
    link: str
    description: str | None = None


def _source(tokens: list[Inline]) -> str:
    parts = []
    for t in tokens:
        if t.kind == "text":
            parts.append(t.text)
        elif t.kind == "code":
            parts.append(f"`{t.text}`")
        elif t.kind == "link":
            parts.append(f"[{_source(t.children)}]({t.href})")
        elif t.kind in ("soft", "hard"):
            parts.append(" ")
        elif t.kind == "image":
            parts.append(f"![{_source(t.children)}]({t.href})")
        else:
            parts.append(t.text)
    return "".join(parts)


#: What a skipped list item is told to be.
PROBLEMS = {
    "missing-link": "skipped malformed index entry: missing link target",
    "not-first": "skipped malformed index entry: entry link must be the first content",
    "no-title": "skipped malformed index entry: missing link title",
    "more-links": "skipped malformed index entry: additional links must be in a description",
    "trailing": "skipped malformed index entry: trailing text must be in a description",
}


def _entry(heading: str, tokens: list[Inline]) -> Entry | str:
    at = next((i for i, t in enumerate(tokens) if t.kind == "link"), None)
    if at is None:
        return PROBLEMS["missing-link"]
    if _source(tokens[:at]).strip():
        return PROBLEMS["not-first"]
    link, rest = tokens[at], tokens[at + 1 :]
    if not link.href:
        return PROBLEMS["missing-link"]
    title, tail = _source(link.children), _source(rest)
    if not title:
        return PROBLEMS["no-title"]
    described = re.match(r"\s+-\s+", tail)
    if not described and any(t.kind == "link" for t in rest):
        return PROBLEMS["more-links"]
    if not described and tail.strip():
        return PROBLEMS["trailing"]
    return Entry(heading, title, link.href, tail[described.end() :].rstrip() if described else None)


def parse(content: str) -> tuple[list[Entry], list[tuple[str, int, str]]]:
    """Entries under first-level headings, and (heading, line, message) of items that are none."""
    blocks, references = markdown.parse(content)
    heading, entries, problems = None, [], []
    for block in blocks:
        if block.kind == "heading" and block.level == 1:
            heading = block.text
        elif block.kind == "list" and block.marker == "bullet" and heading is not None:
            for item in block.children:
                first = next(iter(markdown.texts(item.children)), None)
                if first is None:
                    continue
                found = _entry(heading, markdown.inline(first.text, references))
                if isinstance(found, Entry):
                    entries.append(found)
                else:
                    problems.append((heading, first.line + 1, found))
    return entries, problems


def render_entry(title: str, link: str, description: str | None) -> str:
    line = f"* {markdown.render_link(title, link)}"
    return f"{line} - {markdown.escape_text(description)}" if description else line


def heading_of(kind: str) -> str:
    return kind.title()
