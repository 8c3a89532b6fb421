"""Content to content: sections, links, sources and stamps of one document."""

from __future__ import annotations

import datetime as dt
import math
import re
from typing import Any

from . import frontmatter, markdown, paths


class PlanningError(ValueError):
    """A change that can't be planned."""


def _sections(body: str) -> tuple[list[str], list[markdown.Block]]:
    return body.splitlines(keepends=True), [b for b in markdown.parse(body)[0] if b.kind == "heading"]


def _locate(body: str, heading: str, level: int) -> tuple[list[str], int, int] | None:
    """The lines of a body, and where a section's content begins and ends: up to the next heading as high."""
    lines, headings = _sections(body)
    found = [i for i, h in enumerate(headings) if h.level == level and h.text == heading]
    if len(found) > 1:
        raise PlanningError(f"heading {heading!r} is not unique")
    if not found:
        return None
    at = found[0]
    end = next((h.line for h in headings[at + 1 :] if h.level <= level), len(lines))
    return lines, headings[at].end, end


def _with_body(content: str, body: str) -> str:
    head, old = frontmatter.split(content)
    return content[: len(content) - len(old)] + body if head is not None else body


def replace_section(content: str, heading: str, level: int, new: str) -> str:
    """content with the section's text replaced; unchanged if it already reads so. The section must exist."""
    _, body = frontmatter.split(content)
    if any(b.kind == "heading" and b.level <= level for b in markdown.parse(new)[0]):
        raise PlanningError("section content has a heading at or above the section's level")
    spot = _locate(body, heading, level)
    if spot is None:
        raise PlanningError(f"no section {heading!r} of level {level}")
    lines, a, b = spot
    if "".join(lines[a:b]).strip() == new.strip():
        return content
    middle = f"\n{new.strip()}\n" if new.strip() else ""
    return _with_body(content, "".join(lines[:a]) + middle + ("\n" if b < len(lines) and middle else "") + "".join(lines[b:]))


def append_section(content: str, heading: str, level: int, new_lines: list[str]) -> str:
    """content with lines at the end of a section, which is made if it is missing. Lines whose links are there already stay out."""
    _, body = frontmatter.split(content)
    spot = _locate(body, heading, level)
    targets = {t for _, t, _ in markdown.links("".join(spot[0][spot[1] : spot[2]]))} if spot else set()
    fresh = []
    for line in new_lines:
        own = {t for _, t, _ in markdown.links(line)}
        if own and own <= targets or line in fresh:
            continue
        fresh.append(line if line.endswith("\n") else line + "\n")
        targets |= own
    if not fresh:
        return content
    if spot is None:
        gap = "" if not body.strip() else "\n" if body.endswith("\n") else "\n\n"
        return _with_body(content, f"{body}{gap}{'#' * level} {heading}\n\n{''.join(fresh)}")
    lines, a, b = spot
    while b > a and not lines[b - 1].strip():
        b -= 1
    listed = b > a and markdown.parse("".join(lines[a:b]))[0][-1].kind == "list"
    before = "".join(lines[:b])
    before += "" if before.endswith("\n") else "\n"
    return _with_body(content, before + ("" if listed else "\n") + "".join(fresh) + "".join(lines[b:]))


def _same_target(a: str, b: str) -> bool:
    return markdown.normalise_href(a) == markdown.normalise_href(b)


def rewrite_links(content: str, rewrites: dict[str, str]) -> str:
    """content with the destinations of inline links replaced where they equal an old target after normalisation.

    A target that a reference definition holds is refused. Code, images and text that only looks like a link stay.
    """
    wanted = {markdown.normalise_href(a): b for a, b in rewrites.items()}
    if len(wanted) != len(rewrites):
        raise PlanningError("duplicate link rewrites")
    _, body = frontmatter.split(content)
    blocks, references = markdown.parse(body)
    if any(markdown.normalise_href(t) in wanted for t, _ in references.values()):
        raise PlanningError("a reference definition holds the target")
    lines = body.splitlines(keepends=True)
    for block in markdown.texts(blocks):
        source = "".join(lines[block.line : block.end])
        expected = [t.href for t in _links_of(block, references)]
        if not any(h in wanted for h in expected):
            continue
        out, at, k = "", 0, 0
        for m in re.finditer(r"`+[^`]*`+|(!?)\[(?:[^\[\]\\]|\\.|`[^`]*`|\[[^\[\]]*\])*\](\(\s*)(<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)", source):
            if m[2] is None or m[1]:
                continue
            href = m[3][1:-1] if m[3].startswith("<") else m[3]
            if k < len(expected) and _same_target(markdown._unescape(href), expected[k]):
                k += 1
                new = wanted.get(markdown.normalise_href(markdown._unescape(href)))
                if new is not None:
                    out += source[at : m.start(3)] + (f"<{new}>" if m[3].startswith("<") or re.search(r"[\s()]", new) else new)
                    at = m.end(3)
        lines[block.line : block.end] = [out + source[at:]] + [""] * (block.end - block.line - 1)
    return _with_body(content, "".join(lines))


def _links_of(block: markdown.Block, references: markdown.References) -> list[markdown.Inline]:
    return [t for t in markdown.inline(block.text, references) if t.kind == "link"]


_ACTOR = re.compile(r"human:\S+|process:\S+|[^\s/:]+/[^\s/]+")
STATUSES = ("draft", "stable", "deprecated")


def check_actor(actor: str) -> str:
    if not isinstance(actor, str) or not _ACTOR.fullmatch(actor):
        raise PlanningError(f"not an actor: {actor!r}")
    return actor


def check_datetime(value: Any) -> dt.datetime:
    """A datetime with an offset; a trailing Z counts as one."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.replace("Z", "+00:00") if value.endswith("Z") else value)
        except ValueError as e:
            raise PlanningError(f"not a datetime: {value!r}") from e
    if not isinstance(value, dt.datetime) or value.utcoffset() is None:
        raise PlanningError(f"a datetime needs an offset: {value!r}")
    return value


def check_date(value: Any) -> dt.date:
    if isinstance(value, str):
        try:
            value = dt.date.fromisoformat(value)
        except ValueError as e:
            raise PlanningError(f"not a date: {value!r}") from e
    if not isinstance(value, dt.date) or isinstance(value, dt.datetime):
        raise PlanningError(f"not a date: {value!r}")
    return value


def check_values(values: Any) -> None:
    """Only what YAML can hold and give back: no other types, no infinite numbers, string keys."""
    if type(values) is dict:
        for k, v in values.items():
            if type(k) is not str:
                raise PlanningError(f"not a string key: {k!r}")
            check_values(v)
    elif type(values) is list:
        for v in values:
            check_values(v)
    elif type(values) is float and not math.isfinite(values) or type(values) not in (str, bool, int, float, type(None), dt.date, dt.datetime):
        raise PlanningError(f"not a frontmatter value: {values!r}")


def merge_frontmatter(content: str, updates: dict[str, Any]) -> str:
    check_values(updates)
    try:
        return frontmatter.merge(content, updates)
    except ValueError as e:
        raise PlanningError(str(e)) from e


def upsert_source(content: str, source: dict[str, Any]) -> str:
    """content with source among its sources, unless one with its id, or else its resource, is there."""
    if not isinstance(source.get("resource"), str) or not source["resource"].strip():
        raise PlanningError("a source needs a resource")
    if extra := set(source) - {"resource", "id", "title", "author", "usage_count", "last_modified"}:
        raise PlanningError(f"unknown source key {sorted(extra)[0]!r}")
    held = frontmatter.parse(content).frontmatter.get("sources") or []
    if not isinstance(held, list) or not all(isinstance(s, dict) for s in held):
        raise PlanningError("sources is not a list of mappings")
    key = "id" if source.get("id") else "resource"
    if any(s.get(key) == source[key] for s in held):
        return content
    return merge_frontmatter(content, {"sources": [*held, source]})


def stamp_generated(content: str, by: str, at: Any) -> str:
    return merge_frontmatter(content, {"generated": {"by": check_actor(by), "at": check_datetime(at)}})


def stamp_verified(content: str, by: str, at: Any) -> str:
    """content with one more verification, unless the same actor's of the same moment is there."""
    event = {"by": check_actor(by), "at": check_datetime(at)}
    held = frontmatter.parse(content).frontmatter.get("verified") or []
    held = [held] if isinstance(held, dict) else held
    if not isinstance(held, list) or not all(isinstance(v, dict) for v in held):
        raise PlanningError("verified is not a list of events")
    if any(v.get("by") == by and _moment(v.get("at")) == event["at"] for v in held):
        return content
    return merge_frontmatter(content, {"verified": [*held, event]})


def _moment(value: Any) -> dt.datetime | None:
    """YAML reads an offset as UTC without a zone."""
    if isinstance(value, str):
        value = check_datetime(value)
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    return None


def stamp_status(content: str, status: str) -> str:
    if status not in STATUSES:
        raise PlanningError(f"status must be one of {', '.join(STATUSES)}")
    return merge_frontmatter(content, {"status": status})


def stamp_stale_after(content: str, date: Any) -> str:
    return merge_frontmatter(content, {"stale_after": check_date(date)})


def move_links(content: str, old_path: str, new_path: str) -> str:
    """A document's own relative links, so that they lead to the same places from its new folder; links to itself follow."""
    _, body = frontmatter.split(content)
    rewrites = {}
    for _, href, _ in markdown.links(body):
        target = paths.resolve(old_path, href)
        if target is None:
            continue
        new = paths.moved_href(href, new_path, new_path if target == old_path else target)
        if new != href:
            rewrites[href] = new
    return rewrite_links(content, rewrites) if rewrites else content
