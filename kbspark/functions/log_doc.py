"""Log documents: a title, dated sections and labelled entries."""

from __future__ import annotations

import contextlib
import datetime as dt
import re
from dataclasses import dataclass, field

from . import markdown

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_LABEL = re.compile(r"\*\*((?:[^*\\]|\\.)+)\*\*:[ ]?|__((?:[^_\\]|\\.)+)__:[ ]?")


@dataclass(frozen=True)
class LogEntry:
    text: str
    label: str | None = None


@dataclass
class Log:
    title: str | None = None
    sections: list[tuple[str, list[LogEntry]]] = field(default_factory=list)
    problems: list[tuple[str | None, int, str]] = field(default_factory=list)


def _date_fault(day: str) -> str | None:
    """Why a section can't have this heading; None if it is a day of the calendar."""
    with contextlib.suppress(ValueError):
        if _DATE.fullmatch(day) and dt.date.fromisoformat(day):
            return None
    return f"section left out: no day of the form YYYY-MM-DD in {day!r}"


def parse(content: str) -> Log:
    """What isn't a dated list of entries is a problem inside a valid section, and ignored elsewhere."""
    log, state, entries = Log(), "preamble", []
    for block in markdown.parse(content)[0]:
        if block.kind == "heading" and block.level == 2:
            date = block.text.strip()
            problem = _date_fault(date)
            if problem:
                log.problems.append((date or None, block.line + 1, problem))
                state = "skipped"
            else:
                state, entries = "open", []
                log.sections.append((date, entries))
        elif state == "preamble":
            if block.kind == "heading" and block.level == 1 and log.title is None:
                log.title = block.text
        elif block.kind == "heading" and block.level == 1 or state == "open" and not (block.kind == "list" and block.marker == "bullet"):
            log.problems.append((log.sections[-1][0] if state == "open" else None, block.line + 1, f"skipped unexpected {block.kind}"))
        elif state == "open":
            for item in block.children:
                prose = [b.text for b in item.children if b.kind == "paragraph"]
                for b in item.children:
                    if b.kind != "paragraph":
                        log.problems.append((log.sections[-1][0], b.line + 1, f"skipped unexpected {b.kind} in an entry"))
                text = " ".join(" ".join(p.split("\n")) for p in prose).strip()
                label = None
                if (m := _LABEL.match(text)) and (m[1] or m[2]).strip():
                    label, text = (m[1] or m[2]).strip(), text[m.end() :].strip()
                if text:
                    entries.append(LogEntry(text, label))
                else:
                    log.problems.append((log.sections[-1][0], item.line + 1, "skipped malformed log entry: empty entry text"))
    return log


def render(log: Log) -> str:
    lines = [f"# {log.title}", ""] if log.title is not None else []
    for date, entries in log.sections:
        lines.append(f"## {date}")
        lines += [f"* **{e.label}**: {e.text}" if e.label else f"* {e.text}" for e in entries]
        lines.append("")
    return "\n".join(lines)


def append(content: str, entry: LogEntry, date: str | None = None) -> str:
    """content with entry first in its date's section (by default today's, UTC); sections from new to old.

    A log that can't be rendered back without loss is refused.
    """
    log = parse(content)
    if log.problems:
        raise ValueError(f"log can't be reconstructed: {log.problems[0][2]}")
    date = date or dt.datetime.now(dt.UTC).date().isoformat()
    if problem := _date_fault(date):
        raise ValueError(problem)
    for known, entries in log.sections:
        if known == date:
            entries.insert(0, entry)
            break
    else:
        log.sections.append((date, [entry]))
    log.sections.sort(key=lambda s: s[0], reverse=True)
    return render(log)


def move_entry(old_id: str, new_path: str) -> LogEntry:
    href = markdown.normalise_href(new_path)
    return LogEntry(f'[{markdown.escape_text(old_id)}]({href} "moved to")', "Moved")


def append_move(content: str, old_id: str, new_path: str, date: str | None = None) -> str:
    """Record a move once, whenever it was recorded."""
    entry = move_entry(old_id, new_path)
    if any(e == entry for _, entries in parse(content).sections for e in entries):
        return content
    return append(content, entry, date)
