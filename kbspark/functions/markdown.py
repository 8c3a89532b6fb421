"""A CommonMark subset: blocks with their source lines, inline tokens, and what the engine reads from them.

Known: ATX and Setext headings, paragraphs, fenced and indented code, HTML blocks, quotes, bullet and ordered lists, rules,
link reference definitions; code spans, emphasis, inline, reference and angle links, images, breaks, escapes, entities.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote


@dataclass
class Block:
    """kind: heading, paragraph, code, html, quote, list, item or rule. line and end are 0-based, end exclusive."""

    kind: str
    line: int
    end: int
    level: int = 0
    text: str = ""
    marker: str = ""
    sign: str = "-"
    children: list[Block] = field(default_factory=list)


@dataclass
class Inline:
    """kind: text, code, link, image, soft, hard or html."""

    kind: str
    text: str = ""
    href: str = ""
    title: str | None = None
    children: list[Inline] = field(default_factory=list)


References = dict[str, tuple[str, str | None]]

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^\n]*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|)$")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
_HTML_START = re.compile(r" {0,3}<(?:(?:script|pre|style|textarea)(?=[\s>]|$)|!--|\?|![A-Za-z]|!\[CDATA\[|/?(?:address|article|aside|base|blockquote|body|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))", re.I)


def _expand(line: str) -> str:
    """Leading tabs as spaces up to the next multiple of four."""
    out = ""
    for i, ch in enumerate(line):
        if ch == "\t":
            out += " " * (4 - len(out) % 4)
        elif ch == " ":
            out += " "
        else:
            return out + line[i:]
    return out


def parse(text: str) -> tuple[list[Block], References]:
    """The blocks of a document and its link reference definitions (the first of a label counts)."""
    references: References = {}
    lines = [(i, _expand(x)) for i, x in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))]
    if lines and not lines[-1][1]:
        lines.pop()
    return _blocks(lines, references), references


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if not line.strip() or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML_START.match(line):
        return True
    if (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
        return True
    item = _ITEM.match(line)
    return bool(item and item[4] and (item[2][0] in "-+*" or item[2][:-1] == "1"))


def _blocks(lines: list[tuple[int, str]], references: References) -> list[Block]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        at, line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            j = i
            while j < len(lines) and (not lines[j][1].strip() or _indent(lines[j][1]) >= 4):
                j += 1
            while not lines[j - 1][1].strip():
                j -= 1
            out.append(Block("code", at, lines[j - 1][0] + 1, text="\n".join(x[4:] for _, x in lines[i:j])))
            i = j
        elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
            close = re.compile(r" {0,3}" + re.escape(m[2][0]) + "{" + str(len(m[2])) + r",}[ \t]*$")
            j = next((k for k in range(i + 1, len(lines)) if close.match(lines[k][1])), len(lines))
            out.append(Block("code", at, lines[min(j, len(lines) - 1)][0] + 1, marker=m[3].strip(), text="\n".join(x for _, x in lines[i + 1 : j])))
            i = j + 1
        elif m := _ATX.match(line):
            text = m[2] or ""
            out.append(Block("heading", at, at + 1, len(m[1]), "" if set(text) == {"#"} else text.strip()))
            i += 1
        elif _RULE.match(line):
            out.append(Block("rule", at, at + 1))
            i += 1
        elif _QUOTE.match(line):
            j, inner = i, []
            while j < len(lines):
                if m := _QUOTE.match(lines[j][1]):
                    inner.append((lines[j][0], lines[j][1][m.end() :]))
                elif inner[-1][1].strip() and not _interrupts(lines[j][1]):
                    inner.append((lines[j][0], lines[j][1].lstrip(" ")))
                else:
                    break
                j += 1
            out.append(Block("quote", at, lines[j - 1][0] + 1, children=_blocks(inner, references)))
            i = j
        elif _ITEM.match(line):
            i = _list(lines, i, out, references)
        elif _HTML_START.match(line):
            ends = re.compile("-->" if "<!--" in line else r"</(?:script|pre|style|textarea)>" if re.match(r" *<(?:script|pre|style|textarea)", line, re.I) else r"\?>" if "<?" in line else r"^\s*$", re.I)
            j = i
            while j < len(lines) and not ends.search(lines[j][1]):
                j += 1
            if j < len(lines) and lines[j][1].strip():
                j += 1
            out.append(Block("html", at, lines[j - 1][0] + 1, text="\n".join(x for _, x in lines[i:j])))
            i = j
        else:
            j, level = i + 1, 0
            while j < len(lines):
                if m := _SETEXT.match(lines[j][1]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                if _interrupts(lines[j][1]):
                    break
                j += 1
            text = "\n".join(x.strip(" ") if k == j - 1 - i else x.lstrip(" ") for k, (_, x) in enumerate(lines[i:j]))
            used = 0
            while m := _DEFINITION.match(text, used):
                references.setdefault(_label(m[1]), (_unescape(m[2].strip("<>") if m[2].startswith("<") else m[2]), _unescape(m[3][1:-1]) if m[3] else None))
                used = m.end()
            skipped = text[:used].count("\n")
            text = text[used:]
            end = lines[j - 1][0] + 1
            if text.strip():
                out.append(Block("heading" if level else "paragraph", lines[i + skipped][0], end + bool(level), level, text.strip()))
            i = j + bool(level)
    return out


def _list(lines: list[tuple[int, str]], i: int, out: list[Block], references: References) -> int:
    first = _ITEM.match(lines[i][1])
    kind = first[2][-1]
    block = Block("list", lines[i][0], lines[i][0] + 1, marker="ordered" if first[2][0].isdigit() else "bullet")
    while i < len(lines):
        m = _ITEM.match(lines[i][1])
        if not m or m[2][-1] != kind or _RULE.match(lines[i][1]):
            break
        pad = len(m[3] or "")
        offset = len(m[1]) + len(m[2]) + (pad if 1 <= pad <= 4 and m[4] else 1)
        inner = [(lines[i][0], (" " * offset + lines[i][1][offset:])[offset:] if m[4] else "")]
        j, fenced = i + 1, bool(_FENCE.match(inner[0][1]))
        while j < len(lines):
            line = lines[j][1]
            if not line.strip():
                if j == i + 1 and not inner[0][1].strip():
                    break
                inner.append((lines[j][0], ""))
            elif _indent(line) >= offset:
                inner.append((lines[j][0], line[offset:]))
                if _FENCE.match(line[offset:]):
                    fenced = not fenced
            elif inner[-1][1].strip() and not fenced and not _interrupts(line) and not _ITEM.match(line):
                inner.append((lines[j][0], line.lstrip(" ")))
            else:
                break
            j += 1
        while len(inner) > 1 and not inner[-1][1].strip():
            inner.pop()
        block.children.append(Block("item", lines[i][0], inner[-1][0] + 1, marker=m[2], children=_blocks(inner, references)))
        block.end = inner[-1][0] + 1
        i = j
    out.append(block)
    return i


def walk(blocks: list[Block]) -> Iterator[Block]:
    for b in blocks:
        yield b
        yield from walk(b.children)


_PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_ESCAPED = re.compile(rf"\\([{_PUNCTUATION}])")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")


def _unescape(s: str) -> str:
    return re.sub(rf"{_ESCAPED.pattern}|({_ENTITY.pattern})", lambda m: m[1] if m[1] else html.unescape(m[2]), s)


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def normalise_href(href: str) -> str:
    """Characters outside the URL alphabet percent-encoded; escapes that are there stay."""
    parts = re.split(r"(%[0-9A-Fa-f]{2})", href)
    return "".join(p if k % 2 else quote(p, safe=";/?:@&=+$,-_.!~*'()#") for k, p in enumerate(parts))


def _allowed(href: str) -> bool:
    s = href.strip().lower()
    return not re.match(r"(?:vbscript|javascript|file|data):", s) or bool(re.match(r"data:image/(?:gif|png|jpeg|webp);", s))


_DESTINATION = re.compile(r"<((?:[^<>\n\\]|\\.)*)>|([^\s<\x00-\x1f][^\s\x00-\x1f]*)?")
_TITLE = re.compile(r"""\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))""", re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>|<([\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_TAG = re.compile(r"""<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z].*?)>""", re.S)


def _inline_target(s: str, at: int) -> tuple[str, str | None, int] | None:
    """What stands in parentheses after a link's text: destination, title and where it ends."""
    i = at + 1
    while i < len(s) and s[i].isspace():
        i += 1
    if i < len(s) and s[i] == "<":
        m = _DESTINATION.match(s, i)
        if not m or m[1] is None:
            return None
        href, i = m[1], m.end()
    else:
        depth, j = 0, i
        while j < len(s) and not s[j].isspace() and ord(s[j]) > 31:
            if s[j] == "\\" and j + 1 < len(s) and not s[j + 1].isspace():
                j += 2
                continue
            if s[j] == "(":
                depth += 1
            elif s[j] == ")":
                if not depth:
                    break
                depth -= 1
            j += 1
        if depth:
            return None
        href, i = s[i:j], j
    title = None
    if m := _TITLE.match(s, i):
        title, i = m[1][1:-1], m.end()
    while i < len(s) and s[i].isspace():
        i += 1
    if i >= len(s) or s[i] != ")":
        return None
    return _unescape(href), _unescape(title) if title is not None else None, i + 1


def inline(s: str, references: References | None = None) -> list[Inline]:
    """The tokens of a paragraph's or heading's text."""
    references = references or {}
    out: list[Inline | tuple] = []
    openers: list[list] = []  # [place in out, place in s, image, active]
    i, plain = 0, ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append(Inline("text", plain))
        plain = ""

    while i < len(s):
        ch = s[i]
        if ch == "\\" and i + 1 < len(s):
            if s[i + 1] == "\n":
                flush()
                out.append(Inline("hard"))
                i += 2
            elif m := _ESCAPED.match(s, i):
                plain += m[1]
                i += 2
            else:
                plain += ch
                i += 1
        elif ch == "`":
            run = re.compile("`+").match(s, i)[0]
            m = _CODE.match(s, i)
            if m and m[1] == run:
                flush()
                code = m[2].replace("\n", " ")
                out.append(Inline("code", code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code))
                i = m.end()
            else:
                plain += run
                i += len(run)
        elif ch == "<" and (m := _AUTO.match(s, i)):
            flush()
            href = m[1] or f"mailto:{m[2]}"
            out.append(Inline("link", href=normalise_href(href), children=[Inline("text", m[1] or m[2])]))
            i = m.end()
        elif ch == "<" and (m := _TAG.match(s, i)):
            flush()
            out.append(Inline("html", m[0]))
            i = m.end()
        elif ch == "&" and (m := _ENTITY.match(s, i)):
            plain += html.unescape(m[0])
            i = m.end()
        elif ch == "\n":
            hard = len(plain) - len(plain.rstrip(" ")) >= 2
            plain = plain.rstrip(" ")
            flush()
            out.append(Inline("hard" if hard else "soft"))
            i += 1
            while i < len(s) and s[i] == " ":
                i += 1
        elif ch == "[" or s.startswith("![", i):
            flush()
            wide = 1 + (ch == "!")
            openers.append([len(out), i + wide, ch == "!", True])
            out.append(Inline("text", s[i : i + wide]))
            i += wide
        elif ch == "]":
            flush()
            i = _close(s, i, out, openers, references)
        elif ch in "*_":
            flush()
            n = len(re.compile(re.escape(ch) + "+").match(s, i)[0])
            before, after = s[i - 1] if i else " ", s[i + n] if i + n < len(s) else " "
            odd = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not odd(after) or before.isspace() or odd(before))
            right = not before.isspace() and (not odd(before) or after.isspace() or odd(after))
            opens = left and (ch == "*" or not right or odd(before))
            closes = right and (ch == "*" or not left or odd(after))
            out.append((ch, n, opens, closes))
            i += n
        else:
            plain += ch
            i += 1
    flush()
    return _emphasis(out)


def _close(s: str, i: int, out: list, openers: list, references: References) -> int:
    if not openers:
        out.append(Inline("text", "]"))
        return i + 1
    place, start, image, active = openers.pop()
    if not active:
        out.append(Inline("text", "]"))
        return i + 1
    target, end = None, i + 1
    if s.startswith("(", i + 1) and (found := _inline_target(s, i + 1)):
        target, end = found[:2], found[2]
    else:
        m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, i + 1)
        label = m[1] if m and m[1].strip() else s[start:i]
        if _label(label) in references and (not m or m[1].strip() or m[1] == ""):
            target, end = references[_label(label)], m.end() if m else i + 1
    if target is None or not _allowed(target[0]):
        out.append(Inline("text", "]"))
        return i + 1
    children = _emphasis(out[place + 1 :])
    del out[place:]
    out.append(Inline("image" if image else "link", href=normalise_href(target[0]), title=target[1] or None, children=children))
    if not image:
        for o in openers:
            if not o[2]:
                o[3] = False
    return end


def _emphasis(items: list) -> list[Inline]:
    """Delimiter runs that pair off vanish; what is left of the others is text."""
    runs = [[k, *x] for k, x in enumerate(items) if isinstance(x, tuple)]
    k = 0
    while k < len(runs):
        closer = runs[k]
        if closer[4] and closer[2]:
            for opener in reversed(runs[:k]):
                both = opener[4] or closer[3]
                odd_sum = both and (opener[2] + closer[2]) % 3 == 0 and (opener[2] % 3 or closer[2] % 3)
                if opener[1] == closer[1] and opener[3] and opener[2] and not odd_sum:
                    used = 2 if opener[2] > 1 and closer[2] > 1 else 1
                    opener[2] -= used
                    closer[2] -= used
                    for between in runs[runs.index(opener) + 1 : k]:
                        between[3] = between[4] = False
                    break
            else:
                k += 1
                continue
            if closer[2]:
                continue
        k += 1
    left = {r[0]: r[1] * r[2] for r in runs}
    out: list[Inline] = []
    for k, x in enumerate(items):
        token = Inline("text", left[k]) if isinstance(x, tuple) else x
        if token.kind == "text" and not token.text:
            continue
        if token.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Inline("text", out[-1].text + token.text)
        else:
            out.append(token)
    return out


def texts(blocks: list[Block]) -> Iterator[Block]:
    """Blocks whose text is inline Markdown, in order."""
    return (b for b in walk(blocks) if b.kind in ("heading", "paragraph"))


def flat_text(tokens: list[Inline]) -> str:
    """Concatenated text and code, as in a link's text."""
    return "".join(t.text if t.kind in ("text", "code") else flat_text(t.children) if t.kind == "link" else "" for t in tokens)


def links(body: str) -> list[tuple[str, str, str | None]]:
    """Text, target and title of every link that isn't an image, in order."""
    blocks, references = parse(body)
    out: list[tuple[str, str, str | None]] = []

    def visit(tokens: list[Inline]) -> None:
        for t in tokens:
            if t.kind == "link":
                out.append((flat_text(t.children), t.href, t.title))

    for b in texts(blocks):
        visit(inline(b.text, references))
    return out


def prose(body: str) -> str:
    """Visible text: code and images as a space, breaks and block ends as a newline, link texts kept."""
    blocks, references = parse(body)
    parts: list[str] = []

    def visit(tokens: list[Inline]) -> None:
        for t in tokens:
            if t.kind == "text":
                parts.append(t.text)
            elif t.kind in ("code", "image"):
                parts.append(" ")
            elif t.kind in ("soft", "hard"):
                parts.append("\n")
            elif t.kind == "link":
                visit(t.children)

    for b in texts(blocks):
        visit(inline(b.text, references))
        parts.append("\n")
    return "".join(parts)


_FOOTNOTE = re.compile(r"\[\^([A-Za-z0-9-]+)\](?![A-Za-z0-9-])(:)?")
_LABEL = re.compile(r"\^([A-Za-z0-9-]+)\Z")


def footnotes(body: str) -> list[tuple[str, int, bool]]:
    """Label, 1-based line and whether it is a definition, for each footnote mark in text.

    Code and images are skipped. A mark that the link syntax took for a link's text counts too.
    """
    out: list[tuple[str, int, bool]] = []
    blocks, references = parse(body)
    for b in texts(blocks):
        line = b.line + 1
        joined = ""

        def scan() -> None:
            for m in _FOOTNOTE.finditer(joined):
                out.append((m[1], line, m[2] is not None))

        for t in inline(b.text, references):
            if t.kind == "text":
                joined += t.text
                continue
            scan()
            joined = ""
            if t.kind == "link" and (m := _LABEL.match(flat_text(t.children))):
                out.append((m[1], line, False))
            elif t.kind == "link":
                joined = flat_text([c for c in t.children if c.kind == "text"])
                scan()
                joined = ""
            line += t.kind in ("soft", "hard")
        scan()
    return out


def escape_text(s: str) -> str:
    """Plain text as Markdown that reads back as itself inside a link's text."""
    return re.sub(r"([\\`*_\[\]<&])", r"\\\1", s)


def render_link(text: str, href: str) -> str:
    return f"[{escape_text(text)}]({'<' + href + '>' if re.search(r'[\s()]', href) else href})"


def render(body: str) -> str:
    """A document in one canonical shape: ATX headings, dashes for bullets, fences for code, one blank line between blocks.

    Inline text stays as it is written; link reference definitions come last. Rendering twice changes nothing more.
    """
    blocks, references = parse(body)
    lines = _rendered(blocks)
    if references:
        lines += [""] if lines else []
        lines += [f"[{label}]: {'<' + href + '>' if not href or re.search(r'[\s()<]', href) else href}" + (f' "{title}"' if title and '"' not in title else f" ({title})" if title else "") for label, (href, title) in sorted(references.items())]
    return "\n".join(lines) + "\n" if lines else ""


def _loose(block: Block) -> bool:
    """Whether blank lines part the items of a list or the blocks of one."""
    rows = [block.children, *(item.children for item in block.children)]
    return any(b.line > a.end for blocks in rows for a, b in zip(blocks, blocks[1:], strict=False))


def _rendered(blocks: list[Block], tight: bool = False) -> list[str]:
    out: list[str] = []
    last = None
    for b in blocks:
        if out and not tight:
            out.append("")
        if b.kind == "heading":
            out.append(("#" * b.level + " " + " ".join(b.text.split("\n"))).rstrip())
        elif b.kind == "code":
            fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", b.text)), default=0))
            out += [fence + b.marker.replace("`", ""), *(b.text.split("\n") if b.text else []), fence]
        elif b.kind == "rule":
            out.append("_" * 70)
        elif b.kind == "quote":
            out += [f"> {x}".rstrip() for x in _rendered(b.children)] or [">"]
        elif b.kind == "list":
            bullet = "*" if last is not None and last.kind == "list" and last.marker == b.marker == "bullet" and last.sign == "-" else "-"
            b.sign = bullet
            loose, first = _loose(b), True
            for n, item in enumerate(b.children):
                if loose and not first:
                    out.append("")
                first = False
                start = int(b.children[0].marker[:-1]) if b.marker == "ordered" else 0
                mark = f"{start + n}{item.marker[-1]}" if b.marker == "ordered" else bullet
                inner = _rendered(item.children, not loose)
                out.append(f"{mark} {inner[0]}".rstrip() if inner else mark)
                out += [" " * (len(mark) + 1) + x if x else "" for x in inner[1:]]
        else:
            out += b.text.split("\n")
        last = b
    return out
