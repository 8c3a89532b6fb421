"""Markdown, frontmatter, patches, logs and index documents."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.functions import frontmatter, index_doc, log_doc, markdown, patching, paths


def test_links():
    body = "[real](target.md) ![i](i.png) `[c](x.md)`\n\n```\n[f](f.md)\n```\n\n- [a](<b c.md> \"T\")\n- [ref][R]\n\n[r]: /ref.md 'title'\n\n> [q](q(1).md)\n\n\\[no](n.md) [*x* `y`](z.md)\n"
    assert markdown.links(body) == [("real", "target.md", None), ("a", "b%20c.md", "T"), ("ref", "/ref.md", "title"), ("q", "q(1).md", None), ("x y", "z.md", None)]


def test_prose():
    assert markdown.prose("See **[Alpha](a.md)** `no` ![n](n)\nnext\n\n    code\n\n<div>\nhtml\n</div>\n").split() == ["See", "Alpha", "next"]


def test_footnotes():
    assert markdown.footnotes("# T\n\nA claim.[^ga4-schema] `[^no]`\nB[^b]x\n\n[^ga4-schema]: The source text.\n") == [("ga4-schema", 3, False), ("ga4-schema", 6, True)]


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab*_`[]()<>!\\#-> \n&;1.", max_size=60))
def test_parser_never_fails_and_keeps_lines(body):
    blocks, refs = markdown.parse(body)
    for b in markdown.walk(blocks):
        assert 0 <= b.line <= b.end <= body.count("\n") + 1
    markdown.links(body), markdown.prose(body), markdown.footnotes(body)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab*_`[]()<>!\\& 1", min_size=1, max_size=20).map(lambda s: " ".join(s.split())).filter(bool))
def test_link_text_round_trip(title):
    assert markdown.links(markdown.render_link(title, "x.md")) == [(title, "x.md", None)]


SAMPLES = [
    "Title\n=====\n\nSub\n---\ntext\n",
    "* a\n* b\n\n\n+ c\n",
    "1. a\n\n   more\n2. b\n",
    "para\r\nnext\r\n\r\n# H #\r\n",
    "> quote\nlazy\n\n***\n",
    "    code\n\n~~~py\nx = `1`\n~~~",
    "- a\n  - b\n    - c\n- d\n",
    "[x][r] and [y](z.md)\n\n[r]: <a b.md> 'T'\n",
    "<div>\nraw\n</div>\n\ntext **bold** `c`",
    "| a | b |\n| - | - |\n| 1 | 2 |\n",
    "",
]


@pytest.mark.parametrize("sample", SAMPLES)
def test_canonical_form(sample):
    once = markdown.render(sample)
    assert markdown.render(once) == once
    assert markdown.links(once) == markdown.links(sample) and markdown.prose(once).split() == markdown.prose(sample).split()


def test_canonical_shape():
    assert markdown.render("Title\n=====\n* a\n* b\n\n~~~\nx\n~~~\n***\n") == "# Title\n\n- a\n- b\n\n```\nx\n```\n\n" + "_" * 70 + "\n"


def test_frontmatter():
    assert frontmatter.parse("no").body == "no" and frontmatter.parse("---\n---\nb").frontmatter == {}
    for bad in ("---\na: 1\n", "---\n- x\n---\n", "---\n1: x\n---\n", "---\na: 1\na: 2\n---\n", "---\na: [\n---\n"):
        with pytest.raises(frontmatter.DocumentParseError):
            frontmatter.parse(bad)
    assert frontmatter.parse("---\nb: &x {k: 1}\na:\n  <<: *x\n---\n").frontmatter["a"] == {"k": 1}


def test_merge_keeps_comments_and_order():
    content = "---\n# top\na: 1 # one\nb:\n  - x # in\n# above c\nc: yes\n---\nbody\n"
    assert patching.merge_frontmatter(content, {"b": ["y"], "d": None}) == "---\n# top\na: 1 # one\nb:\n- y\n# above c\nc: yes\nd: null\n---\nbody\n"
    assert patching.merge_frontmatter(content, {"a": 1, "c": True}) == content
    assert "a: 1.0\n" in patching.merge_frontmatter(content, {"a": 1.0})
    for bad in ({"a": float("inf")}, {"a": {1: 2}}, {"a": (1,)}):
        with pytest.raises(patching.PlanningError):
            patching.merge_frontmatter(content, bad)
    with pytest.raises(patching.PlanningError):
        patching.merge_frontmatter("---\na: &x [1]\nb: *x\n---\n", {"b": [2]})


def test_sections():
    content = "---\ntype: x\n---\n# T\n\nintro\n\n## See also\n\n- [a](a.md)\n\n## Next\n\nend\n"
    added = patching.append_section(content, "See also", 2, ["- [a](a.md)", "- [b](b.md)"])
    assert added == content.replace("- [a](a.md)\n", "- [a](a.md)\n- [b](b.md)\n")
    assert patching.append_section(added, "See also", 2, ["- [b](b.md)"]) == added
    assert patching.append_section("text", "New", 2, ["- [b](b.md)"]) == "text\n\n## New\n\n- [b](b.md)\n"
    assert patching.replace_section(content, "See also", 2, "fresh").count("fresh") == 1 and "a.md" not in patching.replace_section(content, "See also", 2, "fresh")
    assert patching.replace_section(content, "Next", 2, "end") == content
    for bad in (("Absent", 2, "x"), ("Next", 2, "# high")):
        with pytest.raises(patching.PlanningError):
            patching.replace_section(content, *bad)


def test_rewrites():
    body = "[a](x.md) `[a](x.md)` ![a](x.md) [b](<x.md> 't') [c](x%20y.md)\n\n```\n[a](x.md)\n```\n"
    assert patching.rewrite_links(body, {"x.md": "new (1).md", "x y.md": "z.md"}) == "[a](<new (1).md>) `[a](x.md)` ![a](x.md) [b](<new (1).md> 't') [c](z.md)\n\n```\n[a](x.md)\n```\n"
    with pytest.raises(patching.PlanningError):
        patching.rewrite_links("[a][r]\n\n[r]: x.md\n", {"x.md": "y.md"})
    assert patching.move_links("[s](a.md) [b](b.md#x) [r](/r.md)", "a.md", "sub/c.md") == "[s](c.md) [b](../b.md#x) [r](/r.md)"


def test_sources_and_stamps():
    content = "---\ntype: x\n---\nb\n"
    once = patching.upsert_source(content, {"resource": "r", "id": "i"})
    assert patching.upsert_source(once, {"resource": "other", "id": "i"}) == once
    assert len(frontmatter.parse(patching.upsert_source(once, {"resource": "r2"})).frontmatter["sources"]) == 2
    at = dt.datetime(2026, 1, 2, 3, tzinfo=dt.UTC)
    stamped = patching.stamp_verified(content, "human:a", at)
    assert patching.stamp_verified(stamped, "human:a", "2026-01-02T03:00:00Z") == stamped
    assert patching.stamp_verified(stamped, "tool/1.0", at) != stamped
    assert patching.stamp_status(content, "draft") == "---\ntype: x\nstatus: draft\n---\nb\n"
    assert "stale_after: 2026-05-01\n" in patching.stamp_stale_after(content, "2026-05-01")
    for f in (lambda: patching.stamp_generated(content, "nobody", at), lambda: patching.stamp_generated(content, "human:a", dt.datetime(2026, 1, 1)), lambda: patching.stamp_status(content, "odd"), lambda: patching.stamp_stale_after(content, at), lambda: patching.upsert_source(content, {"id": "x"})):
        with pytest.raises(patching.PlanningError):
            f()


def test_log():
    log = "# Log\n\npre\n\n## 2026-02-01\n* **Update**: one [x](y.md)\n* two\n\n## 2026-13-01\n* lost\n\n## 2026-01-01\n- three\n  more\n\nstray\n"
    parsed = log_doc.parse(log)
    assert parsed.title == "Log" and [(d, [(e.label, e.text) for e in es]) for d, es in parsed.sections] == [("2026-02-01", [("Update", "one [x](y.md)"), (None, "two")]), ("2026-01-01", [(None, "three more")])]
    assert len(parsed.problems) == 2
    good = "# Log\n\n## 2026-01-01\n* a\n"
    added = log_doc.append(good, log_doc.LogEntry("b", "New"), "2026-03-01")
    assert added == "# Log\n\n## 2026-03-01\n* **New**: b\n\n## 2026-01-01\n* a\n"
    moved = log_doc.append_move(good, "old", "new/x y.md", "2026-01-01")
    assert log_doc.append_move(moved, "old", "new/x y.md", "2026-09-01") == moved
    with pytest.raises(ValueError):
        log_doc.append(log, log_doc.LogEntry("x"), "2026-01-01")


def test_index():
    entries, problems = index_doc.parse("* [early](e.md)\n\n# One\n\n* [a](a.md) - text [l](l.md)\n* [b](b.md)\n* no link\n* x [c](c.md)\n* [d](d.md) tail\n* [](e.md)\n\n# Two\n\n* [f](f/)\n")
    assert [(e.heading, e.title, e.link, e.description) for e in entries] == [("One", "a", "a.md", "text [l](l.md)"), ("One", "b", "b.md", None), ("Two", "f", "f/", None)]
    assert len(problems) == 4
    assert index_doc.heading_of("platform-implementation v2beta") == "Platform-Implementation V2Beta"


def test_paths():
    assert paths.id_to_path("a/b") == "a/b.md" and paths.path_to_id("v1.2.md") == "v1.2"
    for bad in ("", "a//b", "../a", "a\\b", "c:d", "/a", "v1.2"):
        with pytest.raises(paths.ConceptPathError):
            paths.id_to_path(bad)
    assert paths.moved_href("../x.md?q#f", "a/b.md", "c/new x.md") == "../c/new%20x.md?q#f" and paths.moved_href("/x.md", "a/b.md", "c.md") == "/c.md"
