"""Scan, graph, search, context, validation and the command line on small bundles."""

import hashlib
import json
import re
import sqlite3
import unicodedata
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.cli import main
from kbspark.config import Bundle, ConfigError, Profile, Taxonomy, load
from kbspark.functions import text
from kbspark.operators import context, documents, links, listing, mentions, search, validate, writes
from kbspark.sources import bundle as scan
from kbspark.sources import cache, phases
from kbspark.streaming.refresh import stream


def write(root, files):
    for name, content in files.items():
        path = Path(root) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def doc(body, title="Stem", extra=""):
    return f"---\ntype: concept\ntitle: {title}\n{extra}---\n{body}"


def test_scan(spark, tmp_path):
    write(tmp_path, {"a.md": doc("x\n"), "sub/b.md": doc("y\n", extra="when: 2026-01-01\nid: ' k '\n"), "index.md": "# I", "sub/LOG.md": "z", "bad.md": "---\na: [\n---\n", "raw.md": b"\xff", "open.md": "---\na: 1\n", "c.txt": "n", "dup.md": "---\na: 1\na: 2\n---\n", "twin.md": doc("t", extra="id: k\n")})
    found = scan.scan(spark, Bundle("b", str(tmp_path), stable_id_field="id"))
    rows = {r.concept_id: r for r in found.concepts.collect()}
    assert set(rows) == {"a", "sub/b", "twin"}
    assert rows["sub/b"].body == "y\n" and json.loads(rows["sub/b"].frontmatter)["when"] == "2026-01-01" and rows["sub/b"].stable_id == "k"
    assert {(r.rel_path, r.kind) for r in found.problems.collect()} == {("bad.md", "parse-error"), ("raw.md", "decode-error"), ("open.md", "parse-error"), ("dup.md", "parse-error"), ("a.md", "stable-id-missing"), ("sub/b.md", "stable-id-conflict"), ("twin.md", "stable-id-conflict")}
    assert scan.scan(spark, Bundle("none", str(tmp_path / "missing"))).concepts.count() == 0


def test_exclude_counts_from_the_right(spark):
    paths = spark.createDataFrame([("drafts/x.md",), ("a/drafts/x.md",), ("drafts/a/b.md",), ("x.md",)], "rel_path string")
    kept = paths.where(scan.chosen(F.col("rel_path"), Bundle("b", "/", exclude=("drafts/**",))))
    assert {r.rel_path for r in kept.collect()} == {"drafts/a/b.md", "x.md"}


def test_graph(spark, tmp_path):
    write(tmp_path, {"topics/a.md": doc("[b](./b.md) [r](../root.md) [s](/root.md#intro) [e](old%20file.md)\n[n](bad%00name.md) [f](foo%2Fbar.md)"), "topics/b.md": doc("[c](c.md) [out](../../outside.md) [i](../../index.md) [in](/index.md) [l](log.md) [w](https://x.md) [h](#x)"), "topics/old file.md": doc("."), "root.md": doc("[self](root.md)")})
    found = scan.scan(spark, Bundle("b", str(tmp_path)))
    graph = links.build(found.concepts)
    assert {(r.source_concept_id, r.target_concept_id) for r in graph.links.collect()} == {("topics/a", "topics/b"), ("topics/a", "root"), ("topics/a", "topics/old file"), ("root", "root")}
    assert graph.links.count() == 5
    assert {(r.target_concept_id, r.target_path) for r in graph.broken.collect()} == {("topics/c", "topics/c.md"), (None, "../outside.md"), (None, "../index.md")}
    near = lambda s, d: [r.concept_id for r in links.neighborhood(found.concepts, graph.links, s, d).orderBy("concept_id").collect()]
    assert near("topics/b", 0) == ["topics/b"] and near("topics/b", 2) == ["root", "topics/a", "topics/b", "topics/old file"]
    with pytest.raises(ValueError):
        links.neighborhood(found.concepts, graph.links, "nope", 1)


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "concept_id string")
    edges = lambda *e: spark.createDataFrame([tuple(x) for x in e], "source_concept_id string, target_concept_id string")
    ring = {r.concept_id: r.pagerank for r in links.pagerank(nodes.where("concept_id < 'd'"), edges("ab", "bc", "ca")).collect()}
    assert all(abs(v - 1 / 3) < 1e-5 for v in ring.values())
    ranks = {r.concept_id: r.pagerank for r in links.pagerank(nodes, edges("ab", "ab", "ac", "bx")).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] > ranks["c"] > ranks["d"] > 0
    assert [r.concept_id for r in links.orphans(nodes, edges("ab", "ac")).collect()] == ["d"]
    counts = {r.concept_id: (r.outbound, r.inbound) for r in links.degrees(nodes, edges("ab", "ab", "aa")).collect()}
    assert counts == {"a": (3, 1), "b": (0, 2), "c": (0, 0), "d": (0, 0)}


def test_pagerank_of_packed_links(spark, monkeypatch):
    """Links packed over several blocks, lots, files and rows give the ranks of plain rounds."""
    import numpy as np

    rng = np.random.default_rng(3)
    ends = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 50, (600, 2))] + [("n0", f"n{b}") for b in range(40)] + [("n1", "n2")] * 7 + [("n3", "out")]
    ends = [(a, b) for a, b in ends if a != "n9"]
    ids = [f"n{i}" for i in range(53)]
    place = {x: i for i, x in enumerate(ids)}
    m = np.zeros((53, 53))
    for a, b in ends:
        if b in place:
            m[place[b], place[a]] += 1
    outs = m.sum(axis=0)
    ranks = np.full(53, 1 / 53)
    for _ in range(100):
        old, sunk = ranks, ranks[outs == 0].sum()
        ranks = 0.15 / 53 + 0.85 * (m @ np.where(outs > 0, ranks / np.maximum(outs, 1), 0) + sunk / 53)
        if np.abs(ranks - old).sum() < 1e-6:
            break
    monkeypatch.setattr(links, "FILE_LINKS", 100)
    monkeypatch.setattr(links, "PACKED", 40)
    nodes = spark.createDataFrame([(x,) for x in ids], "concept_id string")
    edges = spark.createDataFrame(ends, "source_concept_id string, target_concept_id string")
    for block, lot in ((1 << 16, 128), (10, 2)):
        found = {r.concept_id: r.pagerank for r in links.pagerank(nodes, edges, block=block, lot=lot).collect()}
        assert set(found) == set(ids) and max(abs(found[x] - ranks[place[x]]) for x in ids) < 1e-12


VOCABULARY = ["alpha", "Beta", "café", "gamma.", "delta:", "the", "x_y", "zeta"]


def test_search_agrees_with_fts5(spark):
    import random

    r = random.Random(7)
    rows = [(f"c{i:02}", " ".join(r.choices(VOCABULARY, k=2)), r.choice(["", "alpha note"]), "", " ".join(r.choices(VOCABULARY, k=r.randint(0, 60)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, description, fields, body, tokenize='unicode61')")
    db.executemany("INSERT INTO f VALUES (?,?,?,?,?)", rows)
    docs = spark.createDataFrame(rows, "concept_id string, title string, description string, fields string, body string").cache()
    for q in ("alpha", "cafe zeta", "x_y", "alpha alpha gamma"):
        match = " AND ".join(f'"{w}"' for w in re.findall(r"\w+", q))
        wanted = db.execute("SELECT id, bm25(f), snippet(f, -1, '[', ']', '...', 16) FROM f WHERE f MATCH ? ORDER BY rank, id", (match,)).fetchall()
        found = search.search(docs, q, 100).collect()
        assert [x.concept_id for x in found] == [w[0] for w in wanted], q
        assert all(abs(x.score - w[1]) <= 1e-9 * max(1, abs(w[1])) for x, w in zip(found, wanted))
        if "_" not in q:
            assert [x.snippet for x in found] == [w[2] for w in wanted], q
    assert search.search(docs, "!?", 5).count() == 0 and search.search(docs, "alpha", 0).count() == 0
    with pytest.raises(ValueError):
        search.search(docs, "alpha", -1)


def test_letters_fold_as_fts5_folds_them():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    letters = [c for c in map(chr, [*range(0xC0, 0x370), *range(0x370, 0x528), *range(0x1E00, 0x2000)]) if c.isalpha() and unicodedata.category(c) != "Lm" and c not in "\u037f"]
    for c in letters:
        db.execute("DELETE FROM f")
        db.execute("INSERT INTO f VALUES (?)", (f"x{c}y",))
        assert [r[0] for r in db.execute("SELECT term FROM v")] == [f"x{text.fold(c)}y"], (c, hex(ord(c)))
    for mark in map(chr, range(0x300, 0x340)):
        db.execute("DELETE FROM f")
        db.execute("INSERT INTO f VALUES (?)", (f"x{mark}y",))
        assert ([r[0] for r in db.execute("SELECT term FROM v")] == ["xy"]) == (mark in text.MARKS)


def test_folded_search_agrees_with_fts5(spark):
    rows = [("a", "", "", "", "Čaj a káva"), ("b", "", "", "", "cafe\u0301 ΣΊΣΥΦΟΣ"), ("c", "ſtraße", "", "", "ÉCOLE caj ệ"), ("d", "", "", "", "İstanbul c\u030caj, x.")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, description, fields, body, tokenize='unicode61')")
    db.executemany("INSERT INTO f VALUES (?,?,?,?,?)", rows)
    docs = spark.createDataFrame(rows, "concept_id string, title string, description string, fields string, body string")
    for q in ("caj", "čaj", "CAFÉ", "straße", "école", "istanbul", "ệ", "σίσυφος"):
        match = " AND ".join(f'"{w}"' for w in re.findall(r"\w+", q))
        wanted = {i: (round(score, 9), cut) for i, score, cut in db.execute("SELECT id, bm25(f), snippet(f, -1, '[', ']', '...', 16) FROM f WHERE f MATCH ?", (match,))}
        assert {r.concept_id: (round(r.score, 9), r.snippet) for r in search.search(docs, q).collect()} == wanted and wanted, q


def test_fields_are_flattened_depth_first(spark):
    value = {"b": [1, None, {"z": True, "a": "line\none"}], "a": None, "c": 1.5}
    assert text.flat(value) == ["a", "b", "1", "a", "line\none", "z", "True", "c", "1.5"]
    rows = spark.createDataFrame([({"tags": '["x","y"]', "n": "null", "at": '{"k":{"d":1}}'},), (None,), ({},)], "fields map<string,string>")
    assert [r[0] for r in rows.select(search.fields_text(F.col("fields"))).collect()] == ["at\nk\nd\n1\nn\ntags\nx\ny", "", ""]


def test_stored_index(spark, tmp_path, monkeypatch):
    schema = "concept_id string, title string, description string, fields string, body string"
    rows = {"a": ("Same", "", "", "one two x_y one"), "b": ("Same", None, "", "one three one"), "c": ("", "", "", "")}
    path, queries = str(tmp_path / "index"), ("one", "same three", "two three", "", "x_y", "one_two", "one one", "gone")

    def agree():
        docs = spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)
        search.refresh_index(docs, path)
        for q in queries:
            wanted = {r.concept_id: round(r.score, 9) for r in search.bm25(docs, q).collect()}
            assert {r.concept_id: round(r.score, 9) for r in search.search_index(spark, path, q).collect()} == wanted, q

    agree()
    segments = {p.name for p in (tmp_path / "index/postings").iterdir()}
    agree()
    assert {p.name for p in (tmp_path / "index/postings").iterdir()} == segments  # nothing changed
    rows |= {"b": ("Same", "", "", "two one three"), "d": ("New", "one", "", "three")}
    del rows["a"]
    agree()
    monkeypatch.setattr(search, "MOST_SEGMENTS", 2)
    rows["e"] = ("e", "", "", "one two one_two")
    agree()
    assert cache.load(spark, f"{path}/documents").select("segment").distinct().count() == 1
    with pytest.raises(search.SearchConfigError):
        search.search_index(spark, str(tmp_path / "none"), "one")


def test_context(spark):
    concepts = spark.createDataFrame([("a", "x" * 10), ("b", "x" * 50), ("c", "x"), ("d", "")], "concept_id string, content string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a")], "source_concept_id string, target_concept_id string")
    pack = lambda **k: [(r.concept_id, r.reason, r.status) for r in context.pack(concepts, edges, ["a", "zz", "a"], **k).orderBy("position").collect()]
    assert pack(direction="outbound", budget=59) == [("a", "seed", "entry"), ("b", "outbound-link", "omitted"), ("c", "outbound-link", "omitted")]
    assert pack(depth=1) == [("a", "seed", "entry"), ("b", "outbound-link", "entry"), ("c", "outbound-link", "entry"), ("d", "backlink", "entry")]
    assert pack(depth=0) == [("a", "seed", "entry")]
    for bad in ({"depth": -1}, {"budget": -1}, {"direction": "up"}):
        with pytest.raises(ValueError):
            context.pack(concepts, edges, ["a"], **bad)


def test_mentions(spark):
    rows = [("alpha", "alpha.md", "Alpha", "Alpha itself"), ("beta", "b.md", "Beta", "See Alpha"), ("linked", "l.md", "Linked", "[Alpha](alpha.md)"), ("code", "c.md", "Code", "`Alpha` and [x](alpha.md)"), ("foobar", "f.md", "FooBar", "Foo`x`Bar"), ("split", "s.md", "Two Words", "words here, two there")]
    concepts = spark.createDataFrame(rows, "concept_id string, rel_path string, title string, body string")
    found = mentions.unlinked_mentions(concepts, mentions.visible_prose(concepts), links.extract(concepts))
    assert {(r.source_concept_id, r.target_concept_id) for r in found.collect()} == {("beta", "alpha")}


def test_validation(spark):
    rows = [("ok", '{"type":"concept","title":"T","status":"x"}'), ("none", "{}"), ("blank", '{"type":" ","title":null,"status":" "}'), ("odd", '{"type":"other","title":1,"status":"s","more":1}')]
    concepts = spark.createDataFrame([(i, f, "") for i, f in rows], "concept_id string, frontmatter string, body string")
    profile = Profile(required=("type", "title", "status"), taxonomy=Taxonomy(known_types=("concept", "decision")))
    found = {(r.concept_id, r.severity, r.field) for r in validate.documents(concepts, profile).collect()}
    assert found == {("none", "error", "type"), ("none", "error", "title"), ("none", "error", "status"), ("blank", "error", "type"), ("blank", "error", "title"), ("blank", "error", "status"), ("odd", "warning", "type"), ("odd", "warning", "more")}


def test_listing(spark):
    rows = [("a", '{"type":" t ","title":"x\\r\\ny ","n":0,"flag":false,"a-b.c":[1]}'), ("b", '{"type":["t"]}')]
    concepts = spark.createDataFrame([(i, f"{i}.md", f, "body") for i, f in rows], "concept_id string, rel_path string, frontmatter string, body string")
    row = listing.list_concepts(concepts, ("n", "gone", "flag", "a-b.c")).collect()
    assert len(row) == 1 and row[0].type == "t" and row[0].title == "x y" and row[0].fields == {"n": "0", "flag": "false", "a-b.c": "[1]"}
    assert [r.concept_id for r in listing.missing_type(concepts).collect()] == ["b"]


def test_incremental_scan(spark, tmp_path):
    write(tmp_path / "docs", {"a.md": doc("one"), "b.md": doc("two")})
    bundle = Bundle("b", str(tmp_path / "docs"), cache_dir=str(tmp_path / "cache"))
    assert cache.refresh(spark, bundle).concepts.count() == 2
    write(tmp_path / "docs", {"a.md": doc("longer text"), "c.md": doc("three")})
    (tmp_path / "docs/b.md").unlink()
    found = {r.concept_id: r.body for r in cache.refresh(spark, bundle).concepts.collect()}
    assert found == {"a": "longer text", "c": "three"}


def test_warm_scans_find_what_cold_ones_do(spark, tmp_path, monkeypatch):
    with_id = lambda i, body="x": f"---\ntype: t\nsid: {i}\n---\n{body}"
    write(tmp_path / "docs", {"a.md": with_id("one"), "b.md": with_id("one"), "c.md": with_id("''"), "d [1].md": with_id("four"), "bad.md": "---\n"})
    warm = Bundle("b", str(tmp_path / "docs"), cache_dir=str(tmp_path / "cache"), stable_id_field="sid")

    def same():
        found, cold = cache.refresh(spark, warm), scan.scan(spark, Bundle("b", str(tmp_path / "docs"), stable_id_field="sid"))
        assert sorted(map(tuple, found.problems.collect())) == sorted(map(tuple, cold.problems.collect()))
        assert sorted((r.concept_id, r.body, r.stable_id or "") for r in found.concepts.collect()) == sorted((r.concept_id, r.body, r.stable_id or "") for r in cold.concepts.collect())
        return {(r.rel_path, r.kind) for r in found.problems.collect()}

    first = {("a.md", "stable-id-conflict"), ("b.md", "stable-id-conflict"), ("c.md", "stable-id-missing"), ("bad.md", "parse-error")}
    assert same() == first and same() == first
    write(tmp_path / "docs", {"e.md": with_id("four")})
    assert same() == first | {("d [1].md", "stable-id-conflict"), ("e.md", "stable-id-conflict")}
    assert [tuple(r) for r in scan.stable_id_members(cache.refresh(spark, warm).concepts).collect()] == [("four", "d [1].md"), ("four", "e.md"), ("one", "a.md"), ("one", "b.md")]
    opened = []
    real = cache.read_files
    monkeypatch.setattr(cache, "read_files", lambda *a, **k: opened.append(k.get("only")) or real(*a, **k))
    write(tmp_path / "docs", {"d [1].md": with_id("five", "longer")})
    same()
    assert opened == [None, ["bad.md", "d [1].md"]] or opened == [None, ["d [1].md", "bad.md"]]
    (tmp_path / "docs/a.md").unlink()
    (tmp_path / "docs/bad.md").write_text(with_id("six"))
    assert same() == {("c.md", "stable-id-missing")}


def test_config(tmp_path):
    (tmp_path / "bundles.toml").write_text('[defaults]\nlisting_fields = ["owner"]\n[profiles.p]\nrequired = ["title"]\n[bundles.one]\nroot = "docs"\nprofile = "p"\n[bundles.two]\nroot = "/x"\nlisting_fields = []\n')
    found = load(tmp_path / "bundles.toml", {"stable_id_field": "id"})
    assert found["one"].root == str(tmp_path / "docs") and found["one"].profile.required == ("title",) and found["one"].listing_fields == ("owner",)
    assert found["two"].listing_fields == () and found["two"].stable_id_field == "id"
    for bad in ("[bundles.x]\n", '[bundles.x]\nroot="."\nnope=1\n', '[bundles.x]\nroot="."\nprofile="q"\n', '[bundles.x]\nroot="."\nversion="9.9"\n'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ConfigError):
            load(tmp_path / "bad.toml")


def run(capsys, spark, root, *args):
    code = main(["--config", str(root / "bundles.toml"), *args], spark)
    out = capsys.readouterr().out
    return code, json.loads(out) if out.strip().startswith(("{", "[")) else out


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path, {"bundles.toml": '[bundles.kb]\nroot = "docs"\ncache_dir = "cache"\n', "docs/a.md": doc("About [b](sub/b.md) and Gamma.\n", "Alpha"), "docs/sub/b.md": doc("Back to [a](../a.md).\n", "Beta"), "docs/c.md": doc("[gone](dead.md)\n", "Gamma")})
    assert run(capsys, spark, tmp_path, "scan")[0] == 0
    code, out = run(capsys, spark, tmp_path, "graph")
    assert code == 0 and len(out["links"]) == 2 and len(out["broken_links"]) == 1
    assert [r["concept_id"] for r in run(capsys, spark, tmp_path, "search", "gamma")[1]["results"]] == ["c", "a"]
    assert run(capsys, spark, tmp_path, "context", "--seed", "a", "--seed", "x")[0] == 1
    assert [s["target_concept_id"] for s in run(capsys, spark, tmp_path, "unlinked-mentions", "--apply")[1]["suggestions"]] == ["c"]
    assert "## See also\n\n- [Gamma](c.md)\n" in (tmp_path / "docs/a.md").read_text()
    code, out = run(capsys, spark, tmp_path, "move", "a", "sub/deep/a2")
    assert code == 0 and "[b](../b.md)" in (tmp_path / "docs/sub/deep/a2.md").read_text() and "[a](deep/a2.md)" in (tmp_path / "docs/sub/b.md").read_text()
    assert run(capsys, spark, tmp_path, "stamp-status", "c.md", "--status", "stable")[0] == 0 and "status: stable" in (tmp_path / "docs/c.md").read_text()
    assert run(capsys, spark, tmp_path, "stamp-status", "c.md", "--status", "odd")[0] == 1
    assert run(capsys, spark, tmp_path, "log-append", "made it", "--kind", "Creation", "--date", "2026-01-02")[0] == 0
    assert (tmp_path / "docs/log.md").read_text() == "## 2026-01-02\n* **Creation**: made it\n"
    assert run(capsys, spark, tmp_path, "index")[0] == 0 and "* [Gamma](c.md)" in (tmp_path / "docs/index.md").read_text()
    code, out = run(capsys, spark, tmp_path, "validate")
    assert code == 0 and out["index_drift"] == []
    assert run(capsys, spark, tmp_path, "graph", "--concept", "nope")[0] == 2
    assert run(capsys, spark, tmp_path, "list-bundles")[1][0]["name"] == "kb" and run(capsys, spark, tmp_path, "orient")[0] == 0


def test_indexes_and_moves_of_the_command_line(spark, tmp_path, capsys):
    write(tmp_path, {"bundles.toml": '[bundles.kb]\nroot = "docs"\n', "docs/index.md": '---\nformat_version: "0.1"\n---\nold\n', "docs/a.md": doc("x", "Alpha"), "docs/sub/b.md": doc("[me](b.md) [a](../a.md)", "Beta"), "docs/sub/_directory.yml": "title: Below\ndescription: what is\n  below\n", "docs/other/c.md": doc("y", "Gamma")})
    code, out = run(capsys, spark, tmp_path, "index", "--dry-run")
    assert code == 0 and {x["status"] for x in out["indexes"]} == {"planned"} and (tmp_path / "docs/index.md").read_text().endswith("old\n")
    code, out = run(capsys, spark, tmp_path, "index")
    assert code == 0 and {x["status"] for x in out["indexes"]} == {"written"} and out["excluded_reserved_files"] == [{"dir": "", "filename": "index.md"}]
    root = (tmp_path / "docs/index.md").read_text()
    assert root.startswith('---\nformat_version: "0.1"\n---\n') and "[Below](sub/) - what is below" in root
    assert run(capsys, spark, tmp_path, "validate")[1]["index_drift"] == []
    (tmp_path / "docs/other/index.md").unlink()
    code, out = run(capsys, spark, tmp_path, "move", "sub/b", "other/b")
    assert code == 0 and out["moved"] == "moved" and (tmp_path / "docs/other/b.md").read_text().endswith("[me](b.md) [a](../a.md)")
    assert not (tmp_path / "docs/other/index.md").exists()
    code, out = run(capsys, spark, tmp_path, "move", "a", "sub/a")
    assert code == 0 and [x["rel_path"] for x in out["indexes"]] and "Alpha" not in (tmp_path / "docs/index.md").read_text() and "[Alpha](a.md)" in (tmp_path / "docs/sub/index.md").read_text()
    assert "[a](../sub/a.md)" in (tmp_path / "docs/other/b.md").read_text()
    assert run(capsys, spark, tmp_path, "index", "--force")[0] == 0 and not (tmp_path / "docs/index.md").read_text().startswith("---")
    (tmp_path / "docs/index.md").write_text('---\nformat_version: "9.0"\n---\n')
    assert run(capsys, spark, tmp_path, "index")[0] == 2
    code, out = run(capsys, spark, tmp_path, "graph", "--output", str(tmp_path / "out"))
    assert code == 0 and spark.read.json(out["links"]).count() == 2


def test_links_and_ranks_are_kept(spark, tmp_path, capsys, monkeypatch):
    """Only changed concepts are searched for links, those without links too; phases are watched."""
    write(tmp_path, {"bundles.toml": '[bundles.kb]\nroot = "docs"\ncache_dir = "cache"\n', "docs/a.md": doc("[b](b.md)", "A"), "docs/b.md": doc("none", "B")})
    asked, told = [], []
    real = links.extract
    monkeypatch.setattr(links, "extract", lambda c, reserved: asked.append(sorted(r.concept_id for r in c.collect())) or real(c, reserved))
    watcher = type("W", (), {"started": lambda self, *a: told.append(("started", a[0])), "ended": lambda self, *a: told.append(("ended", a[0])), "failed": lambda self, *a: told.append(("failed", a[0]))})()
    with phases.watching(watcher):
        for _ in range(2):
            assert len(run(capsys, spark, tmp_path, "graph")[1]["links"]) == 1
        assert asked == [["a", "b"]] and told == [(x, p) for _ in range(2) for p in ("scan", "graph") for x in ("started", "ended")]
        write(tmp_path, {"docs/c.md": doc("[a](a.md)", "C")})
        (tmp_path / "docs/b.md").unlink()
        out = run(capsys, spark, tmp_path, "list-concepts", "--with-graph-counts")[1]
    assert asked[1:] == [["c"]] and {c["concept_id"]: (c["outbound"], c["inbound"]) for c in out["concepts"]} == {"a": (0, 1), "c": (1, 0)}
    assert {r.concept_id: r.pagerank for r in cache.load(spark, str(tmp_path / "cache/ranks")).collect()} == {c["concept_id"]: c["pagerank"] for c in out["concepts"]}


def test_new_files_are_made_only_where_none_is(spark, tmp_path):
    write(tmp_path, {"there.md": "x"})
    files = spark.createDataFrame([("new.md", None, "n"), ("there.md", None, "n"), ("no/such.md", None, "n")], "rel_path string, content string, proposed string")
    assert {r.rel_path: r.status for r in writes.apply(writes.plan_contents(files), str(tmp_path)).collect()} == {"new.md": "written", "there.md": "conflict", "no/such.md": "missing"}
    assert (tmp_path / "new.md").read_text() == "n" and (tmp_path / "there.md").read_text() == "x"
    write(tmp_path, {"index.md": '---\nformat_version: "9.0"\n---\n'})
    with pytest.raises(writes.UnsafeBundle):
        writes.apply(writes.plan_contents(files), str(tmp_path))


def test_folders_may_be_described_by_a_function(spark):
    listed = spark.createDataFrame([("a/b/c", "a/b/c.md", "t", "C", None), ("d/e", "d/e.md", "t", "E", None)], "concept_id string, rel_path string, type string, title string, description string")
    told = spark.createDataFrame([("d", "Dee", "its own")], "dir string, title string, description string")
    found = documents.generate_entries(listed, told, lambda d: f"about\n{d} " if d != "a/b" else None).where("heading = 'Subdirectories'").collect()
    assert {(r.link, r.description) for r in found} == {("a/", "about a"), ("b/", None), ("d/", "its own")}


def test_apply_is_guarded(spark, tmp_path):
    write(tmp_path, {"a.md": "one\n", "b.md": "two\n", "c.md": "three\n"})
    files = spark.createDataFrame([("a.md", "one\n"), ("b.md", "stale\n"), ("c.md", "three\n"), ("../out.md", "x"), ("gone.md", "y")], "rel_path string, content string")
    plans = writes.plan(files, lambda c: c if c == "three\n" else c.upper())
    found = {r.rel_path: r.status for r in writes.apply(plans, str(tmp_path)).collect()}
    assert found == {"a.md": "written", "b.md": "conflict", "../out.md": "unsafe", "gone.md": "missing"}
    assert (tmp_path / "a.md").read_text() == "ONE\n" and (tmp_path / "b.md").read_text() == "two\n"
    again = {r.rel_path: r.status for r in writes.apply(plans, str(tmp_path)).collect()}
    assert again["a.md"] == "unchanged"
    sha = hashlib.sha256(b"ONE\n").hexdigest()
    assert [writes.move_file(str(tmp_path), "a.md", to, h) for to, h in (("b.md", sha), ("x/a.md", "0"), ("../a.md", sha), ("x/a.md", sha))] == ["conflict", "conflict", "unsafe", "moved"]
    assert writes.write_safety(None) is None and writes.write_safety("---\nformat_version: '0.1'\n---\n") is None
    assert writes.write_safety("---\nformat_version: '9.0'\n---\n") and writes.write_safety("---\nformat_version: x\n---\n") and writes.write_safety("---\n")


def test_unplannable_changes_are_rows(spark):
    def refuse(content):
        raise ValueError("no")

    row = writes.plan(spark.createDataFrame([("a.md", "x")], "rel_path string, content string"), refuse).first()
    assert row.problem == "no" and row.proposed is None


def test_stream_and_stored_links(spark, tmp_path):
    write(tmp_path / "docs", {"a.md": doc("[b](b.md)"), "b.md": doc("x")})
    seen = []
    run_once = lambda: stream(spark, Bundle("b", str(tmp_path / "docs")), lambda m, n: seen.extend(r.concept_id for r in m.concepts.collect()), str(tmp_path / "cp")).awaitTermination()
    run_once()
    write(tmp_path / "docs", {"c.md": doc("y")})
    run_once()
    assert sorted(seen) == ["a", "b", "c"]
    concepts = scan.scan(spark, Bundle("b", str(tmp_path / "docs"))).concepts
    keep = str(tmp_path / "kept")
    assert cache.refresh_links(concepts, keep, links.extract).count() == 1
    write(tmp_path / "docs", {"b.md": doc("[c](c.md)")})
    (tmp_path / "docs/a.md").unlink()
    concepts = scan.scan(spark, Bundle("b", str(tmp_path / "docs"))).concepts
    assert [(r.source_concept_id, r.target_concept_id) for r in cache.refresh_links(concepts, keep, links.extract).collect()] == [("b", "c")]


@settings(deadline=None, max_examples=100)
@given(st.text(max_size=30))
def test_query_terms_never_fail(q):
    assert all(all(t for t in p) for p in text.query_terms(q))


def test_only_the_entry_module_knows_the_dealt_operators():
    top = Path(__file__).resolve().parents[1]
    for path in (top / "kbspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text())
