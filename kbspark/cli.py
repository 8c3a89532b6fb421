"""Command line: each command is one query over a bundle. JSON on standard output; 0 fine, 1 problems, 2 misuse."""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import json
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Bundle, ConfigError, load
from .functions import frontmatter, log_doc, patching, paths
from .operators import context, documents, links, listing, mentions, search, validate, writes
from .sources import bundle as scan
from .sources import cache
from .sources.phases import phase
from .sources.scratch import store

GUIDE = """kbspark reads a bundle of Markdown documents with YAML frontmatter.
Start with list-concepts to see what there is and graph to see how it hangs together; search finds words, context packs
what surrounds some concepts. validate tells what is wrong. Commands that write take --dry-run and guard every file by its hash.
"""


class Usage(Exception):
    """A command that can't be run as given."""


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _files(folder: str, **tables: DataFrame) -> dict[str, str]:
    """Tables too large for one document as folders of JSON lines: name to place."""
    for name, table in tables.items():
        table.write.mode("error").json(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}


def _manifest(spark: SparkSession, bundle: Bundle) -> scan.Manifest:
    return cache.refresh(spark, bundle)


def _graph(spark: SparkSession, bundle: Bundle) -> tuple[scan.Manifest, links.Graph]:
    """The manifest and its links. With a cache only changed concepts are searched for links."""
    found = _manifest(spark, bundle)
    with phase("graph", bundle) as result:
        kept = None
        if bundle.cache_dir is not None:
            rules = hashlib.sha256(repr(sorted(bundle.reserved)).encode()).hexdigest()[:8]
            kept = cache.refresh_links(found.concepts, f"{bundle.cache_dir}/graph-{rules}", lambda c: links.extract(c, bundle.reserved)).drop("sha256")
        result.append(links.build(found.concepts, bundle.reserved, kept))
    return found, result[-1]


def cmd_scan(spark, bundle, args):
    found = _manifest(spark, bundle)
    if args.output:
        return _files(args.output, concepts=found.concepts.select("concept_id", "rel_path", "size", "sha256", "stable_id"), problems=found.problems), 0
    problems = rows(found.problems)
    return {"concepts": rows(found.concepts.select("concept_id", "rel_path", "size", "sha256", "stable_id").orderBy("concept_id")), "problems": problems}, int(args.quiet and bool(problems))


def _in_folders(spark: SparkSession, bundle: Bundle, name: str) -> DataFrame:
    """dir and content of all files of a name."""
    return scan.read_files(spark, bundle, name).select(documents.folder_of(F.col("rel_path")).alias("dir"), F.decode("content", "UTF-8").alias("content"))


def _sidecars(bundle: Bundle, listed: DataFrame) -> DataFrame:
    """What the folders that hold concepts say about themselves."""
    if "/" in bundle.directory_file:
        raise Usage(f"directory_file must be a plain filename: {bundle.directory_file}")
    return documents.parse_sidecars(scan.read_beside(documents.concept_directories(listed), bundle, bundle.directory_file))


def cmd_validate(spark, bundle, args):
    found = _manifest(spark, bundle)
    findings = validate.bundle(found.concepts, found.problems, bundle.profile, bundle.taxonomy)
    out = rows(findings.orderBy("rel_path", "severity", "field"))
    listed = listing.list_concepts(found.concepts)
    committed = _in_folders(spark, bundle, "index.md")
    drift = rows(documents.drift(documents.generate_entries(listed, _sidecars(bundle, listed).where("problem IS NULL")), committed))
    return {"findings": out, "index_drift": drift}, int(any(f["severity"] == "error" for f in out))


def cmd_list_concepts(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    listed = listing.list_concepts(found.concepts, bundle.listing_fields, args.with_content)
    out = {}
    if args.with_graph_counts:
        ranks = links.pagerank(found.concepts, graph.links)
        ranks = ranks if bundle.cache_dir is None else cache.refresh_ranks(ranks, bundle.cache_dir)
        listed = listing.with_graph(listed, links.degrees(found.concepts, graph.links), ranks)
        out["orphans"] = [r["concept_id"] for r in rows(links.orphans(listed, graph.links).orderBy("concept_id"))]
    return {"concepts": rows(listed.orderBy("concept_id")), "problems": rows(listing.missing_type(found.concepts)) + rows(found.problems), **out}, 0


def _search_rows(found: scan.Manifest, bundle: Bundle) -> DataFrame:
    listed = listing.list_concepts(found.concepts, bundle.listing_fields, True)
    return listed.withColumn("fields", search.fields_text(F.col("fields")))


def cmd_search(spark, bundle, args):
    if bundle.cache_dir is None:
        raise Usage("cache_dir is not configured")
    if args.limit < 0:
        raise Usage("limit must be non-negative")
    index, known = f"{bundle.cache_dir}/index", cache.load(spark, bundle.cache_dir)
    if args.no_refresh and known is None:
        raise Usage("there is no snapshot yet to search without a refresh")
    found = scan.Manifest(bundle, known, None) if args.no_refresh else _manifest(spark, bundle)
    docs = _search_rows(found, bundle)
    if not args.no_refresh or cache.load(spark, f"{index}/documents") is None:
        search.refresh_index(docs, index)
    best = search.search_index(spark, index, args.query).orderBy("score", "concept_id").limit(args.limit)
    return {"results": rows(search.with_snippets(docs, best, args.query))}, 0


def cmd_unlinked_mentions(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    listed = listing.list_concepts(found.concepts)
    known = graph.links.unionByName(graph.broken)
    suggestions = mentions.unlinked_mentions(listed.where("title IS NOT NULL"), mentions.visible_prose(found.concepts), known)
    pairs = None
    if args.select:
        if not all(s.count(":") == 1 for s in args.select):
            raise Usage("--select takes SOURCE:TARGET")
        pairs = spark.createDataFrame([tuple(s.split(":")) for s in args.select], "source_concept_id string, target_concept_id string")
    chosen, unmatched = mentions.select_suggestions(suggestions, pairs)
    out = {"suggestions": rows(chosen.orderBy("source_concept_id", "target_concept_id")), "unmatched": rows(unmatched) if unmatched is not None else []}
    if args.apply:
        at = found.concepts.select("concept_id", "rel_path")
        named = chosen.join(at.select(F.col("concept_id").alias("source_concept_id"), F.col("rel_path").alias("source_path")), "source_concept_id").join(at.select(F.col("concept_id").alias("target_concept_id"), F.col("rel_path").alias("target_path")), "target_concept_id")
        out |= _write(spark, bundle, writes.plan_suggestions(found.concepts.select("rel_path", "content"), named, args.heading, args.heading_level), args.dry_run)
    return out, int(any(w["status"] == "conflict" for w in out.get("written", [])))


def cmd_context(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    _, unknown = context.resolve_seeds(found.concepts, args.seed)
    pack = context.pack(found.concepts, graph.links, args.seed, args.depth, args.direction, args.budget_chars).orderBy("position")
    entries = pack.where("status = 'entry'").join(found.concepts.select("concept_id", "rel_path", listing.inline_value("title").alias("title"), "content"), "concept_id").orderBy("position")
    problems = rows(unknown)
    return {"entries": rows(entries), "omitted": [r["concept_id"] for r in rows(pack.where("status = 'omitted'"))], "problems": problems}, int(bool(problems))


def cmd_graph(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    if args.output and not args.concept and not args.broken:
        return _files(args.output, links=graph.links, broken_links=graph.broken, problems=found.problems), 0
    out = {"broken_links": rows(graph.broken.orderBy("source_concept_id", "target_path", "target"))}
    if args.broken:
        return out, 0
    if args.concept:
        near = [r["concept_id"] for r in rows(links.neighborhood(found.concepts, graph.links, args.concept, args.depth).orderBy("concept_id"))]
        return {"links": rows(links.links_from(graph.links, args.concept)), "backlinks": rows(links.backlinks_to(graph.links, args.concept)), "neighborhood": near}, 0
    return {"links": rows(graph.links.orderBy("source_concept_id", "target_path", "target")), **out, "problems": rows(found.problems)}, 0


def _index_plans(spark: SparkSession, bundle: Bundle, found: scan.Manifest, force: bool = False) -> DataFrame:
    """Plans for the indexes of all folders that hold concepts, with dir. A root index keeps the version it declares, unless
    another is configured or it is to be dropped by force."""
    listed = listing.list_concepts(found.concepts)
    bodies = documents.render_indexes(documents.generate_entries(listed, _sidecars(bundle, listed).where("problem IS NULL")))
    old = _in_folders(spark, bundle, "index.md")
    root = old.where("dir = ''").first()
    declared = frontmatter.parse(root["content"]).frontmatter.get(bundle.version_key) if root is not None and not force else None
    version = bundle.version or declared
    head = f'---\n{bundle.version_key}: "{version}"\n---\n' if version else ""
    place = F.when(F.col("dir") == "", F.lit("index.md")).otherwise(F.concat("dir", F.lit("/index.md")))
    proposed = F.concat(F.when(F.col("dir") == "", F.lit(head)).otherwise(F.lit("")), F.col("body"))
    files = bodies.join(old, "dir", "left").select("dir", place.alias("rel_path"), "content", proposed.alias("proposed"))
    return writes.plan_contents(files).withColumn("dir", documents.folder_of(F.col("rel_path")))


def cmd_index(spark, bundle, args):
    found = _manifest(spark, bundle)
    _require_writable(spark, bundle)
    plans, held = _index_plans(spark, bundle, found, args.force), scan.read_files(spark, bundle, "*").select("rel_path")
    problems, reserved = _sidecars(bundle, listing.list_concepts(found.concepts)).where("problem IS NOT NULL").select("dir", "problem"), documents.reserved_files(held, bundle.reserved)
    if args.directory is not None:
        top = args.directory.strip("/")
        inside = (F.col("dir") == top) | (F.lit(args.recurse) & (F.col("dir").startswith(top + "/") | F.lit(not top)))
        plans, problems, reserved = plans.where(inside), problems.where(inside), reserved.where(inside)
    plans = store(plans.drop("dir"), "plans")
    done = {} if args.dry_run else {r["rel_path"]: r["status"] for r in rows(writes.apply(plans, bundle.root, bundle.version_key))}
    planned = rows(plans.select("rel_path", "changed", F.col("original").isNull().alias("new")).orderBy("rel_path"))
    out = [{"path": r["rel_path"], "status": "unchanged" if not r["changed"] else done.get(r["rel_path"], "planned")} for r in planned]
    out = {"indexes": out, "problems": rows(problems) + rows(listing.missing_type(found.concepts)) + rows(found.problems), "excluded_reserved_files": rows(reserved.orderBy("dir", "filename"))}
    return out, int(bool(out["problems"]) or any(x["status"] not in ("written", "unchanged", "planned") for x in out["indexes"]))


def _require_writable(spark, bundle: Bundle) -> None:
    root = scan.read_files(spark, bundle, "index.md").where("rel_path = 'index.md'").select(F.decode("content", "UTF-8").alias("c")).first()
    if why := writes.write_safety(root["c"] if root else None, bundle.version_key):
        raise Usage(why)


def _write(spark, bundle: Bundle, plans: DataFrame, dry_run: bool) -> dict:
    _require_writable(spark, bundle)
    if dry_run:
        return {"plans": rows(plans.where("changed OR problem IS NOT NULL").select("rel_path", "proposed", "problem"))}
    plans = store(plans, "plans")
    return {"written": rows(writes.apply(plans, bundle.root, bundle.version_key)), "problems": rows(plans.where("problem IS NOT NULL").select("rel_path", "problem"))}


def _one(spark, bundle: Bundle, path: str, change: Callable[[str], str], dry_run: bool):
    files = scan.read_files(spark, bundle).where(F.col("rel_path") == path).select("rel_path", F.decode("content", "UTF-8").alias("content"))
    if files.isEmpty():
        raise Usage(f"no file {path}")
    out = _write(spark, bundle, writes.plan(files, change), dry_run)
    bad = [p for p in out.get("problems", out.get("plans", [])) if p.get("problem")]
    return out, int(bool(bad) or any(w["status"] not in ("written", "unchanged") for w in out.get("written", [])))


def cmd_stable_id(spark, bundle, args):
    if bundle is None or not args.concept:
        return {"stable_id": str(uuid.uuid4())}, 0
    if bundle.stable_id_field is None:
        raise Usage("stable_id_field is not configured")
    path, field, new = paths.id_to_path(args.concept), bundle.stable_id_field, str(uuid.uuid4())
    row = _manifest(spark, bundle).concepts.where(F.col("rel_path") == path).select("stable_id").first()
    if row is None:
        raise Usage(f"no concept {args.concept}")
    if row["stable_id"] and not args.force or not args.write:
        return {"stable_id": row["stable_id"]}, int(row["stable_id"] is None)
    out, code = _one(spark, bundle, path, lambda content: patching.merge_frontmatter(content, {field: new}), False)
    return {"stable_id": new, **out}, code


def cmd_move(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    old, new = (p if p.endswith(".md") else paths.id_to_path(p) for p in (args.source, args.dest))
    for path in (old, new):
        paths.path_to_id(path, bundle.reserved)
    unread = scan.parse_problems(found.problems)
    if not unread.isEmpty():  # what links they have is unknown
        return {"problems": rows(unread)}, 1
    if found.concepts.where(F.col("rel_path") == old).isEmpty():
        raise Usage(f"no file {old}")
    if old == new:
        return {"moved": "unchanged"}, 0
    plans = store(writes.plan_move(found.concepts.select("rel_path", "content"), graph.links.unionByName(graph.broken), old, new), "plans")
    own = plans.where(F.col("rel_path") == old).first()
    out = _write(spark, bundle, plans, args.dry_run)
    if args.dry_run:
        return out, 0
    if any(w["status"] not in ("written", "unchanged") for w in out["written"]) or out["problems"]:
        return out, 1
    out["moved"] = writes.move_file(bundle.root, old, new, own["proposed_sha256"])
    if out["moved"] == "moved":
        folders = sorted({os.path.dirname(p) for p in (old, new)})
        again = store(_index_plans(spark, bundle, _manifest(spark, bundle)).where(F.col("dir").isin(*folders) & F.col("original").isNotNull()).drop("dir"), "plans")
        out["indexes"] = rows(writes.apply(again, bundle.root, bundle.version_key))
    return out, int(out["moved"] != "moved" or any(w["status"] not in ("written", "unchanged") for w in out["indexes"]))


def cmd_graph_repair(spark, bundle, args):
    found, graph = _graph(spark, bundle)
    unread = scan.parse_problems(found.problems)
    if not unread.isEmpty():
        return {"problems": rows(unread)}, 1
    moved = None
    if args.moves:
        with open(args.moves, encoding="utf-8") as f:
            moved = spark.createDataFrame([(k, v) for k, v in json.load(f).items()], "dead_id string, new_path string")
    plans, lost = writes.plan_repair(found.concepts.select("rel_path", "content"), graph.broken, moved)
    return {**_write(spark, bundle, plans, args.dry_run), "unresolved": rows(lost)}, 0


def cmd_log_append(spark, bundle, args):
    entry = log_doc.LogEntry(args.content, args.kind)
    if not os.path.exists(os.path.join(bundle.root, "log.md")):
        _require_writable(spark, bundle)
        content = log_doc.append("", entry, args.date)
        if not args.dry_run:
            with open(os.path.join(bundle.root, "log.md"), "x", encoding="utf-8") as f:
                f.write(content)
        return {"proposed": content}, 0
    return _one(spark, bundle, "log.md", lambda c: log_doc.append(c, entry, args.date), args.dry_run)


def cmd_source_add(spark, bundle, args):
    keys = ("resource", "id", "title", "author", "usage_count", "last_modified")
    source = {k: getattr(args, k) for k in keys if getattr(args, k) is not None}
    return _one(spark, bundle, args.path, lambda c: patching.upsert_source(c, source), args.dry_run)


def cmd_stamp(spark, bundle, args):
    now = dt.datetime.now(dt.UTC).replace(microsecond=0)
    kind = args.command.removeprefix("stamp-")
    change = {
        "generated": lambda c: patching.stamp_generated(c, args.by, args.at or now),
        "verified": lambda c: patching.stamp_verified(c, args.by, args.at or now),
        "status": lambda c: patching.stamp_status(c, args.status),
        "stale-after": lambda c: patching.stamp_stale_after(c, args.stale_after),
    }[kind]
    return _one(spark, bundle, args.path, change, args.dry_run)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kbspark")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, *flags: tuple, dry: bool = False, bundle: bool = True) -> None:
        p = commands.add_parser(name)
        if bundle:
            p.add_argument("--bundle")
        if dry:
            p.add_argument("--dry-run", action="store_true")
        for names, options in flags:
            p.add_argument(*names.split(), **options)
        p.set_defaults(run=run)

    on = {"action": "store_true"}
    add("list-bundles", None, bundle=False)
    add("orient", None, bundle=False)
    add("scan", cmd_scan, ("--quiet", on), ("--output", {"help": "folder for tables of JSON lines"}))
    add("validate", cmd_validate, ("--quiet", on))
    add("list-concepts", cmd_list_concepts, ("--with-graph-counts", on), ("--with-content", on))
    add("search", cmd_search, ("query", {}), ("--limit", {"type": int, "default": 10}), ("--no-refresh", on))
    add("unlinked-mentions", cmd_unlinked_mentions, ("--apply", on), ("--select", {"action": "append"}), ("--heading", {"default": "See also"}), ("--heading-level", {"type": int, "default": 2}), dry=True)
    add("context", cmd_context, ("--seed", {"action": "append", "required": True}), ("--depth", {"type": int, "default": 1}), ("--direction", {"choices": context.DIRECTIONS, "default": "both"}), ("--budget-chars", {"type": int}))
    add("graph", cmd_graph, ("--concept", {}), ("--depth", {"type": int, "default": 1}), ("--broken", on), ("--output", {"help": "folder for tables of JSON lines"}))
    add("index", cmd_index, ("--directory", {}), ("--recurse", on), ("--force", on), ("--quiet", on), dry=True)
    add("stable-id", cmd_stable_id, ("concept", {"nargs": "?"}), ("--write", on), ("--force", on))
    add("move", cmd_move, ("source", {}), ("dest", {}), dry=True)
    add("graph-repair", cmd_graph_repair, ("--moves", {"help": "JSON file: dead concept id to new path"}), dry=True)
    add("log-append", cmd_log_append, ("content", {}), ("--date", {}), ("--kind", {}), dry=True)
    add("source-add", cmd_source_add, ("path", {}), ("--resource", {"required": True}), ("--id", {}), ("--title", {}), ("--author", {}), ("--usage-count", {"type": int}), ("--last-modified", {}), dry=True)
    add("stamp-generated", cmd_stamp, ("path", {}), ("--by", {"required": True}), ("--at", {}), dry=True)
    add("stamp-verified", cmd_stamp, ("path", {}), ("--by", {"required": True}), ("--at", {}), dry=True)
    add("stamp-status", cmd_stamp, ("path", {}), ("--status", {"required": True}), dry=True)
    add("stamp-stale-after", cmd_stamp, ("path", {}), ("--stale-after", {"required": True}), dry=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "orient":
            print(GUIDE)
            return 0
        bundles = load(args.config)
        if args.command == "list-bundles":
            print(json.dumps([{"name": b.name, "root": b.root} for b in sorted(bundles.values(), key=lambda b: b.name)], indent=2))
            return 0
        if args.bundle is None and len(bundles) != 1:
            raise Usage("--bundle is needed")
        bundle = bundles.get(args.bundle) if args.bundle else next(iter(bundles.values()))
        if bundle is None:
            raise Usage(f"no bundle {args.bundle!r}")
        session = spark or SparkSession.builder.appName("kbspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        out, code = args.run(session, bundle, args)
    except (ConfigError, Usage, paths.ConceptPathError, search.SearchConfigError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    if counts := [f"{len(v)} {k}" for k, v in out.items() if isinstance(v, list)]:
        print(f"{args.command}: {', '.join(counts)}", file=sys.stderr)
    return code
