"""Planned edits: rows with the content before and after and their hashes; and a sink that applies them, guarded."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import VersionError, is_supported
from ..functions import frontmatter, patching, paths

PLANS = "rel_path string, original string, original_sha256 string, proposed string, proposed_sha256 string, changed boolean, problem string"


def plan(files: DataFrame, change: Callable[..., str], arguments: tuple[str, ...] = ()) -> DataFrame:
    """A plan per row of files (rel_path, content, arguments). change(content, *arguments) must not read anything else.

    A change that can't be planned is a row with a problem and nothing proposed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.rel_path, row.content, change(row.content, *(getattr(row, a) for a in arguments)), None))
                except (ValueError, frontmatter.DocumentParseError) as e:
                    out.append((row.rel_path, row.content, None, str(e)))
            yield pd.DataFrame(out, columns=["rel_path", "original", "proposed", "problem"])

    planned = files.select("rel_path", "content", *arguments).mapInPandas(run, "rel_path string, original string, proposed string, problem string")
    return planned.select("rel_path", "original", F.sha2("original", 256).alias("original_sha256"), "proposed", F.sha2("proposed", 256).alias("proposed_sha256"), (F.col("proposed") != F.col("original")).alias("changed"), "problem")


def plan_contents(files: DataFrame) -> DataFrame:
    """Plans from rel_path, content (null: there must be no such file yet) and proposed."""
    return files.select("rel_path", F.col("content").alias("original"), F.sha2("content", 256).alias("original_sha256"), "proposed", F.sha2("proposed", 256).alias("proposed_sha256"), (~F.col("content").eqNullSafe(F.col("proposed"))).alias("changed"), F.lit(None).cast("string").alias("problem"))


def _rewrite(content: str, pairs) -> str:
    return patching.rewrite_links(content, {p["old"]: p["new"] for p in pairs})


def plan_rewrites(files: DataFrame, rewrites: DataFrame) -> DataFrame:
    """One plan per file from rewrites (rel_path, old, new); a file's rewrites are grouped, repeats dropped."""
    grouped = rewrites.groupBy("rel_path").agg(F.sort_array(F.collect_set(F.struct("old", "new"))).alias("pairs"))
    return plan(files.join(grouped, "rel_path"), _rewrite, ("pairs",))


@F.pandas_udf(StringType())
def moved_href(href: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([paths.moved_href(*x) for x in zip(href, source, target, strict=True)])


def plan_move(files: DataFrame, links: DataFrame, old_path: str, new_path: str) -> DataFrame:
    """Plans for moving a document: links to it in others, and its own links, seen from its new folder.

    links are those of the graph (source_path, target, target_path). The moved file's plan carries its old path.
    """
    inbound = links.where((F.col("target_path") == old_path) & (F.col("source_path") != old_path))
    rewrites = inbound.select(F.col("source_path").alias("rel_path"), F.col("target").alias("old"), moved_href("target", "source_path", F.lit(new_path)).alias("new")).where("old != new")
    own = plan(files.where(F.col("rel_path") == old_path), lambda content: patching.move_links(content, old_path, new_path))
    return plan_rewrites(files, rewrites).unionByName(own)


def plan_repair(files: DataFrame, broken: DataFrame, moved: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Plans for broken links whose target moved, and (source_path, target, reason) of those that stay broken.

    moved has dead_id and new_path (null: unknown); each dead id is looked up once. Reasons: not-concept-shaped,
    no-plugin-registered (there is no table of moves), unresolved, invalid-resolved-path, planning-failed.
    """
    shaped = broken.where(F.col("target_concept_id").isNotNull())
    lost = broken.where(F.col("target_concept_id").isNull()).select("source_path", "target", F.lit("not-concept-shaped").alias("reason"))
    if moved is None:
        return plan_rewrites(files, files.sparkSession.createDataFrame([], "rel_path string, old string, new string")), lost.unionByName(shaped.select("source_path", "target", F.lit("no-plugin-registered").alias("reason")))
    known = files.select(F.col("rel_path").alias("_there"))
    answers = moved.dropDuplicates(["dead_id"]).join(known, F.col("new_path") == F.col("_there"), "left")
    found = shaped.join(answers, F.col("target_concept_id") == F.col("dead_id"), "left")
    reason = F.when(F.col("new_path").isNull(), "unresolved").when(F.col("_there").isNull(), "invalid-resolved-path")
    found = found.withColumn("reason", reason)
    rewrites = found.where(F.col("reason").isNull()).select(F.col("source_path").alias("rel_path"), F.col("target").alias("old"), moved_href("target", "source_path", "new_path").alias("new"))
    plans = plan_rewrites(files, rewrites)
    failed = plans.where(F.col("problem").isNotNull()).select("rel_path")
    failing = rewrites.join(failed, "rel_path", "left_semi").select(F.col("rel_path").alias("source_path"), F.col("old").alias("target"), F.lit("planning-failed").alias("reason"))
    return plans.where(F.col("problem").isNull()), lost.unionByName(found.where(F.col("reason").isNotNull()).select("source_path", "target", "reason")).unionByName(failing)


def plan_suggestions(files: DataFrame, suggestions: DataFrame, heading: str = "See also", level: int = 2) -> DataFrame:
    """One plan per source for suggestions (source_path, target_path, target_title): bullets under a heading."""
    from .mentions import suggestion_line

    grouped = suggestions.groupBy(F.col("source_path").alias("rel_path")).agg(F.sort_array(F.collect_set(F.struct("target_path", "target_title"))).alias("rows"))

    def change(content: str, rel_path: str, rows) -> str:
        return patching.append_section(content, heading, level, [suggestion_line(rel_path, r["target_path"], r["target_title"]) for r in rows])

    return plan(files.join(grouped, "rel_path").withColumn("own_path", F.col("rel_path")), change, ("own_path", "rows"))


def write_safety(root_index: str | None, version_key: str = "format_version") -> str | None:
    """Why a bundle must not be written to, from the content of its root index; None if it may."""
    if root_index is None:
        return None
    try:
        declared = frontmatter.parse(root_index).frontmatter.get(version_key)
        if declared is None or is_supported(str(declared)):
            return None
        return f"the bundle declares version {declared}, which is newer than what can be written"
    except (frontmatter.DocumentParseError, VersionError) as e:
        return str(e)


def _apply_one(root: str, rel_path: str, before: str | None, after: str) -> tuple[str, str]:
    """Replace a file whose hash is still before by one whose hash is after; before None: make a file that isn't there."""
    top = os.path.realpath(root)
    path = os.path.realpath(os.path.join(top, rel_path))
    if not path.startswith(top + os.sep) or os.path.islink(os.path.join(top, rel_path)):
        return rel_path, "unsafe"
    data, held = after.encode(), None
    try:
        with open(path, "rb") as f:
            held = hashlib.sha256(f.read()).hexdigest()
    except OSError:
        if before is not None or not os.path.isdir(os.path.dirname(path)):
            return rel_path, "missing"
    if held == hashlib.sha256(data).hexdigest():
        return rel_path, "unchanged"
    if held != before:
        return rel_path, "conflict"
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if before is None:
            os.chmod(name, 0o644)
            os.link(name, path)
            os.unlink(name)
        else:
            os.chmod(name, os.stat(path).st_mode & 0o7777)
            os.replace(name, path)
    except FileExistsError:  # made by another since it was looked for
        os.unlink(name)
        return rel_path, "conflict"
    return rel_path, "written"


class UnsafeBundle(ValueError):
    """A bundle that must not be written to."""


def apply(plans: DataFrame, root: str, version_key: str = "format_version") -> DataFrame:
    """rel_path and status of each changed plan. root is a folder that all executors share.

    Nothing is written if the root index, as it is now, declares a version that can't be written (UnsafeBundle).

    A file is written only if its hash is still the one planned for. Running a task again is harmless: what it wrote is
    found unchanged. Files are not written together; a failure leaves the others' results.
    """

    try:
        with open(os.path.join(root, "index.md"), encoding="utf-8", errors="replace") as f:
            index = f.read()
    except OSError:
        index = None
    if why := write_safety(index, version_key):
        raise UnsafeBundle(why)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_apply_one(root, *r) for r in batch.itertuples(index=False)], columns=["rel_path", "status"])

    return plans.where("changed AND problem IS NULL").select("rel_path", "original_sha256", "proposed").mapInPandas(run, "rel_path string, status string")


def move_file(root: str, old_path: str, new_path: str, expected_sha256: str) -> str:
    """Move a file that still has the expected hash; never over another. On the driver, after the plans are applied."""
    top = os.path.realpath(root)
    old, new = (os.path.join(top, p) for p in (old_path, new_path))
    for p in (old, new):
        if not os.path.realpath(p).startswith(top + os.sep):
            return "unsafe"
    with open(old, "rb") as f:
        if hashlib.sha256(f.read()).hexdigest() != expected_sha256:
            return "conflict"
    os.makedirs(os.path.dirname(new), exist_ok=True)
    try:
        os.link(old, new)
    except FileExistsError:
        return "conflict"
    os.unlink(old)
    return "moved"
