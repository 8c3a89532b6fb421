"""Scan a bundle: Markdown files to a table of concepts and a table of problems."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bundle
from ..functions import frontmatter, paths

FILES = "rel_path string, mtime_ms long, size long, content binary"
CONCEPTS = "concept_id string, rel_path string, mtime_ms long, size long, sha256 string, frontmatter string, body string, content string"
PROBLEMS = "rel_path string, kind string, message string"


@dataclass(frozen=True)
class Manifest:
    """concepts: one row per readable document; problems: one row per fault, never an exception."""

    bundle: Bundle
    concepts: DataFrame
    problems: DataFrame


def read_files(spark: SparkSession, bundle: Bundle, pattern: str = "*.md", only: list[str] | None = None) -> DataFrame:
    """Files under the root by relative path; only: those of these relative paths. A missing root is an empty bundle.

    Content is read only by plans that use it, so keys alone are a listing.
    """
    root = bundle.root.rstrip("/")
    places = root if only is None else [f"{root}/{re.sub(r'([\\*?\[\]{}])', r'\\\1', path)}" for path in only]
    if not places:
        return spark.createDataFrame([], FILES)
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(places)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILES)
    prefix = "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in root.split("://", 1)[-1].rstrip("/")) + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), prefix, "")
    return raw.select(rel.alias("rel_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")


def read_beside(folders: DataFrame, bundle: Bundle, name: str) -> DataFrame:
    """dir and content of the files of a name in folders (dir), opened by their paths.

    Spark's listings leave out files whose names begin with an underscore, as those of sidecars do.
    """
    root = bundle.root.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        for batch in batches:
            out = []
            for folder in batch["dir"]:
                try:
                    with files.open_input_stream("/".join(filter(None, (top, folder, name)))) as f:
                        out.append((folder, f.read().decode("utf-8", "replace")))
                except FileNotFoundError:
                    continue
            yield pd.DataFrame(out, columns=["dir", "content"])

    return folders.select("dir").mapInPandas(run, "dir string, content string")


def chosen(rel_path: Column, bundle: Bundle) -> Column:
    included = paths.matches_any(rel_path, bundle.include, True)
    return included & ~paths.matches_any(rel_path, bundle.exclude, False) & ~paths.is_reserved(rel_path, bundle.reserved)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for content in batch["content"]:
            try:
                text = bytes(content).decode("utf-8")
                document = frontmatter.parse(text)
                out.append((None, None, frontmatter.to_json(document.frontmatter), document.body, text))
            except UnicodeDecodeError as e:
                out.append(("decode-error", str(e), None, None, None))
            except frontmatter.DocumentParseError as e:
                out.append(("parse-error", str(e), None, None, None))
        parsed = pd.DataFrame(out, columns=["kind", "message", "frontmatter", "body", "text"], index=batch.index)
        yield pd.concat([batch[["rel_path", "mtime_ms", "size", "sha256"]], parsed], axis=1)


def parse_files(files: DataFrame) -> DataFrame:
    """rel_path, mtime_ms, size, sha256 with frontmatter (JSON), body and text, or with kind and message of a fault."""
    hashed = files.select("rel_path", "mtime_ms", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    return hashed.mapInPandas(_parse, "rel_path string, mtime_ms long, size long, sha256 string, kind string, message string, frontmatter string, body string, text string")


def stable_ids(concepts: DataFrame, field: str | None) -> DataFrame:
    """concepts with stable_id: the field's value as a trimmed string, null if missing or blank."""
    if field is None:
        return concepts.withColumn("stable_id", F.lit(None).cast("string"))
    return concepts.withColumn("stable_id", F.nullif(F.trim(F.try_variant_get(F.try_parse_json("frontmatter"), f"$['{field}']", "string")), F.lit("")))


def stable_id_problems(concepts: DataFrame, field: str | None) -> DataFrame:
    """stable-id-missing rows, and stable-id-conflict rows for each concept whose id others have."""
    if field is None:
        return concepts.sparkSession.createDataFrame([], PROBLEMS)
    missing = concepts.where(F.col("stable_id").isNull()).select("rel_path", F.lit("stable-id-missing").alias("kind"), F.lit(f"Missing or blank stable ID field: {field}").alias("message"))
    return missing.unionByName(stable_id_conflicts(concepts).select("rel_path", F.lit("stable-id-conflict").alias("kind"), F.concat(F.lit("Stable ID '"), F.col("stable_id"), F.lit("' is shared by "), F.col("others").cast("string"), F.lit(" other concepts")).alias("message")))


def stable_id_conflicts(concepts: DataFrame) -> DataFrame:
    """rel_path, stable_id and others (how many other concepts have it). Counted before joining: a common id costs one row."""
    counts = concepts.where(F.col("stable_id").isNotNull()).groupBy("stable_id").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return concepts.select("rel_path", "stable_id").join(counts, "stable_id")


def stable_id_members(concepts: DataFrame) -> DataFrame:
    """stable_id and rel_path of every concept whose id others have, by id: who is in which conflict."""
    return stable_id_conflicts(concepts).select("stable_id", "rel_path").orderBy("stable_id", "rel_path")


def parse_problems(problems: DataFrame) -> DataFrame:
    """The problems of files that couldn't be read as documents: those that hide what the file says."""
    return problems.where(~F.col("kind").startswith("stable-id"))


def manifest_of(files: DataFrame, bundle: Bundle) -> Manifest:
    """A manifest from any table with the columns of FILES."""
    parsed = parse_files(files.where(chosen(F.col("rel_path"), bundle)).dropDuplicates(["rel_path"]))
    concepts = parsed.where(F.col("kind").isNull()).select(paths.concept_id(F.col("rel_path")).alias("concept_id"), "rel_path", "mtime_ms", "size", "sha256", "frontmatter", "body", F.col("text").alias("content"))
    concepts = stable_ids(concepts, bundle.stable_id_field)
    problems = parsed.where(F.col("kind").isNotNull()).select("rel_path", "kind", "message")
    return Manifest(bundle, concepts, problems.unionByName(stable_id_problems(concepts, bundle.stable_id_field)))


def scan(spark: SparkSession, bundle: Bundle) -> Manifest:
    return manifest_of(read_files(spark, bundle), bundle)
