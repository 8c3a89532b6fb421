"""Incremental scans: parsed concepts kept as Parquet, keyed by path, size and modification time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bundle
from .bundle import Manifest, chosen, manifest_of, parse_problems, read_files, stable_id_problems, stable_ids
from .phases import phase
from .scratch import store

KEYS = ["rel_path", "mtime_ms", "size"]
#: Changed files that are opened by their paths, which the driver lists.
MOST_LISTED = 10_000


def diff(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """rel_path and state: fresh (the cached row holds), changed, new or gone. One full outer join on the path."""
    old = cached.select("rel_path", F.struct("mtime_ms", "size").alias("old"))
    new = listing.select("rel_path", F.struct("mtime_ms", "size").alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "fresh").otherwise("changed")
    return old.join(new, "rel_path", "full_outer").select("rel_path", state.alias("state"))


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest snapshot; None without one. Columns that older snapshots lack read as null."""
    try:
        latest = spark.read.text(f"{folder}/latest").first()[0]
        return spark.read.option("mergeSchema", True).parquet(f"{folder}/{latest}")
    except AnalysisException:
        return None


def save(concepts: DataFrame, folder: str) -> None:
    """A new snapshot beside the old, then the pointer to it, so readers see one or the other."""
    name = f"snapshot-{uuid.uuid4().hex[:12]}"
    concepts.write.parquet(f"{folder}/{name}")
    concepts.sparkSession.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest")


def settle(cached: DataFrame, listing: DataFrame, changed: DataFrame, bundle: Bundle) -> tuple[DataFrame, DataFrame]:
    """The concepts after a refresh, and the problems of files that couldn't be read.

    cached: the snapshot's concepts; listing: the keys of the files there are now; changed: the files (with content) whose
    keys aren't in the snapshot. A file that couldn't be read is in no snapshot, so it is read again each time.
    """
    found = manifest_of(changed, bundle)
    fresh = cached.join(listing.select(*KEYS), KEYS, "left_semi")
    return fresh.unionByName(found.concepts, allowMissingColumns=True), parse_problems(found.problems)


def snapshot_manifest(concepts: DataFrame, problems: DataFrame, bundle: Bundle) -> Manifest:
    """A manifest of stored concepts. Problems of stable ids are those of all concepts, whichever of them changed last."""
    concepts = stable_ids(concepts, bundle.stable_id_field)
    return Manifest(bundle, concepts, problems.unionByName(stable_id_problems(concepts, bundle.stable_id_field)))


def refresh(spark: SparkSession, bundle: Bundle) -> Manifest:
    """_refresh(), as a phase that may be watched."""
    with phase("scan", bundle) as result:
        result.append(_refresh(spark, bundle))
    return result[-1]


def _refresh(spark: SparkSession, bundle: Bundle) -> Manifest:
    """A scan that parses only files whose size or time differ from the snapshot, and saves the result.

    Paths, sizes and times are listed first; then up to MOST_LISTED changed files are opened by their paths. Of more, which
    is a first scan or a bundle changed throughout, all contents are scanned. Rows of files that are gone are dropped.
    Without any change nothing is written.
    """
    if bundle.cache_dir is None:
        return manifest_of(read_files(spark, bundle), bundle)
    cached = load(spark, bundle.cache_dir)
    if cached is None:
        found = manifest_of(read_files(spark, bundle), bundle)
        save(found.concepts, bundle.cache_dir)
        return snapshot_manifest(load(spark, bundle.cache_dir), parse_problems(found.problems), bundle)
    listing = store(read_files(spark, bundle).where(chosen(F.col("rel_path"), bundle)).select(*KEYS), "listing")
    differ = listing.join(cached.select(*KEYS), KEYS, "left_anti")
    paths = [r.rel_path for r in differ.select("rel_path").limit(MOST_LISTED + 1).collect()]
    if len(paths) <= MOST_LISTED:
        changed = read_files(spark, bundle, only=paths)
    else:
        changed = read_files(spark, bundle).join(differ.select("rel_path"), "rel_path", "left_semi")
    concepts, problems = settle(cached, listing, changed, bundle)
    if paths or listing.count() != cached.count():
        save(concepts, bundle.cache_dir)
    return snapshot_manifest(load(spark, bundle.cache_dir), problems, bundle)


def changed_ranks(old: DataFrame, new: DataFrame, least: float = 1e-12) -> DataFrame:
    """The rows of new (concept_id, pagerank) that differ from old by more than least."""
    both = new.join(old.select("concept_id", F.col("pagerank").alias("_old")), "concept_id", "left")
    return both.where(F.col("_old").isNull() | (F.abs(F.col("pagerank") - F.col("_old")) > least)).drop("_old")


def refresh_ranks(ranks: DataFrame, folder: str) -> DataFrame:
    """The stored ranks, written anew only if some differ from what is stored or nodes are gone."""
    spark, place = ranks.sparkSession, f"{folder}/ranks"
    old, new = load(spark, place), store(ranks, "ranks")
    if old is None or not changed_ranks(old, new).isEmpty() or old.count() != new.count():
        save(new, place)
    return load(spark, place)


def refresh_links(concepts: DataFrame, folder: str, extract) -> DataFrame:
    """The links of concepts, extracted only for those whose hash differs from the stored one's; titles are stored too.

    extract is links.extract. Links of concepts that are gone are dropped. What was extracted from is stored beside the links,
    so concepts without links aren't read again either.
    """
    spark = concepts.sparkSession
    hashes = store(concepts.select(F.col("concept_id").alias("source_concept_id"), "sha256"), "hashes")
    keys = ["source_concept_id", "sha256"]
    known, old = load(spark, f"{folder}/parsed"), load(spark, f"{folder}/links")
    if known is None or old is None:
        found = extract(concepts).join(hashes, "source_concept_id")
    else:
        stale = hashes.join(known, keys, "left_anti")
        if stale.isEmpty() and known.count() == hashes.count():
            return old
        changed = concepts.join(stale.select(F.col("source_concept_id").alias("concept_id")), "concept_id", "left_semi")
        found = old.join(hashes, keys, "left_semi").unionByName(extract(changed).join(hashes, "source_concept_id"))
    save(found, f"{folder}/links")
    save(hashes, f"{folder}/parsed")
    return load(spark, f"{folder}/links")
