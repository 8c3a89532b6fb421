"""Context packs: concepts around seeds, in order, cut at a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import store

DIRECTIONS = ("outbound", "inbound", "both")


def resolve_seeds(concepts: DataFrame, seeds: list[str]) -> tuple[DataFrame, DataFrame]:
    """concept_id and pos of the seeds that exist, the first of repeats; and unknown-seed rows for the others."""
    asked = concepts.sparkSession.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], "concept_id string, pos int")
    ids = concepts.select("concept_id")
    return asked.join(ids, "concept_id", "left_semi"), asked.join(ids, "concept_id", "left_anti").select("concept_id", F.lit("unknown-seed").alias("kind"))


def expand(seeds: DataFrame, links: DataFrame, depth: int, direction: str) -> DataFrame:
    """concept_id, distance, reason, pos: a breadth-first search; the first to discover a concept gives its reason.

    A level's concepts are visited in order (seeds by position, others by id), each first along its links, then against.
    """
    out = links.select(F.col("source_concept_id").alias("a"), F.col("target_concept_id").alias("b"), F.lit(0).alias("way"))
    back = links.select(F.col("target_concept_id").alias("a"), F.col("source_concept_id").alias("b"), F.lit(1).alias("way"))
    ways = (out if direction == "outbound" else back if direction == "inbound" else out.unionByName(back)).distinct()
    found = seeds.select("concept_id", F.lit(0).alias("distance"), F.lit("seed").alias("reason"), F.col("pos").cast("long").alias("pos"))
    for step in range(1, depth + 1):
        edge = found.where(F.col("distance") == step - 1).select(F.col("concept_id").alias("a"), F.when(F.col("distance") == 0, F.col("pos")).otherwise(F.lit(0)).alias("parent"))
        seen = ways.join(edge, "a").groupBy(F.col("b").alias("concept_id")).agg(F.min(F.struct("parent", "a", "way")).alias("by"))
        new = seen.join(found, "concept_id", "left_anti")
        new = new.select("concept_id", F.lit(step).alias("distance"), F.when(F.col("by.way") == 0, "outbound-link").otherwise("backlink").alias("reason"), F.lit(0).cast("long").alias("pos"))
        found = store(found.unionByName(new), "pack")
    return found


def pack(concepts: DataFrame, links: DataFrame, seeds: list[str], depth: int = 1, direction: str = "both", budget: int | None = None) -> DataFrame:
    """concept_id, reason, distance, char_count, position and status (entry or omitted).

    concepts has concept_id and content; lengths count the whole file. The running sum of lengths can only grow, so what
    fits is what precedes the first that doesn't. The sum runs over what was discovered, which depth bounds.
    """
    if depth < 0:
        raise ValueError("depth must be greater than or equal to 0")
    if budget is not None and budget < 0:
        raise ValueError("budget_chars must be non-negative")
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    known, _ = resolve_seeds(concepts, seeds)
    found = expand(known, links, depth, direction)
    sized = found.join(concepts.select("concept_id", F.char_length("content").cast("long").alias("char_count")), "concept_id")
    order = Window.orderBy("distance", "pos", "concept_id")
    total = F.sum("char_count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.lit(True) if budget is None else total <= budget
    return sized.select("concept_id", "reason", "distance", "char_count", (F.row_number().over(order) - 1).alias("position"), F.when(fits, "entry").otherwise("omitted").alias("status"))
