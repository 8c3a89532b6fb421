"""Titles that other concepts mention without a link."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, paths, text


def visible_prose(concepts: DataFrame) -> DataFrame:
    """concept_id and prose: what a reader sees, without code, images and link targets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"concept_id": batch["concept_id"], "prose": [markdown.prose(b or "") for b in batch["body"]]})

    return concepts.select("concept_id", "body").mapInPandas(run, "concept_id string, prose string")


def unlinked_mentions(titles: DataFrame, prose: DataFrame, linked: DataFrame) -> DataFrame:
    """source_concept_id, target_concept_id, target_title: all words of the target's title stand in the source's prose.

    linked has the pairs that a link joins already, broken links too. A title is looked up by its rarest word alone, and
    only for those hits are the other words checked, so frequent words never join.
    """
    targets = titles.select(F.col("concept_id").alias("target_concept_id"), F.col("title").alias("target_title"), F.array_distinct(text.tokens(F.col("title"))).alias("terms")).where(F.size("terms") > 0)
    sources = prose.select(F.col("concept_id").alias("source_concept_id"), F.array_distinct(text.tokens(F.col("prose"))).alias("words"))
    postings = sources.select("source_concept_id", F.explode("words").alias("term"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = targets.select("target_concept_id", F.explode("terms").alias("term")).join(df, "term", "left")
    rarest = ranked.groupBy("target_concept_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term"))["term"].alias("term"))
    pairs = postings.join(rarest, "term").where("source_concept_id != target_concept_id").select("source_concept_id", "target_concept_id")
    checked = pairs.join(targets, "target_concept_id").join(sources, "source_concept_id").where(F.size(F.array_except("terms", "words")) == 0)
    known = linked.select("source_concept_id", "target_concept_id").where(F.col("target_concept_id").isNotNull()).distinct()
    return checked.join(known, ["source_concept_id", "target_concept_id"], "left_anti").select("source_concept_id", "target_concept_id", "target_title")


def select_suggestions(suggestions: DataFrame, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The suggestions for the wanted pairs, and the pairs for which there is none. Without pairs all are chosen."""
    if pairs is None:
        return suggestions, None
    keys = ["source_concept_id", "target_concept_id"]
    pairs = pairs.dropDuplicates(keys)
    return suggestions.join(pairs, keys, "left_semi"), pairs.join(suggestions, keys, "left_anti")


def suggestion_line(source_path: str, target_path: str, title: str) -> str:
    return f"- {markdown.render_link(title, paths.relative_href(source_path, target_path))}\n"
