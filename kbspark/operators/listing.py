"""Structured listings of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def path_of(key: str) -> str:
    """The path of a top-level key, whatever characters it has."""
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def value(key: str, kind: str = "string") -> Column:
    """A frontmatter value as a scalar; lists and maps as JSON."""
    return F.try_variant_get(F.try_parse_json("frontmatter"), path_of(key), kind)


def kind_of(key: str) -> Column:
    """The type of a frontmatter value, or null without one: STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("frontmatter"), path_of(key), "variant"))


def inline_value(key: str) -> Column:
    """A value as one line of text. Booleans read True and False."""
    raw = value(key)
    return text.inline(F.when(kind_of(key) == "BOOLEAN", F.initcap(raw)).otherwise(raw))


def valid_type() -> Column:
    return F.coalesce((kind_of("type") == "STRING") & (F.regexp_replace(value("type"), r"(?U)\s+", "") != ""), F.lit(False))


def list_concepts(concepts: DataFrame, fields: tuple[str, ...] = (), with_content: bool = False) -> DataFrame:
    """concept_id, rel_path, type, title, description, fields (JSON of the listed keys that exist, in order), frontmatter.

    Concepts without a type are left out; missing_type() has them. Bodies are read only if asked for.
    """
    own = F.json_object_keys("frontmatter")
    entries = [F.struct(F.lit(f).alias("key"), F.to_json(F.try_variant_get(F.try_parse_json("frontmatter"), path_of(f), "variant")).alias("value")) for f in fields]
    picked = F.filter(F.array(*entries), lambda e: F.array_contains(own, e["key"])) if fields else F.array().cast("array<struct<key:string,value:string>>")
    columns = ["concept_id", "rel_path", F.regexp_replace(value("type"), r"(?U)^\s+|\s+$", "").alias("type"), inline_value("title").alias("title"), inline_value("description").alias("description"), F.map_from_entries(picked).alias("fields"), "frontmatter"]
    return concepts.where(valid_type()).select(*columns, *(["body"] if with_content else []))


def missing_type(concepts: DataFrame) -> DataFrame:
    return concepts.where(~valid_type()).select("concept_id", "rel_path", F.lit("missing-type").alias("kind"))


def with_graph(listing: DataFrame, degrees: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """listing with outbound and inbound counts, and pagerank if given."""
    out = listing.join(degrees, "concept_id", "left")
    return out.join(ranks, "concept_id", "left") if ranks is not None else out
