"""Validation rules as tables of findings: concept_id, severity, field, message, line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile, Taxonomy
from ..functions import markdown
from .listing import kind_of, valid_type, value

#: Fields that every document may have.
STANDARD = ("type", "title", "description", "resource", "tags", "timestamp")


def _findings(rows: DataFrame, severity: str, field: Column, message: Column, line: Column | None = None) -> DataFrame:
    return rows.select("concept_id", F.lit(severity).alias("severity"), field.alias("field"), message.alias("message"), (line if line is not None else F.lit(None)).cast("long").alias("line"))


def base(concepts: DataFrame) -> DataFrame:
    absent = F.coalesce(kind_of("type"), F.lit("VOID")) == "VOID"
    rows = concepts.where(~valid_type())
    return _findings(rows, "error", F.lit("type"), F.when(absent, "Missing required frontmatter field: type").otherwise("Frontmatter field 'type' must be a non-empty string"))


def stated_type() -> Column:
    return F.when(valid_type(), F.regexp_replace(value("type"), r"(?U)^\s+|\s+$", ""))


def taxonomy(concepts: DataFrame, profile: Profile, project: Taxonomy = Taxonomy(), of_folders: bool = False) -> DataFrame:
    """Types that aren't allowed, or, where none are listed as allowed, aren't known. A profile's lists win.

    of_folders: the rows are what folders say about themselves; their types with a leading underscore are free.
    """
    allowed = profile.taxonomy.allowed_types or project.allowed_types
    known = profile.taxonomy.known_types or project.known_types
    rows = concepts.withColumn("_type", stated_type()).where(F.col("_type").isNotNull())
    rows = rows.where(~F.startswith("_type", F.lit("_"))) if of_folders else rows
    if allowed:
        return _findings(rows.where(~F.col("_type").isin(*allowed)), "error", F.lit("type"), F.concat(F.lit("Concept type '"), "_type", F.lit("' is not allowed by this profile")))
    if known:
        return _findings(rows.where(~F.col("_type").isin(*known)), "warning", F.lit("type"), F.concat(F.lit("Concept type '"), "_type", F.lit("' is not recognized as a known type")))
    return _findings(rows.limit(0), "warning", F.lit("type"), F.lit(""))


def _by_type(profile: Profile, fields: str, common: tuple[str, ...]) -> Column:
    """The array of fields for a row's type: the profile's, then its type's own."""
    out = F.array(*[F.lit(f) for f in common]).cast("array<string>")
    for kind, own in profile.types.items():
        out = F.when(stated_type() == kind, F.array(*[F.lit(f) for f in dict.fromkeys((*common, *getattr(own, fields)))]).cast("array<string>")).otherwise(out)
    return out


def required_fields(concepts: DataFrame, profile: Profile) -> DataFrame:
    """Fields that are missing, null or blank. What each row needs is one array; nothing is joined."""
    wanted = F.filter(_by_type(profile, "required", profile.required), lambda f: f != "type")
    rows = concepts.select("concept_id", "frontmatter", F.explode(wanted).alias("_field"))
    held = F.try_variant_get(F.try_parse_json("frontmatter"), F.concat(F.lit("$['"), F.col("_field"), F.lit("']")), "variant")
    kind, content = F.coalesce(F.schema_of_variant(held), F.lit("VOID")), F.try_variant_get(held, "$", "string")
    rows = rows.withColumns({"_missing": kind == "VOID", "_blank": (kind == "STRING") & (F.regexp_replace(content, r"(?U)\s+", "") == "")}).where("_missing OR _blank")
    return _findings(rows, "error", F.col("_field"), F.when(F.col("_missing"), F.concat(F.lit("Missing required frontmatter field: "), "_field")).otherwise(F.concat(F.lit("Required frontmatter field '"), "_field", F.lit("' must be a non-empty string"))))


def unknown_fields(concepts: DataFrame, profile: Profile) -> DataFrame:
    common = (*STANDARD, *profile.required, *profile.fields)
    defined = F.array_union(_by_type(profile, "required", common), _by_type(profile, "fields", common))
    rows = concepts.select("concept_id", F.explode(F.array_except(F.json_object_keys("frontmatter"), defined)).alias("_field"))
    return _findings(rows, "warning", F.col("_field"), F.concat(F.lit("Unknown frontmatter field: "), "_field"))


def footnotes(concepts: DataFrame) -> DataFrame:
    """concept_id, label, line, is_definition of every footnote mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, *f) for c, body in zip(batch["concept_id"], batch["body"], strict=True) for f in markdown.footnotes(body or "")]
            yield pd.DataFrame(rows, columns=["concept_id", "label", "line", "is_definition"])

    return concepts.select("concept_id", "body").mapInPandas(run, "concept_id string, label string, line long, is_definition boolean")


def attribution(concepts: DataFrame) -> DataFrame:
    """Footnotes without a source of their id (error), and sources that no footnote cites (warning)."""
    sources = F.try_variant_get(F.try_parse_json("frontmatter"), "$.sources", "array<variant>")
    ids = F.transform(sources, lambda s: F.when(F.schema_of_variant(F.try_variant_get(s, "$.id", "variant")) == "STRING", F.try_variant_get(s, "$.id", "string")))
    declared = concepts.select("concept_id", F.explode(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (F.trim(i) != "")))).alias("label"))
    marks = footnotes(concepts)
    loose = marks.join(declared, ["concept_id", "label"], "left_anti")
    idle = declared.join(marks, ["concept_id", "label"], "left_anti")
    errors = _findings(loose, "error", F.col("label"), F.concat(F.lit("Footnote label '"), "label", F.lit("' has no matching sources[].id")), F.col("line"))
    return errors.unionByName(_findings(idle, "warning", F.col("label"), F.concat(F.lit("sources[].id '"), "label", F.lit("' is not referenced by any footnote"))))


def documents(concepts: DataFrame, profile: Profile | None = None, project: Taxonomy = Taxonomy()) -> DataFrame:
    """All findings about documents: the base rule, the profile's if there is one, and attribution."""
    found = base(concepts)
    if profile is not None:
        found = found.unionByName(taxonomy(concepts, profile, project)).unionByName(required_fields(concepts, profile)).unionByName(unknown_fields(concepts, profile))
    return found.unionByName(attribution(concepts))


def bundle(concepts: DataFrame, problems: DataFrame, profile: Profile | None = None, project: Taxonomy = Taxonomy()) -> DataFrame:
    """rel_path, severity, field, message, line: findings of documents replace what a scan said about their path.

    Of several scan problems of a path the last by kind counts.
    """
    last = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("kind"), F.desc("message")))
    scan = problems.withColumn("_n", last).where("_n = 1").select("rel_path", F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field"), F.concat(F.lit("Scan error ("), "kind", F.lit("): "), "message").alias("message"), F.lit(None).cast("long").alias("line"))
    own = documents(concepts, profile, project).join(concepts.select("concept_id", "rel_path"), "concept_id").drop("concept_id").select("rel_path", "severity", "field", "message", "line")
    return scan.join(own.select("rel_path").distinct(), "rel_path", "left_anti").unionByName(own)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
