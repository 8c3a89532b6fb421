"""Index and log documents as tables, generated indexes, and drift between the two."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import frontmatter, index_doc, log_doc
from ..functions.markdown import normalise_href
from ..functions.paths import is_reserved


def parse_indexes(indexes: DataFrame) -> DataFrame:
    """dir, ordinal, heading, title, link, description, problem, line from dir and content; an entry or a problem a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for folder, content in zip(batch["dir"], batch["content"], strict=True):
                entries, problems = index_doc.parse(content or "")
                out += [(folder, i, e.heading, e.title, e.link, e.description, None, None) for i, e in enumerate(entries)]
                out += [(folder, None, h, None, None, None, message, line) for h, line, message in problems]
            yield pd.DataFrame(out, columns=["dir", "ordinal", "heading", "title", "link", "description", "problem", "line"]).astype({"ordinal": "Int64", "line": "Int64"})

    return indexes.select("dir", "content").mapInPandas(run, "dir string, ordinal long, heading string, title string, link string, description string, problem string, line long")


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else index_doc.heading_of(x))


@F.pandas_udf(StringType())
def href_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalise_href(x))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")


def concept_directories(listing: DataFrame) -> DataFrame:
    """dir of every folder that holds a concept at any depth; the root is empty."""
    parts = F.split("rel_path", "/")
    return listing.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).distinct()


def parse_sidecars(sidecars: DataFrame) -> DataFrame:
    """dir, title, description, problem from dir and content: what a folder says about itself in YAML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for folder, content in zip(batch["dir"], batch["content"], strict=True):
                try:
                    values = frontmatter.parse(f"---\n{content or ''}\n---\n").frontmatter
                    line = {k: " ".join(str(values[k]).split()) or None for k in ("title", "description") if values.get(k) is not None}
                    out.append((folder, line.get("title"), line.get("description"), None))
                except frontmatter.DocumentParseError as e:
                    out.append((folder, None, None, str(e)))
            yield pd.DataFrame(out, columns=["dir", "title", "description", "problem"])

    return sidecars.select("dir", "content").mapInPandas(run, "dir string, title string, description string, problem string")


def reserved_files(files: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """dir and filename of the files that no index lists, as their names are reserved."""
    held = files.where(is_reserved(F.col("rel_path"), reserved))
    return held.select(folder_of(F.col("rel_path")).alias("dir"), F.substring_index("rel_path", "/", -1).alias("filename"))


def generate_entries(listing: DataFrame, sidecars: DataFrame | None = None, describe: Callable[[str], str | None] | None = None) -> DataFrame:
    """dir, heading, title, link, description, ordinal: what a fresh index of each folder lists.

    A folder's own concepts stand under their type, by lower-cased title; the folders in it that hold concepts under
    Subdirectories, with the title and description of their sidecar (dir, title, description) if there is one; describe is
    asked, by its path, about a folder without a description, and its answer becomes one line. listing has concept_id,
    rel_path, type, title, description.
    """
    name = F.substring_index("rel_path", "/", -1)
    own = listing.select(folder_of(F.col("rel_path")).alias("dir"), F.lit(0).alias("last"), F.col("type").alias("kind"), title_case(F.col("type")).alias("heading"), F.coalesce("title", F.substring_index("concept_id", "/", -1)).alias("title"), href_of(name).alias("link"), "description")
    below = concept_directories(listing).where("dir != ''")
    told = sidecars.select("dir", F.col("title").alias("_title"), F.col("description").alias("_told")) if sidecars is not None else None
    none = F.lit(None).cast("string")
    below = below.join(told, "dir", "left") if told is not None else below.withColumns({"_title": none, "_told": none})
    name = F.substring_index("dir", "/", -1)
    if describe is not None:
        asked = F.pandas_udf(lambda folders: folders.map(lambda d: " ".join((describe(d) or "").split()) or None), "string")
        below = below.withColumn("_told", F.coalesce("_told", asked("dir")))
    below = below.select(folder_of(F.col("dir")).alias("dir"), F.lit(1).alias("last"), F.lit("").alias("kind"), F.lit("Subdirectories").alias("heading"), F.coalesce("_title", name).alias("title"), href_of(F.concat(name, F.lit("/"))).alias("link"), F.col("_told").alias("description"))
    return own.unionByName(below)


def order_entries(entries: DataFrame) -> DataFrame:
    order = Window.partitionBy("dir").orderBy("last", "kind", F.lower("title"), "link")
    return entries.withColumn("ordinal", F.row_number().over(order) - 1)


def render_indexes(entries: DataFrame) -> DataFrame:
    """dir and body of generated indexes. A folder is one document, so its entries meet in one row."""

    @F.pandas_udf("string")
    def line(title: pd.Series, link: pd.Series, description: pd.Series) -> pd.Series:
        return pd.Series([index_doc.render_entry(t, u, d) for t, u, d in zip(title, link, description, strict=True)])

    lines = entries.select("dir", F.struct("last", "kind", F.lower("title").alias("l"), F.col("link").alias("u"), "heading", line("title", "link", "description").alias("line")).alias("e"))
    grouped = lines.groupBy("dir").agg(F.sort_array(F.collect_list("e")).alias("es"))
    text = F.aggregate("es", F.struct(F.lit("").alias("body"), F.lit(None).cast("string").alias("kind")), lambda s, e: F.struct(F.concat(s["body"], F.when(s["kind"].eqNullSafe(F.concat(e["last"].cast("string"), e["kind"])), "").otherwise(F.concat(F.when(s["body"] == "", "").otherwise("\n"), F.lit("# "), e["heading"], F.lit("\n\n"))), e["line"], F.lit("\n")).alias("body"), F.concat(e["last"].cast("string"), e["kind"]).alias("kind")), lambda s: s["body"])
    return grouped.select("dir", text.alias("body"))


def drift(generated: DataFrame, indexes: DataFrame) -> DataFrame:
    """dir, link, finding: missing, dropped, stale or malformed. Entries are matched by link; of repeats the last counts.

    indexes has dir and content of the committed ones. Folders without one are left out.
    """
    committed = parse_indexes(indexes)
    last = F.max(F.struct("ordinal", "heading", "title", "description"))
    new = generated.groupBy("dir", "link").agg(F.max(F.struct("heading", "title", "description")).alias("g"))
    old = committed.where("problem IS NULL").groupBy("dir", "link").agg(last.alias("c"))
    both = new.join(indexes.select("dir"), "dir", "left_semi").join(old, ["dir", "link"], "full_outer")
    differ = ~(F.col("g.heading").eqNullSafe(F.col("c.heading")) & F.col("g.title").eqNullSafe(F.col("c.title")) & F.col("g.description").eqNullSafe(F.col("c.description")))
    finding = F.when(F.col("c").isNull(), "missing").when(F.col("g").isNull(), "dropped").when(differ, "stale")
    found = both.select("dir", "link", finding.alias("finding")).where(F.col("finding").isNotNull())
    return found.unionByName(committed.where("problem IS NOT NULL").select("dir", F.lit(None).cast("string").alias("link"), F.lit("malformed").alias("finding")))


def parse_logs(logs: DataFrame) -> DataFrame:
    """rel_path, title, section, date, entry, label, text, problem, line from rel_path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                log = log_doc.parse(content or "")
                out += [(path, log.title, s, date, i, e.label, e.text, None, None) for s, (date, entries) in enumerate(log.sections) for i, e in enumerate(entries)]
                out += [(path, log.title, None, date, None, None, None, message, line) for date, line, message in log.problems]
            yield pd.DataFrame(out, columns=["rel_path", "title", "section", "date", "entry", "label", "text", "problem", "line"]).astype({"section": "Int64", "entry": "Int64", "line": "Int64"})

    return logs.select("rel_path", "content").mapInPandas(run, "rel_path string, title string, section long, date string, entry long, label string, text string, problem string, line long")


def render_log(entries: DataFrame) -> DataFrame:
    """rel_path and content from rel_path, title, date, entry, label, text: sections from new to old."""
    line = F.concat(F.lit("* "), F.when(F.col("label").isNotNull(), F.concat(F.lit("**"), "label", F.lit("**: "))).otherwise(""), "text")
    sections = entries.groupBy("rel_path", "title", "date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    sections = sections.groupBy("rel_path", "title").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("date", "lines")))), lambda s: F.concat(F.lit("## "), s["date"], F.lit("\n"), s["lines"], F.lit("\n"))).alias("ss"))
    return sections.select("rel_path", F.concat(F.coalesce(F.concat(F.lit("# "), "title", F.lit("\n\n")), F.lit("")), F.array_join("ss", "\n")).alias("content"))
