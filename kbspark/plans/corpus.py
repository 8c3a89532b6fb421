"""Knowledge bundles made from relational tables, by expressions that Spark SQL and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"

DOCUMENT_ID = "coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/doc-' || doc_id"
DOCUMENT_TITLE = r"nullif(trim(regexp_extract(coalesce(text, ''), '^([^.\n]{1,40})[.\n]', 1)), '')"
DOCUMENT_FIELDS = f"coalesce('quality' || {NL} || quality || {NL} || 'toxic' || {NL} || toxic, '')"
DOCUMENT_FILE = f"'---' || {NL} || 'type: ' || coalesce(source, 'none') || {NL} || 'title: Doc ' || doc_id || {NL} || '---' || {NL} || coalesce(text, '')"

CUSTOMER_BODY = (
    f"'# ' || c_name || {NL} || {NL} || 'See [nation ' || c_nationkey || '](../nation/' || c_nationkey || '.md \"home\") and `[code](../nation/0.md)`.' || {NL} || {NL} || "
    f"'![img](../region/0.md) and ' || chr(92) || '[no](../region/1.md)' || {NL} || {NL} || '```' || {NL} || '[fenced](../region/1.md)' || {NL} || '```' || {NL} || "
    f"CASE WHEN c_custkey % 7 = 0 THEN {NL} || 'Also [gone][g' || c_custkey || '].' || {NL} || {NL} || '[g' || c_custkey || ']: missing-' || c_custkey || '.md' || {NL} ELSE '' END"
)
SUPPLIER_BODY = f"'Based in *[nation](/nation/' || s_nationkey || '.md#top)*.' || {NL}"
NATION_BODY = f"'- in [' || n_name || '](<../region/' || n_regionkey || '.md>)' || {NL} || '- [index](../index.md)' || {NL}"
REGION_BODY = f"'Region ' || r_name || '.' || {NL}"
PART_BODY = f"'Part, see <https://example.com/' || p_partkey || '.md>.' || {NL}"

#: Table, key, folder, title and body of each kind of concept in the graph bundle.
KINDS = (
    ("customer", "c_custkey", "c_name", CUSTOMER_BODY),
    ("supplier", "s_suppkey", "s_name", SUPPLIER_BODY),
    ("nation", "n_nationkey", "n_name", NATION_BODY),
    ("region", "r_regionkey", "r_name", REGION_BODY),
    ("part", "p_partkey", "p_name", PART_BODY),
)


#: Tables whose rows are or become texts that Python parses.
DEALT = ("documents", "pages", "conversations", "customer", "supplier", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files split it. If a session sets kbspark.scanPartitions, tables of texts are dealt to so many tasks."""
    rows, parts = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get("kbspark.scanPartitions", None)
    return rows.repartition(int(parts)) if parts and name in DEALT else rows


def head_of(kind: str) -> str:
    return f"'---' || {NL} || 'type: {kind}' || {NL} || '---' || {NL}"


def graph_bundle(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("customer", "supplier", "nation", "region", "part")) -> DataFrame:
    """concept_id, rel_path, title, body, content of concepts that link as the tables' foreign keys do."""
    parts = []
    for name, key, title, body in KINDS:
        if name in kinds:
            rows = table(spark, sf_dir, name)
            parts.append(rows.select(F.expr(f"'{name}/' || {key}").alias("concept_id"), F.expr(f"'{name}/' || {key} || '.md'").alias("rel_path"), F.expr(title).alias("title"), F.expr(body).alias("body"), F.expr(f"{head_of(name)} || {body}").alias("content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_sql(kinds: tuple[str, ...] = ("customer", "supplier", "nation", "region", "part")) -> str:
    return " UNION ALL ".join(f"SELECT '{name}/' || {key} AS concept_id, '{name}/' || {key} || '.md' AS rel_path, {body} AS body, {head_of(name)} || {body} AS content FROM {name}" for name, key, _, body in KINDS if name in kinds)


#: The edges of the graph bundle, from the columns that its bodies are made from.
EDGES_SQL = """
SELECT 'customer/' || c_custkey AS source_concept_id, 'nation/' || c_nationkey AS target_concept_id, 'nation ' || c_nationkey AS text, '../nation/' || c_nationkey || '.md' AS target, 'home' AS title FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'nation', '/nation/' || s_nationkey || '.md#top', NULL FROM supplier
UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, n_name, '../region/' || n_regionkey || '.md', NULL FROM nation
"""


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(F.expr(DOCUMENT_ID).alias("concept_id"), F.expr(DOCUMENT_TITLE).alias("title"), F.col("lang").alias("description"), F.expr(DOCUMENT_FIELDS).alias("fields"), F.col("text").alias("body"))


SEARCH_SQL = f"SELECT {DOCUMENT_ID} AS concept_id, {DOCUMENT_TITLE} AS title, lang AS description, {DOCUMENT_FIELDS} AS fields, text AS body FROM documents LEFT JOIN labels USING (doc_id)"


def files(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with rel_path and text as the files that a scan reads."""
    raw = F.encode(F.col(content), "UTF-8")
    return rows.select("rel_path", F.lit(0).cast("long").alias("mtime_ms"), F.octet_length(raw).cast("long").alias("size"), raw.alias("content"))
