"""The engine's operators over the driver's tables, each with DuckDB SQL that computes the same rows without parsing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bundle, Profile, Taxonomy, TypeFields
from ..functions import log_doc, markdown, patching, paths, text
from ..operators import context, documents, links, listing, mentions, search, validate, writes
from ..sources import bundle as scan
from ..sources import cache
from ..sources.scratch import fresh_path
from .corpus import CUSTOMER_BODY, DOCUMENT_FILE, DOCUMENT_ID, EDGES_SQL, KINDS, NL, SEARCH_SQL, files, graph_bundle, graph_sql, search_rows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- search ----

TERMS, ZERO_TERMS = "reedes the", "the nonexistentword"
_BM25 = f"""
WITH d AS ({SEARCH_SQL}),
tk AS (SELECT concept_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(fields, '') || ' ' || coalesce(body, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term FROM d),
dl AS (SELECT d.concept_id, count(term) AS dl FROM d LEFT JOIN tk USING (concept_id) GROUP BY d.concept_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT concept_id, term, count(*) AS f FROM tk WHERE term IN ('reedes', 'the') GROUP BY concept_id, term),
df AS (SELECT term, count(*) AS nt FROM tf GROUP BY term),
hit AS (SELECT concept_id, sum(-(CASE WHEN ln((n - nt + 0.5) / (nt + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nt + 0.5) / (nt + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN dl USING (concept_id), st GROUP BY concept_id HAVING count(*) = 2)
"""


@query(_BM25 + "SELECT concept_id, round(score, 6) AS score FROM hit ORDER BY hit.score, concept_id LIMIT 10")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(search_rows(spark, sf_dir), TERMS)
    return hits.orderBy("score", "concept_id").limit(10).select("concept_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT concept_id, round(score, 6) AS score FROM hit")
def search_bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(search_rows(spark, sf_dir), TERMS).select("concept_id", F.round("score", 6).alias("score"))


@query("SELECT ''::VARCHAR AS concept_id, 0.0::DOUBLE AS score WHERE 1 = 0")
def search_zero_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(search_rows(spark, sf_dir), ZERO_TERMS)


@query(f"""
WITH d AS ({SEARCH_SQL}), tk AS (SELECT concept_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(fields, '') || ' ' || coalesce(body, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term FROM d)
SELECT term, count(DISTINCT concept_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM tk GROUP BY term
""")
def fts_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search_rows(spark, sf_dir).select("concept_id", F.explode(search.row_tokens()).alias("term"))
    return words.groupBy("term", "concept_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(_BM25 + "SELECT concept_id, round(score, 6) AS score FROM hit")
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with marks, in the query and, as one character or two, in the texts, are found as those without."""
    rows = search_rows(spark, sf_dir)
    marks = lambda c: F.when(F.length(c) % 2 == 0, F.translate(c, "eEo", "éÉö")).otherwise(F.replace(c, F.lit("e"), F.lit("e\u0301")))
    return search.bm25(rows.withColumn("body", marks("body")), "réedes TḢE").select("concept_id", F.round("score", 6).alias("score"))


@query()
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search_rows(spark, sf_dir), TERMS, 10).select("concept_id", "title", F.round("score", 6).alias("score"), "snippet")


# ---- scan and listing ----


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of a bundle at two times: of the second a tenth is gone, a third changed, another tenth new."""
    base = "'---' || chr(10) || 'type: customer' || chr(10) || 'sid: ' || {} || chr(10) || '---' || chr(10) || c_name"
    rows = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 10)
    made = lambda r, sid, time: r.select(F.expr("'customer/' || c_custkey || '.md'").alias("rel_path"), F.expr(time).cast("long").alias("mtime_ms"), F.expr(base.format(sid)).alias("text"))
    of = lambda r: r.select("rel_path", "mtime_ms", F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return of(made(rows.where("k != 9"), "c_custkey", "1")), of(made(rows.where("k != 8"), _SID, "CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END"))


#: Stable ids at the second time: of changed customers some are blank and some are those of others.
_SID = "CASE WHEN c_custkey % 3 != 0 OR c_custkey % 10 = 9 THEN '' || c_custkey WHEN c_custkey % 2 = 0 THEN '' || (c_custkey + 1) ELSE chr(39) || chr(39) END"


@query(f"""
WITH c AS (SELECT 'customer/' || c_custkey || '.md' AS rel_path, nullif({_SID}, chr(39) || chr(39)) AS sid FROM customer WHERE c_custkey % 10 != 8)
SELECT sid AS stable_id, rel_path FROM c WHERE sid IN (SELECT sid FROM c GROUP BY sid HAVING count(*) > 1)
""")
def stable_id_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stable_id_members(scan.manifest_of(_versions(spark, sf_dir)[1], Bundle("customers", "/customers", stable_id_field="sid")).concepts)


@query(f"""
WITH c AS (SELECT 'customer/' || c_custkey || '.md' AS rel_path, nullif({_SID}, chr(39) || chr(39)) AS sid FROM customer WHERE c_custkey % 10 != 8),
n AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM c)
SELECT rel_path, coalesce(sid, '') AS sid, CASE WHEN sid IS NULL THEN 'stable-id-missing' WHEN n > 1 THEN 'stable-id-conflict' ELSE '' END AS kind FROM n
""")
def refresh_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second refresh parses what changed, and judges the stable ids of all."""
    first, second = _versions(spark, sf_dir)
    bundle = Bundle("customers", "/customers", stable_id_field="sid")
    cached = scan.manifest_of(first, bundle).concepts
    changed = second.join(cached.select(*cache.KEYS), cache.KEYS, "left_anti")
    found = cache.snapshot_manifest(*cache.settle(cached, second, changed, bundle), bundle)
    return found.concepts.select("rel_path", F.coalesce("stable_id", F.lit("")).alias("sid")).join(found.problems.select("rel_path", "kind"), "rel_path", "left").fillna("", ["kind"])


@query(f"SELECT {DOCUMENT_ID} AS concept_id, octet_length(encode({DOCUMENT_FILE}))::BIGINT AS size, sha256({DOCUMENT_FILE}) AS sha256, length(coalesce(text, ''))::BIGINT AS body_chars FROM documents")
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.expr(f"{DOCUMENT_ID} || '.md'").alias("rel_path"), F.expr(DOCUMENT_FILE).alias("content"))
    found = scan.manifest_of(files(rows), Bundle("documents", "/documents"))
    return found.concepts.select("concept_id", "size", "sha256", F.char_length("body").cast("long").alias("body_chars"))


_FAULTY = f"CASE c_custkey % 5 WHEN 0 THEN '---' || {NL} || 'type: x' || {NL} WHEN 1 THEN '---' || {NL} || '- a list' || {NL} || '---' || {NL} WHEN 2 THEN '---' || {NL} || 'a: 1' || {NL} || 'a: 2' || {NL} || '---' || {NL} WHEN 3 THEN 'no frontmatter' ELSE '---' || {NL} || 'type: [' || {NL} || '---' || {NL} END"


@query("SELECT 'c/' || c_custkey || '.md' AS rel_path, 'parse-error' AS kind FROM customer WHERE c_custkey % 5 <> 3")
def scan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey || '.md'").alias("rel_path"), F.expr(_FAULTY).alias("content"))
    return scan.manifest_of(files(rows), Bundle("faulty", "/faulty")).problems.select("rel_path", "kind")


@query("SELECT 'p/' || p_partkey || '.md' AS rel_path FROM part WHERE NOT (p_partkey % 3 = 0 AND p_size % 2 = 0) AND p_partkey % 10 <> 7 UNION ALL SELECT 'p/deep/er/' || p_partkey || '.md' FROM part WHERE p_partkey % 10 = 7")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "CASE WHEN p_partkey % 10 = 7 THEN 'p/deep/er/' || p_partkey || '.md' WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'p/' || p_partkey || '/INDEX.md' ELSE 'drafts/' || p_partkey || '.md' END ELSE 'p/' || p_partkey || '.md' END"
    rows = table(spark, sf_dir, "part").select(F.expr(path).alias("rel_path"))
    return rows.where(scan.chosen(F.col("rel_path"), Bundle("parts", "/parts", exclude=("drafts/**", "p/deep/**"))))


_TYPED = "CASE c_custkey % 6 WHEN 0 THEN '{' WHEN 1 THEN '{\"type\":\"  \",' WHEN 2 THEN '{\"type\":7,' ELSE '{\"type\":\" ' || c_mktsegment || ' \",' END || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '\"title\":null,' WHEN 2 THEN '\"title\":\" Mr ' || c_name || '\",' ELSE '\"title\":' || c_custkey || ',' END || '\"owner\":\"' || c_nationkey || '\",\"done\":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey").alias("concept_id"), F.expr("'c/' || c_custkey || '.md'").alias("rel_path"), F.expr(_TYPED).alias("frontmatter"), F.lit("").alias("body"), "c_custkey")


@query("""SELECT 'c/' || c_custkey AS concept_id, c_mktsegment AS type, CASE c_custkey % 4 WHEN 2 THEN 'Mr ' || c_name WHEN 3 THEN c_custkey::VARCHAR END AS title, NULL::VARCHAR AS description FROM customer WHERE c_custkey % 6 > 2""")
def list_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_concepts(_typed(spark, sf_dir)).select("concept_id", "type", "title", "description")


@query("""SELECT 'c/' || c_custkey AS concept_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'title=null,' WHEN 2 THEN 'title=" Mr ' || c_name || '",' ELSE 'title=' || c_custkey || ',' END || 'owner="' || c_nationkey || '"' AS fields FROM customer WHERE c_custkey % 6 > 2""")
def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_concepts(_typed(spark, sf_dir), ("title", "absent", "owner"))
    return rows.select("concept_id", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",").alias("fields"))


@query("SELECT 'c/' || c_custkey AS concept_id, 'missing-type' AS kind FROM customer WHERE c_custkey % 6 <= 2")
def list_missing_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.missing_type(_typed(spark, sf_dir)).select("concept_id", "kind")


@query("SELECT 'c/' || c_custkey || '.md' AS rel_path, c_nationkey::VARCHAR AS stable_id, (count(*) OVER (PARTITION BY c_nationkey) - 1)::BIGINT AS others FROM customer QUALIFY others > 0")
def stable_id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stable_id_conflicts(scan.stable_ids(_typed(spark, sf_dir), "owner")).select("rel_path", "stable_id", "others")


@query("SELECT o_orderkey::VARCHAR AS rel_path, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderkey % 10 = 1 THEN 'gone' WHEN o_orderkey % 10 = 2 THEN 'changed' ELSE 'fresh' END AS state FROM orders")
def cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_orderkey").alias("k"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime_ms"), F.col("o_custkey").alias("size"))
    listed = rows.where("k % 10 <> 1").withColumn("size", F.when(F.col("k") % 10 == 2, F.col("size") + 1).otherwise(F.col("size")))
    return cache.diff(rows.where("k % 10 <> 0"), listed)


# ---- graph ----


def _graph(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("customer", "supplier", "nation", "region", "part")) -> links.Graph:
    return links.build(graph_bundle(spark, sf_dir, kinds))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the whole bundle, found in its texts."""
    return _graph(spark, sf_dir).links.select("source_concept_id", "target_concept_id")


@query(EDGES_SQL)
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).links.select("source_concept_id", "target_concept_id", "text", "target", "title")


@query("SELECT 'customer/' || c_custkey AS source_concept_id, 'customer/missing-' || c_custkey AS target_concept_id, 'missing-' || c_custkey || '.md' AS target, 'gone' AS text FROM customer WHERE c_custkey % 7 = 0")
def graph_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).broken.select("source_concept_id", "target_concept_id", "target", "text")


_HREFS = "CASE c_custkey % 9 WHEN 0 THEN './x%20y.md' WHEN 1 THEN '/root.md#intro' WHEN 2 THEN '../../out.md' WHEN 3 THEN 'https://e.com/a.md' WHEN 4 THEN 'a%2Fb.md' WHEN 5 THEN 'index.md' WHEN 6 THEN 'x.txt' WHEN 7 THEN '../nation/1.md?q=1' ELSE 'bad%00name.md' END"


@query("""SELECT 'customer/' || c_custkey AS source_concept_id, CASE c_custkey % 9 WHEN 0 THEN 'customer/x y.md' WHEN 1 THEN 'root.md' WHEN 2 THEN '../out.md' WHEN 7 THEN 'nation/1.md' END AS target_path,
CASE c_custkey % 9 WHEN 0 THEN 'customer/x y' WHEN 1 THEN 'root' WHEN 7 THEN 'nation/1' END AS target_concept_id FROM customer WHERE c_custkey % 9 IN (0, 1, 2, 7)""")
def href_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.expr("'customer/' || c_custkey").alias("concept_id"), F.expr("'customer/' || c_custkey || '.md'").alias("rel_path"), F.expr(f"'[x](' || {_HREFS} || ')'").alias("body"))
    return links.extract(rows).select("source_concept_id", "target_path", "target_concept_id")


@query(f"SELECT source_concept_id, target_concept_id, target FROM ({EDGES_SQL}) WHERE source_concept_id = 'nation/7'")
def links_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links_from(_graph(spark, sf_dir).links, "nation/7").select("source_concept_id", "target_concept_id", "target")


@query(f"SELECT source_concept_id, target_concept_id, target FROM ({EDGES_SQL}) WHERE target_concept_id = 'nation/7'")
def backlinks_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks_to(_graph(spark, sf_dir).links, "nation/7").select("source_concept_id", "target_concept_id", "target")


@query(f"""WITH e AS ({EDGES_SQL}), c AS (SELECT concept_id FROM ({graph_sql()}))
SELECT concept_id, coalesce(o, 0)::BIGINT AS outbound, coalesce(i, 0)::BIGINT AS inbound FROM c LEFT JOIN (SELECT source_concept_id AS concept_id, count(*) AS o FROM e GROUP BY 1) USING (concept_id) LEFT JOIN (SELECT target_concept_id AS concept_id, count(*) AS i FROM e GROUP BY 1) USING (concept_id)""")
def degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.degrees(graph_bundle(spark, sf_dir), _edges(spark, sf_dir))


@query(f"SELECT concept_id FROM ({graph_sql()}) ANTI JOIN (SELECT source_concept_id AS concept_id FROM ({EDGES_SQL}) UNION SELECT target_concept_id FROM ({EDGES_SQL})) USING (concept_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.orphans(graph_bundle(spark, sf_dir), _edges(spark, sf_dir))


_BOTH_WAYS = f"p AS (SELECT source_concept_id AS a, target_concept_id AS b FROM ({EDGES_SQL}) UNION SELECT target_concept_id, source_concept_id FROM ({EDGES_SQL}))"


@query(f"""WITH {_BOTH_WAYS}, one AS (SELECT b FROM p WHERE a = 'nation/7'), two AS (SELECT b FROM p WHERE a IN (SELECT b FROM one))
SELECT concept_id, min(d)::INTEGER AS distance FROM (SELECT 'nation/7' AS concept_id, 0 AS d UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two) GROUP BY 1""")
def neighborhood_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.neighborhood(graph_bundle(spark, sf_dir), _edges(spark, sf_dir), "nation/7", 2)


def _rank_sql(nodes: str, edges: str, rounds: int) -> str:
    return f"""
WITH RECURSIVE nodes AS ({nodes}), e AS (SELECT u, v, count(*) AS k FROM ({edges}) GROUP BY u, v), o AS (SELECT u, sum(k) AS total FROM e GROUP BY u), n AS (SELECT count(*) AS n FROM nodes),
r(i, id, p) AS (
  SELECT 0, id, 1.0::DOUBLE / n FROM nodes, n
  UNION ALL
  SELECT r.i + 1, r.id, 0.15 / n.n + 0.85 * (coalesce(x.s, 0) + (SELECT coalesce(sum(q.p), 0) FROM r q WHERE q.id NOT IN (SELECT u FROM o)) / n.n)
  FROM r LEFT JOIN (SELECT e.v, sum(r2.p * e.k / o.total) AS s FROM r r2 JOIN e ON r2.id = e.u JOIN o ON o.u = e.u GROUP BY e.v) x ON x.v = r.id, n WHERE r.i < {rounds})
SELECT id AS concept_id, round(p, 8) AS pagerank FROM r WHERE i = {rounds}"""


@query(_rank_sql("SELECT 'customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'region/' || r_regionkey FROM region UNION ALL SELECT 'part/' || p_partkey FROM part", f"SELECT source_concept_id AS u, target_concept_id AS v FROM ({EDGES_SQL})", 5))
def pagerank_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.pagerank(graph_bundle(spark, sf_dir), _edges(spark, sf_dir), iterations=5, tolerance=None).select("concept_id", F.round("pagerank", 8).alias("pagerank"))


@query(_rank_sql("SELECT 's/' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p/' || p_partkey FROM part", "SELECT 's/' || l_suppkey AS u, 'p/' || l_partkey AS v FROM lineitem UNION ALL SELECT 'p/' || l_partkey, 's/' || l_suppkey FROM lineitem WHERE l_linenumber = 1", 4))
def pagerank_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.expr("'s/' || s_suppkey").alias("concept_id")).union(table(spark, sf_dir, "part").select(F.expr("'p/' || p_partkey")))
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.expr("'s/' || l_suppkey").alias("source_concept_id"), F.expr("'p/' || l_partkey").alias("target_concept_id")).union(items.where("l_linenumber = 1").select(F.expr("'p/' || l_partkey"), F.expr("'s/' || l_suppkey")))
    return links.pagerank(nodes, edges, iterations=4, tolerance=None).select("concept_id", F.round("pagerank", 8).alias("pagerank"))


@query()
def pagerank_supply_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links in both directions, to the default tolerance; SQL can't express the rounds, tests hold it against a plain version."""
    nodes = table(spark, sf_dir, "supplier").select(F.expr("'s/' || s_suppkey").alias("concept_id")).union(table(spark, sf_dir, "part").select(F.expr("'p/' || p_partkey")))
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.expr("'s/' || l_suppkey").alias("source_concept_id"), F.expr("'p/' || l_partkey").alias("target_concept_id")).union(items.select(F.expr("'p/' || l_partkey"), F.expr("'s/' || l_suppkey")))
    return links.pagerank(nodes, edges).select("concept_id", F.round("pagerank", 8).alias("pagerank"))


# ---- context ----

SEEDS, BUDGET = ["nation/7", "region/1", "nation/7", "nowhere"], 12_000
_PACK = f"""
WITH e AS ({EDGES_SQL}), c AS (SELECT concept_id, length(content)::BIGINT AS char_count FROM ({graph_sql()})),
w AS (SELECT source_concept_id AS a, target_concept_id AS b, 0 AS way FROM e UNION SELECT target_concept_id, source_concept_id, 1 FROM e),
f0 AS (SELECT 'nation/7' AS concept_id, 0 AS distance, 'seed' AS reason, 0 AS pos UNION ALL SELECT 'region/1', 0, 'seed', 1),
f1 AS (SELECT b AS concept_id, 1 AS distance, CASE WHEN way = 0 THEN 'outbound-link' ELSE 'backlink' END AS reason, 0 AS pos FROM w JOIN f0 ON f0.concept_id = a WHERE b NOT IN (SELECT concept_id FROM f0) QUALIFY row_number() OVER (PARTITION BY b ORDER BY f0.pos, way) = 1),
f2 AS (SELECT b AS concept_id, 2 AS distance, CASE WHEN way = 0 THEN 'outbound-link' ELSE 'backlink' END AS reason, 0 AS pos FROM w JOIN f1 ON f1.concept_id = a WHERE b NOT IN (SELECT concept_id FROM f0 UNION SELECT concept_id FROM f1) QUALIFY row_number() OVER (PARTITION BY b ORDER BY a, way) = 1),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2),
s AS (SELECT concept_id, reason, distance::INTEGER AS distance, char_count, (row_number() OVER o - 1)::INTEGER AS position, CASE WHEN sum(char_count) OVER o <= {BUDGET} THEN 'entry' ELSE 'omitted' END AS status FROM f JOIN c USING (concept_id) WINDOW o AS (ORDER BY distance, pos, concept_id))
"""


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.pack(graph_bundle(spark, sf_dir), _edges(spark, sf_dir), SEEDS, depth=2, budget=BUDGET)


@query(_PACK + "SELECT * FROM s WHERE status = 'entry'")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).where("status = 'entry'")


@query(_PACK + "SELECT concept_id, position FROM s WHERE status = 'omitted'")
def context_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).where("status = 'omitted'").select("concept_id", "position")


@query("SELECT 'nowhere' AS concept_id, 'unknown-seed' AS kind")
def context_unknown_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.resolve_seeds(graph_bundle(spark, sf_dir), SEEDS)[1]


# ---- mentions ----

_MENTIONING = "'Ships to ' || n_name || ' and [' || r_name || '](../region/' || r_regionkey || '.md) but not `' || c_mktsegment || '`.'"
_MENTION_SQL = """
WITH s AS (SELECT 'customer/' || c_custkey AS source_concept_id, 'region/' || r_regionkey AS linked, regexp_extract_all(lower('ships to ' || n_name || ' and ' || r_name || ' but not'), '[\\p{L}\\p{N}]+') AS words FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT 'nation/' || n_nationkey AS target_concept_id, n_name AS target_title FROM nation UNION ALL SELECT 'region/' || r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT 'segment/' || c_mktsegment, c_mktsegment FROM customer),
m AS (SELECT source_concept_id, target_concept_id, target_title FROM s, t WHERE list_has_all(words, regexp_extract_all(lower(target_title), '[\\p{L}\\p{N}]+')) AND linked <> target_concept_id)
"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sources = named.select(F.expr("'customer/' || c_custkey").alias("concept_id"), F.expr("'customer/' || c_custkey || '.md'").alias("rel_path"), F.expr(_MENTIONING).alias("body"))
    titles = nation.select(F.expr("'nation/' || n_nationkey").alias("concept_id"), F.col("n_name").alias("title")).union(region.select(F.expr("'region/' || r_regionkey"), "r_name")).union(customer.select(F.expr("'segment/' || c_mktsegment"), "c_mktsegment").distinct())
    return mentions.unlinked_mentions(titles, mentions.visible_prose(sources), links.extract(sources))


@query(_MENTION_SQL + "SELECT * FROM m")
def unlinked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


@query(_MENTION_SQL + "SELECT m.* FROM m JOIN customer ON source_concept_id = 'customer/' || c_custkey AND target_concept_id = 'nation/' || (c_custkey % 25)")
def suggestion_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.expr("'customer/' || c_custkey").alias("source_concept_id"), F.expr("'nation/' || (c_custkey % 25)").alias("target_concept_id"))
    return mentions.select_suggestions(_mentions(spark, sf_dir), wanted.union(wanted))[0]


# ---- validation ----

PROFILE = Profile(required=("type", "title"), fields=("done",), taxonomy=Taxonomy(known_types=("BUILDING", "MACHINERY", "AUTOMOBILE")), types={"MACHINERY": TypeFields(required=("plant",), fields=("owner",))})


def _checked(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return f(_typed(spark, sf_dir)).select("concept_id", "severity", "field", "message")


@query("""SELECT 'c/' || c_custkey AS concept_id, 'error' AS severity, 'type' AS field, CASE c_custkey % 6 WHEN 0 THEN 'Missing required frontmatter field: type' ELSE 'Frontmatter field ''type'' must be a non-empty string' END AS message FROM customer WHERE c_custkey % 6 <= 2""")
def validate_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, validate.base)


@query("""SELECT 'c/' || c_custkey AS concept_id, 'error' AS severity, 'title' AS field, 'Missing required frontmatter field: title' AS message FROM customer WHERE c_custkey % 4 < 2
UNION ALL SELECT 'c/' || c_custkey, 'error', 'plant', 'Missing required frontmatter field: plant' FROM customer WHERE c_custkey % 6 > 2 AND c_mktsegment = 'MACHINERY'""")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, lambda c: validate.required_fields(c, PROFILE))


@query("""SELECT 'c/' || c_custkey AS concept_id, 'warning' AS severity, 'owner' AS field, 'Unknown frontmatter field: owner' AS message FROM customer WHERE NOT (c_custkey % 6 > 2 AND c_mktsegment = 'MACHINERY')""")
def validate_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, lambda c: validate.unknown_fields(c, PROFILE))


@query("""SELECT 'c/' || c_custkey AS concept_id, 'warning' AS severity, 'type' AS field, 'Concept type ''' || c_mktsegment || ''' is not recognized as a known type' AS message FROM customer WHERE c_custkey % 6 > 2 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""")
def validate_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, lambda c: validate.taxonomy(c, PROFILE))


@query("""SELECT severity, sum(n)::BIGINT AS n FROM (
SELECT 'error' AS severity, count(*) AS n FROM customer WHERE c_custkey % 6 <= 2 UNION ALL SELECT 'error', count(*) FROM customer WHERE c_custkey % 4 < 2 UNION ALL SELECT 'error', count(*) FROM customer WHERE c_custkey % 6 > 2 AND c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'warning', count(*) FROM customer WHERE NOT (c_custkey % 6 > 2 AND c_mktsegment = 'MACHINERY') UNION ALL SELECT 'warning', count(*) FROM customer WHERE c_custkey % 6 > 2 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) GROUP BY severity""")
def validate_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.severity_counts(validate.documents(_typed(spark, sf_dir), PROFILE))


@query("""SELECT 'c/' || c_custkey || '.md' AS rel_path, 'error' AS severity, CASE WHEN c_custkey % 6 <= 2 THEN 'type' END AS field FROM customer WHERE c_custkey % 6 <= 2 OR c_custkey % 5 = 0""")
def validate_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    path = F.expr("'c/' || c_custkey || '.md'").alias("rel_path")
    problems = rows.select(path, F.lit("parse-error").alias("kind"), F.lit("a").alias("message")).union(rows.select(path, F.lit("read-error"), F.lit("b")))
    return validate.bundle(_typed(spark, sf_dir), problems).select("rel_path", "severity", "field")


_CITING = "'A claim.[^s' || (c_custkey % 3) || '] `[^code]`' || chr(10) || 'Another.[^s' || (c_custkey % 4) || ']'"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey").alias("concept_id"), F.expr("'{\"type\":\"x\",\"sources\":[{\"id\":\"s' || (c_custkey % 2) || '\",\"resource\":\"r\"},{\"resource\":\"q\"}]}'").alias("frontmatter"), F.expr(_CITING).alias("body"))


@query("SELECT 'c/' || c_custkey AS concept_id, 's' || (c_custkey % 3) AS label, 1::BIGINT AS line, false AS is_definition FROM customer UNION ALL SELECT 'c/' || c_custkey, 's' || (c_custkey % 4), 2, false FROM customer")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.footnotes(_cited(spark, sf_dir))


@query("""SELECT 'c/' || c_custkey AS concept_id, 'error' AS severity, 's' || (c_custkey % 3) AS field, 1::BIGINT AS line FROM customer WHERE c_custkey % 3 <> c_custkey % 2
UNION ALL SELECT 'c/' || c_custkey, 'error', 's' || (c_custkey % 4), 2 FROM customer WHERE c_custkey % 4 <> c_custkey % 2
UNION ALL SELECT 'c/' || c_custkey, 'warning', 's' || (c_custkey % 2), NULL FROM customer WHERE c_custkey % 2 NOT IN (c_custkey % 3, c_custkey % 4)""")
def attribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.attribution(_cited(spark, sf_dir)).select("concept_id", "severity", "field", "line")


# ---- index and log documents ----


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("p_type || '/' || p_brand || '/p-' || p_partkey || '.md'").alias("rel_path"), F.expr("p_type || '/' || p_brand || '/p-' || p_partkey").alias("concept_id"), F.expr("'kind-' || (p_size % 3) || ' b2c'").alias("type"), F.expr("p_name || ' ' || p_partkey").alias("title"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size END").alias("description"))


@query("""SELECT DISTINCT unnest(['', p_type, p_type || '/' || p_brand]) AS dir FROM part""")
def concept_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.concept_directories(_parts(spark, sf_dir))


_GENERATED = """
g AS (SELECT p_type || '/' || p_brand AS dir, 0 AS last, 'kind-' || (p_size % 3) || ' b2c' AS kind, 'Kind-' || (p_size % 3) || ' B2C' AS heading, p_name || ' ' || p_partkey AS title, 'p-' || p_partkey || '.md' AS link, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size END AS description FROM part
  UNION ALL SELECT DISTINCT p_type, 1, '', 'Subdirectories', p_brand, replace(p_brand, '#', '#') || '/', NULL FROM part UNION ALL SELECT DISTINCT '', 1, '', 'Subdirectories', p_type, p_type || '/', NULL FROM part)
"""


@query(f"WITH {_GENERATED} SELECT dir, heading, title, link, description, (row_number() OVER (PARTITION BY dir ORDER BY last, kind, lower(title), link) - 1)::INTEGER AS ordinal FROM g")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.order_entries(documents.generate_entries(_parts(spark, sf_dir))).select("dir", "heading", "title", "link", "description", "ordinal")


@query(f"WITH {_GENERATED} SELECT dir, heading, title, link, description, (row_number() OVER (PARTITION BY dir ORDER BY last, kind, lower(title), link) - 1)::BIGINT AS ordinal FROM g")
def index_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = documents.render_indexes(documents.generate_entries(_parts(spark, sf_dir)))
    return documents.parse_indexes(bodies.withColumnRenamed("body", "content")).select("dir", "heading", "title", "link", "description", "ordinal")


@query(f"""WITH {_GENERATED}, o AS (SELECT *, lag(last || kind) OVER (PARTITION BY dir ORDER BY last, kind, lower(title), link) AS before FROM g)
SELECT dir, sha256(string_agg(CASE WHEN before IS NULL THEN '# ' || heading || chr(10) || chr(10) WHEN before <> last || kind THEN chr(10) || '# ' || heading || chr(10) || chr(10) ELSE '' END || '* [' || title || '](' || link || ')' || coalesce(' - ' || description, '') || chr(10), '' ORDER BY last, kind, lower(title), link)) AS body_sha256 FROM o GROUP BY dir""")
def index_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_indexes(documents.generate_entries(_parts(spark, sf_dir))).select("dir", F.sha2("body", 256).alias("body_sha256"))


@query("""SELECT p_type || '/' || p_brand AS dir, 'p-' || p_partkey || '.md' AS link, CASE p_partkey % 10 WHEN 0 THEN 'missing' ELSE 'stale' END AS finding FROM part WHERE p_partkey % 10 < 2
UNION ALL SELECT p_type || '/' || p_brand, 'ghost-' || p_partkey || '.md', 'dropped' FROM part WHERE p_partkey % 10 = 2 UNION ALL SELECT p_type || '/' || p_brand, NULL, 'malformed' FROM part WHERE p_partkey % 10 = 3""")
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '* [old](p-' || p_partkey || '.md)' ELSE '* [' || p_name || ' ' || p_partkey || '](p-' || p_partkey || '.md)' || CASE WHEN p_size % 2 = 0 THEN ' - size ' || p_size ELSE '' END END || CASE p_partkey % 10 WHEN 2 THEN chr(10) || '* [ghost](ghost-' || p_partkey || '.md)' WHEN 3 THEN chr(10) || '* no link' ELSE '' END"
    rows = table(spark, sf_dir, "part").select(F.expr("p_type || '/' || p_brand").alias("dir"), F.expr("'# Kind-' || (p_size % 3) || ' B2C' || chr(10) || chr(10)").alias("heading"), F.expr(line).alias("line"))
    sections = rows.groupBy("dir", "heading").agg(F.concat("heading", F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("s"))
    committed = sections.groupBy("dir").agg(F.array_join(F.sort_array(F.collect_list("s")), "\n\n").alias("content"))
    return documents.drift(documents.generate_entries(_parts(spark, sf_dir)), committed)


def _log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr("'customer-' || o_custkey || '/log.md'").alias("rel_path"), F.expr("'Orders of ' || o_custkey").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("entry"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Update' WHEN o_orderkey % 3 = 1 THEN 'Creation' END").alias("label"), F.expr("'order ' || o_orderkey || ' is ' || o_orderstatus").alias("text"))


_LOG = "SELECT 'customer-' || o_custkey || '/log.md' AS rel_path, 'Orders of ' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'Update' WHEN o_orderkey % 3 = 1 THEN 'Creation' END AS label, 'order ' || o_orderkey || ' is ' || o_orderstatus AS text, o_orderkey AS k FROM orders"


@query(f"SELECT rel_path, title, date, label, text, (dense_rank() OVER (PARTITION BY rel_path ORDER BY date DESC) - 1)::BIGINT AS section, (row_number() OVER (PARTITION BY rel_path, date ORDER BY k) - 1)::BIGINT AS entry FROM ({_LOG})")
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parse_logs(documents.render_log(_log_entries(spark, sf_dir))).select("rel_path", "title", "date", "label", "text", "section", "entry")


_DAY = "2999-12-31"
_LOG_TEXT = f"""l AS ({_LOG}), d AS (SELECT rel_path, title, date, '## ' || date || chr(10) || string_agg('* ' || coalesce('**' || label || '**: ', '') || text, chr(10) ORDER BY k) || chr(10) AS s FROM l GROUP BY rel_path, title, date)"""


@query(f"WITH {_LOG_TEXT} SELECT rel_path, sha256('# ' || title || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY date DESC)) AS content_sha256 FROM d GROUP BY rel_path, title")
def log_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_log(_log_entries(spark, sf_dir)).select("rel_path", F.sha2("content", 256).alias("content_sha256"))


@query(f"WITH {_LOG_TEXT} SELECT rel_path, sha256('# ' || title || chr(10) || chr(10) || '## {_DAY}' || chr(10) || '* **Audit**: checked' || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY date DESC)) AS proposed_sha256, true AS changed FROM d GROUP BY rel_path, title")
def log_append_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = log_doc.LogEntry("checked", "Audit")
    plans = writes.plan(documents.render_log(_log_entries(spark, sf_dir)), lambda content: log_doc.append(content, entry, _DAY))
    return plans.select("rel_path", "proposed_sha256", "changed")


# ---- planned writes ----


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_bundle(spark, sf_dir, ("customer",)).select("rel_path", "content")


def _plan_columns(plans: DataFrame) -> DataFrame:
    return plans.select("rel_path", "original_sha256", "proposed_sha256", "changed")


_SOURCED = f"'---' || {NL} || 'type: customer # kept' || {NL} || CASE WHEN c_custkey % 2 = 0 THEN 'sources:' || {NL} || '- resource: urn:nation:' || c_nationkey || {NL} ELSE '' END || 'owner: x' || {NL} || '---' || {NL} || 'Body' || {NL}"
_SOURCED_AFTER = f"'---' || {NL} || 'type: customer # kept' || {NL} || 'owner: x' || {NL} || 'sources:' || {NL} || '- resource: urn:nation:' || c_nationkey || {NL} || '---' || {NL} || 'Body' || {NL}"


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey || '.md'").alias("rel_path"), F.expr(_SOURCED).alias("content"), F.expr("'urn:nation:' || c_nationkey").alias("resource"))


@query(f"SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SOURCED}) AS original_sha256, sha256(CASE WHEN c_custkey % 2 = 0 THEN {_SOURCED} ELSE {_SOURCED_AFTER} END) AS proposed_sha256, c_custkey % 2 <> 0 AS changed FROM customer")
def source_upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content, resource: patching.upsert_source(content, {"resource": resource}), ("resource",)))


@query(f"""SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SOURCED}) AS original_sha256,
sha256(replace({_SOURCED}, 'owner: x' || {NL}, 'owner: x' || {NL} || 'verified:' || {NL} || '- by: human:ann' || {NL} || '  at: 2026-01-02 03:04:05+00:00' || {NL})) AS proposed_sha256, true AS changed FROM customer""")
def stamp_verified_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content: patching.stamp_verified(content, "human:ann", at)))


@query(f"""SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SOURCED}) AS original_sha256,
sha256(replace({_SOURCED}, 'owner: x' || {NL}, 'owner: y' || {NL} || 'status: stable' || {NL})) AS proposed_sha256, true AS changed FROM customer""")
def frontmatter_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content: patching.merge_frontmatter(content, {"owner": "y", "status": "stable"})))


_CUSTOMER_FILE = f"'---' || {NL} || 'type: customer' || {NL} || '---' || {NL} || {CUSTOMER_BODY}"


@query(f"SELECT 'customer/' || c_custkey || '.md' AS rel_path, sha256({_CUSTOMER_FILE}) AS original_sha256, sha256(replace({_CUSTOMER_FILE}, '(../nation/7.md', '(../country/7.md')) AS proposed_sha256, true AS changed FROM customer WHERE c_nationkey = 7")
def link_rewrite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewrites = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.expr("'customer/' || c_custkey || '.md'").alias("rel_path"), F.lit("../nation/7.md").alias("old"), F.lit("../country/7.md").alias("new"))
    return _plan_columns(writes.plan_rewrites(_customer_files(spark, sf_dir), rewrites))


@query(f"""SELECT 'customer/' || c_custkey || '.md' AS rel_path, sha256({_CUSTOMER_FILE}) AS original_sha256, sha256(replace({_CUSTOMER_FILE}, '(../nation/7.md', '(../land/of/seven.md')) AS proposed_sha256, true AS changed FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'supplier/' || s_suppkey || '.md', sha256(f), sha256(replace(f, '(/nation/7.md', '(/land/of/seven.md')), true FROM (SELECT *, '---' || {NL} || 'type: supplier' || {NL} || '---' || {NL} || 'Based in *[nation](/nation/' || s_nationkey || '.md#top)*.' || {NL} AS f FROM supplier) WHERE s_nationkey = 7
UNION ALL SELECT 'nation/7.md', sha256(f), sha256(replace(replace(f, '<../region/', '<../../region/'), '(../index.md)', '(../../index.md)')), true FROM (SELECT *, '---' || {NL} || 'type: nation' || {NL} || '---' || {NL} || '- in [' || n_name || '](<../region/' || n_regionkey || '.md>)' || {NL} || '- [index](../index.md)' || {NL} AS f FROM nation) WHERE n_nationkey = 7""")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_bundle(spark, sf_dir)
    plans = writes.plan_move(rows.select("rel_path", "content"), links.build(rows).links, "nation/7.md", "land/of/seven.md")
    return _plan_columns(plans)


def _repair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    body = "'[a](gone-' || c_custkey || '.md) [b](../../out.md)'"
    rows = table(spark, sf_dir, "customer").select(F.expr("'customer/' || c_custkey").alias("concept_id"), F.expr("'customer/' || c_custkey || '.md'").alias("rel_path"), F.expr(body).alias("body"), F.expr(body).alias("content"))
    moved = table(spark, sf_dir, "customer").select(F.expr("'customer/gone-' || c_custkey").alias("dead_id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'customer/' || (c_custkey % 10) || '.md' WHEN 1 THEN 'nowhere/x.md' END").alias("new_path"))
    return writes.plan_repair(rows.select("rel_path", "content"), links.build(rows).broken, moved)


@query("SELECT 'customer/' || c_custkey || '.md' AS rel_path, '[a](' || (c_custkey % 10) || '.md) [b](../../out.md)' AS proposed FROM customer WHERE c_custkey % 3 = 0")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair(spark, sf_dir)[0].select("rel_path", "proposed")


@query("""SELECT 'customer/' || c_custkey || '.md' AS source_path, '../../out.md' AS target, 'not-concept-shaped' AS reason FROM customer
UNION ALL SELECT 'customer/' || c_custkey || '.md', 'gone-' || c_custkey || '.md', CASE c_custkey % 3 WHEN 1 THEN 'invalid-resolved-path' ELSE 'unresolved' END FROM customer WHERE c_custkey % 3 > 0""")
def repair_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair(spark, sf_dir)[1]


@query(f"""SELECT 'customer/' || c_custkey || '.md' AS rel_path, sha256({_CUSTOMER_FILE}) AS original_sha256, sha256({_CUSTOMER_FILE} || {NL} || '## See also' || {NL} || {NL} || '- [' || replace(n_name, '_', chr(92) || '_') || '](../nation/' || n_nationkey || '.md)' || {NL}) AS proposed_sha256, true AS changed FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def suggestion_apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    suggestions = named.select(F.expr("'customer/' || c_custkey || '.md'").alias("source_path"), F.expr("'nation/' || n_nationkey || '.md'").alias("target_path"), F.col("n_name").alias("target_title"))
    return _plan_columns(writes.plan_suggestions(_customer_files(spark, sf_dir), suggestions))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'two lines' WHEN 1 THEN NULL WHEN 2 THEN c_name ELSE c_name || '  x' END AS title FROM customer")
def inline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE c_custkey % 4 WHEN 0 THEN ' two' || chr(13) || chr(10) || 'lines' || chr(9) WHEN 1 THEN chr(10) || ' ' WHEN 2 THEN c_name ELSE c_name || '  x' END"
    return table(spark, sf_dir, "customer").select("c_custkey", text.inline(F.expr(raw)).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'folder/' || p_partkey || '.md' END AS rel_path, CASE WHEN p_partkey % 4 = 0 THEN 'folder/' || p_partkey END AS concept_id FROM part")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'folder/' || p_partkey WHEN 1 THEN 'a/../b' WHEN 2 THEN 'v1.' || p_partkey ELSE 'c:d' END").alias("id"))
    found = ids.select("p_partkey", paths.path_of_id(F.col("id")).alias("rel_path"))
    return found.select("p_partkey", "rel_path", paths.concept_id(F.col("rel_path")).alias("concept_id"))


# ---- more of the above ----


@query(_BM25 + "SELECT concept_id, round(score, 6) AS score FROM hit")
def search_stored_index_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the first refresh lacks some rows and has others of old texts and of rows that are gone."""
    path, rows = fresh_path(spark, "index"), search_rows(spark, sf_dir)
    kind = F.pmod(F.crc32("concept_id"), F.lit(4))
    old = rows.where(kind != 0).withColumn("body", F.when(kind == 1, F.lit("the reedes of old")).otherwise(F.col("body")))
    gone = rows.where(kind == 2).withColumn("concept_id", F.concat("concept_id", F.lit("-gone")))
    search.refresh_index(old.unionByName(gone), path)
    search.refresh_index(rows, path)
    return search.search_index(spark, path, TERMS).select("concept_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT concept_id, round(score, 6) AS score FROM hit")
def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "index")
    search.write_index(search_rows(spark, sf_dir), path)
    return search.search_index(spark, path, TERMS).select("concept_id", F.round("score", 6).alias("score"))


@query(f"""WITH e AS ({EDGES_SQL}) SELECT 'nation/' || n_nationkey AS concept_id, 'nation' AS type, n_name AS title, 1::BIGINT AS outbound, (SELECT count(*) FROM e WHERE target_concept_id = 'nation/' || n_nationkey)::BIGINT AS inbound FROM nation
UNION ALL SELECT 'region/' || r_regionkey, 'region', r_name, 0, (SELECT count(*) FROM e WHERE target_concept_id = 'region/' || r_regionkey) FROM region""")
def list_with_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_bundle(spark, sf_dir, ("nation", "region"))
    concepts = rows.withColumn("frontmatter", F.to_json(F.struct(F.substring_index("concept_id", "/", 1).alias("type"), "title")))
    listed = listing.with_graph(listing.list_concepts(concepts), links.degrees(rows, _edges(spark, sf_dir)))
    return listed.select("concept_id", "type", "title", "outbound", "inbound")


_LISTED = " UNION ALL ".join(f"SELECT '{name}/' || {key} AS concept_id, '{name}' AS type, {title} AS title FROM {name}" for name, key, title, _ in KINDS)


@query(f"""WITH e AS ({EDGES_SQL}), o AS (SELECT source_concept_id AS concept_id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target_concept_id AS concept_id, count(*) AS n FROM e GROUP BY 1)
SELECT concept_id, type, title, coalesce(o.n, 0)::BIGINT AS outbound, coalesce(i.n, 0)::BIGINT AS inbound FROM ({_LISTED}) LEFT JOIN o USING (concept_id) LEFT JOIN i USING (concept_id)""")
def list_all_with_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_bundle(spark, sf_dir)
    concepts = rows.withColumn("frontmatter", F.to_json(F.struct(F.substring_index("concept_id", "/", 1).alias("type"), "title")))
    listed = listing.with_graph(listing.list_concepts(concepts), links.degrees(rows, _edges(spark, sf_dir)))
    return listed.select("concept_id", "type", "title", "outbound", "inbound")


_SIDECAR = "CASE p_type WHEN 'ECONOMY' THEN 'title: Cheap parts' || chr(10) || 'description: All of them' WHEN 'SMALL' THEN '- no mapping' ELSE 'description: About ' || p_type END"


@query("""SELECT DISTINCT p_type AS dir, CASE p_type WHEN 'ECONOMY' THEN 'Cheap parts' END AS title, CASE p_type WHEN 'ECONOMY' THEN 'All of them' WHEN 'SMALL' THEN NULL ELSE 'About ' || p_type END AS description, p_type = 'SMALL' AS faulty FROM part""")
def index_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("dir"), F.expr(_SIDECAR).alias("content")).distinct()
    return documents.parse_sidecars(rows).select("dir", "title", "description", F.col("problem").isNotNull().alias("faulty"))


@query("""SELECT DISTINCT '' AS dir, CASE p_type WHEN 'ECONOMY' THEN 'Cheap parts' ELSE p_type END AS title, p_type || '/' AS link, CASE p_type WHEN 'ECONOMY' THEN 'All of them' WHEN 'SMALL' THEN NULL ELSE 'About ' || p_type END AS description FROM part""")
def index_subdirectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("dir"), F.expr(_SIDECAR).alias("content")).distinct()
    entries = documents.generate_entries(_parts(spark, sf_dir), documents.parse_sidecars(rows))
    return entries.where("dir = '' AND heading = 'Subdirectories'").select("dir", "title", "link", "description")


def _stamped(content: str) -> str:
    """_SOURCED with lines after its owner."""
    return f"""SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SOURCED}) AS original_sha256, sha256(replace({_SOURCED}, 'owner: x' || {NL}, 'owner: x' || {NL} || {content})) AS proposed_sha256, true AS changed FROM customer"""


@query(_stamped(f"'status: draft' || {NL}"))
def stamp_status_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content: patching.stamp_status(content, "draft")))


@query(_stamped(f"'stale_after: 2030-01-31' || {NL}"))
def stamp_stale_after_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content: patching.stamp_stale_after(content, "2030-01-31")))


@query(_stamped(f"'generated:' || {NL} || '  by: tool/1.0' || {NL} || '  at: 2026-01-02 03:04:05+02:00' || {NL}"))
def stamp_generated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sourced(spark, sf_dir), lambda content: patching.stamp_generated(content, "tool/1.0", "2026-01-02T03:04:05+02:00")))


_SECTIONED = f"'# ' || c_name || {NL} || {NL} || '## Notes' || {NL} || {NL} || '- [n](n/' || c_nationkey || '.md)' || {NL} || {NL} || '## End' || {NL} || {NL} || 'done' || {NL}"


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey || '.md'").alias("rel_path"), F.expr(_SECTIONED).alias("content"), F.expr("'- [m](n/' || (c_custkey % 25) || '.md)'").alias("line"))


@query(f"""SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SECTIONED}) AS original_sha256, sha256(CASE WHEN c_custkey % 25 = c_nationkey THEN {_SECTIONED} ELSE replace({_SECTIONED}, '.md)' || {NL}, '.md)' || {NL} || '- [m](n/' || (c_custkey % 25) || '.md)' || {NL}) END) AS proposed_sha256, c_custkey % 25 <> c_nationkey AS changed FROM customer""")
def section_append_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sectioned(spark, sf_dir), lambda content, line: patching.append_section(content, "Notes", 2, [line]), ("line",)))


@query(f"""SELECT 'c/' || c_custkey || '.md' AS rel_path, sha256({_SECTIONED}) AS original_sha256, sha256(replace({_SECTIONED}, '- [n](n/' || c_nationkey || '.md)', 'nothing')) AS proposed_sha256, true AS changed FROM customer""")
def section_replace_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_columns(writes.plan(_sectioned(spark, sf_dir), lambda content: patching.replace_section(content, "Notes", 2, "nothing")))


@query(f"WITH {_LOG_TEXT} SELECT rel_path, sha256('# ' || title || chr(10) || chr(10) || '## {_DAY}' || chr(10) || '* **Moved**: [old/id](new/place.md \"moved to\")' || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY date DESC)) AS proposed_sha256, true AS changed FROM d GROUP BY rel_path, title")
def log_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = writes.plan(documents.render_log(_log_entries(spark, sf_dir)), lambda content: log_doc.append_move(log_doc.append_move(content, "old/id", "new/place.md", _DAY), "old/id", "new/place.md", "1970-01-01"))
    return plans.select("rel_path", "proposed_sha256", "changed")


@query(f"SELECT 'c/' || c_custkey || '.md' AS rel_path, '# ' || c_name || {NL} || {NL} || '- one' || {NL} || '- ' || c_mktsegment || {NL} || {NL} || 'text' || {NL} AS proposed, true AS changed FROM customer")
def canonical_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"c_name || {NL} || '=====' || {NL} || '* one' || {NL} || '* ' || c_mktsegment || {NL} || {NL} || {NL} || 'text'"
    rows = table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey || '.md'").alias("rel_path"), F.expr(source).alias("content"))
    return writes.plan(rows, markdown.render).select("rel_path", "proposed", "changed")


_RESERVED = "CASE c_custkey % 4 WHEN 0 THEN 'n' || c_nationkey || '/c' || c_custkey || '/INDEX.md' WHEN 1 THEN 'n' || c_nationkey || '/c' || c_custkey || '/log.md' WHEN 2 THEN 'log.md/c' || c_custkey || '.md' ELSE 'c' || c_custkey || '/my-log.md' END"


@query("SELECT 'n' || c_nationkey || '/c' || c_custkey AS dir, CASE WHEN c_custkey % 4 = 0 THEN 'INDEX.md' ELSE 'log.md' END AS filename FROM customer WHERE c_custkey % 4 < 2")
def reserved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.reserved_files(table(spark, sf_dir, "customer").select(F.expr(_RESERVED).alias("rel_path")), ("index.md", "log.md"))


@query("SELECT 'customer/' || c_custkey AS concept_id, 'error' AS severity, 'type' AS field FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def validate_allowed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where types are listed as allowed, what is merely known doesn't count."""
    rows = table(spark, sf_dir, "customer").select(F.expr("'customer/' || c_custkey").alias("concept_id"), F.to_json(F.struct(F.concat(F.lit(" "), "c_mktsegment").alias("type"))).alias("frontmatter"))
    rule = Taxonomy(allowed_types=("BUILDING", "MACHINERY"), known_types=("AUTOMOBILE",))
    return validate.taxonomy(rows, Profile(taxonomy=rule)).select("concept_id", "severity", "field")


@query("""
WITH d AS (SELECT 'n' || c_nationkey AS dir, max(c_custkey) AS top FROM customer GROUP BY c_nationkey)
SELECT '' AS dir, dir || '/' AS link, dir AS title, CASE WHEN dir LIKE '%1' THEN 'told by ' || dir WHEN dir LIKE '%2' THEN NULL ELSE 'about ' || dir END AS description FROM d
""")
def index_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders are described by their sidecar, or by a function that is asked about the others."""
    rows = table(spark, sf_dir, "customer").select(F.expr("'n' || c_nationkey || '/' || c_custkey").alias("concept_id"), F.lit("customer").alias("type"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("description"))
    rows = rows.withColumn("rel_path", F.concat("concept_id", F.lit(".md")))
    told = rows.select(F.substring_index("concept_id", "/", 1).alias("dir")).distinct().where("dir LIKE '%1'").select("dir", F.lit(None).cast("string").alias("title"), F.concat(F.lit("told by "), "dir").alias("description"))
    entries = documents.generate_entries(rows, told, lambda folder: None if folder.endswith("2") else f"about\n {folder} ")
    return entries.where("heading = 'Subdirectories'").select("dir", "link", "title", "description")
