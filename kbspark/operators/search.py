"""Full-text search: BM25 over title, description, fields and body, and snippets."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import cache
from ..sources.scratch import store

K1, B = 1.2, 0.75
COLUMNS = ("title", "description", "fields", "body")
#: Segments of a stored index that are kept apart; with more it is written anew as one. Postings of a file of a segment.
MOST_SEGMENTS, FILE_POSTINGS = 16, 2_000_000


class SearchConfigError(ValueError):
    """Search without a place for its index."""


def row_tokens(columns: tuple[str, ...] = COLUMNS) -> Column:
    return F.concat(*[text.tokens(F.col(c)) for c in columns])


def occurrences(words: Column, phrase: list[str]) -> Column:
    """How often the tokens of phrase follow one another."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    span = len(phrase)
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - span + 1, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.slice(words, i, span) == F.array(*[F.lit(p) for p in phrase])))


def idf(n_docs: Column, n_hits: Column) -> Column:
    raw = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw)


def fields_text(fields: Column) -> Column:
    """The listed fields of a row (a map of JSON values) as lines: each key, in order, before what its value holds."""

    @F.pandas_udf("string")
    def lines(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "\n".join(text.flat({k: json.loads(v) for k, v in json.loads(x).items() if v is not None})) if x else "")

    return lines(F.to_json(fields))


def _scored(counts: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """concept_id and score from counts (concept_id, dl, f0, f1, ...) of the rows with all of n words and one row of statistics."""
    hits = counts.crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = sum((idf(F.col("n"), F.col(f"n{i}")) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm) for i in range(n)), F.lit(0.0))
    return hits.select("concept_id", (-score).alias("score"))


def bm25(docs: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """concept_id and score (more negative is better) of the rows that have every word of query.

    One scan counts the query's terms in each row with built-in functions: no word is exploded, and what it counts is stored,
    so texts are read and cut into tokens once. A word with an underscore is a phrase, within one column. A query without
    words has no hits. For many queries over one corpus there is refresh_index().
    """
    phrases = text.query_terms(query)
    if not phrases:
        return docs.select("concept_id", F.lit(0.0).alias("score")).limit(0)
    arrays = docs.select("concept_id", *[text.tokens(F.col(c)).alias(f"_{c}") for c in columns])
    counts = [sum((occurrences(F.col(f"_{c}"), p) for c in columns), F.lit(0)).alias(f"f{i}") for i, p in enumerate(phrases)]
    narrow = store(arrays.select("concept_id", sum((F.size(f"_{c}") for c in columns), F.lit(0)).alias("dl"), *counts), "counts")
    found = [F.col(f"f{i}") > 0 for i in range(len(phrases))]
    stats = narrow.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(f, 1)).alias(f"n{i}") for i, f in enumerate(found)])
    return _scored(narrow.where(reduce(Column.__and__, found)), stats, len(phrases))


def search(docs: DataFrame, query: str, limit: int = 10, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The best rows with title, description, score and a snippet. Snippets are made for them alone."""
    if limit < 0:
        raise ValueError("limit must be non-negative")
    return with_snippets(docs, bm25(docs, query, columns).orderBy("score", "concept_id").limit(limit), query, columns)


def with_snippets(docs: DataFrame, best: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """best (concept_id, score) in order, with title, description and a snippet from docs."""
    rows = docs.join(best, "concept_id").select("concept_id", F.nullif("title", F.lit("")).alias("title"), F.nullif("description", F.lit("")).alias("description"), "score", *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    phrases = text.query_terms(query)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["snippet"] = [snippet([r[f"_{c}"] for c in columns], phrases) for _, r in batch.iterrows()]
            yield batch[["concept_id", "title", "description", "score", "snippet"]]

    return rows.mapInPandas(run, "concept_id string, title string, description string, score double, snippet string").orderBy("score", "concept_id")


def _places(content: str, phrases: list[list[str]]) -> tuple[list[re.Match], list[tuple[int, int, int]]]:
    """The tokens of a column, and (first token, last token, phrase) of each occurrence."""
    found = list(text.WORD.finditer(content))
    words = [text.fold(m[0]) for m in found]
    at = [(i, i + len(p) - 1, k) for i in range(len(words)) for k, p in enumerate(phrases) if words[i : i + len(p)] == p]
    return found, sorted(at)


def snippet(columns: list[str], phrases: list[list[str]], width: int = 16) -> str:
    """The stretch of width tokens, of any column, with the most words of the query; each in brackets."""
    best = (-1, 0, 0)
    parsed = [_places(c, phrases) for c in columns]
    for c, (found, at) in enumerate(parsed):
        starts = [0] + [i for i in range(1, len(found)) if re.search(r"[.:]\s+\Z", columns[c][found[i - 1].end() : found[i].start()])]
        for first, _, _ in at:
            inside = [x for x in at if first <= x[0] < first + width]
            points = 1000 * len({k for *_, k in inside}) + len(inside) - len({k for *_, k in inside})
            last = max(b for _, b, _ in inside)
            begin = first - int((width - (last + 1 - first)) / 2)
            begin = max(0, min(begin, len(found) - width))
            if points > best[0]:
                best = (points, c, begin)
            if len(found) > width:
                sentence = max(s for s in starts if s <= first)
                if sentence < first:
                    inside = [x for x in at if sentence <= x[0] < sentence + width]
                    points = 1000 * len({k for *_, k in inside}) + len(inside) - len({k for *_, k in inside}) + (120 if sentence == 0 else 100)
                    if points > best[0]:
                        best = (points, c, sentence)
    points, c, begin = best
    if points < 0:
        return ""
    found, at = parsed[c]
    end = begin + width
    out, place = "...", found[begin].start()
    if begin == 0:
        out, place = "", 0
    done = -1
    for a, b, _ in at:
        if a < begin or a >= end or a <= done:
            continue
        out += columns[c][place : found[a].start()] + "[" + columns[c][found[a].start() : found[b].end()] + "]"
        place, done = found[b].end(), b
    if end >= len(found):
        return out + columns[c][place:]
    return out + columns[c][place : max(place, found[end - 1].end())] + "..."


def _postings(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """term, concept_id, column and places (in the column, in order) of all words of docs."""
    each = docs.select("concept_id", F.explode(F.array(*[F.struct(F.lit(i).alias("column"), text.tokens(F.col(c)).alias("words")) for i, c in enumerate(columns)])).alias("_c"))
    words = each.select("concept_id", "_c.column", F.posexplode("_c.words").alias("place", "term"))
    return words.groupBy("term", "concept_id", "column").agg(F.sort_array(F.collect_list("place")).alias("places"))


def refresh_index(docs: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """Bring the index at path up to docs (concept_id and columns): only rows that are new or changed are cut into words.

    Their postings make a new segment, cut by ranges of terms and sorted, so a query skips the files and row groups without its
    terms. The table of documents says in which segment each one's postings count; with it the new state becomes
    visible at once. Postings of changed or missing rows stay behind until MOST_SEGMENTS segments are written as one.
    """
    spark = docs.sparkSession
    hashed = docs.withColumn("sha256", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256))
    known = cache.load(spark, f"{path}/documents")
    if known is not None and known.select("segment").distinct().count() >= MOST_SEGMENTS:
        known = None
    fresh = None if known is None else known.join(hashed.select("concept_id", "sha256"), ["concept_id", "sha256"], "left_semi").select("concept_id", "sha256", "segment", "dl")
    new = hashed if known is None else hashed.join(known.select("concept_id", "sha256"), ["concept_id", "sha256"], "left_anti")
    segment = uuid.uuid4().hex[:12]
    added = store(new.select("concept_id", "sha256", F.lit(segment).alias("segment"), F.size(row_tokens(columns)).cast("long").alias("dl")), "added")
    words = added.agg(F.sum("dl")).first()[0]
    if words:
        ranged = _postings(new, columns).repartitionByRange(max(1, -(-words // FILE_POSTINGS)), "term", "concept_id").sortWithinPartitions("term", "concept_id", "column")
        ranged.write.parquet(f"{path}/postings/segment={segment}")
    cache.save(added if fresh is None else fresh.unionByName(added), f"{path}/documents")


def write_index(docs: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """An index of docs at a path that has none."""
    refresh_index(docs, path, columns)


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """bm25() from a stored index, phrases included; of the postings only those of the query's terms are read."""
    phrases = text.query_terms(query)
    known = cache.load(spark, f"{path}/documents")
    if known is None:
        raise SearchConfigError(f"there is no index at {path}")
    terms = sorted({t for p in phrases for t in p})
    if not terms or known.agg(F.sum("dl")).first()[0] in (None, 0):
        return known.select("concept_id", F.lit(0.0).alias("score")).limit(0)
    postings = spark.read.schema("term string, concept_id string, column int, places array<int>, segment string").parquet(f"{path}/postings")
    rows = postings.where(F.col("term").isin(*terms)).join(known.select("concept_id", "segment"), ["concept_id", "segment"], "left_semi")
    by_column = rows.groupBy("concept_id", "column").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_at"))
    none = F.array().cast("array<int>")

    def times(phrase: list[str]) -> Column:
        first, *rest = (F.coalesce(F.try_element_at("_at", F.lit(t)), none) for t in phrase)
        return F.size(F.filter(first, lambda x: reduce(Column.__and__, (F.array_contains(r, x + k) for k, r in enumerate(rest, 1)), F.lit(True))))

    counts = by_column.select("concept_id", *[times(p).alias(f"f{i}") for i, p in enumerate(phrases)]).groupBy("concept_id").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(phrases))])
    counts = store(counts, "counts")
    found = [F.col(f"f{i}") > 0 for i in range(len(phrases))]
    stats = counts.agg(*[F.count(F.when(f, 1)).alias(f"n{i}") for i, f in enumerate(found)]).crossJoin(known.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")))
    return _scored(counts.where(reduce(Column.__and__, found)).join(known.select("concept_id", "dl"), "concept_id"), stats, len(phrases))
