"""Exact deduplication through a minimal perfect hash over the digests already in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, blobs, marked, normalised, own_id, store

#: Distinct digests that one shard of the index holds on average.
SHARD_DIGESTS = 50_000
#: Bits for each key and level; more of them mean fewer levels.
GAMMA = 2.0


class PerfectHash:
    """A minimal perfect hash of distinct 256-bit digests.

    On each level every key left picks one bit; bits picked once are kept, the other keys go on to the next level. A
    key's slot is the number of kept bits before its own. Any digest gets a slot or -1; only a comparison with the
    digest in the slot tells members from others.
    """

    def __init__(self, digests: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        words, base, left = _words(digests), 0, np.arange(len(digests))
        while len(left):
            at = _positions(words[left], len(self.levels), int(np.ceil(GAMMA * len(left))))
            kept = np.bincount(at, minlength=int(np.ceil(GAMMA * len(left)))) == 1
            self.levels.append((kept, base + np.cumsum(kept) - 1))
            base += int(kept.sum())
            left = left[~kept[at]]
        self.size = base

    def slots(self, digests: np.ndarray) -> np.ndarray:
        words, out = _words(digests), np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, (kept, rank) in enumerate(self.levels):
            at = _positions(words[left], level, len(kept))
            hit = kept[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, 1] + np.uint64(level) * (words[:, 2] | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _look_up(id_type: pa.DataType, own: bool):
    """One shard: slots with whole digests, winner locators and counts; what isn't in its slot forms groups of its own.

    own: the history is part of the corpus, so all its digests are reported, and the smaller locator wins. Otherwise only
    those met again are, and the history's locator wins.
    """
    schema = pa.schema([("digest", pa.binary()), ("keep_id", id_type), ("group_size", pa.int64()), ("known", pa.bool_())])

    def run(history: pa.Table, incoming: pa.Table) -> pa.Table:
        old, new = blobs(history["digest"], 32), blobs(incoming["digest"], 32)
        index = PerfectHash(old)
        slot_of = index.slots(old)
        digest, source = np.empty_like(old), np.empty(len(old), np.int64)
        digest[slot_of], source[slot_of] = old, np.arange(len(old))
        slots = history.take(pa.array(source)).combine_chunks()
        slot = index.slots(new)
        member = slot >= 0
        member[member] = (digest[slot[member]] == new[member]).all(axis=1)
        again = np.full(len(old), -1, np.int64)  # the incoming digest that a slot was met by; incoming ones are distinct
        again[slot[member]] = np.flatnonzero(member)
        met = pa.array(again, mask=again < 0)
        size = pc.add(slots["n"], pc.fill_null(incoming["n"].combine_chunks().take(met), 0))
        first = pc.min_element_wise(slots["first"], incoming["first"].combine_chunks().take(met)) if own else slots["first"]
        known = pa.table([slots["digest"], first, size, pa.array(np.ones(len(old), bool))], schema=schema)
        alone = incoming.filter(pa.array(~member))
        others = pa.table([alone["digest"], alone["first"], alone["n"], pa.array(np.zeros(len(alone), bool))], schema=schema)
        return pa.concat_tables([known if own else known.filter(pa.array(again >= 0)), others])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))


def history_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct digests of a corpus, each with its smallest id and its count: what find_repeats takes as history.

    Keep it as Parquet beside the corpus; the histories of further corpora can be added to it by unionByName, if only
    documents that find_repeats kept are in them.
    """
    return _counted(docs.select(own_id(docs, id_col)[0].alias("_id"), _digest(F.col(text_col)).alias("digest")))


def _find(docs: DataFrame, id_col: str, text_col: str, history: DataFrame | None) -> tuple[DataFrame, int]:
    id_, kind, arrow = own_id(docs, id_col)
    rows = store(docs.select(id_.alias("_id"), _digest(F.col(text_col)).alias("digest")), "digests").df
    total, known = rows.count(), 0
    if history is None:
        old = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(2)) == 0
        before, after = _counted(rows.where(old)), _counted(rows.where(~old))
    else:
        before, after, known = history.select("digest", F.col("first").cast(kind).alias("first"), "n"), _counted(rows), history.count()
    shards = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total + known) // SHARD_DIGESTS))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards))
    before, after = (x.withColumn("shard", shard) for x in (before, after))
    found = before.groupBy("shard").cogroup(after.groupBy("shard")).applyInArrow(_look_up(arrow, history is None), f"digest binary, keep_id {kind}, group_size long, known boolean")
    groups = store(found, "groups").df
    own = F.lit(True) if history is None else ~F.col("known")
    out = attach(rows, groups, "digest", "group_size", total)
    return out.select("_id", "digest", "keep_id", "group_size", "known", (own & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept")), total


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """Group rows of equal text: one row per row of docs with id_col, digest, keep_id, group_size, known and kept.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as empty.
    history is what history_of() made of an earlier corpus: its distinct digests and winners fill a minimal perfect hash, in
    shards by digest. Rows of docs are counted by digest and looked up; a hit is confirmed by comparing all 32 bytes.
    Known digests are repeats: keep_id is the history's winner, group_size counts its copies too, none is kept. Digests of
    no member are groups of their own, in which the row with the smallest id stays. Without a history half of the ids, by
    hash, are the history of the others, and the smallest id of each text stays; known then tells digests of that half.

    Integer ids come back as long, others as strings and ordered as such. Null ids count in group_size; keep_id is null only if
    all ids of a group are. Rows with the same id and text are one document: each is kept. Columns of docs other than the two
    named are ignored, so their names can't clash. An empty table gives an empty result. Memory: a shard of the index at a
    time, whatever the lengths of texts; copies are counted before any shuffle.
    """
    return _find(docs, id_col, text_col, history)[0].withColumnRenamed("_id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """docs, with its own columns, with one row of each text: the one with the smallest id (null only if all ids are).

    Texts of the history, if one is given, go altogether. Of several rows with that id and text the one with the least JSON
    stays, so results don't depend on the run. Rows whose ids have no part in this are kept where they are read, by a
    bitmap; only the others are shuffled.
    """
    found, total = _find(docs, id_col, text_col, history)
    found = found.where("group_size > 1").groupBy(F.struct("_id", "digest").alias("_key"))
    cut = store(found.agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).where("not _kept or _rows > 1").withColumn("_cut", F.col("_key._id")), "cut").df
    id_ = own_id(docs, id_col)[0]
    rows = marked(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), id_.alias("_cut")), F.col("_cut"), cut, "_cut")
    own_text = F.col("_row").getField(text_col)
    touched = rows.where("_maybe").select("_row", F.struct(F.col("_cut").alias("_id"), _digest(own_text).alias("digest")).alias("_key"))
    left = rows.where("not _maybe").select("_row").unionByName(attach(touched, cut, "_key", "_rows", total, "left_anti").select("_row"))
    again = cut.where("_kept")
    if not again.isEmpty():
        twins = attach(touched, again, "_key", "_rows", total).groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        left = left.unionByName(twins.select("_row"))
    return left.select("_row.*")
