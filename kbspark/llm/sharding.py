"""Shards that each hold the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, store

#: Rows of a cell on average, and cells at least. A cell is the unit in which rows are sorted and numbered.
CELL_ROWS, CELLS = 20_000, 64


def _numbered(rows: DataFrame, order: list[str], cells: int, label: str) -> DataFrame:
    """rows with _at, their place (from 0) in the order of all rows; stored.

    Rows are cut by ranges of the whole order, so rows that agree in its first columns needn't share a cell, and sorted
    and numbered within a cell. Only the counts of cells meet in one task.
    """
    ranged = rows.repartitionByRange(cells, *order).sortWithinPartitions(*order)
    ranged = store(ranged.withColumns({"_cell": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), label).df
    counts = ranged.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_cell").withColumn("_at", F.col("_before") + F.col("_in")).drop("_cell", "_in", "_before")


def interleave(rows: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", stratum_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Give each row of rows a shard (0 to shards - 1) and a slot (from 0, without gaps) in it.

    Within a stratum rows are shuffled by a seeded hash of their id and ranked; a row's fractional rank is
    (rank - 1/2) / size of the stratum. All rows sorted by it, cut into equal counts, make the shards, so each shard has
    within a row or two the mixture of the whole, and counts at most one apart. Result: id_col, stratum_col, the columns
    named in carry, fraction, position, shard, slot.

    Null strata are a stratum of their own; null ids hash as empty; rows with equal ids follow one another, by the columns
    in carry. Ids may have any type. No column but those named is read. An empty table gives no rows. No task holds a
    stratum, a fraction or an id: all rows are cut into cells of about CELL_ROWS by the whole order, in which rows alike in
    all columns are told apart by a number given when they were stored.
    """
    total = rows.count()
    cells = max(CELLS, -(-total // CELL_ROWS))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    own = [id_col, stratum_col, *(c for c in carry if c not in (id_col, stratum_col))]
    narrow = rows.select(F.struct(*own).alias("_own"), mixed.alias("_key"), F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")).alias("_stratum"))
    narrow = store(narrow.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())), "strata").df
    by_key = _numbered(narrow, ["_stratum", "_key", "_own", "_tie"], cells, "sorted")
    strata = store(by_key.groupBy("_stratum").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_of")), "counts").df
    fraction = (2.0 * (F.col("_at") - F.col("_first")) + 1.0) / (2.0 * F.col("_of"))
    ranked = store(attach(by_key, strata, "_stratum", "_of", total).select("_own", "_key", "_tie", fraction.alias("_fraction")), "ranked").df
    placed = _numbered(ranked, ["_fraction", "_key", "_own", "_tie"], cells, "placed")
    placed = placed.withColumn("_shard", F.expr(f"_at * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("_own.*", F.col("_fraction").alias("fraction"), F.col("_at").alias("position"), F.col("_shard").alias("shard"), (F.col("_at") - first).alias("slot"))
