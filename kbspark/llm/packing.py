"""Best-fit packing of texts into sequences, with no two of a source or of a cluster of copies in one sequence."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import normalised, own_id, store

#: Items that one task packs together on average, and copies of a repeated row that are dealt to a group at a time.
GROUP_ITEMS, DEALT = 2_048, 16


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each item, in order of falling size, its bin and its offset there.

    Bins are ordered by the room they have left. From the tightest bin with room enough the search goes on to the next
    until neither its bitmap of sources nor that of clusters has the item's bit. sources and clusters are numbers of
    bits, or -1 for none.
    """
    rooms: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (source_bits[rooms[at][1]] & s or cluster_bits[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            room, bin_ = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[bin_] |= s
        cluster_bits[bin_] |= c
        insort(rooms, (room - size, bin_))
        out.append((bin_, capacity - room))
    return out


def _bits(values: list, alone_counts: bool) -> list[int]:
    """Numbers from 0 for the values that more than one item has (or all); null conflicts with nothing."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in seen.items() if v is not None and (alone_counts or n > 1))}
    return [number.get(v, -1) for v in values]


def _pack_group(capacity: int, id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        group = table["_group"][0].as_py()
        rows = zip(*(table[c].to_pylist() for c in ("_size", "_id", "_source", "_cluster", "_copies")), strict=True)
        rows = [r[:4] for r in rows for _ in range(r[4])]
        rows.sort(key=lambda r: (-(r[0] % capacity), -r[0], r[1] is not None, r[1] if r[1] is not None else 0, str(r[2:])))
        rest = [r for r in rows if r[0] % capacity]
        placed = best_fit([r[0] % capacity for r in rest], _bits([r[2] for r in rest], True), _bits([r[3] for r in rest], False), capacity)
        base, used = group << 32, 1 + max((b for b, _ in placed), default=-1)
        out = []
        for size, id_, *_ in rows:
            for piece in range(size // capacity):
                out.append((id_, piece, piece * capacity, capacity, base + used, 0))
                used += 1
        for (size, id_, *_), (bin_, offset) in zip(rest, placed, strict=True):
            out.append((id_, size // capacity, size // capacity * capacity, size % capacity, base + bin_, offset))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def deal(items: DataFrame, total: int) -> DataFrame:
    """items (_id, _size, _source, _cluster) with _group and _copies, the number of such rows in the group.

    Rows alike in all four columns can stand for one another, so they are counted first; their copies are dealt a few at a
    time. So no group gets many more than GROUP_ITEMS items, whatever ids, sizes, sources or clusters the rows share.
    """
    alike = items.groupBy("_id", "_size", "_source", "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / DEALT).cast("long"))).alias("_part")
    dealt = alike.select("*", part).withColumn("_copies", F.least(F.lit(DEALT), F.col("_n") - F.col("_part") * DEALT))
    groups = max(1, -(-total // GROUP_ITEMS))
    return dealt.withColumn("_group", F.pmod(F.xxhash64("_id", "_size", "_source", "_cluster", "_part", F.lit(3)), F.lit(groups))).drop("_n", "_part")


def pack(docs: DataFrame, capacity: int = 2_048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row per piece of a row of docs: id_col, piece, start, size, bin_id and bin_offset.

    size defaults to the text's words plus one, for the mark of its end; null and empty texts have that mark alone.
    A text longer than capacity is cut: its full pieces fill bins of their own, the rest is packed like any other text.
    No bin holds more than capacity, two rests of one source, or two of one cluster. Clusters are texts equal but for
    case and white space; a caller who knows clusters of near copies passes their column. Null sources and clusters
    conflict with nothing. Integer ids come back as long, others as strings; rows with null or equal ids and repeated
    rows are packed each by itself. Other columns are ignored. An empty table gives no rows.

    Only sizes, sources and clusters move. Rows are dealt by a hash to groups of bounded size that are packed on their
    own, so a hot source, cluster, id or row is spread over all groups. Ties are broken by size, id, source and cluster, so
    results don't depend on the run.
    """
    plain = F.trim(normalised(F.col(text_col)))  # one pass serves both: words are the spaces left and one more
    size = F.when(plain == "", 1).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 2) if size is None else size
    cluster = F.xxhash64(F.lower(plain)) if cluster is None else cluster
    id_, kind, arrow = own_id(docs, id_col)
    items = store(docs.select(id_.alias("_id"), size.cast("long").alias("_size"), F.col(source_col).cast("string").alias("_source"), cluster.alias("_cluster")), "items").df
    total, tasks = items.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal(items, total).repartition(max(1, min(tasks, -(-total // GROUP_ITEMS))), "_group")  # few bytes, but work enough for a task each
    packed = dealt.groupBy("_group").applyInArrow(_pack_group(capacity, arrow), f"_id {kind}, piece int, start long, size long, bin_id long, bin_offset long")
    return packed.withColumnRenamed("_id", id_col)


__all__ = ["best_fit", "deal", "pack"]
