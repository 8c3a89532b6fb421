"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, attach, marked, mix, own_id, rolling, store, without
from .components import components

#: Members that one task compares with a bucket's pivot at a time, and pivots of a bucket.
GROUP_MEMBERS, PIVOTS = 256, 4
#: Documents of a block, when all documents of two blocks are compared.
BLOCK_DOCS = 512
#: Hashed elements of one step of a signature.
STEP = 1 << 17


@dataclass(frozen=True)
class Plan:
    """Shingles of width words, linked from 100 * intersection >= percent * union.

    miss bounds the chance that a pair just at the threshold shares no band: bands are added until
    (1 - s ** rows) ** bands <= miss.
    """

    width: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    seed: int = 7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Half as many functions as values: each gives its least and its greatest value."""
        draw = np.random.default_rng(self.seed)
        n = -(-self.rows * self.bands // 2)
        return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; the whole text is one if it has fewer words."""
    ids = hashes.of(words)
    if len(ids) >= width:
        return np.unique(rolling(ids, width))
    return rolling(ids, len(ids)) + np.uint64(len(ids)) if len(ids) else ids


def signature(items: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    x, n = (items >> np.uint64(16)).astype(np.uint32), len(factors)
    least, greatest = np.empty(n, np.uint32), np.empty(n, np.uint32)
    step = max(1, STEP // len(x))
    for i in range(0, n, step):
        h = (x[None, :] ^ masks[i : i + step, None]) * factors[i : i + step, None]
        h.min(axis=1, out=least[i : i + step])
        h.max(axis=1, out=greatest[i : i + step])
    return np.concatenate([least, greatest])


def _sign(plan: Plan):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (factors, masks), bands = WordHashes(), plan.functions(), plan.bands
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in source:
            n, keys, lists, values = [], [], [0], []
            for text in as_bytes(batch.column("_text")):
                words = text.lower().split() if text else []
                items = shingles(words, plan.width, hashes)
                n.append(len(items))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if len(items):
                    s = signature(items, factors, masks)[: plan.rows * bands].reshape(bands, plan.rows)
                    h = salt.copy()
                    for j in range(plan.rows):
                        h = mix(h + s[:, j])
                    values.append(h.view(np.int64))
                lists.append(lists[-1] + (bands if len(items) else 0))
            flat = pa.array(np.concatenate(values)) if values else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), flat)], names=["_id", "_n", "_key", "_bands"])

    return run


def _id_type(docs: DataFrame) -> tuple[str, pa.DataType]:
    _, kind, arrow = own_id(docs, "_id")
    return kind, arrow


def _emit_sets(plan: Plan, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("items", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in source:
            texts, out, size = batch.column("_text"), [], 0
            for i, id_ in enumerate(batch.column("_id").to_pylist()):
                text = as_bytes(texts.slice(i, 1))[0]
                out.append((id_, shingles(text.lower().split() if text else [], plan.width, hashes).tobytes()))
                size += len(out[-1][1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def full_sets(docs: DataFrame, needs: DataFrame, plan: Plan) -> DataFrame:
    """needs (stored: id and what else) with items, the full shingle set of the document.

    Sets are built where the texts are read, and only of documents that a bitmap of bounded size doesn't rule out, so no text
    is shuffled. docs: _id, _text.
    """
    kind, arrow = _id_type(docs)
    wanted = marked(docs.where("_id IS NOT NULL"), F.col("_id"), needs, "id").where("_maybe").select("_id", "_text")
    return wanted.mapInArrow(_emit_sets(plan, arrow), f"id {kind}, items binary").join(needs, "id")


def _compare(percent: int, id_type: pa.DataType):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, []
        for batch in source:
            a, b = [], []
            for grp, salt, member, id_, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (grp, salt):
                    group, pivots = (grp, salt), []
                items = np.frombuffer(items, np.uint64)
                if not member:
                    pivots.append(items)
                    continue
                for pivot in pivots:
                    small, large = sorted((pivot, items), key=len)
                    if not len(small) or 100 * len(small) < percent * len(large):
                        continue
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        a.append(grp)
                        b.append(id_)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], names=["a", "b"])

    return run


def confirm(docs: DataFrame, pairs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b; stored) whose full shingle sets pass the threshold. docs: _id, _text.

    A set is built once for each document and sent to the groups it takes part in. The members of a popular a are dealt
    over several groups, each with a copy of a's set.
    """
    kind, arrow = _id_type(docs)
    counts = store(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "counts").df
    dealt = attach(pairs, counts, "a", "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP_MEMBERS)).cast("int"))
    members = dealt.select(F.col("b").alias("id"), F.col("a").alias("grp"), "salt", F.lit(True).alias("member"))
    pivots = counts.select(F.col("a").alias("id"), F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / GROUP_MEMBERS).cast("int") - 1)).alias("salt"), F.lit(False).alias("member"))
    needs = store(members.unionByName(pivots), "needs").df
    sets = full_sets(docs, needs, plan).select("grp", "salt", "member", "id", "items")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(parts, "grp", "salt").sortWithinPartitions("grp", "salt", "member").mapInArrow(_compare(plan.percent, arrow), f"a {kind}, b {kind}")


def _compare_all(percent: int, id_type: pa.DataType):
    """Tiles: all documents of different labels are compared, by the shingles that several of them have."""

    def links(ids: list, names: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        number = {x: i for i, x in enumerate(dict.fromkeys(names))}
        labels = [number[x] for x in names]
        sizes = np.array([len(x) for x in sets])
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        ends, keys = np.append(starts[1:], len(flat)), flat[starts]
        root = {x: x for x in labels}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        label = np.array(labels)
        values, counts = np.unique(label, return_counts=True)
        most = values[counts.argmax()]
        for q in np.flatnonzero(label != most):
            at = np.searchsorted(keys, sets[q])
            both = np.zeros(len(sets), np.int64)
            for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
                both[doc[a:b]] += 1
            for x in np.flatnonzero((100 * both >= percent * (sizes + sizes[q] - both)) & (label != label[q])):
                if (u := top(labels[q])) != (v := top(labels[x])):
                    root[u] = v
                    yield ids[q], ids[x]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, labels, sets = None, [], [], []
        found: list[tuple] = []
        for batch in source:
            for grp, label, id_, items in zip(*(batch.column(c).to_pylist() for c in ("grp", "label", "id", "items")), strict=True):
                if grp != tile:
                    if len(set(labels)) > 1:
                        found += links(ids, labels, sets)
                    tile, ids, labels, sets = grp, [], [], []
                ids.append(id_)
                labels.append(label)
                sets.append(np.frombuffer(items, np.uint64))
        if len(set(labels)) > 1:
            found += links(ids, labels, sets)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], id_type), pa.array([x for _, x in found], id_type)], names=["a", "b"])

    return run


def _groups(torn: DataFrame) -> DataFrame:
    """rep, label and grp, the sets of documents that are compared with one another: for torn (band, low, rep, label).

    Buckets that share documents make a cluster. A cluster is one group if that takes fewer copies of sets than a group for
    each of its buckets does, so a chain of many small buckets is never compared as a whole.
    """
    clusters = components(torn.select(F.col("rep").alias("a"), F.col("low").alias("b"))).df
    placed = store(torn.join(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "rep"), "placed").df
    copies = lambda n: n * F.ceil(n / BLOCK_DOCS)
    by_band = placed.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum(copies(F.col("n"))).alias("apart"), F.sum("n").alias("rows"))
    whole = placed.select("cluster", "rep").distinct().groupBy("cluster").agg(copies(F.count(F.lit(1))).alias("together"))
    chosen = store(by_band.join(whole, "cluster").select("cluster", "rows", (F.col("together") <= F.col("apart")).alias("one")), "chosen").df
    split = attach(placed, chosen, "cluster", "rows", placed.count())
    return split.select("rep", "label", F.when(F.col("one"), F.xxhash64("cluster")).otherwise(F.xxhash64(F.lit("band"), "band")).alias("grp")).distinct()


def settle(docs: DataFrame, torn: DataFrame, plan: Plan) -> DataFrame:
    """Links between documents of different labels in the buckets of torn (stored: band, low, rep, label). docs: _id, _text.

    The documents of a group are cut into blocks, those of a large label into blocks of their own, and any two blocks that
    aren't of one label meet in a task, which gets each full set once and returns no more links than join the labels.
    """
    kind, arrow = _id_type(docs)
    members = store(_groups(torn), "members").df
    by_label = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    small = by_label.where(F.col("n") <= BLOCK_DOCS).groupBy("grp").agg(F.sum("n").alias("small"))
    sizes = store(by_label.join(small, "grp", "left").withColumn("_of", F.struct("grp", "label")).drop("grp", "label"), "sizes").df
    large = F.col("n") > BLOCK_DOCS
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / BLOCK_DOCS)
    blocks = attach(members.withColumn("_of", F.struct("grp", "label")), sizes, "_of", "n", members.count())
    blocks = blocks.select("grp", "rep", "label", F.when(large, F.col("label")).alias("whole"), F.pmod(F.xxhash64(F.when(large, F.col("rep")).otherwise(F.col("label"))), parts).alias("part"))
    blocks = store(blocks.withColumn("block", F.xxhash64("grp", "whole", F.col("whole").isNull(), "part")), "blocks").df
    kinds = store(blocks.groupBy("grp", "block", "whole").agg(F.count(F.lit(1)).alias("docs")), "kinds").df
    x, y = kinds.alias("x"), kinds.alias("y")
    tiles = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.whole") == F.col("y.whole"), F.lit(False)))
    tiles = tiles.select(F.array(F.col("x.block"), F.col("y.block")).alias("two"), F.xxhash64("x.block", "y.block").alias("tile"))
    tiles = tiles.select(F.explode(F.array_distinct("two")).alias("block"), "tile")
    needs = store(blocks.join(tiles, "block").select(F.col("rep").alias("id"), F.col("tile").alias("grp"), "label").distinct(), "needs").df
    sets = full_sets(docs, needs, plan)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_compare_all(plan.percent, arrow), f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id and kept.

    Words are runs without ASCII white space, A-Z lower-cased; a text's set holds its distinct shingles. Texts linked
    directly or through others form a component, named by its smallest id; kept marks that row. Texts without words
    (null, empty) are linked with nothing. Texts of the same words always belong together. A null id is in no component
    (component_id is null; kept). Rows of one id are one document, linked by any of its texts. Integer ids come back as long,
    others as strings and ordered as such. Whole texts count, however long. Other columns are ignored. An empty table gives
    no rows.

    Equal texts are merged before anything is compared. In each bucket all members are compared with a few pivots; where
    that leaves a bucket with more than one component, settle() compares its members of different components with one
    another, block by block. So every pair that shares a band is either connected or refuted, and no bucket is capped.
    """
    id_, kind, _ = own_id(docs, id_col)
    rows = docs.select(id_.alias("_id"), F.col(text_col).alias("_text"))
    signed = store(rows.mapInArrow(_sign(plan), f"_id {kind}, _n long, _key binary, _bands array<long>"), "signed")
    total = signed.df.count()
    classes = signed.df.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_count"))
    heads = signed.df.where(F.col("_id").isNotNull() & (F.col("_n") > 0)).groupBy("_key").agg(F.min(F.struct("_id", "_n", "_bands")).alias("_rep"))
    bands = heads.select(F.explode("_rep._bands").alias("band"), F.col("_rep._id").alias("rep"), F.col("_rep._n").alias("n"))
    bands = store(bands, "bands")
    several = store(bands.df.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("band", "low", "size"), "several")
    met = store(attach(bands.df, several.df, "band", "size", bands.df.count()), "met")
    bands.drop()
    several.drop()
    n_met = met.df.count()
    pivots = [F.min(F.struct("rep", "n"))] + [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("_"), F.struct("rep", "n").alias("p")))["p"] for k in range(1, PIVOTS)]
    chosen = store(met.df.groupBy("band").agg(F.array_distinct(F.array(*pivots)).alias("pivots"), F.count(F.lit(1)).alias("size")), "chosen")
    shared = store(attach(met.df.drop("size"), chosen.df, "band", "size", n_met), "shared")
    met.drop()
    chosen.drop()
    stars = shared.df.select("rep", "n", F.explode("pivots").alias("pivot")).where((F.col("rep") != F.col("pivot.rep")) & (100 * F.least("n", "pivot.n") >= plan.percent * F.greatest("n", "pivot.n")))
    stars = store(stars.select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b")).distinct(), "stars")
    labels = components(confirm(rows, stars.df, plan))
    labelled = shared.df.join(labels.df, F.col("rep") == F.col("node"), "left").select("band", "rep", "low", F.coalesce("label", "rep").alias("label"))
    labelled = store(labelled, "labelled")
    shared.drop()
    open_ = store(labelled.df.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most").select("band", "size"), "open")
    torn = store(attach(labelled.df, open_.df, "band", "size", n_met).drop("size"), "torn")
    labelled.drop()
    if not torn.df.isEmpty():
        more = store(settle(rows, torn.df, plan), "more").df
        labels = components(labels.df.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.join(labels.df, F.col("_rep") == F.col("node"), "left").select("_key", "_count", F.coalesce("label", "_rep").alias("_component"))
    named = store(named, "named")
    out = attach(signed.df.select("_id", "_n", "_key"), named.df, "_key", "_count", total)
    component = F.when((F.col("_n") == 0) | F.col("_id").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its own columns, with the rows of one id of each component: the smallest. Rows with null ids stay.

    The others are dropped where they are read, as far as a bitmap of ids can tell; only what it can't is shuffled.
    """
    groups = near_groups(docs, plan, id_col, text_col).where(~F.col("kept"))
    gone = store(groups.groupBy(F.col(id_col).alias("_gone")).agg(F.count(F.lit(1)).alias("_rows")), "gone").df
    return without(docs, id_col, gone, docs.count())


__all__ = ["Plan", "confirm", "drop_near", "near_groups", "shingles", "signature"]
