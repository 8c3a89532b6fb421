"""Removal of repeated passages by suffix automata over the passages that documents may share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, WordHashes, as_bytes, attach, marked, own_id, rolling, store, stretches

#: Words of the anchors by which windows are dealt to reference shards.
ANCHOR_WORDS = 8
#: Words that one automaton holds on average; a shard with more gets several, whose findings are merged.
SHARD_WORDS = 20_000
#: Anchors of more than this share of all (document, anchor) pairs are dealt over SALTS shards; there are at most HOT_ANCHORS.
HOT_ANCHORS, SALTS = 20_000, 64


class SuffixAutomaton:
    """All substrings of the texts added so far, each with the number of the first text that has it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, moves: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the substrings of q that p and word make, so that q keeps only longer ones."""
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], number: int) -> None:
        moves, link, length, last = self.next, self.link, self.length, 0
        for word in words:
            q = moves[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                continue
            p, new = last, self._state({}, 0, length[last] + 1, number)
            while p >= 0 and word not in moves[p]:
                moves[p][word] = new
                p = link[p]
            if p >= 0:
                q = moves[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = new

    def stream(self, words: list[bytes], width: int) -> list[int]:
        """Matching statistics cut at width: for each run of width words the number of the first text that has it, or -1."""
        moves, link, length, state, matched, out = self.next, self.link, self.length, 0, 0, []
        for i, word in enumerate(words, 1):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state, matched = moves[state][word], matched + 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if i >= width:
                out.append(self.first[state] if matched >= width else -1)
        return out


def anchors(ids: np.ndarray, width: int) -> np.ndarray:
    """For each window of width words the least hash of its word n-grams: equal windows have equal anchors."""
    grams = rolling(ids, min(ANCHOR_WORDS, width))
    span, reach = width - min(ANCHOR_WORDS, width) + 1, 1
    least = grams
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _anchors_and_runs(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a text, each with a hash of all stretches of words whose windows it anchors."""
    anchor = anchors(ids, width)
    breaks = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(anchor)]])
    distinct, of = np.unique(anchor[starts], return_inverse=True)
    runs = np.zeros(len(distinct), np.uint64)
    np.add.at(runs, of, stretches(ids, starts, ends + width - 1))
    return distinct, runs


def _list_anchors(width: int, id_type: pa.DataType):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in source:
            found, sizes = [(np.empty(0, np.uint64), np.empty(0, np.uint64))], []
            for text in as_bytes(batch.column("_text")):
                words = text.split() if text else []
                found.append(_anchors_and_runs(hashes.of(words), width) if len(words) >= width else found[0])
                sizes.append(len(found[-1][0]))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            anchor, runs = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([anchor, runs, batch.column("_id").take(at).cast(id_type), batch.column("_h").take(at)], names=["anchor", "runs", "doc", "h"])

    return run


def _held(column: pa.ListArray) -> list[np.ndarray]:
    """Lists of longs as sorted arrays; null as empty."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [np.sort(values[a:b]).view(np.uint64) if b > a else np.empty(0, np.uint64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _runs(open_: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each stretch of open windows with one anchor."""
    if not open_.any():
        return
    breaks = np.flatnonzero((anchor[1:] != anchor[:-1]) | (open_[1:] != open_[:-1])) + 1
    edges = np.concatenate([[0], breaks, [len(anchor)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if open_[a]:
            yield a, b


def _list_runs(width: int, hot_anchors: Broadcast, id_type: pa.DataType):
    schema = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("run", pa.binary()), ("doc", id_type), ("h", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hot = WordHashes(), hot_anchors.value
        for batch in source:
            rows, size = [], 0
            for id_, h, text, asked in zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist(), as_bytes(batch.column("_text")), _held(batch.column("_asked")), strict=True):
                words = text.split()
                anchor = anchors(hashes.of(words), width)
                for a, b in _runs(np.isin(anchor, asked), anchor):
                    key = int(anchor[a : a + 1].view(np.int64)[0])
                    rows.append((key, 1 + xxhash.xxh3_64_intdigest(str(id_)) % SALTS if key in hot else 0, b" ".join(words[a : b + width - 1]), id_, h))
                    size += len(rows[-1][2])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _match(width: int, id_type: pa.DataType):
    """Runs sorted by anchor, salt, document: the windows that no run of a smaller document in the same automaton has.

    settled: the automaton has all runs of the anchor. Then nothing is told of the smallest document, which has all its windows
    first, as every reader of the findings knows.
    """
    schema = pa.schema([("doc", id_type), ("h", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64()), ("settled", pa.bool_())])

    def found(runs: list[tuple[list[bytes], int | str, int]], anchor: int, settled: bool, hashes: WordHashes, out: list[tuple]) -> None:
        if settled and all(doc == runs[0][1] for _, doc, _ in runs):
            return
        automaton = SuffixAutomaton()
        for number, (words, *_) in enumerate(runs):
            automaton.add(words, number)
        owner = np.cumsum([0, *(a[1] != b[1] for a, b in zip(runs, runs[1:]))])  # runs of one document have one number
        for number, (words, doc, h) in enumerate(runs):
            if settled and not owner[number]:
                continue
            windows = rolling(hashes.of(words), width).view(np.int64)
            first = owner[np.array(automaton.stream(words, width), np.int64)]
            out += [(doc, h, anchor, window, settled) for window in np.unique(windows[first == owner[number]]).tolist()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, seen, runs, size, several, last = WordHashes(), None, {}, [], 0, False, None
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in source:
            for anchor, salt, text, doc, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (anchor, salt):
                    if runs:
                        found(runs, key[0], not several and not key[1], hashes, out)
                    key, seen, runs, size, several = (anchor, salt), {}, [], 0, False
                # A run that an earlier document has too has no window first, and one of a copy of a row says nothing new.
                if seen.get(text, doc) != doc or runs and last == (doc, h, text):
                    continue
                if size > SHARD_WORDS:
                    found(runs, anchor, False, hashes, out)
                    seen, runs, size, several = {}, [], 0, True
                seen[text], last = doc, (doc, h, text)
                runs.append((text.split(), doc, h))
                size += len(runs[-1][0])
            if len(out) > 4_000:
                yield batch_of()
                out = []
        if runs:
            found(runs, key[0], not several and not key[1], hashes, out)
        if out:
            yield batch_of()

    return run


def _remove(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in source:
            n_words, n_removed, kept = [], [], []
            for text, late, first in zip(as_bytes(batch.column("_text")), _held(batch.column("_late")), _held(batch.column("_first")), strict=True):
                words = text.split() if text else []
                n_words.append(len(words))
                n_removed.append(0)
                if len(words) >= width and len(late):
                    ids = hashes.of(words)
                    repeated = np.isin(anchors(ids, width), late)
                    if repeated.any() and len(first):
                        repeated &= ~np.isin(rolling(ids, width), first)
                    if repeated.any():
                        edge = np.zeros(len(words) + 1, np.int32)
                        edge[: len(repeated)] += repeated
                        edge[width:] -= repeated
                        stays = np.cumsum(edge[:-1]) == 0
                        n_removed[-1] = len(words) - int(stays.sum())
                        words = [words[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed and kept_text (the words left, joined by one space).

    Words are runs without ASCII white space. A word is removed if a window of width words covers it whose words also
    stand, in a row, in a text with a smaller id; windows are judged on the input. Null and empty texts have no words.
    Integer ids come back as long, others as strings and ordered as such. Rows with null ids lose nothing and take nothing from
    others; rows with equal ids take nothing from one another. Whole texts count. Other columns are ignored. An empty table
    gives no rows.

    Windows are dealt to reference shards by their anchor, the least hash among their word n-grams. Anchors of a single
    document are settled by a count; where all documents of an anchor have it within the same words, the smallest has all its
    windows first. Of the other anchors, the smallest document of each wording sends its passages to a shard. There the
    passages, in order of ids, make suffix automata of bounded size, and each passage streamed through one learns which document
    has each of its windows first. Frequent anchors are dealt over several shards. Findings of different automata are merged
    by window, so nothing depends on where a shard was cut.

    Texts that no shard asks for, and those that lose nothing, are never shuffled: a bitmap of bounded size tells them where they
    are read. Lists of anchors and windows belong to an id and text, so rows that share an id share none but with their copies.
    """
    spark = docs.sparkSession
    id_, kind, arrow = own_id(docs, id_col)
    rows = docs.select(id_.alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    named = rows.where("_id IS NOT NULL AND _text IS NOT NULL")
    listed = store(named.mapInArrow(_list_anchors(width, arrow), f"anchor long, runs long, doc {kind}, h long"), "listed").df
    ends = listed.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    several = store(ends.select("anchor"), "several").df
    listed = store(marked(listed, F.col("anchor"), several, "anchor").where("_maybe").drop("_maybe"), "near").df
    pairs = listed.count()
    counted = listed.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("runs").alias("_least"), F.max("runs").alias("_most"), F.count(F.lit(1)).alias("n"))
    counted = store(counted.where("low < high").select("anchor", "low", "n", (F.col("_least") != F.col("_most")).alias("contested")), "anchors").df
    floor = max(pairs // HOT_ANCHORS, 1_000)
    hot = spark.sparkContext.broadcast({r.anchor for r in counted.where(F.col("contested") & (F.col("n") >= floor)).select("anchor").collect()})
    total = rows.count()
    same = F.struct(F.col("_id"), F.col("_h")).alias("_key")
    often = store(named.groupBy(same).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= max(total // HOT_SHARE, HOT_ROWS)), "often").df

    def listing(found: DataFrame, label: str) -> DataFrame:
        """found, lists for each _key, with how many rows have the key (1 for all but hot ones)."""
        return store(found.join(F.broadcast(often), "_key", "left").withColumn("_rows", F.coalesce("_rows", F.lit(1))), label).df

    own = F.struct(F.col("doc").alias("_id"), F.col("h").alias("_h")).alias("_key")
    shared = store(attach(listed, counted, "anchor", "n", pairs).drop("n"), "shared").df
    wordings = shared.where("contested").select(F.struct("anchor", "runs").alias("_of"), "anchor", "doc", "h")
    least = store(wordings.groupBy("_of").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n")), "wordings").df
    asked = listing(attach(wordings, least, "_of", "n", pairs).where("doc = low").groupBy(own).agg(F.collect_set("anchor").alias("_asked")), "asked")
    late = listing(shared.where("low < doc").groupBy(own).agg(F.collect_set("anchor").alias("_late")), "late")
    flagged = marked(named.select(same, "_text"), F.col("_key"), asked, "_key").where("_maybe").drop("_maybe")
    texts = attach(flagged, asked, "_key", "_rows", total).select("_key._id", "_key._h", "_text", "_asked")
    runs = texts.mapInArrow(_list_runs(width, hot, arrow), f"anchor long, salt int, run binary, doc {kind}, h long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = runs.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "h", "run").mapInArrow(_match(width, arrow), f"doc {kind}, h long, anchor long, window long, settled boolean")
    found = store(found, "passages").df
    open_ = found.where("not settled").select(F.struct("anchor", "window").alias("_of"), "doc", "h", "window")
    firsts = store(open_.groupBy("_of").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n")), "firsts").df
    merged = attach(open_, firsts, "_of", "n", found.count()).where("doc = low").select("doc", "h", "window")
    first = found.where("settled").select("doc", "h", "window").unionByName(merged).groupBy(own).agg(F.collect_set("window").alias("_first"))
    judged = store(late.join(first, "_key", "left").withColumn("_first", F.coalesce("_first", F.array().cast("array<long>"))), "judged").df
    empty = F.array().cast("array<long>")
    parted = marked(rows.select(same, "_text"), F.col("_key"), judged, "_key")
    changed = F.col("_maybe") & F.col("_key._id").isNotNull()
    whole = parted.where(~changed).select("_key._id", "_text", empty.alias("_late"), empty.alias("_first"))
    cut = attach(parted.where(changed).drop("_maybe"), judged, "_key", "_rows", total, "left").select("_key._id", "_text", F.coalesce("_late", empty).alias("_late"), F.coalesce("_first", empty).alias("_first"))
    out = whole.unionByName(cut).mapInArrow(_remove(width), f"_id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", id_col)
