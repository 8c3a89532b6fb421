"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of every benchmark item."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, own_id, store

#: Words of one suffix array on average, and bytes of benchmark text searched for in one pass over the training texts.
SHARD_WORDS, BLOCK_BYTES = 400_000, 16_000_000
#: Suffixes searched for together, and places looked at together: they bound the memory of a search.
PROBES, PLACES = 1 << 19, 1 << 21

#: Letters A-Z lower-cased, other ASCII that isn't a letter or digit to a space; all else stays.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Items:
    """One block of benchmark items as one row of word numbers (from 1), a 0 after each item."""

    def __init__(self, items: Iterator[tuple[str, bytes | None]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        parts, sizes = [], []
        for name, text in items:
            if words := words_of(text):
                parts.append(np.array([*(self.ids.setdefault(w, len(self.ids) + 1) for w in words), 0], np.int32))
                self.names.append(name)
                sizes.append(len(parts[-1]))
        self.numbers = np.concatenate([*parts, np.zeros(1, np.int32)])
        self.starts = np.cumsum([0, *sizes])[:-1]
        self.ends = self.starts + np.array(sizes, np.int64) - 1

    def of(self, at: np.ndarray) -> np.ndarray:
        """The numbers of the items that places are in."""
        return np.searchsorted(self.starts, at, "right") - 1

    def probes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Every suffix that has a window, by its place, and the words of that: width, or all words of an item of fewer.

        The other suffixes are shorter than a window, so no match of theirs counts.
        """
        sizes = self.ends - self.starts
        first = np.maximum(sizes - width, 0) + 1
        item = np.repeat(np.arange(len(sizes)), first)
        at = self.starts[item] + np.arange(len(item)) - np.repeat(np.cumsum(first) - first, first)
        return at, np.minimum(sizes, width)[item]


class SuffixArray:
    """All suffixes of a shard of texts that begin with a known word, in order. A suffix ends at the next 0.

    Sorted by doubling: a round sorts the suffixes that agree in their first k words by the place of what follows those, so
    they agree in 2k words. Later rounds touch only what still agrees.
    """

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        self.numbers = numbers
        stops = np.append(np.flatnonzero(numbers == 0), n)
        left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)  # words until the next 0
        at = np.flatnonzero(numbers)
        at = at[np.argsort(numbers[at], kind="stable")]
        rank = np.zeros(2 * n + 1, np.int64)  # 0 for a stop, else 1 + the place of the first suffix that agrees
        new = np.concatenate([[True], numbers[at[1:]] != numbers[at[:-1]]]) if len(at) else np.zeros(0, bool)
        rank[at] = 1 + np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        k, open_ = 1, np.arange(len(at))
        while len(open_):
            group = rank[at[open_]]
            same = np.zeros(len(open_), bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
            # Suffixes of up to k words that agree so far are equal: nothing is left to tell them apart.
            open_ = open_[same]
            group = group[same]
            follows = rank[at[open_] + k]
            order = np.lexsort((follows, group))
            at[open_], follows = at[open_][order], follows[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])]) if len(open_) else np.zeros(0, bool)
            rank[at[open_]] = 1 + np.maximum.accumulate(np.where(new, open_, 0))
            k *= 2
            open_ = open_[left[at[open_]] > k // 2]
        self.at = at

    def find(self, items: Items, probes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each probe the range of suffixes that begin with its words, by binary searches word by word.

        Each search is within the range of the words before; a probe is given up where that is empty.
        """
        begins = np.searchsorted(self.numbers[self.at], np.arange(len(items.ids) + 2))  # the suffixes of each first word
        word = items.numbers[probes]
        low, high = begins[word], begins[word + 1]
        active = np.flatnonzero(low < high)
        for depth in range(1, int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            word = items.numbers[probes[active] + depth]
            low[active], high[active] = self._bound(depth, word, low[active], high[active]), self._bound(depth, word + 1, low[active], high[active])
            active = active[low[active] < high[active]]
        return low, high

    def _bound(self, depth: int, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in each range whose suffix has at least the word at this depth."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.numbers[self.at[middle] + depth] < word[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def _numbered(texts: list[list[bytes]], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, a 0 for unknown words and after each text, and where each text starts."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    numbers = np.zeros(starts[-1] + 1, np.int32)
    for start, words in zip(starts, texts, strict=False):
        numbers[start : start + len(words)] = np.fromiter(map(items.ids.get, words, repeat(0)), np.int32, len(words))
    return numbers, starts


def _extend(numbers: np.ndarray, items: Items, place: np.ndarray, probe: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words each match has: on from length until words differ or one side ends."""
    length, active = length.copy(), np.arange(len(place))
    while len(active):
        here = numbers[place[active] + length[active]]
        active = active[(here > 0) & (here == items.numbers[probe[active] + length[active]])]
        length[active] += 1
    return length


def maximal_matches(texts: list[list[bytes]], items: Items, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """All matches of a window or more that can't be made longer on either side, as arrays: place in the shard, item, place in
    the item, words. Each probe's places are looked at in parts of about PLACES, so repetitive texts take time, not memory.
    """
    numbers, _ = _numbered(texts, items)
    array = SuffixArray(numbers)
    all_probes, all_lengths = items.probes(width)
    for start in range(0, len(all_probes), PROBES):
        probes, lengths = all_probes[start : start + PROBES], all_lengths[start : start + PROBES]
        low, high = array.find(items, probes, lengths)
        met = np.flatnonzero(low < high)
        counts = np.cumsum(high[met] - low[met])
        total = int(counts[-1]) if len(counts) else 0
        for first in range(0, total, PLACES):
            pair = np.arange(first, min(first + PLACES, total))
            own = np.searchsorted(counts, pair, "right")
            place = array.at[low[met[own]] + pair - (counts[own] - (high - low)[met[own]])]
            probe, length = probes[met[own]], lengths[met[own]]
            # A pair whose words before agree too is the middle of a longer match, which another probe finds from its start.
            before = np.where(place > 0, numbers[place - 1], 0)
            left = np.where(probe > 0, items.numbers[probe - 1], 0)
            start_ = (before == 0) | (before != left)
            place, probe, length = place[start_], probe[start_], length[start_]
            item = items.of(probe)
            yield place, item, probe - items.starts[item], _extend(numbers, items, place, probe, length)


def _search_shard(texts: list[list[bytes]], items: Items, width: int) -> list[tuple[list[int], list[tuple[str, int, int, int]]]]:
    """For each text the spans of hit words (start, end, start, end, ...) and for each item found in it the item's name with
    the start in the text, the start in the item and the words of their longest match: the first of equals.
    """
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.zeros(starts[-1] + 2, np.int64)
    best = np.zeros((5, 0), np.int64)
    for place, item, inside, length in maximal_matches(texts, items, width):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + length, -1)
        doc = np.searchsorted(starts, place, "right") - 1
        rows = np.concatenate([best, np.stack([doc, item, place - starts[doc], inside, length])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[4], rows[1], rows[0]))]
        best = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])] if rows.shape[1] else rows
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(hit))
    doc_of = np.searchsorted(starts, turns[::2], "right") - 1
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for doc, a, b in zip(doc_of.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        out[doc][0].extend((a - int(starts[doc]), b - int(starts[doc])))
    for doc, item, start, inside, length in best.T.tolist():
        out[doc][1].append((items.names[item], start, inside, length))
    return out


def _search(texts: list[bytes | None], items: Items, width: int) -> Iterator[tuple[int, list[int], list[tuple[str, int, int, int]]]]:
    """The number of words of each text and what _search_shard finds, shard by shard."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size >= SHARD_WORDS or i == len(texts) - 1:
            for words, (spans, found) in zip(held, _search_shard(held, items, width), strict=True):
                yield len(words), spans, found
            held, size = [], 0


_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))
_FOUND = "n_words long, spans array<int>, matches array<struct<item: string, start: long, item_start: long, words: long>>"


def _find(shared: Broadcast, width: int, id_type: pa.DataType, hits_only: bool):
    schema = pa.schema([("_id", id_type), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("matches", _MATCHES)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in source:
            found = list(_search(as_bytes(batch.column("_text")), items, width))
            rows = [(id_, n, spans, [{"item": a, "start": b, "item_start": c, "words": d} for a, b, c, d in sorted(matches)]) for id_, (n, spans, matches) in zip(batch.column("_id").to_pylist(), found, strict=True) if spans or not hits_only]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[Items]]:
    """The number of blocks of about BLOCK_BYTES of text that the distinct items make, and the blocks, one at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))

    def made() -> Iterator[Items]:
        for block in range(blocks):
            here = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
            yield Items((r.name, r.text.encode()) for r in here.toLocalIterator())

    return blocks, made()


def _joined(spans: Column) -> Column:
    """Lists of spans as one: in order, and those that meet or overlap as one span."""
    two = F.transform(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), lambda i: F.struct(F.get(spans, (2 * i).cast("int")).alias("a"), F.get(spans, (2 * i + 1).cast("int")).alias("b")))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, x["b"])))
        return F.when((F.size(done) > 0) & (x["a"] <= F.try_element_at(done, F.lit(-1))), longer).otherwise(F.concat(done, F.array(x["a"], x["b"])))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(F.array_sort(two), F.array().cast("array<int>"), add))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_words, spans (start and end of each stretch of hit words) and matches.

    Words are runs of letters a-z, digits and non-ASCII characters after A-Z are lower-cased. A window is width words in
    a row of an item, or all words of an item with fewer. A word of a text is hit inside any occurrence of a window. matches
    has for each item found the longest verbatim match of a window or more: item, start (its first word in the text),
    item_start (in the item) and words; the first of equals. Null and empty texts have no words; items without words are never
    found; items with equal or null ids are named by the same string (null: empty), and the best of their matches counts.
    Ids may have any type; rows with equal or null ids are searched one by one. Only the named columns are read. Empty
    tables give no rows, or rows without matches.

    Each task makes suffix arrays of its texts, shard by shard (a very long text is one shard), and searches each for all
    suffixes of a block of the benchmark. A block has at most about BLOCK_BYTES of text (or one item), so it can be broadcast;
    blocks are searched for one after another and what they find is stored. With one block nothing is shuffled; with more, the
    texts are stored once with a number for each row, and finds are joined by it.
    """
    sc = docs.sparkSession.sparkContext
    id_, kind, arrow = own_id(docs, id_col)
    narrow = docs.select(id_.alias("_id"), F.col(text_col).alias("_text"))
    blocks, made = _blocks(benchmark, item_col, item_text_col)
    if blocks == 1:
        out = narrow.mapInArrow(_find(sc.broadcast(next(made)), width, arrow, False), f"_id {kind}, {_FOUND}")
    else:
        n_words = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(_WORD)).cast("long")
        rows = store(narrow.withColumns({"_row": F.monotonically_increasing_id(), "n_words": n_words}), "texts").df
        texts, hits = rows.select(F.col("_row").alias("_id"), "_text"), None
        for items in made:
            shared = sc.broadcast(items)
            found = store(texts.mapInArrow(_find(shared, width, pa.int64(), True), f"_id long, {_FOUND}"), "leaks").df
            shared.destroy()
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy(F.col("_id").alias("_row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches"))
        out = rows.select("_id", "_row", "n_words").join(hits, "_row", "left")
        out = out.withColumns({"spans": _joined(F.coalesce("spans", F.array().cast("array<int>"))), "matches": F.coalesce("matches", F.array())})
    best = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["item"].alias("item"), (-m["words"]).alias("less"), m["start"].alias("start"), m["item_start"].alias("item_start"), m["words"].alias("words")))),
        F.array().cast("array<struct<item: string, start: long, item_start: long, words: long>>"),
        lambda done, m: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["item"] == m["item"]), done).otherwise(F.concat(done, F.array(F.struct(m["item"].alias("item"), m["start"].alias("start"), m["item_start"].alias("item_start"), m["words"].alias("words"))))),
    )
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", best.alias("matches"))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"].cast("long"))


def _filter(shared: Broadcast, width: int, text_col: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in source:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([not spans for _, spans, _ in _search(texts, items, width)], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, with its own columns, without the rows in whose text a window of the benchmark occurs.

    Rows are dropped where they are read, whatever their ids; nothing is shuffled or joined. Texts, windows and blocks are
    those of find_leaks(); with more blocks than one, what each leaves is stored before the next is searched for.
    """
    sc = docs.sparkSession.sparkContext
    blocks, made = _blocks(benchmark, item_col, item_text_col)
    for k, items in enumerate(made):
        shared = sc.broadcast(items)
        docs = docs.mapInArrow(_filter(shared, width, text_col), docs.schema)
        if k < blocks - 1:
            docs = store(docs, "clean").df
            shared.destroy()
    return docs
