"""Language identification by the nearest of several centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Rows that a model is fitted on at most, dealt evenly over the languages: those of the least hashes of ids. Every language
#: gets one row at least, so with more languages than this there are as many rows as languages.
TRAIN_ROWS = 3_000
#: Ids drawn of each language before the least hashes are chosen, so that chance leaves none without.
DRAWN = 40
#: Buckets of hashed character n-grams (of 1 to 3 characters), and centroids for each language.
BITS, CENTROIDS, ROUNDS = 13, 3, 10
#: A text is rejected if its cosine is below MARGIN times this quantile of its language's training cosines at its length.
QUANTILE, MARGIN = 0.01, 0.8
#: Starts of training texts, in characters, that stand for short texts; cosines that a quantile is taken from, if there are.
CUTS, ENOUGH = (2, 4, 8, 16, 32, 64, 128, 256), 50
#: Centroids that a task holds as a dense matrix at a time; the model itself holds them as sparse rows.
TOGETHER = 512

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def n_grams(text: str | None) -> np.ndarray | None:
    """The buckets of all n-grams of a whole text; None without a letter. What isn't a letter counts as one space."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return None
    before = np.concatenate([[True], letter[:-1]])
    x = np.where(letter, points, np.uint32(32))[letter | before]
    x = np.concatenate([x, np.array([32], np.uint32)]) * np.uint32(0x9E3779B1)
    grams = [x, x[:-1] * np.uint32(31) + x[1:] + np.uint32(7)]
    if len(x) > 2:
        grams.append(grams[1][:-1] * np.uint32(33) + x[2:] + np.uint32(11))
    h = np.concatenate(grams)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: Centroids as sparse rows: the buckets and values of row i stand from ends[i - 1] to ends[i].
    seen: np.ndarray
    values: np.ndarray
    ends: np.ndarray
    #: The number of each centroid's language.
    owner: np.ndarray
    #: The least cosine that isn't rejected, for each language and band of lengths.
    least: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _dense(self, start: int) -> np.ndarray:
        """Centroids start to start + TOGETHER. The only part of a small model is kept."""
        held = getattr(self, "_held", None)
        if held is None or held[0] != start:
            ends = self.ends[start : start + TOGETHER]
            first = self.ends[start - 1] if start else 0
            rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=first))
            part = np.zeros((len(ends), 1 << BITS), np.float32)
            part[rows, self.seen[first : ends[-1]]] = self.values[first : ends[-1]]
            held = self._held = (start, part)
        return held[1]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language and the cosine for each row of n-gram counts; the first of equals."""
        x, at = self.weigh(counts), np.arange(len(counts))
        best, cosine = np.zeros(len(counts), np.int64), np.full(len(counts), -1.0)
        for start in range(0, len(self.ends), TOGETHER):
            likeness = x @ self._dense(start).T
            here = likeness.argmax(axis=1)
            found = likeness[at, here]
            better = found > cosine
            best, cosine = np.where(better, start + here, best), np.where(better, found, cosine)
        return self.owner[best], np.clip(cosine, 0.0, 1.0)

    def rejects(self, best: np.ndarray, cosine: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether each row with what predict() found is too far from its language for its length."""
        return cosine < self.least[best, _band((counts > 0).sum(axis=1))]


def _band(distinct: np.ndarray) -> np.ndarray:
    """Lengths count in different n-grams, so that one word said a thousand times is as short as the word; bands are powers of 2."""
    return np.log2(np.maximum(distinct, 1)).astype(np.int64)


def _cluster(x: np.ndarray) -> np.ndarray:
    """Spherical k-means from the rows farthest from one another; no chance is involved."""
    centre = x.mean(axis=0)
    chosen = [int((x @ centre).argmax())]
    while len(chosen) < min(CENTROIDS, len(x)):
        nearest = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(nearest.argmin()))
    c = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _others(x: np.ndarray, c: np.ndarray, texts: list[list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """The bands and cosines of the vectors of each row (itself and its starts) with centroids that the row has no part in."""
    own = (x @ c.T).argmax(axis=1)
    sums = np.stack([x[own == k].sum(axis=0) for k in range(len(c))])
    size, norm = np.bincount(own, minlength=len(c)), (sums * sums).sum(axis=1)
    bands, cosines = [], []
    for row, k, vectors in zip(x, own, texts, strict=True):
        left = size - (np.arange(len(c)) == k)
        if not left.any():
            continue
        rest = norm.copy()
        rest[k] += 1 - 2 * (sums[k] @ row)
        for seen, v in vectors:
            dots = sums[:, seen] @ v
            dots[k] -= row[seen] @ v
            bands.append(len(seen))
            cosines.append((dots / np.sqrt(np.maximum(rest, 1e-12)))[left > 0].max())
    return _band(np.array(bands, np.int64)), np.array(cosines)


def _limits(bands: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine kept in each band. A band of too few cosines is joined by the shorter ones next to it, then by longer ones."""
    order = np.argsort(bands, kind="stable")
    bands, cosines, out = bands[order], cosines[order], np.zeros(BITS + 1)
    for b in range(BITS + 1 if len(bands) else 0):
        start, end = np.searchsorted(bands, [b, b + 1])
        start = max(0, min(start, end - ENOUGH))
        start = np.searchsorted(bands, bands[min(start, len(bands) - 1)])
        end = min(len(bands), max(end, start + ENOUGH))
        out[b] = MARGIN * np.quantile(cosines[start:end], QUANTILE)
    return out


def _sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, id and text of the training rows: for each label the ids of the least hashes, as many as its share of TRAIN_ROWS.

    Rows without id, label or a letter are never drawn; of rows with equal label and id the least text is. A label's ids
    are thinned by a coin to some DRAWN or twice its share before they are ranked, so no task ranks a hot label.
    """
    known = rows.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    sizes = store(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "labels").df
    labels = sizes.count()
    share = max(1, TRAIN_ROWS // max(labels, 1))
    rates = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max(2 * share, DRAWN))) / F.col("n")).alias("rate"))
    rates = F.broadcast(rates) if labels <= 100_000 else rates
    key = F.xxhash64("id", F.lit(23))
    drawn = known.select("lang", "id").join(rates, "lang").where(F.pmod(key, F.lit(1 << 30)) < F.col("rate") * float(1 << 30))
    ranked = drawn.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(key, "id")))
    chosen = store(ranked.where(F.col("rank") <= share).select("lang", "id"), "drawn").df
    few = F.broadcast(chosen) if labels <= 100_000 else chosen
    return known.join(few, ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a language: whole texts of at most TRAIN_ROWS rows, or one of each language if those are more.

    No language that has a text with a letter and an id is lost. Repeated rows of one id count once; null labels, ids and
    texts and texts without letters are left out; ties of hashes go by id. An empty table makes a model that knows no
    language. Only n-gram counts reach the driver. The model grows with the number of languages, not of rows.
    """

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for lang, id_, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "id", "text")), strict=True):
                starts = [n_grams(text), *(n_grams(text[:c]) for c in CUTS if c < len(text))]
                if starts[0] is not None:
                    found = [np.unique(g, return_counts=True) for g in starts if g is not None]
                    out.append((lang, id_, *(b"".join(x[i].astype(t).tobytes() for x in found) for i, t in ((0, np.uint16), (1, np.float32))), [len(x[0]) for x in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("lang", pa.string()), ("id", pa.string()), ("seen", pa.binary()), ("n", pa.binary()), ("sizes", pa.list_(pa.int32()))]))

    sample = sorted(_sample(rows, id_col, text_col, lang_col).mapInArrow(counted, "lang string, id string, seen binary, n binary, sizes array<int>").collect())
    texts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    of: dict[str, list[int]] = {}
    for i, r in enumerate(sample):
        at = np.cumsum(r["sizes"])[:-1]
        texts.append(list(zip(np.split(np.frombuffer(r["seen"], np.uint16), at), np.split(np.frombuffer(r["n"], np.float32), at), strict=True)))
        of.setdefault(r["lang"], []).append(i)
    known_in = np.zeros(1 << BITS)
    for t in texts:
        known_in[t[0][0]] += 1
    idf = (np.log((1 + len(texts)) / (1 + known_in)) + 1).astype(np.float32)
    seen, values, sizes, owner, found = [np.empty(0, np.uint16)], [np.empty(0, np.float32)], [], [], []
    for k, rows_of in enumerate(of.values()):  # a language at a time: only its rows are ever dense
        weighed = [[(b, (w := np.log1p(n) * idf[b]) / max(np.linalg.norm(w), 1e-12)) for b, n in texts[i]] for i in rows_of]
        x = np.zeros((len(rows_of), 1 << BITS), np.float32)
        for i, t in enumerate(weighed):
            x[i, t[0][0]] = t[0][1]
        centroids = _cluster(x)
        found.append(_others(x, centroids, weighed))
        for c in centroids:
            seen.append(np.flatnonzero(c).astype(np.uint16))
            values.append(c[seen[-1]].astype(np.float32))
            sizes.append(len(seen[-1]))
            owner.append(k)
    least = np.zeros((len(of), BITS + 1))
    if found:
        anywhere = _limits(*(np.concatenate(c) for c in zip(*found, strict=True)))
        least = np.stack([_limits(*f) if len(f[0]) else anywhere for f in found])
    return Model(list(of), idf, np.concatenate(seen), np.concatenate(values), np.cumsum(sizes, dtype=np.int64), np.array(owner, np.int64), least)


def identify(rows: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", together: int = 64) -> DataFrame:
    """One row per row: id_col, lang_pred, score (the cosine, 0 to 1) and rejected.

    lang_pred is the language of the nearest centroid, the first of equals in the order of names, or und (score 0, rejected)
    if the text is null or has no letter, or if nothing was learned. A text farther from its nearest centroid, by MARGIN, than
    all but the QUANTILE of that language's training texts of its length are from centroids of the others is rejected but
    keeps its nearest language. Ids may have any type or be null; repeated rows get equal results. Only the two named columns
    are read. Whole texts count. Rows are scored where they are read, with TOGETHER dense centroids in memory at a time. An
    empty table gives no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in source:
            texts = batch.column("_text")
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for start in range(0, len(texts), together):
                grams = [n_grams(t) for t in texts.slice(start, together).to_pylist()]
                there = [i for i, g in enumerate(grams) if g is not None] if m.languages else []
                if not there:
                    continue
                counts = np.stack([np.bincount(grams[i], minlength=1 << BITS).astype(np.float32) for i in there])
                best, cosine = m.predict(counts)
                at = start + np.array(there)
                score[at], rejected[at] = cosine, m.rejects(best, cosine, counts)
                for i, k in zip(at, best, strict=True):
                    lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(lang), pa.array(score), pa.array(rejected)], names=["_id", "lang_pred", "score", "rejected"])

    narrow = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(scored, f"_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, with its own columns, without the rows that identify() rejects; filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chosen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in source:
            texts, keep = batch.column(batch.schema.get_field_index(text_col)), []
            for start in range(0, len(texts), 64):
                for g in (n_grams(t) for t in texts.slice(start, 64).to_pylist()):
                    if g is None or not m.languages:
                        keep.append(False)
                        continue
                    counts = np.bincount(g, minlength=1 << BITS).astype(np.float32)[None]
                    keep.append(not m.rejects(*m.predict(counts), counts)[0])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)
