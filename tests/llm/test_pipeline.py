"""The pipeline and the registered queries against plain versions on the smallest tables."""

import importlib
import re
import sys
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from kbspark.llm import language_id, queries

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def windows(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain_pipeline(rows, rejected, items):
    rows = [r for r in sorted(rows) if r[0] not in rejected]
    texts, kept = set(), []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in texts:
            texts.add(norm)
            kept.append((i, t))
    sets = {}
    for i, t in kept:
        w = words(lower(t))
        sets[i] = windows(w, 5) if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    kept = [(i, t) for i, t in kept if find(i) == i]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    probes = set()
    for t in items:
        w = re.findall(pattern, lower(t))
        probes |= windows(w, min(10, len(w))) if w else set()
    sizes = {len(p) for p in probes}
    return [(i, t) for i, t in kept if not any(windows(re.findall(pattern, lower(t)), n) & probes for n in sizes)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language_id.fit(docs.where(~queries.held_out()))
    rejected = {r.doc_id for r in language_id.identify(docs, model).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    wanted = plain_pipeline(rows, rejected, items)
    found = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in found} == {i for i, _ in wanted}
    total = Counter()
    for r in found:
        total[r.doc_id] += r.size
    assert total == {i: len(words(t)) + 1 for i, t in wanted}
    assert max(Counter({b: sum(r.size for r in found if r.bin_id == b) for b in {r.bin_id for r in found}}).values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "the and of", None, None, None, "x"), (None, None, "en", "s", 1, None)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            left = stage(spark, rows, DIR)
            assert left.columns == docs.columns
            left.collect()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    order = sorted(rel.columns)
    wanted = sorted((tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == wanted


def test_shards_of_documents(spark):
    found = queries.op4_shard_interleave(spark, DIR).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 and r.law == "rows" and r.grown_shard is None for r in found)
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(texts) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s])) for s in sizes)


def test_near_duplicates_of_documents(spark):
    """op6 against all pairs of sets."""
    rows = sorted((r.doc_id, words(lower(r.text))) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    sets = {i: windows(w, 3) if len(w) >= 3 else {tuple(w)} if w else set() for i, w in rows}
    label = {i: i for i in sets}
    changed = True
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    found = queries.op6_minmax_near_dedup(spark, DIR).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(s), label[i]) for i, s in sets.items()}


def test_classifiers_of_documents(spark):
    found = queries.op10_language_id(spark, DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    graded = queries.op1_quality_ordinal(spark, DIR).collect()
    assert len(graded) == len(found) and all(0 <= r.p_tail <= 1 for r in graded)


def test_all_are_registered():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_faults_of_the_dealt_operators_are_not_hidden(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "xxhash", None)
    for name in [m for m in sys.modules if m.startswith("kbspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ImportError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
