"""Exact, near and substring deduplication and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import decontaminate, exact_dedup, near_dedup, substring_dedup
from kbspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _id long, label string, digest string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(seed=1, n=120):
    """Copies, near copies, shared passages, nulls in any column, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "Ünï", "!!", "x.y"]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 160))) for _ in range(n // 3)]
    passage = " ".join(r.choices(vocabulary, k=70))
    rows = []
    for i in range(n):
        t = r.choice(texts)
        words = t.split(" ")
        kind = r.random()
        if kind < 0.3:
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = "changed"
        elif kind < 0.5:
            at = r.randint(0, len(words))
            words[at:at] = passage.split(" ")
        elif kind < 0.6:
            words = [w.upper() for w in words]
        rows.append((i, r.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, " ".join(["a", "b", "a"] * 8000)), (n + 4, "a b"), (n + 5, "A\tb"), (None, rows[0][1]), (None, None), rows[5], rows[5], (n + 6, "one")]
    return [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "s", None, True, 3, "x", "y") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def test_perfect_hash_is_minimal_and_tells_strangers():
    r = np.random.default_rng(3)
    keys, others = r.integers(0, 256, (5000, 32), np.uint8), r.integers(0, 256, (500, 32), np.uint8)
    index = exact_dedup.PerfectHash(keys)
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000)) and index.size == 5000
    found = index.slots(others)
    assert not any((keys[np.argsort(slots)][s] == o).all() for s, o in zip(found, others) if s >= 0)
    assert exact_dedup.PerfectHash(keys[:0]).slots(others).max() == -1


def test_exact(spark, docs):
    norm = {}
    for i, t, *_ in awkward():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = []
    for t, ids in norm.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_dedup.find_repeats(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    left = exact_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for _, k, *_ in expected}


def test_repeated_rows_are_dropped(spark):
    """One row of each text is left, also where rows share their id or have none."""
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a  b", "w"), (2, "a b", "x"), (None, "a b", "x"), (None, "n", "x"), (None, "n", "x"), (3, None, "x"), (3, "", None), (3, "c", "x"), (4, "d", "x"), (None, "d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").repartition(3)
    found = sorted((tuple(r) for r in exact_dedup.drop_repeats(docs).collect()), key=repr)
    assert len(found) == 5 and {(i, " ".join((t or "").split())) for i, t, _ in found} == {(1, "a b"), (None, "n"), (3, ""), (3, "c"), (4, "d")}
    assert sorted((tuple(r) for r in exact_dedup.drop_repeats(docs.repartition(5)).collect()), key=repr) == found
    many = docs.where("doc_id = 4").crossJoin(spark.range(500)).select(docs.columns)
    assert exact_dedup.drop_repeats(many).count() == 1


def test_history_is_kept_and_looked_up(spark):
    """Three corpora, one after another: what the history knows goes, whatever its ids."""
    corpora = [[(5, "a b"), (6, "a  b"), (7, "c")], [(1, "a\tb"), (2, "d"), (3, "d"), (None, "e")], [(9, "e"), (9, "d"), (8, "new"), (8, None), (10, "")]]
    known, seen = {}, spark.createDataFrame([], "digest binary, first long, n long")
    for k, rows in enumerate(corpora):
        docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, known string")
        found = exact_dedup.find_repeats(docs, history=seen).collect()
        norm = [(i, " ".join((t or "").split())) for i, t in rows]
        for r, t in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.digest)), sorted(norm, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).digest())), strict=True):
            here = [i for i, x in norm if x == t[1]]
            first = known[t[1]][0] if t[1] in known else min((i for i in here if i is not None), default=None)
            assert (r.doc_id, r.keep_id, r.known) == (t[0], first, t[1] in known), (k, t)
            assert r.group_size == len(here) + (known[t[1]][1] if t[1] in known else 0)
            assert r.kept == (t[1] not in known and r.doc_id == first)
        left = exact_dedup.drop_repeats(docs, history=seen)
        assert sorted(" ".join((r.text or "").split()) for r in left.collect()) == sorted({t for _, t in norm} - set(known))
        seen = spark.createDataFrame(seen.unionByName(exact_dedup.history_of(left)).collect(), seen.schema)
        for r in seen.collect():
            t = next(t for t in {x for _, x in norm} | set(known) if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
            known[t] = (r.first, r.n)


def test_ids_may_be_strings(spark):
    """Every operator on ids that no number can be made of finds what it finds on numbers in the same order."""
    rows = [(i, t) for i, t, *_ in awkward(3, 60)]
    name = lambda i: None if i is None else f"doc-{i:05}"
    numbers = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([(name(i), t) for i, t in rows], "doc_id string, text string")
    bench = spark.createDataFrame([(1, "a b a a b a a b a a")], "item_id long, text string")
    same = lambda x, y: sorted((tuple(name(v) if k in ids else v for k, v in enumerate(r)) for r in x.collect()), key=repr) == sorted(map(tuple, y.collect()), key=repr)
    ids = {0, 2}
    assert same(*(exact_dedup.find_repeats(d).drop("known") for d in (numbers, names)))
    assert same(*(near_dedup.near_groups(d, near_dedup.Plan(3, 85, 8)) for d in (numbers, names)))
    ids = {0}
    assert same(*(substring_dedup.remove_passages(d, 12) for d in (numbers, names)))
    assert same(*(decontaminate.find_leaks(d, bench) for d in (numbers, names)))
    assert same(*(exact_dedup.drop_repeats(d) for d in (numbers, names)))
    assert same(*(near_dedup.drop_near(d) for d in (numbers, names)))


def test_rows_of_one_id_take_nothing_from_one_another(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(5, "x " + passage), (5, passage + " y"), (5, passage + " y"), (9, "z " + passage), (None, passage)]
    found = substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found) == [(0, 30, 0), (5, 31, 0), (5, 31, 0), (5, 31, 0), (9, 31, 30)]


def shingle_set(text, width):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


@pytest.mark.parametrize(("width", "percent", "rows"), [(3, 85, 8), (5, 80, 6)])
def test_near(spark, docs, width, percent, rows):
    sets = [(i, shingle_set(t, width)) for i, t, *_ in awkward()]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(known):
        for j, b in known[k + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    expected = [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]
    found = near_dedup.near_groups(docs, near_dedup.Plan(width, percent, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_settles_buckets_that_pivots_leave_open(spark, monkeypatch):
    """A ring of texts, each linked only with its neighbours, and blocks of one document."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 2)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"n{j}" for j in range(i)] + base[i:]) for i in range(0, 40, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = near_dedup.Plan(1, 85, 1)
    sets = [set(t.split()) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, plan).collect()}
    assert found == {i: find(i) for i in range(len(sets))}


def test_min_max_signature_estimates_similarity():
    r = np.random.default_rng(0)
    items = np.sort(r.integers(0, 1 << 63, 1200, np.uint64))
    a, b = items[:1000], items[200:]
    factors, masks = near_dedup.Plan(rows=8, percent=85).functions()
    agree = (near_dedup.signature(a, factors, masks) == near_dedup.signature(b, factors, masks)).mean()
    assert abs(agree - 800 / 1200) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(50, 40), (45, 50), (45, 40)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert found == {**{i: i // 10 * 10 for i in range(31) if i != 30}, **({30: 30} if (29, 30) in edges else {}), 50: 40, 45: 40, 40: 40}


def windows_of(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


@pytest.mark.parametrize(("width", "shard"), [(50, 20_000), (12, 200)])
def test_passages(spark, docs, monkeypatch, width, shard):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in awkward()]
    first = {}
    for i, words in rows:
        for w in windows_of(words, width) if i is not None else ():
            first[w] = min(i, first.get(w, i))
    expected = []
    for i, words in rows:
        gone = set()
        for k, w in enumerate(windows_of(words, width)) if i is not None else ():
            if first[w] < i:
                gone.update(range(k, k + width))
        expected.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    found = [tuple(r) for r in substring_dedup.remove_passages(docs, width).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), min_size=1, max_size=6), st.integers(1, 5))
def test_automaton_knows_who_was_first(texts, width):
    automaton = substring_dedup.SuffixAutomaton()
    first = {}
    for n, words in enumerate(texts):
        automaton.add(words, n)
        for w in windows_of(words, width):
            first.setdefault(w, n)
    for words in [*texts, [b"a", b"z", *texts[0]]]:
        assert automaton.stream(words, width) == [first.get(w, -1) for w in windows_of(words, width)]


def words9(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def longest_match(words, probe, least):
    """Most words in a row that both have, if least or more, with the first place in words, then in probe."""
    best, runs = None, {}
    for i, w in enumerate(words):
        now = {}
        for j, v in enumerate(probe):
            if v == w:
                n = now[j] = runs.get(j - 1, 0) + 1
                found = (-n, i - n + 1, j - n + 1)
                if n >= least and (best is None or found < best):
                    best = found
        runs = now
    return best


@pytest.mark.parametrize("block", [16_000_000, 60])
def test_leaks(spark, docs, monkeypatch, block):
    rows = awkward()
    long = next(words9(t) for _, t, *_ in rows if t and len(words9(t)) > 40)
    items = [(1, " ".join(long[3:30])), (2, "CHANGED!"), (3, None), (4, ""), (5, "a b a b"), (6, "absent words here"), (10, " ".join(long[20:26])), (None, "x y"), (2, "changed"), (7, "é ß"), (8, " ".join(long[:14] + ["zzz"] + long[10:40])), (9, "b a a " * 8), (9, "b a a " * 8)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 500)
    expected = []
    for i, t, *_ in rows:
        words, hit, names = words9(t), set(), {}
        for item, text in items:
            probe = words9(text)
            n = min(10, len(probe))
            wanted = set(windows_of(probe, n)) if n else set()
            for k, w in enumerate(windows_of(words, n) if n else ()):
                if w in wanted:
                    hit.update(range(k, k + n))
                    names.setdefault("" if item is None else str(item), (probe, n))
        expected.append((i, len(words), len(hit), tuple((k, -v[0], v[1], v[2]) for k, v in sorted((k, longest_match(words, *v)) for k, v in names.items()))))
    found = decontaminate.find_leaks(docs, bench).withColumn("n_hit", decontaminate.hit_words("spans"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple((m["item"], m["words"], m["start"], m["item_start"]) for m in r["matches"])) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == {i for i, _, n, _ in expected if not n}


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"q"]), max_size=14), max_size=5))
def test_suffix_array_is_in_order(texts):
    items = decontaminate.Items([("x", b"a b c")])
    numbers, _ = decontaminate._numbered(texts, items)

    def suffix(i):
        return numbers[i : i + int(np.argmin(numbers[i:]))].tolist()

    order = [suffix(i) for i in decontaminate.SuffixArray(numbers).at]
    assert order == sorted(suffix(i) for i in np.flatnonzero(numbers))


def test_dropping_keeps_columns_and_clean_rows(spark, docs):
    bench = spark.createDataFrame([(1, "one"), (2, "a b a a b a a b a a")], "item_id long, text string")
    left = decontaminate.drop_leaks(docs, bench)
    gone = {r.doc_id for r in decontaminate.find_leaks(docs, bench).where("size(spans) > 0").collect()}
    assert left.columns == docs.columns and len(gone) == 2
    assert {r.doc_id for r in left.collect()} == {r[0] for r in awkward()} - gone
    left = near_dedup.drop_near(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in near_dedup.near_groups(docs).collect() if r.kept}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.find_repeats(docs).count() == near_dedup.near_groups(docs).count() == substring_dedup.remove_passages(docs).count() == decontaminate.find_leaks(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.find_leaks(some, bench).first()["matches"] == []
