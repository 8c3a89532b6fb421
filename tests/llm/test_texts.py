"""Formatting, sharding, packing, WARC, language ID and quality."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.llm import chat_format, language_id, packing, quality, sharding, warc

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\e\\l\\b", "<<SYS>>\n<</SYS>>", "<", "[", "<<TURN 41>>x<</TURN>>", "", "\n", " ", "é<s>", "[/INST]</s><s>", "a\\<s>\\"]


def read(chats):
    turns = chat_format.read_back(F.col("formatted"))
    learned = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])))
    return {r._conv: r for r in chats.select(F.col("conv_id").alias("_conv"), turns.alias("turns"), learned.alias("learned"), "valid", "state", "formatted", "segments").collect()}


def test_chats_read_back(spark):
    rows, r = [], random.Random(2)
    for c in range(60):
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "US>>ER"]), r.choice([None, *NASTY]), "x") for t in range(r.randint(1, 8))]
    rows += [(None, 0, "user", "u", "x"), (None, None, "assistant", "a", "x"), (99, 1, "user", "q", "x"), (99, 1, "user", "q", "x"), (98, 0, "user", "word " * 50_000, "x")]
    r.shuffle(rows)
    found = read(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")))
    for c in {x[0] for x in rows}:
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        assert [(t.role, t.text) for t in found[c].turns] == [(x[2], x[3]) for x in turns]
        assert found[c].learned == "".join(x[3] for x in turns if x[2] == "assistant")
        assert found[c].formatted == "".join(s.text for s in found[c].segments)


def test_chat_machine(spark):
    orders = {1: "su a", 2: "ua", 3: "uaua", 4: "au", 5: "uu", 6: "u", 7: "sa", 8: "ux", 9: "s"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(c, i, names[k], "t") for c, o in orders.items() for i, k in enumerate(o.replace(" ", ""))]
    found = read(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {c: found[c].state for c in orders} == {1: "answered", 2: "answered", 3: "answered", 4: "rejected", 5: "rejected", 6: "asked", 7: "rejected", 8: "rejected", 9: "ready"}
    assert [c for c in orders if found[c].valid] == [1, 2, 3]
    only = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), only_valid=True)
    assert sorted(r.conv_id for r in only.collect()) == [1, 2, 3]
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 40)
    r = random.Random(4)
    rows = [(i, r.choice(["hot"] * 10 + ["a", "b", None]), 9, "c") for i in range(3003)] + [(None, "a", 9, "c"), (None, None, 9, "c"), (5, "hot", 9, "c"), (5, "hot", 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, shard int, slot string")
    found = sharding.interleave(docs, 16, seed=3).collect()
    assert len(found) == len(rows)
    sizes = Counter(x.shard for x in found)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(x.slot for x in found if x.shard == s) == list(range(sizes[s]))
    for source, n in Counter(x[1] for x in rows).items():
        got = Counter(x.shard for x in found if x.source == source)
        assert all(abs(got[s] - n / 16) <= 2.01 for s in range(16)), (source, got)
    keyed = sorted(((hashlib.md5(f"3:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, s) for i, s, *_ in rows), key=lambda x: (x[0], str(x[3])))
    ranks, seen, totals = [], Counter(), Counter(x[3] for x in keyed)
    for key, _, i, s in keyed:
        seen[s] += 1
        ranks.append(((2 * seen[s] - 1) / (2 * totals[s]), key, s))
    ranks.sort(key=lambda x: (x[0], x[1]))
    assert [s for *_, s in ranks] == [x.source for x in sorted(found, key=lambda x: x.position)]
    assert sharding.interleave(docs.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(spark, monkeypatch, capacity):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 100)
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)) + r.choice(["", " x", " y"]), r.choice(["hot", "hot", "a", "b", "c", None]), 1, 2) for i in range(500)] + [(900, None, None, 1, 2), (901, "", "a", 1, 2), (902, "v " * 5000, "a", 1, 2), (None, "n", "b", 1, 2), (950, "same", "a", 1, 2), (950, "same", "a", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bin_id int")
    found = packing.pack(docs, capacity).collect()
    total = Counter()
    for i, t, *_ in rows:
        total[i] += len((t or "").split()) + 1
    assert {i: sum(x.size for x in found if x.doc_id == i) for i in total} == total
    source, text = {x[0]: x[2] for x in rows}, {x[0]: " ".join((x[1] or "").split()) for x in rows}
    for b in {x.bin_id for x in found}:
        held = sorted((x for x in found if x.bin_id == b), key=lambda x: x.bin_offset)
        assert sum(x.size for x in held) <= capacity
        assert all(x.bin_offset + x.size == y.bin_offset for x, y in zip(held, held[1:]))
        named = [source[x.doc_id] for x in held if source[x.doc_id] is not None]
        assert len(named) == len(set(named))
        assert len(held) == 1 or len({text[x.doc_id] for x in held}) == len(held)
    assert packing.pack(docs.limit(0)).count() == 0


def plain_best_fit(items, capacity):
    """Items (size, source, cluster) in order: each into the bin with least room that takes it, else into a new one."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + size <= capacity and not any((x[1] == source and source is not None) or (x[2] == cluster and cluster is not None) for x in b)]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((at, sum(x[0] for x in bins[at])))
        bins[at].append((size, source, cluster))
    return out


def test_packing_agrees_with_plain_best_fit(spark, monkeypatch):
    """Group by group: the same items in the same order, each in its plain bin at its plain place."""
    monkeypatch.setattr(packing, "GROUP_ITEMS", 60)
    r = random.Random(11)
    rows = [(r.choice([None, "x", f"id-{i}"]) if i % 9 == 0 else f"id-{i}", r.randint(1, 40), r.choice(["hot", "hot", "a", "b", None]), r.choice([None, 1, 2, 3, 4, 5])) for i in range(400)] + [("same", 7, "a", 1)] * 90
    docs = spark.createDataFrame(rows, "doc_id string, n int, source string, near int").withColumn("text", F.lit("t"))
    found = packing.pack(docs, 32, size=F.col("n"), cluster=F.col("near")).collect()
    items = docs.select(F.col("doc_id").alias("_id"), F.col("n").cast("long").alias("_size"), F.col("source").alias("_source"), F.col("near").alias("_cluster"))
    groups = {}
    for x in packing.deal(items, len(rows)).collect():
        groups.setdefault(x._group, []).extend([(x._size, x._id, x._source, x._cluster)] * x._copies)
    assert sum(map(len, groups.values())) == len(rows) and max(map(len, groups.values())) <= 120
    wanted = Counter()
    for group, members in groups.items():
        members.sort(key=lambda m: (-(m[0] % 32), -m[0], m[1] is not None, m[1] or "", str(m[2:])))
        rest = [m for m in members if m[0] % 32]
        for m, (bin_, offset) in zip(rest, plain_best_fit([(m[0] % 32, m[2], m[3]) for m in rest], 32), strict=True):
            wanted[m[1], m[0] % 32, (group << 32) + bin_, offset] += 1
    assert Counter((x.doc_id, x.size, x.bin_id, x.bin_offset) for x in found if x.size < 32) == wanted
    assert sum(x.size == 32 for x in found) == sum(n // 32 for _, n, *_ in rows)


def test_hot_rows_are_dealt_over_groups(spark):
    n = 200_000
    items = spark.range(n).select(F.lit(None).cast("long").alias("_id"), F.lit(4).cast("long").alias("_size"), F.lit("s").alias("_source"), F.lit(1).alias("_cluster"))
    sizes = [r[1] for r in packing.deal(items, n).groupBy("_group").agg(F.sum("_copies")).collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * packing.GROUP_ITEMS


@pytest.mark.parametrize("source", ["concat('host-', id)", "'one'"])
def test_small_sources_and_null_ids_share_no_cell(spark, source):
    n, seen = 200_000, []
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.expr(source).alias("source"))
    real = sharding.store

    def watched(df, label):
        kept = real(df, label)
        if label in ("sorted", "placed"):
            seen.append(kept.df.groupBy("_cell").count().agg(F.max("count")).first()[0])
        return kept

    sharding.store, found = watched, None
    try:
        found = sharding.interleave(rows)
    finally:
        sharding.store = real
    assert len(seen) == 2 and max(seen) <= 2 * sharding.CELL_ROWS
    got = {r.shard: (r["n"], r.lo, r.hi, r.d) for r in found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()}
    assert got == {s: (n // 16, 0, n // 16 - 1, n // 16) for s in range(16)}


def test_best_fit_goes_on_past_conflicts():
    assert packing.best_fit([6, 5, 4, 3], [0, 1, 0, -1], [-1] * 4, 10) == [(0, 0), (1, 0), (1, 5), (0, 6)]
    plain = packing.best_fit([7, 6, 3, 4], [-1] * 4, [-1] * 4, 10)
    assert plain == [(0, 0), (1, 0), (0, 7), (1, 6)]


def test_archives(spark):
    big, r = "é" * 700, random.Random(6)
    noise = "".join(chr(r.randint(32, 0x2FF)) for _ in range(200_000))
    pages = [(1, "http://a", big), (2, "http://b", big), (3, "http://c\nX: y", big + "x"), (4, None, None), (5, "u", ""), (6, "v", "short"), (7, "w", "short"), (8, "x", noise), (None, "n", big), (2, "http://b", big), (9, "magic", "\x1f\x08 WARC/1.0 \r\n\r\n" * 200)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    files = warc.write_archives(df)
    wanted = sorted(((f"urn:page:{'none' if i is None else i}", "response" if i != 1 else "revisit", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "urn:page:2" if i == 1 else None) for i, _, h in pages))
    for split in (1 << 22, 700, 64):
        records = warc.read_archives(spark, files, split).collect()
        assert sorted(((x.record_id, x.record_type, x.payload_length, x.payload_digest.split(":")[1], x.refers_to) for x in records)) == wanted
        for x in records:
            if x.record_type == "response":
                assert hashlib.sha1(x.payload).hexdigest() == x.payload_digest.split(":")[1]
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def plain_reader(data):
    """Records and broken stretches as (offset, content or None), by one pass with Python's own gzip."""
    import gzip
    import zlib

    def member(at):
        d = zlib.decompressobj(31)
        try:
            out = d.decompress(data[at:])
        except zlib.error:
            return None
        return (len(data) - len(d.unused_data), out) if d.eof and out.startswith(b"WARC/1.") else None

    at, out = 0, []
    assert gzip
    while at < len(data):
        if found := member(at):
            out.append((at, found[1]))
            at = found[0]
        else:
            to = next((i for i in range(at + 1, len(data)) if data[i : i + 3] == warc.MAGIC and member(i)), len(data))
            out.append((at, None))
            at = to
    return out


def nested():
    """Records whose payloads hold whole archives (stored as they are), junk, a member that is no record, a cut member."""
    import gzip
    import zlib

    def stored(payload, kind=b"response", content=b"application/http"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload if content.startswith(b"application/http") else payload
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)
        return pack.compress(b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, content, len(block)) + block + b"\r\n\r\n") + pack.flush()

    one, two, three = (warc.record("response", i, "http://x", b"p%d" % i * 50, "d", "2020-01-01T00:00:00Z") for i in (1, 2, 3))
    inner = one + three
    return [
        one + stored(inner * 5) + two,
        b"junk\x1f\x8b\x08junk" + one + gzip.compress(b"not a record") + b"\x1f\x8b\x08" + two + two[:40],
        stored(inner)[:-9] + two,  # its checksum is lost, so what it held is met
        stored(b"software: x", b"warcinfo", b"application/warc-fields") + stored(b"a: b\r\n\r\nc", b"metadata", b"text/plain") + stored(stored(inner)) + one,
    ]


def test_reader_meets_the_same_records_however_files_are_cut(spark, tmp_path):
    rows, wanted, broken = [], [], []
    for i, data in enumerate(nested()):
        path = tmp_path / f"{i}.warc.gz"
        path.write_bytes(data)
        rows.append((f"file://{path}", len(data)))
        for at, found in plain_reader(data):
            (broken if found is None else wanted).append((i, at) if found is None else (i, at, warc.parse(found)[1]))
    assert len(wanted) == 3 + 2 + 3 + 4 and broken
    rows.append((f"file://{tmp_path}/none.warc.gz", 0))
    files = spark.createDataFrame(rows, "path string, size long")
    for split in (10_000, 333, 100):
        found = warc.read_archives(spark, files, split).collect()
        assert sorted((int(x.path.split("/")[-1][0]), x.offset, bytes(x.payload)) for x in found) == wanted
        assert {x.record_type for x in found} == {"response", "warcinfo", "metadata"}
        pieces = {(int(x.path.split("/")[-1][0]), x.offset) for x in warc.find_broken(spark, files, split).collect()}
        assert set(broken) <= pieces
    info = next(x for x in found if x.record_type == "warcinfo")
    assert bytes(info.payload) == b"software: x" and info.payload_length == 11
    for data in nested():  # every cut in two
        for cut in range(1, len(data), 5):
            first = warc.Members(pa.BufferReader(data), 0, cut)
            upto = first.exits()
            at = next((x for c, x in upto if c >= 0), cut)
            parts = [*first.read(0), *(warc.Members(pa.BufferReader(data), cut, len(data)).read(at) if at < len(data) else ())]
            assert [(a, d) for a, _, d in parts if d is not None] == [x for x in plain_reader(data) if x[1] is not None]


def test_language(spark):
    data = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(data)
    train = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    model = language_id.fit(train)
    odd = spark.createDataFrame([(-1, None, None, "x"), (-2, "", None, "x"), (-3, "123 !?", "en", "x"), (-4, "z" * 100_000, None, "x"), (None, "the", None, "x")], "doc_id long, text string, lang string, score string")
    found = {x.doc_id: x for x in language_id.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and all(found[i].score == 0 and found[i].rejected for i in (-1, -2, -3))
    assert found[-4].lang_pred in model.languages and 0 <= found[-4].score <= 1
    test = docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2) & F.col("lang").isNotNull() & (F.col("n_chars") > 60))
    right = language_id.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    left = language_id.drop_rejected(odd, model)
    assert left.columns == odd.columns and {x.doc_id for x in left.collect()} <= {-4, None}
    nothing = language_id.fit(odd.limit(0))
    assert {x.lang_pred for x in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize(("labels", "each"), [(1500, 10), (6000, 2)])
def test_no_label_is_lost(spark, labels, each):
    rows = spark.range(labels * each).select(F.col("id").alias("doc_id"), F.concat(F.lit("wörd "), F.md5(F.col("id").cast("string"))).alias("text"), F.concat(F.lit("l"), F.col("id") % labels).alias("lang"))
    model = language_id.fit(rows)
    assert len(model.languages) == labels and set(model.owner) == set(range(labels))
    assert language_id.identify(rows.limit(50), model).where("lang_pred != 'und' AND score > 0").count() == 50


def test_training_rows_are_bounded_whatever_the_label_or_id(spark):
    rows = spark.createDataFrame([(i, f"text {i} of en", "en") for i in range(9000)] + [(7, "again and again", "de")] * 3000 + [(None, "nobody", "fr")] * 100 + [(9001, "12 3", "it"), (9002, "uno", "it")], "doc_id long, text string, lang string")
    drawn = language_id._sample(rows, "doc_id", "text", "lang").groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in drawn} == {"en": language_id.TRAIN_ROWS // 3, "de": 1, "it": 1}


def test_language_scores_agree_with_plain_cosines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    ends = [0, *model.ends.tolist()]
    centroids = [dict(zip(model.seen[a:b].tolist(), model.values[a:b].tolist(), strict=True)) for a, b in zip(ends, ends[1:])]
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        grams = language_id.n_grams(r.text)
        if grams is None:
            assert found[r.doc_id].lang_pred == "und"
            continue
        weights = {g: math.log1p(n) * float(model.idf[g]) for g, n in Counter(grams.tolist()).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c.get(g, 0.0) for g, w in weights.items()) / size for c in centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(found[r.doc_id].score - cosines[best]) < 1e-4 and found[r.doc_id].lang_pred == model.languages[model.owner[best]]
    assert all(abs(sum(v * v for v in c.values()) - 1) < 1e-4 for c in centroids)


NO_LANGUAGE = [
    "def merge(a, b):\n    out = []\n    while a and b:\n        out.append(a.pop(0) if a[0] < b[0] else b.pop(0))\n    return out + a + b\n\n\nclass Node:\n    def __init__(self, key, left=None, right=None):\n        self.key, self.left, self.right = key, left, right\n\n    def walk(self):\n        if self.left:\n            yield from self.left.walk()\n        yield self.key\n",
    "TWFueSBoYW5kcyBtYWtlIGxpZ2h0IHdvcmsu" * 3 + "QmFzZTY0IGVuY29kaW5nIHNjaGVtZXMgYXJlIGNvbW1vbmx5IHVzZWQgd2hlbiB0aGVyZSBpcyBhIG5lZWQgdG8gZW5jb2RlIGJpbmFyeSBkYXRh" * 3,
    "0x7fb3a2f6ba10 mov rax, qword ptr [rbp-0x18]; xor ecx, ecx; jmp 0x4005d0; push rbp; sub rsp, 0x20; lea rdi, [rip+0xf]; call puts; leave; ret; nop dword ptr [rax+rax]",
]


def test_what_is_no_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(f"s-{i}", t) for i, t in enumerate(NO_LANGUAGE)], "doc_id string, text string")
    assert [r.doc_id for r in language_id.identify(odd, model).where("not rejected").collect()] == []


STRANGERS = [
    "La lingua italiana è una lingua romanza parlata principalmente in Italia. È classificata al ventisettesimo posto tra le lingue per numero di parlanti nel mondo. Nel corso dei secoli la letteratura ha avuto una grande importanza nella formazione della lingua comune, che gli scrittori hanno adattato alle esigenze del loro tempo.",
    "Język polski jest językiem z grupy zachodniosłowiańskiej, do której należą również czeski, kaszubski, słowacki i języki łużyckie. Jest językiem urzędowym w Polsce oraz jednym z języków urzędowych Unii Europejskiej. Ocenia się, że jest językiem ojczystym około czterdziestu milionów ludzi na świecie.",
    "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Suomessa suomen kieli on toinen maan virallisista kielistä, ja sitä puhuu äidinkielenään noin viisi miljoonaa ihmistä. Kielen sanasto on suurelta osin omaperäistä.",
    "Het Nederlands is een West-Germaanse taal, de meest gebruikte taal in Nederland en België, de officiële taal van Suriname en een van de drie officiële talen van België. Het is de derde meest gesproken Germaanse taal, en wordt door ruim twintig miljoen mensen als moedertaal gesproken.",
    "Kiswahili ni lugha ya Kibantu yenye misamiati mingi ya Kiarabu lakini sasa ya Kiingereza pia, inayozungumzwa katika eneo kubwa la Afrika ya Mashariki. Lugha hii ina utajiri mkubwa wa misamiati na misemo na mithali na mashairi na mafumbo na vitendawili na nyimbo.",
]


def test_strangers_are_rejected_and_short_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.fit(docs.where(~held))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(STRANGERS)], "doc_id long, text string")
    assert all(x.rejected for x in language_id.identify(odd, model).collect())
    assert language_id.drop_rejected(odd, model).count() == 0
    rate = F.avg(F.col("rejected").cast("int"))
    short, long = (docs.where(held & c) for c in ((F.length("text") < 100) & ~F.col("text").contains("licens"), F.length("text") >= 300))
    assert short.count() > 4 and language_id.identify(short, model).where("rejected").count() == 0
    for n in (5, 20, 60, 1 << 30):
        assert language_id.identify(long.withColumn("text", F.substring("text", 1, n)), model).select(rate).first()[0] < 0.02
    for lang in model.languages:  # each is a stranger to the others
        rest = language_id.fit(docs.where(~held & (F.col("lang") != lang)))
        assert language_id.identify(docs.where((F.col("lang") == lang) & (F.length("text") >= 300)), rest).select(rate).first()[0] > 0.95
    few = language_id.fit(spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "the dog sat on the log", "en"), (3, "le chat est sur le lit", "fr")], "doc_id long, text string, lang string"))
    assert few.least.shape == (2, language_id.BITS + 1) and (few.least < 0.8).all()


def test_ordinal_model_orders_grades():
    r = np.random.default_rng(1)
    grades = r.integers(0, 3, 900)
    lists = [np.unique(np.concatenate([[10 + g], 100 + r.integers(0, 300, 20)])) for g in grades]
    model = quality.train(grades, lists, 3)
    p = model.probabilities(np.array([model.weights[x].sum() for x in lists]))
    assert np.all(np.diff(model.cuts) >= 0) and np.allclose(p.sum(axis=1), 1)
    assert (p.argmax(axis=1) == grades).mean() > 0.95
    assert (model.weights[100:400] != 0).mean() < 0.2


def test_quality(spark):
    good, bad = "a fine text about trees and rivers", "you are a worthless clown"
    rows = [(i, f"{good if i % 3 else bad} n{i % 11}", "x") for i in range(300)] + [(1000, None, "x"), (1001, "", "x"), (None, good, "x"), (1002, bad + " pad" * 30_000, "x"), (1, good, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_tail string")
    ratings = spark.createDataFrame([(i, 2 if i % 3 else 0) for i in range(300)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, grade int")
    found = quality.grade(docs, quality.fit(docs, ratings, 3), 1).collect()
    assert len(found) == len(rows) and all(0 <= x.p_tail <= 1 and 0 <= x.expected_grade <= 2 for x in found)
    assert all((x.p_tail > 0.5) == bool(x.doc_id % 3) for x in found if x.doc_id is not None and x.doc_id < 300)
    assert next(x for x in found if x.doc_id == 1002).p_tail < 0.5
    assert quality.grade(docs, quality.fit(docs, ratings.limit(0), 3), 1).count() == len(rows)
    assert quality.grade(docs.limit(0), quality.fit(docs.limit(0), ratings, 3), 1).count() == 0


def test_grades_agree_with_the_plain_likelihood(spark):
    """Scores, probabilities and expected grades by the formulas; and cuts that no small step makes likelier."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", ((1 - F.col("toxic")) * (1 + F.col("quality"))).alias("grade"))
    model = quality.fit(docs, ratings, 3)
    found = {r.doc_id: r for r in quality.grade(docs, model, 1).collect()}
    logistic = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    scores = {}
    for r in docs.collect():
        score = sum(float(model.weights[quality.bucket(f)]) for f in quality.features((r.text or "").encode()))
        below = [logistic(float(c) - score) for c in model.cuts]
        p = [b - a for a, b in zip([0.0, *below], [*below, 1.0])]
        assert abs(found[r.doc_id].expected_grade - sum(k * x for k, x in enumerate(p))) < 1e-6 and abs(found[r.doc_id].p_tail - sum(p[1:])) < 1e-6
        scores[r.doc_id] = score
    graded = [(scores[r.doc_id], r.grade) for r in ratings.where("grade IS NOT NULL").dropDuplicates(["doc_id"]).collect() if r.doc_id in scores]

    def loss(cuts):
        at = [-math.inf, *cuts, math.inf]
        return -sum(math.log(max(1e-9, (logistic(at[g + 1] - s) if g < 2 else 1) - (logistic(at[g] - s) if g else 0))) for s, g in graded) / len(graded)

    share = [sum(g <= k for _, g in graded) / len(graded) for k in (0, 1)]
    plain = -sum(math.log([share[0], share[1] - share[0], 1 - share[1]][g]) for _, g in graded) / len(graded)
    fitted = loss(model.cuts)
    assert fitted < 0.7 * plain
    for k in (0, 1):
        for step in (-0.3, 0.3):
            moved = list(model.cuts)
            moved[k] += step
            assert loss(sorted(moved)) > fitted - 1e-3


def test_grades_rank_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", ((1 - F.col("toxic")) * (1 + F.col("quality"))).alias("grade")).where("grade IS NOT NULL")
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    model = quality.fit(docs, ratings.where(~unseen), 3)
    rows = quality.grade(docs.join(ratings.where(unseen).select("doc_id"), "doc_id", "left_semi"), model, 1).join(ratings, "doc_id").collect()

    def auc(scores):
        ranked = sorted(scores)
        wins, low = 0.0, 0
        for _, up in ranked:
            wins, low = (wins + low, low) if up else (wins, low + 1)
        return wins / max(1, low * (len(ranked) - low))

    assert len(rows) > 500
    assert auc([(r.p_tail, r.grade > 0) for r in rows]) > 0.9
    assert auc([(r.expected_grade, r.grade > 1) for r in rows]) > 0.6


def test_an_id_counts_once(spark):
    docs = spark.createDataFrame([(f"u-{i % 50}", f"word{i % 2} x{i % 50}") for i in range(1000)], "doc_id string, text string")
    ratings = spark.createDataFrame([(f"u-{i % 50}", i % 2) for i in range(500)] + [("u-1", 2), ("u-1", 9)], "doc_id string, grade int")
    rated = {}
    real = quality.train
    quality.train = lambda grades, lists, n: rated.update(n=len(grades)) or real(grades, lists, n)
    try:
        assert quality.grade(docs, quality.fit(docs, ratings, 3), 1).count() == 1000
    finally:
        quality.train = real
    assert rated["n"] == 50


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="\\elb<>/s[]INSTYU", max_size=40))
def test_escape_leaves_no_control(text):
    shown = text.replace("\\", "\\e")
    for control in chat_format.DEFAULT.controls:
        shown = shown.replace(control, chat_format.CODES[control[0]] + control[1:])
    assert not any(c in shown for c in chat_format.DEFAULT.controls)
    for plain, code in reversed(chat_format.CODES.items()):
        shown = shown.replace(code, plain)
    assert shown == text
