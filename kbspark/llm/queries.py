"""The operators over the driver's tables, each with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import table
from . import chat_format, decontaminate, exact_dedup, language_id, near_dedup, packing, quality, sharding, substring_dedup, warc


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema))
    chats = chat_format.format_chats(rows)
    turns = chat_format.read_back(F.col("formatted"))
    chats = chats.withColumns({"_turns": turns, "_learned": F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])))})
    return chats.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("state"),
        F.col("valid"),
    )


#: The machine in SQL: roles in order as one string, which must match the accepted orders.
OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\e'),
    '<<SYS>>', '\l<SYS>>'), '<</SYS>>', '\l</SYS>>'), '<<TURN ', '\l<TURN '), '<</TURN>>', '\l</TURN>>'),
    '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') AS shown FROM rows
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(shown) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 18 + 2 * octet_length(encode(role)) END) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars,
  CASE WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked'
    WHEN roles = 's' THEN 'ready' ELSE 'rejected' END AS state,
  regexp_full_match(roles, 's?(ua)+') AS valid
FROM chats
"""


def op4_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = sharding.interleave(docs, shards=16, carry=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: CRC-32 over the bytes of a text, with its table made by the rule; then the ranks and cuts of interleave() by plain windows.
OP4_SQL = r"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b::UBIGINT, [i::UBIGINT FOR i IN range(8)]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS bytes FROM documents),
h AS (SELECT doc_id, source, octet_length(bytes) + 1 AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k,
  xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(bytes), '..')]),
    lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::BIGINT])))::BIGINT AS text_crc32 FROM d, crc),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, k, doc_id, source, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 16 // total)::INT AS shard, (pos - (pos * 16 // total * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: Ratings from the labels: 0 toxic, 1 clean, 2 clean and of good quality. Rows with a null label have none. Texts are kept
#: whose probability of being clean is at least KEEP.
GRADES, CLEAN, KEEP = 3, 1, 0.7


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", ((1 - F.col("toxic")) * (1 + F.col("quality"))).alias("grade"))
    graded = quality.grade(docs, quality.fit(docs, ratings, GRADES), CLEAN)
    return graded.withColumn("kept", F.col("p_tail") >= KEEP)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), near_dedup.Plan(width=3, percent=85, rows=8))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_passages(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, archives)
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    whole = F.col("record_type") == "response"
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM w
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    n_hit, names = decontaminate.hit_words(F.col("spans")), F.array_sort("matches.item")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_ordinal": op1_quality_ordinal,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chat_format": op3_chat_format,
    "op4_shard_interleave": op4_shard_interleave,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_minmax_near_dedup": op6_minmax_near_dedup,
    "op7_suffix_automata": op7_suffix_automata,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_shard_interleave": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op7_suffix_automata": OP7_SQL, "op8_warc": OP8_SQL, "op9_decontaminate": OP9_SQL}
