"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, license_scan, mining, mixing, packing, quality, spelling, substring, token_store, topk, url_filter, warc

#: The rules of the url query: fixed values.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page's url."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    documents, _ = mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap of every piece."""
    packed = packing.pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), 4096, keep_ids=False, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, shared, template_size, start of every license text that a document holds."""
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return token_store.encode_and_read_back(_read(spark, sf_dir, "documents", "doc_id", "text"), end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, measures, base_failed, kept, fail_bits of every document."""
    entries = quality.ledger(_read(spark, sf_dir, "documents", "doc_id", "text"), rules=quality.FIRST_RULES)
    base = F.lit(quality.mask_of(quality.POLICIES["base"])).cast("long")
    judged = quality.apply_policy(entries, "v1").withColumn("base_failed", F.col("fail_bits").bitwiseAND(base) != 0)
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept", "fail_bits")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten best of all vectors for each vec_id divisible by 100."""
    return topk.top_k(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document: windows of 35 words."""
    return substring.removal_digests(_read(spark, sf_dir, "documents", "doc_id", "text"), size=35)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, links of every document: three-word shingles, 90 percent."""
    groups = jaccard.link_groups(_read(spark, sf_dir, "documents", "doc_id", "text"), size=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id", "links")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back."""
    back = warc.archive_round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each vec_id divisible by 100."""
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mining.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back."""
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    records = rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    said = json.dumps({"messages": [{"role": role, "content": "</s>[INST] ok [/INST]"} for role in ("user", "assistant")]})
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(said)).alias("record"))
    turns = chat.canonical_turns(records.unionByName(more))
    return chat.conversation_digests(chat.read_turns(chat.format_turns(turns)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least 5 code points and 3 occurrences."""
    return spelling.variant_groups(spelling.vocabulary(_read(spark, sf_dir, "documents", "doc_id", "text")))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT doc_id, rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM t) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)::BIGINT
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars > 10 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_dup_lines > 3 THEN 32 ELSE 0 END
        + CASE WHEN n_words > 100000 THEN 64 ELSE 0 END
        + CASE WHEN n_words < 3 THEN 128 ELSE 0 END
        + CASE WHEN n_words >= 50 AND 100 * n_repeat_words > 50 * n_words THEN 256 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM b
"""

OP7_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
        array_to_string(list_transform(string_split(hex, ''), lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', h) - 3, 4)), '') AS bits FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(bits, 5 * k + j + 1, 1) = '1')::INTEGER * (16 >> j)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.r <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, role = 'assistant' AS learned,
        CASE role WHEN 'user' THEN length('[INST][/INST]') WHEN 'system' THEN length('[SYS][/SYS]') WHEN 'assistant' THEN length('</s>')
          ELSE length('[ROLE][/ROLE][/TURN]') + length(role) + len(regexp_extract_all(role, '[\[<]\\*(/?INST\]|/?SYS\]|/?ROLE\]|/TURN\]|/s>)')) END AS marks,
        len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?SYS\]|/?ROLE\]|/TURN\]|/s>)')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE learned), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learned), '')) AS loss_sha256,
  sum(marks + length(text) + escapes)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op6_quality_rules": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_chat_format": OP12_SQL}
