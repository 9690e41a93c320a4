"""The queries of this subpackage: op1_ to op10_, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import bpe_ops, html_tree, line_crf, media, packing, quality, sharding, simhash, substrings, toxicity
from kinforge.llm.frames import free_name, new_folder, table


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_seed_and_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_ops.round_trip(table(spark, sf_dir, "documents"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.inspect(media.store(table(spark, sf_dir, "documents")))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.BLOCK, media.BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_crf.ruled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("line_states")


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_dom_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_tree.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Arrivals into which op9 deals the documents.
ARRIVALS = 8


def op9_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored in arrivals, merged by size, read back from the last manifest."""
    store = sharding.Store(spark, new_folder(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    arrival = free_name(docs, "_arrival")
    store.append_all(docs.withColumn(arrival, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS))), arrival)
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op10_quality_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5's result that SQL can express: counts and base rules."""
    return op5_line_crf_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4's result that SQL can express: the payload read back and the stored form."""
    return op4_signature_sniffing(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_power_of_two_packing": op1_power_of_two_packing,
    "op2_seed_and_extend_dedup": op2_seed_and_extend_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_signature_sniffing": op4_signature_sniffing,
    "op5_line_crf_rules": op5_line_crf_rules,
    "op6_lexicon_toxicity": op6_lexicon_toxicity,
    "op7_dom_tree_extraction": op7_dom_tree_extraction,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_size_tiered_sharding": op9_size_tiered_sharding,
    "op10_quality_factorisation_machine": op10_quality_factorisation_machine,
    "rules_base_counts": rules_base_counts,
    "media_payloads": media_payloads,
}



def _little(x: str) -> str:
    """Hexadecimal digits of a 32-bit little-endian number."""
    return "printf('%02x%02x%02x%02x', " + ", ".join(f"({x}) // {256**k} % 256" for k in range(4)) + ")"


ORACLE_SQL: dict[str, str] = {
    "rules_base_counts": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS often FROM x),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM m WHERE often > 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
FROM l LEFT JOIN r USING (doc_id)""",
    "media_payloads": f"""
WITH w AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64) AS m, raw || unhex(repeat('00', CAST(greatest(64, (n + 63) // 64 * 64) - n AS BIGINT))) AS payload FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(m + 56 AS BIGINT) AS media_bytes,
  sha256(unhex('52494646' || {_little("m + 48")} || '57415645666d74201000000001000100401f0000401f00000100080066616374' || '04000000' || {_little("n")} || '64617461' || {_little("m")}) || payload) AS media_sha256
FROM p""",
    "op2_seed_and_extend_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM x),
r AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE low < doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda word, n: NOT list_contains(js, n)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
    "op9_size_tiered_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
}
