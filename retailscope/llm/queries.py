"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm import conversations, decontaminate, language, licences, phrases, sentencepieces, simhash, suffixes, tokencounts, tokenfiles, urlfilter, vectors, warc
from retailscope.llm.common import documents
from retailscope.plans.registry import Registry
from retailscope.session import table

registry = Registry()


@registry.add("op7_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(rule_host, rule_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best
"""


@registry.add("op10_url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.contract_rules(spark))


@registry.add("op5_token_id_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_token_files(manifest)


@registry.add("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, s.payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM sized s LEFT JOIN firsts f ON f.payload_digest = s.payload_digest AND payload_bytes >= 100
"""


@registry.add("op9_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    page_id, refers_to = (F.col(c).cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to")))
    return records.select(page_id, "payload_bytes", "payload_digest", "record_type", refers_to)


@registry.add("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.find_near_copies(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registry.add("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@registry.add("op4_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@registry.add("op1_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.find_near_vectors(table(spark, sf_dir, "embeddings"))


@registry.add("op3_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.find_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@registry.add("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage_turns(table(spark, sf_dir, "conversations"))
    return conversations.fold_pieces(conversations.repair_conversations(damaged))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM split GROUP BY lang
), phrases AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM split, unnest(range(1, 6)) t(m), unnest(range(1, len(words) - m + 2)) u(i)
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[: k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest
  FROM phrases, unnest(range(1, m)) t(k) WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, a, h.f AS l, r.f AS r, n, (1000 * a * n) // (h.f * r.f) AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.phrase = head JOIN phrases r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + s - 1], ' ') AS phrase, max(f) AS longer
  FROM phrases, unnest(range(2, m)) t(s), unnest(range(1, m - s + 2)) u(i) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@registry.add("op12_phrase_collocations", PHRASE_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir)).drop("cut")


@registry.add("op11_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(documents(spark, sf_dir))
    labels = F.array_union("whole_labels", F.col("spans.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_whole").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join("whole_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.col("cover").alias("score"),
    )
