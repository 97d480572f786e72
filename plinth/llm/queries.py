"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.llm import decontaminate, divergence, langid, licenses, maintext, pieces, quality, repair, sharding, simhash, tokens, urls, warc
from plinth.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, from the installed package of them."""
    return import_module("public_tokenizers").path(name)


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(documents(spark, sf_dir)))


ORACLE_SQL["op1_license_scan"] = licenses.oracle()


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_report(documents(spark, sf_dir))


def _rules_sql(rules: quality.RepetitionRules = quality.RepetitionRules()) -> str:
    """Words are numbered; an n-gram that a text holds twice covers its words, and lines that repeat an earlier one count."""
    sizes = sorted({3, *rules.gram_share})
    grams = ", ".join(f"CASE WHEN i + {n - 1} <= n_words THEN array_to_string(words[i : i + {n - 1}], ' ') END AS g{n}" for n in sizes)
    again = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 THEN 1 ELSE 0 END AS a{n}" for n in sizes)
    inside = ", ".join(f"max(a{n}) OVER (PARTITION BY r ORDER BY i ROWS {n - 1} PRECEDING) AS c{n}" for n in sizes)
    shares = ", ".join(f"sum(c{n} * chars) AS dup_chars_{n}" for n in sizes if n in rules.gram_share)
    every = [f"dup_chars_{n}" for n in sorted(rules.gram_share)]
    zero = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in every)
    bad = " OR ".join([f"n_symbols > {rules.symbol_share} * word_chars", f"dup_line_chars > {rules.line_share} * word_chars", *(f"dup_chars_{n} > {s} * word_chars" for n, s in rules.gram_share.items())])
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
w AS (SELECT r, words, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, length(word) AS chars, {grams} FROM w), a AS (SELECT *, {again} FROM g), c AS (SELECT *, {inside} FROM a),
per AS (SELECT r, sum(chars) AS word_chars, sum(c3) AS n_repeat_words, {shares} FROM c GROUP BY 1),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
later AS (SELECT r, list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda x: length(x))) AS chars FROM lines WHERE regexp_matches(line, '{word}') QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY k) > 1),
dup AS (SELECT r, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM later GROUP BY 1),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {zero} FROM d LEFT JOIN per USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM b
"""


ORACLE_SQL["op2_quality_rules"] = _rules_sql()


#: The contract's curated list.
URL_RULES = [
    urls.ListRule(urls.BLOCK, "com", "/en/"),
    urls.ListRule(urls.ALLOW, "example.com", "/en/7"),
    urls.ListRule(urls.ALLOW, "net", "/de/"),
    urls.ListRule(urls.BLOCK, "example.net", "/de/8"),
    urls.ListRule(urls.BLOCK, "org", "/es/"),
]


@_query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.crc32("pieces").alias("pieces_crc32"), "lossless")


@_query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_ids(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    found = tokens.read_ids(manifest)
    return found.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("items")


def _contamination_sql(window: int = decontaminate.WINDOW) -> str:
    """Windows of items and of texts as strings of their words, joined."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents), b AS (SELECT item_id, {words} AS words FROM benchmark),
items AS (SELECT item_id, least(len(words), {window}) AS size, words, unnest(range(1, len(words) - least(len(words), {window}) + 2)) AS i FROM b WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS w FROM items), sizes AS (SELECT DISTINCT size FROM windows),
own AS (SELECT r, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
met AS (SELECT r, i, o.size, item_id FROM own o JOIN windows v ON o.size = v.size AND array_to_string(words[i : i + o.size - 1], ' ') = w),
hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT r, i, size FROM met)) GROUP BY 1),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""


ORACLE_SQL["op8_decontamination"] = _contamination_sql()


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op9_warc"] = """
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
    SELECT payload_digest, max(page_id) AS original FROM rows WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM rows LEFT JOIN best USING (payload_digest)
"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLE_SQL["op12_source_divergence"] = divergence.oracle()


@_query
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(spread(table(spark, sf_dir, "pages")))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


ORACLE_SQL["op11_conversation_repair"] = repair.oracle()
