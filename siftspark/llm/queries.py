"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import exact_dedup, jaccard, license_scan, outlier_rules, packing, perspectives, resampling, substrings, tokens, url_filter
from siftspark.llm.common import documents

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampling.resample(documents(spark, sf_dir), labels, (F.col("quality") == 1) & (F.col("toxic") == 0))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), n=3, percent=90)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_rules.outliers(documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = perspectives.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    span = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return each.select("conv_id", "part", "speaker", "n_turns", "n_own_turns", "n_target_chars", span.alias("target_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1,
    "op2_substring_dedup": op2,
    "op3_bpe_round_trip": op3,
    "op4_ngram_jaccard": op4,
    "op5_url_filter": op5,
    "op6_outlier_rules": op6,
    "op7_license_scan": op7,
    "op8_packing": op8,
    "op9_perspectives": op9,
    "op10_exact_dedup": op10,
    "pipeline": corpus_pipeline.run,
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP5_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in URL_RULES)}),
urls AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ranked AS (
  SELECT u.rid, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.rid ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, r.verdict DESC, rule_host || rule_path DESC) AS n
  FROM urls u JOIN rules r ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path))
SELECT u.page_id, u.host, u.path, k.rule, coalesce(k.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM ranked WHERE n = 1) k ON u.rid = k.rid
"""


def op7_sql() -> str:
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in license_scan.SENTENCES.items())
    steps, last, found = [], "seq", []
    for k, (_, ids) in enumerate(license_scan.RULES):
        pattern = quoted("," + ",,".join(ids) + ",")
        keep = ", ".join(["doc_id", "ids", "n", "unknown", *(f"m{i}" for i in range(k))])
        steps.append(f"s{k} AS (SELECT {keep}, contains(rest, {pattern}) AS m{k}, replace(rest, {pattern}, ',-,') AS rest FROM {last})")
        last = f"s{k}"
    for name in dict.fromkeys(n for n, _ in license_scan.RULES):
        hits = " OR ".join(f"m{k}" for k, (n, _) in enumerate(license_scan.RULES) if n == name)
        found.append(f"CASE WHEN {hits} THEN {quoted(name)} END")
    critical, notice = quoted(license_scan.CRITICAL), quoted(license_scan.NOTICE)
    norm = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split_regex(lower(coalesce(text, '')), {quoted(license_scan.PIECE)}) AS ps FROM documents),
lines AS (SELECT rid, p, list_filter(string_split_regex(ps[p], '[\\x0A\\x0D]+'), lambda s: regexp_matches(s, '[a-z0-9]')) AS ls
  FROM docs, unnest(range(1, len(ps) + 1)) t(p) WHERE regexp_matches(ps[p], {critical})),
tails AS (SELECT rid, p, min(i) AS i FROM (SELECT rid, p, i, {norm("array_to_string(ls[i:], ' ')")} AS s FROM lines, unnest(range(1, len(ls) + 1)) t(i) WHERE len(ls) > 1) JOIN known ON s = sentence GROUP BY rid, p),
said AS (SELECT rid, p, l, ls[l] AS s FROM lines LEFT JOIN tails USING (rid, p), unnest(range(1, len(ls) + 1)) t(l) WHERE (i IS NULL OR l < i) AND regexp_matches(ls[l], {critical})
  UNION ALL SELECT rid, p, i, array_to_string(ls[i:], ' ') FROM lines JOIN tails USING (rid, p)),
named AS (SELECT rid, p, l, coalesce(id, 'unknown') AS id FROM (SELECT rid, p, l, {norm("s")} AS s FROM said) LEFT JOIN known ON s = sentence WHERE id IS NOT NULL OR NOT regexp_matches(s, {notice})),
lists AS (SELECT rid, string_agg(id, ',' ORDER BY p, l) AS ids, string_agg(id || ',', ',' ORDER BY p, l) AS marked, count(*) AS n, count(*) FILTER (WHERE id = 'unknown') AS unknown FROM named GROUP BY rid),
seq AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(n, 0) AS n, coalesce(unknown, 0) AS unknown, ',' || coalesce(marked, '') AS rest FROM docs LEFT JOIN lists USING (rid)),
{", ".join(steps)},
done AS (SELECT doc_id, ids, n, unknown, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found FROM {last})
SELECT doc_id, n::BIGINT AS n_sentences, ids AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, unknown::BIGINT AS n_unknown,
       CASE WHEN n = 0 THEN 'none' WHEN len(found) = 0 THEN 'unknown' WHEN unknown > 0 THEN 'partial' ELSE 'known' END AS status
FROM done
"""


OP9_SQL = """
WITH said AS (SELECT DISTINCT conv_id, 0::BIGINT AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, part, role AS speaker FROM said WHERE role <> 'system'),
pieces AS (
  SELECT p.conv_id, p.part, p.speaker, s.turn, s.role, s.text, s.role = p.speaker AS own,
         '<|im_start|>' || CASE WHEN s.role = p.speaker THEN 'assistant' WHEN s.role = 'system' THEN 'system' ELSE 'user name=' || s.role END || chr(10) AS head,
         s.text || '<|im_end|>' AS body
  FROM people p JOIN said s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.part = s.part),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS pos FROM pieces)
SELECT conv_id, part, speaker, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE own)::BIGINT AS n_own_turns,
       sum(length(body)) FILTER (WHERE own)::BIGINT AS n_target_chars,
       string_agg((pos::BIGINT)::VARCHAR || '-' || ((pos + length(body))::BIGINT)::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own) AS target_spans,
       sha256(string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS text_sha256
FROM placed GROUP BY conv_id, part, speaker
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, rid) = 1 AS kept, text_sha256
FROM t
"""


def oracle_sql() -> dict[str, str]:
    out = {"op5_url_filter": OP5_SQL, "op7_license_scan": op7_sql(), "op9_perspectives": OP9_SQL, "op10_exact_dedup": OP10_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
