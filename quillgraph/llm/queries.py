"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_text, jaccard_join, packing, quality_rules, secret_scan, suffix_dedup, token_counts, url_filter
from .common import table

#: The conversation that is added to the table.
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    return import_module("public_tokenizers").path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(added)
    return chat_format.read_back(chat_format.format_turns(rows))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of the base kinds and of all kinds: a first run, whose ledger is still empty."""
    rows, _ = secret_scan.scan_paths(docs.select(F.col("doc_id").alias("path"), "text"))
    found = F.col("found")
    base = F.filter(found, lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(secret_scan.render(base), 256).alias("base_sha256"), secret_scan.render(found).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_rows(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), depth=50)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_packing, op4_html_text, op5_secret_scan, op6_decontaminate, op7_suffix_dedup, op8_quality_rules, op9_jaccard_join, op10_token_counts)
}

_CONTROL = r"\\\\|<</SYS>>|\[/INST\]|<<SYS>>|\[INST\]|</s>|<s>|<\|"
_CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {CONTROL_CONVERSATION}, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT {CONTROL_CONVERSATION}, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS expanded_tokens
FROM c GROUP BY conv_id"""


def _secrets_sql() -> str:
    quoted = [(i, r, r.pattern.replace("'", "''")) for i, r in enumerate(secret_scan.RULES)]
    matches = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS gap FROM d WHERE regexp_matches(t, '{p}')" for i, r, p in quoted)
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    base = f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(secret_scan.BASE_RULES)}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({matches}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, rank, kind, CAST({total.format("gap[1:i]")} + {total.format("m[1:i-1]")} AS BIGINT) AS a, CAST({total.format("gap[1:i]")} + {total.format("m[1:i]")} AS BIGINT) AS b FROM each WHERE length(g[i]) >= least)
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


ORACLES: dict[str, str] = {"op1_chat_format": _CHAT_SQL, "op5_secret_scan": _secrets_sql()}
