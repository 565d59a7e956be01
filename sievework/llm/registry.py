"""Queries of this subpackage over the driver's tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from sievework.llm import chat, embedding_dedup, encoding, html_text, line_dedup, mixing, packing, quality, secrets, simhash, token_files
from sievework.runtime import spread, table


def op1_source_mix(spark, sf_dir):
    out = mixing.plan_mix(spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text"), columns=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda x: x["shard"]).alias("shards"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(spread(table(spark, sf_dir, "documents")))


def op3_html_text(spark, sf_dir):
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def op4_secret_scan(spark, sf_dir):
    return secrets.secret_digest(spread(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark, sf_dir):
    out = quality.quality(spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text"), slim=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op6_simhash(spark, sf_dir):
    return simhash.fingerprint_digest(spread(table(spark, sf_dir, "documents")))


def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(spread(table(spark, sf_dir, "embeddings")))


def op8_token_files(spark, sf_dir):
    return token_files.token_digest(spark, spread(table(spark, sf_dir, "documents")), encoding.vocabulary("word_bpe_49k.json"))


def op9_chat_format(spark, sf_dir):
    return chat.render_conversations(spread(table(spark, sf_dir, "conversations")))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(spread(table(spark, sf_dir, "documents")), encoding.vocabulary("byte_bpe_50k.json"))


def pipeline(spark, sf_dir):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def mix_targets(spark, sf_dir):
    """What op1 plans for each document's source, which SQL can say too."""
    out = mixing.plan_mix(spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text"), columns=["doc_id"])
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


MIX_TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, 2.0 * words AS cap, ([3, 1, 2])[((r - 1) % 3 + 1)::INT] AS weight, sum(words) OVER () AS total FROM s),
l AS (SELECT *, (1.5 * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, words, least(cap, weight * max(level) OVER ()) AS target FROM l)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, round(target::DOUBLE, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def secret_base(spark, sf_dir):
    """The base patterns of op4 alone."""
    return secrets.secret_digest(spread(table(spark, sf_dir, "documents"))).drop("spans")


_SPANS = "SELECT doc_id, '{kind}' AS kind, {rank} AS k, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, m[i] AS hit FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d WHERE regexp_matches(t, '{pattern}')))"
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
SECRET_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_SPANS.format(kind="assign", rank=0, pattern=_ASSIGN)} UNION ALL {_SPANS.format(kind="access", rank=1, pattern="AKIA[A-Z0-9]+")} UNION ALL {_SPANS.format(kind="hex", rank=2, pattern="[0-9a-f]+")}),
f AS (SELECT *, a + length(hit) AS b FROM s WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 WHEN 'access' THEN length(hit) >= 16 ELSE length(hit) >= 32 END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


def quality_counts(spark, sf_dir):
    """The counts of op5 alone."""
    out = quality.quality(spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text"), slim=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3), g AS (SELECT doc_id, list(i) AS spots FROM v GROUP BY doc_id, w[i], w[i + 1], w[i + 2] HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, unnest(spots) AS p FROM g), (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM c LEFT JOIN r USING (doc_id)
"""


def queries():
    return {"op1_source_mix": op1_source_mix, "op2_line_dedup": op2_line_dedup, "op3_html_text": op3_html_text, "op4_secret_scan": op4_secret_scan, "op5_quality_rules": op5_quality_rules, "op6_simhash": op6_simhash, "op7_embedding_dedup": op7_embedding_dedup, "op8_token_files": op8_token_files, "op9_chat_format": op9_chat_format, "op10_best_fit_packing": op10_best_fit_packing, "pipeline": pipeline, "mix_targets": mix_targets, "secret_base": secret_base, "quality_counts": quality_counts}


def oracle_sql():
    return {"op2_line_dedup": line_dedup.ORACLE, "op9_chat_format": chat.ORACLE, "mix_targets": MIX_TARGETS, "secret_base": SECRET_BASE, "quality_counts": QUALITY_COUNTS}
