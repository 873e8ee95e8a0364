"""The registered queries of this package, one per operator, with their comparison SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline
from tickloom.llm.katz import katz_scores
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.mixing import NOISE, mix
from tickloom.llm.oracle_sql import KATZ, REPAIR, TRIE
from tickloom.llm.packing import pack_documents
from tickloom.llm.pii import KINDS, personal_data
from tickloom.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt
from tickloom.llm.quality_rules import judge
from tickloom.llm.repair import damaged, repair
from tickloom.llm.secret_scan import BASE_RULES, RULES, secrets
from tickloom.llm.simhash import near_classes
from tickloom.llm.spans import listed
from tickloom.llm.text import documents
from tickloom.llm.token_counts import token_counts
from tickloom.llm.topk import top_k
from tickloom.llm.weak_labels import classify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_classes(documents(spark, folder))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(documents(spark, folder), documents(spark, folder, "labels"))
    base = [F.col("_stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, "base_failed", "kept")


def op4_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder))


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda m: m["kind"] == kind)).cast("long")


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(documents(spark, folder))
    counts = [_of_kind("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.array_sort("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(documents(spark, folder, "embeddings"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = secrets(documents(spark, folder))
    names = [r.name for r in RULES]
    base = F.filter("spans", lambda m: m["kind"] < len(BASE_RULES))
    counts = [_of_kind("spans", i).alias(f"n_{r.name}") for i, r in enumerate(BASE_RULES)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed(base, names).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), names).alias("spans"))


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = katz_scores(documents(spark, folder))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(documents(spark, folder, "conversations"))))


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(documents(spark, folder, "conversations")))


QUERIES |= {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_weak_labels": op4_weak_labels,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_personal_data": op7_personal_data,
    "op8_top_k": op8_top_k,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_language_model": op11_language_model,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
    "pipeline": pipeline,
}
ORACLES |= {"op11_language_model": KATZ, "op12_prefix_trie": TRIE, "op13_repair": REPAIR}
if PIPELINE_SQL is not None:
    ORACLES["pipeline"] = PIPELINE_SQL

ORACLES["op1_mixing"] = f"""
WITH m AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ln(-ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0))
         - ln(CASE WHEN length(text) > 0 THEN greatest(0.05, length(translate(text, '{NOISE}', ''))::DOUBLE / length(text)) ELSE 1.0 END) AS x
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS s, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM m GROUP BY source
), r AS (
  SELECT *, (3 * s) / w AS ratio, (sum(s) OVER () - coalesce(sum(3 * s) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM t WINDOW b AS (ORDER BY (3 * s) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (
  SELECT source, s, least((3 * s)::DOUBLE, (SELECT arg_min(level, ratio) FROM r WHERE ratio >= level) * w) AS target FROM r
), e AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS epochs FROM p
), c AS (
  SELECT m.doc_id, m.source, m.x, m.size, e.s, e.target, e.epochs, e.target - e.epochs * e.s AS rest, sum(m.size) OVER (PARTITION BY m.source ORDER BY m.x, m.doc_id) AS upto
  FROM m JOIN e ON m.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, s AS source_size, target, (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR nearest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (
  SELECT *, upto > rest AND abs(size - gap) < gap AND row_number() OVER (PARTITION BY source, upto <= rest ORDER BY abs(size - gap), x, doc_id) = 1 AS nearest
  FROM (SELECT *, rest - coalesce(max(upto) FILTER (WHERE upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM c)
)"""


ORACLES["op5_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.i, k.line, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""


ORACLES["op8_top_k"] = """
WITH u AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS (
  SELECT vec_id, list_transform(e, lambda x: floor(1024 * x::DOUBLE)) AS e FROM u
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""
