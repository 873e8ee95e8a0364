"""A training corpus from ``documents``: quality rules, line dedup, near-copy removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's documents. Stages pass further columns of ``docs`` through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.mixing import mix
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality_rules import judge
from tickloom.llm.simhash import without_near_copies
from tickloom.llm.text import documents, prepare, store


#: Units whose ids a worker of the packing stage keeps: fewer than alone, since its executor still holds what earlier stages took.
PACKING_UNITS = 100_000


def _held(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of the row can clash with an operator's own."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the decision list rejects go. Empty and null texts are among them."""
    return judge(docs, documents(spark, sf_dir, "labels"), rows=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share stay in one of them; ``n_chars``, if there, follows the text."""
    kept = dedup_lines(_held(docs)).select("_row.*", F.col("text").alias("_kept"))
    changed = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return kept.select(*[changed[c].alias(c) if c in changed else kept[c] for c in docs.columns])


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the smallest id stays: fingerprints within two bits, as op2 finds them in
    vantage-point trees, and pairs of shingle sets that fingerprints miss."""
    return without_near_copies(docs, bits=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mix(docs, rows=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs, cached_units=PACKING_UNITS)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The learned stages cannot be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
