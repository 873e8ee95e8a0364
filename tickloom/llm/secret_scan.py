"""Secret scanning with an incremental ledger of blobs, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content (a blob). The ledger says which (blob, rule, rule
version) triples have been scanned and what was found. A run scans only the triples that are not there yet, each blob once
however many paths and versions hold it, and joins the findings back to all paths. A rule with a new version is scanned anew;
the other rules are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.spans import add_matches, kept
from tickloom.llm.text import prepare, store


@dataclass(frozen=True)
class Rule:
    """A pattern with a name and a version; a match counts if ``least`` characters are in it, or in ``part`` of it if given."""

    name: str
    pattern: str
    version: int = 1
    least: int = 1
    part: str | None = None

    def good(self, value: Column) -> Column:
        measured = value if self.part is None else F.regexp_extract(value, self.part, 1)
        return F.length(measured) >= self.least


# The base kinds. Runs of a class begin where the class begins, which keeps searches linear and the matches the same.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, least=8, part=ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)

#: Further kinds: forms that are published by their issuers and hardly occur otherwise.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("hosting_token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{20,}+"),
    Rule("url_login", r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$&*+=~-]{6,128}@[A-Za-z0-9]"),
)
RULES = (*BASE_RULES, *MORE_RULES)

LEDGER = "blob string, rule string, version int, found array<struct<start:int,end:int>>"


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], LEDGER)


def blob_of(text: Column) -> Column:
    """Content address of a version; a null text has that of an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_new(history: DataFrame, ledger: DataFrame, path: str, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows of all triples of this history that the ledger lacks.

    One path stands for each blob, chosen from addresses alone; texts meet the list of blobs to scan once and are not compared.
    """
    asked = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    addresses = history.select(F.col(path).alias("_path"), blob_of(F.col(text)).alias("blob"))
    blobs = addresses.groupBy("blob").agg(F.min("_path").alias("_path"))
    wanted = blobs.select("blob", "_path", F.explode(asked).alias("a")).select("blob", "_path", "a.*")
    wanted = wanted.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    todo = store(wanted.groupBy("blob", "_path").agg(F.collect_set("rule").alias("_rules"))).withColumnRenamed("blob", "_blob")
    texts = history.select(F.col(path).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("blob", blob_of(F.col("_t")))
    once = texts.join(todo, texts["_own"].eqNullSafe(todo["_path"]) & (texts["blob"] == todo["_blob"]))
    scanned = once.select("blob", "_t", "_rules")
    for rule in rules:
        # A rule that is not asked for sees an empty text.
        scanned = scanned.withColumn("_seen", F.when(F.array_contains("_rules", rule.name), F.col("_t")).otherwise(F.lit("")))
        scanned = add_matches(scanned, "_seen", rule.name, rule.pattern)
    found = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                F.transform(kept(r.name, 0, r.good), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("found"),
            )
            for r in rules
        ]
    )
    rows = scanned.select("blob", F.explode(F.filter(found, lambda f: F.array_contains("_rules", f["rule"]))).alias("f")).select("blob", "f.*")
    # Rows that repeat both path and text are scanned alike.
    return rows.groupBy("blob", "rule", "version").agg(F.first("found").alias("found"))


def secrets(history: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """``path, blob, spans`` (array of start, kind, end; by start, then rule order) of every row, and the grown ledger.

    ``kind`` is the place of the rule in ``rules``. Every row of the history is returned, repeated ones too, with all findings
    of its content by the rules in their present versions. A null text is an empty one and has none. An empty table gives no
    rows and leaves the ledger as it is. Other columns are not read, whatever their names.
    """
    prepare(history.sparkSession)
    ledger = empty_ledger(history) if ledger is None else ledger
    new = store(scan_new(history, ledger, path, text, rules))
    grown = ledger.select("blob", "rule", "version", "found").unionAll(new)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(i))])
    hits = grown.filter(F.size("found") > 0).withColumn("kind", F.element_at(place, F.concat_ws(":", "rule", F.col("version").cast("string")))).filter("kind IS NOT NULL")
    spans = F.transform("found", lambda m: F.struct(m["start"].alias("start"), F.col("kind").alias("kind"), m["end"].alias("end")))
    by_blob = store(hits.select("blob", spans.alias("s")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")))
    paths = store(history.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob")))
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return paths.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans")), grown
