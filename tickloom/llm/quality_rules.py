"""Quality rules as a learned decision list, worked out with DataFrame functions only.

Statistics of every text are joined to quality labels. Sequential covering then grows one rule at a time: a conjunction of
threshold conditions on the statistics, each chosen for the largest information gain among the labelled rows that no earlier
rule covers. A grown rule is pruned on rows that were kept aside, and taken only if it is precise there. The list is emitted
as one ordered conditional expression.

Every choice needs only the numbers of good and bad rows per statistic and threshold, which one aggregation over the labelled
rows counts for all candidates at once; the driver sees these counts, never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import SPACE_CHARS, prepare, store, without, words

# The characters that count as symbols; the window of repeated words; the limits of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

#: Statistics that rules may use, all shares or means so that they do not follow the length of a text.
FEATURES = ("symbol_share", "mean_word", "repeat_share", "dup_line_share", "distinct_share", "upper_share", "digit_share", "other_share")
#: Candidate thresholds per statistic (quantiles of the labelled rows), conditions per rule, rules per list.
BINS, CONDITIONS, RULES = 24, 3, 8
#: A rule must be right on so many of the rows kept aside, and cover so many bad ones in all.
PRECISION, SUPPORT = 0.95, 5


def repeated_words(listed: Column) -> Column:
    """Words inside windows of five that occur at least twice in the list, the first occurrence included."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(listed) - WINDOW),
        lambda i: F.xxhash64(*[F.get(listed, i + j) for j in range(WINDOW)]),
    )
    return F.when(F.size(listed) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _with_covered(df: DataFrame) -> DataFrame:
    """``_repeat``: words covered by repeated windows, from the window hashes ``_hashes`` in text order.

    Most texts repeat no window; for them the lists below are empty. Each list is a column of its own, since an expression
    inside a lambda would be worked out once per element.
    """
    some = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.col("_hashes")).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_some", some)
    df = df.withColumn("_placed", F.sort_array(F.transform("_some", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed, places = F.col("_placed"), F.col("_places")
    again = F.transform("_placed", lambda w, k: F.when((F.get(placed, k - 1)["h"] == w["h"]) | (F.get(placed, k + 1)["h"] == w["h"]), w["i"]))
    df = df.withColumn("_places", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    steps = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return df.withColumn("_repeat", F.aggregate(steps, F.lit(0), lambda total, step: total + step).cast("long")).drop("_some", "_placed", "_places")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_stats``: counts and shares of every whole text; a null text has no words and no lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    listed = F.col("_words")
    base = docs.withColumn("_text", whole).withColumn("_words", words(F.col("_text")))
    base = base.withColumn("_hashes", repeated_words(listed))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: F.length(without(line, SPACE_CHARS)) > 0))
    n_words = F.size(listed).cast("long")
    word_chars = F.length(without(F.col("_text"), SPACE_CHARS)).cast("long")
    symbols = (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long")
    dup_lines = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    base = _with_covered(base)
    repeat = F.col("_repeat")
    upper = word_chars - F.length(F.regexp_replace("_text", "[A-Z\\x20\\x09-\\x0D]", ""))
    digits = F.length("_text") - F.length(without(F.col("_text"), "0123456789"))
    other = F.length("_text") - F.length(without(F.col("_text"), "!?~^{}[]=_/@+\\\\"))
    counts = base.withColumn(
        "_counts",
        F.struct(
            n_words.alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
            F.size("_lines").alias("lines"), F.size(F.array_distinct(listed)).alias("distinct"), upper.alias("upper"), digits.alias("digits"), other.alias("other"),
        ),
    )
    c = F.col("_counts")
    share = lambda part, of: F.when(of > 0, part.cast("double") / of).otherwise(F.lit(0.0))
    stats = F.struct(
        *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        share(c["n_symbols"], c["word_chars"]).alias("symbol_share"),
        share(c["word_chars"], c["n_words"]).alias("mean_word"),
        share(c["n_repeat_words"], c["n_words"]).alias("repeat_share"),
        share(c["n_dup_lines"], c["lines"]).alias("dup_line_share"),
        # Distinct words fall with the length of a text; against its square root they do not.
        share(c["distinct"], F.sqrt(c["n_words"].cast("double"))).alias("distinct_share"),
        share(c["upper"], c["word_chars"]).alias("upper_share"),
        share(c["digits"], c["word_chars"]).alias("digit_share"),
        share(c["other"], c["word_chars"]).alias("other_share"),
    )
    # Always true, but not known to be: keeps filters on the statistics from being pushed below, where each would work them out anew.
    return counts.withColumn("_stats", F.when(F.monotonically_increasing_id() >= 0, stats)).drop("_text", "_words", "_hashes", "_lines", "_repeat", "_counts")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"])


# --- learning ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, row: Column | None = None) -> Column:
        value = F.col(self.feature) if row is None else row[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _all(rule: Sequence[Condition], row: Column | None = None) -> Column:
    return reduce(lambda a, b: a & b, [c.column(row) for c in rule])


def _candidate_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[float, float]]:
    """Bad and good rows per statistic and bin; bin b lies above the b-th threshold."""
    binned = [
        F.struct(F.lit(f).alias("f"), reduce(lambda a, b: a + b, [(F.col(f) > F.lit(t)).cast("int") for t in ts], F.lit(0)).alias("b")) for f, ts in cuts.items() if ts
    ]
    counted = rows.select("bad", F.explode(F.array(*binned)).alias("c")).groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in counted.collect()}


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, float, float] | None:
    """The condition of the largest gain over these rows, with the bad and good rows that it leaves."""
    counts = _candidate_counts(rows, cuts)
    best = None
    for feature, thresholds in cuts.items():
        bins = [counts.get((feature, b), (0, 0)) for b in range(len(thresholds) + 1)]
        p0, n0 = sum(p for p, _ in bins), sum(n for _, n in bins)
        for i, threshold in enumerate(thresholds):
            below = tuple(sum(x[j] for x in bins[: i + 1]) for j in (0, 1))
            for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if p >= SUPPORT and p + n < p0 + n0:
                    found = (_gain(p, n, p0, n0), Condition(feature, above, threshold), p, n)
                    if found[0] > 1e-6 and (best is None or found[0] > best[0]):
                        best = found
    return best and best[1:]


def learn(labelled: DataFrame, features: Sequence[str] = FEATURES) -> list[Rule]:
    """Rules for bad rows, in order. ``labelled`` has the features, ``bad`` (0 or 1) and ``aside`` (boolean: for pruning)."""
    quantiles = [i / BINS for i in range(1, BINS)]
    found = labelled.agg(*[F.percentile_approx(f, quantiles, 1000).alias(f) for f in features], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), quantiles, 1000).alias(f"{f}_bad") for f in features]).first()
    cuts = {f: sorted(set(found[f] or []) | set(found[f"{f}_bad"] or [])) for f in features}
    rules: list[Rule] = []
    rest = labelled
    if not any(cuts.values()):
        return rules
    while len(rules) < RULES:
        growing, rule = rest.filter(~F.col("aside")), ()
        while len(rule) < CONDITIONS:
            step = _best_condition(growing, cuts)
            if step is None:
                break
            rule, growing = (*rule, step[0]), growing.filter(step[0].column())
            if step[2] == 0:
                break
        if not rule:
            break
        # Prune: of the rule's beginnings, the one that does best on the rows kept aside.
        judged = rest.groupBy("aside").agg(
            *[F.sum(F.when(_all(rule[: i + 1]), F.col("bad"))).alias(f"p{i}") for i in range(len(rule))],
            *[F.sum(F.when(_all(rule[: i + 1]), 1 - F.col("bad"))).alias(f"n{i}") for i in range(len(rule))],
        )
        by = {r["aside"]: r for r in judged.collect()}
        scores = []
        for i in range(len(rule)):
            p, n = ((by[True][f"{k}{i}"] or 0) if True in by else 0 for k in "pn")
            grown_p, grown_n = ((by[False][f"{k}{i}"] or 0) if False in by else 0 for k in "pn")
            precise = (p + grown_p) / max(1, p + n + grown_p + grown_n) >= PRECISION and p >= PRECISION * (p + n)
            scores.append(((p - n) / max(1, p + n) if precise else -1.0, p, i))
        value, _, end = max(scores)
        if value < 0:
            break
        rules.append(rule[: end + 1])
        rest = rest.filter(~_all(rules[-1]))
    return rules


def decision(rules: Sequence[Rule], stats: Column) -> Column:
    """The list as one ordered conditional: false where a rule applies first, true where none does."""
    if not rules:
        return F.lit(True)
    out = F.when(_all(rules[0], stats), F.lit(False))
    for rule in rules[1:]:
        out = out.when(_all(rule, stats), F.lit(False))
    return out.otherwise(F.lit(True))


def learn_from(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """Rules learned from all labelled rows that pass the base rule. Labels other than 0 and 1 and null ids are left out.

    ``measured`` has ``_id`` and ``_stats``; what is joined to the labels is a few numbers per row.
    """
    known = labels.filter(F.col(quality).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).alias("_quality"))
    rows = measured.filter(~base_failed(F.col("_stats"))).select("_id", "_stats").join(known, "_id")
    rows = rows.select(*[F.col("_stats")[f].alias(f) for f in FEATURES], (1 - F.col("_quality")).cast("int").alias("bad"), (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("aside"))
    return learn(store(rows))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: bool = False) -> DataFrame:
    """``doc_id, _stats, base_failed`` and ``kept`` of every row; with ``rows`` the rows of ``docs`` that are kept, unchanged.

    A null or empty text has no words and fails the base rule. Without labels, or with labels of one kind, the list is empty
    and only the base rule rejects. Rows that repeat an id are judged each; an empty table gives no rows. Thresholds are
    quantiles, so ties fall on the same side. Statistics are worked out once and stored, with ``rows`` beside the row they belong
    to: writing and reading a text costs far less than its statistics, and no text is joined to them.
    """
    prepare(docs.sparkSession)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if rows else []
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_own"), *row)
    measured = store(text_statistics(own, "_own").drop("_own"))
    rules = learn_from(measured, labels, doc_id)
    failed = base_failed(F.col("_stats"))
    verdict = ~failed & decision(rules, F.col("_stats"))
    if rows:
        return measured.filter(verdict).select("_row.*")
    return measured.select(F.col("_id").alias("doc_id"), "_stats", failed.alias("base_failed"), verdict.alias("kept"))
