"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction, with DataFrame functions only.

What the fixed patterns find are seeds. Seeds and other tokens that look like identifiers (mentions) form a graph between
values (instances) and the words around them (patterns). Rounds alternate until no further pattern is trusted: a pattern is as
good as its known instances outweigh what speaks against it, an instance as good as its patterns make it (noisy or). A value not
known yet hardly speaks against a pattern, unless it stands mainly elsewhere, is a seed of another kind or has too few or too
many digits. Mentions of accepted instances become spans, among them the places where a known value stands in a form that the
fixed patterns refuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.spans import add_matches, kept, listed
from tickloom.llm.text import UPPER, LOWER, prepare, store

# The kinds in order and their patterns. A match can begin only where its first run of characters begins or where
# the last match ended; saying so keeps the search linear on long runs and changes no match.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Other tokens that may be identifiers: seven digits or an at sign in one word.
S = r"\x20\x09-\x0D"
MENTION = rf"(?<![^{S}])(?=(?:[^{S}0-9]*+[0-9]){{7}}|[^{S}@]*+@)[^{S}]++"
EDGE = "[.,;:!?()\"'<>\\[\\]]"
#: Or seven digits and more in two to nineteen groups with a space, a dot, a hyphen or a bracket between them. A longer run is a table.
GAP = r"[\x20().-]{1,3}"
GROUPS = rf"(?=[+(0-9])(?<![^{S}])(?<![0-9]{GAP})[+(]{{0,2}}(?=[0-9](?:(?:{GAP})?[0-9]){{6}})[0-9]++(?:{GAP}[0-9]++){{1,18}}+(?!{GAP}[0-9])(?={EDGE}*+(?:[{S}]|\z))"

#: Trust: share of the known among the weights of a pattern, distinct known instances behind it, score of an instance; weight of a value
#: that nothing is known of.
PATTERN_SCORE, PATTERN_KNOWN, INSTANCE_SCORE, UNSEEN = 0.9, 5, 0.9, 0.1
#: Digits of a value by kind; those of an email address do not matter.
DIGITS = {1: (4, 12), 2: (13, 19), 3: (7, 15)}


def luhn(value: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def weight(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((F.length(digits) - i) % 2 == 1, double).otherwise(digit)

    right = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight) % 10 == 0
    return F.when(F.length(digits).between(13, 19), right).otherwise(F.lit(False))


def _digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _word_before(gap: Column) -> Column:
    return F.translate(F.regexp_extract(gap, rf"([^{S}]+)[{S}]*$", 1), UPPER, LOWER)


def _word_after(gap: Column) -> Column:
    return F.translate(F.regexp_extract(gap, rf"^[{S}]*([^{S}]+)", 1), UPPER, LOWER)


def _plain(value: Column) -> Column:
    """An instance: digits only, or lower case where there is an at sign."""
    return F.when(value.contains("@"), F.translate(value, UPPER, LOWER)).otherwise(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``_text_key``, ``base`` (spans of the fixed patterns) and ``mentions`` (with contexts) of every row."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("mention", MENTION), ("groups", GROUPS)):
        df = add_matches(df, "_t", name, pattern)
    base = F.concat(
        kept("email", 0, lambda v: F.lit(True)),
        kept("ip", 1, lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        kept("card", 2, luhn),
        kept("phone", 3, lambda v: _digit_count(v).between(9, 15)),
    )
    df = df.select("doc_id", F.xxhash64("_t").alias("_text_key"), base.alias("base"), "mention", "groups")

    def trimmed(m: Column) -> Column:
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], f"^{EDGE}+", ""))
        inner = F.regexp_replace(m["value"], f"^{EDGE}+|{EDGE}+$", "")
        start = m["start"] + lead
        return F.struct(F.lit(-1).alias("kind"), start.alias("start"), (start + F.length(inner)).alias("end"), inner.alias("value"), m["before"].alias("before"), m["after"].alias("after"))

    whole = F.transform("groups", lambda m: F.struct(F.lit(-1).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "value", "before", "after")]))
    df = df.withColumn("mention", F.concat(F.transform("mention", trimmed), whole))
    free = F.filter("mention", lambda m: (m["end"] > m["start"]) & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    def mention(m: Column) -> Column:
        return F.struct(
            m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _plain(m["value"]).alias("value"), m["value"].contains("@").alias("at"),
            _word_before(m["before"]).alias("l"), _word_after(m["after"]).alias("r"),
        )

    return df.select(
        "doc_id", "_text_key", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
        F.transform(F.concat("base", free), mention).alias("mentions"),
    )


def bootstrap(mentions: DataFrame) -> DataFrame:
    """Accepted instances ``kind, at, value``: the seeds, and the values that patterns make identifiers.

    ``mentions`` has kind (-1 for none), at, value and the words l and r around it. All counts are aggregations over distinct
    (instance, pattern) pairs, and only patterns with several known instances are joined back. What is trusted and accepted only
    grows from round to round: the rounds end when it does not, after as many as the longest chain of contexts has links.
    """
    framed = F.array(F.concat_ws(" ", F.lit("frame"), "l", F.lit("_"), "r"), F.concat_ws(" ", F.lit("left"), "l"))
    usable = mentions.filter((F.col("l") != "") & (F.length("value") > 0))
    edges = store(usable.select("at", "value", F.explode(framed).alias("pattern")).distinct())
    lefts = edges.filter(F.col("pattern").startswith("left "))
    places = store(lefts.groupBy("at", "value").agg(F.count("*").alias("places")))
    seeds = store(mentions.filter("kind >= 0").select("kind", "at", "value").distinct().withColumn("score", F.lit(1.0)))
    kinds = seeds.groupBy("at", "value").agg(F.collect_set("kind").alias("seed_of"))
    fits = F.lit(False)
    for kind, (fewest, most) in DIGITS.items():
        fits = fits | ((F.col("kind") == kind) & F.length("value").between(fewest, most))
    fits = (F.col("at") & (F.col("kind") == 0)) | (~F.col("at") & fits)
    known, before = seeds, 0
    while True:
        hopeful = store(edges.join(known, ["at", "value"]).groupBy("kind", "at", "pattern").agg(F.count("*").alias("good")).filter(F.col("good") >= PATTERN_KNOWN))
        here = lefts.join(hopeful, ["at", "pattern"]).groupBy("kind", "at", "value").agg(F.count("*").alias("here"))
        # A value against a kind: not at all once accepted, wholly where it cannot be one, by the share of its places elsewhere otherwise.
        doubt = here.join(places, ["at", "value"]).join(kinds, ["at", "value"], "left").join(known.withColumnRenamed("score", "_known"), ["kind", "at", "value"], "left")
        elsewhere = 1 - F.col("here") / F.col("places")
        unlike = ~fits | (F.col("seed_of").isNotNull() & ~F.array_contains(F.coalesce("seed_of", F.array().cast("array<int>")), F.col("kind")))
        against = F.when(F.col("_known").isNotNull(), 0.0).when(unlike, 1.0).when(elsewhere > 0.5, elsewhere).otherwise(UNSEEN)
        doubt = store(doubt.select("kind", "at", "value", against.alias("against")))
        met = edges.join(hopeful, ["at", "pattern"]).join(doubt, ["kind", "at", "value"])
        trust = F.col("good") / (F.col("good") + F.sum("against"))
        trusted = store(met.groupBy("kind", "at", "pattern", "good").agg(trust.alias("trust")).filter(F.col("trust") >= PATTERN_SCORE).select("kind", "at", "pattern", "trust"))
        now = trusted.count()
        if now == before:
            break
        before = now
        drawn = edges.join(trusted, ["at", "pattern"]).join(doubt.filter(F.col("against") <= 0.5), ["kind", "at", "value"])
        drawn = drawn.groupBy("kind", "at", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))).alias("score")).filter(F.col("score") >= INSTANCE_SCORE)
        known = store(known.unionAll(drawn).groupBy("kind", "at", "value").agg(F.max("score").alias("score")))
    best = known.groupBy("at", "value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return best.select("kind", "at", "value")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end; by kind, then start) of every row.

    A null text is empty and has no spans. Matches of one kind are leftmost and do not overlap; those of different kinds may.
    Added spans overlap neither the base spans of their text nor each other: of two, the longer one stays. Rows are told apart by id and text: equal rows get equal spans, and
    every row is returned. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)
    own = store(base_spans(docs, doc_id, text))
    mentions = own.select("doc_id", "_text_key", F.explode("mentions").alias("m")).select("doc_id", "_text_key", "m.*")
    trusted = store(bootstrap(mentions)).withColumnRenamed("kind", "_kind")
    more = mentions.filter("kind < 0").join(trusted, ["at", "value"]).select("doc_id", "_text_key", F.struct(F.col("_kind").alias("kind"), "start", "end").alias("m"))
    more = store(more.groupBy("doc_id", "_text_key").agg(F.collect_set("m").alias("_more")))
    shorter = lambda m, o: (o["start"] < m["end"]) & (m["start"] < o["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])
    more = more.withColumn("_more", F.filter("_more", lambda m: ~F.exists("_more", lambda o: shorter(m, o))))
    more = more.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_key", "_key")
    joined = own.join(more, own["doc_id"].eqNullSafe(more["_id"]) & (own["_text_key"] == more["_key"]), "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("_more", F.array().cast(own.schema["base"].dataType)))).alias("spans"))
