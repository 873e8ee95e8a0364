"""Places of regular-expression matches as DataFrame expressions.

Spark gives the matches of a pattern and the text between them, not their places. A match begins where the lengths of
everything before it end, so places are running sums over both lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def _total(listed: Column) -> Column:
    return F.aggregate(listed, F.lit(0), lambda a, x: a + x)


def add_matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """``df`` with ``name``: array of (start, end, value, before, after) of the leftmost matches that do not overlap.

    Places count code points from 0, the end excluded. ``before`` and ``after`` are up to 60 characters between the match and
    its neighbours. Running sums go by blocks, so the work for a text with n matches grows with n, not with its square, up
    to some ten thousand matches. No match costs one search of the text.
    """
    v, g, w, s = f"_{name}_v", f"_{name}_g", f"_{name}_w", f"_{name}_s"
    df = df.withColumn(v, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(g, F.when(F.size(v) > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn(w, F.transform(v, lambda x, i: F.length(x) + F.length(F.get(F.col(g), i))))
    blocks = F.when(
        F.size(w) > BLOCK,
        F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(F.col(w), b * BLOCK + 1, F.lit(BLOCK)))),
    ).otherwise(F.array(F.lit(0)))
    df = df.withColumn(s, blocks)

    def before(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return _total(F.slice(F.col(s), F.lit(1), block)) + _total(F.slice(F.col(w), block * BLOCK + 1, i % BLOCK))

    def match(x: Column, i: Column) -> Column:
        gap = F.get(F.col(g), i)
        start = before(i) + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"), F.right(gap, F.lit(60)).alias("before"), F.left(F.get(F.col(g), i + 1), F.lit(60)).alias("after"))

    return df.withColumn(name, F.transform(v, match)).drop(v, g, w, s)


def kept(name: str, kind: int, good) -> Column:
    """The matches for which ``good(value)`` holds, as (kind, start, end, value, before, after)."""
    passed = F.filter(F.col(name), lambda m: good(m["value"]))
    return F.transform(passed, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "value", "before", "after")]))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of every span, comma-joined in the order given."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
