"""Execution gates: which candidates of a (flow, instrument, position cycle) may become orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import Running, prefix_scan, with_position
from tickloom.session import cut_lineage


def first_n(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, limit: int) -> DataFrame:
    """The first ``limit`` candidates per key (``limit=1``: once per cycle)."""
    return with_position(candidates, keys, order, bucket, "execution").filter(F.col("execution") <= limit)


def rearmed(decisions: DataFrame, keys: Sequence[str], pos: str, bucket: Column, limit: int) -> DataFrame:
    """First candidate after each CONDITION_NOT_MET (missing input does not re-arm), at most ``limit``.

    A candidate is armed when the last NOT_MET before it is newer than the last candidate before it.
    """
    is_candidate = F.col("status") == "CANDIDATE"
    seen = prefix_scan(
        decisions,
        keys,
        [pos],
        bucket,
        {
            "_miss": Running("max", F.when(F.col("status") == "CONDITION_NOT_MET", F.col(pos)), exclusive=True),
            "_cand": Running("max", F.when(is_candidate, F.col(pos)), exclusive=True),
        },
    )
    armed = seen.filter(is_candidate & (F.col("_cand").isNull() | (F.col("_miss") > F.col("_cand")))).drop("_miss", "_cand")
    return first_n(cut_lineage(armed), keys, [pos], F.floor(F.col(pos) / 65_536), limit)


def spaced(candidates: DataFrame, keys: Sequence[str], axis: str, gap: int, chunk: int = 1_024) -> DataFrame:
    """Greedy spacing: accept a candidate when ``axis`` moved at least ``gap`` since the last accepted one.

    ``axis`` is an integer that counts bars or trading sessions, so it is bounded by the calendar (about a million one-minute
    bars in eleven years). It is cut into chunks. For each chunk, and each possible number of steps still blocked on entry
    (0..gap), the blocked steps on exit are computed in parallel; chaining those small maps per key gives the true entry
    state of every chunk, and a second parallel pass marks the accepted positions.
    """
    size = max(chunk, gap)
    xs = (
        candidates.select(*keys, F.col(axis).cast("long").alias("_x"))
        .distinct()
        .groupBy(*keys, F.floor(F.col("_x") / size).alias("_chunk"))
        .agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    )
    xs = cut_lineage(xs)

    def blocked_until(entry: Column) -> Column:
        return F.aggregate("_xs", entry.cast("long"), lambda b, x: F.when(x >= b, x + gap).otherwise(b))

    start = F.col("_chunk") * size
    exits = F.transform(F.sequence(F.lit(0), F.lit(gap)), lambda r: blocked_until(start + r))
    maps = xs.select(*keys, F.struct(F.col("_chunk").alias("c"), exits.alias("m")).alias("_map"))
    state = F.struct(F.lit(-(2**62)).cast("long").alias("b"), F.array().cast("array<struct<c:bigint,b:bigint>>").alias("entries"))

    def advance(s: Column, m: Column) -> Column:
        offset = F.greatest(F.lit(0), F.least(F.lit(gap), s["b"] - m["c"] * size))
        entry = F.struct(m["c"].alias("c"), s["b"].alias("b"))
        return F.struct(
            F.element_at(m["m"], (offset + 1).cast("int")).alias("b"), F.concat(s["entries"], F.array(entry)).alias("entries")
        )

    entries = (
        maps.groupBy(*keys)
        .agg(F.aggregate(F.sort_array(F.collect_list("_map")), state, advance)["entries"].alias("_e"))
        .select(*keys, F.explode("_e").alias("_e"))
        .select(*keys, F.col("_e.c").alias("_chunk"), F.col("_e.b").alias("_b"))
    )
    mark = F.struct(F.col("_b").cast("long").alias("b"), F.array().cast("array<bigint>").alias("hits"))

    def accept(s: Column, x: Column) -> Column:
        return F.when(x >= s["b"], F.struct((x + gap).alias("b"), F.concat(s["hits"], F.array(x)).alias("hits"))).otherwise(s)

    accepted = xs.join(entries, [*keys, "_chunk"]).select(*keys, F.explode(F.aggregate("_xs", mark, accept)["hits"]).alias("_x"))
    return candidates.withColumn("_x", F.col(axis).cast("long")).join(accepted, [*keys, "_x"]).drop("_x")


def position_scopes(candidates: DataFrame, changes: DataFrame, keys: Sequence[str], at: str, bucket: Column) -> DataFrame:
    """``candidates`` with ``scope``: how often the position of their keys has opened or closed so far.

    Gates keyed by it begin anew with every position cycle, and between positions. ``changes``: keys, ``at`` and ``changes``; a change
    counts for the candidates of its own instant. ``bucket`` is a non-decreasing function of the column ``at``.
    """
    row = F.struct(*[F.col(c) for c in candidates.columns])
    asked = candidates.select(*keys, F.col(at).alias("at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), row.alias("_row"))
    moved = changes.select(*keys, "at", F.lit(0).alias("_kind"), F.col("changes").cast("long").alias("_n"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    counted = prefix_scan(moved.unionByName(asked), keys, ["at", "_kind"], bucket, {"scope": Running("sum", F.col("_n"))})
    return counted.filter("_kind = 1").select("_row.*", "scope")
