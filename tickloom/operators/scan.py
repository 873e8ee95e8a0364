"""Ordered scans that never put a whole key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task, which fails when one instrument or run holds a large
share of the data. Here the ordered axis is cut into buckets whose label is an order-preserving function of the order
columns (a day, a month, a quantity range). Each operator works on (key, bucket) groups and passes a carry from bucket
to bucket that is computed on a small per-bucket summary:

* ``prefix_scan``  running sum / count / max / min / last / first / previous value, any direction, exact;
* ``with_position``  dense 1-based row number per key;
* ``in_chunks``  fixed-size chunks of consecutive rows, each with the preceding rows a bounded frame needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


@dataclass(frozen=True)
class Running:
    """One running value. ``kind``: sum, count, max, min, last (ignores NULL), prev (row before, NULL kept)."""

    kind: str
    expr: Column
    exclusive: bool = False
    reverse: bool = False


def _ordering(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _local(run: Running, spec: WindowSpec) -> Column:
    frame = spec.rowsBetween(Window.unboundedPreceding, -1 if run.exclusive or run.kind == "prev" else 0)
    if run.kind == "sum":
        return F.sum(run.expr).over(frame)
    if run.kind == "count":
        return F.count(run.expr).over(frame)
    if run.kind == "max":
        return F.max(run.expr).over(frame)
    if run.kind == "min":
        return F.min(run.expr).over(frame)
    if run.kind == "last":
        return F.last(run.expr, ignorenulls=True).over(frame)
    if run.kind == "prev":
        return F.last(F.struct(run.expr.alias("v"))).over(frame)
    raise ValueError(f"unknown running kind {run.kind!r}")


def _total(run: Running, order: Sequence[str], reverse: bool) -> Column:
    # A single order column keeps the aggregation buffer fixed-width, so Spark hashes instead of sorting.
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    if run.kind == "sum":
        return F.sum(run.expr)
    if run.kind == "count":
        return F.count(run.expr)
    if run.kind == "max":
        return F.max(run.expr)
    if run.kind == "min":
        return F.min(run.expr)
    if run.kind == "last":
        return pick(run.expr, F.when(run.expr.isNotNull(), key))
    return pick(run.expr, key)


def _carry(run: Running, total: Column, spec: WindowSpec) -> Column:
    frame = spec.rowsBetween(Window.unboundedPreceding, -1)
    if run.kind in ("sum", "count"):
        return F.sum(total).over(frame)
    if run.kind == "max":
        return F.max(total).over(frame)
    if run.kind == "min":
        return F.min(total).over(frame)
    if run.kind == "prev":
        # Every bucket of the summary has rows, so the row before a bucket is the last one of the bucket before.
        return F.lag(F.struct(total.alias("v")), 1).over(spec)
    return F.last(total, ignorenulls=True).over(frame)


def _combine(run: Running, local: Column, carry: Column, dtype: T.DataType) -> Column:
    if run.kind == "count":
        return local + F.coalesce(carry, F.lit(0))
    if run.kind == "sum":
        if isinstance(dtype, T.DecimalType):
            # Adding two 38-digit decimals gives up scale; 37 digits keep it exact.
            exact = T.DecimalType(min(dtype.precision, 37), dtype.scale)
            local, carry = local.cast(exact), carry.cast(exact)
        return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
    if run.kind == "max":
        return F.greatest(local, carry)
    if run.kind == "min":
        return F.least(local, carry)
    if run.kind == "prev":
        return F.coalesce(local, carry)["v"]
    return F.coalesce(local, carry)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    outs: Mapping[str, Running],
    reverse: bool = False,
) -> DataFrame:
    """Append running values per ``keys`` in ``order``.

    ``bucket`` must be a non-decreasing function of ``order``. One exchange of the rows by (keys, bucket) plus a
    partially aggregated summary of one row per (key, bucket). ``bucket=None`` is for groups whose size is bounded by
    definition (one session of one instrument) and runs a plain window. ``reverse`` scans from the end; a single output can
    turn its own direction, both directions share the exchange.
    """
    if bucket is None:
        done = df
        for name, run in outs.items():
            spec = Window.partitionBy(*keys).orderBy(*_ordering(order, run.reverse != reverse))
            done = done.withColumn(name, F.lag(run.expr, 1).over(spec) if run.kind == "prev" else _local(run, spec))
        return done

    base = df.withColumn(BUCKET, bucket)
    group = [*keys, BUCKET]
    names = list(outs)
    backward = {n: outs[n].reverse != reverse for n in names}
    rows = {d: Window.partitionBy(*group).orderBy(*_ordering(order, d)) for d in (False, True)}
    buckets = {d: Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc() if d else F.col(BUCKET).asc()) for d in (False, True)}
    local = base.select("*", *[_local(outs[n], rows[backward[n]]).alias(f"_l_{n}") for n in names])

    totals = base.groupBy(*group).agg(*[_total(outs[n], order, backward[n]).alias(f"_t_{n}") for n in names])
    carries = totals.select(*group, *[_carry(outs[n], F.col(f"_t_{n}"), buckets[backward[n]]).alias(f"_c_{n}") for n in names])

    types = {f.name: f.dataType for f in local.schema.fields}
    joined = local.join(carries, group, "left")
    return joined.select(
        *[c for c in df.columns if c not in outs],
        *[_combine(outs[n], F.col(f"_l_{n}"), F.col(f"_c_{n}"), types[f"_l_{n}"]).alias(n) for n in names],
    )


def running_sum_and_floor(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, value: Column, total: str, floor: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Running sum and the running minimum of that sum (``floor``; ``<floor>_before`` excludes the current row), and further running
    ``sums`` of decimals with 8 places.

    All carries come from one summary: a bucket contributes its sums and the lowest partial sum inside it. ``bucket=None`` is for
    bounded groups, as in ``prefix_scan``.
    """
    sums = sums or {}
    money = "decimal(28,8)"
    if bucket is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        upto, before = spec.rowsBetween(Window.unboundedPreceding, 0), spec.rowsBetween(Window.unboundedPreceding, -1)
        running = df.withColumns({total: F.sum(value).over(upto)} | {n: F.sum(c).over(upto).cast(money) for n, c in sums.items()})
        return running.withColumn(f"{floor}_before", F.min(total).over(before)).withColumn(floor, F.least(total, f"{floor}_before"))
    base = df.withColumn(BUCKET, bucket).withColumn("_v", value)
    group = [*keys, BUCKET]
    rows = Window.partitionBy(*group).orderBy(*order)
    upto, before = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({"_ls": F.sum("_v").over(upto)} | {f"_l_{n}": F.sum(c).over(upto).cast(money) for n, c in sums.items()})
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    exact = F.col("_v").cast("decimal(28,8)")
    zero = F.lit(0).cast("decimal(28,8)")
    summary = local.groupBy(*group).agg(F.sum(exact).cast("decimal(28,8)").alias("_ts"), F.min("_ls").alias("_tm"), *[F.sum(c.cast(money)).cast(money).alias(f"_t_{n}") for n, c in sums.items()])
    summary = summary.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier).cast(money), zero) for n in sums})
    summary = summary.withColumn("_cs", F.coalesce(F.sum("_ts").over(earlier).cast("decimal(28,8)"), zero))
    summary = summary.withColumn("_cm", F.min(F.col("_cs") + F.col("_tm")).over(earlier)).select(*group, "_cs", "_cm", *[f"_c_{n}" for n in sums])
    joined = local.withColumns({"_lm": F.min("_ls").over(upto), "_lb": F.min("_ls").over(before)}).join(summary, group, "left")
    return joined.select(
        *df.columns,
        (F.col("_cs") + F.col("_ls")).alias(total),
        F.least("_cm", F.col("_cs") + F.col("_lm")).alias(floor),
        F.least("_cm", F.col("_cs") + F.col("_lb")).alias(f"{floor}_before"),
        *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).cast(money).alias(n) for n in sums],
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, name: str = "pos"
) -> DataFrame:
    """Dense 1-based position per key: a running count."""
    return prefix_scan(df, keys, order, bucket, {name: Running("count", F.lit(1))})


def in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    halo: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk_rows: int = 50_000,
    pos: str = "pos",
) -> DataFrame:
    """Run bounded-frame windows over chunks of ``chunk_rows`` consecutive rows of a key.

    Every chunk also receives the last ``halo`` rows of the chunk before it, so any frame that looks back at most
    ``halo`` rows is exact; those copies are dropped afterwards. All columns built in ``compute`` share one exchange.
    """
    size = max(chunk_rows, halo, 1)
    home = F.floor((F.col(pos) - 1) / F.lit(size))
    tail = F.pmod(F.col(pos) - 1, F.lit(size)) >= F.lit(size - halo)
    placed = (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    )
    spec = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    done = compute(placed, spec)
    return done.filter("_chunk = _home").drop("_chunk", "_home")
