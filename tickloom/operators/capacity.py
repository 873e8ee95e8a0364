"""Bar capacity shared between orders, over all bars of their lives.

A bar lets the orders of its instrument take so much in all, in the order they were submitted; an order takes what is left of each
bar of its life until it is complete or expires. Orders become eligible in the order they are submitted.

Laid end to end, the capacities of an instrument's bars are one axis. An order may use it from ``a`` (where the first bar of its
life begins) up to ``d`` (where the last one ends). If the orders before it have used the axis up to ``f``, it is served from
max(f, a) on, and the axis is used up to

    g(f) = max(f, min(max(f, a) + quantity, d)).

Each g is a line broken in three places, and so are chains of them in more. Positions cut an instrument's orders into chunks; each
chunk is chained into one broken line, the lines are evaluated one after the other, which gives the place where each chunk begins,
and a second pass serves the orders of all chunks at once. No instrument is one task's work but for one number per chunk.

Instruments with at most ``WHOLE_RUN_ROWS`` orders and bars need no chunks: their rows are sent once, and their orders are served one
after the other as they stream by.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ledger import WHOLE_RUN_ROWS
from tickloom.operators.scan import Running, prefix_scan, with_position
from tickloom.session import cut_lineage

#: Orders of a chunk; decimal type of the axis and the units it is counted in.
CHUNK = 1024
AXIS = "decimal(28,8)"
UNIT = 100_000_000

#: A piece of a broken line: where it begins (None: at the lowest), whether it rises, and its value there or its distance from f.
Piece = tuple[int | None, bool, int]


def chained(pieces: list[Piece], a: int, d: int, quantity: int) -> list[Piece]:
    """The line g after the line given; neighbours on the same line are one piece."""
    if a >= d:
        return pieces
    out: list[Piece] = []

    def add(start: int | None, rises: bool, value: int) -> None:
        if not out or out[-1][1:] != (rises, value):
            out.append((start, rises, value))

    for i, (start, rises, value) in enumerate(pieces):
        if not rises:
            add(start, False, max(value, min(max(value, a) + quantity, d)))
            continue
        end = pieces[i + 1][0] if i + 1 < len(pieces) else None
        # Where f + value meets the breaks of g: below a, from a on, from d - quantity on, from d on.
        cuts = [(None, False, min(a + quantity, d)), (a - value, True, value + quantity), (max(a, d - quantity) - value, False, d), (d - value, True, value)]
        for (at, up, v), upto in zip(cuts, [c[0] for c in cuts[1:]] + [None], strict=True):
            low = start if at is None else at if start is None else max(start, at)
            if (low is None or end is None or low < end) and (low is None or upto is None or low < upto):
                add(low, up, v)
    return out


def evaluated(pieces: Sequence[Piece], f: int) -> int:
    at = bisect_right([p[0] for p in pieces[1:]], f)
    _, rises, value = pieces[at]
    return f + value if rises else value


def _chunk_lines(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    pieces: list[Piece] = [(None, True, 0)]
    for a, d, q in zip(*(rows.sort_values("_pos")[c] for c in ("_a", "_d", "_q")), strict=True):
        pieces = chained(pieces, int(a), int(d), int(q))
    first = {k: [rows[k].iloc[0]] for k in keys}
    return pd.DataFrame(first | {"_at": [[p[0] for p in pieces[1:]]], "_rises": [[p[1] for p in pieces]], "_value": [[p[2] for p in pieces]]})


def _used(f: int, a: list[int], d: list[int], q: list[int]) -> tuple[list[int], list[int]]:
    """Where each of the orders begins and ends on the axis that is used up to ``f``."""
    begins, ends = [], []
    for since, until, quantity in zip(a, d, q, strict=True):
        begin = max(f, since)
        f = max(f, min(begin + quantity, until))
        begins.append(min(begin, f))
        ends.append(f)
    return begins, ends


def _served(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_pos")
    begins, ends = _used(int(rows["_f"].iloc[0]), *(list(map(int, rows[c])) for c in ("_a", "_d", "_q")))
    return rows.assign(_begin=begins, _end=ends)


def _in_turn(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Serves the orders of one key after the other. Of each key come first its bars, in order, then its orders as submitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, 0
        bars: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for batch in batches:
            n, names, starts = batch.num_rows, batch.column(key), batch.column("starts_at")
            cap, a, d, q = (batch.column(c).to_numpy() for c in ("_cap", "_a", "_d", "_q"))
            is_bar = batch.column("_kind").to_numpy() == 1
            new = pc.not_equal(names.slice(1), names.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
            rows, at, taken, left = [], [], [], []
            for i, j in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), n]):
                if i == j:
                    continue
                if (name := names[i].as_py()) != now:
                    now, f, bars = name, 0, []
                m = i + int(is_bar[i:j].sum())
                if m > i:
                    bars.append((a[i:m], cap[i:m], starts.slice(i, m - i)))
                if m == j or not bars:
                    continue
                if len(bars) > 1:
                    bars = [(np.concatenate([b[0] for b in bars]), np.concatenate([b[1] for b in bars]), pa.concat_arrays([b[2] for b in bars]))]
                (high, size, when) = bars[0]
                begins, ends = _used(f, a[m:j].tolist(), d[m:j].tolist(), q[m:j].tolist())
                f = ends[-1]
                begin, end = np.array(begins, np.int64), np.array(ends, np.int64)
                first = np.searchsorted(high, begin, "right")
                number = np.where(end > begin, np.searchsorted(high - size, end, "left") - first, 0)
                mine = np.repeat(np.arange(j - m), number)
                bar = np.arange(len(mine)) + np.repeat(first - (np.cumsum(number) - number), number)
                upto = np.minimum(end[mine], high[bar])
                rows.append(mine + m)
                at.append(when.take(pa.array(bar)))
                taken.append(upto - np.maximum(begin[mine], high[bar] - size[bar]))
                left.append(q[m:j][mine] - (upto - begin[mine]))
            if rows:
                which = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [names.take(which), batch.column("order_id").take(which), pa.concat_arrays(at), pa.array(np.concatenate(taken)), pa.array(np.concatenate(left))],
                    names=[key, "order_id", "starts_at", "_t", "_left"],
                )

    return run


def _entries(lines: DataFrame, key: str) -> DataFrame:
    """Where each chunk begins: the lines of a key in order, one number carried on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f = None, 0
        for frame in frames:
            out = []
            for name, at, rises, value in zip(frame[key], frame["_at"], frame["_rises"], frame["_value"], strict=True):
                if name != now:
                    now, f = name, 0
                out.append(f)
                f = evaluated(list(zip([None, *map(int, at)], map(bool, rises), map(int, value), strict=True)), f)
            yield frame[[key, "_chunk"]].assign(_f=out)

    kind = lines.schema[key].dataType.simpleString()
    return lines.repartition(key).sortWithinPartitions(key, "_chunk").mapInPandas(run, f"{key} {kind}, _chunk long, _f long")


def share_capacity(orders: DataFrame, bars: DataFrame, capacity: Column, submission: Sequence[str], bucket: Column, width: float, key: str = "instrument_id", chunk: int = CHUNK, limit: int = WHOLE_RUN_ROWS) -> DataFrame:
    """``key, order_id, starts_at, filled_quantity, remaining, fill_status``: what each order takes of each bar.

    ``orders``: key, order_id, quantity, eligible_at, expires_at and the ``submission`` columns; an order's life are the bars that start
    from eligible_at on and before expires_at. ``bars``: key, starts_at; ``capacity`` is an expression over them, and a bar without
    capacity serves nobody. ``bucket`` is a non-decreasing function of the submission columns, ``width`` the bucket width on the
    capacity axis. Quantities have eight places; an instrument's whole capacity must stay below 9e10. Orders that get nothing have
    no row. Instruments of more than ``limit`` orders and bars are cut into chunks of ``chunk`` orders; there are at most rows / ``limit``
    of them.
    """
    open_bars = bars.select(key, "starts_at", capacity.cast(AXIS).alias("_cap")).filter("_cap > 0")
    sizes = orders.select(key).unionByName(bars.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.filter(F.col("_n") > limit).select(key))
    if large.isEmpty():
        return _share_whole(orders, open_bars, submission, key)
    few = F.broadcast(large)
    small = _share_whole(orders.join(few, key, "left_anti"), open_bars.join(few, key, "left_anti"), submission, key)
    return small.unionByName(_share_spread(orders.join(few, key, "left_semi"), open_bars.join(few, key, "left_semi"), submission, bucket, width, key, chunk))


def _shares(units: Column) -> Column:
    return (units.cast(AXIS) / UNIT).cast("decimal(18,8)")


def _with_status(done: DataFrame) -> DataFrame:
    return done.withColumn("fill_status", F.when(F.col("remaining") == 0, "FILLED").otherwise("PARTIALLY_FILLED"))


def _share_whole(orders: DataFrame, open_bars: DataFrame, submission: Sequence[str], key: str) -> DataFrame:
    """``share_capacity`` for instruments of a bounded number of rows: one exchange of orders and bars."""
    kinds = {f.name: f.dataType for f in orders.schema.fields}
    sent = [c for c in dict.fromkeys(["order_id", "eligible_at", "expires_at", *submission]) if c != key]
    none = F.lit(None).cast("timestamp")
    lives = orders.filter(F.col(key).isNotNull() & F.col("order_id").isNotNull()).select(
        key, F.lit(0).alias("_kind"), none.alias("starts_at"), F.lit(0).cast("long").alias("_cap"), F.coalesce((F.col("quantity").cast(AXIS) * UNIT).cast("long"), F.lit(0)).alias("_q"), *sent
    )
    edges = {"eligible_at": F.col("starts_at"), "expires_at": F.col("starts_at")}
    line = lives.unionByName(
        open_bars.filter(F.col(key).isNotNull()).select(
            key, F.lit(1).alias("_kind"), "starts_at", (F.col("_cap") * UNIT).cast("long").alias("_cap"), F.lit(0).cast("long").alias("_q"),
            *[edges.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in sent],
        )
    )
    # At one instant the edges of lives come before the bar that starts there.
    upto = [Window.partitionBy(key).orderBy(edge, "_kind").rowsBetween(Window.unboundedPreceding, 0) for edge in ("eligible_at", "expires_at")]
    laid = line.repartition(key).withColumn("_a", F.sum("_cap").over(upto[0])).withColumn("_d", F.sum("_cap").over(upto[1]))
    queued = laid.sortWithinPartitions(key, F.desc("_kind"), F.when(F.col("_kind") == 1, F.col("_a")), *[c for c in submission if c != key])
    shape = f"{key} {kinds[key].simpleString()}, order_id {kinds['order_id'].simpleString()}, starts_at timestamp, _t long, _left long"
    served = queued.select(key, "_kind", "starts_at", "_cap", "_a", "_d", "_q", "order_id").mapInArrow(_in_turn(key), shape)
    return _with_status(served.select(key, "order_id", "starts_at", _shares(F.col("_t")).alias("filled_quantity"), _shares(F.col("_left")).alias("remaining")))


def _share_spread(orders: DataFrame, open_bars: DataFrame, submission: Sequence[str], bucket: Column, width: float, key: str, chunk: int) -> DataFrame:
    """``share_capacity`` for instruments of any number of rows."""
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast(AXIS)
    instants = orders.select(key, "order_id", F.explode(F.array(F.struct(F.col("eligible_at").alias("at"), F.lit("a").alias("edge")), F.struct(F.col("expires_at").alias("at"), F.lit("d").alias("edge")))).alias("_e"))
    # At one instant the edges of lives come before the bar that starts there.
    line = open_bars.select(key, F.col("starts_at").alias("at"), F.lit(1).alias("kind"), none.alias("order_id"), none.alias("edge"), "_cap").unionByName(
        instants.select(key, "_e.at", F.lit(0).alias("kind"), F.col("order_id").cast("string").alias("order_id"), "_e.edge", zero.alias("_cap"))
    )
    laid = cut_lineage(prefix_scan(line, [key], ["at", "kind"], F.date_trunc("month", "at"), {"_upto": Running("sum", F.col("_cap"))}))
    units = (F.col("_upto") * UNIT).cast("long")
    edges = laid.filter("kind = 0").groupBy(key, F.col("order_id").alias("_id")).agg(F.max(F.when(F.col("edge") == "a", units)).alias("_a"), F.max(F.when(F.col("edge") == "d", units)).alias("_d"))

    placed = with_position(orders.select(key, "order_id", "quantity", *[c for c in submission if c not in (key, "order_id", "quantity")]), [key], list(submission), bucket, "_pos")
    placed = placed.select(key, "order_id", F.col("order_id").cast("string").alias("_id"), "quantity", "_pos", F.floor((F.col("_pos") - 1) / chunk).alias("_chunk"))
    queued = cut_lineage(placed.join(edges, [key, "_id"]).drop("_id").withColumn("_q", (F.col("quantity").cast(AXIS) * UNIT).cast("long")))
    kind = queued.schema[key].dataType.simpleString()
    lines = queued.groupBy(key, "_chunk").applyInPandas(lambda rows: _chunk_lines(rows, [key, "_chunk"]), f"{key} {kind}, _chunk long, _at array<bigint>, _rises array<boolean>, _value array<bigint>")
    entries = cut_lineage(_entries(lines, key))
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in queued.schema.fields if f.name != "_chunk"] + ["_chunk long", "_f long", "_begin long", "_end long"])
    ordered = [c.split()[0] for c in shape.split(", ")]
    served = queued.join(entries, [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(lambda rows: _served(rows)[ordered], shape)
    served = cut_lineage(served.filter("_end > _begin").select(key, "order_id", "quantity", "_begin", "_end"))

    # Bars and services both cut the axis; a stretch between two cuts lies in one bar and in one service or none.
    order = F.struct("order_id", "quantity", "_begin", "_end")
    no_order, no_bar = F.lit(None).cast(served.select(order.alias("o")).schema["o"].dataType), F.lit(None).cast("timestamp")
    cuts = served.select(key, F.col("_end").alias("q"), F.lit(0).alias("kind"), order.alias("o"), no_bar.alias("bar"))
    cuts = cuts.unionByName(laid.filter("kind = 1").select(key, units.alias("q"), F.lit(1).alias("kind"), no_order.alias("o"), F.col("at").alias("bar")))
    cuts = cuts.unionByName(served.select(key, F.col("_begin").alias("q"), F.lit(2).alias("kind"), no_order.alias("o"), no_bar.alias("bar")))
    found = prefix_scan(
        cuts, [key], ["q", "kind"], F.floor(F.col("q") / F.lit(width * UNIT)),
        {"_o": Running("last", F.col("o"), reverse=True), "_bar": Running("last", F.col("bar"), reverse=True), "_from": Running("prev", F.col("q"))},
    )
    begin = F.coalesce("_from", F.lit(0))
    inside = found.withColumn("_from", begin).filter((F.col("q") > F.col("_from")) & F.col("_o").isNotNull() & (F.col("_from") >= F.col("_o._begin")))
    taken = inside.groupBy(key, F.col("_o.order_id").alias("order_id"), F.col("_bar").alias("starts_at")).agg(
        F.sum(F.col("q") - F.col("_from")).alias("_t"), F.max("q").alias("_q"), F.max("_o").alias("_o")
    )

    left = (F.col("_o.quantity") - _shares(F.col("_q") - F.col("_o._begin"))).cast("decimal(18,8)")
    return _with_status(taken.select(key, "order_id", "starts_at", _shares(F.col("_t")).alias("filled_quantity"), left.alias("remaining")))
