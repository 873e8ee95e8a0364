"""Structured Streaming forms of the event-time operators.

State is keyed so that it stays small per key: bars keep one open bucket, gates one counter, windows at most 180 values; messages keep
one hash each until they expire, many messages in one state. Operators whose result depends on the order of rows hold the rows of a key back until the watermark
has passed them and take them in event order then, whatever the batch they arrived in; a timer releases the rows of keys that fall
silent. What such an operator has given equals the rows of its batch twin up to the watermark. Rows that arrive behind the watermark
are dropped, as by every operator here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.bars import tick_rank
from tickloom.operators.calendar import et_month
from tickloom.schemas import TABLES
from tickloom.session import utc


#: Bytes of files that one micro-batch reads at most (a single larger file is still one batch).
BATCH_BYTES = 8 << 30


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table folder as a stream of its files; a single-file table is picked by name from its folder."""
    reader = utc(spark).readStream.schema(TABLES[name]).option("maxBytesPerTrigger", str(BATCH_BYTES))
    path = f"{folder}/{name}.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Process everything available, append to a file sink, stop. Exactly-once through the sink's log."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()


def run_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Keep a table equal to a running aggregate: each batch rewrites the (small) result."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    query.trigger(availableNow=True).start().awaitTermination()


def bars(ticks: DataFrame, keys: list[str], ts: str, px: Column, qty: Column, tiebreak: str, width: str, lag: str) -> DataFrame:
    """Bars per event-time bucket. A bar appears once the watermark (``lag`` behind the newest tick) passes its end; later
    ticks are dropped and counted in the query's progress."""
    rows = ticks.select(*keys, F.col(ts), tick_rank(ts, tiebreak).alias("_k"), px.alias("_p"), qty.alias("_q"))
    return (
        rows.withWatermark(ts, lag)
        .groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(
            F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_k").alias("close"), F.sum("_q").cast("long").alias("volume")
        )
        .select(*keys, F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "open", "high", "low", "close", "volume")
    )


def monthly_counters(evaluations: DataFrame) -> DataFrame:
    """Running counters per run and local month (complete mode: one row per run and month)."""
    return evaluations.groupBy("run_id", et_month("evaluated_at").alias("et_month")).agg(
        F.count(F.lit(1)).alias("evaluation_count"), F.count_if("data_gap").alias("data_gap_count"), F.count_if("trade_occurred").alias("triggered_count")
    )


def _sorted(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in event order."""
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")


#: What is kept of a key (anything JSON can hold, None at first) and its next rows in order give what is kept and the rows to give out.
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def in_event_order(stream: DataFrame, key: str, ts: str, tiebreak: str, values: list[str], lag: str, retention: str, step: Step, output: str) -> DataFrame:
    """Apply ``step`` to the rows of each key in the order of ``ts`` and ``tiebreak``, across micro-batches.

    A row waits in the state until the watermark (``lag`` behind the newest row) is past its millisecond; the state of a key without
    waiting rows is dropped ``retention`` after its last row. ``output`` is the schema behind the key column.
    """
    keep_ms = int(pd.Timedelta(retention).total_seconds() * 1000)
    columns = ["_us", tiebreak, *values]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept, last_ms = (json.loads(state.get[0]), json.loads(state.get[1]), state.get[2]) if state.exists else ([], None, 0)
        held = pd.DataFrame(waiting, columns=columns)
        if not state.hasTimedOut:
            new = pd.concat(list(frames), ignore_index=True)
            new["_us"] = new[ts].astype("datetime64[us]").astype("int64")
            held = pd.concat([held, new[columns]], ignore_index=True) if len(held) else new[columns]
        held = held.sort_values(["_us", tiebreak], kind="stable", ignore_index=True)
        watermark = state.getCurrentWatermarkMs()
        ready = int((held["_us"] // 1000 < watermark).sum())
        if state.hasTimedOut and not len(held):
            state.remove()
            return
        if ready:
            kept, out = step(kept, held.iloc[:ready].reset_index(drop=True))
            last_ms = int(held["_us"].iloc[ready - 1] // 1000)
        rest = held.iloc[ready:]
        state.update((rest.to_json(orient="values"), json.dumps(kept), last_ms))
        due = int(rest["_us"].iloc[0] // 1000) if len(rest) else last_ms + keep_ms
        state.setTimeoutTimestamp(max(due, watermark + 1))
        if ready and len(out):
            out.insert(0, key, k[0])
            yield out

    slim = stream.withWatermark(ts, lag).select(key, ts, tiebreak, *values)
    kind = slim.schema[key].dataType.simpleString()
    return slim.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {output}", "waiting string, kept string, last_ms long", "append", GroupStateTimeout.EventTimeTimeout
    )


def rolling_mean(stream: DataFrame, key: str, ts: str, tiebreak: str, value: str, n: int, lag: str, retention: str = "3650 days") -> DataFrame:
    """Mean of the last ``n`` values of each key; what is kept is the list of at most n - 1 values."""

    def step(kept: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        before = kept or []
        series = pd.Series(before + rows[value].tolist(), dtype="float64")
        means = series.rolling(n, min_periods=1).mean().to_numpy()[len(before):]
        return series.tolist()[-(n - 1):] if n > 1 else [], pd.DataFrame({tiebreak: rows[tiebreak], "rolling_mean": means})

    return in_event_order(stream, key, ts, tiebreak, [value], lag, retention, step, f"{tiebreak} long, rolling_mean double")


def gate(stream: DataFrame, key: str, ts: str, tiebreak: str, candidate: str, gap: int, lag: str, retention: str = "3650 days") -> DataFrame:
    """Accept a candidate when at least ``gap`` evaluations passed since the last accepted one; what is kept is their number."""

    def step(kept: int | None, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        places = np.flatnonzero(rows[candidate].to_numpy(dtype=bool))
        last = -(gap if kept is None else kept) - 1
        hits: list[int] = []
        # From one accepted candidate straight to the first one far enough behind it.
        at = int(np.searchsorted(places, last + gap))
        while at < len(places):
            last = int(places[at])
            hits.append(last)
            at = int(np.searchsorted(places, last + gap))
        return min(gap, len(rows) - 1 - last), pd.DataFrame({tiebreak: rows[tiebreak].iloc[hits].to_numpy(dtype="int64")})

    return in_event_order(stream, key, ts, tiebreak, [candidate], lag, retention, step, f"{tiebreak} long")


def classify_messages(stream: DataFrame, ts: str, lag: str, retention: str, buckets: int = 1 << 14) -> DataFrame:
    """CLAIMED, DUPLICATE or CONFLICT per arrival of a message, in event order as by ``in_event_order``. What is kept of a message is its
    first hash and the time of its last arrival, until ``retention`` after that.

    There are about as many messages as arrivals, so they do not get a state each: messages of one of ``buckets`` hash values share one.
    """
    keep_ms = int(pd.Timedelta(retention).total_seconds() * 1000)
    columns = ["_us", "arrival", "_message", "payload_hash"]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept = map(json.loads, state.get) if state.exists else ([], {})
        held = pd.DataFrame(waiting, columns=columns)
        if not state.hasTimedOut:
            new = pd.concat(list(frames), ignore_index=True)
            new["_us"] = new[ts].astype("datetime64[us]").astype("int64")
            held = pd.concat([held, new[columns]], ignore_index=True) if len(held) else new[columns]
        held = held.sort_values(["_us", "arrival"], kind="stable", ignore_index=True)
        watermark = state.getCurrentWatermarkMs()
        present = set(held["_message"])
        kept = {m: seen for m, seen in kept.items() if m in present or seen[1] + keep_ms >= watermark}
        ready = int((held["_us"] // 1000 < watermark).sum())
        rows, rest = held.iloc[:ready], held.iloc[ready:]
        outcome = []
        for us, message, payload in zip(rows["_us"].tolist(), rows["_message"].tolist(), rows["payload_hash"].tolist(), strict=True):
            first = kept.setdefault(message, [payload, None])
            outcome.append("CLAIMED" if first[1] is None else "DUPLICATE" if first[0] == payload else "CONFLICT")
            first[1] = us // 1000
        due = [int(rest["_us"].iloc[0] // 1000)] if len(rest) else []
        due += [min(seen[1] for seen in kept.values()) + keep_ms] if kept else []
        if due:
            state.update((rest.to_json(orient="values"), json.dumps(kept)))
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        else:
            state.remove()
        if ready:
            yield pd.DataFrame({"_message": rows["_message"], "arrival": rows["arrival"], "outcome": outcome})

    kind = stream.schema["message_id"].dataType
    text = F.coalesce(F.concat(F.lit("="), F.col("message_id").cast("string")), F.lit(""))
    slim = stream.withWatermark(ts, lag).select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("_bucket"), text.alias("_message"), ts, "arrival", "payload_hash")
    done = slim.groupBy("_bucket").applyInPandasWithState(
        update, "_message string, arrival long, outcome string", "waiting string, kept string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return done.select(F.when(F.col("_message") != "", F.substring("_message", 2, 1 << 30)).cast(kind).alias("message_id"), "arrival", "outcome")


def classify_sequences(stream: DataFrame, ts: str, lag: str, retention: str = "3650 days") -> DataFrame:
    """STALE when the aggregate has already seen an equal or higher sequence; what is kept is one number per aggregate."""

    def step(kept: int | None, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        sequence = rows["sequence"].to_numpy(dtype="int64")
        lowest = np.iinfo(np.int64).min if kept is None else kept
        before = np.maximum(lowest, np.r_[lowest, np.maximum.accumulate(sequence)[:-1]])
        stale = (sequence <= before) & ((before > lowest) | (kept is not None))
        return int(max(lowest, sequence.max())), pd.DataFrame({"arrival": rows["arrival"], "stale": stale})

    return in_event_order(stream, "aggregate_id", ts, "arrival", ["sequence"], lag, retention, step, "arrival long, stale boolean")


def dedupe(stream: DataFrame, ts: str, retention: str, keys: list[str]) -> DataFrame:
    """First arrival per key inside the retention, with built-in state handling."""
    return stream.withWatermark(ts, retention).dropDuplicatesWithinWatermark(keys)


def lease_alerts(heartbeats: DataFrame, key: str, ts: str, lease: str, lag: str) -> DataFrame:
    """One alert per heartbeat that no later heartbeat renewed in time; silent keys are found by an event-time timer."""
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0], unit="us")
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [last]})
            return
        rows = _sorted(frames, [ts])
        stamps = rows[ts].tolist()
        if state.exists:
            stamps = [pd.Timestamp(state.get[0], unit="us"), *stamps]
        lost = [a for a, b in zip(stamps, stamps[1:], strict=False) if (b - a) > pd.Timedelta(milliseconds=lease_ms)]
        newest = stamps[-1]
        state.update((int(newest.value // 1000),))
        state.setTimeoutTimestamp(max(int(newest.value // 1_000_000) + lease_ms, state.getCurrentWatermarkMs() + 1))
        if lost:
            yield pd.DataFrame({key: [k[0]] * len(lost), "last_seen": pd.Series(lost, dtype="datetime64[us]")})

    slim = heartbeats.withWatermark(ts, lag).select(key, ts)
    return slim.groupBy(key).applyInPandasWithState(
        update, f"{key} long, last_seen timestamp", "last_us long", "append", GroupStateTimeout.EventTimeTimeout
    )


