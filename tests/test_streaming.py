from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.streaming import ops as T


def _files(spark, path, rows, schema, parts):
    """Each part is one file, so each micro-batch sees one part."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _late_rows(rng, hours):
    """Rows in event order, and the same rows dealt so that some arrive several batches late; a last row moves the watermark on."""
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), start + dt.timedelta(minutes=i), i, float(rng.randrange(20))) for i in range(120)]
    dealt = sorted(rows, key=lambda r: r[2] + rng.choice([0, 0, 0, 30, 70]))
    return rows, [*dealt, (9, start + dt.timedelta(hours=hours), 1000, 0.0)]


def test_late_rows_are_taken_in_event_order(spark, tmp_path):
    """Rows up to 70 minutes late, over eight batches, under a lag of two hours: results equal a loop over the rows in order."""
    rng = random.Random(4)
    schema = "k long, ts timestamp, id long, v double"
    rows, dealt = _late_rows(rng, 30)
    path = str(tmp_path / "in")
    _files(spark, path, dealt, schema, 8)
    stream = _stream(spark, path, schema)

    T.run_available(T.rolling_mean(stream, "k", "ts", "id", "v", 4, "2 hours"), str(tmp_path / "mean"), str(tmp_path / "c1"))
    got = {r["id"]: r["rolling_mean"] for r in spark.read.parquet(str(tmp_path / "mean")).collect()}
    assert set(got) == {r[2] for r in rows}
    for key in range(3):
        seen = []
        for k, _, ident, v in rows:
            if k == key:
                seen.append(v)
                assert abs(got[ident] - sum(seen[-4:]) / len(seen[-4:])) < 1e-9

    T.run_available(T.gate(stream.withColumn("c", F.col("v") > 8), "k", "ts", "id", "c", 3, "2 hours"), str(tmp_path / "gate"), str(tmp_path / "c2"))
    accepted = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "gate")).collect())
    expected = []
    for key in range(3):
        last, pos = None, 0
        for k, _, ident, v in rows:
            if k == key:
                pos += 1
                if v > 8 and (last is None or pos - last >= 3):
                    expected.append(ident)
                    last = pos
    assert accepted == sorted(expected)

    requests = stream.select(F.col("k").alias("aggregate_id"), "ts", F.col("id").alias("arrival"), (F.col("id") - 3 * F.col("v")).cast("long").alias("sequence"))
    T.run_available(T.classify_sequences(requests, "ts", "2 hours"), str(tmp_path / "seq"), str(tmp_path / "c3"))
    stale = {r["arrival"]: r["stale"] for r in spark.read.parquet(str(tmp_path / "seq")).collect()}
    for key in range(3):
        top = None
        for k, _, ident, v in rows:
            if k == key:
                sequence = int(ident - 3 * v)
                assert stale[ident] == (top is not None and sequence <= top)
                top = sequence if top is None else max(top, sequence)

    messages = stream.select((F.col("id") % 40).alias("message_id"), "ts", F.col("id").alias("arrival"), (F.col("v") % 2).cast("long").alias("payload_hash"))
    T.run_available(T.classify_messages(messages, "ts", "2 hours", "3 hours"), str(tmp_path / "msg"), str(tmp_path / "c4"))
    outcome = {r["arrival"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "msg")).collect()}
    first: dict = {}
    for _, _, ident, v in rows:
        known = first.setdefault(ident % 40, (ident, int(v) % 2))
        assert outcome[ident] == ("CLAIMED" if known[0] == ident else "DUPLICATE" if known[1] == int(v) % 2 else "CONFLICT")


def test_state_expires_after_its_retention(spark, tmp_path):
    """A key silent for longer than the retention begins anew; one silent for less goes on."""
    schema = "k long, ts timestamp, id long, v double"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(0), 0, 10.0), (2, at(0), 1, 10.0), (3, at(4), 2, 0.0), (2, at(4.5), 3, 20.0), (3, at(9), 4, 0.0), (3, at(13), 5, 0.0), (1, at(14), 6, 20.0), (2, at(14), 7, 40.0), (3, at(30), 8, 0.0), (3, at(31), 9, 0.0)]
    path = str(tmp_path / "in")
    _files(spark, path, rows, schema, len(rows))
    T.run_available(T.rolling_mean(_stream(spark, path, schema), "k", "ts", "id", "v", 5, "1 hour", "6 hours"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["id"]: r["rolling_mean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 10 and got[3] == 15 and got[6] == 20 and got[7] == 40


def test_late_ticks_are_dropped_behind_the_watermark(spark, tmp_path):
    schema = "k string, ts timestamp, id long, v double"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(m), i, v) for i, (m, v) in enumerate([(1, 1.0), (100, 2.0), (105, 1.5), (2, 9.0), (200, 3.0)])]
    path = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    bars = T.bars(_stream(spark, path, schema), ["k"], "ts", F.col("v").cast("decimal(18,8)"), F.lit(1), "id", "10 minutes", "5 minutes")
    T.run_available(bars, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["starts_at"].hour * 60 + r["starts_at"].minute: (float(r["high"]), r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (1.0, 1), 100: (2.0, 2)}


def test_messages_share_a_bounded_number_of_states(spark, tmp_path):
    """Messages of four hash values share four states; each expires by itself, one without an id is a message too."""
    schema = "k long, ts timestamp, id long, v double"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, at(0), i, 1.0) for i in range(30)] + [(None, at(0), 30, 1.0), (None, at(1), 31, 1.0), (2, at(1), 32, 0.0), (4, at(2), 33, 1.0)]
    rows += [(99, at(20), 34, 1.0), (99, at(20.5), 35, 1.0), (97, at(21), 39, 1.0), (4, at(22), 36, 1.0), (4, at(23), 37, 0.0), (98, at(40), 38, 1.0)]
    path = str(tmp_path / "in")
    _files(spark, path, rows, schema, len(rows))
    messages = _stream(spark, path, schema).select(F.col("k").alias("message_id"), "ts", F.col("id").alias("arrival"), F.col("v").cast("long").alias("payload_hash"))
    done = T.classify_messages(messages, "ts", "1 hour", "6 hours", buckets=4)
    query = done.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 4
    got = {r["arrival"]: (r["message_id"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(got[i] == (i, "CLAIMED") for i in range(30)) and got[30] == (None, "CLAIMED") and got[31] == (None, "DUPLICATE")
    assert got[32] == (2, "CONFLICT") and got[33] == (4, "DUPLICATE")
    assert got[36] == (4, "CLAIMED") and got[37] == (4, "CONFLICT") and 38 not in got
