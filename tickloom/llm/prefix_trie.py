"""The prefix trie of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its key is the sum of two hashes per turn (of place, role and text), so that keys
are running sums and a conversation of any length is cut into buckets. Nodes are rows grouped by key.

Totals go from the deepest nodes up. Nodes are sorted in reverse level order (Spark's sort, which spills), and each sends its
totals to its parent, later in that order, through a priority queue that spills sorted runs. A node whose members have more
turns below it than ``shard_rows`` or a 4 096th of all is heavy; there are at most 4 096 of those on each level. The subtrees right below
heavy nodes are the shards; each lies in one task whole, and many shards share a task. What the shard roots send up is added up
per heavy node first; then the heavy nodes are processed in the same way across shards.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, store_packed
from tickloom.operators.scan import Running, prefix_scan, with_position

#: Subtrees of at most so many turns are no trouble for a task; heavy nodes on a level are at most so many.
SHARD_ROWS, HEAVY = 500, 4096
#: Messages a queue holds in memory; rows of a conversation that are numbered together, as a power of two.
IN_MEMORY, PLACES = 200_000, 12
KEY_SPACE = Decimal(2**63)
KEY = ["depth", "k1", "k2"]

_MESSAGE = struct.Struct("<6q")


class SpillingQueue:
    """A priority queue of messages (tuples of six numbers, least first) that holds a bounded number of them in memory.

    Spilled runs are anonymous files of the task, as Spark's own spills are: they go with the task, and nobody else reads them.
    """

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory = in_memory
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator]] = []
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.in_memory:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for message in sorted(self.heap):
            file.write(_MESSAGE.pack(*message))
        file.seek(0)
        self.heap = []
        self.spilled += 1
        self._advance(self.spilled, self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while block := file.read(_MESSAGE.size * 4096):
                yield from _MESSAGE.iter_unpack(block)

    def _advance(self, number: int, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def peek(self) -> tuple | None:
        own = self.heap[0] if self.heap else None
        other = self.runs[0][0] if self.runs else None
        return own if other is None or own is not None and own <= other else other

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, run = heapq.heappop(self.runs)
            self._advance(number, run)
            return head
        return heapq.heappop(self.heap)


def time_forward(rows: Iterator[tuple], in_memory: int = IN_MEMORY) -> Iterator[tuple[int, int, int]]:
    """Children, leaves and saved tokens of each node's subtree. Rows come in reverse level order: depth, key, parent's key (None
    where the parent is elsewhere), own saving, and the children, leaves and savings that come from elsewhere."""
    queue = SpillingQueue(in_memory)
    for depth, k1, k2, p1, p2, saving, children, leaves, saved in rows:
        saved += saving
        place = (-depth, k1, k2)
        while (message := queue.peek()) is not None and message[:3] == place:
            _, _, _, a, b, n = queue.pop()
            leaves, saved, children = leaves + a, saved + b, children + n
        leaves = leaves if children else 1
        yield children, leaves, saved
        if p1 is not None:
            queue.push((1 - depth, p1, p2, leaves, saved, 1))


_IN = [*KEY, "p1", "p2", "saving", "in_children", "in_leaves", "in_saved"]
_OUT = ["n_children", "n_leaves", "saved_tokens"]


def _forward(nodes: DataFrame) -> DataFrame:
    """``time_forward`` over each partition, whose rows come in reverse level order."""
    kept = [c for c in nodes.columns if c not in _IN or c in KEY]
    shape = ", ".join([f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} long" for c in _OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(*(batch.column(c).to_pylist() for c in _IN), strict=True)

        done: list[tuple] = []
        for found in time_forward(rows()):
            done.append(found)
            if len(done) == waiting[0].num_rows:
                batch = waiting.pop(0)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in zip(*done, strict=True)], names=[*kept, *_OUT])
                done = []

    return nodes.mapInArrow(run, shape)


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of each key, in order: a key's ids are hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(out) > 1000:
                yield _records(out)
                out = []
        if now is not None:
            out.append((*now, digest.hexdigest()))
        if out:
            yield _records(out)

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*KEY, "ends_sha256"])

    together = ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return together.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, role, text``: turns by number (null first), then role and text; null roles and texts are empty. Rows without
    a conversation belong to none and are left out."""
    known = turns.filter(turns[conv_id].isNotNull()).select(
        turns[conv_id].cast("long").alias("conv_id"), F.coalesce(turns[turn].cast("long"), F.lit(-(1 << 63))).alias("_turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"),
    )
    placed = with_position(known, ["conv_id"], ["_turn", "role", "text"], F.shiftright("_turn", PLACES), "place")
    return placed.select("conv_id", "place", "role", "text")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: turns ``conv_id, place, role, text`` and ``conv_id, n_turns`` of all.

    Conversation c begins with the first h turns of conversation c - c % family (all if it has fewer, none if there is no such
    conversation), h = crc32(c) % most, and goes on with its own turns behind its first h. At most ``family`` conversations take
    turns from one, and less than ``most`` of them.
    """
    turns = store_packed(turns)
    sizes = store_packed(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    heads = sizes.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head")
    )
    heads = heads.join(sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("_head_n")), "head", "left")
    taken = F.least("h", F.coalesce("_head_n", F.lit(0)))
    heads = store_packed(heads.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = turns.filter(F.col("place") < most).select(F.col("conv_id").alias("head"), "place", "role", "text")
    first = first.join(heads, "head").filter("place <= taken").select("conv_id", "place", "role", "text")
    own = turns.join(heads, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    return first.unionByName(own), heads.select("conv_id", "n_turns")


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, place`` (from 1, without gaps), ``role`` and ``text`` without nulls; ``conversations`` has ``conv_id`` and
    ``n_turns`` of every conversation once, those without turns included. The root is a node as soon as there is a conversation; an
    empty table gives no rows. Equal conversations share all their nodes. Keys have 126 bits; equal keys count as equal sequences.
    One conversation's id list is hashed by one task as it streams by; all else is spread.
    """
    spark = prepare(turns.sparkSession)
    hashed = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", "role", "text"), 1).cast("decimal(19,0)").alias(f"_h{seed}") for seed in (1, 2)]
    rows = turns.select("conv_id", F.col("place").cast("long").alias("depth"), F.octet_length("text").cast("long").alias("bytes"), *hashed)
    sums = prefix_scan(rows, ["conv_id"], ["depth"], F.shiftright("depth", PLACES), {"k1": Running("sum", F.col("_h1")), "k2": Running("sum", F.col("_h2"))})

    def key(column):
        return (column % F.lit(KEY_SPACE)).cast("long")

    paths = sums.select("conv_id", "depth", "bytes", *[key(F.col(f"k{i}")).alias(f"k{i}") for i in (1, 2)], *[key(F.col(f"k{i}") - F.col(f"_h{i}")).alias(f"p{i}") for i in (1, 2)])
    paths = store_packed(paths.join(conversations, "conv_id").withColumn("below", F.col("n_turns") - F.col("depth") + 1))
    facts = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    nodes = paths.groupBy(*KEY).agg(*facts, F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("below").alias("weight"))
    no_key = F.lit(None).cast("long")
    root = conversations.agg(*facts).filter("n_convs > 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"), no_key.alias("p1"), no_key.alias("p2"), no_key.alias("weight"))
    nodes = store_packed(nodes.unionByName(root).withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes")))

    limit = max(shard_rows, paths.count() // HEAVY)
    is_heavy = F.col("weight").isNull() | (F.col("weight") > limit)
    heavy = store_packed(nodes.filter(is_heavy))
    depths = paths.join(heavy.select(*KEY), KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("_heavy"))
    shards = paths.join(depths, "conv_id", "left").filter(F.col("depth") == F.coalesce("_heavy", F.lit(0)) + 1).select("conv_id", F.col("depth").alias("_top"), F.col("k1").alias("_shard"))
    light = nodes.filter(~is_heavy).join(shards, "conv_id")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    top = F.col("depth") == F.col("_top")
    sent = [F.when(~top, F.col(p)).alias(p) for p in ("p1", "p2")]
    light = light.select("_shard", *KEY, *sent, "saving", *zeros, "n_convs", "conv_id", F.col("p1").alias("up1"), F.col("p2").alias("up2"), top.alias("top"))
    light = light.repartition("_shard").drop("_shard").sortWithinPartitions(F.desc("depth"), "k1", "k2")
    light = store_packed(_forward(light))

    up = light.filter("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"))
    up = up.agg(F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
    across = heavy.join(up, KEY, "left").fillna(0, ["in_children", "in_leaves", "in_saved"])
    across = across.select(*_IN, "n_convs", "conv_id", F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.lit(False).alias("top"))
    across = _forward(across.repartition(1).sortWithinPartitions(F.desc("depth"), "k1", "k2"))

    found = light.unionByName(across)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    last = paths.filter("depth = n_turns").select("conv_id", *KEY)
    bare = conversations.filter("n_turns = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in KEY])
    out = found.join(parents, ["depth", "up1", "up2"], "left").join(_ends(last.unionByName(bare)), KEY, "left")
    none = spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", *_OUT[:2], "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
