"""Repair of conversations by cheapest edits, decided by one integer minimum.

A repaired conversation's roles read: nothing, or perhaps a system turn, then user and assistant in turn, the assistant last.
Rows may be kept, given another role, or deleted, and empty turns inserted, each at a cost. The states of that grammar at each
row are the nodes of a directed acyclic graph, its edges the edits. A node's value is the best way from it to the end as one
whole number: the cost in the high digits, and below it the letters of the edits, each a digit of fixed width at its place, with
zeros behind the last. An edit before a way adds its cost and moves the letters on by one place. The least number is then the
cheapest way, and among equals the first one in the order of the alphabet, since a zero stands before all letters.

Rows stream by in order, sorted by Spark; of a conversation a task holds one byte per row, a digest of each distinct turn, and
the numbers, while turns beyond a few megabytes wait in a file of the task.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import SPACE_CHARS, prepare

#: Costs: another role, deletion, insertion, and a turn that breaks off and stays.
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Letters of the edits in the order of the alphabet: digits of three bits, zero for none.
LETTERS, BITS = " DIKR", 3
#: States: nothing yet, after the system turn, after a user, after an assistant. What may follow, and which states may end.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MAY_END = (True, False, False, True)
NAMES = {"u": "user", "a": "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Bytes of a conversation's turns that are held in memory.
IN_MEMORY = 4 << 20

_SIZE = struct.Struct("<q")


def least_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the best edits of a conversation's rows: initial of the role, fault."""
    places = 3 * len(rows) + 2
    width, top = BITS * places, BITS * (places - 1)
    low, never = (1 << width) - 1, 1 << (width + 64)

    def before(way: int, cost: int, letter: int) -> int:
        return way if way >= never else ((way >> width) + cost) << width | letter << top | (way & low) >> BITS

    def with_insertions(ways: list[int]) -> list[int]:
        """No two insertions more than lead back to the same state, so each state needs one look in this order."""
        ways[2] = min(ways[2], before(ways[3], INSERT, 2))
        for state in (0, 1, 3):
            ways[state] = min(ways[state], before(ways[2], INSERT, 2))
        return ways

    ways = with_insertions([0 if end else never for end in MAY_END])
    for initial, fault in reversed(rows):
        extra = BROKEN if fault == TRUNCATED else 0
        now = []
        for state, follow in enumerate(FOLLOW):
            way = before(ways[state], DELETE, 1)
            if fault not in (BLANK, DUPLICATE):
                if initial in follow:
                    way = min(way, before(ways[follow[initial]], extra, 3))
                way = min(way, before(ways[3 if "a" in follow else 2], REROLE + extra, 4))
            now.append(way)
        ways = with_insertions(now)
    digits = format(ways[0] & low, f"0{places}o").rstrip("0")
    return ways[0] >> width, "".join(LETTERS[int(d)] for d in digits)


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns after the edits."""
    state = 0
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if "a" in FOLLOW[state] else "u"
        state = FOLLOW[state][initial]
        yield (role if letter == "K" else NAMES[initial]), text


class Conversation:
    """One conversation as its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.rows: list[tuple[str, int]] = []
        self.seen: set[bytes] = set()
        self.turns = tempfile.SpooledTemporaryFile(IN_MEMORY)
        self.first_turn = self.last_turn = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.distinct += turn != self.last_turn
            self.last_turn = turn
        data = [role.encode(), text.encode()]
        record = _SIZE.pack(len(data[0])) + data[0] + _SIZE.pack(len(data[1])) + data[1]
        digest = hashlib.blake2b(record, digest_size=16).digest()
        words = text.rstrip(SPACE_CHARS)
        fault = BLANK if not words else DUPLICATE if digest in self.seen else TRUNCATED if words[-1] not in ".!?" else FINE
        self.seen.add(digest)
        if self.rows:
            self.illegal += self.rows[-1][0] + role[:1] not in ("su", "ua", "au")
        self.rows.append((role[:1], fault))
        self.turns.write(record)

    def _stored(self) -> Iterator[tuple[str, str]]:
        self.turns.seek(0)
        for _ in self.rows:
            yield tuple(self.turns.read(_SIZE.unpack(self.turns.read(_SIZE.size))[0]).decode() for _ in range(2))

    def result(self) -> tuple:
        cost, audit = least_edits(self.rows)
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(edited(audit, self._stored())):
            digest.update(("\n" * (i > 0) + f"{role}:{text}").encode())
        self.turns.close()
        faults = [f for _, f in self.rows]
        gaps = self.last_turn - self.first_turn + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), self.illegal, cost, audit, digest.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows changed by the CRC of id and turn; dropped ones stay, marked, for their conversation.

    A null role or text is one space, and so is a null id or turn where the CRC is taken."""

    def shown(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown(turns["conv_id"]), shown(turns["turn"])).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown(turns["text"]), ".!?", "")).otherwise(shown(turns["text"]))
    role = F.when(kind == 4, "user").otherwise(shown(turns["role"]))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("_kind"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, letters of the edits, digest of the repaired turns.

    ``turns`` has ``conv_id, turn, role, text`` without null roles and texts, and ``gone`` where a row does not count (a conversation
    all of whose rows are gone comes out with zeros and empty texts). Rows are taken by turn, nulls first, then role and text. A
    null id is a conversation of its own. Only the first character of a role counts; an empty role cannot be kept. An empty table
    gives no rows. Conversations are spread by id; one conversation is one task's work, which grows with the square of its rows
    (in machine words of the numbers compared), while its turns are never held in memory together.
    """
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv)
                if not gone:
                    now.add(turn, role, text)
            if out:
                yield _records(out)
                out = []
        if now is not None:
            yield _records([now.result()])

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    together = turns.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return together.mapInArrow(run, RESULT)
