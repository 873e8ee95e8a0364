"""Removal of lines that many documents share, with two Bloom filters ahead of the shuffle.

Pass one puts the hash of every line into a filter of lines seen once, and of every line met again into a filter of lines seen
twice. Tasks do this for their own rows; their filters are merged block by block, where a bit that two tasks have set counts
as seen twice. Pass two tests every line against the second filter: only suspected repeats are shuffled, to be counted exactly
and to choose the document that keeps the line. Pass three drops the confirmed lines; documents without a suspect never move.

The second filter is the only thing that is broadcast. Its size is fixed by ``MOST_BITS``; with more lines than it can tell
apart there are more false suspects, which costs shuffle and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tickloom.llm.text import SPACE_CHARS, prepare, store

#: Filter bits per line and the largest filter (2^28 bits: 32 MB to the driver and to each executor).
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
BLOCK_BITS = 1 << 18
#: Hashes that a task holds before it hands on what it has of the filters.
FLUSH = 1 << 20

_SPACES = SPACE_CHARS.encode()
#: Bytes that continue a character; a text has as many code points as it has other bytes.
_INNER = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """UTF-8 without the six ASCII spaces at both ends, A-Z in lower case."""
    return line.strip(_SPACES).lower()


def long_keys(lines: list[bytes], least: int) -> list[bytes | None]:
    """The key of every line; None for keys shorter than ``least`` code points."""
    out: list[bytes | None] = []
    for line in lines:
        key = line_key(line) if len(line) >= least else b""
        out.append(key if len(key) >= 4 * least or len(key) >= least and len(key.translate(None, _INNER)) >= least else None)
    return out


def lines_of(column: pa.Array) -> list[list[bytes]]:
    """Lines of each text as UTF-8; a null text is one empty line."""
    return [(t or b"").split(b"\n") for t in column.cast(pa.binary()).to_pylist()]


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 7)


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


def filter_bits(docs: DataFrame, text: str, least: int) -> int:
    """Size of the filters: a power of two that follows the number of lines, up to MOST_BITS."""
    lines = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    count = docs.agg(F.sum(F.when(F.length(text) >= least, lines))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(BITS_PER_LINE * count + 1)))))


def seen_twice(docs: DataFrame, text: str, least: int) -> tuple[np.ndarray, int]:
    """The filter of lines that at least two documents may hold (packed bits), and its size in bits."""
    bits = filter_bits(docs, text, least)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bit positions per filter block, from the distinct lines of each document."""
        held: list[int] = []

        def blocks() -> pa.RecordBatch:
            distinct, times = np.unique(np.array(held, np.uint64), return_counts=True)
            rows = []
            for twice in (False, True):
                chosen = distinct[times > 1] if twice else distinct
                at = np.unique(np.concatenate(positions(chosen, bits)))
                for block, part in zip(*_by_block(at), strict=True):
                    rows.append((block, twice, part.astype("<i4").tobytes()))
            held.clear()
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["block", "twice", "bits"]).astype({"block": "int32"}), preserve_index=False)

        for batch in batches:
            for lines in lines_of(batch.column(0)):
                held.extend({_hash(k) for k in long_keys(lines, least) if k is not None})
                if len(held) >= FLUSH:
                    yield blocks()
        if held:
            yield blocks()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sure, packed in batch.itertuples(index=False):
                one = once.setdefault(block, np.zeros(BLOCK_BITS, bool))
                two = twice.setdefault(block, np.zeros(BLOCK_BITS, bool))
                at = np.frombuffer(packed, "<i4")
                if sure:
                    two[at] = True
                else:
                    two[at[one[at]]] = True
                    one[at] = True
        rows = [(b, np.packbits(v, bitorder="little").tobytes()) for b, v in twice.items() if v.any()]
        if rows:
            yield pd.DataFrame(rows, columns=["block", "bits"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(partial, "block int, twice boolean, bits binary")
    blocks = parts.repartition("block").mapInPandas(merged, "block int, bits binary")
    found = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        at = row["block"] * (BLOCK_BITS // 8)
        found[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return found, bits


def _by_block(at: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted positions by block, as positions inside their block."""
    block = at // BLOCK_BITS
    names, starts = np.unique(block, return_index=True)
    return names.tolist(), np.split(at % BLOCK_BITS, starts[1:]) if len(names) else []


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """The rows of ``docs`` with the shared lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (long).

    A line's key is the line without the six ASCII spaces at both ends, A-Z in lower case. Keys of at least ``least`` code
    points that at least ``documents`` documents hold lose all their lines except in the largest id that holds them. Lines are
    cut at line feeds only; a null or empty text is one empty line. Rows that repeat an id are one document: they count once
    and keep or lose a line together. Rows without an id are one document too, which never is the largest. Keys are compared by
    SHA-256. All columns of ``docs`` stay; it may not have the two new ones. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    found, bits = seen_twice(docs, text, least)
    shared = spark.sparkContext.broadcast(found)
    columns = docs.columns

    def suspects(keys: list[list[bytes | None]]) -> list[np.ndarray]:
        """Of each document, which lines may be held by another one as well."""
        flat = [_hash(k) if k is not None else 0 for own in keys for k in own]
        long_enough = np.array([k is not None for own in keys for k in own], bool)
        one, two = positions(np.array(flat, np.uint64), bits)
        hit = long_enough
        for at in (one, two):
            hit = hit & ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return np.split(hit, np.cumsum([len(own) for own in keys])[:-1])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [long_keys(lines, least) for lines in lines_of(batch.column(1))]
            at, found = [], []
            for row, (own, hit) in enumerate(zip(keys, suspects(keys), strict=True) if keys else ()):
                mine = {_digest(own[i]) for i in np.flatnonzero(hit)}
                at += [row] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["doc", "key"])

    kind = docs.schema[doc_id].dataType
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    lines = given.mapInArrow(suspected, StructType([StructField("doc", kind), StructField("key", BinaryType())]))
    lines = store(lines.distinct())
    # Stored, so that a key that very many documents hold is split in the join with it.
    keepers = store(lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= documents))
    lost = lines.join(keepers, "key").filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    lost = store(lost.groupBy("doc").agg(F.collect_list("key").alias("_lost")))

    plain = docs.schema
    final = StructType([*plain.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def with_counts(batch: pa.RecordBatch, kept: pa.Array, before: list[int], gone: list[int]) -> pa.RecordBatch:
        new = {text: kept, "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
        names = [*columns, "n_lines", "n_dropped"]
        return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    def hits(batch: pa.RecordBatch) -> tuple[list[list[bytes | None]], list[bool]]:
        keys = [long_keys(lines, least) for lines in lines_of(batch.column(text))]
        return keys, [bool(hit.any()) for hit in suspects(keys)] if keys else []

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hit = hits(batch)
            out = batch.filter(pa.array([not h for h in hit], pa.bool_()))
            before = [len(k) for k, h in zip(keys, hit, strict=True) if not h]
            yield with_counts(out, out.column(text).fill_null(""), before, [0] * len(before))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(batch)[1], pa.bool_()))

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, before, gone = [], [], []
            for lines, lost_keys in zip(lines_of(batch.column(text)), batch.column("_lost").to_pylist(), strict=True):
                drop = set(lost_keys or ())
                stay = [line for line, k in zip(lines, long_keys(lines, least), strict=True) if k is None or _digest(k) not in drop] if drop else lines
                kept.append(b"\n".join(stay))
                before.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield with_counts(batch, pa.array(kept, pa.binary()).cast(pa.string()), before, gone)

    free = docs.mapInArrow(untouched, final)
    held = docs.mapInArrow(touched, plain)
    lost = lost.withColumnRenamed("doc", "_doc")
    # The same kind of join at every size: a broadcast for small tables only would hide what large ones cost.
    joined = held.join(lost.hint("merge"), held[doc_id].eqNullSafe(lost["_doc"]), "left").drop("_doc")
    return free.unionAll(joined.mapInArrow(cleared, final))


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()
