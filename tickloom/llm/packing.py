"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Whole windows of a long document are cut off first; they need no partner. What remains of every document is cut into a large
part and a tail of ever smaller ones, which later even out what the large parts leave uneven, and a batch of parts is divided
over k windows: each part begins as a partial partition (its size in one window,
nothing in the others); the two partial partitions with the largest imbalance are merged with their windows in opposing order,
which evens both out, until one partition is left. k begins at the fewest windows that could hold the batch and rises until no
window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm.pretokens import UnitCache, is_plain, pieces, segments
from tickloom.llm.text import prepare
from tickloom.llm.token_counts import default_vocabulary

CAPACITY = 1024
#: A remainder keeps all but one in so many of its tokens together, and so does what is cut off, down to the smallest part.
TAPER = 8
SMALLEST = 8
#: Units that the tokenizer library encodes in one call, and how byte-level vocabularies write a line break.
GROUP, LINE_BREAK = 64, "\u010a"
#: Windows divided at a time: bounds the memory of a task and the length of a partial partition.
BATCH_WINDOWS = 256
#: Units whose ids a worker keeps; beyond that its cache starts anew.
CACHED_UNITS = 1_000_000

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp differencing into k windows: the window of every item, and the window totals."""
    heap: list[tuple[int, int]] = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    count = len(sizes)

    def totals(node: int) -> np.ndarray:
        if node >= count:
            return sums.pop(node)
        single = np.zeros(k, np.int64)
        single[0] = sizes[node]
        return single

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = totals(a) + totals(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        node = count + len(merges)
        sums[node] = joined
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), node))
    root = heap[0][1]
    total = totals(root)
    windows: dict[int, np.ndarray] = {root: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        mine = windows.pop(count + at)
        left = np.empty(k, np.int64)
        left[order] = mine
        windows[a], windows[b] = left, left[::-1]
    return np.array([windows[i][0] for i in range(count)], np.int64), total


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of every item and the number of windows, none above the capacity; no item may exceed it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows, totals = difference(sizes, k)
        if totals.max() <= capacity:
            return windows, k
        k += 1


def parts_of(length: int, taper: int = TAPER, smallest: int = SMALLEST) -> list[int]:
    """Sizes of the parts of a remainder, falling by ``taper``."""
    out = []
    while length > smallest:
        out.append(length - length // taper)
        length //= taper
    return [*out, length] if length else out


@lru_cache(maxsize=1)
def encoder(vocabulary: str, end_id: int, cached_units: int = CACHED_UNITS) -> Callable[[list[str]], list[bytes]]:
    """Texts to packed little-endian ids with the end id; the tokenizer library encodes a unit once, then it is cached.

    A worker keeps its encoder and the bounded cache from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    if len(special) > 1:
        raise ValueError("one special string is supported")
    mark, mark_id = next(iter(special.items()), (None, 0))
    between = array("I", [mark_id]).tobytes()
    end = array("I", [end_id]).tobytes()
    line_break = library.token_to_id(LINE_BREAK)

    def ids_of(units: list[str]) -> list[bytes]:
        """Plain units go to the library in groups, set apart by line breaks: one call each costs more than the encoding."""
        plain = [u for u in units if line_break is not None and is_plain(u)]
        groups = [plain[at : at + GROUP] for at in range(0, len(plain), GROUP)]
        found: dict[str, bytes] = {}
        for group, encoded in zip(groups, library.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            cuts = 4 * np.flatnonzero(ids == line_break)
            packed = ids.tobytes()
            found.update(zip(group, (packed[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(packed)], strict=True)), strict=True))
        rest = [u for u in units if u not in found]
        found.update(zip(rest, (array("I", e.ids).tobytes() for e in library.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [found[u] for u in units]

    cache = UnitCache(ids_of, cached_units)

    def encode(texts: list[str]) -> list[bytes]:
        cut = [[pieces(s) for s in segments(t, mark)] for t in texts]
        found = iter(cache.look_up(list(chain.from_iterable(cut))))
        return [between.join([b"".join(next(found)) for _ in parts]) + end for parts in cut]

    return encode


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, taper: int = TAPER, batch_windows: int = BATCH_WINDOWS, cached_units: int = CACHED_UNITS
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with the checksum of its ids.

    Every row of ``docs`` is packed, a null text as an empty one (its end id alone). Repeated rows are packed each. A text of
    any length is cut into whole windows and a remainder. Packing is local to a task, so nothing is shuffled; sequence ids hold
    the partition number, and a task that runs again reads the same rows and gives the same pieces. An empty table gives no
    rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    if taper < 2 or capacity < 1:
        raise ValueError("taper is at least 2, capacity at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id, cached_units)
        sequence = TaskContext.get().partitionId() << 36
        waiting: list[tuple] = []
        held = 0

        def packed() -> list[tuple]:
            nonlocal sequence, held
            windows, k = pack(np.array([w[2] for w in waiting], np.int64), capacity)
            offsets = [0] * k
            rows = []
            for (doc, start, length, crc, tokens), window in zip(waiting, windows.tolist(), strict=True):
                rows.append((doc, start, length, crc, tokens, sequence + window, offsets[window]))
                offsets[window] += length
            sequence += k
            waiting.clear()
            held = 0
            return rows

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names=COLUMNS)

        for batch in batches:
            rows: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(keys, encode([t or "" for t in texts]), strict=True):
                tokens = len(ids) // 4
                start = 0
                while tokens - start >= capacity:
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), tokens, sequence, 0))
                    sequence += 1
                    start += capacity
                for length in parts_of(tokens - start, taper) if tokens > start else []:
                    waiting.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens))
                    held += length
                    start += length
                if held >= batch_windows * capacity:
                    rows += packed()
            if rows:
                yield frame(rows)
        if waiting:
            yield frame(packed())

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
