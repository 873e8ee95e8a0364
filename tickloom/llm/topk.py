"""Exact top-k inner products by columnar branch and bound.

Candidates are read in chunks and laid out vertically (one row per dimension). For a block of queries the scores of a whole
chunk are accumulated dimension block by dimension block. After each block a candidate survives for a query only if its score
so far plus the most that the remaining dimensions can add (the product of the remaining lengths of both vectors) reaches the
query's k-th best score; the survivors are compacted and only they see the next block. The k-th best score starts from a first
pass over a bounded sample, so that every task prunes from its first chunk.

Queries are taken in blocks of bounded size. A block is broadcast, meets every candidate once, and leaves at most k rows per
query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, store

#: Queries per broadcast block; queries worked on together; candidates per chunk; dimensions per step; sampled candidates.
QUERY_BLOCK, QUERY_GROUP, CHUNK, STEP, SAMPLE = 4096, 256, 2048, 16, 4096
#: Sums below this are exact in double arithmetic.
EXACT = 1 << 52


def scaled(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return np.floor(out * scale)


def suffix_lengths(values: np.ndarray, step: int) -> np.ndarray:
    """Length of what remains of each vector after each block; the last is zero."""
    squares = np.add.reduceat(values * values, np.arange(0, values.shape[1], step), axis=1)
    rest = squares[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(np.c_[rest[:, 1:], np.zeros(len(values))])


def best(columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, query: np.ndarray, query_id: int, query_rest: np.ndarray, first: np.ndarray, floor: float, k: int):
    """Ids and scores of the k best candidates of a chunk for one query, from the scores of the first block on."""
    floor -= abs(floor) * 1e-12 if np.isfinite(floor) else 0.0
    alive = np.flatnonzero((first + rest[:, 0] * query_rest[0] * (1 + 1e-9) + 1e-3 >= floor) & (ids != query_id))
    score = first[alive]
    for block in range(1, len(query_rest)):
        if not len(alive):
            break
        a, b = block * STEP, (block + 1) * STEP
        score = score + query[a:b] @ columns[a:b, alive]
        if len(alive) > k:
            # The k-th best lower bound among the survivors raises the floor.
            slack = rest[alive, block] * query_rest[block] * (1 + 1e-9) + 1e-3
            floor = max(floor, np.partition(score - slack, -k)[-k])
            stay = score + slack >= floor
            alive, score = alive[stay], score[stay]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query; ties go to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own id. Vectors that are
    null, or hold a null or a component that is not finite, take no part, nor do rows without an id; vectors of unequal
    lengths are compared as if filled up with zeros. Rows that repeat an id are candidates each, and their queries share one
    list of k. Components beyond 2^20 are worked out in whole-number arithmetic; a score beyond 64 bits is an error. An empty
    table gives no rows. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    given = F.col(vector)
    usable = given.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = store(vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), given.cast("array<double>").alias("v")))
    facts = known.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, largest = int(facts[0] or 0), float(facts[1] or 0.0)
    width = max(STEP, -(-width // STEP) * STEP)
    reach = (largest * scale + 1) ** 2 * width
    if reach >= 2**63:
        raise OverflowError("scores do not fit 64 bits")
    kind = np.float64 if reach < EXACT else np.int64
    queries = known.filter(F.col("vec_id") % every == 0)
    blocks = 1 + (queries.count() - 1) // QUERY_BLOCK
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    sample = [r for r in known.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(16)) == 0).limit(SAMPLE).collect()]
    result = None
    for block in range(blocks):
        rows = numbered.filter(F.col("_block") == block).collect()
        if rows:
            found = _block_top(known, rows, sample, width, k, scale, kind)
            result = found if result is None else result.unionAll(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = store(result)
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_top(known: DataFrame, rows: list, sample: list, width: int, k: int, scale: int, kind) -> DataFrame:
    """At most k rows per query of the block and task."""
    query_ids = np.array([r["vec_id"] for r in rows], np.int64)
    queries = scaled([r["v"] for r in rows], width, scale).astype(kind)
    query_rest = suffix_lengths(queries.astype(np.float64), STEP)
    floors = np.full(len(rows), -np.inf)
    if len(sample) > k:
        seen = queries @ scaled([r["v"] for r in sample], width, scale).astype(kind).T
        seen = np.where(query_ids[:, None] == np.array([r["vec_id"] for r in sample])[None, :], np.iinfo(np.int64).min if kind is np.int64 else -np.inf, seen)
        floors = np.partition(seen, -k, axis=1)[:, -k].astype(np.float64)
    shared = known.sparkSession.sparkContext.broadcast((query_ids, queries, query_rest, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, query_rest, floors = shared.value
        floors = floors.copy()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, values in _chunks(batches, width, scale):
            values = values.astype(kind)
            rest = suffix_lengths(values.astype(np.float64), STEP)
            columns = np.ascontiguousarray(values.T)
            for at in range(0, len(queries), QUERY_GROUP):
                first = queries[at : at + QUERY_GROUP, :STEP] @ columns[:STEP]
                for i, scores in enumerate(first, start=at):
                    found, score = best(columns, ids, rest, queries[i], query_ids[i], query_rest[i], scores, floors[i], k)
                    if not len(found):
                        continue
                    if i in held:
                        found, score = np.r_[held[i][0], found], np.r_[held[i][1], score]
                        order = np.lexsort((found, -score))[:k]
                        found, score = found[order], score[order]
                    held[i] = found, score
                    if len(found) == k:
                        floors[i] = max(floors[i], float(score[-1]))
        if held:
            sizes = [len(f) for f, _ in held.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_ids[list(held)], sizes)),
                    pa.array(np.concatenate([f for f, _ in held.values()])),
                    pa.array(np.concatenate([s for _, s in held.values()]).astype(np.int64)),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return known.mapInArrow(run, "query_id long, vec_id long, score long")


def _chunks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            vectors = part.column(1)
            lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            values = np.zeros((part.num_rows, width))
            values[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(values * scale)
