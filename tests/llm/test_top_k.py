"""Exact top-k against every pair."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from tickloom.llm import topk
from tickloom.llm.topk import top_k


def plain(rows, every, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = defaultdict(list)
    for q, a in usable:
        if q % every == 0:
            best[q] += [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q]
    return sorted((q, n, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("blocks", [4096, 3])
def test_top_k_equals_all_pairs(spark, monkeypatch, blocks):
    """Ties, repeated ids and rows, nulls, components that are not finite, unequal lengths, clashing columns."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=40).round(3).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 40) for i in range(300, 340)]
    rows += [(1, [0.9, 0.9]), (1, [0.1, 0.1]), (0, [0.5, 0.5]), (0, [0.5, -0.5]), (7, rows[7][1]), (20, rows[20][1])]
    rows += [(400, None), (401, [None, 1.0]), (402, [math.nan]), (403, [math.inf]), (None, [1.0]), (410, []), (-10, [0.5] * 3)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, score="clash", v=1) for i, v in rows], "vec_id long, embedding array<double>, score string, v int")
    assert rows_of(top_k(df.repartition(5), every=10)) == plain(rows, 10, 10)


def test_repeated_ids_are_candidates_each(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.9, 0.9]), (1, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(top_k(df)) == [(0, 1, 1, 943104 // 1), (0, 2, 1, 104448)] == plain(rows, 100, 10)


def test_top_k_of_few_rows(spark):
    shape = "vec_id long, embedding array<double>"
    assert rows_of(top_k(spark.createDataFrame([], shape))) == []
    assert rows_of(top_k(spark.createDataFrame([(100, [1.0])], shape))) == []
    assert rows_of(top_k(spark.createDataFrame([(100, [1.0]), (101, [2.0])], shape))) == [(100, 1, 101, 1024 * 2048)]
