"""The stages of the corpus pipeline on awkward tables, and as a whole."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tickloom.llm import simhash
from tickloom.llm.simhash import bucket_forest, similarity, without_near_copies

DATA = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _row string, words int, size double"
SHARED = "this passage of more than forty letters is found in many of the documents"


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \t", "one", "A" * 3000, "long " * 30_000, "\n".join([SHARED, "own line"]), "日本語 テキスト", SHARED.upper()]
    texts += [f"{SHARED}\ndocument {i} has words of its own {'and many more of them ' * 3}{i}" for i in range(6)]
    rows = [Row(doc_id=i, text=t, lang=None, source=[None, "a"][i % 2], n_chars=None, _row="clash", words=i, size=None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[9], Row(doc_id=None, text="one", lang=None, source="a", n_chars=1, _row=None, words=None, size=None)]
    return spark.createDataFrame(rows, SHAPE)


def test_stages_of_empty_tables(spark, awkward):
    for _, stage in pipeline.STAGES:
        assert stage(spark, awkward.limit(0), DATA).count() == 0


def test_stages_keep_the_columns_of_documents(spark, awkward):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, awkward, DATA)
        assert out.columns == awkward.columns, name
        before = {(r["doc_id"], r["words"]) for r in awkward.select("doc_id", "words").collect()}
        assert {(r["doc_id"], r["words"]) for r in out.select("doc_id", "words").collect()} <= before


def test_lines_go_and_lengths_follow(spark, awkward):
    out = pipeline.line_stage(spark, awkward, DATA).collect()
    assert len(out) == awkward.count()
    holders = [r for r in out if SHARED in (r["text"] or "").lower()]
    assert {r["doc_id"] for r in holders} == {14}
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)


def test_mixing_repeats_rows_whole(spark, awkward):
    out = Counter(str(r) for r in pipeline.mixing_stage(spark, awkward, DATA).collect())
    given = Counter(str(r) for r in awkward.collect())
    assert set(out) <= set(given) and max(out.values()) <= 3 * max(given.values())


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_equal_all_pairs(spark):
    """On the given documents: what stays is one document, the smallest, of each class of exact copies and links of 0.8 or more."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"].lower() for r in docs.collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if texts[a].split() == texts[b].split() or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r["doc_id"] for r in without_near_copies(docs).select("doc_id").collect()}
    expected = {d for d in ids if find(d) == d}
    assert expected <= kept and len(kept - expected) <= 1


def test_the_whole_pipeline(spark):
    """Every piece lies in a document that the stages kept, each of its copies is packed whole, and shared lines are gone."""
    pieces = pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    mixed = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    tokens, sequences = defaultdict(int), defaultdict(int)
    whole = {}
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]] += p["length"]
        whole[p["doc_id"]] = p["doc_tokens"]
    assert set(tokens) == set(mixed) and all(tokens[d] == mixed[d] * whole[d] for d in tokens)
    assert max(sequences.values()) <= 1024
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(quality.get(d) != 0 for d in mixed) or sum(quality.get(d) == 0 for d in mixed) <= 2
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) >= 40).select(F.lower(F.trim("line")).alias("k"), "doc_id").distinct()
    assert lines.groupBy("k").count().filter("count >= 5").count() == 0


def template_sets(seed, n=150):
    """Sets that share a template: pairs of 0.45 to 1, most of them below 0.8."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 120, np.uint64)
    out = []
    for i in range(n):
        kept = base[rng.random(120) < rng.choice([0.75, 0.9, 0.97])] if i % 3 or not out else out[rng.integers(len(out))]
        out.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, rng.integers(0, 20), np.uint64)])))
    return out


def classes(n, links, roots):
    parent = {r: r for r in roots}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[find(roots[i])] = find(roots[j])
    return [min(k for k in range(n) if find(roots[k]) == find(roots[i])) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_bucket_forest_joins_what_all_pairs_join(seed):
    sets = template_sets(seed)
    n = len(sets)
    roots = [i if i % 10 else 1 for i in range(n)]
    every = [(i, j) for i in range(n) for j in range(i) if similarity(sets[i], sets[j]) >= simhash.SIMILARITY]
    links = bucket_forest(sets, roots, [0] * n)
    assert set(links) <= set(every) and len(links) < n and classes(n, links, roots) == classes(n, every, roots)
    sides = [i % 2 for i in range(n)]
    assert classes(n, bucket_forest(sets, roots, sides), roots) == classes(n, [(i, j) for i, j in every if sides[i] != sides[j]], roots)
    assert bucket_forest([np.array([5], np.uint64)] * 3, [1, 2, 2], [0, 0, 0]) == [(1, 0)]


def test_buckets_in_parts_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    sets = template_sets(9)
    n = len(sets)
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, set binary")
    members = spark.createDataFrame([(7, i, i) for i in range(n)], "bucket long, id long, root long")
    links = [(r["a"], r["b"]) for r in simhash._bucket_links(members, table).collect()]
    every = [(i, j) for i in range(n) for j in range(i) if similarity(sets[i], sets[j]) >= simhash.SIMILARITY]
    assert classes(n, links, list(range(n))) == classes(n, every, list(range(n)))
