"""SimHash fingerprints and near-duplicate groups found with vantage-point trees over Hamming space.

A tree is built from a bounded sample of fingerprints. Each inner node has a vantage point and a radius: what lies within the
radius belongs to the left, the rest to the right. Every fingerprint is a member of exactly one leaf (a shard). Two
fingerprints within ``bits`` of each other differ by at most ``bits`` in their distance to any vantage point (triangle
bound), so a fingerprint near a boundary is sent as a query also to the shards beyond it, and to no others. Each close pair
then meets in exactly one shard as member and member or member and query; the shard reports links that join what is close
(a spanning forest, so a large group of near copies costs its size, not its square).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text import prepare, store

#: Fingerprints per shard: a 256th of all, within these bounds.
SHARD_ROWS = (128, 8192)
#: Sampled fingerprints per shard for choosing vantage points and radii; at most SAMPLE_ROWS per tree are taken to the driver.
SAMPLE_PER_SHARD, SAMPLE_ROWS = 32, 1 << 19
#: Words per shingle of a fingerprint.
SHINGLE = 3
#: Shingles whose bits are counted at a time, which bounds the memory for a long text.
CHUNK = 1 << 15


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def _majority(counts: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``size`` words joined by a space; a shorter sequence is one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(0, len(words) - size)
    pairs = zip(starts[: last + 1].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in pairs], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in lower case (A-Z only); bytes split at the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    return _majority(_bits(hashes), len(hashes))


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from each hash (the finaliser of a splittable generator)."""
    h = hashes + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row: a bit is set if it is set in over half of the shingles' hashes.

    A null text has no words; no words give the fingerprint zero. Repeated shingles count each time; texts are hashed whole.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([_signed(shingle_fingerprint(words_of(t), shingle)) for t in batch], dtype="int64")

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.coalesce(F.col(text), F.lit(""))).alias("fp"))


# --- vantage-point trees -------------------------------------------------------------------------------------------------


@dataclass
class VantageTree:
    """Inner nodes as parallel lists; a child below zero is a leaf with the number -1 - child."""

    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: int = 0
    root: int = -1


def distance(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other)


def build_tree(sample: np.ndarray, depth: int, bits: int, smallest: int = 8) -> VantageTree:
    """A tree of at most ``depth`` levels. Of a few vantage points the one with the least crowded boundary is used."""
    tree = VantageTree()

    def grow(points: np.ndarray, levels: int) -> int:
        best = None
        if levels and len(points) >= 2 * smallest:
            for vantage in points[:4]:
                apart = distance(points, vantage)
                radius = int(np.median(apart))
                if (apart <= radius).all():
                    radius -= 1
                inside = int((apart <= radius).sum())
                if 0 < inside < len(points):
                    crowd = int(((apart > radius - bits) & (apart <= radius + bits)).sum()) + abs(2 * inside - len(points))
                    best = min(best or (crowd, int(vantage), radius), (crowd, int(vantage), radius))
        if best is None:
            tree.leaves += 1
            return -tree.leaves
        _, vantage, radius = best
        at = len(tree.vantage)
        for column, value in ((tree.vantage, vantage), (tree.radius, radius), (tree.left, 0), (tree.right, 0)):
            column.append(value)
        near = distance(points, np.uint64(vantage)) <= radius
        tree.left[at] = grow(points[near], levels - 1)
        tree.right[at] = grow(points[~near], levels - 1)
        return at

    tree.root = grow(sample, depth)
    return tree


def route(tree: VantageTree, points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaf, positions and membership of everything that has to be in that leaf."""
    stack = [(tree.root, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, member = stack.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at, member
            continue
        apart = distance(points[at], np.uint64(tree.vantage[node])).astype(np.int64)
        radius = tree.radius[node]
        inside = apart <= radius
        # A member stays on its side and asks across the boundary in one direction only; a query asks on both.
        to_left = inside | (~member & (apart <= radius + bits))
        to_right = ~inside | (apart > radius - bits)
        stack.append((tree.left[node], at[to_left], member[to_left]))
        stack.append((tree.right[node], at[to_right], (member & ~inside)[to_right]))


def linked(points: np.ndarray, member: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all members and queries that are close, breadth first from members.

    What has been reached is not compared again, so a dense group takes few passes.
    Queries meet members only; two queries meet in the shard in which one of them is a member.
    """
    links: list[tuple[int, int]] = []
    left = np.flatnonzero(member)
    asking = np.flatnonzero(~member)
    while len(left):
        frontier = [int(left[0])]
        left = left[1:]
        while frontier:
            one = frontier.pop()
            pools = [left, asking] if member[one] else [left]
            rest = []
            for pool in pools:
                near = distance(points[pool], points[one]) <= bits
                if near.any():
                    hits = pool[near].tolist()
                    links += [(one, h) for h in hits]
                    frontier += hits
                    pool = pool[~near]
                rest.append(pool)
            left = rest[0]
            if member[one]:
                asking = rest[1]
    return links


def near_links(points: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` between ids that join all ids with close fingerprints.

    ``points`` has ``tree`` (int), ``id`` and ``fp`` (long). Fingerprints of different trees are never compared. The number of
    shards follows the number of points; the driver sees a sample for the trees, nothing else.
    """
    spark = points.sparkSession
    counts = {r["tree"]: r["n"] for r in points.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    trees: dict[int, VantageTree] = {}
    if counts:
        largest = max(counts.values())
        shard = min(max(largest // 256, SHARD_ROWS[0]), SHARD_ROWS[1])
        depth = max(0, int(np.ceil(np.log2(largest / shard))))
        wanted = min(SAMPLE_ROWS, SAMPLE_PER_SHARD << depth)
        spread = 1 << 40
        cut = max(1, min(spread, int(spread * 1.1 * wanted / largest)))
        picked = points.filter(F.pmod(F.xxhash64("id", "tree", F.lit("sample")), F.lit(spread)) < cut)
        sample = picked.select("tree", "fp").limit(2 * wanted * len(counts)).toPandas()
        for tree in counts:
            own = np.sort(sample.loc[sample["tree"] == tree, "fp"].to_numpy(np.int64).view(np.uint64))
            trees[tree] = build_tree(np.random.default_rng(tree).permutation(own), depth, bits)
    shared = spark.sparkContext.broadcast(trees)
    columns = ["id", "fp"]
    schema = "shard long, member boolean, " + ", ".join(f"{c} long" for c in columns)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree, group in batch.groupby("tree"):
                values = {c: group[c].to_numpy(np.int64) for c in columns}
                for leaf, at, member in route(shared.value[int(tree)], values["fp"].view(np.uint64), bits):
                    out.append(pd.DataFrame({"shard": (int(tree) << 32) | leaf, "member": member} | {c: v[at] for c, v in values.items()}))
            if out:
                yield pd.concat(out, ignore_index=True)

    def in_shard(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy(np.int64)
        points = group["fp"].to_numpy(np.int64).view(np.uint64)
        links = linked(points, group["member"].to_numpy(bool), bits)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return points.select("tree", *columns).mapInPandas(routed, schema).groupBy("shard").applyInPandas(in_shard, "a long, b long")


# --- the operator --------------------------------------------------------------------------------------------------------


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest ``doc_id`` reachable over fingerprints that differ in at most
    ``bits`` bits.

    Equal fingerprints (exact copies among them) become one point before anything is compared, so a group of copies of any
    size costs one point. Texts without words have the fingerprint zero and are linked by it like others. Null ids take part
    but are never the smallest, unless a class has no other. Every row is returned, repeated ones too; an empty table gives no
    rows. Other columns are not read.
    """
    own = store(fingerprints(docs, doc_id, text, shingle))
    distinct = store(own.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    links = store(near_links(distinct.select(F.lit(0).alias("tree"), F.col("fp").alias("id"), "fp"), bits))
    joined = components(links).join(distinct, F.col("node") == F.col("fp")).select("node", "root", "_first")
    smallest = joined.groupBy("root").agg(F.min("_first").alias("_least"))
    moved = joined.join(smallest, "root").select(F.col("node").alias("fp"), "_least")
    classes = store(distinct.join(moved, "fp", "left").select("fp", F.coalesce("_least", "_first").alias("component_id")))
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Settings of near-copy removal: words per shingle and the least similarity of a pair. Each document has BANDS keys of BAND_ROWS
#: minimum hashes. A pair of similarity s shares a key with probability 1 - (1 - s^5)^18 whatever the edit looks like: 99.92 % at
#: 0.8. A pair whose sketches differ in more than FAR_BITS of 128 is not looked at: a similarity of 0.8 differs in 19.4 on average
#: with a deviation of 4.1, so one such pair in 30 000 is lost there.
CHECK_SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 18, 5
FAR_BITS = 36
#: Members of a bucket that meet in one task when all its pairs have to be compared; rounds with other leaders before that.
BUCKET_ROWS, BUCKET_BYTES, LEADER_ROUNDS = 1024, 1 << 25, 1
#: Shingles whose minimum hashes are worked out at a time.
MIN_CHUNK = 1 << 12

_RANDOM = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * BAND_ROWS, 1), np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes: equal for two sets if the minima of all hash functions of a band are equal."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), MIN_CHUNK):
        least = np.minimum(least, ((shingles[at : at + MIN_CHUNK] ^ _RANDOM[0]) * (_RANDOM[1] | np.uint64(1))).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def _shingle_set(words: list[bytes]) -> np.ndarray:
    return np.unique(shingle_hashes(words, CHECK_SHINGLE)) if words else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words))) if words else 0


def near_copy_vectors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``id`` (a digest of the words), ``fp`` (the fingerprint), ``s1, s2`` (a shingle sketch) and ``bands`` of every row; no
    words, no bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, sketches, bands = [], [], [], []
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                hashes = shingle_hashes(words, CHECK_SHINGLE) if words else np.zeros(0, np.uint64)
                ids.append(_key(words))
                prints.append(_signed(shingle_fingerprint(words, SHINGLE)))
                sketches.append([_signed(_majority(_bits(h), len(h))) for h in (hashes, _mixed(hashes, 1))])
                bands.append(band_keys(np.unique(hashes)).view(np.int64).tolist() if words else [])
            sketch = np.array(sketches, np.int64).reshape(-1, 2).T
            columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), *map(pa.array, sketch), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "fp", "s1", "s2", "bands"])

    schema = "doc_id long, id long, fp long, s1 long, s2 long, bands array<bigint>"
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``id, set`` (sorted shingle hashes as bytes) of the texts whose ``id`` is in ``wanted``, once each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_key(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0)], names=["id", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "set"])

    texts = docs.select(docs[text].alias("text")).mapInArrow(keyed, "id long, text string").join(wanted, "id", "left_semi")
    return texts.dropDuplicates(["id"]).mapInArrow(sets, "id long, set binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose shingle sets are similar by SIMILARITY or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            good = pa.array([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    with_x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return with_x.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s1", "s2")), F.lit(0)) <= FAR_BITS


def bucket_forest(sets: list[np.ndarray], roots: list[int], sides: list[int]) -> list[tuple[int, int]]:
    """Pairs of similarity SIMILARITY or more that join all such pairs of different ``roots``; with two ``sides``, pairs across them.

    A pair that similar has a shingle in common among the rarest fifth of either set (in one order of all shingles, the rarest of the bucket
    first), so only members that share one of these are compared: texts of one template are not, where their own words differ.
    """
    shingles, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(shingles), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(shingles))
    ranks = np.split(order[at], np.cumsum([len(s) for s in sets])[:-1])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    across = len(set(sides)) > 1
    holders: dict[int, list[int]] = {}
    links = []
    held_here = np.zeros(len(shingles), bool)
    for i, own in enumerate(ranks):
        held_here[own] = True
        least = math.ceil(SIMILARITY * len(own) - 1e-9)
        rare = np.partition(own, len(own) - least)[: len(own) - least + 1] if least else own
        asked: set[int] = set()
        for rank in rare.tolist():
            held = holders.setdefault(rank, [])
            for j in held:
                if j not in asked and not (across and sides[i] == sides[j]):
                    asked.add(j)
                    x, y = find(roots[i]), find(roots[j])
                    if x != y and least <= len(ranks[j]) <= len(own) / SIMILARITY + 1e-6:
                        both = int(np.count_nonzero(held_here[ranks[j]]))
                        if both / (len(own) + len(ranks[j]) - both) >= SIMILARITY:
                            parent[x] = y
                            links.append((i, j))
            held.append(i)
        held_here[own] = False
    return links


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """All pairs ``a, b`` of a bucket that no link joins so far, listed one by one: what ``_bucket_links``, which the pipeline runs, need not
    do. ``members`` has bucket, n, p (id and sketch) and root.

    A bucket is cut into parts of some BUCKET_ROWS members, and two parts at a time meet under one key.
    """
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    own = F.pmod(F.xxhash64("p.id", F.lit("part")), parts).cast("int")
    left = members.select("bucket", own.alias("i"), every.alias("j"), F.col("p").alias("x"), F.col("root").alias("_x"))
    right = members.select("bucket", every.alias("i"), own.alias("j"), F.col("p").alias("y"), F.col("root").alias("_y"))
    met = left.join(right, (left["bucket"] == right["bucket"]) & (left["i"] == right["i"]) & (left["j"] == right["j"]) & (F.col("x.id") < F.col("y.id")) & (F.col("_x") != F.col("_y")) & _near("x", "y"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _bucket_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all similar pairs of a bucket that are not joined so far. ``members`` has bucket, id and root.

    A bucket is cut into parts of some BUCKET_ROWS members and BUCKET_BYTES of shingle sets, and two parts at a time meet in one task.
    A task reports a spanning forest, so what it returns grows with its members, not with their pairs.
    """
    sized = members.join(sets.select("id", F.length("set").alias("_bytes")), "id")
    parts = sized.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BUCKET_ROWS, F.sum("_bytes") / BUCKET_BYTES)).cast("int").alias("_parts"))
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.col("_parts")).cast("int")
    dealt = members.join(parts, "bucket").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "root")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].tolist()
        if len(set(group["root"])) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = bucket_forest([np.frombuffer(s, np.uint64) for s in group["set"]], group["root"].tolist(), group["side"].tolist())
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    return dealt.join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(meet, "a long, b long").distinct()


def near_copy_links(docs: DataFrame, text: str, distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` of similarity SIMILARITY or more that join all such pairs that share a band key.

    Each bucket first compares its members with one leader, which settles most buckets and a large group of copies at once.
    Where members stay apart, those of a bucket meet in a task, in a large bucket after one further leader. No link goes unverified.
    """
    points = distinct.select(F.struct("id", "s1", "s2").alias("p"), F.explode("bands").alias("bucket"))
    buckets = points.groupBy("bucket").agg(F.count("*").alias("n"), F.min("p").alias("lead")).filter(F.col("n") > 1)
    met = store(points.join(buckets, "bucket"))
    sets = store(_shingle_sets(docs, text, met.select("p.id").distinct()))
    links = store(_similar(met.filter((F.col("p.id") != F.col("lead.id")) & _near("p", "lead")).select(F.col("lead.id").alias("a"), F.col("p.id").alias("b")).distinct(), sets))
    for turn in range(1, LEADER_ROUNDS + 2):
        roots = components(links).select(F.col("node").alias("_node"), "root")
        rooted = met.filter(F.col("n") > 2).join(roots, F.col("p.id") == F.col("_node"), "left").select("bucket", "n", "p", F.coalesce("root", "p.id").alias("root"))
        rooted = store(rooted)
        lead = F.min_by(F.struct("p", "root"), F.xxhash64("p.id", F.lit(turn))).alias("lead")
        mixed = store(rooted.groupBy("bucket").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), lead, F.max("n").alias("_n")).filter(F.col("_least") != F.col("_most")).select("bucket", "lead", "_n"))
        rows, largest = mixed.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).first()
        if not rows:
            break
        apart = rooted.join(mixed, "bucket")
        if turn > LEADER_ROUNDS or largest <= BUCKET_ROWS:
            return links.unionAll(store(_bucket_links(apart.select("bucket", F.col("p.id").alias("id"), "root"), sets)))
        asked = apart.filter(F.col("root") != F.col("lead.root")).select("p", F.col("lead.p").alias("lead")).filter(_near("p", "lead"))
        links = store(links.unionAll(_similar(asked.select(F.col("lead.id").alias("a"), F.col("p.id").alias("b")).distinct(), sets)))
    return links


def fingerprint_links(distinct: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` that join all ids of ``distinct`` (``id, fp``) whose fingerprints differ in at most ``bits`` bits, found in the
    vantage-point trees; equal fingerprints are one point."""
    points = store(distinct.groupBy("fp").agg(F.min("id").alias("_one")))
    close = store(near_links(points.select(F.lit(0).alias("tree"), F.col("fp").alias("id"), "fp"), bits))
    prepare(distinct.sparkSession)
    ends = [points.select(F.col("fp").alias(f"_{c}"), F.col("_one").alias(c)) for c in "ab"]
    apart = close.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(ends[0], "_a").join(ends[1], "_b").select("a", "b")
    equal = distinct.select("fp", F.col("id").alias("b")).join(points, "fp").filter(F.col("b") != F.col("_one")).select(F.col("_one").alias("a"), "b")
    return apart.unionAll(equal)


def near_copy_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """``doc_id, component_id``: groups of exact and near copies, linked by pairs whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more and, with ``bits``, by fingerprints that differ in at most so many bits. Texts with the same words are one
    point; rows that share a ``doc_id`` are of one group."""
    own = store(near_copy_vectors(docs, doc_id, text))
    distinct = store(own.groupBy("id").agg(F.min("doc_id").alias("_first"), *[F.first(c).alias(c) for c in ("fp", "s1", "s2", "bands")]))
    shared = distinct.filter(F.col("_first").isNotNull()).groupBy("_first").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.collect_set("id").alias("_all"))
    shared = shared.filter(F.col("a") != F.col("b")).select("a", F.explode("_all").alias("b"))
    if bits is not None:
        shared = shared.unionAll(fingerprint_links(distinct.select("id", "fp"), bits))
    roots = components(store(near_copy_links(docs, text, distinct).unionAll(shared)))
    smallest = roots.join(distinct.select(F.col("id").alias("node"), "_first"), "node")
    least = smallest.groupBy("root").agg(F.min("_first").alias("_least"))
    moved = smallest.join(least, "root").select(F.col("node").alias("id"), "_least")
    classes = store(distinct.join(moved, "id", "left").select("id", F.coalesce("_least", "_first").alias("component_id")))
    return own.join(classes, "id").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` less all but the smallest ``doc_id`` of each group of exact and near copies (see ``near_copy_classes``).

    Rows that share a ``doc_id`` are one document and stay or go together; rows without one stay.
    """
    classes = near_copy_classes(docs, doc_id, text, bits)
    gone = store(classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
