"""Language-model scores: Katz backoff over word pairs, single words and the unknown word.

Counting. A first pass counts the words of the training texts. A second one sends every pair (word before, word) of every text
to the bucket of its word, a chunk's equal pairs once, with the rows it stands in. A bucket thus has the counts of its words and
of all pairs ending in them. The most frequent words, 65 536 at most, are numbered on the driver and shared with all tasks; their
pairs are spread over all buckets, so that no frequent word is one bucket.

Model. Turing's estimate discounts counts up to five: ``d_r r`` for a count of r. One further count of every context is kept for
what was never seen after it, so that a context whose followers are all frequent can back off as well:

    P(w)     = d_c(w) c(w) / (N + 1),  the rest is the unknown word's
    P(w | u) = d_c(uw) c(uw) / (c(u) + 1)            where the pair was seen
             = alpha(u) P(w)                         where it was not, but u was
             = P(w)                                  where u was not seen either

``alpha(u)`` makes the probabilities of a context add up to one exactly; it needs the sum of P over all followers of u, which the
buckets add up in parts. Pairs, contexts and the parts of the scores are stored as tables, one folder each.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, store_packed

#: Keys of the start of a text and of its end; frequent words follow, all other words are hashes with the sign bit set.
START, END, FIRST = 0, 1, 2
#: So many of the most frequent words have numbers at most.
HOT = 1 << 16
#: Tokens in a chunk of texts and, on average, in a task's buckets together; buckets a task goes through one after the other;
#: bytes of a text that are cut into words at a time.
CHUNK, TASK, BUCKETS, SLICE = 1_000_000, 6_000_000, 12, 8 << 20
#: Counts up to this one are discounted.
COUNTS = 5
HELD_OUT, FOLDS = 0, 10

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What a packed piece of a chunk holds: arrays and their types.
PACKED = (
    ("base", "<i8"), ("w", "<i8"), ("u", "<i8"), ("links", "<u4"), ("doc", "<u4"), ("times", "<u4"), ("held", "u1"),
    ("row", "<i8"), ("doc_id", "<i8"), ("no_id", "u1"), ("out", "u1"), ("tokens", "<i8"),
)
#: Kinds of stored rows: texts, parts of their scores, parts of contexts, pairs, contexts that texts held out look up.
TEXT, PART, CONTEXT, PAIR, LOOKUP = range(5)
CLASSES = [f"m{r}" for r in range(1, COUNTS + 1)]
MERGED = ", ".join(["kind int", *[f"{c} long" for c in ("row", "doc_id", "u", "w", "c", "n", *CLASSES)], "base double", "s double"])


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The lower-case words of a text, in lists of bounded size; blanks are those of ASCII, and so are the letters lowered."""
    at = 0
    while len(data) - at > SLICE:
        found = _BLANK.search(data, at + SLICE)
        if not found:
            break
        yield data[at : found.start()].lower().split()
        at = found.end()
    yield data[at:].lower().split()


class Keys:
    """Words to keys, with a bounded cache of the words a task has met."""

    def __init__(self, hot: dict[int, int], limit: int = 300_000):
        self.hot, self.limit = hot, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for word in set(words).difference(known):
            key = (xxhash.xxh64_intdigest(word) | 1 << 63) - (1 << 64)
            known[word] = self.hot.get(key, key)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def mixed(keys: np.ndarray) -> np.ndarray:
    """Bits of 64-bit keys well spread, as unsigned numbers."""
    x = keys.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in byte planes, compressed: high bytes of small numbers cost nothing."""
    laid = [np.ascontiguousarray(arrays[name], kind) for name, kind in PACKED]
    body = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in laid)
    return np.array([len(a) for a in laid], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", len(PACKED)).tolist()
    kinds = [np.dtype(kind) for _, kind in PACKED]
    total = sum(n * kind.itemsize for n, kind in zip(sizes, kinds, strict=True))
    body = np.frombuffer(pa.decompress(blob[4 * len(PACKED) :], decompressed_size=total, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for (name, _), n, kind in zip(PACKED, sizes, kinds, strict=True):
        planes = body[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += n * kind.itemsize
    return out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    return np.flatnonzero(np.r_[True, change])


def regrouped(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the elements of ragged groups, group after group."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Chunk:
    """Texts, or parts of very long ones, whose pairs are grouped together."""

    rows: list[int]
    held: list[bool]
    before: list[int]
    keys: list[np.ndarray]
    size: int = 0

    def add(self, row: int, held: bool, before: int, keys: np.ndarray) -> None:
        self.rows.append(row)
        self.held.append(held)
        self.before.append(before)
        self.keys.append(keys)
        self.size += len(keys)

    def pieces(self, buckets: int, records: list[tuple]) -> Iterator[tuple[int, bytes]]:
        """The pairs of the chunk by bucket; the first piece also holds what is known of whole texts."""
        sizes = np.array([len(k) for k in self.keys], np.int64)
        w = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        u = np.r_[np.int64(START), w[:-1]] if len(w) else w
        u[first[sizes > 0]] = np.array(self.before, np.int64)[sizes > 0]
        base = min(self.rows, default=0)
        doc = np.repeat(np.array(self.rows, np.int64) - base, sizes)
        held = np.zeros(int(doc.max()) + 1 if len(doc) else 0, np.uint8)
        held[np.array(self.rows, np.int64)[sizes > 0] - base] = np.array(self.held, bool)[sizes > 0]

        own_w, at_w = np.unique(w, return_inverse=True)
        own_u, at_u = np.unique(u, return_inverse=True)
        order = np.argsort(at_w * max(1, len(own_u)) + at_u, kind="stable")
        at_w, at_u, doc = at_w[order], at_u[order], doc[order]
        link = starts_of(at_w, at_u, doc)
        times = np.diff(np.r_[link, len(doc)])
        at_w, at_u, doc = at_w[link], at_u[link], doc[link]
        pair = starts_of(at_w, at_u)
        links = np.diff(np.r_[pair, len(doc)])
        w, u = own_w[at_w[pair]], own_u[at_u[pair]]
        bucket = (mixed(np.where(w >= 0, w * 0x1000193 ^ u, w)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        into = regrouped(pair[order], links[order])
        bucket, w, u, links, doc, times = bucket[order], w[order], u[order], links[order], doc[into], times[into]

        none = {name: np.zeros(0, kind) for name, kind in PACKED}
        known = none | {"row": [r[0] for r in records], "doc_id": [r[1] or 0 for r in records], "no_id": [r[1] is None for r in records], "out": [r[2] for r in records], "tokens": [r[3] for r in records]}
        if records:
            yield int(records[0][0] % buckets), packed(known)
        cuts = starts_of(bucket)
        upto = np.r_[0, np.cumsum(links)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True) if len(cuts) else ():
            part = slice(upto[a], upto[b])
            yield int(bucket[a]), packed(none | {"base": [base], "w": w[a:b], "u": u[a:b], "links": links[a:b], "doc": doc[part], "times": times[part], "held": held})


def discounts(numbers: dict[int, int], top: int = COUNTS) -> np.ndarray:
    """Turing's discount of each count up to ``top`` (index 0 unused), from the numbers of counts: fewer counts, or none, are
    discounted where the numbers do not allow it."""
    out = np.ones(top + 1)
    for k in range(top, 1, -1):
        n = [numbers.get(r, 0) for r in range(1, k + 2)]
        if min(n) == 0 or (k + 1) * n[k] >= n[0]:
            continue
        beyond = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - beyond) / (1 - beyond) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            out[1 : k + 1] = d
            return out
    return out


@dataclass
class Words:
    """Totals of the training tokens, discounts of their counts, and the frequent words."""

    tokens: int
    distinct: int
    texts: int
    discount: np.ndarray
    rest: float
    hot: dict[int, int]
    hot_counts: np.ndarray

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P of words with these counts; 0 stands for the unknown word."""
        known = np.where(counts <= COUNTS, self.discount[np.minimum(counts, COUNTS)], 1.0) * counts / (self.tokens + 1)
        return np.where(counts > 0, known, self.rest)


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    held = F.crc32(F.coalesce(docs[doc_id].cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), held.alias("held"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("data"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = Keys({})
    waiting: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        w, c = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]), return_counts=True)
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int64))], names=["w", "c"])

    for batch in batches:
        for held, data in zip(batch.column("held").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if held:
                continue
            waiting.append(np.array([END], np.int64))
            for words in words_of(data):
                waiting.append(keys(words))
                size += len(words)
                if size >= CHUNK:
                    yield counted()
                    size = 0
    yield counted()


def count_words(inputs: DataFrame) -> tuple[DataFrame, Words]:
    """The stored table ``w, c`` of the training words, and what all tasks need to know of it."""
    words = store_packed(inputs.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    facts = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("w") == END, F.col("c")))).first()
    tokens, distinct, texts = (int(x or 0) for x in facts)
    numbers = {r["c"]: r["count"] for r in words.filter(F.col("c") <= COUNTS + 1).groupBy("c").count().collect()}
    # The words of the highest counts, down to the count from which they would be too many.
    size = F.floor(8 * F.log2("c")).cast("int")
    least, total = None, 0
    for r in sorted(words.filter(F.col("w") != END).groupBy(size.alias("size")).count().collect(), reverse=True):
        total += r["count"]
        if total > HOT:
            break
        least = r["size"]
    frequent = [] if least is None else words.filter((F.col("w") != END) & (size >= least)).collect()
    frequent.sort(key=lambda r: (-r["c"], r["w"]))
    discount = discounts(numbers)
    rest = (1 + sum((1 - discount[r]) * r * numbers.get(r, 0) for r in range(1, COUNTS + 1))) / (tokens + 1)
    hot = {r["w"]: FIRST + i for i, r in enumerate(frequent)}
    return words, Words(tokens, distinct, texts, discount, rest, hot, np.array([0, texts, *[r["c"] for r in frequent]], np.int64))


def _send(hot: dict[int, int], tasks: int):
    """Chunks of texts to packed pieces by task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(hot)
        row = TaskContext.get().partitionId() << 33
        chunk, records = Chunk([], [], [], []), []

        def flushed() -> Iterator[pa.RecordBatch]:
            found = list(chunk.pieces(tasks * BUCKETS, records))
            if found:
                numbers = np.array([b for b, _ in found], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(numbers % tasks), pa.array(numbers // tasks), pa.array([p for _, p in found], pa.binary())], names=["task", "bucket", "piece"])

        for batch in batches:
            for doc, held, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "data")), strict=True):
                before, tokens = START, 1
                for words in words_of(data):
                    part = keys(words)
                    chunk.add(row, held, before, part)
                    before = int(part[-1]) if len(part) else before
                    tokens += len(part)
                    if chunk.size >= CHUNK:
                        yield from flushed()
                        chunk, records = Chunk([], [], [], []), []
                chunk.add(row, held, before, np.array([END], np.int64))
                records.append((row, doc, held, tokens))
                row += 1
        yield from flushed()

    return run


def merged(pieces: list[dict[str, np.ndarray]], words: Words) -> list[dict]:
    """Counts of the pairs of a bucket, its parts of contexts and of the texts' scores: columns by kind of row."""
    w, u, links = (np.concatenate([p[c] for p in pieces]) for c in ("w", "u", "links"))
    rows = np.concatenate([p["base"][0] + p["doc"].astype(np.int64) if len(p["base"]) else np.zeros(0, np.int64) for p in pieces])
    times = np.concatenate([p["times"] for p in pieces]).astype(np.int64)
    held = np.concatenate([p["held"][p["doc"]] for p in pieces]).astype(bool)
    order = np.lexsort((u, w))
    at = starts_of(w[order], u[order])
    pair = np.zeros(len(w), np.int64)
    new = np.zeros(len(w), np.int64)
    new[at] = 1
    pair[order] = np.cumsum(new) - 1
    w, u = w[order][at], u[order][at]
    link = np.repeat(pair, links)
    count = np.bincount(link, times * ~held, len(w)).astype(np.int64)
    first = starts_of(w)
    own = np.repeat(np.add.reduceat(count, first), np.diff(np.r_[first, len(w)])) if len(w) else count
    of_word = np.where(w >= 0, words.hot_counts[np.where(w >= 0, w, 0)], own)
    p = words.probability(of_word)

    seen = count > 0
    contexts, of = np.unique(u[seen], return_inverse=True)
    c = count[seen]
    parts = {"kind": CONTEXT, "u": contexts, "c": np.bincount(of, c, len(contexts)).astype(np.int64), "s": np.bincount(of, p[seen], len(contexts))}
    parts |= {m: np.bincount(of[c == r], minlength=len(contexts)) for r, m in enumerate(CLASSES, 1)}

    with np.errstate(divide="ignore"):
        log = np.where(seen, np.log10(np.maximum(count, 1)), np.log10(p))
    own_base, follows = np.log10(of_word + 0.1), np.where(w == END, 0.0, np.log10(of_word + 1.0))
    texts, at = np.unique(rows, return_inverse=True)
    n = len(texts)
    score = times * (log[link] - np.where(held, 0.0, follows[link]))
    scores = {"kind": PART, "row": texts, "n": np.bincount(at, times * (of_word[link] > 0), n).astype(np.int64), "base": np.bincount(at, times * own_base[link], n), "s": np.bincount(at, score, n)}
    scores |= {m: np.bincount(at, times * (count[link] == r), n).astype(np.int64) for r, m in enumerate(CLASSES, 1)}

    asked, of_row, t = u[link[held]], rows[held], times[held]
    hit = seen[link[held]]
    order = np.lexsort((asked, of_row))
    at = starts_of(of_row[order], asked[order])
    sums = [np.add.reduceat((t * x)[order], at) if len(at) else np.zeros(0, np.int64) for x in (hit, ~hit)]
    lookups = {"kind": LOOKUP, "row": of_row[order][at], "u": asked[order][at], "c": sums[0], "n": sums[1]}
    pairs = {"kind": PAIR, "u": u[seen], "w": w[seen], "c": c}
    known = {name: np.concatenate([p[name] for p in pieces]) for name in ("row", "doc_id", "no_id", "out", "tokens")}
    whole = {"kind": TEXT, "row": known["row"], "doc_id": pa.array(known["doc_id"], mask=known["no_id"].astype(bool)), "c": known["out"].astype(np.int64), "n": known["tokens"]}
    return [whole, scores, parts, pairs, lookups]


#: What adds up across the buckets of a task: by what, and which columns.
ADDED = {PART: (("row",), ("n", "base", "s", *CLASSES)), CONTEXT: (("u",), ("c", "s", *CLASSES)), LOOKUP: (("row", "u"), ("c", "n"))}


def added(found: list[dict]) -> dict:
    """Columns of one kind, rows with equal keys added up."""
    keys, sums = ADDED[found[0]["kind"]]
    whole = {c: np.concatenate([f[c] for f in found]) for c in (*keys, *sums)}
    order = np.lexsort([whole[k] for k in reversed(keys)])
    at = starts_of(*[whole[k][order] for k in keys])
    out = {"kind": found[0]["kind"]} | {k: whole[k][order][at] for k in keys}
    return out | {c: np.add.reduceat(whole[c][order], at) if len(at) else whole[c] for c in sums}


def _merge(words: Words):
    shape = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in MERGED.split(", ")])

    def records(columns: dict) -> Iterator[pa.RecordBatch]:
        n = len(columns["row"] if "row" in columns else columns["u"])
        columns = columns | {"kind": np.full(n, columns["kind"], np.int32)}
        whole = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)
        for at in range(0, n, 20_000):
            yield whole.slice(at, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for bucket, piece in zip(batch.column("bucket").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                pieces[bucket].append(piece)
        sums: dict[int, list[dict]] = {kind: [] for kind in ADDED}
        for bucket in sorted(pieces):
            for columns in merged([unpacked(b) for b in pieces.pop(bucket)], words):
                if columns["kind"] in sums:
                    # Two at most wait, so that a task holds little more than the sums themselves.
                    waiting = sums[columns["kind"]]
                    waiting[:] = [added([*waiting, columns])]
                else:
                    yield from records(columns)
        for waiting in sums.values():
            for columns in waiting:
                yield from records(columns)

    return run


@dataclass
class Model:
    """The stored tables of the model: words ``w, c``, pairs ``u, w, c``, contexts ``u, total, alpha``; discounts of pairs."""

    words: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    totals: Words
    discount: np.ndarray


def fit_and_collect(docs: DataFrame, doc_id: str, text: str) -> tuple[Model, DataFrame]:
    """The model of the texts not held out, and the stored parts of the scores of all texts."""
    prepare(docs.sparkSession)
    inputs = _inputs(docs, doc_id, text)
    words, totals = count_words(inputs)
    tasks = 1 + totals.tokens // TASK
    sent = inputs.mapInArrow(_send(totals.hot, tasks), "task int, bucket int, piece binary").repartitionById(tasks, "task")
    parts = store_packed(sent.mapInArrow(_merge(totals), MERGED), by=["kind"])
    pairs = parts.filter(F.col("kind") == PAIR).select("u", "w", "c")
    numbers = {r["c"]: r["count"] for r in pairs.filter(F.col("c") <= COUNTS + 1).groupBy("c").count().collect()}
    discount = discounts(numbers)
    sums = parts.filter(F.col("kind") == CONTEXT).groupBy("u").agg(F.sum("c").alias("total"), F.sum("s").alias("likely"), *[F.sum(m).alias(m) for m in CLASSES])
    kept_back = sum((F.col(m) * float((1 - discount[r]) * r) for r, m in enumerate(CLASSES, 1)), F.lit(1.0))
    alpha = kept_back / (F.col("total") + 1) / (1 - F.col("likely"))
    contexts = store_packed(sums.select("u", "total", alpha.alias("alpha")))
    return Model(words, pairs, contexts, totals, discount), parts


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from rows whose CRC of the id is no multiple of ten; a row without id is held out. A null text is empty
    and has the end token alone. Repeated rows are learned from and scored each. Words are told apart by 63 bits of their hash.
    A text of any length is taken in slices. Where no text is left to learn from, every token has probability one. An empty
    table gives no rows. Other columns are not read.
    """
    model, parts = fit_and_collect(docs, doc_id, text)
    totals = model.totals
    of = {k: parts.filter(F.col("kind") == k) for k in (TEXT, PART, LOOKUP)}
    frequent = F.col("u") >= 0
    # Frequent contexts number at most HOT and the start; all others meet by a shuffle in which none is large.
    met = of[LOOKUP].filter(frequent).join(F.broadcast(model.contexts.filter(frequent)), "u", "left").unionByName(of[LOOKUP].filter(~frequent).join(model.contexts.filter(~frequent), "u", "left"))
    backed = F.when(F.col("total").isNotNull(), F.col("n") * F.log10("alpha") - F.col("c") * F.log10(F.col("total") + 1.0)).otherwise(0.0)
    zero = F.lit(0).cast("long")

    def row(source: DataFrame, **columns: Column) -> DataFrame:
        names = {"doc_id": F.lit(None).cast("long"), "held": zero, "tokens": zero, "n": zero, "base": F.lit(0.0), "s": F.lit(0.0)} | {m: zero for m in CLASSES} | columns
        return source.select("row", *[c.alias(name) for name, c in names.items()])

    rows = row(of[TEXT], doc_id=F.col("doc_id"), held=F.col("c"), tokens=F.col("n"))
    rows = rows.unionByName(row(of[PART], n=F.col("n"), base=F.col("base"), s=F.col("s"), **{m: F.col(m) for m in CLASSES})).unionByName(row(met, s=backed))
    sums = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("held", "tokens", "n", "base", "s", *CLASSES)])
    discounted = sum((F.col(m) * math.log10(model.discount[r]) for r, m in enumerate(CLASSES, 1)), F.col("s"))
    held = F.col("held") > 0
    return sums.select(
        "doc_id", held.alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("n").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * math.log10(totals.tokens + 0.1 * (totals.distinct + 1))).alias("base_score"),
        (discounted - F.when(held, 0.0).otherwise(math.log10(totals.texts + 1))).alias("score"),
    )
