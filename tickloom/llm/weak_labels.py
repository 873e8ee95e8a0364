"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on every document. Expectation maximisation estimates how often each is right
and how common good documents are, from the numbers of documents per combination of votes: there are at most 2^L of them, so
the estimate is exact over all documents however many there are. The posterior of its combination labels each document, and a
linear scorer over hashed words and word forms is trained on these labels, so that it also judges documents on which no
labeller votes. Texts are read once: the votes and the counted features of all of them are stored, and the scorer reads these.

What labellers and scorer look at are sums over words. A worker works out the facts of a word once (its lexicon) and adds them
up for all documents of a batch together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, store_packed

#: Hashed features; documents that train the scorer (a sample by hash of the id, of about this size); gradient steps.
FEATURES = 1 << 14
TRAIN_ROWS = 20_000
STEPS, RATE, PENALTY = 60, 2.0, 1e-4
#: Rounds of expectation maximisation; documents that the rates assumed at first count for; a document is kept from this score on.
ROUNDS, PRIOR, KEEP = 500, 1.0, 0.5
#: Words a lexicon holds before it starts anew; words and texts that are worked on together.
WORDS, TOGETHER, ROWS = 500_000, 200_000, 128

#: Labeller names with the range of their statistic in which they vote, and the vote: 1 bad, 2 good.
LABELLERS = (
    ("symbols", 0.08, math.inf, 1),
    ("repeats", 0.30, 1.0, 1),
    ("shouting", 0.60, 1.0, 1),
    ("long_words", 14.0, math.inf, 1),
    ("bars", 0.10, 1.0, 1),
    ("sameness", 0.30, 1.0, 1),
    ("plain_words", 0.70, 1.0, 2),
    ("sentences", 0.02, 0.30, 2),
)
SYMBOLS = "#*$%&<>!^~{}[]"
#: Facts of a word: length, letters, capitals, symbols, and whether it is a bar, a plain word or ends a part of a sentence.
CHARS, LETTERS, UPPER, SYMBOL, BAR, PLAIN, ENDS = range(7)


def _number(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % FEATURES


#: Whether a word repeats the one before it is a feature of its own.
REPEATED = (_number("r0"), _number("r1"))


def facts_of(word: str) -> tuple[int, ...]:
    """Letters of most words are all there is to them, which saves looking at each character."""
    if word.isalpha():
        upper = 0 if word.islower() else len(word) if word.isupper() else sum(map(str.isupper, word))
        return len(word), len(word), upper, 0, 0, not word[1:].isupper(), 0
    return (
        len(word), sum(map(str.isalpha, word)), sum(map(str.isupper, word)), sum(map(word.count, SYMBOLS)), word == "|",
        word.strip(".,;:").isalpha() and not word[1:].isupper(), word[-1] in ".,;:",
    )


@lru_cache(maxsize=4096)
def _form(upper: bool, length: int, tail: str) -> tuple[int, int]:
    return _number(f"t{tail}"), _number(f"c{upper:d}{length}")


def features_of(word: str) -> tuple[int, int, int]:
    """The word itself, what of its last characters is no letter or digit, and its form."""
    tail = "" if word.isalnum() else "".join(c for c in word[-4:] if not c.isalnum())
    return _number(f"w{word.lower()}"), *_form(word.isupper(), min(len(word), 15), tail)


class Lexicon:
    """The facts and features of words, each worked out once."""

    def __init__(self, limit: int = WORDS):
        self.limit = limit
        self.known: dict[str, int] = {}
        self.facts = np.zeros((1024, 7), np.int64)
        self.features = np.zeros((1024, 3), np.int64)

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        missing = list(set(words).difference(known))
        if missing:
            at = len(known)
            upto = at + len(missing)
            while upto > len(self.facts):
                self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
                self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            known.update(zip(missing, range(at, upto), strict=True))
            self.facts[at:upto] = list(map(facts_of, missing))
            self.features[at:upto] = list(map(features_of, missing))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    """A worker keeps its lexicon from task to task."""
    return Lexicon()


class Texts:
    """Texts as word codes, one after the other. Texts without words have neither votes nor features."""

    def __init__(self, texts: list[str], words: Lexicon):
        split = [t.split() for t in texts]
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.lexicon = words
        self.codes = words.codes(list(chain.from_iterable(split)))
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.same = np.zeros(len(self.codes), bool)
        self.same[1:] = (self.codes[1:] == self.codes[:-1]) & (self.owner[1:] == self.owner[:-1])

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, len(self.sizes))

    def statistics(self) -> np.ndarray:
        """What the labellers look at, in their order, by text."""
        facts = [self._sum(self.lexicon.facts[self.codes, i]) for i in range(7)]
        n = np.maximum(self.sizes, 1)
        grams = np.maximum(self.sizes - 2, 0)
        whole = np.flatnonzero(self.owner[2:] == self.owner[:-2]) if len(self.owner) > 2 else np.zeros(0, np.int64)
        # A lexicon and the words of a batch are less than 2^21 codes, so three of them fit one number, and mostly the text besides.
        bits = int(self.codes.max(initial=0)).bit_length()
        of, key = self.owner[whole], self.codes[whole] << 2 * bits | self.codes[whole + 1] << bits | self.codes[whole + 2]
        if len(self.sizes).bit_length() + 3 * bits < 64:
            key = np.sort(of << 3 * bits | key)
            of = key >> 3 * bits
        else:
            order = np.lexsort((key, of))
            of, key = of[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        distinct = np.bincount(of[new], minlength=len(self.sizes))
        with np.errstate(invalid="ignore", divide="ignore"):
            again = np.where(grams > 0, 1 - distinct / np.maximum(grams, 1), 0.0)
            out = np.stack(
                [
                    facts[SYMBOL] / facts[CHARS], again, facts[UPPER] / np.maximum(facts[LETTERS], 1), facts[CHARS] / n, facts[BAR] / n,
                    self._sum(self.same) / n, facts[PLAIN] / n, facts[ENDS] / n,
                ],
                axis=1,
            )
        out[self.sizes == 0] = np.nan
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and how often: words, word endings that are no letters, word forms and repetitions."""
        columns = [*self.lexicon.features[self.codes].T, np.where(self.same, REPEATED[1], REPEATED[0])]
        keys, n = np.unique(np.concatenate([self.owner * FEATURES + numbers for numbers in columns]), return_counts=True)
        return keys // FEATURES, keys % FEATURES, n

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and value."""
        owner, at, n = self.counts()
        return owner, at, scaled(owner, n, len(self.sizes))


def scaled(owner: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    """Logarithms of how often features occur, scaled to length one by text."""
    x = np.log1p(n)
    return x / np.sqrt(np.bincount(owner, x * x, texts))[owner]


def votes_of(statistics: np.ndarray) -> list[str]:
    """One digit per labeller: 0 none, 1 bad, 2 good."""
    digits = [np.where((statistics[:, i] >= low) & (statistics[:, i] <= high), vote, 0) for i, (_, low, high, vote) in enumerate(LABELLERS)]
    return ["".join(map(str, row)) for row in np.stack(digits, axis=1).tolist()]


def in_parts(texts: list[str]) -> Iterator[tuple[slice, Texts]]:
    """The texts of a batch in runs of bounded length."""
    begin, size = 0, 0
    for at, text in enumerate(texts, 1):
        size += len(text)
        if size > 6 * TOGETHER or at - begin == ROWS or at == len(texts):
            yield slice(begin, at), Texts(texts[begin:at], lexicon())
            begin, size = at, 0


@dataclass
class LabelModel:
    """Share of good documents; per labeller and class (bad, good) how often it votes."""

    good: float
    rates: np.ndarray

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of a good document for rows of zeros and ones (the labeller votes)."""
        with np.errstate(divide="ignore"):
            yes, no = np.log(self.rates[:, 1] / self.rates[:, 0]), np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        score = math.log(self.good / (1 - self.good)) + patterns @ yes + (1 - patterns) @ no
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))

    def posterior(self, pattern: str) -> float:
        return float(self.posteriors(np.array([[v != "0" for v in pattern]], float))[0])


def fit_label_model(counts: dict[str, int], kinds: list[int] | None = None, rounds: int = ROUNDS, prior: float = PRIOR) -> LabelModel:
    """Expectation maximisation over the vote combinations and their numbers of documents.

    Every labeller votes one way (``kinds``, by default of LABELLERS), and its rate in each class is free, but that it does not
    vote more often where its vote is wrong: then both rates are the same and its vote says nothing. This and the rates at the
    beginning tell the two classes apart. ``prior`` documents of each class follow the first rates, whatever the number of rows.
    """
    kinds = kinds or [vote for *_, vote in LABELLERS]
    patterns = np.array([[v != "0" for v in p] for p in counts], float).reshape(-1, len(kinds))
    weight = np.array(list(counts.values()), float)
    first = np.array([[0.30, 0.01] if kind == 1 else [0.30, 0.70] for kind in kinds])
    model = LabelModel(0.8, first)
    for _ in range(rounds if len(counts) else 0):
        own = model.posteriors(patterns)
        share = np.stack([(1 - own) * weight, own * weight])
        good = float(np.clip(share[1].sum() / weight.sum(), 0.01, 0.99))
        fired = (share @ patterns).T + prior * first
        sizes = share.sum(axis=1) + prior
        rates = fired / sizes
        pooled = fired.sum(axis=1) / sizes.sum()
        for i, kind in enumerate(kinds):
            if (rates[i, 0] - rates[i, 1]) * (1 if kind == 1 else -1) < 0:
                rates[i] = pooled[i]
        new = LabelModel(good, rates)
        moved = abs(new.good - model.good) + np.abs(new.rates - model.rates).max()
        model = new
        if moved < 1e-9:
            break
    return model


def _train(sample: DataFrame, total: int) -> np.ndarray:
    """Logistic regression by full gradients, summed by the tasks over the stored sample; the last weight is the constant."""
    spark = sample.sparkSession
    weights = np.zeros(FEATURES + 1)
    momentum = np.zeros(FEATURES + 1)
    for _ in range(STEPS if total else 0):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(FEATURES + 1)
            w = shared.value  # noqa: B023
            for batch in batches:
                at, x, y = (batch.column(c) for c in ("at", "x", "y"))
                sizes = pa.compute.list_value_length(at).to_numpy(zero_copy_only=False)
                at, x, y = at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                score = np.bincount(row, w[at] * x, len(sizes)) + w[-1]
                error = 1 / (1 + np.exp(-score)) - y
                out[:-1] += np.bincount(at, error[row] * x, FEATURES)
                out[-1] += error.sum()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], names=["g"])

        total_gradient = sum(np.array(r["g"]) for r in sample.mapInArrow(gradient, "g array<double>").collect())
        momentum = 0.9 * momentum - RATE * (total_gradient / total + PENALTY * weights)
        weights = weights + momentum
        shared.unpersist()
    return weights


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and counted features of all texts; those without words have no features."""
    for batch in batches:
        texts = batch.column("t").to_pylist()
        for part, read in in_parts(texts):
            owner, at, n = read.counts()
            cuts = pa.array(np.searchsorted(owner, np.arange(len(read.sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(values, pa.int32())) for values in (at, n)]
            same = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "picked")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(votes_of(read.statistics()), pa.string()), *lists], names=["doc_id", "picked", "votes", "at", "n"])


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features per row of a stored batch; row, feature number and value of all of them."""
    sizes = pa.compute.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "n"))
    return sizes, owner, at, scaled(owner, n.astype(np.int64), len(sizes))


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows with the values of their features in place of the counts."""
    for batch in batches:
        sizes, _, at, x = _counted(batch)
        cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(values)) for values in (at, x)]
        yield pa.RecordBatch.from_arrays([*lists, batch.column("y")], names=["at", "x", "y"])


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """``doc_id, votes, posterior, score`` and ``kept`` of every row.

    ``posterior`` is the label model's, ``score`` the linear scorer's probability of a good document. A text is kept if its
    score reaches ``keep``; a null or empty one has no words, no votes and the score of the constant alone, and is not kept.
    Equal texts get equal scores. An empty table gives no rows. Votes and combinations cover all rows; the scorer is trained on
    a sample of them by the hash of the id, TRAIN_ROWS or fewer on average. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    whole = F.coalesce(docs[text], F.lit(""))
    share = min(1.0, TRAIN_ROWS / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(docs[doc_id].cast("long"), F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole.alias("t"), picked.alias("picked"))
    voted = store_packed(rows.mapInArrow(_voted, "doc_id long, picked boolean, votes string, at array<int>, n array<int>"))
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_label_model(counts)
    posteriors = {p: model.posterior(p) for p in counts}
    label = F.create_map(*chain.from_iterable((F.lit(p), F.lit(y)) for p, y in posteriors.items())) if posteriors else F.create_map(F.lit(""), F.lit(0.0))
    learnt = voted.filter(F.col("picked") & (F.size("at") > 0)).select("at", "n", label[F.col("votes")].alias("y"))
    sample = store_packed(learnt.mapInArrow(_valued, "at array<int>, x array<double>, y double"))
    shared = spark.sparkContext.broadcast(_train(sample, sample.count()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sizes, owner, at, x = _counted(batch)
            votes = batch.column("votes").to_pylist()
            score = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * x, len(sizes)) + w[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("votes"), pa.array([posteriors[v] for v in votes], pa.float64()), pa.array(score), pa.array((score >= keep) & (sizes > 0))],
                names=["doc_id", "votes", "posterior", "score", "kept"],
            )

    return voted.select("doc_id", "votes", "at", "n").mapInArrow(scored, "doc_id long, votes string, posterior double, score double, kept boolean")
