"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one flat array of symbol ids with sequence numbers (a ragged array). A step looks up the rank of every
adjacent pair, takes each sequence's lowest rank, merges all its occurrences in all sequences at once (leftmost first where
they overlap), and drops the sequences that have no mergeable pair left. What survives is counted. All sequences advance
together, so a step is a handful of array operations whatever the number of sequences. A pair made by a merge always has a
higher rank than that merge, hence taking the lowest rank first gives exactly the library's tokens.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pretokens import UnitCache, is_plain, pieces, segments
from tickloom.llm.text import prepare

# Fixed value: the byte-level pre-token pattern, with the white space of Unicode.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

BYTE_BPE = "byte_bpe_50k.json"


def default_vocabulary() -> str:
    return public_tokenizers.path(BYTE_BPE)


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Pairs of symbol ids as sorted keys, with their rank and the id they merge to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for byte, letter in byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        special = [t["content"] for t in spec["added_tokens"]]
        if len(special) > 1:
            raise ValueError("one special string is supported")
        self.special = special[0] if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` for pairs that do not merge."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def merge_counts(table: MergeTable, sequences: list[bytes]) -> np.ndarray:
    """Number of symbols that each byte sequence merges down to."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    counts = np.zeros(len(sequences), np.int64)
    symbols = table.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), lengths)
    while len(symbols):
        inner = owner[1:] == owner[:-1]
        rank = np.full(len(symbols), table.none, np.int64)
        rank[:-1][inner] = table.rank(symbols[:-1][inner], symbols[1:][inner])
        starts = np.flatnonzero(np.r_[True, ~inner])
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        done = lowest == table.none
        if done.any():
            counts[owner[starts[done]]] = sizes[done]
        lowest = np.repeat(lowest, sizes)
        hit = (rank == lowest) & (lowest != table.none)
        # Occurrences of one pair overlap only in runs of one symbol; every second one of a run merges.
        index = np.arange(len(symbols))
        run_start = hit & ~np.r_[False, hit[:-1] & (owner[1:] == owner[:-1])]
        since = index - np.maximum.accumulate(np.where(run_start, index, 0))
        hit &= since % 2 == 0
        symbols[hit] = table.made[rank[hit]]
        stay = ~np.r_[False, hit[:-1]] & (lowest != table.none)
        symbols, owner = symbols[stay], owner[stay]
    return counts


def pretokens_of(found: Callable[[str], list[str]], units: list[str]) -> list[list[str]]:
    """The pre-tokens of each unit. Units without inner white space are searched together, set apart by line breaks."""
    plain = [u for u in units if is_plain(u)]
    by_unit: dict[str, list[str]] = {}
    now: list[str] = []
    at = 0
    for token in found("\n".join(plain)):
        if token == "\n":
            by_unit[plain[at]] = now
            now = []
            at += 1
        else:
            now.append(token)
    if plain:
        by_unit[plain[at]] = now
    return [by_unit[u] if u in by_unit else found(u) for u in units]


def unit_counter(table: MergeTable, limit: int = 1_000_000) -> Callable[[list[str]], list[int]]:
    """Token counts of units: the pre-tokens not yet known are merged together in one ragged array."""
    found = regex.compile(PATTERN).findall
    known: dict[str, int] = {}

    def count(missing: list[str]) -> list[int]:
        tokens = pretokens_of(found, missing)
        if len(known) > limit:
            known.clear()
        new = list(set(chain.from_iterable(tokens)).difference(known))
        known.update(zip(new, merge_counts(table, [t.encode("utf-8", "surrogatepass") for t in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, t)) for t in tokens]

    return count


@lru_cache(maxsize=1)
def _counter(path: str) -> tuple[MergeTable, UnitCache]:
    """A worker keeps its merge table and the bounded cache of units from task to task."""
    table = merge_table(path)
    return table, UnitCache(unit_counter(table))


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text.

    A null text counts as empty (0 bytes, 0 tokens). The special string inside a text is one token, as the library gives it by
    default. Repeated rows are counted each; ties do not arise. Columns outside ``keep`` are not read, whatever their names.
    The work is per row, with no shuffle; a worker holds one Arrow batch and a bounded cache of units.
    """
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cache = _counter(path)
        for batch in batches:
            cut = [[pieces(s) for s in segments(t or "", table.special)] for t in batch]
            found = iter(cache.look_up(list(chain.from_iterable(cut))))
            yield pd.Series([len(parts) - 1 + sum(sum(next(found)) for _ in parts) for parts in cut], dtype="int64")

    whole: Column = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.octet_length(whole).cast("long").alias("n_bytes"), counted(whole).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
