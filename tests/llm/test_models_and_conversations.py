"""Language-model scores, prefix tries and repaired conversations against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from tickloom.llm import katz, prefix_trie, queries, repair
from tickloom.llm.katz import COUNTS, discounts, katz_scores

DATA = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class PlainKatz:
    def __init__(self, rows):
        self.rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [1]) for d, t in rows]
        self.c1, self.c2, self.context = Counter(), Counter(), Counter()
        for d, tokens in self.rows:
            if not self.held(d):
                self.c1.update(tokens)
                self.c2.update(zip([0, *tokens], tokens, strict=False))
                self.context.update([0, *tokens[:-1]])
        self.d1, self.d2 = (discounts(Counter(c.values())) for c in (self.c1, self.c2))
        self.n = sum(self.c1.values())
        self.followers = defaultdict(list)
        for u, w in self.c2:
            self.followers[u].append(w)
        self.unknown = 1 - sum(self.word(w) for w in self.c1)
        self.alpha = {}
        for u, ws in self.followers.items():
            self.alpha[u] = (1 - sum(self.pair(u, w) for w in ws)) / (1 - sum(self.word(w) for w in ws))

    @staticmethod
    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0

    def word(self, w):
        c = self.c1[w]
        return (self.d1[c] if c <= COUNTS else 1) * c / (self.n + 1) if c else self.unknown

    def pair(self, u, w):
        c = self.c2[u, w]
        if c:
            return (self.d2[c] if c <= COUNTS else 1) * c / (self.context[u] + 1)
        return self.alpha.get(u, 1) * self.word(w)

    def scores(self):
        for d, tokens in self.rows:
            base = sum(math.log10((self.c1[w] + 0.1) / (self.n + 0.1 * (len(self.c1) + 1))) for w in tokens)
            score = sum(math.log10(self.pair(u, w)) for u, w in zip([0, *tokens], tokens, strict=False))
            yield d, self.held(d), len(tokens), sum(w in self.c1 for w in tokens), self.n, base, score


def same(found, expected):
    found = sorted(found, key=lambda r: (str(r[0]), r[2], r[-1]))
    expected = sorted(expected, key=lambda r: (str(r[0]), r[2], r[-1]))
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot", [1 << 16, 100])
def test_katz_scores_equal_a_plain_model(spark, monkeypatch, hot):
    """Whatever share of words is frequent: all, some."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "TASK", 40_000)
    monkeypatch.setattr(katz, "CHUNK", 3000)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    plain = PlainKatz(rows)
    same([tuple(r) for r in katz_scores(df.repartition(3)).collect()], list(plain.scores()))
    for u in [0, *random.Random(1).sample(sorted(w for w in plain.followers if isinstance(w, str)), 20)]:
        assert sum(plain.pair(u, w) for w in plain.c1) + plain.alpha[u] * plain.unknown == pytest.approx(1)
    held = [r for r in plain.scores() if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_katz_scores_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(katz, "SLICE", 50)
    monkeypatch.setattr(katz, "CHUNK", 40)
    texts = [None, "", " \t\n", "One", "one ONE one", "É é a\x85b a\x1cb", "x " * 500, "y" * 9000, "tail\x0b\x0ctail"]
    rows = [Row(doc_id=i, text=t, words="clash", c=i, row=None) for i, t in enumerate(texts)] + [Row(doc_id=None, text="one two", words="", c=0, row=None)]
    rows += [rows[4], rows[4], Row(doc_id=4, text="another text of the same id", words="", c=0, row=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, c int, row string")
    same([tuple(r) for r in katz_scores(df).collect()], list(PlainKatz([(r.doc_id, r.text) for r in rows]).scores()))
    assert katz_scores(df.limit(0)).count() == 0
    held = df.filter("doc_id is null")
    assert tuple(katz_scores(held).first()) == (None, True, 3, 0, 0, 3 * math.log10(0.1 / 0.1), 0.0)


def test_discounts_where_counts_allow_them():
    assert discounts({}).tolist() == [1.0] * 6 and discounts({1: 5}).tolist() == [1.0] * 6
    d = discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    assert all(0 < x < 1 for x in d[1:])
    n = [0, 100, 40, 20, 12, 8]
    assert sum((1 - d[r]) * r * n[r] for r in range(1, 6)) == pytest.approx(100)
    assert all(x < 1 for x in discounts({1: 100, 2: 40, 3: 5})[1:3]) and discounts({1: 100, 2: 40, 3: 5})[3:].tolist() == [1, 1, 1]


def test_packed_arrays_come_back():
    rng = np.random.default_rng(2)
    arrays = {name: rng.integers(0, 200, rng.integers(0, 50)) for name, _ in katz.PACKED}
    back = katz.unpacked(katz.packed(arrays))
    assert all(np.array_equal(arrays[n], back[n]) for n in arrays)


def plain_trie(rows):
    """Nodes of the rebuilt conversations of rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1].encode() if node else b"") + sum(saved[c] for c in children[node])
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(built[c]) == len(node))
        yield (ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], str(r)))


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_rows", [20_000, 30, 1])
def test_trie_equals_a_plain_one(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    for c in range(1000, 1060):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, "user", rng.choice(["a", "b", "é"])))
    rows += [(2000 + i, t, "user", f"x{t}") for i in range(30) for t in range(12)]
    rows += [(3001, None, None, None), (3001, None, "", ""), (3001, 5, "user", "x" * 5000), (3002, 1, "u", "s"), (3002, 1, "u", "s"), (3003, 1, "us", "s"), (None, 1, "user", "lost")]
    rows += [(4000, t, "user", str(t % 7)) for t in range(300)]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumnRenamed("text", "text")
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)), shard_rows=shard_rows)
    assert ordered(tuple(r) for r in found.collect()) == ordered(plain_trie(rows))


def test_trie_of_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", 5, "k")], CONVERSATIONS + ", place int, k1 string")
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))
    assert ordered(tuple(r) for r in found.collect()) == ordered(plain_trie([(1, 0, "user", "t")]))
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df.limit(0))))
    assert found.count() == 0


def test_queue_spills_and_keeps_its_order():
    rng = random.Random(4)
    queue, held, out = prefix_trie.SpillingQueue(in_memory=10), [], []
    for _ in range(2000):
        if held and rng.random() < 0.4:
            assert queue.peek() == min(held)
            out.append(queue.pop())
            held.remove(out[-1])
        else:
            message = tuple(rng.randint(-5, 5) for _ in range(6))
            queue.push(message)
            held.append(message)
    assert queue.spilled > 10 and [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None


def plain_edits(rows):
    """The best of all edits with up to two insertions anywhere."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    choices = []
    for initial, fault in rows:
        extra = 3 if fault == repair.TRUNCATED else 0
        own = [("D", "", 4)]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            own += [("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        choices.append(own)
    for picked in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            initials = between[0] + "".join(i + g for (_, i, _), g in zip(picked, between[1:], strict=True))
            if re.fullmatch(r"(s?(ua)+)?", initials):
                audit = "I" * len(between[0]) + "".join(e + "I" * len(g) for (e, _, _), g in zip(picked, between[1:], strict=True))
                cost = sum(c for _, _, c in picked) + 3 * sum(map(len, between))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_least_edits_equal_the_best_of_all():
    for n in range(4):
        for initials in itertools.product("suat", repeat=n):
            for faults in itertools.product(range(4), repeat=n):
                if n < 3 or hash((initials, faults)) % 40 == 0:
                    rows = list(zip(initials, faults, strict=True))
                    assert repair.least_edits(rows) == plain_edits(rows), rows
    cost, audit = repair.least_edits([("u", 0), ("a", 0)] * 700)
    assert (cost, audit) == (0, "K" * 1400)


def plain_repair(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, turns in by.items():
        after = []
        for t, r, x in turns:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            after += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
        after.sort(key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2]))
        faults, seen = [], set()
        for _, r, x in after:
            body = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((r, x))
        numbers = [t for t, _, _ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        cost, audit = repair.least_edits([(r[:1], f) for (_, r, _), f in zip(after, faults, strict=True)])
        out, at, last = [], 0, ""
        for letter in audit:
            if letter == "I":
                last = "a" if last == "u" else "u"
                out.append(("user" if last == "u" else "assistant") + ":")
                continue
            _, r, x = after[at]
            at += 1
            if letter == "R":
                last = "a" if last == "u" else "u"
                out.append(("user" if last == "u" else "assistant") + ":" + x)
            elif letter == "K":
                last = r[0]
                out.append(f"{r}:{x}")
        assert at == len(after) and re.fullmatch(r"(s?(ua)+)?", "".join(o[0] for o in out))
        yield (c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(repair, "IN_MEMORY", 200)
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    for c in range(5000, 5150):
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([None, t, t, t, 2 * t]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["a.", "b", "", " \t", None, "c!", "d? \n", "é"])))
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "x" * 3000 + "."), (6000, 3, "user", "only.")]
    found = queries.repair(queries.damaged(spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "turn AS gone", "role AS cost")))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_repair(rows)))
    assert queries.repair(queries.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = tuple(queries.repair(queries.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], CONVERSATIONS))).first())
    assert row == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
