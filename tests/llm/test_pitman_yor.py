"""The language model: exact scores under a fixed seating, seatings against the exact law, edge tables, held-out texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import pitman_yor
from foldwright.llm.pitman_yor import pack, score_texts, seat, unpack

ROOT = 0.75


def half(customers, weight, growth, discount, rng):
    return (customers + 1) // 2


def brute(rows, held, discount):
    """Plain dictionaries, seated by ``half``."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    train = [words(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    pairs, after = Counter(p for t in train for p in zip([0, *t], t)), Counter()
    for t in train:
        after.update([0, *t[:-1]])
    n, v = sum(count.values()), len(count)
    tables, opened, customers = {p: (c + 1) // 2 for p, c in pairs.items()}, Counter(), Counter()
    for (u, w), t in tables.items():
        opened[u] += t
        customers[w] += t
    own = {w: (c + 1) // 2 for w, c in customers.items()}
    fresh = (1 + ROOT * sum(own.values())) / (v + 1)
    shared = lambda w: (customers[w] - ROOT * own.get(w, 0) + fresh) / (1 + sum(customers.values()))
    out = []
    for i, text in rows:
        t = words(text)
        p = [(pairs[u, w] - discount * tables.get((u, w), 0) + (1 + discount * opened[u]) * shared(w)) / (1 + after[u]) for u, w in zip([0, *t], t)]
        out.append((i, held(i), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), sum(map(math.log10, p))))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 6), round(r[6], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", [True]) for r in rows], "doc_id long, text string, slice long, words string, held array<boolean>")


def discount_of(rows, held):
    pairs = Counter()
    for i, t in rows:
        if not held(i):
            ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            pairs.update(zip([0, *ws], [*ws, None]))
    by = Counter(pairs.values())
    return min(max(by[1] / (by[1] + 2 * by[2]), 0.1), 0.95) if by[1] else 0.5


def corpus(seed, n=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("a b c d E e f g h the The of x1 x2 x3 été 日本".split()) if r.random() < 0.8 else f"w{r.randrange(400)}" for _ in range(r.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 21), (300, 64)])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", sizes[1])
    rows = [*corpus(1), (100, None), (101, ""), (102, " \t\n"), (103, "A b"), (103, "a  B"), (104, "new words only"), (7, "the the the"), (106, " ".join(f"w{k % 700}" for k in range(20_000)))]
    held = lambda i: i % 5 == 2
    local = lambda *a: (a[0] + 1) // 2  # noqa: E731 -- defined here, so that it travels to the tasks
    got = score_texts(table(spark, rows).repartition(3), F.col("doc_id") % 5 == 2, seating=local)
    same([tuple(r) for r in got.collect()], brute(rows, held, discount_of(rows, held)))


def test_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a c"), (None, None), (3, "")]
    got = score_texts(table(spark, rows), F.lit(False)).collect()
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {11} and sum(r["doc_id"] is None for r in got) == 2
    alone = score_texts(table(spark, rows), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(0, 0, 0.0, 0.0)] * 5
    assert score_texts(table(spark, []), F.lit(False)).collect() == []


def test_seats_follow_the_law():
    """Mean tables of n customers when a new table has odds (theta + d t) to (n - d t), against the exact recursion and a long table."""
    rng, n, theta, d = np.random.default_rng(1), 40, 2.0, 0.5
    law = defaultdict(float, {1: 1.0})
    for seated in range(1, n):
        after = defaultdict(float)
        for t, p in law.items():
            new = (theta + d * t) / (theta + seated)
            after[t + 1] += p * new
            after[t] += p * (1 - new)
        law = after
    many = np.full(20_000, n)
    drawn = seat(many, np.full(len(many), theta), np.full(len(many), d), d, rng)
    assert abs(drawn.mean() - sum(t * p for t, p in law.items())) < 0.1
    assert np.abs(np.bincount(drawn, minlength=n + 1)[: n + 1] / len(many) - np.array([law[t] for t in range(n + 1)])).max() < 0.02
    n, expected = 5000, 1.0
    for seated in range(1, n):
        expected += (theta + d * expected) / (theta + seated)
    large = seat(np.full(2000, n), np.full(2000, theta), np.full(2000, d), d, rng)
    assert abs(large.mean() / expected - 1) < 0.03
    assert seat(np.array([0, 1]), np.ones(2), np.ones(2), d, rng).tolist() == [0, 1]


def test_packed_arrays():
    for a in (np.zeros(0, np.int64), np.array([3, 2**40]), np.array([2**64 - 1], np.uint64), np.array([0.5, -1])):
        assert (unpack(pack(a)) == a).all()


def test_repeatable_and_better_than_single_words(spark):
    from foldwright.llm.common import read
    from foldwright.llm.pitman_yor import language_model_scores

    docs = read(spark, "/root/testdata/sf0.01", "documents")
    first, second = ({r["doc_id"]: tuple(r) for r in language_model_scores(docs).collect()} for _ in range(2))
    assert first == second and len(first) == docs.count()
    held = [r for r in first.values() if r[1]]
    assert sum(r[6] for r in held) > 0.9 * sum(r[5] for r in held)  # logarithms: a tenth less surprise
