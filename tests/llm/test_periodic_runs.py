"""Runs against brute force on random strings, hand-written cases and edge tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foldwright.llm.periodic_runs import periodic_runs, repeat_tails, runs_of_texts, summarize


def brute(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        equal = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        begin = None
        for k, same in enumerate(equal):
            if same and begin is None:
                begin = k
            elif not same and begin is not None:
                if k - begin + q >= max(24, 3 * q):
                    found.setdefault((begin, k + q), q)
                begin = None
    return sorted((a, b - a, q) for (a, b), q in found.items())


def made(r):
    words = [r.randrange(r.choice([1, 2, 2, 3, 5, 50])) for _ in range(r.randint(0, 260))]
    for _ in range(r.randint(0, 3)):
        if len(words) > 3:
            a = r.randrange(len(words))
            p = r.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a + p, r.randint(a, len(words))):
                words[i] = words[i - p]
    return words


def test_all_runs_of_random_strings():
    r, total = random.Random(11), 0
    for _ in range(300):
        docs = [made(r) for _ in range(r.randint(1, 6))]
        _, starts, runs = runs_of_texts([" ".join(map(str, d)) for d in docs])
        got = [[] for _ in docs]
        for a, b, q in runs.tolist():
            k = int(np.searchsorted(starts, a, side="right")) - 1
            got[k].append((a - int(starts[k]), b - a, q))
        for d, found in zip(docs, got, strict=True):
            want = brute(d)
            total += len(want)
            assert sorted(found) == want
    assert total > 200


LONG = " ".join(f"w{i % 9000}" for i in range(60_000))  # one run of period 9000
ROWS = [
    (1, "a " * 24), (2, "a " * 23), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, "x " + "b c d\t" * 9 + "tail"), (7, "x " + "b c d " * 9 + "tail"), (None, "é 語 " * 30), (9, "a b " * 12 + "a a a b " * 8), (10, "    " * 20),
    (25, "one two three four five"),
]


def summary(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(said), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "b", [0]) for r in ROWS], "doc_id long, text string, period long, collapsed string, runs array<int>")


def test_edges(docs):
    got = [tuple(r) for r in summarize(periodic_runs(docs)).collect()]
    short = [summary(i, t) for i, t in ROWS if t is not LONG]
    text = hashlib.sha256(LONG[: LONG.index(" w0 ")].encode()).hexdigest()
    long = (6, 1, 0, 60_000, 9000, 6666, hashlib.sha256(b"0,60000,9000\n").hexdigest(), text)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([*short, long], key=key)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_tails_repeat(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(600)] + [(None, "p q r"), (1003, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    changed = 0
    for doc_id, text, after in got.join(repeat_tails(got).withColumnRenamed("text", "after"), "doc_id").collect():
        h = zlib.crc32(str(doc_id).encode())
        words, g = (text or "").split(), h // 10
        if h % 10 == 0 and words:
            a, n = g % len(words), len(words)
            p = 1 + (n - a) // (3 + g % 8)
            text, changed = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n)), changed + 1
        assert after == text
    assert changed > 20
