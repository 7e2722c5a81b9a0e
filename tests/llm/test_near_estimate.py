"""The estimate limit loses fewer pairs at the least similarity than the bands do."""

import math

import numpy as np

from foldwright.llm import near_dedup


def test_estimate_limit_is_rarely_missed():
    n, p = near_dedup.REGISTERS, near_dedup.LEAST_PERCENT / 100
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(n * near_dedup.LEAST_ESTIMATE)))
    assert missed < (1 - p ** (n // near_dedup.BANDS)) ** near_dedup.BANDS < 1e-5


def test_codes_never_lose_a_link():
    """The bound from the codes is at least the true intersection in any widths, and close to it."""
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 5, 300, 1900, 2048, 2049, 2600, 8000)]
    codes = [near_dedup._decode(s.astype("<u2" if len(s) <= near_dedup.SHORT_CODES else "<u4").tobytes(), len(s)) for s in sets]
    seen = np.zeros(1 << 16, dtype=bool)
    for x, code in zip(sets, codes, strict=True):
        common = np.array([len(np.intersect1d(x, y)) for y in sets])
        got = near_dedup.most_common(code, codes, seen)
        assert (got >= common).all() and (got <= np.minimum(len(x), common + 0.15 * np.array([len(y) for y in sets]) + 1)).all()
        assert not seen.any()


def test_crowd_of_edits(spark):
    """One base and very many edits of it, most of them alike but not linked: blocks and row joins agree with all pairs."""
    rng, base, rows = np.random.default_rng(11), [f"b{i}" for i in range(60)], []
    for i in range(150):
        words = list(base)
        for j in rng.choice(60, rng.integers(1, 7), replace=False):
            words[j] = f"e{i}-{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    sets = near_dedup.shingle_sets([t for _, t in rows])
    home = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and home[i] != home[j]:
                low, high = sorted((home[i], home[j]))
                home = [low if h == high else h for h in home]
    assert got == dict(enumerate(home)) and 10 < len(set(home)) < 140
