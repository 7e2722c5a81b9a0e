"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least three times as long as q, that no neighbour extends.  Periods up to
DIRECT are found by comparing the words with themselves at that distance.  For a longer period q there is one scale t = 4, 8, 16,
... with 1.5 t <= q < 3 t.  At that scale a hash of every window of t words selects positions: i is selected when the least hash
among the windows that start in [i, i + t] is at i or at i + t.  The choice depends on the 2t words from i on alone, so equal
contexts are selected alike, and every stretch of 3t - 1 words has a selected position among its first t unless it has a period of at
most t / 3.  Windows with so small a period have no say (they lie in runs that smaller scales have found already); without them
selected positions of equal context are more than t / 3 apart.  Two selected positions with equal contexts at distance q therefore
exist in every run of period q; they propose q, and words are compared to the left and right of them to find the whole run.

All documents of a slice are one string with a unique word after each document; a run cannot hold such a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import WORD, pieces

LEAST_WORDS, LEAST_POWER = 24, 3
DIRECT = 5
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stretches(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal stretch of true values."""
    change = np.diff(np.r_[False, match, False].astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _small_periods(words: np.ndarray) -> np.ndarray:
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, min(DIRECT, len(words) - 1) + 1):
        begin, end = _stretches(words[q:] == words[:-q])
        long = end - begin >= (LEAST_POWER - 1) * q
        found.append(np.stack([begin[long], end[long] + q, np.full(long.sum(), q)], axis=1))
    return _smallest(np.concatenate(found))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row (begin, end, period) per stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _equal_ahead(words: np.ndarray, at: int, q: int) -> int:
    """How many words from ``at`` on equal those q further."""
    n, size = 0, 64
    while at + q + n < len(words):
        stop = min(size, len(words) - at - q - n)
        differ = np.flatnonzero(words[at + n : at + n + stop] != words[at + q + n : at + q + n + stop])
        if len(differ):
            return n + int(differ[0])
        n, size = n + stop, size * 2
    return n


def _equal_behind(words: np.ndarray, at: int, q: int) -> int:
    """How many words before ``at`` equal those q further."""
    n, size = 0, 64
    while n < at:
        stop = min(size, at - n)
        differ = np.flatnonzero(words[at - n - stop : at - n] != words[at - n - stop + q : at - n + q])
        if len(differ):
            return n + stop - 1 - int(differ[-1])
        n, size = n + stop, size * 2
    return n


def _selected(h: np.ndarray, t: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Selected positions of windows hashed as ``h``; windows in the stretches [begin, end] have no say."""
    inside = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end + 1, -1)
    value = np.where(np.cumsum(inside[:-1]) > 0, _NONE, h)
    least, width = value, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    last = len(h) - 2 * t
    if last < 0:
        return np.zeros(0, dtype=np.int64)
    least = np.minimum(least[: last + 1], value[t : last + t + 1])
    return np.flatnonzero((least != _NONE) & ((value[: last + 1] == least) | (value[t : last + t + 1] == least)))


def _proposals(position: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances, in [1.5 t, 3 t), of selected positions with equal contexts."""
    order = np.lexsort((position, context))
    position, context = position[order], context[order]
    at, far = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(1, len(position)):
        gap = position[k:] - position[:-k]
        near = (context[k:] == context[:-k]) & (gap < 3 * t)
        if not near.any():
            break
        take = near & (2 * gap >= 3 * t)
        at.append(position[:-k][take])
        far.append(gap[take])
    return np.concatenate(at), np.concatenate(far)


def _whole_runs(words: np.ndarray, at: np.ndarray, far: np.ndarray, t: int) -> np.ndarray:
    """The runs (begin, end, period) that hold the proposed pairs of contexts."""
    order = np.lexsort((at, far))
    at, far = at[order], far[order]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (far[1:] != far[:-1]) | (at[1:] > at[:-1] + 2 * t)
    runs: list[tuple[int, int, int]] = []
    for i, q in zip(at[fresh].tolist(), far[fresh].tolist(), strict=True):
        if runs and runs[-1][2] == q and i < runs[-1][1] - q:
            continue
        begin, end = i - _equal_behind(words, i, q), i + q + _equal_ahead(words, i, q)
        runs.append((begin, end, q))
    return np.array([r for r in runs if r[1] - r[0] >= LEAST_POWER * r[2]], dtype=np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs (begin, end, period), of any length, of a string of word numbers whose documents end at ``ends``.

    The word at each end is unique.  A document takes part at the scales that its length allows.
    """
    runs = _small_periods(words)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    where = np.arange(len(words))
    h, t = _mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    lengths = ends - starts
    while True:
        if t >= 4:
            stay = 2 * lengths >= 9 * t
            if not stay.any():
                return runs
            if not stay.all():
                kept = np.repeat(stay, lengths + 1)
                where, h, starts, lengths = where[kept], h[kept], starts[stay], lengths[stay]
            # runs whose period is too small to have a say at this scale
            small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
            begin = np.searchsorted(where, small[:, 0])
            present = (begin < len(where)) & (where[np.minimum(begin, len(where) - 1)] == small[:, 0])
            begin, span = begin[present], (small[:, 1] - small[:, 0])[present]
            chosen = _selected(h, t, begin, begin + span - t)
            context = _mix(h[chosen] * np.uint64(0x9E3779B97F4A7C15) ^ h[chosen + t])
            at, far = _proposals(where[chosen], context, t)
            if len(at):
                runs = _smallest(np.concatenate([runs, _whole_runs(words, at, far, t)]))
        ahead = np.arange(len(h), dtype=np.uint64) | np.uint64(1 << 63)  # windows past the end are like no other
        ahead[: max(0, len(h) - t)] = h[t:]
        h, t = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ ahead), 2 * t


def runs_of_texts(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, the starts of the texts in the string of all words, and its runs of LEAST_WORDS words and more."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at exactly the ASCII white space
    number = {w: i for i, w in enumerate({w for ws in words for w in ws})}
    lengths = np.array([len(ws) for ws in words], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    string = np.empty(int(lengths.sum()) + len(words), dtype=np.int64)
    for ws, n, end in zip(words, lengths, ends, strict=True):
        string[end - n : end] = np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=n)
    string[ends] = len(number) + np.arange(len(ends))
    runs = find_runs(string, ends)
    return words, ends - lengths, runs[runs[:, 1] - runs[:, 0] >= LEAST_WORDS]


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id), runs and collapsed of every row of ``docs``.

    ``runs`` lists (start, length, period) of every run by start and period, ``collapsed`` joins by one space the words that stay
    when of each run only the first period is kept.  Words are runs of characters other than ASCII white space.  A text that is null,
    empty or blank has no words: no runs and an empty collapsed text.  Rows are independent: repeated rows give repeated results, ids
    may be null or shared, other columns are ignored, and an empty table gives an empty result.  Memory follows the longest text.
    """
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__text"):
            words, starts, runs = runs_of_texts(texts)
            owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]  # owners stay in order
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            found, collapsed = [], []
            for k, ws in enumerate(words):
                own = runs[bounds[k] : bounds[k + 1]] - np.array([starts[k], starts[k], 0])
                if len(own):
                    found.append([{"start": a, "length": b - a, "period": q} for a, b, q in own.tolist()])
                    edge = np.zeros(len(ws) + 1, dtype=np.int64)
                    np.add.at(edge, own[:, 0] + own[:, 2], 1)
                    np.add.at(edge, own[:, 1], -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                else:
                    found.append([])
                collapsed.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, run_type), pa.array(collapsed, pa.string())], [*keep, "runs", "collapsed"])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by h = crc32 of its id, repeats p words from word a on, words joined by a space.

    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) with g = floor(h / 10) and n words; other texts stay as they are.
    """
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    n, g = F.size("words").cast("long"), F.floor(h / 10)
    a = F.when(n > 0, F.pmod(g, n))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    index = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))
    changed = F.array_join(F.transform(index, lambda i: F.get(F.col("words"), i)), " ")
    rows = docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("a", a).withColumn("p", p)
    return rows.select("doc_id", F.when(F.size("words") > 0, changed).otherwise(F.col("text")).alias("text"))


def _strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equals the first."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


def summarize(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", _strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
