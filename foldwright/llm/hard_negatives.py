"""Hard negatives by slot-decomposed selection.

Anchors are a stated set of rows; each looks for its best positives (rows of its label) and, for every positive, for the best rows of
other labels whose score lies in a window below the positive's.  The windows of one anchor overlap.  The upper limits of its positives
split the scores into disjoint slots, so a row falls into one slot only; combiners in the tasks keep the best rows of each slot, and
merging the slots from a positive's own downwards gives the best rows under its limit.  Those that also meet its lower limit are the
answer: they are the first ones, so nothing is lost by keeping as many a slot as are wanted.

Anchors are a fixed share of the rows and grow with them.  They go out in chunks of a bounded number of components; every chunk is held
against all rows where the rows are stored, as matrix products, and only the best rows per task, anchor and slot are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import drop_stored, store

POSITIVES, NEGATIVES = 5, 3
#: The window below a positive's score: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
SCALE = 256
CHUNK_COMPONENTS = 1 << 21  # of the anchors that are broadcast at a time: 16 MB
BLOCK_SCORES = 1 << 21


def scaled_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v, row_key) of the rows that take part, each once; v holds floor(SCALE * x) in 64 bits.

    Null labels, null ids and vectors that are null or hold a null or non-finite component take no part.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select("vec_id", label.alias("label"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(usable, F.lit(False)))
    whole = rows.select("vec_id", "label", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v")).distinct()
    return whole.withColumn("row_key", F.xxhash64("vec_id", "label", "v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors end in zeros, components beyond ``width`` meet zeros only and are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = place < width
    out[row[fits], place[fits]] = flat[fits]
    return out


def _scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer products of rows and anchors; scores that leave 57 bits are held as Python integers."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    bound = most(x) * most(a) * x.shape[1]
    if bound < 2.0**53:
        return (x.astype(np.float64) @ a.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**56:
        return x @ a.T
    return x.astype(object) @ a.astype(object).T


def _best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of every (anchor, slot), by falling score and rising id."""
    order = np.lexsort((vec_id, -score, slot, anchor))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (anchor[order][1:] != anchor[order][:-1]) | (slot[order][1:] != slot[order][:-1])
    first = np.flatnonzero(fresh)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < most]


class _Kept:
    """The best entries of each (anchor, slot) seen by a task, and the score below which a new one cannot enter."""

    def __init__(self, anchors: int, slots: int, most: int):
        self.slots, self.most = slots, most
        self.anchor, self.slot, self.score, self.vec_id = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.floor = np.full((anchors, slots), -(2**62), dtype=np.int64)

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        merged = [np.concatenate(c) for c in ((self.anchor, anchor), (self.slot, slot), (self.score, score), (self.vec_id, vec_id))]
        keep = _best(*merged, self.most)
        self.anchor, self.slot, self.score, self.vec_id = (c[keep] for c in merged)
        cell = self.anchor * self.slots + self.slot
        full = np.flatnonzero(cell[self.most - 1 :] == cell[: max(0, len(cell) - self.most + 1)])
        last = full + self.most - 1  # entries of a cell lie together, best first
        self.floor[self.anchor[last], self.slot[last]] = np.clip(self.score[last].astype(object), -(2**62), 2**62).astype(np.int64) if self.score.dtype == object else self.score[last]


Candidates = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Kept], Iterator[tuple[np.ndarray, np.ndarray, int]]]


def _scan(rows: DataFrame, anchors: pa.Table, extra: dict, slots: int, most: int, candidates: Candidates) -> DataFrame:
    """(anchor, slot, score, vec_id): the best entries per task of the pairs that ``candidates`` finds in blocks of scores."""
    width = max((len(v) for v in anchors["v"]), default=0)
    shared = rows.sparkSession.sparkContext.broadcast((anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["row_key"].to_numpy(), _matrix(anchors["v"], width), extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, a_label, a_key, a, more = shared.value
        kept = _Kept(len(a), slots, most)
        step = max(1, BLOCK_SCORES // max(1, len(a)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vec_id, label, key, x = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(2), width)
                for j, i, slot, score in candidates(x, label, key, a, a_label, a_key, more, kept):
                    kept.add(j, np.full(len(j), slot, dtype=np.int64), score, vec_id[i])
        score = np.array([min(max(int(s), 1 - 2**63), 2**63 - 1) for s in kept.score], dtype=np.int64) if kept.score.dtype == object else kept.score
        yield pa.RecordBatch.from_arrays([pa.array(kept.anchor), pa.array(kept.slot.astype(np.int32)), pa.array(score), pa.array(kept.vec_id)], ["anchor", "slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "v", "row_key").mapInArrow(run, "anchor long, slot int, score long, vec_id long")


def _same_label(x, label, key, a, a_label, a_key, more, kept):
    """Rows of the anchor's label other than the anchor."""
    for value in np.intersect1d(label, a_label):
        i, j = np.flatnonzero(label == value), np.flatnonzero(a_label == value)
        s = _scores(x[i], a[j])
        enters = (s >= kept.floor[j, 0]) & (key[i][:, None] != a_key[j])
        r, c = np.nonzero(enters)
        yield j[c], i[r], 0, s[r, c]


def _other_label(x, label, key, a, a_label, a_key, more, kept):
    """Rows of other labels, slot by slot; slot p of an anchor goes from above the next upper limit, or the lower limit, to its own."""
    upper, lower = more["upper"], more["lower"]
    s = _scores(x, a)
    low, high = lower.min(initial=2**62), upper.max(initial=-(2**62))
    other = (label[:, None] != a_label) & (s >= low) & (s <= high)
    r, c = np.nonzero(other)
    value = s[r, c]
    for slot in range(upper.shape[1]):
        enters = (value >= np.maximum(lower[c, slot], kept.floor[c, slot])) & (value <= upper[c, slot])
        yield c[enters], r[enters], slot, value[enters]


def _merged(found: DataFrame, most: int) -> DataFrame:
    """(anchor, slot, best): the first ``most`` entries over all tasks; a group holds at most ``most`` entries of each task."""
    entry = F.struct((-F.col("score")).alias("fall"), "vec_id")
    lists = found.groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return lists.select("anchor", "slot", F.slice("all", 1, most).alias("best"))


def _limits(positives: pa.Table, anchors: int, most: int) -> dict[str, np.ndarray]:
    """Upper limit and lowest useful score of every slot; a slot without a positive is empty."""
    upper, lower = np.full((anchors, most), -(2**62), dtype=np.int64), np.full((anchors, most), 2**62, dtype=np.int64)
    for j, best in zip(positives["anchor"].to_pylist(), positives["best"].to_pylist(), strict=True):
        limits = [(HIGH * p // 100, -(-LOW * p // 100)) for p in (-e["fall"] for e in best) if p >= 0]
        tops = sorted({u for u, _ in limits}, reverse=True)
        for slot, top in enumerate(tops):
            least = min(low for u, low in limits if u == top)
            below = tops[slot + 1] + 1 if slot + 1 < len(tops) else least
            upper[j, slot], lower[j, slot] = top, max(below, least)
    return {"upper": upper, "lower": lower}


def mine_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over all anchors and their positives.

    ``vectors`` has vec_id, embedding and the columns that ``label`` and ``is_anchor`` use; other columns are ignored.  Rows that do not
    take part are listed at :func:`scaled_rows`.  Rows equal in id, label and vector count once; rows that share only the id are rows
    of their own.  Vectors of different lengths meet as if the shorter one ended in zeros.  Products are exact; a score beyond 64 bits
    counts as the nearest of -(2**63 - 1) and 2**63 - 1, a component beyond 64 bits counts as the nearest long.  A positive with a negative score has an empty
    window.  Anchors without positives, and positives without negatives in their window, give no row; so does an empty table.
    """
    spark = vectors.sparkSession
    rows = store(scaled_rows(vectors, F.col(label) if isinstance(label, str) else label), "vectors")
    anchors = rows.filter(is_anchor).select("vec_id", "label", "v", "row_key")
    size = anchors.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    chunks = -(-2 * size // CHUNK_COMPONENTS) if size > CHUNK_COMPONENTS else 1
    parts: list[DataFrame] = []
    for chunk in range(chunks):
        # chunks by hash of the row: half full on average, so that none grows far beyond the bound
        held = anchors.filter(F.pmod("row_key", F.lit(chunks)) == chunk).orderBy("vec_id", "row_key").toArrow()
        best = store(_merged(_scan(rows, held, {}, 1, positives, _same_label), positives), "positives")
        limits = _limits(best.select("anchor", "best").toArrow(), held.num_rows, positives)
        found = store(_merged(_scan(rows, held, limits, positives, negatives, _other_label), negatives), "slots")
        parts.append(store(_answer(spark, held, best, found, negatives), "negatives"))
        drop_stored(best, found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _answer(spark, held: pa.Table, best: DataFrame, slots: DataFrame, most: int) -> DataFrame:
    """Slots merged downwards: under a positive's upper limit, the first entries that also meet its lower limit."""
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(held.num_rows)), "anchor_id": held["vec_id"]}))
    merged = slots.groupBy("anchor").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("entries"))
    pairs = best.select("anchor", F.posexplode("best").alias("place", "p")).select("anchor", "place", F.col("p.vec_id").alias("positive_id"), (-F.col("p.fall")).alias("positive_score"))
    score = lambda e: (-e["fall"]).cast("decimal(20,0)")
    limit = F.col("positive_score").cast("decimal(20,0)")
    window = F.slice(F.filter("entries", lambda e: (score(e) * 100 >= limit * LOW) & (score(e) * 100 <= limit * HIGH)), 1, most)
    rows = pairs.join(merged, "anchor").join(names, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("rank", "e"))
    return rows.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score", (-F.col("e.fall")).alias("negative_score"))


def shifted_label() -> Column:
    """(label + 1) % 10 where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
