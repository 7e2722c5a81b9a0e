"""Removal of repeated 50-byte strings with suffix arrays built by the difference-cover algorithm.

Sorting all suffixes of a corpus would move every byte many times, so the suffixes are distributed by content first.  An anchor is
the 24-byte string with the smallest hash in some 50-byte window; equal windows have equal anchors at equal offsets.  The context of
an anchor (at most 26 bytes before, 50 from its start on) holds all its windows; equal contexts form a class.  Documents lie in
blocks of ascending doc_id.  Blocks exchange anchors and classes by ranges of anchors, twelve bytes each, and learn for each class
whether an earlier block has it (then it goes whole) and whether its anchor has other classes.  Only contexts that go nowhere by
that and whose anchor has several classes move on, one block sending the bytes of a class; they meet by anchor in pools.  A pool is
sorted by the difference-cover algorithm: triples at positions not divisible by three are sorted and named, names are sorted by
recursion, the remaining suffixes follow from them, both orders are merged, and neighbours with 50 equal bytes form groups whose
smallest document keeps its bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import drop_stored, free_shuffles, store, text_ranges

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM  # windows that hold an anchor start up to this many bytes before it
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 4 << 20
POOL_BYTES = 1 << 20

_U = np.uint64
_ROOT, _INVERSE = _U(0xD1342543DE82EF95), _U(pow(0xD1342543DE82EF95, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of all stretches of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = np.full(n + 1, _ROOT), np.full(n + 1, _INVERSE)
        up[0] = self.down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    step = 1
    n = len(x)
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: n - width + 1], x[width - step : width - step + n - width + 1])


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Positions of the anchors of all windows within the documents of a block, and their hashes."""
    hashes = Hashes(data)
    n, width = len(data), REACH + 1
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), hashes
    at = np.arange(n - GRAM + 1)
    h = hashes.of(at, at + GRAM) | _U(1)
    least = _sliding(h, width, np.minimum)  # window starts 0 .. n - SPAN
    ends = np.cumsum(sizes)
    crossing = np.zeros(n + 1, dtype=np.int32)  # windows that would run over the end of a document
    np.add.at(crossing, np.maximum(ends - SPAN + 1, ends - sizes), 1)
    np.add.at(crossing, ends, -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    padded = np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]
    most = _sliding(padded, width, np.maximum)[: len(h)]
    found = np.flatnonzero(most == h)
    return found, h[found], hashes


def cut_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, first_id, doc_ids, sizes, body): documents of at least SPAN bytes in ascending doc_id.

    A block holds all rows of each of its ids, or rows of one id only; so of two blocks the one with the smaller ``first_id`` has
    smaller ids throughout, and blocks with equal ``first_id`` hold that id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 32

        def pack(rows):
            nonlocal count
            count += 1
            ids, parts = [r[0] for r in rows], [r[1] for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([count - 1], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["block", "first_id", "doc_ids", "sizes", "body"],
            )

        # rows of one id may begin in the task before or go on in the next one, so the first and the last id have blocks of their own,
        # and so has an id whose rows fill more than a block
        done, same, held, alone = [], [], 0, True
        for batch in batches:
            for start, stop, texts in text_ranges(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(start, stop - start).to_pylist(), texts, strict=True):
                    raw = text.encode()
                    if same and same[0][0] != doc_id:
                        if alone:
                            yield pack(same)
                            held, alone = 0, False
                        else:
                            done.extend(same)
                        same = []
                    if done and held + len(raw) > block_bytes:
                        yield pack(done)
                        done, held = [], sum(len(r[1]) for r in same)
                    if same and held + len(raw) > block_bytes:
                        yield pack(same)
                        same, held, alone = [], 0, True
                    same.append((doc_id, raw))
                    held += len(raw)
        for rest in (done, same):
            if rest:
                yield pack(rest)

    rows = docs.filter(F.octet_length("text") >= SPAN).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, "block long, first_id long, doc_ids array<long>, sizes array<long>, body binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, np.frombuffer(row["body"], dtype=np.uint8), np.array(row["sizes"], dtype=np.int64)


@dataclass
class Around:
    """Contexts of a block, and their distinct classes in order of (anchor, class)."""

    at: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    place: np.ndarray  # class of each context
    anchor: np.ndarray
    kind: np.ndarray
    part: np.ndarray


def around(data: np.ndarray, sizes: np.ndarray, n_ranges: int) -> Around:
    at, h, hashes = anchors(data, sizes)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, "right")
    begin, end = np.maximum(at - REACH, ends[doc] - sizes[doc]), np.minimum(at + SPAN, ends[doc])
    kind = _mix(hashes.of(begin, end) + h)
    order = np.lexsort((kind, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = kind[order[1:]] != kind[order[:-1]]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    anchor = h[order[new]]
    part = (((anchor >> _U(32)) * _U(n_ranges)) >> _U(32)).astype(np.int64)
    return Around(at, begin, end, doc, place, anchor, kind[order[new]], part)


def exchange_classes(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """(block, flags): for the distinct classes of a block, whether no earlier block has them and whether their anchor has others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, data, sizes in _rows(batches):
            c = around(data, sizes, n_ranges)
            present, begin = np.unique(c.part, return_index=True)
            cut = np.r_[begin, len(c.part)]
            rest = (c.anchor & _U(0xFFFFFFFF)).astype("<u4")
            n = len(present)
            yield pa.RecordBatch.from_arrays(
                [pa.array(present), pa.array([row["block"]] * n, pa.int64()), pa.array([row["first_id"]] * n, pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (rest, c.kind))],
                ["part", "block", "first_id", "anchors", "classes"],
            )

    def meet(group: pa.Table) -> pa.Table:
        turn = np.argsort(group["first_id"].to_numpy(), kind="stable")
        blobs = group["classes"].combine_chunks()
        sizes = pc.binary_length(blobs).to_numpy()[turn] // 8
        kind = np.frombuffer(b"".join(blobs[i].as_buffer() for i in turn.tolist()), dtype=np.uint64)
        owner = np.repeat(np.unique(group["first_id"].to_numpy()[turn], return_inverse=True)[1].astype(np.int32), sizes)
        order = np.argsort(kind, kind="stable").astype(np.int32)
        by = kind[order]
        new = np.r_[True, by[1:] != by[:-1]]
        del kind, by
        heads, mine = order[new], np.empty(len(order), dtype=np.int32)
        mine[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        first = owner == owner[heads][mine]
        blobs = group["anchors"].combine_chunks()
        anchor = np.frombuffer(b"".join(blobs[i].as_buffer() for i in turn.tolist()), dtype="<u4")[heads]
        order = np.argsort(anchor, kind="stable").astype(np.int32)
        same = np.zeros(len(order) + 1, dtype=bool)  # whether a class and the next one in order share the anchor
        same[1:-1] = anchor[order[1:]] == anchor[order[:-1]]
        several = np.zeros(len(order), dtype=bool)
        several[order] = same[1:] | same[:-1]
        several = several[mine]
        cut = np.cumsum(sizes)[:-1]
        bits = [np.packbits(np.r_[a, b]).tobytes() for a, b in zip(np.split(first, cut), np.split(several, cut), strict=True)]
        return pa.table({"part": group["part"], "block": group["block"].take(pa.array(turn)), "bits": pa.array(bits, pa.binary())})

    sent = blocks.select("block", "first_id", "sizes", "body").mapInArrow(send, "part long, block long, first_id long, anchors binary, classes binary")
    met = sent.groupBy("part").applyInArrow(meet, "part long, block long, bits binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("flags"))


def judge_blocks(blocks: DataFrame, flags: DataFrame, n_ranges: int) -> DataFrame:
    """What the exchange decides, and what it leaves to the pools.

    One row per block with ``edges``: begin and end of removed stretches in its body, as 64-bit integers.  One row per context that
    is still open with anchor, class, owner (its doc_id), start in the body, lead (the anchor's place) and, once per class, its bytes.
    """
    names = ["block", "edges", "anchor", "class", "owner", "start", "lead", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, data, sizes in _rows(batches):
            c = around(data, sizes, n_ranges)
            first, several = np.ones(len(c.kind), dtype=bool), np.zeros(len(c.kind), dtype=bool)
            for part in row["flags"] or []:
                a, b = np.searchsorted(c.part, part["part"]), np.searchsorted(c.part, part["part"], "right")
                bits = np.unpackbits(np.frombuffer(part["bits"], dtype=np.uint8), count=2 * (b - a)).astype(bool)
                first[a:b], several[a:b] = bits[: b - a], bits[b - a :]
            ids = np.array(row["doc_ids"], dtype=np.int64)[c.doc]
            least = np.full(len(c.kind), np.iinfo(np.int64).max)
            np.minimum.at(least, c.place, ids)
            gone = ~first[c.place] | (ids > least[c.place])
            edges = np.stack([c.begin[gone], c.end[gone]], axis=1)
            if len(edges):  # contexts come in order, so stretches that touch are merged in one pass
                cut = np.flatnonzero(edges[1:, 0] > np.maximum.accumulate(edges[:, 1])[:-1]) + 1
                edges = np.stack([edges[np.r_[0, cut], 0], np.maximum.reduceat(edges[:, 1], np.r_[0, cut])], axis=1)
            free = np.flatnonzero(~gone & several[c.place])
            new = np.zeros(len(free), dtype=bool)
            new[np.unique(c.place[free], return_index=True)[1]] = True
            at, begin, end, place = c.at[free], c.begin[free], c.end[free], c.place[free]
            raw = [row["body"][a:b] if n else None for a, b, n in zip(begin.tolist(), end.tolist(), new.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([edges.astype("<i8").tobytes()], pa.binary()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]] * len(free), pa.int64()), pa.nulls(len(free), pa.binary()), pa.array(c.anchor[place].view(np.int64)), pa.array(c.kind[place].view(np.int64)), pa.array(ids[free]), pa.array(begin), pa.array((at - begin).astype(np.int32)), pa.array(raw, pa.binary())], names
            )

    rows = blocks.join(flags, "block", "left").select("block", "doc_ids", "sizes", "body", "flags")
    return rows.mapInArrow(run, "block long, edges binary, anchor long, class long, owner long, start long, lead int, context binary")


def _one_key(*columns: np.ndarray) -> np.ndarray:
    """One integer per row that sorts like the rows of non-negative columns; columns too wide for 63 bits are numbered first."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        top = int(column.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * top >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + column
    return key


def _before(some: np.ndarray, others: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """How many of the others precede each of some; the columns to sort by hold the others first, both in order."""
    key = _one_key(*columns)
    return np.searchsorted(key[: len(others)], key[len(others) :])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover modulo three."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    padded = np.r_[s, 0, 0, 0].astype(np.int64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    key = _one_key(padded[sample], padded[sample + 1], padded[sample + 2])
    order = np.argsort(key)
    by, key = sample[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if names.max() < len(sample):
        sorted_sample = sample[suffix_array(names)]
    else:
        sorted_sample = by
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_one_key(padded[zero], rank[zero + 1]))]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    less = _before(zero, ones, padded[np.r_[ones, zero]], rank[np.r_[ones, zero] + 1])
    less = less + _before(zero, twos, *(x[np.r_[twos, zero] + k] for k, x in enumerate((padded, padded, rank))))
    out = np.empty(n, dtype=np.int64)
    at = less + np.arange(len(zero))
    out[at] = zero
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sorted_sample
    return out


def repeated_windows(texts: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each text the starts of its windows that also lie in a text with a smaller owner."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0" * SPAN, dtype=np.uint8)
    symbols = data[: int((sizes + 1).sum())].astype(np.int64) + 2
    symbols[begins + sizes] = 1
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    order = suffix_array(symbols)
    order = order[order - begins[text_of[order]] + SPAN <= sizes[text_of[order]]]
    if not len(order):
        return [np.zeros(0, dtype=np.int64)] * len(texts)
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # eight bytes from each place on
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        word = words[order + k]
        new[1:] |= word[1:] != word[:-1]
    starts = np.flatnonzero(new)
    owner = owners[text_of[order]]
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.r_[starts, len(order)]))
    hit = np.sort(order[owner > least])
    cut = np.searchsorted(hit, begins)
    return [hit[a:b] - begins[i] for i, (a, b) in enumerate(zip(cut, np.r_[cut[1:], len(hit)], strict=True))]


def may_repeat(texts: list[bytes], lead: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which contexts of a pool may hold a window that another context of the same anchor holds too.

    A window starts 0-8, 9-17 or 18-26 bytes before the anchor, so it covers one of three stretches around it; a context that
    shares none of its three stretches shares no window.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = Hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    out = np.zeros(len(texts), dtype=bool)
    for before, after in ((0, SPAN - 8), (9, SPAN - 17), (18, GRAM)):
        has = np.flatnonzero((lead >= before) & (lead + after <= sizes))
        at = begins[has] + lead[has]
        key = hashes.of(at - before, at + after) ^ _mix(anchor[has].view(np.uint64))
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        out[has[count[place] > 1]] = True
    return out


def judge_pools(found: DataFrame, n_pools: int) -> DataFrame:
    """(block, edges): stretches of the open contexts that lie in a document with a smaller id."""

    def run(group: pa.Table) -> pa.Table:
        anchor, kind, owner, block, start = (group[c].to_numpy() for c in ("anchor", "class", "owner", "block", "start"))
        empty = group["context"].is_null().to_numpy().astype(np.int8)
        order = np.lexsort((empty, kind, anchor))
        new = np.r_[True, (anchor[order[1:]] != anchor[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])]
        best, mine = order[new], np.empty(len(order), dtype=np.int64)
        mine[order] = np.cumsum(new) - 1
        texts = group["context"].take(pa.array(best)).to_pylist()
        pool = np.flatnonzero(may_repeat(texts, group["lead"].to_numpy()[best].astype(np.int64), anchor[best]))
        counts, hits = np.zeros(len(best), dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(pool):
            each = repeated_windows([texts[i] for i in pool], owner[best[pool]])
            counts[pool], hits = [len(x) for x in each], np.concatenate(each)
        n = counts[mine]
        at = np.repeat((np.cumsum(counts) - counts)[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        windows, home = hits[at] + np.repeat(start, n), np.repeat(block, n)
        order = np.lexsort((windows, home))
        windows, home = windows[order], home[order]
        new = np.ones(len(order), dtype=bool)  # windows of a block that overlap or touch become one stretch
        new[1:] = (home[1:] != home[:-1]) | (windows[1:] > windows[:-1] + SPAN)
        edges = np.stack([windows[new], windows[np.r_[new[1:], True][: len(new)]] + SPAN], axis=1).astype("<i8")
        held, cut = np.unique(home[new], return_index=True)
        blobs = [edges[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(edges)])]
        return pa.table({"block": pa.array(held, pa.int64()), "edges": pa.array(blobs, pa.binary())})

    rows = found.filter("anchor IS NOT NULL").select(F.pmod("anchor", F.lit(n_pools)).alias("pool"), "anchor", "class", "owner", "block", "start", "lead", "context")
    return rows.groupBy("pool").applyInArrow(run, "block long, edges binary")


def _results(row: dict, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, str]]:
    """doc_id, bytes, removed bytes, their runs and the digest of the rest, for the documents of a block."""
    edges = np.concatenate([np.frombuffer(e, dtype="<i8") for e in row["edges"] or []] or [np.zeros(0, dtype=np.int64)])
    change = np.bincount(edges[::2], minlength=len(data) + 1) - np.bincount(edges[1::2], minlength=len(data) + 1)
    gone = np.cumsum(change[:-1]) > 0
    end = 0
    for doc_id, size in zip(row["doc_ids"], sizes.tolist(), strict=True):
        begin, end = end, end + size
        out = gone[begin:end]
        runs = int(np.count_nonzero(np.diff(np.r_[False, out].astype(np.int8)) == 1))
        yield doc_id, size, int(out.sum()), runs, hashlib.sha256(data[begin:end][~out].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a 50-byte string that covers it also starts in a document with a smaller doc_id.  Null texts count as empty.
    Rows without doc_id neither lose bytes nor take any.  Rows that share a doc_id do not remove each other's bytes, and each loses
    what its own text shares with smaller ids.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    blocks = store(cut_blocks(docs, block_bytes), "blocks")
    free_shuffles(spark)
    total = blocks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_ranges = max(16, math.ceil(total / RANGE_BYTES))
    flags = store(exchange_classes(blocks, n_ranges), "flags")
    free_shuffles(spark)
    found = store(judge_blocks(blocks, flags, n_ranges), "contexts")
    drop_stored(flags)
    free_shuffles(spark)
    volume = found.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    sure = found.filter("edges IS NOT NULL").select("block", "edges")
    edges = store(sure.union(judge_pools(found, max(16, math.ceil(volume / POOL_BYTES)))), "edges")
    drop_stored(found)
    free_shuffles(spark)
    edges = edges.groupBy("block").agg(F.collect_list("edges").alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, data, sizes in _rows(batches):
            columns = zip(*_results(row, data, sizes), strict=True)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    searched = blocks.join(edges, "block", "left").select("doc_ids", "sizes", "body", "edges")
    searched = searched.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    none = F.lit(0).cast("long")
    other = docs.filter((F.octet_length(text) < SPAN) | F.col("doc_id").isNull())
    other = other.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    kind = docs.schema["doc_id"].dataType
    return searched.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(other)
