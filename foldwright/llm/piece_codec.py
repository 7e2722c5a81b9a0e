"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Merging takes the best-scored adjacent pair first, leftmost on ties, as the agenda of the published algorithm does.  A candidate
is a pair of neighbouring symbols at fixed character offsets of a document; it is skipped for good when the hash of (seed,
document key, offsets) falls under the dropout rate.  The draw belongs to the candidate, so a rerun, another partitioning or a
retried task gives the same pieces.

No piece of the supported models has a word mark after another character, so the stretches between word starts merge
independently.  All stretches of one length in a slice advance in step as matrices; long ones use an agenda of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import pieces

MARK = 0x2581
NEVER = np.int32(2**31 - 1)
UNKNOWN, MERGED = -1, -2
STEP_LENGTH = 24
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(key, left, middle, right) -> np.ndarray:
    """Uniform draws in [0, 2**32) of candidate merges."""
    x = key + left * np.uint64(0x9E3779B97F4A7C15) + middle * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9)
    return _mix(x) >> np.uint64(32)


@dataclass
class PieceTables:
    """A model as arrays: characters to symbols, merges in an open hash table, the bytes of every id."""

    symbols: np.ndarray  # code point -> symbol
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    byte_ids: np.ndarray
    single: dict[int, int]  # symbols of characters that are no piece themselves
    words: list[bytes]

    @classmethod
    def load(cls, path: str) -> PieceTables:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        names = [p.piece for p in model.pieces]
        usable = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(chr(MARK) in name.lstrip(chr(MARK)) for name in usable):
            raise ValueError("a piece with a word mark inside is not supported")
        byte_ids = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("lossless decoding needs a piece for every byte")
        symbols = np.full(0x110000, UNKNOWN, dtype=np.int32)
        single: dict[int, int] = {}
        for ch in sorted({c for name in usable for c in name}):
            if ch in usable:
                symbols[ord(ch)] = usable[ch][0]
            else:
                symbols[ord(ch)] = len(names) + len(single)
                single[len(names) + len(single)] = ord(ch)
        symbols[32] = symbols[MARK]
        symbols[MARK] = UNKNOWN  # a mark in the text itself is written as bytes, so that it decodes to itself
        id_of = {name: i for name, (i, _) in usable.items()} | {chr(cp): s for s, cp in single.items()}
        scores = sorted({-score for _, score in usable.values()})
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, ranks, ids = [], [], []
        if 2 * sum(len(name) - 1 for name in usable) > 8 * SLOTS:
            raise ValueError("the merge table is too small for this model")
        for name, (i, score) in usable.items():
            for cut in range(1, len(name)):
                a, b = id_of.get(name[:cut]), id_of.get(name[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank_of[-score])
                    ids.append(i)
        order = np.argsort(keys)
        words = [b""] * len(names)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                words[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                words[i] = p.piece.replace(chr(MARK), " ").encode()
        k, r, v = (np.array(x, dtype=t)[order] for x, t in ((keys, np.int64), (ranks, np.int32), (ids, np.int32)))
        slot_keys, slot_place = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.int32)
        rest = np.arange(len(k))
        at = cls.slot(k)
        while len(rest):  # linear probing, all pending keys at once
            free = slot_keys[at[rest]] < 0
            first = np.unique(at[rest][free], return_index=True)[1]
            chosen = rest[free][first]
            slot_keys[at[chosen]], slot_place[at[chosen]] = k[chosen], chosen
            rest = np.setdiff1d(rest, chosen, assume_unique=True)
            at[rest] = (at[rest] + 1) & (SLOTS - 1)
        return cls(symbols, slot_keys, np.r_[r, NEVER].astype(np.int32)[np.where(slot_keys < 0, len(r), slot_place)], np.r_[v, 0].astype(np.int32)[np.where(slot_keys < 0, len(v), slot_place)], byte_ids, single, words)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of the merge of each pair of symbols, or of an empty slot (rank NEVER)."""
        key = a.astype(np.int64) << 20 | b
        at = self.slot(key)
        wrong = np.flatnonzero((self.pair_keys[at] != key) & (self.pair_keys[at] >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (SLOTS - 1)
            wrong = wrong[(self.pair_keys[at[wrong]] != key[wrong]) & (self.pair_keys[at[wrong]] >= 0)]
        return at


def merge_rows(t: PieceTables, rows: np.ndarray, keys: np.ndarray, first: np.ndarray, limit: int) -> np.ndarray:
    """Merge equal-length stretches in step.  ``rows`` (n, length) symbols; returns ids with MERGED where a symbol went away.

    ``keys`` are the document keys and ``first`` the offsets of the stretches; candidates drawn under ``limit`` are skipped.
    """
    n, length = rows.shape
    if length == 1 or n == 0:
        return rows
    # row-major cells; every array below is addressed by row * length + column
    symbol = rows.ravel().copy()
    after = np.tile(np.arange(1, length + 1, dtype=np.int32), n)
    before = np.tile(np.arange(-1, length - 1, dtype=np.int32), n)
    best = np.full((n, length), NEVER, dtype=np.int32)

    def rank(slots, row, left, middle, right):
        found = t.pair_ranks[slots]
        if limit:
            at = np.flatnonzero(found < NEVER)
            base, u = first[row[at]], np.uint64
            skip = draws(keys[row[at]], (base + left[at]).astype(u), (base + middle[at]).astype(u), (base + right[at]).astype(u)) < u(limit)
            found[at[skip]] = NEVER
        return found

    grid = symbol.reshape(n, length)
    wide = np.tile(np.arange(length - 1, dtype=np.int32), n)
    start = t.merges(grid[:, :-1].ravel(), grid[:, 1:].ravel())
    best[:, :-1] = rank(start, np.repeat(np.arange(n), length - 1), wide, wide + 1, wide + 2).reshape(n, length - 1)
    row, flat = np.arange(n), best.ravel()
    while True:
        j = best.argmin(axis=1) if len(row) == n else best[row].argmin(axis=1)
        cell = row * length + j
        on = flat[cell] < NEVER
        if not on.all():
            row, j, cell = row[on], j[on], cell[on]
            if not len(row):
                return symbol.reshape(n, length)
        base = cell - j
        other = base + after[cell]
        symbol[cell] = t.pair_ids[t.merges(symbol[cell], symbol[other])]
        symbol[other] = MERGED
        flat[other] = NEVER
        far = after[other]
        after[cell] = far
        # the merged symbol with the one after it
        has = far < length
        some, here, there = row[has], cell[has], (base + far)[has]
        flat[cell] = NEVER
        before[there] = j[has]
        flat[here] = rank(t.merges(symbol[here], symbol[there]), some, j[has], far[has], after[there])
        # and with the one before it
        left = before[cell]
        has = left >= 0
        some, here, there = row[has], (base + left)[has], cell[has]
        flat[here] = rank(t.merges(symbol[here], symbol[there]), some, left[has], j[has], far[has])


def merge_agenda(t: PieceTables, row: np.ndarray, key: np.uint64, base: int, limit: int) -> np.ndarray:
    """One long stretch with a heap as agenda; same results as :func:`merge_rows`."""
    symbol = row.tolist()
    length = len(symbol)
    after, before = list(range(1, length + 1)), list(range(-1, length - 1))
    u = np.uint64
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        lefts = [a for a in lefts if a >= 0 and after[a] < length]
        if not lefts:
            return
        rights = [after[a] for a in lefts]
        ends = [after[b] for b in rights]
        slots = t.merges(np.array([symbol[a] for a in lefts]), np.array([symbol[b] for b in rights]))
        ranks = t.pair_ranks[slots]
        skip = np.zeros(len(lefts), dtype=bool)
        if limit:
            skip = draws(key, u(base) + np.array(lefts, dtype=u), u(base) + np.array(rights, dtype=u), u(base) + np.array(ends, dtype=u)) < u(limit)
        for a, b, e, r, s, no in zip(lefts, rights, ends, ranks.tolist(), slots.tolist(), skip.tolist(), strict=True):
            if r < NEVER and not no:
                heapq.heappush(heap, (r, a, b, e, s))

    offer(list(range(length - 1)))
    while heap:
        _, a, b, e, s = heapq.heappop(heap)
        if symbol[a] == MERGED or after[a] != b or symbol[b] == MERGED or after[b] != e:
            continue  # one side has merged with another neighbour
        symbol[a], symbol[b] = int(t.pair_ids[s]), MERGED
        after[a] = e
        if e < length:
            before[e] = a
        offer([before[a], a])
    return np.array(symbol, dtype=np.int32)


def encode_texts(t: PieceTables, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has.  ``keys``: a 64-bit number per document."""
    limit = int(round(dropout * 2**32))
    filled = [" " + x if x else "" for x in texts]
    lengths = np.fromiter(map(len, filled), dtype=np.int64, count=len(filled))
    cps = np.frombuffer("".join(filled).encode("utf-32-le"), dtype=np.uint32)
    if not len(cps):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    symbol = t.symbols[cps]
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    mark = symbol == t.symbols[32]
    unknown = symbol == UNKNOWN
    edge = np.ones(len(cps), dtype=bool)
    edge[1:] = (owner[1:] != owner[:-1]) | unknown[1:] | unknown[:-1] | (mark[1:] & ~mark[:-1])
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.r_[starts, len(cps)])
    doc_of = owner[starts]
    first = starts - begin[doc_of]
    keyed = keys.astype(np.uint64)
    out = symbol.copy()
    for size in np.unique(sizes[sizes > 1]).tolist():
        which = np.flatnonzero(sizes == size)
        if size > STEP_LENGTH:
            for w in which.tolist():
                at = starts[w]
                out[at : at + size] = merge_agenda(t, symbol[at : at + size], keyed[doc_of[w]], int(first[w]), limit)
            continue
        for part in np.array_split(which, max(1, len(which) * size // 400_000)):
            grid = starts[part][:, None] + np.arange(size)
            out[grid] = merge_rows(t, symbol[grid], keyed[doc_of[part]], first[part], limit)
    count = (out >= 0).astype(np.int64)
    loose = (out == UNKNOWN) | (out >= len(t.words))
    width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    count[loose] = width[loose]
    place = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), dtype=np.int32)
    plain = (out >= 0) & ~loose
    ids[place[plain]] = out[plain]
    cp, w, p = cps[loose], width[loose], place[loose]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)
    for k in range(4):
        has = w > k
        shift = (6 * (w[has] - 1 - k)).astype(np.uint32)
        bits = cp[has] >> shift
        value = np.where(w[has] == 1, bits, np.where(k == 0, lead[w[has]] | bits, 0x80 | (bits & 0x3F)))
        ids[p[has] + k] = t.byte_ids[value]
    return ids, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def decode_ids(t: PieceTables, ids: list[int]) -> str:
    """The text of one document: bytes of the pieces without the leading word mark."""
    raw = b"".join(map(t.words.__getitem__, ids))
    return raw[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to the ``keep`` columns (doc_id).

    Null texts count as empty; an empty text has no ids.  Rows with equal ids and texts get equal pieces; a null id is a key like
    any other.  With dropout 0 the pieces are those of the model itself.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(PieceTables.load(model_path))  # bounded by the vocabulary
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch, texts in pieces(batches, "__text", 1 << 19):
            keys = batch.column(batch.schema.get_field_index("__key")).to_numpy()
            ids, counts = encode_texts(tables, texts, keys.view(np.uint64), dropout)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists], [*keep, "ids"])

    rows = docs.select(*keep, F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__key"), F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, ids array<int>")


def decoder(spark, model_path: str):
    """Column function from ids to text."""
    shared = spark.sparkContext.broadcast(PieceTables.load(model_path))  # bounded by the vocabulary

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        tables = shared.value
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        return pa.array([decode_ids(tables, flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())

    return run


def id_bytes_crc32() -> Column:
    """Column function: unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())

    return run


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text_sha256, decoded_sha256, lossless of every row."""
    encoded = encode(docs, model_path, dropout, seed, ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    decoded = encoded.select("doc_id", text.alias("text"), "ids", decoder(docs.sparkSession, model_path)("ids").alias("decoded"), id_bytes_crc32()("ids").alias("ids_crc32"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("text", 256).alias("text_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"),
    )
