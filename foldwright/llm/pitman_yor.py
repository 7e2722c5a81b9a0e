"""Hierarchical Pitman-Yor language model: texts scored by seatings of Chinese restaurants.

Every preceding word is the context of a restaurant; its customers are the words that follow, its dishes the different ones.  The first
customer of each table is a customer of the parent that all contexts share, the restaurant of single words, whose tables draw from the
uniform distribution over the known words and one unknown.  A Gibbs sweep lets, dish by dish, all customers of a dish get up and be
seated anew, given the tables of the other dishes and the parent's distribution; then the parent's customers, which are the tables of
all contexts, are seated.  Both levels see the other one as of the last sweep, so that blocks of restaurants are seated side by side.  A
dish with one customer has one table in every seating; only the others are seated.  Predictive probabilities are averaged over the last
sweeps.

Words and pairs are counted over all training texts; nothing is cut off.  Texts are numbered once, in slices.  Slices, blocks of words
and blocks of pairs send each other packed arrays (:data:`MESSAGE`), grouped by receiver; blocks grow in number with the corpus, and the
pairs of a context with more than 1 / HOT of all tokens are spread over blocks by the following word.  The driver sees totals and the at
most HOT such contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import free_shuffles, remainder, pieces
from foldwright.session import scratch_path, ship_package

SLICE_BYTES = 8 << 20
BLOCK_TOKENS = 1 << 21
HOT = 4096
BURN_IN, SAMPLES = 1, 2
STRENGTH = 1.0
SEED = 20240607

#: A message to block ``block`` from block or slice ``peer``; x and y are summed on the driver where a kind uses them.
MESSAGE = "block long, kind int, peer long, x double, y double, data array<binary>"
_FIELDS = [("block", pa.int64()), ("kind", pa.int32()), ("peer", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("data", pa.list_(pa.binary()))]
COUNTS, WORDS, PAIRS, CODES, REPEATED, SINGLES, STATE, REPLY, SEATS, SUMS, ASKED, WORD_REPLY, PAIR_REPLY = range(13)

Message = tuple[int, int, int, float, float, list[np.ndarray]]


def _named(text: bytes) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), dtype=np.uint64)[0]


START, END = _named(b" start"), _named(b" end")  # no word holds a space


# ---------------------------------------------------------------- packed arrays

def pack(a: np.ndarray) -> bytes:
    """One array, compressed byte place by byte place; integers are narrowed to the smallest type that holds them.  Where most values
    but few are small, wide ones would make all of them wide: their places are nearly empty and cost little."""
    if a.dtype.kind in "iu" and a.dtype != np.uint64 and len(a):
        a = a.astype(np.min_scalar_type(int(a.max())))
    places = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return a.dtype.str[1:].encode() + zstandard.ZstdCompressor(level=1).compress(places.data if places.size else b"")


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:2].decode())
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(places.T).view(kind).ravel()


def _batch(messages: Iterable[Message]) -> pa.RecordBatch:
    rows = [(b, k, p, x, y, [pack(a) for a in arrays]) for b, k, p, x, y, arrays in messages]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def exchange(messages: DataFrame, fn: Callable[[int, dict[int, list[tuple[int, list[np.ndarray]]]]], Iterable[Message]]) -> DataFrame:
    """Messages sent by every block that gets the ``messages``: ``fn(block, {kind: [(peer, arrays), ...]})``, peers in order."""

    def run(table: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for kind, peer, data in sorted(zip(table["kind"].to_pylist(), table["peer"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda m: m[:2]):
            got.setdefault(kind, []).append((peer, [unpack(d) for d in data]))
        return pa.Table.from_batches([_batch(fn(table["block"][0].as_py(), got))])

    return messages.groupBy("block").applyInArrow(run, MESSAGE)


class _Stored:
    """Messages written under the checkpoint folder, one folder per kind; read and dropped by kind."""

    def __init__(self, messages: DataFrame, name: str):
        self.spark = messages.sparkSession
        self.path = scratch_path(self.spark, name)
        messages.write.partitionBy("kind").option("compression", "none").parquet(self.path)
        schema = self.spark.createDataFrame([], MESSAGE).select("block", "peer", "x", "y", "data", "kind").schema
        self.table = self.spark.read.schema(schema).parquet(self.path)

    def __getitem__(self, kind: int) -> DataFrame:
        return self.table.filter(F.col("kind") == kind).select("block", "kind", "peer", "x", "y", "data")

    def drop(self, *kinds: int) -> None:
        for kind in kinds:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kind={kind}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- slices of numbered texts

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def number_texts(docs: DataFrame, held: Column) -> DataFrame:
    """Slices of whole texts: (slice, docs, held, lengths, words, tokens, n_tokens).

    ``words`` holds the sorted 64-bit names of the different words, ``tokens`` their places, text after text, each with its end.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, out, held_out, size = [], [], [], 0
        numbers = _Numbers({b" end": 0, b" start": 1})

        def flush() -> pa.RecordBatch:
            nonlocal count, size
            names = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in numbers), dtype=np.uint64)
            words, place = np.unique(names, return_inverse=True)
            tokens = place.astype(np.int32)[np.concatenate(out)]
            lengths = np.array([len(t) for t in out], dtype=np.int64)
            row = [[(part << 32) + count], [pa.concat_arrays(ids)], [held_out], [pack(lengths)], [pack(words)], [pack(tokens)], [len(tokens)]]
            count, size = count + 1, 0
            types = [pa.int64(), pa.list_(ids[0].type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            row[1] = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([r if isinstance(r, pa.Array) else pa.array(r, t) for r, t in zip(row, types, strict=True)], ["slice", "docs", "held", "lengths", "words", "tokens", "n_tokens"])

        for batch, texts in pieces(batches, "text"):
            ids.append(batch.column(0))
            held_out += batch.column(2).to_pylist()
            for text in texts:
                body = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone splits
                body.append(b" end")
                out.append(np.fromiter(map(numbers.__getitem__, body), dtype=np.int32, count=len(body)))
                size += len(text)
            if size >= SLICE_BYTES:
                yield flush()
                ids, out, held_out = [], [], []
                numbers = _Numbers({b" end": 0, b" start": 1})
        if out:
            yield flush()

    fields = f"slice long, docs array<{id_type}>, held array<boolean>, lengths binary, words binary, tokens binary, n_tokens long"
    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, fields)


@dataclass
class _Slice:
    """One slice unpacked, with the place of its start and end words."""

    number: int
    held: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Slice:
        return cls(row["slice"], np.array(row["held"], dtype=bool), unpack(row["lengths"]).astype(np.int64), unpack(row["words"]), unpack(row["tokens"]).astype(np.int64))

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = np.searchsorted(self.words, START)
        return before


def _send_slices(slices: DataFrame, fn: Callable[[_Slice], Iterable[Message]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _batch(fn(_Slice.of(batch.slice(k, 1).to_pylist()[0])))

    return slices.select("slice", "held", "lengths", "words", "tokens").mapInArrow(run, MESSAGE)


# ---------------------------------------------------------------- blocks

def _word_block(words: np.ndarray, bits: int) -> np.ndarray:
    """Blocks are ranges of names, so sorted words lie block by block."""
    return (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), dtype=np.int64)


def _by_block(words: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(block, range) of the sorted ``words``."""
    block = _word_block(words, bits)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, dtype=np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=False):
        yield int(block[a]), slice(a, b)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _pair_block(context: np.ndarray, word: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """A context's block, or one of 64 by the following word where the context is hot."""
    spread = _mix(context ^ _mix((word & np.uint64(63)) + np.uint64(1)))
    place = np.minimum(np.searchsorted(hot, context), max(len(hot) - 1, 0))
    return _word_block(np.where(hot[place] == context, spread, context) if len(hot) else context, bits)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def _pairs(s: _Slice, bits: int, hot: np.ndarray):
    """Different (context, word) pairs of a slice in block order: places, block, training count; and the pair of every token."""
    key = s.contexts() << 32 | s.tokens << 1 | s.training()
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.r_[True, key[1:] >> 1 != key[:-1] >> 1]
    first = np.flatnonzero(fresh)
    count = np.add.reduceat(key & 1, first)
    u, w = key[first] >> 32, (key[first] & 0xFFFFFFFF) >> 1
    block = _pair_block(s.words[u], s.words[w], bits, hot)
    dealt = np.argsort(block, kind="stable")
    place = np.empty(len(dealt), dtype=np.int64)
    place[dealt] = np.arange(len(dealt))
    which = np.empty(len(order), dtype=np.int64)
    which[order] = place[np.cumsum(fresh) - 1]
    return u[dealt], w[dealt], block[dealt], count[dealt], which


def seat(customers: np.ndarray, weight: np.ndarray, growth: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers are seated one after another.

    With n customers at t tables the next one opens a table with odds (weight + growth * t) to n - discount * t.  From the 65th
    customer on, a 32nd of those seated come in at a time and see the same odds.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    seated, step = 1, 1
    active = np.flatnonzero(customers > 1)
    while len(active):
        step = max(1, seated // 32) if seated >= 64 else 1
        coming = np.minimum(customers[active] - seated, step)
        new = weight[active] + growth[active] * tables[active]
        odds = new / (new + (seated + (coming - 1) / 2) - discount * tables[active])
        tables[active] += rng.binomial(coming, np.clip(odds, 0, 1)) if step > 1 else rng.random(len(active)) < odds
        seated += step
        active = active[customers[active] > seated]
    return tables


@dataclass
class _Totals:
    """Numbers that every block needs: training tokens, known words, discounts, and the shared restaurant's customers and tables."""

    tokens: int
    known: int
    discount: float
    root_discount: float = 0.75
    strength: float = STRENGTH
    customers: float = 0.0
    tables: float = 0.0

    def shared(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of a word in the restaurant of single words."""
        fresh = (self.strength + self.root_discount * self.tables) / (self.known + 1)
        return (customers - self.root_discount * tables + fresh) / (self.strength + self.customers)


# ---------------------------------------------------------------- the model

def _count_words(slices: DataFrame, bits: int) -> DataFrame:
    """WORDS per word block: words and training counts; the start counts training texts.  x, y: tokens and known words."""

    def send(s: _Slice) -> Iterator[Message]:
        count = np.bincount(s.tokens[s.training()], minlength=len(s.words))
        count[np.searchsorted(s.words, START)] = int((~s.held).sum())
        known = np.flatnonzero(count)
        for block, at in _by_block(s.words[known], bits):
            yield block, COUNTS, s.number, 0.0, 0.0, [s.words[known][at], count[known][at]]

    def add(block: int, got: dict) -> Iterator[Message]:
        words, count = _sums(*(np.concatenate([a[i] for _, a in got[COUNTS]]) for i in (0, 1)))
        real = words != START
        yield block, WORDS, block, float(count[real].sum()), float(real.sum()), [words, count]

    return exchange(_send_slices(slices, send), add)


def _hot_contexts(words: DataFrame, least: float) -> np.ndarray:
    """Contexts with more than ``least`` customers, a HOT-th of all: fewer than HOT + 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                names, count = map(unpack, data)
                yield pa.RecordBatch.from_arrays([pa.array(names[count > least].view(np.int64))], ["word"])

    return np.sort(words.select("data").mapInArrow(run, "word long").toArrow()["word"].to_numpy().view(np.uint64))


def _count_pairs(slices: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """Per pair block: CODES to answer each slice (0 unseen, 1 seen once, 2 + place among REPEATED), REPEATED pairs, and SINGLES per
    word block: of the pairs seen once, how many a word begins and ends.  x, y of REPEATED: pairs seen once and twice."""

    def send(s: _Slice) -> Iterator[Message]:
        u, w, block, count, _ = _pairs(s, bits, hot)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            begin = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
            yield int(block[a]), PAIRS, s.number, 0.0, 0.0, [s.words[u[a:b][begin]], np.diff(np.r_[begin, b - a]), s.words[w[a:b]], count[a:b]]

    def add(block: int, got: dict) -> Iterator[Message]:
        parts = got[PAIRS]
        u = np.concatenate([np.repeat(a[0], a[1]) for _, a in parts])
        w, n = (np.concatenate([a[i] for _, a in parts]) for i in (2, 3))
        sizes = [len(a[2]) for _, a in parts]
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        fresh = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]
        first = np.flatnonzero(fresh)
        u, w, total = u[first], w[first], np.add.reduceat(n[order].astype(np.int64), first)
        often, once = total > 1, total == 1
        code = np.minimum(total, 1)
        code[often] = 2 + np.arange(often.sum())
        codes = np.empty(len(order), dtype=np.int64)
        codes[order] = code[np.cumsum(fresh) - 1]
        for (peer, _), end, size in zip(parts, np.cumsum(sizes).tolist(), sizes, strict=True):
            yield block, CODES, peer, 0.0, 0.0, [codes[end - size : end]]
        words = np.unique(np.concatenate([u[often], w[often]]))
        places = [np.searchsorted(words, u[often]), np.searchsorted(words, w[often])]
        yield block, REPEATED, block, float(once.sum()), float((total == 2).sum()), [words, *places, total[often]]
        ones = np.ones(int(once.sum()), dtype=np.int64)
        words, begins, ends = _sums(np.concatenate([u[once], w[once]]), np.r_[ones, 0 * ones], np.r_[0 * ones, ones])
        for target, at in _by_block(words, bits):
            yield target, SINGLES, block, 0.0, 0.0, [words[at], begins[at], ends[at]]

    return exchange(_send_slices(slices, send), add)


def _join_singles(block: int, got: dict) -> Iterator[Message]:
    """STATE without repeated pairs: words, training counts, tables as context and as word."""
    words, count = got[WORDS][0][1]
    begins, ends = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for _, (names, b, e) in got.get(SINGLES, []):
        at = np.searchsorted(words, names)
        begins[at] += b
        ends[at] += e
    yield block, STATE, block, 0.0, 0.0, [words, count, begins, ends]


def _seat_parent(bits: int, totals: _Totals, sweep: int, seating: Callable):
    """Per word block: all tables of contexts come together; STATE (words, counts, tables as context, customers, tables) and a REPLY to
    every pair block.  x, y of STATE: customers and tables of the shared restaurant."""

    def run(block: int, got: dict) -> Iterator[Message]:
        words, count, begins, ends = got[STATE][0][1]
        tables, customers = begins.astype(np.int64), ends.astype(np.int64)
        places = []
        for peer, (names, b, e) in got.get(SUMS, []):
            at = np.searchsorted(words, names)
            tables[at] += b
            customers[at] += e
            places.append((peer, at))
        weight = np.full(len(words), (totals.strength + totals.root_discount * max(totals.tables, totals.known)) / (totals.known + 1))
        own = seating(customers, weight, np.zeros(len(words)), totals.root_discount, np.random.default_rng([SEED, sweep, 0, block]))
        yield block, STATE, sweep, float(customers.sum()), float(own.sum()), [words, count, tables, customers, own]
        for peer, at in places:
            yield peer, REPLY, block, 0.0, 0.0, [tables[at], customers[at], own[at]]

    return run


def _seat_contexts(bits: int, totals: _Totals, sweep: int, sampled: bool, seating: Callable):
    """Per pair block: repeated pairs are seated anew; SEATS (tables now, sum over sampled sweeps) and SUMS to every word block."""

    def run(block: int, got: dict) -> Iterator[Message]:
        words, u, w, count = got[REPEATED][0][1]
        if sweep < 0:
            now, summed = np.ones(len(u), dtype=np.int64), np.zeros(len(u), dtype=np.int64)
        else:
            tables, customers, own = (np.concatenate([a[i] for _, a in got[REPLY]]) if len(words) else words for i in range(3))
            before, summed = got[SEATS][0][1]
            base = totals.shared(customers, own)[w]
            weight = (totals.strength + totals.discount * (tables[u] - before.astype(np.float64))) * base
            now = seating(count.astype(np.int64), weight, totals.discount * base, totals.discount, np.random.default_rng([SEED, sweep, 1, block]))
            summed = summed + now if sampled else summed
        yield block, SEATS, block, 0.0, 0.0, [now, summed]
        begins, ends = (np.bincount(x, weights=now, minlength=len(words)).astype(np.int64) for x in (u, w))
        for target, at in _by_block(words, bits):
            yield target, SUMS, block, 0.0, 0.0, [words[at], begins[at], ends[at]]

    return run


def _filled(seen: np.ndarray, customers: np.ndarray, tables: np.ndarray, samples: int) -> list[np.ndarray]:
    """Customers and summed tables of pairs seen never (0), once (1) or often (2); those of the last are given."""
    out = [np.array(few, dtype=np.int64)[seen] for few in ([0, 1, 0], [0, samples, 0])]
    for all_pairs, given in zip(out, (customers, tables), strict=True):
        all_pairs[seen == 2] = given
    return out


def _sum(df: DataFrame) -> tuple[float, float]:
    x, y = df.agg(F.sum("x"), F.sum("y")).first()
    return x or 0.0, y or 0.0


def score_texts(docs: DataFrame, held: Column, burn_in: int = BURN_IN, samples: int = SAMPLES, seating: Callable = seat) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; rows that are not ``held`` train.

    Words are runs of characters other than ASCII white space, A-Z in lower case; an end follows each text and counts as a token.  A
    text that is null, empty or blank has its end alone.  base_score is the add-one score of single words, score the model's; both are
    sums of log10.  An unknown word has the unknown's probability, an unknown context the shared distribution.  Rows are texts of
    their own, also where ids are null or shared; other columns are ignored.  Without training rows there is one unknown word with
    probability one (scores 0); an empty table gives an empty result.  Words are told apart by 64-bit names.  Reruns agree when the
    table is read in the same partitions.  ``seating`` draws tables as :func:`seat` does.  Memory follows a slice of SLICE_BYTES or the longest text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slices_path = scratch_path(spark, "slices")
    numbered = number_texts(docs, held)
    numbered.write.option("compression", "none").parquet(slices_path)
    slices = spark.read.schema(numbered.schema).parquet(slices_path)
    total = slices.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(3, int(total // BLOCK_TOKENS).bit_length())
    words = _Stored(_count_words(slices, bits), "words")
    tokens, known = _sum(words[WORDS])
    hot = _hot_contexts(words[WORDS], tokens / HOT)
    pairs = _Stored(_count_pairs(slices, bits, hot), "pairs")
    free_shuffles(spark)
    once, twice = _sum(pairs[REPEATED])
    free_shuffles(spark)  # again, as the plan of a write is let go only after the write has been reported
    totals = _Totals(int(tokens), int(known), discount=min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5)
    state = _Stored(exchange(_all(words[WORDS], pairs[SINGLES]), _join_singles), "state")
    words.drop(WORDS)
    pairs.drop(SINGLES)
    seats = _Stored(exchange(pairs[REPEATED], _seat_contexts(bits, totals, -1, False, seating)), "seats")
    sampled: list[tuple[_Totals, _Stored]] = []
    for sweep in range(burn_in + samples + 1):
        parent = _Stored(exchange(_all(state[STATE], seats[SUMS]), _seat_parent(bits, totals, sweep, seating)), "parent")
        customers, tables = _sum(parent[STATE])
        free_shuffles(spark)
        totals = _Totals(totals.tokens, totals.known, totals.discount, customers=customers, tables=tables)
        if sweep < burn_in + samples:
            new = _Stored(exchange(_all(pairs[REPEATED], parent[REPLY], seats[SEATS]), _seat_contexts(bits, totals, sweep, sweep >= burn_in, seating)), "seats")
            seats.drop(SEATS, SUMS)
            seats = new
        parent.drop(REPLY)
        if sweep > burn_in:
            sampled.append((totals, parent))
        else:
            parent.drop(STATE)
        free_shuffles(spark)
    state.drop(STATE)
    seats.drop(SUMS)
    return _scores(docs, slices, pairs, seats, sampled, bits, hot)


def _scores(docs: DataFrame, slices: DataFrame, pairs: _Stored, seats: _Stored, sampled: list, bits: int, hot: np.ndarray) -> DataFrame:
    all_totals = [t for t, _ in sampled]

    def ask(s: _Slice) -> Iterator[Message]:
        for block, at in _by_block(s.words, bits):
            yield block, ASKED, s.number, 0.0, 0.0, [s.words[at]]

    def answer_words(block: int, got: dict) -> Iterator[Message]:
        states = [a for _, a in got.get(STATE, [])]
        for peer, (names,) in got.get(ASKED, []):
            out: list[np.ndarray] = []
            for words, count, *rest in states or [[np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 4] * len(all_totals):
                at = np.minimum(np.searchsorted(words, names), max(len(words) - 1, 0))
                found = words[at] == names if len(words) else np.zeros(len(names), dtype=bool)
                pick = lambda v: np.where(found, v[at], 0) if len(v) else np.zeros(len(names), np.int64)  # noqa: B023, E731
                out += ([] if out else [pick(count)]) + [pick(v) for v in rest]
            yield peer, WORD_REPLY, block, 0.0, 0.0, out

    def answer_pairs(block: int, got: dict) -> Iterator[Message]:
        count, summed = got[REPEATED][0][1][3], got[SEATS][0][1][1]
        customers, tables = np.r_[0, 1, count.astype(np.int64)], np.r_[0, len(all_totals), summed.astype(np.int64)]
        for peer, (codes,) in got.get(CODES, []):
            often = codes[codes > 1]
            yield peer, PAIR_REPLY, block, 0.0, 0.0, [np.minimum(codes, 2), customers[often], tables[often]]

    word_replies = exchange(_all(_send_slices(slices, ask), *(p[STATE] for _, p in sampled)), answer_words)
    pair_replies = exchange(_all(pairs[CODES], pairs[REPEATED], seats[SEATS]), answer_pairs)
    replies = _Stored(_all(word_replies, pair_replies), "replies")
    pairs.drop(CODES, REPEATED)
    seats.drop(SEATS)
    for _, parent in sampled:
        parent.drop(STATE)
    free_shuffles(docs.sparkSession)
    replies[WORD_REPLY].isEmpty()
    free_shuffles(docs.sparkSession)
    sent = _all(replies[WORD_REPLY], replies[PAIR_REPLY]).select(F.col("block").alias("slice"), "kind", "peer", "data")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    t = all_totals[0]
    discount, strength = t.discount, t.strength

    def score(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.slice(0, 1)
        s = _Slice.of({c: row[c][0].as_py() for c in ("slice", "held", "lengths", "words", "tokens")})
        u, w, _, _, which = _pairs(s, bits, hot)
        got: dict[int, list] = {WORD_REPLY: [], PAIR_REPLY: []}
        for kind, _, data in sorted(zip(answers["kind"].to_pylist(), answers["peer"].to_pylist(), answers["data"].to_pylist(), strict=True), key=lambda m: m[:2]):
            got[kind].append([unpack(d) for d in data])
        got[PAIR_REPLY] = [_filled(*arrays, len(all_totals)) for arrays in got[PAIR_REPLY]]
        count, *parts = (np.concatenate(c).astype(np.float64) for c in zip(*got[WORD_REPLY], strict=True))
        customers, tables = (np.concatenate(c).astype(np.float64) for c in zip(*got[PAIR_REPLY], strict=True))
        n = len(all_totals)
        value = customers - discount * tables / n
        for k, now in enumerate(all_totals):
            opened, of, at = parts[3 * k : 3 * k + 3]
            value += (strength + discount * opened[u]) * now.shared(of, at)[w] / n
        logs = np.log10(value / (strength + count[u]))[which]
        base = np.log10((count + 1) / (t.tokens + t.known + 1))[s.tokens]
        begin = np.cumsum(s.lengths) - s.lengths
        add = lambda v: pa.array(np.add.reduceat(v, begin))
        out = [row["docs"].combine_chunks().flatten(), pa.array(s.held), pa.array(s.lengths), add((count > 0)[s.tokens].astype(np.int64)), pa.array(np.full(len(begin), t.tokens)), add(base), add(logs)]
        return pa.Table.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slices.groupBy("slice").cogroup(sent.groupBy("slice")).applyInArrow(score, fields)


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    return score_texts(docs, remainder("doc_id", 7) == 2)
