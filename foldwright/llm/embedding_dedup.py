"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learnt on a bounded sample turns vectors into balanced binary codes.  A code is cut into TABLES chunks; codes that
differ in fewer than 2 * TABLES bits agree in some chunk up to one bit.  Such chunks agree in one of their halves, so vectors of
equal halves meet in one task, which finds those whose other halves are at most one bit away.  How many bits pairs at the least cosine differ in depends on the vectors: a common direction moves them
apart once codes are centred.  So pairs at exactly that cosine are planted around the sample, and further rotations with tables of
their own are added until LEAST_RECALL of them are shown; where MAX_CODES rotations do not suffice, all pairs of a label are
compared in blocks.  A pair is taken from the first table that shows it; the cosine of the original vectors decides.  Equal
vectors of one label are merged first and counted, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import drop_stored, free_shuffles, store
from foldwright.llm.graph import components
from foldwright.session import collect_bounded

SAMPLE = 20_000
STRETCH_BITS = 12
BITS = 64
TABLES = 4
CHUNK = BITS // TABLES
HALF = CHUNK // 2
HALVES = 2 * TABLES
ROWS = 1 << 16
COMPONENTS = 1 << 18
PAIRS = 1 << 18
MAX_CODES = 16
PLANTED = 8000
LEAST_RECALL = 0.995
BLOCK = 2048
MAX_WIDTHS = 64


@dataclass
class BinaryCodes:
    mean: np.ndarray
    projection: np.ndarray  # (width, BITS)

    @classmethod
    def fit(cls, vectors: np.ndarray, rounds: int = 40, seed: int = 7) -> BinaryCodes:
        """Principal directions rotated so that signs lose as little as possible; narrow vectors get several rotations."""
        width = vectors.shape[1]
        mean = vectors.mean(axis=0)
        centred = vectors - mean
        _, _, directions = np.linalg.svd(centred.T @ centred)
        rng = np.random.default_rng(seed)
        parts, left = [], BITS
        while left > 0:
            k = min(left, width)
            base = directions[:k].T
            x = centred @ base
            rotation = np.linalg.qr(rng.standard_normal((k, k)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(x @ rotation).T @ x)
                rotation = (u @ vt).T
            parts.append(base @ rotation)
            left -= k
        return cls(mean, np.concatenate(parts, axis=1))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((vectors - self.mean) @ self.projection > 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def planted_pairs(vectors: np.ndarray, least: float, n: int = PLANTED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample and others at exactly the least cosine, half of them off in any direction, half as vectors differ."""
    rng = np.random.default_rng(seed)
    x = vectors[rng.integers(0, len(vectors), n)]
    aside = rng.standard_normal(x.shape)
    half = n // 2
    apart = vectors[rng.integers(0, len(vectors), half)] - vectors[rng.integers(0, len(vectors), half)]
    apart -= (apart * x[:half]).sum(axis=1, keepdims=True) * x[:half]
    differs = np.linalg.norm(apart, axis=1) > 1e-6
    aside[:half][differs] = apart[differs]
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    return x, least * x + np.sqrt(max(0.0, 1 - least * least)) * aside


def shown(apart: np.ndarray) -> np.ndarray:
    """Whether codes that differ in these bits meet in some table."""
    chunks = apart.view(np.uint64)[:, None] >> np.arange(0, BITS, CHUNK, dtype=np.uint64) & np.uint64((1 << CHUNK) - 1)
    return (np.bitwise_count(chunks) <= 1).any(axis=1)


def fit_codes(vectors: np.ndarray, least: float) -> tuple[list[BinaryCodes], int] | None:
    """Enough rotations for LEAST_RECALL, and the most bits in which planted pairs differ; None if MAX_CODES do not suffice."""
    x, y = planted_pairs(vectors, least)
    models: list[BinaryCodes] = []
    met, bits = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    while len(models) < MAX_CODES:
        models.append(BinaryCodes.fit(vectors, seed=7 + len(models)))
        apart = models[-1].encode(x) ^ models[-1].encode(y)
        met |= shown(apart)
        bits += np.bitwise_count(apart.view(np.uint64))
        if met.mean() >= LEAST_RECALL:
            return models, int(bits.max())
    return None


def shortlist(rows: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """At most 2 * n rows, among them the n smallest by the 64-bit keys; more only where all keys of more than n rows are equal.

    Counts of stretches of a key show where the n rows end; where many rows share that stretch, it is cut into stretches again.
    """
    below, tied, left = F.lit(False), F.lit(True), n
    for key in keys:
        low, high = -(1 << 63), (1 << 63) - 1
        for shift in [*range(64 - STRETCH_BITS, 0, -STRETCH_BITS), 0]:
            stretches = rows.filter(tied & key.between(low, high)).groupBy(F.shiftright(key, shift).alias("stretch")).count()
            counts = sorted(collect_bounded(stretches, 1 << STRETCH_BITS, "stretches of hashes"))
            reach = np.cumsum([c for _, c in counts], dtype=np.int64)
            last = int(np.searchsorted(reach, left))
            if last == len(counts):
                return rows
            stretch, held = counts[last]
            left -= int(reach[last]) - held
            low, high = stretch << shift, (stretch + 1 << shift) - 1
            if held <= n:
                return rows.filter(below | (tied & (key <= high)))
        below, tied = below | (tied & (key < low)), tied & (key == low)
    return rows.filter(below | tied)


def least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest (hash of id, id), in that order; rows of equal id go by the hash of label and vector.

    They are sorted out of a short list, as a sort with a limit hands n rows of every task to the driver.
    """
    own, other = F.xxhash64("id"), F.xxhash64("label", "embedding")
    return shortlist(rows, [own, other], n).orderBy(own, "id", other).limit(n)


def _unit(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(models: list[BinaryCodes]):
    @F.arrow_udf("array<long>")
    def run(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.list_(pa.int64()))
        x = _unit(values)
        found = np.stack([m.encode(x) for m in models], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(models)), pa.array(found.ravel()))

    return run


def _lookup(pool: tuple, block: np.ndarray, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place of a, place of b) of each pair of a block in a pool (block, id, vector); an id may stand there several times."""
    n = len(pool[0])
    ids = pa.concat_arrays([pool[1], a, b]).dictionary_encode().indices.to_numpy().astype(np.int64)
    blocks = np.unique(np.concatenate([pool[0], block]), return_inverse=True)[1]
    held = blocks[:n] * (len(ids) + 1) + ids[:n]
    order = np.argsort(held, kind="stable")
    pair, places = np.arange(len(block)), []
    for own in (ids[n : n + len(block)], ids[n + len(block) :]):
        key = blocks[n:] * (len(ids) + 1) + own
        low, high = np.searchsorted(held, key, sorter=order), np.searchsorted(held, key, "right", sorter=order)
        times = (high - low)[pair]
        places = [np.repeat(p, times) for p in places]
        reach = np.cumsum(times)
        places.append(order[np.repeat(low[pair], times) + np.arange(times.sum()) - np.repeat(reach - times, times)])
        pair = np.repeat(pair, times)
    return pair, *places


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_pair, block = batch["b"].is_valid(), batch["block"].to_numpy()
            pairs = is_pair.to_numpy(zero_copy_only=False)
            if not pairs.all():
                fresh = block[~pairs], batch["a"].filter(pc.invert(is_pair)), _unit(batch["embedding"].filter(pc.invert(is_pair)))
                pool = fresh if pool is None else (np.concatenate([pool[0], fresh[0]]), pa.concat_arrays([pool[1], fresh[1]]), np.concatenate([pool[2], fresh[2]]))
            if pairs.any():
                a, b = batch["a"].filter(is_pair), batch["b"].filter(is_pair)
                pair, x, y = _lookup(pool, block[pairs], a, b)
                for at in range(0, len(pair), PAIRS // 16):
                    part = slice(at, at + PAIRS // 16)
                    found = pa.array(pair[part][np.einsum("ij,ij->i", pool[2][x[part]], pool[2][y[part]]) >= least])
                    yield pa.RecordBatch.from_arrays([a.take(found), b.take(found)], ["a", "b"])
            last = pool[0] == block[-1]
            pool = pool[0][last], pool[1].filter(pa.array(last)), pool[2][last]

    return run


def in_blocks(found: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) with a block, each of about ``most`` pairs of one home: the smallest id that b is paired with.

    The pairs of a dense group share few homes, so a vector is sent to few blocks and not once for each pair.
    """
    homes = found.groupBy("b").agg(F.min("a").alias("home"))
    homed = found.join(homes.hint("merge"), "b")  # a small file may hold many pairs
    sides = homed.groupBy("home").count().select("home", F.ceil(F.sqrt(F.col("count") / most)).alias("side")).filter("side > 1")
    side = F.coalesce("side", F.lit(1).cast("long"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("a"), side), F.pmod(F.xxhash64("b"), side))
    return homed.join(sides, "home", "left").select("a", "b", block.alias("block"))


def links(placed: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of (a, b, block) rows whose vectors (id, embedding) have the least cosine."""
    needs = placed.select("block", F.col("a").alias("id")).union(placed.select("block", F.col("b").alias("id"))).distinct()
    nothing = F.array().cast(vectors.schema["embedding"].dataType)  # nulls in a row cost Arrow's writer time that grows with their number
    sent = needs.hint("merge").join(vectors, "id").select("block", F.col("id").alias("a"), F.lit(None).cast(placed.schema["b"].dataType).alias("b"), "embedding")
    asked = placed.select("block", "a", "b", nothing.alias("embedding"))
    met = sent.union(asked).repartition("block").sortWithinPartitions("block", F.col("b").isNotNull())
    return met.mapInArrow(_linked(least), f"a {placed.schema['a'].dataType.simpleString()}, b {placed.schema['b'].dataType.simpleString()}")


def _chunk_bits(apart: np.ndarray, table: int) -> np.ndarray:
    """In how many bits of this table's chunk codes differ that differ in these bits, one column a code."""
    return np.bitwise_count(apart[:, table // TABLES] >> np.uint64(CHUNK * (table % TABLES)) & np.uint64((1 << CHUNK) - 1))


def _matches(group: np.ndarray, place: np.ndarray, codes: np.ndarray, most_apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group whose halves beside the one they share are at most one bit apart, each pair of codes once.

    A pair comes from the first table that shows it; if both halves are equal, from the lower one.
    """
    beside = codes[np.arange(len(codes)), place // HALVES] >> (HALF * (place % HALVES ^ 1)).astype(np.uint64) & np.uint64((1 << HALF) - 1)
    key = group << HALF | beside.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, place, codes = key[order], place[order], codes[order]
    for flip in [0, *(1 << k for k in range(HALF))]:
        start = np.searchsorted(key, key | flip) if flip else np.arange(1, len(key) + 1)
        count = np.searchsorted(key, key | flip, side="right") - start
        count[key & flip != 0 if flip else place % 2 != 0] = 0
        reach = np.cumsum(count)
        low = 0
        while low < len(key):
            before = reach[low] - count[low]
            high = max(low + 1, int(np.searchsorted(reach, before + PAIRS, side="right")))
            if reach[high - 1] > before:
                n = count[low:high]
                a = np.repeat(np.arange(low, high), n)
                b = np.arange(len(a)) + np.repeat(start[low:high] - (reach[low:high] - n - before), n)
                bits = sum(np.bitwise_count(codes[a, r] ^ codes[b, r]).astype(np.int64) for r in range(codes.shape[1]))
                near = bits <= most_apart
                a, b = a[near], b[near]
                table = place[a] // 2
                first, apart = np.ones(len(a), dtype=bool), codes[a] ^ codes[b]
                for t in range(table.max(initial=0)):
                    first &= (table <= t) | (_chunk_bits(apart, t) > 1)
                if first.any():
                    yield order[a[first]], order[b[first]]
            low = high


def candidates(codes: DataFrame, n_codes: int, most_apart: int) -> DataFrame:
    """Pairs (a, b) of (id, label, codes) rows of one label that some table shows, each once."""
    halves = [(p, F.col("codes")[p // HALVES], p % HALVES) for p in range(HALVES * n_codes)]
    entry = F.explode(F.array(*(F.shiftrightunsigned(code, HALF * k).bitwiseAND(F.lit((1 << HALF) - 1)) + F.lit(p << HALF) for p, code, k in halves)))
    entries = codes.select("id", "label", *(F.col("codes")[r].alias(f"code_{r}") for r in range(n_codes)), entry.alias("half"))

    def ends(table: pa.Table) -> np.ndarray:
        label, half = table["label"].combine_chunks().dictionary_encode().indices.to_numpy(), table["half"].to_numpy()
        return np.flatnonzero((label[1:] != label[:-1]) | (half[1:] != half[:-1])) + 1

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.zeros(table.num_rows, dtype=np.int64)
        group[ends(table)] = 1
        ids, code = table["id"].combine_chunks(), np.stack([table[f"code_{r}"].to_numpy() for r in range(n_codes)], axis=1).view(np.uint64)
        for a, b in _matches(np.cumsum(group), table["half"].to_numpy() >> HALF, code, most_apart):
            x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
            less = pc.less(x, y)
            found = pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x)], ["a", "b"])
            yield found.filter(pc.not_equal(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = [], ROWS
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < least:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            whole = int(ends(table).max(initial=0))
            if whole:
                yield from pairs(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            least = max(ROWS, 2 * (table.num_rows - whole))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    met = entries.repartition("label", "half").sortWithinPartitions(F.xxhash64("label", "half"), "label", "half")
    id_type = codes.schema["id"].dataType.simpleString()
    return met.mapInArrow(run, f"a {id_type}, b {id_type}")


def all_candidates(same: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of (id, label, embedding) rows of one label, all compared in blocks of about BLOCK by BLOCK."""
    blocks = same.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = same.select("id", "label", "embedding").join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("id", "embedding"), F.col("blocks")))
    left = placed.select("id", "label", "embedding", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = placed.select("id", "label", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("i"), F.col("own").alias("j"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = _unit(x["embedding"].combine_chunks()) @ _unit(y["embedding"].combine_chunks()).T >= least - 1e-9
        a, b = np.nonzero(near)
        a, b = x["id"].to_numpy()[a], y["id"].to_numpy()[b]
        within = x["i"][0].as_py() == x["j"][0].as_py()
        keep = a < b if within else a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    keys = ["label", "i", "j"]
    return left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def embedding_dedup(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows are compared when labels are equal and not null.  A vector that is null, empty, zero or holds null or non-finite parts
    links with nothing, as does a row without vec_id (component_id null, not kept).  Vectors of different lengths are not
    compared.  Rows with equal label and vector are linked with each other; rows that repeat a vec_id count as further vectors.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    given = rows.select("vec_id", "label", "embedding")
    good = given.filter(usable)
    classes = store(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("width", F.size("embedding")), "vectors"
    )
    widths = [r["width"] for r in collect_bounded(classes.select("width").distinct(), MAX_WIDTHS, "vector lengths")]
    spark = rows.sparkSession
    free_shuffles(spark)
    pairs, stored = spark.createDataFrame([], "a long, b long"), []
    for width in widths:
        same = classes.filter(F.col("width") == width)
        sample = least_hashed(same, SAMPLE).select("embedding").toArrow()["embedding"]
        fitted = fit_codes(_unit(sample.combine_chunks()), least)
        if fitted is None:
            found = all_candidates(same, least)
        else:
            models, most_apart = fitted
            stored.append(store(same.select("id", "label", _codes(models)("embedding").alias("codes")), "codes"))
            found = candidates(stored[-1], len(models), most_apart)
        found = store(found, "candidates")
        free_shuffles(spark)
        stored.append(store(in_blocks(found, max(1024, COMPONENTS // width)), "placed"))
        drop_stored(found)
        free_shuffles(spark)
        pairs = pairs.union(links(stored[-1], same.select("id", "embedding"), least))
    pairs = store(pairs, "links")
    drop_stored(*stored)
    free_shuffles(spark)
    ends = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    linked = ends.hint("merge").join(classes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("linked"))
    about = linked.join(components(pairs).hint("merge"), "id")
    free_shuffles(spark)
    first = F.xxhash64("label", "embedding").alias("vector_hash")  # sorts fast
    own = good.select("vec_id", first, "label", "embedding").join(classes.select("id", "copies", first, "label", "embedding"), ["vector_hash", "label", "embedding"])
    matched = own.select("vec_id", "id", "copies").join(about, "id", "left").select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    alone = given.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return matched.union(alone).select("vec_id", "n_links", "component_id", kept)
