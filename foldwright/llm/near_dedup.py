"""Near-duplicate documents by SetSketch registers.

A document is the set of its five-word shingles.  Its sketch has one register per hash: floor(1 - log_b(x)) of the smallest
exponential variate x over the set, truncated to [0, Q + 1].  Registers of a union are the maxima, so sketches merge; equal
registers are about as frequent as the Jaccard similarity, so bands of register values find candidates.  The similarity of a
candidate is estimated jointly from how many registers are larger, smaller and equal, by maximum likelihood given both set
sizes, and confirmed on the full sets.

Equal sets are merged first.  In every band bucket all members are compared with one leader, drawn anew for each bucket, and
each document confirms its most similar leaders.  Where a bucket still holds several components, the members outside its largest
one are held against all its members in blocks, so that no link between components is lost and copies are never expanded into
pairs.  The blocks carry short codes of the whole sets: a pair leaves its block only if the codes allow the least similarity, which
every link does, so that the pairs that are merely alike, whose number grows with the square of a group, stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import pieces, store
from foldwright.llm.graph import components

WORDS = 5
REGISTERS, BANDS = 128, 32
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
LEAST_PERCENT = 75
#: Five standard deviations of the estimate below the least similarity.
LEAST_ESTIMATE = 0.55
LEADERS = 3  # confirmed first per document
BLOCK, SMALL = 1024, 48
BLOCK_BYTES = 1 << 23  # codes in a block
SHORT_CODES = 2048  # sets up to this size have codes of 16 bits, larger ones of 32
LONG_WORD = 64  # bytes

_ROOT = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_ROOT_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(size, _ROOT), np.full(size, _ROOT_INVERSE)
    for s in steps:
        s[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


@cache
def _word_factors() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    _powers.cache_clear() if _powers.cache_info().currsize > 4 else None
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = np.diff(np.r_[False, inside].astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):  # sums modulo 2**64 tell long words apart badly
        words[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    place = np.searchsorted(starts, begins)
    grams = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for k, factor in enumerate(_word_factors()):
        grams += words[k : k + len(grams)] * factor
    grams = _mix(grams)
    out = []
    for i in range(len(texts)):
        a, b = int(place[i]), int(place[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set."""
    factor, shift = _family()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * factor + shift).min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, Q + 1).astype("<u2")


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band number is part of the key."""
    rows = registers.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in rows.T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def estimate_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows (pairs, REGISTERS) of sets with known sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        first, second = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(first, 1e-12)) + less * np.log(np.maximum(second, 1e-12)) + equal * np.log(np.maximum(1 - first - second, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the logarithm of the likelihood is concave
        left, right = low + (high - low) * 0.382, low + (high - low) * 0.618
        worse = fit(left) < fit(right)
        low, high = np.where(worse, left, low), np.where(worse, high, right)
    return (low + high) / 2


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, registers of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            sets = shingle_sets(texts)
            rows = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([None if r is None else band_keys(r) for r in rows], pa.list_(pa.int64())), pa.array([None if r is None else r.tobytes() for r in rows], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "registers"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_shingles long, set_key binary, bands array<long>, registers binary")


def _estimate():
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.float64())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype="<u2").reshape(len(c), -1) for c in (a, b))
        return pa.array(estimate_jaccard(x, y, n_a.to_numpy(), n_b.to_numpy()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in pieces(iter([batch]), "text_a"):
                keep = []
                right = [t or "" for t in part.column(part.schema.get_field_index("text_b")).to_pylist()]
                for x, y in zip(shingle_sets(left), shingle_sets(right), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= LEAST_PERCENT * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def bucket_leaders(members: DataFrame) -> DataFrame:
    """(bucket, leader) of the buckets with several members; the leader is drawn by a hash of bucket and id."""
    found = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id", "bucket")).alias("leader"))
    return found.filter("n > 1").select("bucket", "leader")


def best_leaders(estimated: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of every document and its most similar leaders; a document has at most one leader per band."""
    ranked = estimated.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("estimate", F.xxhash64("id", "leader").alias("draw"), "leader")), asc=False).alias("r"))
    pairs = ranked.select("id", F.explode(F.slice("r", 1, most)).alias("r")).select("id", "r.leader")
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def set_codes(texts: DataFrame) -> DataFrame:
    """(id, n_shingles, codes) of every text: the low bits of each shingle hash, two bytes in a short set, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in pieces(batches, "text"):
            sets = shingle_sets(part)
            codes = [s.astype("<u2" if len(s) <= SHORT_CODES else "<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(codes, pa.binary())], ["id", "n_shingles", "codes"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n_shingles long, codes binary").distinct()


def _decode(codes: bytes, size: int) -> np.ndarray:
    return np.frombuffer(codes, dtype="<u2" if size <= SHORT_CODES else "<u4")


def most_common(x: np.ndarray, others: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """At least the size of the intersection of a set with each of the others, from their codes.

    ``seen`` is a table of 2**16 false marks, and is so again at the end.  Shingles in common have the same code in any width.
    """
    if x.dtype.itemsize == 4:
        full = np.unique(x)
        out = np.array([np.isin(y, full, kind="sort").sum() if y.dtype.itemsize == 4 else 0 for y in others], dtype=np.int64)
    else:
        out = np.zeros(len(others), dtype=np.int64)
    narrow = [i for i, y in enumerate(others) if y.dtype.itemsize == 2 or x.dtype.itemsize == 2]
    if narrow:
        marks = x.astype(np.uint16)
        seen[marks] = True
        sizes = np.array([len(others[i]) for i in narrow])
        hit = seen[np.concatenate([others[i].astype(np.uint16) for i in narrow])]
        out[narrow] = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
        seen[marks] = False
    return np.minimum(out, len(x))


def _possible(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return 100 * common >= LEAST_PERCENT * (n_a + n_b - common)


def _crossing(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of two sets of members that lie in different components and whose codes allow a link.

    A pair that shares several buckets is given by its first one.  Estimates are taken only where enough registers agree.
    """
    x, y = (np.frombuffer(b"".join(t["registers"].to_pylist()), dtype="<u2").reshape(t.num_rows, REGISTERS) for t in (left, right))
    (i1, h1, n1), (i2, h2, n2) = ([t[c].to_numpy() for c in ("id", "home", "n_shingles")] for t in (left, right))
    own, other = ([_decode(c, n) for c, n in zip(t["codes"].to_pylist(), sizes, strict=True)] for t, sizes in ((left, n1), (right, n2)))
    outer2, band = right["outlier"].to_numpy(zero_copy_only=False), left["band"][0].as_py() if left.num_rows else 0
    seen = np.zeros(1 << 16, dtype=bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(left.num_rows):
        equal = y == x[k]
        near = np.flatnonzero((equal.sum(axis=1) >= REGISTERS * LEAST_ESTIMATE * 0.8) & (h2 != h1[k]) & (~outer2 | (i2 > i1[k])))
        if len(near):
            bands = equal[near].reshape(len(near), BANDS, -1).all(axis=2)
            near = near[bands.argmax(axis=1) == band]
        if len(near):
            value = estimate_jaccard(np.broadcast_to(x[k], (len(near), REGISTERS)), y[near], np.full(len(near), n1[k]), n2[near])
            near = near[value >= LEAST_ESTIMATE]
        if len(near):
            near = near[_possible(most_common(own[k], [other[j] for j in near], seen), n1[k], n2[near])]
            out.append((np.full(len(near), i1[k]), i2[near]))
    a, b = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _codes_allow():
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        n, m = n_a.to_numpy(), n_b.to_numpy()
        seen = np.zeros(1 << 16, dtype=bool)
        pairs = zip(a.to_pylist(), b.to_pylist(), n, m, strict=True)
        common = np.array([most_common(_decode(p, k), [_decode(q, j)], seen)[0] for p, q, k, j in pairs], dtype=np.int64)
        return pa.array(_possible(common, n, m), pa.bool_())

    return run


def crossing_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) between components that meet in a bucket, from (bucket, band, id, home, n_shingles, registers, codes).

    Members of a bucket outside its largest component are held against all members, in blocks of about BLOCK by BLOCK, fewer where
    sets are large, that a task compares as matrices.  Buckets of up to SMALL members are joined row by row.
    """
    homes = members.groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("codes")).alias("bytes"))
    main = homes.groupBy("bucket").agg(
        F.sum("n").alias("total"), F.max_by("home", F.struct("n", "home")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"),
        F.sum("bytes").alias("bytes"), (F.sum("bytes") - F.max_by("bytes", F.struct("n", "home"))).alias("outside_bytes"),
    )
    placed = members.join(main, "bucket").withColumn("outlier", F.col("home") != F.col("main"))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES))
    placed = placed.withColumn("left_blocks", blocks("outside", "outside_bytes")).withColumn("right_blocks", blocks("total", "bytes"))
    own_left, own_right = F.pmod(F.xxhash64("id"), F.col("left_blocks")), F.pmod(F.xxhash64("id"), F.col("right_blocks"))
    span = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    columns = ["bucket", "band", "id", "home", "n_shingles", "registers", "codes", "outlier"]
    large = F.col("total") > SMALL
    left = placed.filter(large & F.col("outlier")).select(*columns, own_left.alias("i"), F.explode(span(F.col("right_blocks"))).alias("j"))
    right = placed.filter(large).select(*columns, F.explode(span(F.col("left_blocks"))).alias("i"), own_right.alias("j"))
    keys = ["bucket", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(_crossing, "a long, b long")
    small = placed.filter(~large)
    one = small.filter("outlier").select(*(F.col(c).alias(f"{c}_1") for c in columns))
    two = small.select(*(F.col(c).alias(f"{c}_2") for c in columns))
    other = (F.col("bucket_1") == F.col("bucket_2")) & (F.col("home_1") != F.col("home_2")) & (~F.col("outlier_2") | (F.col("id_2") > F.col("id_1")))
    sizes = ("n_shingles_1", "n_shingles_2")
    alike = one.join(two, other).filter(_estimate()("registers_1", "registers_2", *sizes) >= LEAST_ESTIMATE)
    few = alike.filter(_codes_allow()("codes_1", "codes_2", *sizes)).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b"))
    return found.union(few).distinct()


def near_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component_id) of the linked classes (id, n_shingles, bands, registers); texts come from ``docs``."""
    ids = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    leaders = store(bucket_leaders(ids), "leaders")
    crowd = ids.join(leaders, "bucket")
    stars = crowd.select("id", "leader").filter("id <> leader").distinct()
    sketches = classes.select("id", "n_shingles", "registers")
    estimated = (
        stars.join(sketches, "id")
        .join(sketches.toDF("leader", "leader_n", "leader_registers"), "leader")
        .select("id", "leader", _estimate()("registers", "leader_registers", "n_shingles", "leader_n").alias("estimate"))
        .filter(F.col("estimate") >= LEAST_ESTIMATE)
    )
    pairs = store(best_leaders(estimated, LEADERS), "pairs")
    crowded = crowd.select("id").distinct()
    texts = store(docs.select(F.col("doc_id").alias("id"), "text").join(crowded, "id", "left_semi"), "texts")
    links = store(confirm(pairs, texts), "links")
    groups = components(links)
    # members of buckets in which several components meet
    homes = crowd.join(groups, "id", "left").select("id", "bucket", "band", F.coalesce("component_id", "id").alias("home"))
    mixed = homes.groupBy("bucket").agg(F.min("home").alias("x"), F.max("home").alias("y")).filter("x <> y").select("bucket")
    places = store(homes.join(mixed, "bucket", "left_semi"), "places")
    codes = store(set_codes(texts.join(places.select("id").distinct(), "id", "left_semi")), "codes")
    members = places.join(sketches, "id").join(codes, ["id", "n_shingles"]).select("bucket", "band", "id", "home", "n_shingles", "registers", "codes")
    members = store(members, "members")
    more = store(confirm(crossing_pairs(members).join(pairs, ["a", "b"], "left_anti"), texts), "links")
    if more.isEmpty():
        return groups
    # links between components join the components
    at = groups.select("id", "component_id")
    ends = more.join(at.toDF("a", "x"), "a", "left").join(at.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = components(ends)
    known = groups.union(more.select("a", "a").union(more.select("b", "b")).join(at.toDF("a", "x"), "a", "left_anti").distinct().toDF("id", "component_id"))
    return known.join(joined.toDF("component_id", "joined"), "component_id", "left").select("id", F.coalesce("joined", "component_id").alias("component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, with A-Z in lower case.  Fewer than five words form one shingle;
    null, empty and blank texts have none and link with nothing.  Documents link at 100 * intersection >= 75 * union.  A row
    without doc_id links with nothing (component_id null, not kept).  Rows that share a doc_id are one node of the graph.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = store(sketch_documents(docs), "sketches")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first(F.struct("n_shingles", "bands", "registers")).alias("s"))
    classes = store(same.select("set_key", "id", "s.*"), "classes")
    groups = near_classes(classes.select("id", "n_shingles", "bands", "registers"), docs)
    homes = classes.select("set_key", "id").join(groups, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("home"))
    thin = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
    return thin.join(homes, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("home", "doc_id").alias("component_id"), F.coalesce(F.coalesce("home", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept")
    )
