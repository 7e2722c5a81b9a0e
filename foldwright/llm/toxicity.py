"""Toxicity of texts after noisy-channel restoration.

Disguised words (digits and signs for letters, letters set apart, letters repeated) become lattices of characters.  A Viterbi pass
under a character language model picks the likeliest reading, and the restored words are scored by a logistic model on word
beginnings, endings and whole words.  Plain words have one reading only and skip the lattice.

The language model counts the words of all texts, labelled or not.  It is bounded by hashed buckets, two for each count of which
the smaller holds, so no trigram is left out for being rare.  The classifier alone learns from at most SAMPLE labelled documents,
drawn by a hash of their ids; its CANDIDATES most frequent features are weighed and at most FEATURES with a gain of LEAST_GAIN or
more are kept.  All counting runs on Spark.  Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import pieces, remainder, store
from foldwright.session import collect_bounded

SAMPLE = 16_000
CANDIDATES = 200_000
FEATURES = 4096
LEAST_GAIN = 25.0
CACHED_TOKENS = 150_000
BUCKETS = 1 << 20  # of each of the two tables of the character model
HELD_WORDS = 50_000
HELD_LOGS = 500_000
THRESHOLD = 0.7

# Signs that stand for letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
JOINTS = " .-_*·"
EDGE = "?.,;:*#%&~'\"()[]{}<>/\\…“”„«»¿¡!"
LEET_COST, JOIN_COST, REPEAT_COST, SKIP_COST, BREAK_COST, LEAST_LOG = 0.7, 0.7, 0.7, 8.0, 1.0, -9.0

_RUN = re.compile(r"(.)\1\1")
_DOUBLES = re.compile(r"(.)\1.*(.)\2")
_SIGNS = re.compile(r"^[$@|+]{3,}|[$@|+]{3,}$")
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET_CHARS = re.compile("[" + re.escape("".join(LEET)) + "]")
SPACED = re.compile(r"(?<!\S)(?:\S([ .\-_*·]))(?:\S\1)+\S(?=[?!.,;:]*(?!\S))")


_MASK = (1 << 64) - 1
_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
TRIGRAM, PAIR, CONTEXT2, SINGLE, CONTEXT1 = range(1, 6)


def _slots(kind: int, a: int, b: int, c: int) -> tuple[int, int]:
    """The buckets of a count in the two tables, as in :func:`_slot_arrays`."""
    x = (kind * _MIXERS[0] + a * _MIXERS[1] + b * _MIXERS[2] + c * _MIXERS[3]) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) & _MASK
    return (x >> 44) % BUCKETS, BUCKETS + (x >> 8) % BUCKETS


def _slot_arrays(kind: int, a: np.ndarray | int, b: np.ndarray | int, c: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    u = np.uint64
    x = u(kind * _MIXERS[0] & _MASK) + a * u(_MIXERS[1]) + b * u(_MIXERS[2]) + c * u(_MIXERS[3])
    x = (x ^ (x >> u(31))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(29))) * u(0x94D049BB133111EB)
    return ((x >> u(44)) % u(BUCKETS)).astype(np.int64), ((x >> u(8)) % u(BUCKETS)).astype(np.int64) + BUCKETS


def add_words(table: np.ndarray, words: dict[str, int]) -> None:
    """Add the trigrams of words, with ^ before and $ after, to a table of 2 * BUCKETS counts and their total."""
    padded = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 3 for w in words), dtype=np.int64, count=len(words))
    n = np.fromiter(words.values(), dtype=np.float64, count=len(words))
    inside = np.ones(len(padded), dtype=bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    weights = np.repeat(n, sizes - 2)
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    o = np.zeros(1, dtype=np.uint64)
    for kind, x, y, z in ((TRIGRAM, a, b, c), (PAIR, o, b, c), (CONTEXT2, a, b, o), (SINGLE, o, o, c), (CONTEXT1, o, b, o)):
        for slots in _slot_arrays(kind, x, y, z):
            table[: 2 * BUCKETS] += np.bincount(slots, weights=weights, minlength=2 * BUCKETS)
    table[-1] += weights.sum()


@dataclass
class CharacterModel:
    """Trigram logarithms over letters, with ^ before and $ after a word; unseen trigrams fall back on shorter ones."""

    counts: np.ndarray  # (2 * BUCKETS + 1), the last one is the total
    held: dict[str, float] = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, docs: DataFrame) -> CharacterModel:
        """Count the words of all texts; each task sends the buckets it has filled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, words = np.zeros(2 * BUCKETS + 1), Counter()

            def flush():
                plain: Counter[str] = Counter()
                for token, n in words.items():
                    if (w := token.strip(EDGE)).isalpha():
                        plain[w] += n
                words.clear()
                if plain:
                    add_words(table, plain)

            for _, texts in pieces(batches, "text"):
                for t in texts:
                    words.update(t.lower().split())
                    if len(words) > HELD_WORDS:
                        flush()
            flush()
            filled = np.flatnonzero(table)
            for i in range(0, len(filled), 1 << 16):
                part = filled[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table[part].astype(np.int64))], ["bucket", "n"])

        summed = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * BUCKETS + 1 rows
        counts = np.zeros(2 * BUCKETS + 1)
        counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
        return cls(counts.astype(np.float32))

    def count(self, kind: int, a: int, b: int, c: int) -> float:
        i, j = _slots(kind, a, b, c)
        return float(min(self.counts[i], self.counts[j]))

    def log(self, context: str, letter: str) -> float:
        value = self.held.get(context + letter)
        if value is None:
            if len(self.held) >= HELD_LOGS:
                self.held.clear()
            value = self.held[context + letter] = self._log(*map(ord, context + letter))
        return value

    def _log(self, a: int, b: int, c: int) -> float:
        single = self.count(SINGLE, 0, 0, c)
        if not single:
            return LEAST_LOG
        p = 0.05 * single / float(self.counts[-1])
        pair = min(self.count(PAIR, 0, b, c), single)
        if not pair:
            return max(math.log(p), LEAST_LOG)
        p += 0.2 * pair / max(pair, self.count(CONTEXT1, 0, b, 0))
        three = min(self.count(TRIGRAM, a, b, c), pair)
        return math.log(p + (0.75 * three / max(three, self.count(CONTEXT2, a, b, 0)) if three else 0.0))


def decode(model: CharacterModel, token: str) -> list[str]:
    """The words of the likeliest reading of a disguised token.

    The state is the pair of last letters.  A run of one sign may be one letter or two; a joint between letters is either part of
    the disguise or the end of a word; other signs end a word.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # a path is (path before, letters), read back at the end
    i, n = 0, len(token)
    while i < n:
        c = token[i]
        j = i + 1
        while j < n and token[j] == c:
            j += 1
        length = j - i
        arcs: list[tuple[str, float]] = []
        readings = [(c, 0.0)] if c.isalpha() else [(x, LEET_COST) for x in LEET.get(c, "")]
        for letter, cost in readings:
            if length == 1:
                arcs.append((letter, cost))
            elif length == 2:
                arcs += [(letter * 2, 2 * cost), (letter, cost + REPEAT_COST)]
            else:
                arcs += [(letter, cost + REPEAT_COST), (letter * 2, cost + REPEAT_COST)]
        if not c.isalpha():
            arcs.append((" ", SKIP_COST if readings else BREAK_COST if c in JOINTS else 0.0))
            if c in JOINTS and length == 1:
                arcs.append(("", JOIN_COST))
        following: dict[str, tuple[float, tuple]] = {}
        for context, (score, path) in states.items():
            for letters, cost in arcs:
                s, state = score - cost, context
                if letters == " ":
                    if state != "^^":
                        s += model.log(state, "$")
                    state = "^^"
                else:
                    for letter in letters:
                        s += model.log(state, letter)
                        state = state[1] + letter
                if state not in following or s > following[state][0]:
                    following[state] = (s, (path, letters))
        states = following
        i = j
    ends = [(s + (model.log(c, "$") if c != "^^" else 0.0), path) for c, (s, path) in states.items()]
    best = max(s for s, _ in ends)
    return max("".join(_letters(path)) for s, path in ends if s == best).split()


def _letters(path: tuple | None) -> list[str]:
    """The letters of a path, first to last."""
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return out[::-1]


def words_of(model: CharacterModel | None, token: str) -> list[str]:
    """Restored words of one lower-case token; without a model the token is only cut."""
    if token.isalpha() and not _RUN.search(token) and not _DOUBLES.search(token):
        return [token]
    core = _SIGNS.sub("", token.strip(EDGE))
    while core and core[-1] in EDGE:
        core = core.rstrip(EDGE)
    if core.isalpha():
        if model is None or not (_RUN.search(core) or _DOUBLES.search(core)):
            return [core]
        return decode(model, core)
    found = _LETTERS.findall(core)
    if model is None or not found:
        return found
    if _LEET_CHARS.search(core) or _RUN.search(core) or SPACED.fullmatch(core):
        return decode(model, core)
    return found


def grams_of(words: list[str]) -> list[str]:
    out = []
    for w in words:
        if len(w) >= 3:
            out.append("=" + w)
            for k in range(3, min(9, len(w))):
                out.append("^" + w[:k])
                out.append(w[-k:] + "$")
    return out


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text: what white space separates, and stretches of single signs."""
    low = text.lower()
    out = set(low.split())
    for m in SPACED.finditer(low):
        out.add(m.group())
    return out


class Grams:
    """Features of tokens, with two bounded tables per worker; ``wanted`` restricts them."""

    def __init__(self, model: CharacterModel | None, wanted: dict[str, int] | None = None) -> None:
        self.model, self.wanted = model, wanted
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def of(self, text: str) -> set:
        if len(self.young) > CACHED_TOKENS:
            self.young, self.old = {}, self.young
        out: set = set()
        for token in tokens_of(text):
            held = self.young.get(token)
            if held is None:
                held = self.old.get(token)
                if held is None:
                    grams = grams_of(words_of(self.model, token))
                    held = tuple(grams) if self.wanted is None else tuple({self.wanted[g] for g in grams if g in self.wanted})
                self.young[token] = held
            if held:
                out.update(held)
        return out


def restore_text(docs: DataFrame, model: CharacterModel) -> DataFrame:
    """(doc_id, restored): the words of every text after restoration, in order, separated by spaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS

    def whole(text: str) -> str:
        low, out, at = text.lower(), [], 0
        for m in SPACED.finditer(low):
            out += [w for t in low[at : m.start()].split() for w in words_of(shared.value, t)] + words_of(shared.value, m.group())
            at = m.end()
        return " ".join(out + [w for t in low[at:].split() for w in words_of(shared.value, t)])

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else whole(t) for t in texts.to_pylist()], pa.string())

    return docs.select("doc_id", run("text").alias("restored"))


def _counted(sample: DataFrame, name: str, grams) -> DataFrame:
    """(gram, n) of ``grams(text)`` over the sample, summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for _, texts in (x for batch in batches for x in pieces(iter([batch]), "text")):
            for t in texts:
                counts.update(grams(t))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], [name, "n"])

    return sample.select("text").mapInArrow(run, f"{name} string, n long").groupBy(name).agg(F.sum("n").alias("n"))


@dataclass
class ToxicityModel:
    characters: CharacterModel
    features: dict[str, int]
    weights: np.ndarray
    precision: np.ndarray  # lower bound of the toxic share of the documents with a feature
    bias: float

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> ToxicityModel:
        """Learn from ``labels`` (doc_id, toxic): a document with several labels is toxic if one says so; null labels are left out."""
        marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        drawn = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_size)
        sample = store(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["text", "toxic"]).repartition(16), "sample")  # at most sample_size ids; copies teach once
        totals = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        good, bad = totals.get(False, 0), totals.get(True, 0)
        prior = math.log((bad + 0.5) / (good + 0.5))
        characters = CharacterModel.fit(docs)
        if not bad or not good:
            return cls(characters, {}, np.zeros(0), np.zeros(0), prior)
        shared = sample.sparkSession.sparkContext.broadcast(characters)

        def all_grams(text: str, held: dict = {}):  # noqa: B006  one table per task
            return held.setdefault("", Grams(shared.value)).of(text)

        toxic = _counted(sample.filter("toxic = 1"), "gram", all_grams).filter("n >= 2").orderBy(F.desc("n"), "gram").limit(CANDIDATES)
        hits = {r["gram"]: r["n"] for r in collect_bounded(toxic, CANDIDATES, "candidate features")}
        place = {g: i for i, g in enumerate(hits)}
        wanted = sample.sparkSession.sparkContext.broadcast(place)  # at most CANDIDATES strings

        def some_grams(text: str, held: dict = {}):  # noqa: B006  one table per task
            return [str(i) for i in held.setdefault("", Grams(shared.value, wanted.value)).of(text)]

        clean = {int(r["gram"]): r["n"] for r in collect_bounded(_counted(sample.filter("toxic = 0"), "gram", some_grams), CANDIDATES, "candidate features")}
        gains = []
        leading: dict[str, int] = {}  # the most frequent whole word with a beginning or ending
        for g, a in hits.items():
            if g[0] == "=":
                for part in grams_of([g[1:]]):
                    leading[part] = max(leading.get(part, 0), a)
        for g, a in hits.items():
            if g[0] != "=" and leading.get(g, 0) >= 0.8 * a:
                continue  # no more than that word says
            b = clean.get(place[g], 0)
            if (a + 0.5) / (bad + 1) < 4 * (b + 0.5) / (good + 1):
                continue
            gain = 2 * (a * math.log(a * (good + bad) / ((a + b) * bad)) + (b * math.log(b * (good + bad) / ((a + b) * good)) if b else 0.0))
            if gain >= LEAST_GAIN:
                gains.append((-gain, g, least_share(a, a + b)))
        gains = sorted(gains)[:FEATURES]
        chosen = {g: i for i, (_, g, _) in enumerate(gains)}
        model = cls(characters, chosen, np.zeros(len(chosen)), np.array([x for _, _, x in gains]), prior)
        rows = collect_bounded(model._found(sample.select("text", "toxic"), ["toxic"]), sample_size, "sample documents")
        model.weights, model.bias = fit_logistic([r["found"] for r in rows], np.array([float(r["toxic"]) for r in rows]), len(chosen), prior)
        return model

    def _found(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.characters, self.features))  # bounded by BUCKETS and FEATURES
        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = Grams(*shared.value)
            for batch, texts in pieces(batches, "text"):
                found = [sorted(grams.of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, pa.list_(pa.int32()))], [*keep, "found"])

        return rows.select(*keep, "text").mapInArrow(run, f"{fields}, found array<int>")

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row: the logistic score, or the surest feature if that is more.

        Toxic words rarely come alone, so the logistic model divides its weight among them; the surest feature alone still counts.
        """
        weights, precision, bias = self.weights, self.precision, self.bias

        @F.arrow_udf("double")
        def run(found: pa.Array) -> pa.Array:
            lists = found.to_pylist()
            z = np.array([bias + sum(weights[i] for i in x) for x in lists], dtype=np.float64)
            sure = np.array([max((precision[i] for i in x), default=0.0) for x in lists], dtype=np.float64)
            return pa.array(np.maximum(sure, 1 / (1 + np.exp(-np.clip(z, -700, 700)))))

        return self._found(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", run("found").alias("score"))


def least_share(hits: int, n: int, z: float = 1.96) -> float:
    """Lower end of the Wilson interval of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_logistic(found: list[list[int]], y: np.ndarray, width: int, prior: float, ridge: float = 0.05, steps: int = 600) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on present features, by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cols = np.array([i for x in found for i in x], dtype=np.int64)
    w, b = np.zeros(width), prior
    if not width or not len(y):
        return w, b
    most = max(1, max(len(x) for x in found)) + 1
    rate = np.r_[1 / (0.25 * (np.bincount(cols, minlength=width) * most + 1) + ridge), 1 / (0.25 * len(y) * most)]
    theta = np.r_[w, b]
    ahead, t = theta.copy(), 1.0
    for _ in range(steps):
        z = ahead[-1] + np.bincount(rows, weights=ahead[cols], minlength=len(y))
        residual = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
        gradient = np.r_[np.bincount(cols, weights=residual[rows], minlength=width) + ridge * ahead[:-1], residual.sum()]
        new, s = ahead - rate * gradient, (1 + math.sqrt(1 + 4 * t * t)) / 2
        if gradient @ (new - theta) > 0:
            t, s = 1.0, 1.0
        ahead, theta, t = new + (t - 1) / s * (new - theta), new, s
    return theta[:-1], float(theta[-1])


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return remainder(doc_id, 3) == 1


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learnt from labels of rows that are not held out.

    Null and empty texts have the score of a text without any feature.  Without labels of both kinds all scores are the prior.
    Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    model = ToxicityModel.fit(docs, labels.filter(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
