"""Language identification as mixture inference over character trigrams.

A document is a mixture of languages.  Expectation-maximisation estimates the proportions from trigram likelihoods; the language
set is the one with the best penalised likelihood, tried in order of proportion.  Trigram counts come from all labelled
documents, one partial table per task, summed by Spark.  The model is bounded: BUCKETS trigram codes times the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import pieces, text_ranges
from foldwright.session import collect_bounded

BUCKETS = 1 << 18
MAX_LANGUAGES = 400
UNDETERMINED = "und"


@cache
def _folded() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index and code of every trigram of the letters, runs of other characters being one space; letters per document."""
    joined = "\n".join([*texts, ""])  # every text ends in a space
    cps = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)[: len(cps)]
    letter = cps != 32
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space of a run
    cps, owner = cps[keep], owner[keep]
    # a space before the first and after the last letter of every document keeps its edges
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    cps, owner = np.insert(cps, start, 32), np.insert(owner, start, owner[start])
    if len(cps) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), letters
    code = (cps[:-2] * np.uint32(0x9E3779B1)) ^ (cps[1:-1] * np.uint32(0x85EBCA77)) ^ (cps[2:] * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(14)
    same = owner[:-2] == owner[2:]
    return owner[:-2][same], code[same], letters


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of (text, lang) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                codes = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(counts[codes])], ["lang", "code", "n"])
            held.clear()

        for batch, texts in pieces(batches, "text"):
            owner, code, _ = trigrams(texts)
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            spoken = which[owner]
            for k, lang in enumerate(langs.tolist()):
                if lang not in held and len(held) >= 32:
                    yield from flush()
                counts = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                counts += np.bincount(code[spoken == k], minlength=BUCKETS)
        yield from flush()

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # (BUCKETS, languages), natural logarithms

    @classmethod
    def fit(cls, docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
        rows = collect_bounded(count_trigrams(docs), BUCKETS * MAX_LANGUAGES, "trigram counts")
        languages = sorted({r["lang"] for r in rows})
        place = {lang: i for i, lang in enumerate(languages)}
        counts = np.zeros((BUCKETS, len(languages)))
        for r in rows:
            counts[r["code"], place[r["lang"]]] = r["n"]
        seen = counts.sum(axis=1) > 0
        total = counts.sum(axis=0) + smoothing * (seen.sum() + 1)
        return cls(languages, np.log((counts + smoothing) / total).astype(np.float32))


def infer(owner: np.ndarray, code: np.ndarray, n_docs: int, logs: np.ndarray, steps: int = 12, least: float = 0.02, evidence: float = 1 / 3) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (docs, languages) and per-trigram advantage of the chosen mixture over uniform guessing.

    Overlapping trigrams repeat each character three times, so the penalised likelihood counts a third of them.  Languages below
    ``least`` in the full mixture are no candidates.
    """
    k = logs.shape[1]
    cells, weight = np.unique(owner.astype(np.uint64) << np.uint64(32) | code, return_counts=True)
    doc, gram = (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
    weight = weight.astype(np.float32)
    share = np.zeros((n_docs, k), dtype=np.float32)
    if not len(doc):
        return share, np.zeros(n_docs)
    rows = logs[gram]
    top = rows.max(axis=1)
    like = np.exp(rows - top[:, None])

    def em(doc, like, weight, allowed, rounds):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        here, place = doc[starts], np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
        pi = allowed[here] / allowed[here].sum(axis=1, keepdims=True)
        mass = np.add.reduceat(weight, starts)[:, None]
        for _ in range(rounds):
            joint = like * pi[place]
            total = joint.sum(axis=1)
            joint *= (weight / np.maximum(total, 1e-30))[:, None]
            pi = np.add.reduceat(joint, starts, axis=0) / mass
        total = np.maximum((like * pi[place]).sum(axis=1), 1e-30)
        return here, pi, np.add.reduceat(weight * np.log(total), starts), mass[:, 0]

    here, pi, _, mass = em(doc, like, weight, np.ones((n_docs, k), dtype=np.float32), steps)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    single = np.add.reduceat((rows - top[:, None]) * weight[:, None], starts, axis=0)
    best = single.argmax(axis=1)
    share[here, best] = 1.0
    score = evidence * single.max(axis=1)
    fee = 0.5 * np.log(np.maximum(evidence * mass, 2.0))
    order = np.argsort(-pi, axis=1, kind="stable")
    for size in range(2, k + 1):
        wanted = np.take_along_axis(pi, order[:, size - 1 : size], axis=1)[:, 0] >= least
        if not wanted.any():
            break
        allowed = np.zeros((n_docs, k), dtype=np.float32)
        np.put_along_axis(sub := np.zeros_like(pi), order[:, :size], 1.0, axis=1)
        allowed[here] = sub
        flag = np.zeros(n_docs, dtype=bool)
        flag[here[wanted]] = True
        rows_in = flag[doc]
        at, mix, gain, _ = em(doc[rows_in], like[rows_in], weight[rows_in], allowed, steps)
        index = np.searchsorted(here, at)
        value = evidence * gain - fee[index] * (size - 1)
        better = value > score[index]
        share[at[better]] = mix[better]
        score[index[better]] = value[better]
    total = np.add.reduceat(weight * np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-30)), starts)
    fit = np.zeros(n_docs)
    fit[here] = (total + np.add.reduceat(weight * top, starts)) / mass + np.log(BUCKETS)
    return share, fit


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and languages (all of the chosen set with their proportions) to the ``keep`` columns of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text when the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))  # at most BUCKETS x MAX_LANGUAGES floats
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        names = np.array([*languages, UNDETERMINED], dtype=object)
        for batch, texts in pieces(batches, "__text"):
            owner, code, letters = trigrams(texts)
            share = np.zeros((len(texts), 0))
            if languages:
                share, _ = infer(owner, code, len(texts), logs)
            known = (letters > 0) & (share.sum(axis=1) > 0)
            pred = np.where(known, share.argmax(axis=1) if languages else 0, len(languages))
            score = np.where(known, share.max(axis=1) if languages else 0.0, 0.0)
            mixes = [[{"lang": languages[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, known, strict=True)]
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            out += [pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))]
            out.append(pa.array(mixes, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", "languages"])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    from foldwright.llm.common import remainder

    return remainder(doc_id, 4) == 2


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row; learnt from the rows that are not held out.

    Null or letterless texts are ``und`` (score 0); rows with null lang teach nothing; repeated rows are repeated; an empty
    table gives an empty result.  Other columns are ignored.
    """
    model = LanguageModel.fit(docs.filter(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The rows whose main language is known and has at least ``least_share`` of the text; columns as given.

    Texts without letters go, null ones too; rows are judged one by one, so repeated rows and shared or null ids stay alike.  Without
    any row that has a language nothing is known and every row goes; an empty table stays empty.
    """
    model = LanguageModel.fit(docs.filter(~held_out()).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model.logs)  # at most BUCKETS x MAX_LANGUAGES floats

    @F.arrow_udf("double")
    def main_share(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for _, _, part in text_ranges(texts):
            owner, code, letters = trigrams(part)
            share = infer(owner, code, len(part), shared.value)[0].max(axis=1) if shared.value.shape[1] else np.zeros(len(part))
            out.append(np.where(letters > 0, share, 0.0).astype(np.float64))
        return pa.array(np.concatenate(out))

    scored = docs.select(F.struct(*docs.columns).alias("row"), main_share(F.col("text")).alias("share"))
    return scored.filter((F.col("share") > 0) & (F.col("share") >= least_share)).select("row.*")
