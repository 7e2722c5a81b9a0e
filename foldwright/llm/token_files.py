"""Token ids in ORC files, ordered by document.

A file row is (part, offset, doc_id, n_tokens, ids).  Ids lie in integer run-length encoded streams; row indexes and a Bloom
filter on doc_id let a reader skip stripes and row groups by metadata; stripes are read in parallel.  ``offset`` counts the ids
before the row in its part, so a document's place in the whole stream is the sum of the parts before plus its offset.

Texts of common characters are cut at spaces, or where that does not do by a pattern, into pretokens, and each distinct one is encoded
once per worker by the tokenizers library; all other texts go to the library whole, also those that hold the string of an added token, which the library
reads as that token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import pieces
from foldwright.session import broadcast_checked, scratch_path

END = 0
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
CACHED_WORDS = 250_000
RUN_WORDS = 400
SLICE_BYTES = 4 << 20
SPACE_SIGN = "Ġ"  # how byte-level vocabularies write a space

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SPACES = "\t-\r "
#: Texts of these characters are cut alike by PRETOKEN and by the byte-level pre-tokenizer.
COMMON = re.compile(f"[\t-\r -~¡-©«-±´¶-¸»¿-ɏ‐-‧]*")
PRETOKEN = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")  # most frequent first

#: Names of what has no space before it in the chunks of a text: the word that begins a line (HEAD before it), a line end, a mark.  No
#: common text holds them.
HEAD, LINE = "\0", "\1"
STOP, STOP_BYTES = "\x0e", np.array([END], dtype="<u4").tobytes()  # the end of a text
POINTS = {",": "\2", ".": "\3", ";": "\4", ":": "\5", "!": "\6", "?": "\7"}
MARKS = {LINE: "\n"} | {name: mark for mark, name in POINTS.items()}


class WordEncoder:
    """Byte-level BPE ids as little-endian bytes, with bounded tables of pretokens and of chunks between spaces per worker."""

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.library = Tokenizer.from_file(path)
        strings = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, strings)) or "(?!)")  # texts that hold one go to the library whole
        self.opens = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith(SPACE_SIGN)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of words of letters with a space before them, how many each has, and the places of those left out (size 0).

        They go many at a time: each of them, and nothing inside it, begins with a token that holds the space, so the ids of a run are
        cut there; a run with other ids is left out."""
        starts = range(0, len(words), RUN_WORDS)
        parts, sizes, left = [np.zeros(0, dtype=np.uint32)], np.zeros(len(words), dtype=np.int64), []
        for i, e in zip(starts, self.library.encode_batch_fast([" " + " ".join(words[i : i + RUN_WORDS]) for i in starts], add_special_tokens=False), strict=True):
            ids, held = np.array(e.ids, dtype="<u4"), sizes[i : i + RUN_WORDS]
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(held) and cuts[0] == 0:
                held[:] = np.diff(np.r_[cuts, len(ids)])
                parts.append(ids)
            else:
                left += range(i, i + len(held))
        return np.concatenate(parts), sizes, left

    def _look_up(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of texts given as pretokens."""
        if len(self.words) > CACHED_WORDS:  # words in use move over from the older table
            self.words, self.older = {}, self.words
        wanted = set().union(*cut).difference(self.words)
        self.words.update((w, self.older[w]) for w in wanted if w in self.older)
        fresh = list(wanted.difference(self.words))
        self.words.update(zip(fresh, self._batch(fresh), strict=True))
        return [b"".join(map(self.words.__getitem__, c)) for c in cut]

    def _chunks(self, names: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks that occur ``count`` times, how many each has and where they begin; size -1 where what the end of a
        chunk means depends on what follows.  Words that occur once are not held in the table."""
        if len(self.chunks) > CACHED_WORDS:  # chunks in use move over from the older table
            self.chunks, self.older_chunks = {}, self.chunks
        self.chunks[STOP] = STOP_BYTES
        found = list(map(self.chunks.get, names))
        fresh = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            ids = self.older_chunks.get(names[i])
            if ids is None:
                fresh.append(i)
            else:
                found[i] = self.chunks[names[i]] = ids
        words = [i for i in fresh if names[i].isalpha()]
        ids, sizes, left = self._spaced([names[i] for i in words])
        begin = np.cumsum(sizes) - sizes
        raw, words = ids.tobytes(), np.array(words, dtype=np.int64)
        for k in np.flatnonzero((count[words] > 1) & (sizes > 0)).tolist():
            self.chunks[names[words[k]]] = raw[4 * begin[k] : 4 * (begin[k] + sizes[k])]
        other = [i for i in fresh if names[i] in MARKS or (names[i][-1:].isalnum() and not names[i].isalpha() and names[i].split() == [names[i]])]
        other += words[left].tolist()
        texts = [MARKS.get(c) or (c[1:] if c[0] == HEAD else " " + c) for c in (names[i] for i in other)]
        for i, x in zip(other, self._look_up([PRETOKEN.findall(t) for t in texts]), strict=True):
            found[i] = self.chunks[names[i]] = x
        held = np.frombuffer(b"".join([x or b"" for x in found]), dtype="<u4")
        every = np.fromiter((-1 if x is None else len(x) // 4 for x in found), dtype=np.int64, count=len(found))
        at = np.cumsum(np.maximum(every, 0)) - np.maximum(every, 0)
        every[words[sizes > 0]], at[words[sizes > 0]] = sizes[sizes > 0], len(held) + begin[sizes > 0]
        return np.concatenate([held, ids]), every, at

    def _apart(self, texts: list[str], common: np.ndarray) -> list[bytes]:
        """Ids of texts one by one, by their pretokens where they are common, else by the library."""
        out = dict(zip(np.flatnonzero(common), self._look_up([PRETOKEN.findall(t) for t, c in zip(texts, common, strict=True) if c]), strict=True))
        out.update(zip(np.flatnonzero(~common), self._batch([t for t, c in zip(texts, common, strict=True) if not c]), strict=True))
        return [out[i] + STOP_BYTES for i in range(len(texts))]

    def encode(self, column: pa.Array, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """How many ids each text has, its end id included, and all ids.

        Chunks between single spaces and line ends are looked up whole, a mark that ends one apart from it: a space begins a pretoken,
        and a letter or digit, or a mark after one, ends a pretoken before a space.  Texts with other white space, or other signs before
        a space, are cut by the pattern.  Cutting and numbering are Arrow's work on columns.
        """
        n = len(texts)
        common = np.fromiter((bool(COMMON.fullmatch(t)) and not self.added.search(t) for t in texts), dtype=bool, count=n)
        cut = pc.binary_join_element_wise(HEAD, pc.if_else(pa.array(common), pc.fill_null(column, ""), ""), f" {STOP}", "")
        cut = pc.replace_substring(cut, "\n", f" {LINE} {HEAD}")
        for mark, name in POINTS.items():
            cut = pc.replace_substring(cut, mark + " ", f" {name} ")
        lists = pc.split_pattern(cut, " ")
        coded = lists.flatten().dictionary_encode()
        place, owner = coded.indices.to_numpy(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        ids, sizes, begin = self._chunks(coded.dictionary.to_pylist(), np.bincount(place, minlength=len(coded.dictionary)))
        alone = ~common
        alone[owner[(sizes < 0)[place]]] = True
        rest = np.flatnonzero(alone)
        if len(rest):
            keep = ~alone[owner]
            place, owner = np.r_[place[keep], len(sizes) + np.arange(len(rest))], np.r_[owner[keep], rest]
            order = np.argsort(owner, kind="stable")
            place, owner = place[order], owner[order]
            more = self._apart([texts[i] for i in rest], common[rest])
            added = np.fromiter(map(len, more), dtype=np.int64, count=len(more)) // 4
            begin = np.r_[begin, len(ids) + np.cumsum(added) - added]
            ids, sizes = np.r_[ids, np.frombuffer(b"".join(more), dtype="<u4")], np.r_[sizes, added]
        taken = sizes[place]
        ends = np.cumsum(taken)
        flat = ids[np.repeat(begin[place] - (ends - taken), taken) + np.arange(ends[-1])]
        return np.bincount(owner, weights=taken, minlength=n).astype(np.int64), pa.array(flat.astype(np.int32))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the ids of every whole text, an end id after each document, in ascending doc_id order.

    Null texts count as empty and give the end id alone; null ids come first; rows that repeat an id follow each other in text
    order.  Other columns are ignored; an empty table writes no rows.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        part, offset = TaskContext.get().partitionId(), 0
        for batch, texts in pieces(batches, "text", SLICE_BYTES):
            sizes, ids = encoder.encode(batch.column(1), texts)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(offset + ends - sizes), batch.column(0), pa.array(sizes), lists],
                ["part", "offset", "doc_id", "n_tokens", "ids"],
            )
            offset += int(ends[-1])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = ordered.mapInArrow(run, f"part int, offset long, doc_id {doc_id}, n_tokens long, ids array<int>")
    (
        rows.write.format("orc")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("compression", "zstd")
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``: the number of ids of all documents before."""
    rows = spark.read.orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("held"))
    parts = len(rows.inputFiles())  # a part is a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file part
    bases = ends.select(F.col("part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(broadcast_checked(bases, parts), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter reaches the ORC reader, which skips by file, stripe and Bloom metadata."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def token_summary(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32 of every row."""
    from foldwright.llm.piece_codec import id_bytes_crc32

    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    rows = read_tokens(docs.sparkSession, path)
    return rows.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), id_bytes_crc32()("ids").alias("ids_crc32"))
