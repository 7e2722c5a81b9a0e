"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from foldwright.llm import embedding_dedup, exact_dedup, language_id, licenses, mixing, near_dedup, piece_codec, repeated_spans, token_files, toxicity

PIECES, TOKENS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while many other animals look on from the far side of a quiet river bank in the evening sun"
NEAR = BASE.replace("evening", "morning")
TEXTS = [
    (1, BASE, "a"), (2, "  " + BASE.replace(" ", "\t\n"), "a"), (3, NEAR, None), (4, None, "b"), (5, "", "b"), (6, "   \n\t", None), (7, LONG, "c"), (8, "x", "c"),
    (9, "A b", "d"), (10, "a  B", "d"), (11, "été 日本語 🙂 œuvre", "e"), (1, BASE, "a"), (None, BASE, "a"), (None, None, None), (14, LONG + " tail", "c"), (3, BASE + " again and again", "a"), (15, "%%% 123 ---", "e"),
]
SCHEMA = "doc_id long, text string, source string, lang string, body string, key long, part int, ids int, n long, id long, s string, address long, size int, copies int, score int"


def table(spark, rows=TEXTS, lang="en"):
    """Documents with columns named like those the operators use."""
    return spark.createDataFrame([(*r, lang, "b", 1, 2, 3, 4, 5, "s", 6, 7, 8, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact(docs, nothing):
    groups: dict[str, list] = {}
    for i, text, _ in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    want = Counter()
    for body, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, least, len(ids), i is not None and i == least, hashlib.sha256(body.encode()).hexdigest())] += 1
    for capacity in (20_000, 2):
        assert Counter(rows_of(exact_dedup.exact_dedup(docs, capacity))) == want
    assert rows_of(exact_dedup.exact_dedup(nothing)) == []


def test_index_splits_buckets(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2000) AS text")
    index = exact_dedup.build_index(rows, 100)
    sizes = index.cells.groupBy("depth", exact_dedup.prefix("address", 10).alias("p")).count()
    assert index.cells.count() == 2000 and sizes.count() > 20
    leaves = index.directory.collect()
    assert max(r["cells"] for r in leaves) <= 100 and sum(r["cells"] for r in leaves) == 2000
    assert abs(sum(2.0 ** -r["depth"] for r in leaves) - 1) < 0.2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_brute(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t)
    home = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, x in sets.items():
            for j, y in sets.items():
                c = len(x & y)
                if c and 100 * c >= 75 * len(x | y) and home[i] != home[j]:
                    home[i] = home[j] = min(home[i], home[j])
                    changed = True
    return Counter((i, len(shingles(t)), home.get(i), i is not None and home[i] == i) for i, t, *_ in rows)


def test_near(docs, nothing):
    assert Counter(rows_of(near_dedup.near_dedup(docs))) == near_brute(TEXTS)
    assert rows_of(near_dedup.near_dedup(nothing)) == []


def test_near_long_words(spark):
    """Words that sums modulo 2**64 cannot tell apart: a Thue-Morse word of 1024 letters and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, "s"), (2, other, "s"), (3, word, "s"), (4, " ".join([word] * 3 + ["x", "y", "z"]), "s"), (5, " ".join([other] * 3 + ["x", "y", "z"]), "s")]
    assert Counter(rows_of(near_dedup.near_dedup(table(spark, rows)))) == near_brute(rows)


def test_near_chains(spark):
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(80):  # each text is an edit of the one before it, so far ends of the chain differ
        words[rng.integers(60)] = f"v{i}"
        rows.append((i, " ".join(words), "s"))
    rows += [(100 + i, " ".join(f"u{x}" for x in rng.integers(0, 40, 30)), "s") for i in range(40)]
    assert Counter(rows_of(near_dedup.near_dedup(table(spark, rows)))) == near_brute(rows)


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 1500, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    x, y = np.r_[a, b], np.r_[a, rng.integers(0, 2**63, 700, dtype=np.uint64)]
    got = near_dedup.estimate_jaccard(near_dedup.sketch(x)[None], near_dedup.sketch(y)[None], np.array([2000]), np.array([2200]))[0]
    assert abs(got - 1500 / 2700) < 0.17
    assert (near_dedup.merge_sketches(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(x)).all()


def spans_brute(rows):
    body = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in body:
        for k in range(len(b) - 49) if i is not None else ():
            w = b[k : k + 50]
            least[w] = min(i, least.get(w, i))
    out = Counter()
    for i, b in body:
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_spans(docs, nothing):
    assert Counter(rows_of(repeated_spans.remove_repeats(docs))) == spans_brute(TEXTS)
    assert rows_of(repeated_spans.remove_repeats(nothing)) == []


def test_spans_shared_passages(spark):
    rng = np.random.default_rng(5)
    passages = ["".join(rng.choice(list("abcde "), 70)) for _ in range(6)] + ["ab" * 60, "z" * 90]
    rows = [(int(i), "".join(p if rng.random() < 0.5 else "".join(rng.choice(list("abcdé "), 20)) for p in rng.permutation(passages)[:4]), "s") for i in rng.permutation(60)]
    assert Counter(rows_of(repeated_spans.remove_repeats(table(spark, rows)))) == spans_brute(rows)


@pytest.mark.parametrize("block_bytes", [150, 1000, 20000])
def test_spans_shared_ids_over_blocks(spark, block_bytes):
    """Rows of one id in several blocks, an id with more rows than a block holds, and one phrase in ever new surroundings."""
    rng = np.random.default_rng(block_bytes)
    phrase = "the same forty-two letters in every document."
    passages = ["".join(rng.choice(list("abcde "), 70)) for _ in range(5)]
    rows = []
    for _ in range(90):
        parts = [p if rng.random() < 0.4 else "".join(rng.choice(list("xyzé "), 30)) for p in rng.permutation(passages)[:3]]
        rows.append((int(rng.choice([3, 3, 3, 7, *range(10, 40)])), "".join(parts) + phrase + "".join(rng.choice(list("uvw "), 40)), "s"))
    assert Counter(rows_of(repeated_spans.remove_repeats(table(spark, rows).repartition(4), block_bytes))) == spans_brute(rows)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(12), 50, 301]:
        for a in (1, 2, 6):
            s = rng.integers(1, a + 1, n)
            assert repeated_spans.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_pieces(docs, nothing):
    import sentencepiece

    plain = {(r["doc_id"], r["text"] or ""): list(r["ids"]) for r in piece_codec.encode(docs, PIECES, 0.0, keep=["doc_id", "text"]).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(ids == library.encode(text) for (_, text), ids in plain.items())
    varied = rows_of(piece_codec.round_trip(docs, PIECES, 0.1))
    assert len(varied) == len(TEXTS) and all(r[5] and r[3] == r[4] for r in varied)
    assert Counter(rows_of(piece_codec.round_trip(docs.repartition(5), PIECES, 0.1))) == Counter(varied)
    assert [r[1] for r in rows_of(piece_codec.round_trip(docs, PIECES, 0.1, 2))] != [r[1] for r in varied]
    assert rows_of(piece_codec.round_trip(nothing, PIECES)) == []


def test_pieces_agree_for_long_stretches():
    tables = piece_codec.PieceTables.load(PIECES)
    row = tables.symbols[np.array([ord(c) for c in "internationalisations" * 1])]
    for limit in (0, 2**29, 2**31):
        both = piece_codec.merge_rows(tables, row[None], np.array([9], dtype=np.uint64), np.array([4]), limit)[0], piece_codec.merge_agenda(tables, row, np.uint64(9), 4, limit)
        assert both[0].tolist() == both[1].tolist()


def test_tokens(docs, nothing, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENS)
    special = [(20, "hello <|endoftext|> there", "s"), (21, "a<|endoftext|>", "s"), (22, "<|endoftext|><|endoftext|> <|end of text|>", "s")]
    docs = table(spark, [*TEXTS, *special])
    ordered = sorted(((i, t or "") for i, t, _ in [*TEXTS, *special]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = Counter(), 0
    for i, t in ordered:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want[(i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
        start += len(ids)
    path = str(tmp_path / "tokens")
    assert Counter(rows_of(token_files.token_summary(docs, TOKENS, path))) == want
    assert {r["doc_id"] for r in token_files.find_tokens(spark, path, [7, 9, 77]).collect()} == {7, 9}
    assert rows_of(token_files.token_summary(nothing, TOKENS)) == []


def test_language(docs, nothing, spark):
    mixed = [(i, " ".join(w), "s") for i, w in enumerate([["the", "cat", "and", "dog", "is", "here"]] * 40 + [["der", "hund", "und", "katze", "ist", "hier"]] * 40)]
    taught = spark.createDataFrame([(i, t, "en" if i < 40 else "de") for i, t, _ in mixed], "doc_id long, text string, lang string")
    model = language_id.LanguageModel.fit(taught)
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame([(1, "the dog is here and the cat"), (2, "der hund und katze"), (3, None), (4, "12 %"), (5, "the cat and dog is here " * 20 + "der hund und katze ist hier " * 20)], "doc_id long, text string"), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and found[3]["score"] == 0
    assert {x["lang"] for x in found[5]["languages"]} == {"en", "de"} and 0.3 < found[5]["score"] < 0.7
    rows = language_id.language_of_documents(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert Counter(r["lang_pred"] for r in rows)["und"] == sum(not any(c.isalpha() for c in t or "") for _, t, _ in TEXTS)
    assert rows_of(language_id.language_of_documents(nothing)) == []
    assert language_id.keep_identified(docs).columns == docs.columns


def test_mix(docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in TEXTS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sizes, targets = {}, {r["source"]: r["target"] for r in rows}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, closed, rest = {}, set(), float(sum(sizes.values()))
    while True:  # reshare the excess until no target is above three times its source
        level = rest / sum(w for s, w in weight.items() if s not in closed) if len(closed) < len(order) else 0
        over = {s for s in order if s not in closed and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            rest -= want[s]
        closed |= over
    want |= {s: level * weight[s] for s in order if s not in closed}
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in order)
    assert Counter(tuple(r) for r in mixing.mix_sources(docs.repartition(7)).collect()) == Counter(tuple(r) for r in rows)
    assert rows_of(mixing.mix_sources(nothing)) == []
    assert mixing.apply_mix(docs).columns == docs.columns


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 300)), f"s{int(rng.integers(0, 4)) if rng.random() < 0.6 else 0}") for i in range(900)]
    taken = mixing.mix_sources(table(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    assert all(abs(r["sum(taken)"] / r["first(target)"] - 1) < 0.01 for r in taken)


def test_licenses(spark, nothing):
    mit = "Copyright (c) 2001 Some Body\n\n" + licenses._MIT.replace('"', "”").upper()
    rows = [(1, mit), (2, None), (3, ""), (4, "Intro line\nreleased under the MIT licence!\nLicensed under CC BY-NC 4.0"), (4, "Intro line\nreleased under the MIT licence!\nLicensed under CC BY-NC 4.0"), (5, "MIT License"), (None, mit)]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license_id"], r["notices"]) for r in found) == Counter([(1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, "CC-BY-NC-4.0,MIT"), (4, None, "CC-BY-NC-4.0,MIT"), (5, None, ""), (None, "MIT", "")])
    # notices belong to their row, whatever ids rows share
    rows = [(4, "x\nLicensed under the MIT License."), (4, "plain words"), (None, "Licensed under CC BY-NC 4.0"), (None, "other words")]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["notices"]) for r in found) == Counter([(4, "MIT"), (4, ""), (None, "CC-BY-NC-4.0"), (None, "")])
    assert rows_of(licenses.license_scan(nothing)) == []


def test_long_tokens_are_decoded_in_time():
    import time

    started = time.time()
    token = "".join("a1b0c3d"[i % 7] for i in range(1_000_000))
    assert len("".join(toxicity.decode(_Flat(), token))) > 0
    assert time.time() - started < 90


class _Flat:
    """A character model in which every letter is alike."""

    def log(self, context: str, letter: str) -> float:
        return -1.0


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(4)
    clean = ["river", "stone", "garden", "window", "letter", "summer", "market", "simple", "island", "mother", "doctor"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 12))
        if i % 4 == 0:
            words[3:5] = ["idiot", "moron"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 4 == 0), 1))
    given = table(spark, rows)
    marks = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    scored = {r["doc_id"]: r for r in toxicity.toxicity_of_documents(given, marks).collect()}
    assert all((scored[i]["score"] >= 0.7) == (i % 4 == 0) == bool(scored[i]["predicted"]) for i in scored) and len(scored) == 400
    model = toxicity.ToxicityModel.fit(given, marks)
    for token, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("idiooooot", "idiot")]:
        assert toxicity.words_of(model.characters, token) == [word]
    assert [r["restored"] for r in toxicity.restore_text(spark.createDataFrame([(1, "The r1ver i d i o t!"), (2, None)], "doc_id long, text string"), model.characters).collect()] == ["the river idiot", None]
    assert len(model.score(docs).collect()) == len(TEXTS)
    assert rows_of(toxicity.toxicity_of_documents(nothing, marks.limit(0))) == []


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    vectors = [(i, [float(x) for x in base[i % 60] + 0.02 * rng.standard_normal(16)], int(i % 2)) for i in range(180)]
    vectors += [(200, vectors[0][1], 0), (201, vectors[0][1], 1), (202, vectors[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None] + [1.0] * 15, 0), (207, [], 0), (208, [2 * x for x in vectors[0][1]], 0), (209, [1.0, 0.0], 0), (None, vectors[0][1], 0), (200, vectors[0][1], 0)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<double>, label int, id string, code int")).collect()
    good = [(i, np.array(v), y) for i, v, y in vectors if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {k: set() for k in range(len(good))}
    for a, (_, x, p) in enumerate(good):
        for b, (_, y, q) in enumerate(good):
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    want = Counter()
    for a, (i, _, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min(good[k][0] for k in seen)
        want[(i, len(links[a]), least, i == least)] += 1
    want += Counter((i, 0, i, i is not None) for i, v, y in vectors if not any(i == g[0] for g in good))
    assert Counter(tuple(r) for r in got) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rows_of(embedding_dedup.embedding_dedup(empty)) == []
