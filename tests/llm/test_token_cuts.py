"""Token ids of texts cut at spaces, against the library."""

import numpy as np
import pyarrow as pa
import pytest

from foldwright.llm import token_files
from foldwright.llm.common import vocabulary

PARTS = ["word", "Été", "don't", "it's,", "a.b", "3.14", "12", "x1", "end.", "no!", "why?", "so;", "...", "(in", "out)", ",", "-", "|", "", " ", "\n", "\n\n", "\t", "\r\n", "line\nnext", "stop.\nGo", "汉字", " ", "\x01", "\x0e", "<|endoftext|>"]


def _texts(seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["", " ", ".", "a", "\n", *(" ".join(rng.choice(PARTS[: 9 if k % 2 else None], rng.integers(1, 30))) for k in range(400))]


@pytest.mark.parametrize("table", [250_000, 20])
def test_ids_are_those_of_the_library(monkeypatch, table):
    monkeypatch.setattr(token_files, "CACHED_WORDS", table)
    encoder = token_files.WordEncoder(vocabulary("byte_bpe_50k.json"))
    for seed in range(4):
        texts = _texts(seed)
        column = pa.array([None, *texts])
        sizes, ids = encoder.encode(column, ["", *texts])
        want = [e.ids + [token_files.END] for e in encoder.library.encode_batch_fast(["", *texts], add_special_tokens=False)]
        got = np.split(ids.to_numpy(), np.cumsum(sizes)[:-1])
        assert [g.tolist() for g in got] == want


def test_usual_texts_are_cut_without_the_pattern(monkeypatch):
    encoder = token_files.WordEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["One line, of words. Then it's\nanother; why? No: 3.14!", "Été"]
    monkeypatch.setattr(encoder, "_apart", None)  # not called
    sizes, ids = encoder.encode(pa.array(texts), texts)
    assert ids.to_pylist() == [i for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False) for i in [*e.ids, token_files.END]] and len(sizes) == 2
