"""The character model of the noisy channel learns from all texts, labelled or not."""

import math

import numpy as np
import pytest

from foldwright.llm import toxicity

CLEAN = ["river", "stone", "garden", "window", "letter", "summer", "market", "simple"]


def test_unlabelled_texts_teach_the_model(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(CLEAN, 8))) for i in range(60)] + [(100 + i, "дурак говорит глупости, дурак!") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    characters = toxicity.ToxicityModel.fit(docs, labels).characters
    assert characters.log("ду", "р") > math.log(0.5)
    assert toxicity.words_of(characters, "дуууураааак") == ["дурак"]
    assert toxicity.words_of(characters, "д у р а к") == ["дурак"]


@pytest.mark.parametrize("held", [2, 50_000])
def test_logarithms_equal_exact_counts(spark, monkeypatch, held):
    words = [*CLEAN, "été", "日本語", "river", "summer"]
    monkeypatch.setattr(toxicity, "HELD_WORDS", held)
    model = toxicity.CharacterModel.fit(spark.createDataFrame([(i, w.upper() + "!") for i, w in enumerate(words)] + [(99, None), (98, "")], "doc_id long, text string").repartition(3))
    grams = [f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)]
    for a, b, c in set(grams):
        p = 0.75 * grams.count(a + b + c) / sum(g[:2] == a + b for g in grams) + 0.2 * sum(g[1:] == b + c for g in grams) / sum(g[1] == b for g in grams) + 0.05 * sum(g[2] == c for g in grams) / len(grams)
        assert model.log(a + b, c) == pytest.approx(math.log(p), rel=1e-5)
    assert model.log("ri", "語") == pytest.approx(math.log(0.05 / len(grams)), rel=1e-5)
    assert model.log("ri", "q") == toxicity.LEAST_LOG
