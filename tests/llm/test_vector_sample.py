"""The sample that rotations are fitted on: the same rows as a sort, without n rows of every task on their way to the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import embedding_dedup


def table(spark, ids):
    rows = [(i, [float(k), 1.0], k % 3) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(8)


@pytest.mark.parametrize("bits", [2, 12])
@pytest.mark.parametrize("n", [1, 40, 300, 500])
def test_rows_of_a_sort(spark, monkeypatch, bits, n):
    monkeypatch.setattr(embedding_dedup, "STRETCH_BITS", bits)
    rows = table(spark, range(300))
    want = rows.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    assert embedding_dedup.least_hashed(rows, n).collect() == want


@pytest.mark.parametrize("ids", [[7] * 300, [7] * 200 + list(range(100)), list(range(100)) * 3])
def test_rows_of_equal_id(spark, ids):
    rows = table(spark, ids)
    got = embedding_dedup.least_hashed(rows, 50).collect()
    want = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("label", "embedding")).limit(50).collect()
    assert got == want
    assert embedding_dedup.least_hashed(rows.repartition(3), 50).collect() == want


@pytest.mark.parametrize("ids", [range(4000), [7] * 3000 + list(range(1000))])
def test_few_rows_leave_the_tasks(spark, ids):
    rows = table(spark, ids)
    keys = [F.xxhash64("id"), F.xxhash64("label", "embedding")]
    assert 100 <= embedding_dedup.shortlist(rows, keys, 100).count() <= 200


def test_sample_comes_from_a_short_list(spark, monkeypatch):
    seen = []
    own = embedding_dedup.shortlist
    monkeypatch.setattr(embedding_dedup, "shortlist", lambda rows, keys, n: seen.append((own(rows, keys, n).count(), n)) or own(rows, keys, n))
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 50)
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), 0) for i in range(400)], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.embedding_dedup(vectors).count() == 400
    assert [n for _, n in seen] == [50] and 50 <= seen[0][0] <= 100
