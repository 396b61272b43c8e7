"""Nearest neighbours when the index would take more directions than can be probed."""

import numpy as np
import pytest

pytest.importorskip("tesserine.llm.entries")

from tesserine.llm import nearest

SCHEMA = "vec_id long, embedding array<float>"


def test_recall_with_many_directions(spark, monkeypatch):
    monkeypatch.setattr(nearest, "directions", lambda count: 10)
    x = np.random.default_rng(2).standard_normal((6000, 16)).astype(np.float32)
    got = nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "vec_id % 100 = 0").toPandas()
    hit = 0
    for q in range(0, 6000, 100):
        far = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hit += len(set(got[got["query_id"] == q]["vec_id"]) & set(np.argsort(far)[:10].tolist()))
    assert hit / 600 >= 0.95


def test_every_query_below_target_is_searched_in_full(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TUPLES", 1)
    monkeypatch.setattr(nearest, "_misses", lambda index, q: False)
    x = np.random.default_rng(5).standard_normal((1500, 16)).astype(np.float32)
    got = nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "vec_id % 100 = 0").toPandas()
    for q in range(0, 1500, 100):
        far = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        assert set(got[got["query_id"] == q]["vec_id"]) == set(np.argsort(far)[:10].tolist())
