"""Nearest neighbours: what a task holds does not grow with the buckets that queries visit."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tesserine.llm.entries")

from tesserine.llm import nearest


def test_queries_are_sent_in_small_batches_and_held_in_none():
    x = np.random.default_rng(3).standard_normal((200, 16)).astype(np.float32)
    raw = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "vector"])
    index = nearest.Index(16, 4, 4.0, 4.0)
    sizes = nearest.Sizes({}, None)
    sent = list(nearest._probed({16: index}, sizes, x.dtype)(iter([raw])))
    want = {(i, t, n) for i, v in enumerate(x) for t, numbers in enumerate(index.probes(v.astype(float))) for n in numbers.tolist()}
    assert len(want) > 4 * nearest.SENT and max(b.num_rows for b in sent) <= nearest.SENT
    assert {(i, t, n) for b in sent for i, t, n in zip(*(b.column(c).to_pylist() for c in (5, 1, 2)), strict=True)} == want


def test_blocks_with_more_queries_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "BLOCKS", 1)
    monkeypatch.setattr(nearest, "ASKED", 7)
    x = np.random.default_rng(4).standard_normal((900, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[7].tolist()), (900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 3 = 0").toPandas()
    hit = 0
    for q in range(0, 900, 3):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[5] = min(far[5], far[7])
        far[q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 10 and np.allclose(mine["score"], far[mine["vec_id"]]) and mine["vec_id"].is_unique
        hit += len(set(mine["vec_id"]) & set(np.argsort(far)[:10].tolist()))
    assert hit / 3000 >= 0.95 and not set(got["query_id"]) - set(range(900))
