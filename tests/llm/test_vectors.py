"""Vector operators against brute force, and on odd rows."""

import numpy as np
import pytest

pytest.importorskip("tesserine.llm.entries")

from tesserine.llm import embedding_dedup, graph, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "v", 2) for i, v, label in rows], SCHEMA)


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [0.0] * 15, 1), (905, [1.0] * 16, None), (906, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def vectors(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, n // 2)] + rng.choice([0.0, 0.05, 0.1, 0.2]) * rng.standard_normal(16).astype(np.float32)
    return x


def test_embedding_dedup_brute_force(spark):
    x = vectors()
    label = np.arange(len(x)) % 2
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, [*((i, v, int(label[i])) for i, v in enumerate(x)), *ODD])).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    reach = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(reach, np.where(link, reach[None], len(x)).min(axis=1))
        if (new == reach).all():
            break
        reach = new
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == reach.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert got[None].n_links == 0 and got[None].kept


def test_embedding_dedup_large_bucket(spark):
    """More near copies than a block holds, and exact copies."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, base + 0.01 * rng.standard_normal(16), 1) for i in range(1300)] + [(2000 + i, base, 1) for i in range(50)]
    got = embedding_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.n_links for r in got} == {1349} and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_embedding_dedup_empty(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(frame(spark, ODD)).count() == len(ODD)


def test_nearest_recall_and_scores(spark):
    x = np.random.default_rng(2).standard_normal((3000, 16)).astype(np.float32)
    rows = [*((i, v, 0) for i, v in enumerate(x)), *((9000 + r[0] if r[0] is not None else None, *r[1:]) for r in ODD)]
    got = nearest.nearest(frame(spark, rows), "vec_id % 100 = 0").toPandas()
    d = x.astype(float)
    hit = 0
    extra = [9905]  # a valid vector of the same length
    ids = np.array([*range(3000), *extra])
    d = np.concatenate([d, np.ones((1, 16))])
    for q in range(0, 3000, 100):
        far = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.array_equal(mine["score"], far[[np.flatnonzero(ids == v)[0] for v in mine["vec_id"]]])
        hit += len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, far))[:10]]))
    assert hit / 300 >= 0.9


def test_nearest_ties_and_few(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(0, 40)] + [(100, [9.0, 9.0, 9.0], 0), (200, [1.0, 2.0], 0)]
    got = nearest.nearest(frame(spark, rows), "vec_id % 100 = 0").toPandas().sort_values(["query_id", "rank"])
    assert got[got["query_id"] == 0]["vec_id"].tolist() == list(range(1, 11))
    assert got[got["query_id"] == 100]["vec_id"].tolist() == list(range(10))  # far away: searched against all
    assert 200 not in got["query_id"].tolist()  # no vector of its length
    assert nearest.nearest(frame(spark, []), "vec_id % 100 = 0").count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 4000 + i) for i in range(100)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if n in got} and all(find(n) == n for n in root if n not in got)


def test_labels_of_other_types(spark):
    x = [1.0] * 16
    rows = [(1, x, "a"), (2, x, "a"), (3, x, "b"), (4, x, None)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, x, l) for i, x, l in [(1, x, 1.2), (2, x, 1.9), (3, x, 1.2)]], "vec_id long, embedding array<float>, label double")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
