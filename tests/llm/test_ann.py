import random

import numpy as np
import pytest

from case_insights.llm.ann import CentroidGraph, balanced_centroids, nearest_by_inner_product
from case_insights.llm.entry import queries

SCHEMA = "vec_id long, embedding array<float>, list int, n long"


def exact(rows, asked, k):
    out = {}
    for q, x in asked:
        found = sorted((-float(np.dot(np.array(x), np.array(y))), i) for i, y in rows if i != q)
        out[q] = found[:k]
    return out


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    assert balanced_centroids(x, 37).shape == (37, 8)
    same = np.ones((100, 8))
    assert np.allclose(balanced_centroids(same, 10), 1)


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(2)
    centroids, x = rng.normal(size=(400, 16)), rng.normal(size=(100, 16))
    ids, dist = CentroidGraph(centroids).nearest(x, 32)
    true = ((x[:, None] - centroids[None]) ** 2).sum(2).argsort(1)[:, :8]
    hits = np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), true.tolist())])
    assert hits > 0.9 and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(r)) == len(r) for r in ids.tolist())


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in queries()["op1_posting_lists"](spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        assert all(s == pytest.approx(float(x[ids == i][0] @ x[ids == q][0]), abs=1e-12) for _, i, s in got)
        hits += len(best & {i for _, i, _ in got})
        total += 20
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_blocks(spark):
    rng = random.Random(4)
    good = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)]
    good += [(i, good[7][1]) for i in range(200, 260)]
    odd = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [1.0]), (305, []),
           (306, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows = [(i, v, 1, 2) for i, v in [*good, good[3], *odd]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = exact(good, [g for g in good if g[0] % 20 == 0], 20)
    # one list: the search is exact, whatever the blocks
    for block in (4096, 16):
        got = nearest_by_inner_product(frame, frame.filter("vec_id % 20 = 0"), list_rows=1000, block_rows=block).collect()
        found = {}
        for r in sorted(got, key=lambda r: r.rank):
            found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert found == {q: [(pytest.approx(s), i) for s, i in best] for q, best in want.items()}


def test_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (1, [2.0, 1.0], 1, 1)], SCHEMA)
    got = nearest_by_inner_product(frame, frame.filter("vec_id % 20 = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4.0)]
    assert nearest_by_inner_product(frame.limit(0), frame.limit(0)).collect() == []
    assert nearest_by_inner_product(frame, frame.limit(0)).collect() == []
