import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from case_insights.llm.entry import queries
from case_insights.llm.whitening import add_rows, combine, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, x array<long>"


def scatter(x):
    away = x - x.mean(0)
    return away.T @ away


def test_secular_roots():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 10, 64):
        d, z = np.sort(rng.normal(size=m) * 10), rng.normal(size=m) * 10.0 ** rng.integers(-6, 3, m)
        roots, apart = secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        scale = max(np.abs(want).max(), 1)
        assert np.abs(roots - want).max() < 1e-13 * scale
        assert np.abs(d - roots[:, None] - apart).max() < 1e-13 * scale
        assert (np.diag(apart) < 0).all()  # a root lies above its pole


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 6), st.lists(st.lists(st.integers(-3, 3), min_size=6, max_size=6), min_size=1, max_size=25), st.integers(0, 12))
def test_rows_one_by_one_and_parts_combined(dimension, rows, power):
    x = np.array(rows)[:, :dimension] * 2**power
    values, vectors = add_rows(x)
    scale = max(1.0, scatter(x).trace())
    assert np.abs(vectors.T @ vectors - np.eye(dimension)).max() < 1e-11
    assert np.abs(vectors @ np.diag(values) @ vectors.T - scatter(x)).max() < 1e-11 * scale
    cut = len(x) // 2
    if cut:
        one, two = ((len(p), p.sum(0), *add_rows(p)) for p in (x[:cut], x[cut:]))
        n, total, values, vectors = combine(one, two)
        assert n == len(x) and (total == x.sum(0)).all()
        assert np.abs(vectors @ np.diag(values) @ vectors.T - scatter(x)).max() < 1e-11 * scale


def test_equal_eigenvalues_are_deflated():
    values, vectors = rank_one(np.full(5, 2.0), np.eye(5), np.array([3.0, 0, 4, 0, 0]))
    assert np.allclose(values, [2, 2, 2, 2, 27], atol=1e-14)
    assert np.allclose(np.abs(vectors[:, -1]), [0.6, 0, 0.8, 0, 0])
    same = rank_one(values, vectors, np.zeros(5))
    assert same[0] is values


def judge(got, rows, components=4):
    """The result against numpy's eigendecomposition and whole-number arithmetic."""
    kept = [(i, x) for i, x in rows if x is not None and None not in x]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, dimension = fit.shape
    total = [sum(int(v) for v in column) for column in fit.T]
    centred = (fit * n - np.array(total)) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, dimension)
    assert len(got) == len(kept) * k
    want, found = defaultdict(list), defaultdict(list)
    for i, x in kept:
        want[i].append([sum((n * int(c) - s) ** 2 for c, s in zip(x, total)), x])
    by_component = defaultdict(list)
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-9
        found[r.vec_id].append(int(r.deviation_exact))
        assert r.deviation == (int(r.deviation_exact) if r.deviation_exact < 1 << 63 else None)
        by_component[r.component].append(r)
    assert {i: sorted(d for d, _ in w) for i, w in want.items()} == {i: sorted(set_) [::k] for i, set_ in found.items()}
    assert set(by_component) == set(range(1, k + 1))
    for c, rs in by_component.items():
        if e[c - 1] <= 1e-12 * e[0] or e[0] == 0:
            assert all(r.whitened is None and r.explained == 0 for r in rs)
            continue
        assert all(math.isclose(r.explained, e[c - 1] / np.trace(v), rel_tol=1e-9) for r in rs)
        gaps = [abs(e[c - 1] - e[j]) for j in range(dimension) if j != c - 1]
        if gaps and min(gaps) < 1e-6 * e[0]:
            continue
        axis = axes[:, c - 1]
        axis = axis * np.sign(axis[np.abs(axis).argmax()]) / math.sqrt(e[c - 1])
        ours = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in rs)
        theirs = sorted((i is None, i or 0, float((np.array(x, float) - np.array(total) / n) @ axis)) for i, x in kept)
        assert [o[:2] for o in ours] == [t[:2] for t in theirs]
        assert np.allclose([o[2] for o in ours], [t[2] for t in theirs], rtol=1e-7, atol=1e-8)


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", n long, values double").repartition(3)
    return whiten(df, **sizes).collect()


def test_many_small_parts_give_the_same(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-40, 40) * (j + 1) for j in range(7)]) for i in range(400)]
    judge(run(spark, rows, part_rows=9, fan=3), rows)
    judge(run(spark, rows), rows)


def test_rows_nobody_thinks_of(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-5, 5) for _ in range(3)] + [7]) for i in range(40)]
    rows += [(1, [0, 0, 0, 0])] * 30 + [(None, [1, 2, 3, 4])] * 2 + [(5, None), (6, [1, None, 2, 3])]
    judge(run(spark, rows + [(7, [1, 2]), (8, [])], part_rows=5), rows)
    one = run(spark, [(1, [3, 4]), (2, [3, 4])])
    assert len(one) == 4 and all(r.whitened is None and r.explained == 0 and r.n == 1 and r.deviation == 0 for r in one)
    flat = [(i, [i, 2 * i, 3 * i]) for i in range(9)]
    judge(run(spark, flat), flat)
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []


def test_large_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-(1 << 45), 1 << 45) for _ in range(3)]) for i in range(30)]
    got = run(spark, rows)
    assert any(r.deviation is None for r in got)
    judge(got, rows)
    with pytest.raises(ValueError, match="62"):
        run(spark, [(i, [(1 << 61) + i]) for i in range(5)])


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op11_whitening"](spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, [math.floor(256 * c) for c in r.embedding]) for r in rows]
    judge(got.collect(), rows)
