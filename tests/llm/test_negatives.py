import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from case_insights.llm.entry import oracle_sql, queries
from case_insights.llm.negatives import mine_hard_negatives, strassen

SCHEMA = "vec_id long, label int, x array<long>"


def brute_force(rows, anchors, positives=5, negatives=5, low=80):
    """Rows of the result, from plain loops over Python's whole numbers."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    chosen = {}
    for i, label, x in rows:
        if i in anchors and (i not in chosen or (label, x) < chosen[i]):
            chosen[i] = (label, x)
    out = set()
    for a, (label, y) in chosen.items():
        scores = [(i, lab, sum(p * q for p, q in zip(y, x))) for i, lab, x in rows if i != a]
        same, best = defaultdict(lambda: None), None
        for i, lab, s in scores:
            if lab == label and (same[i] is None or s > same[i]):
                same[i] = s
        for p, ps in sorted(same.items(), key=lambda r: (-r[1], r[0]))[:positives]:
            best = {}
            for i, lab, s in scores:
                if lab != label and low * ps <= 100 * s <= 100 * ps and s > best.get(i, s - 1):
                    best[i] = s
            for rank, (i, s) in enumerate(sorted(best.items(), key=lambda r: (-r[1], r[0]))[:negatives], 1):
                out.add((a, p, rank, i, ps, s))
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (65, 33, 40), (97, 64, 131), (0, 64, 4), (40, 0, 40)])
def test_products_are_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
    assert (strassen(a, b, 4) == a @ b).all()
    # partial sums wrap, the result does not
    big = np.full((40, 40), (1 << 31) - 1)
    assert (strassen(big, np.eye(40, dtype=np.int64) * ((1 << 31) - 1), 4) == np.eye(40) * 0 + big * ((1 << 31) - 1)).all()


def random_rows(seed, n, dimension=6, spread=3):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-spread, spread + 2) for _ in range(dimension)]) for i in range(n)]


def run(spark, rows, anchors, **sizes):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA + ", score string, i int").repartition(3)
    ids = df.filter(df.vec_id.isin(anchors)) if anchors else df.limit(0)
    got = mine_hard_negatives(df, ids, **sizes).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


def test_many_small_tiles_give_the_same(spark):
    rows = random_rows(2, 150)
    anchors = set(range(0, 150, 10))
    want = brute_force(rows, anchors)
    assert len(want) > 100
    assert run(spark, rows, anchors, anchor_rows=3, tile_rows=11) == want
    assert run(spark, rows, anchors) == want


def test_rows_nobody_thinks_of(spark):
    rows = random_rows(5, 40) + random_rows(6, 12)  # other rows under the same ids
    rows += [(3, 0, [1] * 6)] * 30 + [(100 + i, 1, [1] * 6) for i in range(40)]  # repeats and ties
    rows += [(None, 1, [1] * 6), (200, None, [1] * 6), (201, 1, None), (202, 1, [1, None, 1, 1, 1, 1]), (203, 0, [0] * 6)]
    rows += [(204, 0, [-1] * 6), (205, 9, [2] * 6), (206, 8, [1] * 6)]  # 9 and 8 have no other row
    anchors = {0, 3, 4, 100, 201, 203, 204, 205, 206, 999}
    want = brute_force(rows, anchors)
    assert run(spark, rows + [(207, 0, [1]), (208, 0, [])], anchors, anchor_rows=2, tile_rows=7) == want
    assert run(spark, rows, set()) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert mine_hard_negatives(empty, empty).collect() == []
    only_nulls = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert mine_hard_negatives(only_nulls, only_nulls).collect() == []


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, [1 << 40]), (1, 0, [1]), (2, 1, [-(1 << 63)])], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        mine_hard_negatives(df, df)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op12_hard_negatives"](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(oracle_sql()["op12_hard_negatives"])
    assert got.columns == want.columns
    assert {tuple(r) for r in got.collect()} == set(want.fetchall()) != set()
