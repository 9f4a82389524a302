"""Hard negatives from exact integer scores: Strassen products of anchor and candidate tiles.

- Vectors of whole numbers are dealt to blocks of bounded size by a hash, so equal vectors or a frequent label
  fill several blocks. A tile is one block of anchors with one block of candidates.
- The scores of a tile are one matrix product by Strassen's recursion, seven products of half the size in place of
  eight, with zero rows or columns where a side is odd. Sums are of 64-bit whole numbers, hence exact.
- First anchors meet the rows of their own label; each tile returns an anchor's best few, and heaps of tiles are
  merged. Then anchors meet all rows, with a window of scores for each positive; each tile returns the best few rows
  of another label within a window, and these are merged likewise.

The anchors are a stated set of queries: every anchor meets every row, in tiles, and a tile gives a few rows for each
of its anchors, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.llm.sized import broadcast_if_small
from case_insights.llm.store import saved

LEAST = 32  # a side of this length or less is multiplied plainly
SLICE = 256  # anchors of a tile scored at once


def strassen(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> np.ndarray:
    """a @ b for whole numbers, by Strassen's recursion down to sides of ``least``. Exact wherever the result
    fits: sums that wrap around on the way there do so modulo 2^64, and back."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= least:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, least)
    p2 = strassen(a21 + a22, b11, least)
    p3 = strassen(a11, b12 - b22, least)
    p4 = strassen(a22, b21 - b11, least)
    p5 = strassen(a11 + a12, b22, least)
    p6 = strassen(a21 - a11, b11 + b12, least)
    p7 = strassen(a12 - a22, b21 + b22, least)
    out = np.empty((a.shape[0], b.shape[1]), p1.dtype)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(n, -1)


def _first(ids: np.ndarray, order: np.ndarray, k: int, repeats: bool) -> np.ndarray:
    """The first ``k`` places of ``order``, one for each id."""
    if repeats:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


def _candidates(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    right = right.sort_by("vec_id")
    ids = right.column("vec_id").to_numpy()
    return ids, _matrix(right.column("x")), right.column("label").to_numpy(), bool((ids[1:] == ids[:-1]).any())


def _best_positives(k: int):
    """(anchor_id, vec_id, score): the best ``k`` other rows of a tile for each anchor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, x, _, repeats = _candidates(right)
            anchors, y = left.column("anchor_id").to_numpy(), _matrix(left.column("x"))
            for at in range(0, len(anchors), SLICE):
                score = strassen(y[at : at + SLICE], x.T)
                for anchor, s in zip(anchors[at : at + SLICE], score):
                    near = np.flatnonzero(ids != anchor)
                    if len(near) > 4 * k and not repeats:  # all that tie with the k best
                        near = near[s[near] >= np.partition(s[near], len(near) - k)[len(near) - k]]
                    best = _first(ids, near[np.argsort(-s[near], kind="stable")], k, repeats)
                    out[0].append(np.full(len(best), anchor, np.int64))
                    out[1].append(ids[best])
                    out[2].append(s[best])
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), map(pa.array, columns))))

    return run


def _best_negatives(k: int, low: int):
    """(anchor_id, positive_id, positive_score, vec_id, score): for each anchor and positive the best ``k`` rows of
    a tile with another label and a score from ``low`` percent of the positive's score up to that."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            ids, x, labels, repeats = _candidates(right)
            anchors, own, y = left.column("anchor_id").to_numpy(), left.column("label").to_numpy(), _matrix(left.column("x"))
            positives = left.column("positives").to_pylist()
            for at in range(0, len(anchors), SLICE):
                score = strassen(y[at : at + SLICE], x.T)
                for i, s in enumerate(score, at):
                    other = np.flatnonzero(labels != own[i])
                    other = other[np.argsort(-s[other], kind="stable")]
                    falling = -s[other]
                    for p in positives[i]:
                        top, bottom = p["score"], -(-low * p["score"] // 100)
                        start, stop = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -bottom, "right")
                        best = _first(ids, other[start : max(start, stop)], k, repeats)
                        for column, value in zip(out, (anchors[i], p["vec_id"], top)):
                            column.append(np.full(len(best), value, np.int64))
                        out[3].append(ids[best])
                        out[4].append(s[best])
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "vec_id", "score"), map(pa.array, columns))))

    return run


def _merged(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The best ``k`` of all tiles for each key; a vec_id counts once, with its best score."""
    best = found.groupBy(*key, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _tiles(anchors: DataFrame, rows: DataFrame, key: list[str], anchor_rows: int, tile_rows: int):
    """Both sides grouped by ``key`` and tile. Their columns ``a`` and ``n``: rows of either side that meet."""
    a, n = F.ceil(F.col("a") / anchor_rows), F.ceil(F.col("n") / tile_rows)
    left = anchors.withColumns({
        "i": F.pmod(F.xxhash64("anchor_id"), a), "j": F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    })
    right = rows.withColumns({
        "i": F.explode(F.sequence(F.lit(0).cast("long"), a - 1)), "j": F.pmod(F.xxhash64("vec_id", "x"), n)
    })
    key = [*key, "i", "j"]
    return left.drop("a", "n").groupBy(*key).cogroup(right.drop("a", "n").groupBy(*key))


def mine_hard_negatives(
    vectors: DataFrame,
    anchor_ids: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    anchor_rows: int = 4096,
    tile_rows: int = 8192,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` is (vec_id, label, x: whole numbers; other columns are ignored), ``anchor_ids`` (vec_id). A row's score
    is its inner product with the anchor, higher ones first, ties to the smaller vec_id. An anchor's positives are its
    first other rows of the same label, all if fewer. For each, the first rows of another label with
    ``low * positive_score <= 100 * score <= 100 * positive_score`` are returned, rank from 1; a pair without any has
    no row.

    Rows with a null vec_id, label or x, or with a null in x or another dimension than most rows (the smaller, if
    equally many), take no part. Equal rows count once. Of different rows with one vec_id that is an anchor, the
    smallest (label, then x) is the anchor; as candidates each is judged, and a list names a vec_id once, with its best
    score. An empty table gives no rows. Numbers so large that 100 times a score could leave 64 bits are an error."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<long>").alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null and forall(x, c -> c is not null)")
    peak = F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))
    dimension, largest = rows.agg(F.mode(F.size("x"), True), peak).first()
    if not dimension:
        return spark.createDataFrame([], schema)
    if 100 * dimension * largest**2 >= 1 << 63:
        raise ValueError(f"scores of {dimension} components up to {largest:g} don't fit 64 bits")
    rows = saved(rows.filter(F.size("x") == dimension).distinct(), "mining-rows")
    anchors = rows.join(anchor_ids.select("vec_id").distinct(), "vec_id", "left_semi")
    anchors = saved(
        anchors.groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "x")).alias("row")).select("anchor_id", "row.*"),
        "mining-anchors",
    )
    by_label = saved(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy("label").agg(F.count(F.lit(1)).alias("a")), "label"),
        "mining-labels",
    )
    small = broadcast_if_small(by_label, by_label.count())
    found = _tiles(anchors.join(small, "label"), rows.join(small, "label"), ["label"], anchor_rows, tile_rows).applyInArrow(
        _best_positives(positives), "anchor_id long, vec_id long, score long"
    )
    found = _merged(found, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asking = saved(anchors.join(found, "anchor_id"), "mining-positives")
    both = {"a": F.lit(asking.count()), "n": F.lit(rows.count())}
    found = _tiles(asking.withColumns(both), rows.withColumns(both), [], anchor_rows, tile_rows).applyInArrow(
        _best_negatives(negatives, low), "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    )
    return _merged(found, ["anchor_id", "positive_id", "positive_score"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
