"""Approximate nearest neighbours by inner product: balanced posting lists, and a graph over their centroids.

- Vectors get one more component so that all have the same length; then the largest inner product is the
  smallest distance. Centroids come from a bounded sample by halving it again and again at the middle of the
  line between two means, so each stands for an equal share.
- Centroids are few enough for memory. A neighbour graph over them is searched with a beam, for all rows of a
  batch at once.
- A vector near the boundary is put into several lists: those whose centroid is not much further than the
  nearest one, unless a list that it is in lies in the same direction, its centroid close to that one beside the
  vector's distance. All rows are indexed.
- A query reads the lists whose centroid is within a ratio of the distance of its nearest one, and more until
  they hold enough rows. Lists and their queries are split into blocks of bounded size; each pair of blocks is
  one matrix product, with scores in double precision on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.llm.store import saved

LINKS, SPREAD_LINKS = 16, 4  # of a centroid: nearest others, and others anywhere


def _rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Means of ``lists`` parts of almost equal size."""
    rng = np.random.default_rng(seed)
    out = []

    def divide(x: np.ndarray, parts: int) -> None:
        if parts == 1 or len(x) <= 1:
            out.append(x.mean(0))
            return
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        left = parts // 2
        cut = len(x) * left // parts
        divide(x[order[:cut]], left)
        divide(x[order[cut:]], parts - left)

    divide(sample, max(1, min(lists, len(sample))))
    return np.array(out)


class CentroidGraph:
    """Beam search over centroids linked to their nearest ones."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        self.links = np.zeros((n, min(n, LINKS + SPREAD_LINKS)), np.int64)
        rng = np.random.default_rng(seed)
        for i in range(n):
            near = np.argsort(((self.centroids - self.centroids[i]) ** 2).sum(1), kind="stable")
            near = near[near != i][:LINKS]
            fill = self.links.shape[1] - len(near)
            self.links[i] = np.concatenate([near, rng.integers(0, n, fill)])

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the centroids found, nearest first, and their distances."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        x = x.astype(np.float32)
        start = np.linspace(0, k - 1, beam).astype(np.int64)
        ids = np.repeat(start[None], n, 0)
        dist = ((x[:, None] - self.centroids[start][None]) ** 2).sum(2)
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        open_ = np.ones((n, beam), bool)
        rows = np.arange(n)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, open_ = (np.take_along_axis(a, order, 1) for a in (ids, dist, open_))
            active = rows[open_.any(1)]
            if not len(active):
                return ids, np.sqrt(dist)
            at = open_[active].argmax(1)
            open_[active, at] = False
            new = self.links[ids[active, at]]
            d = ((x[active][:, None] - self.centroids[new]) ** 2).sum(2)
            d[seen[active[:, None], new]] = np.inf
            twice = np.sort(new, 1)
            if (twice[:, 1:] == twice[:, :-1]).any():  # a spread link may repeat another link
                for c in range(1, new.shape[1]):
                    d[:, c][(new[:, :c] == new[:, c : c + 1]).any(1)] = np.inf
            seen[active[:, None], new] = True
            width = new.shape[1]
            more_ids = np.zeros((n, width), np.int64)
            more_dist = np.full((n, width), np.inf, np.float32)
            more_ids[active], more_dist[active] = new, d
            ids, dist = np.concatenate([ids, more_ids], 1), np.concatenate([dist, more_dist], 1)
            open_ = np.concatenate([open_, np.isfinite(more_dist)], 1)


def _lists_of(graph, longest: float, ratio: float, spread: float, copies: int):
    """Rows (list, vec_id, vec): each vector in the lists it belongs to."""

    def run(batches):
        g = graph.value
        for batch in batches:
            x = _rows(batch.column("vec"))
            rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
            ids, dist = g.nearest(np.column_stack([x, rest]), 16)
            row, lists = [], []
            close = dist <= (1 + ratio) * dist[:, :1] + 1e-9
            for i in range(len(x)):
                chosen = []
                for c, d in zip(ids[i][close[i]].tolist(), dist[i][close[i]].tolist()):
                    apart = g.centroids[chosen] - g.centroids[c]
                    if chosen and (apart * apart).sum(1).min() < (spread * d) ** 2:
                        continue
                    chosen.append(c)
                    if len(chosen) == copies:
                        break
                row += [i] * len(chosen)
                lists += chosen
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), batch.column("vec_id").take(at), batch.column("vec").take(at)],
                ["list", "vec_id", "vec"],
            )

    return run


def _probes(graph, sizes, longest: float, ratio: float, beam: int, enough: int):
    """Rows (list, query_id, query): each query with the lists it reads."""

    def run(batches):
        g, size = graph.value, sizes.value
        for batch in batches:
            x = _rows(batch.column("vec"))
            q = x * (longest / np.sqrt((x * x).sum(1, keepdims=True)))
            ids, dist = g.nearest(np.column_stack([q, np.zeros(len(q))]), beam)
            before = np.cumsum(size[ids], axis=1) - size[ids]
            use = (dist <= (1 + ratio) * dist[:, :1]) | (before < enough)
            row, place = np.nonzero(use)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row, place], pa.int32()), batch.column("vec_id").take(at), batch.column("vec").take(at)],
                ["list", "query_id", "query"],
            )

    return run


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            x, ids = _rows(left.column("vec").combine_chunks()), left.column("vec_id").to_numpy()
            queries = _rows(right.column("query").combine_chunks())
            repeats = len(np.unique(ids)) < len(ids)
            for q, query in zip(right.column("query_id").to_pylist(), queries):
                score = np.einsum("ij,j->i", x, query)
                near = np.arange(len(score))
                if len(score) > 4 * k and not repeats:  # all that tie with the k + 1 best, one of which may be q
                    near = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                order = near[np.lexsort((ids[near], -score[near]))]
                order = order[ids[order] != q]
                if repeats:
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
                order = order[:k]
                out[0].append(np.full(len(order), q, np.int64))
                out[1].append(ids[order])
                out[2].append(score[order])
        columns = [np.concatenate(c) if c else [] for c in out]
        return pa.table({
            "query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
            "score": pa.array(columns[2], pa.float64()),
        })

    return run


def nearest_by_inner_product(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    list_rows: int = 100,
    sample_rows: int = 16_384,
    boundary_ratio: float = 0.15,
    spread: float = 0.3,
    copies: int = 4,
    search_ratio: float = 0.2,
    beam: int = 128,
    block_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id of ``queries`` its ``k`` best other rows found among
    ``vectors`` (both: vec_id, embedding), best first, ties to the smaller vec_id.

    score is the inner product in double precision. Rows with a null vec_id, and vectors that are null, zero,
    of another dimension than most, or with a null or non-finite component take no part. A vec_id that repeats
    counts once, with its best score. With fewer than ``k`` other rows all are returned; without any, or for an
    empty table, there is no row for a query.

    ``sample_rows`` bounds the rows that centroids are fitted on (those with the smallest hash). There is a list for
    every ``list_rows`` rows, but at most one for 32 sampled ones; beyond that lists grow, and blocks with them, so
    that a query's share of the rows, on which recall rests, stays the same."""
    spark = vectors.sparkSession

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
        return rows.filter(
            "vec_id is not null and vec is not null and exists(vec, x -> x <> 0) "
            "and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        )

    data = usable(vectors)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    shape = data.agg(F.mode(F.size("vec")), F.count("*"), F.max(norm)).first()
    dimension, total, longest = shape
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = data.filter(F.size("vec") == dimension)
    sample = data.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample_rows).select("vec").collect()
    x = np.array([r.vec for r in sample])
    x = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))])
    lists = max(1, min(math.ceil(total / list_rows), len(x) // 32))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, lists)))

    posting = saved(
        data.mapInArrow(_lists_of(graph, longest, boundary_ratio, spread, copies), "list int, vec_id long, vec array<double>"),
        "postings",
    )
    count = np.zeros(lists, np.int64)
    for at, n in posting.groupBy("list").count().collect():  # one row for each list
        count[at] = n
    asked = usable(queries).filter(F.size("vec") == dimension).dropDuplicates(["vec_id"])
    sizes = spark.sparkContext.broadcast(count)
    probe = saved(
        asked.mapInArrow(
            _probes(graph, sizes, longest, search_ratio, beam, 20 * k), "list int, query_id long, query array<double>"
        ),
        "probes",
    )
    # blocks: a list's rows by their hash, its queries by theirs; every pair of blocks meets once
    blocks = posting.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("n")).join(
        probe.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("m")), "list"
    )
    left = posting.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("vec_id", "vec"), "n").alias("i"), F.explode(F.expr("sequence(0L, m - 1)")).alias("j"),
        "vec_id", "vec",
    )
    right = probe.join(blocks, "list").select(
        "list", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"), F.pmod(F.xxhash64("query_id"), "m").alias("j"),
        "query_id", "query",
    )
    key = ["list", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
