"""Mixing sources to target weights: whole blocks of tokens dealt out by Sainte-Laguë apportionment.

- A source's share of all tokens follows its weight. No source is asked for more than ``cap`` times what it has;
  what is cut off goes to the others by weight, until none is above.
- A source's documents are dealt to shards of bounded size by a hash, and lie there one behind the other in hash
  order. A shard is cut into blocks of equally many tokens, to within one.
- Sainte-Laguë: seats, which are blocks, go one by one to the highest quotient votes / (2 * seats + 1). Sources get
  theirs by their targets; a source's seats go to bundles of its shards, and a bundle's to its shards, by the blocks
  they hold. No group of more than a bundle's shards, or a source's bundles, meets in one place.
- A shard with more seats than blocks takes each block as often as the quotient says, and the rest of its seats go to
  blocks drawn without replacement by a generator seeded with the shard.

Only a few numbers for each source come to the driver: a mix is a list of sources with weights.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm.sized import broadcast_if_small
from case_insights.llm.store import saved

WORD = r"[^\x20\x09-\x0D]+"
BUNDLE = 1024  # shards that share out one quota
CHUNK = 256  # repeats of a row that stay together
FINE = 256  # blocks that the least target holds at least, while blocks can be made smaller


def targets(sizes: Sequence[int], weights: Sequence[int], cap: int = 3) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight, none above ``cap`` times its size."""
    out: dict[int, Fraction] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        level = Fraction(sum(sizes)) - sum(out.values())
        level = level / sum(weights[i] for i in free) if free else level
        above = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not above:
            return [out.get(i, weights[i] * level) for i in range(len(sizes))]
        out |= {i: Fraction(cap * sizes[i]) for i in above}


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """``seats`` dealt to the highest quotients votes / (2 * held + 1), ties to the earlier one; nobody holds more
    than ``most``. Without room or votes for all seats, some stay free.

    Rounding at any divisor gives the seats for some total; from there seats are added or taken back one by one."""
    share = sum(votes) / seats if seats else 0
    held = [min(m, int(v / share + 0.5)) if share else 0 for v, m in zip(votes, most)]
    free = seats - sum(held)
    if free >= 0:
        heap = [(-v / (2 * h + 1), i) for i, (v, h, m) in enumerate(zip(votes, held, most)) if h < m and v > 0]
        heapq.heapify(heap)
        while free and heap:
            _, i = heapq.heappop(heap)
            held[i] += 1
            free -= 1
            if held[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
        return held
    heap = [(votes[i] / (2 * h - 1), -i) for i, h in enumerate(held) if h]
    heapq.heapify(heap)
    for _ in range(-free):
        _, i = heapq.heappop(heap)
        held[-i] -= 1
        if held[-i]:
            heapq.heappush(heap, (votes[-i] / (2 * held[-i] - 1), i))
    return held


def _deal(key: str, cap: int):
    """The seats of a group, the same on each of its rows, dealt to the rows by their blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        most = [cap * b for b in rows["blocks"]]
        rows["seats"] = sainte_lague([float(b) for b in rows["blocks"]], int(rows["seats"].iloc[0]), most)
        return rows

    return run


def _take(seed: int):
    """Rows of a shard with the words taken: whole passes, and spans [start, stop) of words on top."""

    def run(rows: pa.Table, quota: pa.Table) -> pa.Table:
        at, shard = rows.column("at")[0].as_py(), rows.column("shard")[0].as_py()
        rows = rows.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("chunk", "ascending")])
        copies = rows.column("copies").to_numpy()
        rows = rows.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        size = rows.column("size").to_numpy()
        end = np.cumsum(size)
        start, words = end - size, int(end[-1])
        blocks, seats = (quota.column(c)[0].as_py() if quota.num_rows else 0 for c in ("blocks", "seats"))
        passes, extra = divmod(seats, blocks) if blocks else (0, 0)
        drawn = np.sort(np.random.default_rng([seed, at, shard]).permutation(blocks)[:extra])
        first = np.ones(extra, bool)
        first[1:] = drawn[1:] != drawn[:-1] + 1  # runs of neighbouring blocks
        last = np.append(first[1:], True) if extra else first
        run_start, run_end = (b * words // max(blocks, 1) for b in (drawn[first], drawn[last] + 1))
        low = np.searchsorted(run_end, start, "right")
        n = np.where(size > 0, np.maximum(np.searchsorted(run_start, end, "left") - low, 0), 0)
        row = np.repeat(np.arange(len(size)), n)
        offsets = np.concatenate([[0], np.cumsum(n)])
        piece = np.arange(len(row)) - offsets[row] + low[row]
        from_, to = np.maximum(run_start[piece], start[row]) - start[row], np.minimum(run_end[piece], end[row]) - start[row]
        taken = passes * size + np.bincount(row, to - from_, len(size)).astype(np.int64)
        spans = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays([pa.array(from_, pa.int64()), pa.array(to, pa.int64())], ["start", "stop"]),
        )
        return pa.table({
            "at": rows.column("at"), "shard": rows.column("shard"), "doc_id": rows.column("doc_id"), "size": rows.column("size"),
            "taken": pa.array(taken, pa.int64()), "passes": pa.array(np.full(len(size), passes), pa.int32()), "spans": spans,
        })

    return run


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    block_tokens: int = 64,
    shard_rows: int = 4096,
    shard_words: int = 1 << 20,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, shard, passes, spans`` for each row of ``docs`` (doc_id,
    text, source; other columns are ignored).

    size: words of the text; a null or blank text has none. source_size: words of the row's source; target: words
    that the mix asks of it. Sources in order of code points, null last, have the ``weights`` in turn. The mix takes
    the row's text ``passes`` times and the words of ``spans``, numbered from 0 and excluding stop, once more; taken
    is the number of words in that, at most ``cap * size``.

    Blocks hold ``block_tokens`` words, fewer where the least target would otherwise hold under 256 of them, so that
    small sources come near their target too. Which blocks are drawn follows from the rows and ``seed`` alone. Rows
    that agree in source, doc_id (null included) and size are interchangeable; they are counted first and dealt in
    chunks, so that very many of them spread over shards. A very long text is a shard of its own at worst. A table
    without words takes nothing; an empty table gives no rows."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = saved(
        docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
        .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")),
        "mix-sizes",
    )
    blank = F.when(F.col("size") == 0, F.col("copies")).otherwise(0)
    found = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies") - F.sum(blank), F.sum(blank)).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    asked = targets([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))], cap)
    block = int(max(1, min([block_tokens, *(t // FINE for t in asked if t)])))
    sources = broadcast_if_small(
        spark.createDataFrame(
            [
                (i, name, words, float(t), max(1, -(-rows // shard_rows), -(-words // shard_words)), max(1, -(-blank // shard_rows)))
                for i, ((name, words, rows, blank), t) in enumerate(zip(found, asked))
            ],
            "at int, name string, source_size long, target double, shards long, blank_shards long",
        ),
        len(found),
    )
    draw = F.xxhash64(F.lit(seed), "doc_id", "size", "chunk")
    # rows without words lie apart, so that every other shard holds as many words as rows at least
    shard = F.when(F.col("size") > 0, F.pmod(draw, "shards")).otherwise(F.col("shards") + F.pmod(draw, "blank_shards"))
    placed = (
        counted.join(sources.select("at", "name", "shards", "blank_shards"), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})")))
        .select(
            "at", "doc_id", "size", "chunk", F.least(F.lit(CHUNK), F.col("copies") - CHUNK * F.col("chunk")).alias("copies"),
            shard.alias("shard"),
            F.xxhash64(F.lit(seed + 1), "doc_id", "size", "chunk").alias("place"),
        )
    )
    words = F.sum(F.col("size") * F.col("copies")).cast("long").alias("words")
    # as many blocks as words at most, and none without words
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long")
    shards = saved(
        placed.groupBy("at", "shard").agg(words).withColumn("blocks", blocks)
        .withColumn("bundle", F.expr(f"shard div {BUNDLE}")),
        "mix-shards",
    )
    held = {r.at: r.n for r in shards.groupBy("at").agg(F.sum("blocks").alias("n")).collect()}
    # a target in blocks as long as the source's own ones are
    votes = [float(t * held[i] / r[1]) if r[1] else 0.0 for i, (r, t) in enumerate(zip(found, asked))]
    seats = sainte_lague(votes, round(sum(votes)), [cap * held[i] for i in range(len(found))])
    quotas = spark.createDataFrame(list(enumerate(seats)), "at int, seats long")
    bundles = shards.groupBy("at", "bundle").agg(F.sum("blocks").alias("blocks"))
    bundles = bundles.join(broadcast_if_small(quotas, len(found)), "at").groupBy("at").applyInPandas(
        _deal("bundle", cap), "at int, bundle long, blocks long, seats long"
    )
    quota = shards.drop("words").join(bundles.select("at", "bundle", "seats"), ["at", "bundle"]).groupBy("at", "bundle").applyInPandas(
        _deal("shard", cap), "at int, shard long, blocks long, bundle long, seats long"
    )
    key = ["at", "shard"]
    taken = placed.groupBy(*key).cogroup(quota.select(*key, "blocks", "seats").groupBy(*key)).applyInArrow(
        _take(seed),
        "at int, shard long, doc_id long, size long, taken long, passes int, spans array<struct<start:long,stop:long>>",
    )
    return taken.join(sources, "at").select(
        "doc_id", "size", "source_size", "target", "taken", F.col("name").alias("source"), "shard", "passes", "spans"
    )
