"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``virtual_nodes`` places on the ring of 64-bit hashes, each row the place of its doc_id's hash.
The arc before a virtual node belongs to its shard. A shard takes rows up to its load bound; rows beyond it
go on clockwise to the next shard with room. The bounds add up to the number of rows, so counts differ by one
at most.

Only the number of rows of each arc (``shards * virtual_nodes`` of them, whatever the input) comes to the
driver. There the overflow is worked out for whole runs of an arc's rows; a row then finds its shard and
slot from its rank within the arc. Arcs are parts of a hash range, so equal texts or a frequent source
don't gather in one.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = "rows"


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard). Places of a shard don't depend on the number of shards."""

    def place(name: str) -> int:
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)

    return sorted((place(f"{s}/{v}"), s) for s in range(shards) for v in range(virtual_nodes))


def bounded_runs(counts: list[int], owner: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, from, to, shard, slot) that place the rows of every arc: ranks from <= rank < to within
    the arc go to ``shard``, the first of them to ``slot``.

    First every shard takes rows of its own arcs, clockwise, up to its bound; then what is left over goes on
    clockwise, arc by arc, to the next shard that has room."""
    free, used, runs, left = list(bounds), [0] * len(bounds), [], []

    def take(arc: int, start: int, stop: int, shard: int) -> int:
        n = min(stop - start, free[shard])
        if n:
            runs.append((arc, start, start + n, shard, used[shard]))
            free[shard] -= n
            used[shard] += n
        return start + n

    for arc, n in enumerate(counts):
        start = take(arc, 0, n, owner[arc])
        if start < n:
            left.append((arc, start, n))
    for arc, start, stop in left:
        step = 1
        while start < stop:
            start = take(arc, start, stop, owner[(arc + step) % len(owner)])
            step += 1
    return runs


def shard_by_ring(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs`` (doc_id, text;
    other columns are ignored).

    law is ``rows``: the numbers of rows of the shards differ by one at most. size: bytes of the text plus 16;
    text_crc32: of its UTF-8 bytes; a null text counts as empty. slot numbers a shard's rows without gaps from
    0. grown_shard is null, as this law moves rows between old shards when one is added. Rows of one doc_id
    stay in hash order next to each other, ordered by checksum and size; rows that are equal in these too are
    interchangeable. A null doc_id has a place like any other. An empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("place"),
    )
    nodes = ring(shards, virtual_nodes)
    places, owner = [p for p, _ in nodes], [s for _, s in nodes]
    # the arc of a row: how many nodes lie below its place, found within its 1/4096 of the ring
    low = -(1 << 63)
    cells = [
        (c, bisect.bisect_left(places, low + (c << 52)), [p for p in places if low + (c << 52) <= p < low + ((c + 1) << 52)])
        for c in range(4096)
    ]
    cell = spark.createDataFrame(cells, "cell int, below int, inside array<long>")
    rows = rows.withColumn("cell", (F.shiftright("place", 52) + 2048).cast("int")).join(F.broadcast(cell), "cell")
    arc = F.col("below") + F.size(F.filter("inside", lambda p: p < F.col("place")))
    rows = rows.withColumn("arc", F.pmod(arc, F.lit(len(nodes))).cast("int")).drop("cell", "below", "inside")

    counts = [0] * len(nodes)
    for a, n in rows.groupBy("arc").count().collect():  # one row for each arc at most
        counts[a] = n
    total = sum(counts)
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    runs = spark.createDataFrame(
        bounded_runs(counts, owner, bounds), "arc int, start long, stop long, shard int, slot0 long"
    )
    order = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    # at most two runs for each arc and one more for each shard it overflows to
    placed = ranked.join(F.broadcast(runs), "arc").filter("rank >= start and rank < stop")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(ROWS).alias("law"), "shard",
        (F.col("slot0") + F.col("rank") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
