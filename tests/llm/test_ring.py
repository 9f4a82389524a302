import random
import zlib
from collections import Counter, defaultdict

import pytest

from case_insights.llm.ring import bounded_runs, ring, shard_by_ring


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_counts_slots_and_sizes(docs, texts, shards):
    rows = shard_by_ring(docs, shards=shards).collect()
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == expected


def test_overflow_goes_clockwise():
    # four arcs; shard 0 is full after two rows of its own, the rest goes on to the next arcs with room
    assert bounded_runs([5, 1, 0, 0], [0, 1, 0, 2], [2, 2, 2]) == [
        (0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)
    ]


def test_runs_match_one_row_at_a_time():
    rng = random.Random(3)
    for _ in range(50):
        shards = rng.randint(1, 6)
        owner = [rng.randrange(shards) for _ in range(12)]
        owner[:shards] = range(shards)
        counts = [rng.choice([0, 0, 1, 3, 20]) for _ in owner]
        total = sum(counts)
        bounds = [total // shards + (s < total % shards) for s in range(shards)]
        load, placed, late = [0] * shards, {}, []
        for arc, n in enumerate(counts):
            for rank in range(n):
                if load[owner[arc]] < bounds[owner[arc]]:
                    placed[arc, rank] = owner[arc], load[owner[arc]]
                    load[owner[arc]] += 1
                else:
                    late.append((arc, rank))
        for arc, rank in late:
            at = arc
            while load[owner[at % len(owner)]] >= bounds[owner[at % len(owner)]]:
                at += 1
            shard = owner[at % len(owner)]
            placed[arc, rank] = shard, load[shard]
            load[shard] += 1
        runs = bounded_runs(counts, owner, bounds)
        assert {(a, r): (s, slot + r - x) for a, x, y, s, slot in runs for r in range(x, y)} == placed


def test_places_of_a_shard_stay():
    assert {x for x in ring(8, 16) if x[1] < 7} == set(ring(7, 16))


def test_most_rows_stay_when_a_shard_is_added(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "string(id) as text")
    old = {r.doc_id: r.shard for r in shard_by_ring(rows, shards=8).collect()}
    new = {r.doc_id: r.shard for r in shard_by_ring(rows, shards=9).collect()}
    assert sum(old[i] == new[i] for i in old) > 0.6 * len(old)


def test_no_rows(no_docs):
    assert shard_by_ring(no_docs).collect() == []
