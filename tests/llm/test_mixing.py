import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from case_insights.llm.entry import queries
from case_insights.llm.mixing import mix_sources, sainte_lague, targets


def by_quotients(votes, seats, most):
    held = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v > 0 and held[i] < most[i]]
        if not open_:
            break
        held[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * held[i] + 1), -i))] += 1
    return held


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        votes = [rng.choice([0, 1, 3, rng.randint(1, 1000)]) for _ in range(n)]
        most = [rng.choice([0, 2, 1000]) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert sainte_lague(votes, seats, most) == by_quotients(votes, seats, most), (votes, seats, most)
    assert sainte_lague([], 5, []) == []


def test_targets_stop_at_the_cap_and_the_rest_is_shared():
    assert targets([100, 100], [1, 3]) == [50, 150]
    assert targets([10, 100, 0], [3, 1, 2]) == [30, 80, 0]
    got = targets([1, 5, 1000, 20], [3, 3, 1, 2])
    assert got[:2] == [3, 15] and sum(got) == 1026 and got[3] == 60
    assert targets([0, 0], [1, 2]) == [0, 0] and targets([], []) == []


def judge(rows, texts):
    """Rows (doc_id, size, source_size, target, taken, source, passes, spans) against what the contract asks."""
    sizes = defaultdict(int)
    for _, text, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    want = dict(zip(order, targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(
        (i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in texts
    )
    took = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == float(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.passes * r.size + sum(s.stop - s.start for s in r.spans)
        assert all(0 <= s.start < s.stop <= r.size for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
        took[r.source] += r.taken
    for s in order:
        assert abs(took[s] - want[s]) <= max(0.01 * want[s], 3), (s, took[s], float(want[s]))


def test_rows_nobody_thinks_of(spark, texts):
    rows = [(i, t, [None, "a", "Z", "é", "tiny", "none"][k % 4 if k > 3 else 4]) for k, (i, t) in enumerate(texts)]
    rows += [(500, "one two three", "tiny"), (501, "", "none"), (None, None, "none"), (9000, "w " * 30000, "a")]
    rows += [(7, "same words each time", "Z")] * 700 + [(None, None, "a")] * 600 + [(8, "x", "é"), (8, "y", "é")]
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], schema + ", size int, shard string").repartition(5)
    got = mix_sources(df, shard_rows=64, shard_words=2000)
    judge(got.collect(), rows)
    again = mix_sources(df.repartition(2, "text"), shard_rows=64, shard_words=2000)
    key = ["doc_id", "size", "source_size", "target", "taken", "source", "shard"]
    assert Counter(got.select(key).collect()) == Counter(again.select(key).collect())
    assert mix_sources(df.limit(0)).collect() == []
    blank = mix_sources(df.filter("text is null")).collect()
    assert blank and all(r.taken == 0 and r.target == 0 for r in blank)


def test_many_bundles_share_a_source(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, shard_rows=2, block_tokens=1)
    assert got.filter("shard >= 1024").count()
    judge(got.collect(), rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_table(spark, sf):
    got = queries()["op13_source_mix"](spark, sf)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    judge(got.collect(), texts)
