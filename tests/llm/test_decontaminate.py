import random

import numpy as np

from case_insights.llm.decontaminate import _any_of, _signatures, _sums, common_subsequence, find_leaks
from case_insights.llm.entry import queries

SF = "/root/testdata/sf0.1"


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        places = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        assert common_subsequence(a, places, b) == table[-1, -1]


def test_leaks_of_the_table(spark):
    """All verbatim copies are found, and nothing but documents that share long runs of words with an item."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries()["op5_decontaminate"](spark, SF).collect()}
    plain = {(d, i) for i, t in items.items() for d, x in texts.items() if t in x}
    assert plain and len(plain - found) <= 0.02 * len(plain)
    runs = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in items.items())}
    for d, i in found - plain:
        w = texts[d].lower().split()
        assert runs[i] & {tuple(w[a : a + 5]) for a in range(len(w) - 4)}, (d, i)


def test_paraphrases_and_odd_rows(spark, docs, no_docs):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30)) + f". The answer is {i} of all {i + 1} there.") for i in range(20)]
    items += [(50, None), (51, ""), (52, "too short"), (None, "x" * 9), items[0]]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")

    def noise(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    rows = []
    for i, text in items[:20]:
        words = text.split()
        for at in rng.sample(range(len(words) - 8), 6):
            words[at] = "other"
        rows.append((i, noise(rng.randint(0, 300)) + " " + " ".join(words) + " " + noise(rng.randint(0, 300))))
    rows += [(100 + i, noise(300)) for i in range(100)]
    rows += [(200, None), (201, ""), (None, rows[3][1]), rows[3]]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (4096, 5):
        found = [(r.doc_id, r.item_id) for r in find_leaks(texts, benchmark, items_per_block=block).collect()]
        assert sorted(found, key=repr) == sorted([*((i, i) for i in range(20)), (3, 3), (None, 3)], key=repr)
    assert find_leaks(no_docs, benchmark).collect() == []
    assert find_leaks(docs, benchmark.limit(0)).collect() == []
    assert find_leaks(docs, benchmark).collect() == []


def test_item_in_half_of_the_documents(spark):
    """Copies don't take the weight from an item's words."""
    rng = random.Random(7)

    def noise(n):
        return " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(n))

    item = " ".join(f"q{i}" for i in range(30)) + "."
    rows = [(i, noise(80) + (f" {item} " if i % 2 else " ") + noise(80)) for i in range(400)]
    found = find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(1, item), (2, noise(30))], "item_id long, text string"),
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, 1) for i in range(1, 400, 2)]


def test_short_items_and_long_ones(spark):
    """Items below eight words are found as exact runs, and such runs only; longer ones at any length."""
    rng = random.Random(9)

    def noise(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    items = {i: " ".join(f"s{i}x{j}" for j in range(n)) for i, n in enumerate([1, 2, 3, 6, 6, 7])}
    items |= {i: noise(n) + "." for i, n in ((10, 30), (11, 150), (12, 600))}
    items[20] = items[3]  # the same words under another id
    rows = [(i, f"{noise(50)} {t.upper()}! {noise(50)} {t}") for i, t in items.items()]
    broken = items[4].split()
    rows += [(100, f"{noise(20)} {' '.join(broken[:3])} other {' '.join(broken[3:])}"), (101, None), (102, ""),
             (103, " ".join(broken[:5])), (104, " ".join(broken[1:]) + " " + broken[0])]
    found = find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    wanted = [(i, i) for i in items if i > 1] + [(3, 20), (20, 3)]
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted(wanted)
    assert {r.near_word for r in found if r.item_id in (2, 3, 4, 5, 20)} == {50}


def test_signatures_bound_the_words_in_common():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 16, 4000).astype(np.uint16)
    starts = np.arange(0, 4000, 8)
    runs = _any_of(_signatures(ids, starts), 7)
    for _ in range(200):
        at = int(rng.integers(0, 490))
        near = ids[8 * at : 8 * at + 56]
        item = np.concatenate([rng.choice(near, 10), rng.integers(0, 1 << 16, 20).astype(np.uint16)])
        missing = np.bitwise_count(_signatures(item, np.array([0]))[0] & ~runs[at]).sum()
        assert len(item) - missing >= np.isin(item, near).sum()


def test_sums_of_runs():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(50, 7))
    for lengths in ([1], [8, 8, 3], rng.integers(1, 90, 40).tolist(), [1000, 1, 2]):
        which = rng.integers(0, 50, sum(lengths))
        starts = np.cumsum([0, *lengths[:-1]])
        for width in (2, 8, 32):
            assert np.allclose(_sums(rows, which, starts, width), np.add.reduceat(rows[which], starts))
