import hashlib
import itertools
import math
import random

import pytest

from case_insights.llm import jaccard
from case_insights.llm.graph import components
from case_insights.llm.jaccard import jaccard_components
from case_insights.llm.substring import SuffixAutomaton, remove_repeats

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    group = {n: n for e in edges for n in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: group[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _sets(text):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


@pytest.mark.parametrize("leaders", [(), (1, 2)])
def test_components_of_all_links(docs, texts, leaders):
    sets = [_sets(t) for _, t in texts]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(group[:], 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and 100 * shared >= 85 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    lowest = {}
    for (i, _), g in zip(texts, group):
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    expected = sorted(
        (repr(i), len(s), lowest.get(g) if s else i) for (i, _), s, g in zip(texts, sets, group)
    )
    found = jaccard_components(docs, leaders=leaders)
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in found.collect()) == expected


def test_pairs_of_long_rows_are_made_once(spark, monkeypatch):
    """Versions of a long text that stay just below the bound, and a few above: the last product makes a pair once or
    twice, not for each n-gram that both have, and texts are cut into sets three times, whatever the number of turns."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = []
    for i in range(24):
        words = list(base)
        for at in rng.sample(range(600), 3 if i % 6 == 0 else 16):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [_sets(t) for t in texts]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]

    made, cuts = [], []
    product, wanted = jaccard._product, jaccard._wanted_sets
    distinct = jaccard.DataFrame.distinct

    def counted(*args):
        with monkeypatch.context() as m:
            m.setattr(type(docs), "distinct", lambda df: df)
            out = product(*args)
        made.append(out.count())
        return distinct(out)

    monkeypatch.setattr(jaccard, "_product", counted)
    monkeypatch.setattr(jaccard, "_wanted_sets", lambda *args: cuts.append(1) or wanted(*args))
    found = {r.doc_id: r.component_id for r in jaccard_components(docs, leaders=(1,)).collect()}
    assert found == dict(enumerate(group))
    assert len(set(group)) > 10
    assert 0 < made[-1] <= 2 * math.comb(len(texts), 2)
    assert cuts == [1]


def test_no_documents(no_docs):
    assert jaccard_components(no_docs).collect() == []
    assert remove_repeats(no_docs).collect() == []


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(50):
        words = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for w in words[:3]:
            automaton.add(w)
        known = {tuple(w[i:j]) for w in words[:3] for i in range(len(w)) for j in range(i, len(w) + 1)}
        query = words[3]
        expected = [max(n for n in range(e + 2) if tuple(query[e + 1 - n : e + 1]) in known) for e in range(len(query))]
        assert automaton.matches(query) == expected


def removed_by_definition(texts, window=13):
    first = {}
    for i, t in texts:
        words = (t or "").encode().split()
        for a in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[a : a + window])
                first[key] = min(first.get(key, i), i)
    rows = []
    for i, t in texts:
        words = (t or "").encode().split()
        keep = [True] * len(words)
        for a in range(len(words) - window + 1):
            if i is not None and first[tuple(words[a : a + window])] < i:
                keep[a : a + window] = [False] * window
        kept = b" ".join(w for w, k in zip(words, keep) if k)
        rows.append((repr(i), len(words), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


@pytest.mark.parametrize("busy", [1000, 1])
def test_repeats_are_those_of_the_definition(docs, texts, busy):
    found = [
        (repr(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
        for r in remove_repeats(docs, shard_segments=busy).collect()
    ]
    assert sorted(found) == removed_by_definition(texts)


def test_repeats_at_random(spark):
    rng = random.Random(8)
    texts = []
    for i in range(300):
        words = [rng.choice(["a", "b"]) for _ in range(rng.randint(0, 40))]
        texts.append((rng.randrange(200), " ".join(words)))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = [
        (repr(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
        for r in remove_repeats(rows, filter_bits=1 << 16).collect()
    ]
    assert sorted(found) == removed_by_definition(texts)


def test_all_columns_can_be_kept(docs):
    found = remove_repeats(docs, keep=True)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert found.count() == docs.count()
