"""Each stage against brute force over what the stage before it kept."""

import itertools
import random
import re
import string

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from case_insights.llm.entry import queries, vocabulary_path
from tests.llm.test_similarity import removed_by_definition
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def five_words(text):
    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.schema == before.schema, name
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert kept[name].keys() <= {r.doc_id for r in before.select("doc_id").collect()}
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, second, third, fourth = (kept[name] for name, _ in corpus_pipeline.STAGES[:-1])
    assert all(r == source[i] for i, r in first.items()) and len(first) > 0.8 * len(source)

    sets = {i: five_words(r.text) for i, r in first.items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    assert second.keys() == {i for i, g in group.items() if i == g}

    removed = {i: n for i, _, n, _ in removed_by_definition([(i, r.text) for i, r in second.items()])}
    assert third.keys() == second.keys()
    for i, r in third.items():
        assert len(r.text.split()) == len(second[i].text.split()) - removed[repr(i)]
        assert r.n_chars == len(r.text) and (removed[repr(i)] or r == second[i])

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, r in fourth.items() if any(t in r.text for t in items)]
    assert all(r == third[i] for i, r in fourth.items()) and len(fourth) > 0.7 * len(third)

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(pieces, [(i, r.text) for i, r in fourth.items()], Tokenizer.from_file(vocabulary_path()), 1024)


def test_empty_and_odd_documents(spark, docs, no_docs):
    for table, at_most in ((no_docs, 0), (docs, docs.count())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = stage(spark, table, SF)
            assert table.columns == columns and table.count() <= at_most
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() >= bool(at_most)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_keep_every_row(spark, name):
    """One row for each row of the table that the query is over; pieces, pairs and neighbours have more or fewer."""
    found = queries()[name](spark, SF)
    if name.startswith("op11_"):
        assert found.count() == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").filter("embedding is not null").count()
    elif name.startswith(("op1_", "op5_", "op8_", "op12_")):
        assert found.count()
    else:
        table = "pages" if name.startswith(("op6_", "op7_")) else "documents"
        assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"
    ]


def test_near_copies_from_four_fifths(spark):
    """A text cut from 200 to 166 words shares 162 of 196 five-word shingles; one cut to 150 words 146 of them."""
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" for i in range(200)]
    texts = [words, words[:166], other, other[:150]]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == [0, 2, 3]


def test_leaks_go_row_by_row(spark):
    """Rows with a null or repeated doc_id go by their own texts."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{clean} {item}"), (None, clean), (None, None), (1, clean), (1, f"{item} {clean}"), (2, ""), (3, clean), (3, clean)]
    rng = random.Random(5)  # a table of a few passages has too few directions for cosines to tell
    rows += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.reject_leaks(spark, docs, SF).collect()]
    left = [x for x in left if x[0] is None or x[0] < 100]
    assert sorted(left, key=repr) == sorted([(None, clean), (None, None), (1, clean), (2, ""), (3, clean), (3, clean)], key=repr)
