import random
import zlib

import numpy as np

from case_insights.llm.entry import queries
from case_insights.llm.toxicity import FactorizationMachine, fit_toxicity, judge_toxicity, training_rows


def test_factors_learn_pairs():
    """A pair of terms is toxic, each of them alone is not: no sum of weights can tell."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.4
        rows.append(np.array([1] * int(insult) + [2] * int(group) + sorted(rng.choice(np.arange(3, 60), 5, replace=False).tolist())))
        label.append(float(insult and group))
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = FactorizationMachine(6).fit(np.concatenate(rows), offsets, np.array(label))

    def score(*terms):
        return model.scores(np.array(terms), np.array([0, len(terms)]))[0]

    assert score(1, 2) > 0.7 and score(1) < 0.3 and score(2) < 0.3 and model.scores(np.zeros(0, int), np.zeros(2, int))[0] < 0.3
    pair = float(model.factor[1] @ model.factor[2])
    assert pair > 0


def test_held_out_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries()["op2_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(found[x.doc_id].predicted, x.toxic) for x in labels if found[x.doc_id].held_out]
    flagged = [t for p, t in held if p]
    assert sum(flagged) / len(flagged) > 0.9
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.6


def test_odd_rows(spark, docs, no_docs, texts):
    rng = random.Random(1)
    labels = spark.createDataFrame(
        [(i, rng.randint(0, 1), "x") for i, _ in texts if i is not None] + [(None, 1, "x"), (1, None, "x"), (8, 1, "x")],
        "doc_id long, toxic int, text string",
    )
    rows = judge_toxicity(docs, labels).collect()
    assert len(rows) == len(texts)
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert scores[1] == scores[2] == scores[3] and scores[8] == scores[9]
    assert judge_toxicity(no_docs, labels).collect() == []
    assert {r.score for r in judge_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    training = training_rows(docs, labels)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in training.collect())
    assert training_rows(docs, labels, max_rows=5).select("doc_id").distinct().count() <= 5
    assert fit_toxicity(training).bits == 18
