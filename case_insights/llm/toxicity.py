"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed to ``2^bits`` buckets. The model adds a weight for each
term and, for each pair of terms, the product of their factors, so that a pair can be toxic whose terms alone
are not. The pairs cost no more than the terms: their sum is half of (sum of factors)^2 less the squares.

The model is fitted in one task on a sample of labelled rows that ``max_rows`` bounds, and sent to all tasks;
its size is fixed by ``bits`` and ``FACTORS``. Texts are scored where they are read, whole, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from case_insights.llm import words as W

FACTORS = 4
MIN_HOLDERS, MIN_SPREADS = 5, 3.5  # of a term: labelled rows, and standard deviations from the mean share
_SEED = 7


def _terms(batch: pa.RecordBatch, bits: int):
    """The sorted distinct buckets of each row, in one array, and the offsets of rows."""
    parts, sizes = [], []
    for part in W.slices(batch):
        data, offsets = W.text_bytes(part.column("text"))
        start, end, first = W.split_words(data, offsets, W.PUNCTUATION)
        bucket = (W.hash_words(data, start, end, lower=True) >> np.uint64(64 - bits)).astype(np.int64)
        row = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(first))
        both = np.unique((row << bits) | bucket)
        parts.append((both & ((1 << bits) - 1)).astype(np.int32))
        sizes.append(np.bincount(both >> bits, minlength=part.num_rows))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class FactorizationMachine:
    """Logistic factorization machine over sets of buckets, fitted by Adagrad."""

    def __init__(self, bits: int, bias: float = 0.0, weight=None, factor=None):
        self.bits, self.bias = bits, bias
        size = 1 << bits
        self.weight = np.zeros(size, np.float32) if weight is None else weight
        self.factor = np.zeros((size, FACTORS), np.float32) if factor is None else factor

    def raw(self, terms: np.ndarray, offsets: np.ndarray):
        """Log-odds of each row, and the sums of its factors."""
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets))
        linear, sums, squares = np.zeros(n), np.zeros((n, FACTORS)), np.zeros(n)
        if len(full):
            at = offsets[full]
            v = self.factor[terms].astype(np.float64)
            linear[full] = np.add.reduceat(self.weight[terms].astype(np.float64), at)
            sums[full] = np.add.reduceat(v, at)
            squares[full] = np.add.reduceat((v * v).sum(1), at)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, offsets)[0], -30, 30)))

    def fit(self, terms, offsets, label, epochs=60, rate=0.3, decay=2e-4, batch=256) -> FactorizationMachine:
        """Terms that too few rows hold, or that are about as frequent under either label, keep the weight 0 and
        no factors: with far more terms than rows they would only learn the rows by heart. ``decay`` pulls
        weights and factors to 0."""
        rng = np.random.default_rng(_SEED)
        share = min(max(label.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        size = np.diff(offsets)
        holders = np.bincount(terms, minlength=len(self.weight))
        toxic = np.bincount(terms, np.repeat(label, size), minlength=len(self.weight))
        spread = np.sqrt(np.maximum(holders * share * (1 - share), 1e-9))
        useful = (holders >= MIN_HOLDERS) & (np.abs(toxic - holders * share) >= MIN_SPREADS * spread)
        self.factor[useful] = rng.normal(0, 0.02, (np.count_nonzero(useful), FACTORS))
        kept = useful[terms]
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        terms = terms[kept]
        seen_w, seen_v = np.full(len(self.weight), 1e-6), np.full(self.factor.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                size = offsets[rows + 1] - offsets[rows]
                part = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(offsets[rows] - part[:-1], size) + np.arange(part[-1])
                t = terms[at]
                raw, sums = self.raw(t, part)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
                used, place = np.unique(t, return_inverse=True)
                e = np.repeat(error, size)
                grad_w = np.bincount(place, e, len(used)) / len(rows) + decay * self.weight[used]
                v = self.factor[t]
                pull = e[:, None] * (np.repeat(sums, size, axis=0) - v)
                grad_v = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(FACTORS)], 1)
                grad_v = grad_v / len(rows) + 5 * decay * self.factor[used]
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                self.weight[used] -= rate * grad_w / np.sqrt(seen_w[used])
                self.factor[used] -= 0.2 * rate * grad_v / np.sqrt(seen_v[used])
                self.bias -= rate * 0.1 * float(error.mean())
        return self


def _features(bits: int):
    def run(batches):
        for batch in batches:
            terms, offsets = _terms(batch, bits)
            rows = [terms[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "terms"]
            )

    return run


def _fitted(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        rows = [np.frombuffer(x, np.int32) for x in table.column("terms").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        label = table.column("label").to_numpy().astype(np.float64)
        model = FactorizationMachine(bits).fit(np.concatenate(rows), offsets, label)
        return pa.table({
            "bias": pa.array([model.bias]),
            "weight": pa.array([model.weight.tobytes()], pa.binary()),
            "factor": pa.array([model.factor.tobytes()], pa.binary()),
        })

    return run


def fit_toxicity(labelled: DataFrame, bits: int = 18) -> FactorizationMachine:
    """Fit on all rows of ``labelled`` (doc_id, text, label 0 or 1), in one task: the caller bounds them. No rows
    give a model that scores 0.5 everywhere."""
    rows = labelled.mapInArrow(_features(bits), "doc_id long, label int, terms binary")
    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fitted(bits), "bias double, weight binary, factor binary").first()
    if found is None:
        return FactorizationMachine(bits)
    return FactorizationMachine(
        bits, found.bias, np.frombuffer(found.weight, np.float32), np.frombuffer(found.factor, np.float32).reshape(-1, FACTORS)
    )


def _scored(model, keep: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            scores = []
            for part in W.slices(batch):
                terms, offsets = _terms(part, m.bits)
                scores.append(m.scores(terms, offsets))
            score = np.concatenate(scores) if scores else np.zeros(0)
            names = [c for c in batch.schema.names if keep or c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(score)], [*names, "score"])

    return run


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, keep: bool = False) -> DataFrame:
    """``doc_id, score`` for each row of ``docs`` (doc_id, text): the probability of label 1, 0 to 1; with ``keep``
    all columns of ``docs`` and score, which replaces a column of that name. A null text scores like an empty one;
    equal texts score alike. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * (1 + FACTORS) bytes for each of 2^bits buckets
    if keep:
        docs = docs.drop("score")
        schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    else:
        docs, schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double"
    return docs.mapInArrow(_scored(shared, keep), schema)


def held_out(doc_id):
    """Whether a row is held out of the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> DataFrame:
    """``doc_id, text, label`` of labelled rows (labels: doc_id, toxic) that aren't held out: all of them, or the
    ``max_rows`` with the smallest hash of doc_id. Repeated labels count once, the larger one; null ids and labels
    are left out. The bounded sample is broadcast to the texts, so these aren't shuffled."""
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, by a model fitted on its labelled rows
    that aren't held out. predicted is 1 from ``threshold`` on. A null doc_id isn't held out."""
    model = fit_toxicity(training_rows(docs, labels))
    return toxicity_scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
