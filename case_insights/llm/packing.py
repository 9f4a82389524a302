"""Packing of whole documents into sequences of a fixed length, related ones together.

1. Texts are tokenised once. A document's full windows are sequences of their own; what is left of it, a tail
   shorter than a window, is stored with its ids. The number of documents that hold each token is counted
   over all of them; the vocabulary bounds that table.
2. Tails are dealt by content to shards of about ``shard_tails`` rows: each goes to the nearest of a set of
   centroids of projected TF-IDF vectors, and there to a bucket by the smallest hash of its terms. Buckets follow one
   another in a fixed order that is cut into shards of one size; what is too large for a shard, such as many copies,
   is spread over several. Each shard is a BM25 inverted index of its tails, whose terms are tokens.
3. In a shard the next unused tail is a seed and opens a sequence; the index gives its unused neighbours by
   falling score, which fill the window. The last one is cut where the window ends, its rest stays unused.
   Only the last sequence of a shard has padding.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm import words as W
from case_insights.llm.store import saved

# Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_BYTES = 1 << 23  # of text whose words are encoded together
K1, B = 1.2, 0.75
NEAREST = 32  # neighbours sorted first; all others follow if a window takes more
DIRECTIONS, BUCKETS = 128, 256  # of a projected tail; of a centroid's tails
MAX_CENTROIDS, SAMPLE_PER_CENTROID, ROUNDS = 4096, 16, 8  # bound the fit, not the tails dealt
_SEED = 5

# Fixed value: white space for the pattern above.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Where a cut before a space could change the ids: within a run of white space, or before a space that ends the text.
_UNSAFE = rf"[{_SPACE}] (?:[{_SPACE}]|\z)"
_ODD = rf"\A\z|\A[{_SPACE}]|[{_SPACE}]\z"


class Encoder:
    """Ids of whole texts. Each distinct word of a batch, with the space before it, is encoded once, all in one call;
    its ids are then put where it stands. ``special``: tokens that text can spell, each with its id."""

    def __init__(self, vocabulary: list[bytes], special: dict[str, int] | None = None):
        import tiktoken

        ranks = {piece: i for i, piece in enumerate(vocabulary)}
        self.codec = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special or {}
        last = max([len(vocabulary) - 1, *self.special.values()])
        self.kind = np.dtype("<u2" if last < 1 << 16 else "<u4")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.spelt = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.sizes = np.array([len(piece) for piece in vocabulary], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.codec.encode_ordinary(text), self.kind)

    def _whole(self, text: str) -> np.ndarray:
        parts = self.spelt.split(text) if self.spelt else [text]  # every other part is a special token
        return np.concatenate(
            [np.array([self.special[x]], self.kind) if i % 2 else self._ids(x) for i, x in enumerate(parts)])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null has none), and the n + 1 offsets of rows."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        first = words.offsets.to_numpy().astype(np.int64)
        first, flat = first - first[0], words.flatten()
        coded = flat.dictionary_encode()
        # a text's first word has no space before it; a whole text is one word here
        heads = flat.take(pa.array(first[:-1])).to_pylist()
        own = [self._whole(texts[i].as_py()) if w else self._ids(heads[i]) for i, w in enumerate(whole.to_pylist())]
        # words that begin or end with white space could join with the next one
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        usual = coded.dictionary.filter(pa.array(~odd))
        joined = self._ids("".join(" " + w for w in usual.to_pylist()))
        ends = np.cumsum(pc.binary_length(usual).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cut = np.searchsorted(np.cumsum(self.sizes[joined]), ends) + 1
        own_odd = [self._ids(" " + w) for w in coded.dictionary.filter(pa.array(odd)).to_pylist()]
        sizes = np.concatenate([np.diff(cut, prepend=0), [len(x) for x in own_odd], [len(x) for x in own]]).astype(np.int64)
        values = np.concatenate([joined, *own_odd, *own])
        place = np.empty(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(usual)), len(usual) + np.arange(len(own_odd))
        at = place[coded.indices.to_numpy()]
        at[first[:-1]] = len(odd) + np.arange(len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)]) * self.kind.itemsize
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).take(pa.array(at))
        _, ends, data = pieces.buffers()
        ids = np.frombuffer(data, self.kind) if data else np.zeros(0, self.kind)
        return ids, np.frombuffer(ends, np.int64)[: len(at) + 1][first] // self.kind.itemsize


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def special_tokens(path: str) -> dict[str, int]:
    """The tokens of a tokenizer's file that text can spell, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@functools.lru_cache(4)
def _encoder(vocabulary: tuple[bytes, ...], special: tuple[tuple[str, int], ...]) -> Encoder:
    """Made once in a worker process, not in each task."""
    return Encoder(list(vocabulary), dict(special))


def _documents(encoder: Encoder, batch: pa.RecordBatch, end_id: int):
    for part in W.slices(batch, size=BATCH_BYTES):
        ids, first = encoder.encode_all(part.column("text"))
        for doc, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
            yield doc, np.append(ids[a:b], encoder.kind.type(end_id))


_TOKENISED = "kind int, row long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary"


def _tokenised(vocabulary, terms: int, window: int, end_id: int):
    """kind 0: a full window; 1: a tail with its ids; 2: token ``start`` is in ``length`` tails of the task,
    and token -1 stands for the total length of its tails, with their number in doc_tokens."""

    def run(batches):
        encoder = _encoder(*vocabulary.value)
        holders = np.zeros(terms + 1, np.int64)
        row, tails, tail_tokens = TaskContext.get().partitionId() << 33, 0, 0
        names = [c.split()[0] for c in _TOKENISED.split(", ")]
        for batch in batches:
            out = [[] for _ in names]
            for doc, ids in _documents(encoder, batch, end_id):
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    row += 1
                    full = len(part) == window
                    if not full:
                        holders[np.unique(part)] += 1
                        tails += 1
                        tail_tokens += len(part)
                    values = (0, row, doc, start, window, checksum(part), len(ids), None) if full else (
                        1, row, doc, start, len(part), None, len(ids), part.tobytes())
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        used = np.flatnonzero(holders)
        n = len(used) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array(np.append(used, -1)), pa.array(np.append(holders[used], tail_tokens)),
             pa.nulls(n, pa.int64()), pa.array(np.append(np.zeros(n - 1, np.int64), tails)),
             pa.nulls(n, pa.binary())],
            names,
        )

    return run


@functools.lru_cache(1)
def _projection(terms: int) -> np.ndarray:
    return np.random.default_rng(_SEED).normal(size=(terms, DIRECTIONS)).astype(np.float32)


def _projected(kind: str, column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tail its unit vector (zero without informative terms), and its bucket."""
    turn = _projection(len(idf))
    vectors, buckets = np.zeros((len(column), DIRECTIONS), np.float32), np.zeros(len(column), np.int64)
    for i, ids in enumerate(column.to_pylist()):
        terms, times = np.unique(np.frombuffer(ids, kind), return_counts=True)
        useful = idf[terms] > 0
        terms, times = terms[useful], times[useful]
        if len(terms):
            vectors[i] = (idf[terms] * times / (times + K1)).astype(np.float32) @ turn[terms]
            hashes = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            buckets[i] = int(terms[np.argmin(hashes ^ (hashes >> np.uint64(29)))]) % BUCKETS
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9), buckets


def fit_centroids(vectors: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` unit centroids (spherical k-means), each followed by the nearest one that is left."""
    rng = np.random.default_rng(_SEED)
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.sort(rng.permutation(len(distinct))[:n])]
    for _ in range(ROUNDS):
        nearest = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centroids)
    order, left = [0], np.ones(len(centroids), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, centroids @ centroids[order[-1]], -2).argmax()))
        left[order[-1]] = False
    return centroids[order]


def _vectors(kind: str, idf):
    def run(batches):
        for batch in batches:
            vectors, _ = _projected(kind, batch.column("ids"), idf.value)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary())], ["vector"])

    return run


def _celled(kind: str, idf, centroids):
    """The tails with their cell: centroid and bucket."""

    def run(batches):
        for batch in batches:
            vectors, buckets = _projected(kind, batch.column("ids"), idf.value)
            cell = (vectors @ centroids.value.T).argmax(1) * BUCKETS + buckets
            yield batch.append_column("cell", pa.array(cell.astype(np.int64)))

    return run


def _dealt(tails: DataFrame, n: int, shards: int, kind: str, idf) -> DataFrame:
    """``tails`` (n of them) with ``shard``: related ones together, shards of about the same size."""
    if shards == 1:
        return tails.withColumn("shard", F.lit(0).cast("long"))
    spark = tails.sparkSession
    wanted = min(4 * shards, MAX_CENTROIDS)  # finer than shards: a cut between two splits few groups
    sample = tails.filter(F.pmod(F.xxhash64("row"), F.lit(n)) < wanted * SAMPLE_PER_CENTROID).select("ids")
    found = [r.vector for r in sample.mapInArrow(_vectors(kind, idf), "vector binary").collect()]
    vectors = np.stack([np.frombuffer(v, np.float32) for v in sorted(found)] or [np.zeros(DIRECTIONS, np.float32)])
    centroids = spark.sparkContext.broadcast(fit_centroids(vectors, wanted))
    schema = "row long, doc_id long, start long, doc_tokens long, ids binary, cell long"
    celled = saved(tails.mapInArrow(_celled(kind, idf, centroids), schema), "cells")
    counts = np.zeros(len(centroids.value) * BUCKETS, np.int64)
    for cell, size in celled.groupBy("cell").count().collect():  # at most MAX_CENTROIDS * BUCKETS rows
        counts[cell] = size
    before = spark.sparkContext.broadcast((np.cumsum(counts) - counts, counts))

    def sharded(batches):
        first, size = before.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            # a place in the cell, from the row number alone
            mixed = (batch.column("row").to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            place = first[cell] + (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 * size[cell]
            shard = np.minimum(place * shards / n, shards - 1).astype(np.int64)
            yield batch.set_column(batch.schema.get_field_index("cell"), "shard", pa.array(shard))

    return celled.mapInArrow(sharded, schema.replace("cell", "shard"))


class Index:
    """BM25 inverted index of a shard's tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.terms, docs, weights = [], [], []
        for doc, ids in enumerate(tails):
            terms, times = np.unique(ids, return_counts=True)
            useful = idf[terms] > 0
            terms, times = terms[useful].astype(np.int64), times[useful]
            norm = K1 * (1 - B + B * len(ids) / mean_length)
            self.terms.append(terms)
            docs.append(np.full(len(terms), doc, np.int64))
            weights.append(idf[terms] * times * (K1 + 1) / (times + norm))
        term = np.concatenate(self.terms)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = np.concatenate(docs)[order], np.concatenate(weights)[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.size = len(tails)

    def scores(self, doc: int) -> np.ndarray:
        """Scores of all tails for the terms of ``doc``."""
        a, b = self.first[self.terms[doc]], self.first[self.terms[doc] + 1]
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(n.sum())
        return np.bincount(self.docs[at], self.weights[at], minlength=self.size)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores and of those equal to the last of them, best first, ties by place."""
    if n >= len(score):
        return np.argsort(-score, kind="stable")
    near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return near[np.argsort(-score[near], kind="stable")]


def fill_windows(lengths: list[int], scores, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (tail, start, length, sequence, offset). ``scores(i)``: of all tails as neighbours of tail i."""
    rest, taken = np.array(lengths), np.zeros(len(lengths), np.int64)
    out, sequence = [], 0
    for seed in range(len(lengths)):
        while rest[seed]:
            used = 0
            ranked = None
            at = seed
            place = 0
            while at is not None and used < window:
                n = int(min(rest[at], window - used))
                out.append((at, int(taken[at]), n, sequence, used))
                rest[at] -= n
                taken[at] += n
                used += n
                if used < window and ranked is None:
                    open_tails = np.flatnonzero(rest)
                    score = scores(seed)[open_tails]
                    ranked = open_tails[_best(score, NEAREST)]
                elif used < window and place == len(ranked) < len(open_tails):
                    ranked = open_tails[_best(score, len(score))]  # starts with those before
                at = None
                if used < window and place < len(ranked):
                    at = int(ranked[place])
                    place += 1
            sequence += 1
    return out


def _packed(kind: str, window: int, idf, mean_length: float):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        tails = [np.frombuffer(x, kind) for x in shard.column("ids").to_pylist()]
        index = Index(tails, idf.value, mean_length)
        pieces = fill_windows([len(x) for x in tails], index.scores, window)
        tail, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        crc = [checksum(tails[t][s : s + n]) for t, s, n in zip(tail.tolist(), start.tolist(), length.tolist())]
        at = shard.column("shard")[0].as_py()
        return pa.table({
            "doc_id": shard.column("doc_id").take(pa.array(tail)),
            "start": pa.array(start + shard.column("start").to_numpy()[tail]),
            "length": pa.array(length),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": shard.column("doc_tokens").take(pa.array(tail)),
            "sequence_id": pa.array(((np.int64(at) << 33) + sequence) * 2 + 1),
            "offset": pa.array(offset),
        })

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_by_retrieval(
    docs: DataFrame, vocabulary: list[bytes], window: int = 1024, end_id: int = 0, shard_tails: int = 2048,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all rows of ``docs``
    (doc_id, text; other columns are ignored).

    A document is the ids of its whole text (a null text counts as empty) and ``end_id``; each id lies in
    exactly one piece. Where a text spells a token of ``special`` (text and id), it is that token. start and doc_tokens count ids; offset is the piece's place in its sequence, without
    gaps. Rows are packed one by one, so repeated rows and null ids are packed too; equally good neighbours
    go by row number. An empty table gives no rows."""
    spark = docs.sparkSession
    special = special or {}
    terms = max([len(vocabulary) - 1, end_id, *special.values()]) + 1
    # a vocabulary is a parameter, not data
    shared = spark.sparkContext.broadcast((tuple(vocabulary), tuple(sorted(special.items()))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(docs.mapInArrow(_tokenised(shared, terms, window, end_id), _TOKENISED), "tokens")
    holders = np.zeros(terms + 1)
    tails = length = 0
    counted = rows.filter("kind = 2").groupBy("start").agg(F.sum("length"), F.sum("doc_tokens"))
    for token, n, m in counted.collect():  # at most one row for each token of the vocabulary
        if token < 0:
            length, tails = n, m
        else:
            holders[token] = n
    idf = np.maximum(0, np.log((tails - holders + 0.5) / (holders + 0.5)))
    idf[holders == 0] = 0
    full = rows.filter("kind = 0").select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    shards = max(1, round(tails / shard_tails))
    kind, idf = "<u2" if terms <= 1 << 16 else "<u4", spark.sparkContext.broadcast(idf)
    pack = _packed(kind, window, idf, length / max(tails, 1))
    open_ = rows.filter("kind = 1").select("row", "doc_id", "start", "doc_tokens", "ids")
    packed = _dealt(open_, tails, shards, kind, idf).groupBy("shard").applyInArrow(pack, _PIECES)
    return full.union(packed)
