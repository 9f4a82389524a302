"""Benchmark items in documents, found by latent semantic retrieval and confirmed word by word.

1. Texts are read once: each word becomes a 16-bit number (its hash), stored with the document, and the passages
   of ``PASSAGE`` words that hold each of 2^``BITS`` terms (leading bits) are counted.
2. A distributed randomised SVD of the passages' TF-IDF matrix A: each task adds up its part of A'(A R) for a
   random matrix R, the parts are summed, and the driver gets the leading right singular vectors from that
   small matrix (Nystrom's formula), whatever the number of passages.
   Every term has a weight, so an item that is copied into most documents, or has common words only, keeps its own.
3. Passages and items are projected, each direction scaled to the same spread. Windows of
   whole blocks of ``BLOCK`` words are compared by cosine with all items of about their length.
4. For close pairs the longest common subsequence of the item's words and of the words around the window
   decides, with a lower bar if the item's answer (its last sentence) stands there word for word. It is left out
   where too few of the item's words occur there; ``SIGNATURE`` bits of the words of both sides bound their number
   from above, so that most pairs go without a look at their words.
5. Items too short for that are looked for in step 1, as exact runs of words by 64-bit hashes.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm import words as W
from case_insights.llm.store import saved

PASSAGE, BLOCK, BITS = 32, 8, 13
SCALES = (3, 4, 6, 9, 13, 18)  # blocks of a window
RANK, SKETCH = 48, 56
SIGNATURE = 1024
PAIRS = 1 << 15  # whose signatures are compared at a time
MAX_SHORT = 1 << 22  # items looked for as exact runs; their hashes are broadcast
_SEED = 11
_PARTS = 32  # in which a task's matrix is summed


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of each text, and the offsets of rows."""
    data, offsets = W.text_bytes(column)
    start, end, first = W.split_words(data, offsets, W.PUNCTUATION)
    return W.hash_words(data, start, end, lower=True), first


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit numbers of the terms of each text, and the offsets of rows."""
    hashes, first = _hashes(column)
    return (hashes >> np.uint64(48)).astype(np.uint16), first


def _passages(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words that don't cross rows."""
    n = np.diff(first)
    runs = -(-n // size)
    row = np.repeat(np.arange(len(n)), runs)
    return first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * size


def _sums(rows: np.ndarray, which: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``rows[which]`` over the runs of places that begin at ``starts``. Runs are cut into parts of ``width`` places,
    and parts are added up place by place: for rows of some dozens of numbers ten times as fast as ``reduceat``."""
    length = np.diff(np.append(starts, len(which)))
    parts = -(-length // width)
    first = np.cumsum(parts) - parts
    within = (np.arange(parts.sum()) - np.repeat(first, parts)) * width
    begin, length = np.repeat(starts, parts) + within, np.minimum(np.repeat(length, parts) - within, width)
    out = rows.take(which[begin], axis=0)
    rest = np.zeros_like(out)
    for j in range(1, int(length.max(initial=0))):
        live = np.flatnonzero(length > j)
        if len(live) == len(length):
            rest += rows.take(which[begin + j], axis=0)
        else:
            rest[live] += rows.take(which[begin[live] + j], axis=0)
    out += rest
    return out if len(out) == len(starts) else _sums(out, np.arange(len(out)), first, width)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at each place with as many left."""
    return W.run_hashes(h, k)[: max(0, len(h) - k + 1)]


def _short_items(min_exact: int, min_words: int):
    """Number of words and hash of each item of ``min_exact`` up to ``min_words`` words."""

    def run(batches):
        for batch in batches:
            ids, sizes, keys = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                h, _ = _hashes(pa.array([text.as_py()], pa.string()))
                if min_exact <= len(h) < min_words:
                    ids.append(item)
                    sizes.append(len(h))
                    keys.append(int(_runs(h, len(h)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["item_id", "size", "key"])

    return run


def _exact(h: np.ndarray, first: np.ndarray, short: dict[int, np.ndarray]):
    """(row, size, key, place) of the first place of each short item in each row."""
    for size, keys in short.items():
        runs = _runs(h, size).view(np.int64)
        at = np.flatnonzero(np.isin(runs, keys))
        row = np.searchsorted(first, at, "right") - 1
        inside = at + size <= first[row + 1]
        places: dict[tuple[int, int], int] = {}
        for r, place in zip(row[inside].tolist(), at[inside].tolist()):
            places.setdefault((r, int(runs[place])), int(place - first[r]))
        for (r, key), place in places.items():
            yield r, size, key, place


def _read(short):
    """kind 0: a document's numbers; 1: a term (doc_id) and the number of this task's passages that hold it, and
    their number under -1; 2: a document that holds the short item of ``size`` words and hash ``n``, at ``place``."""

    def run(batches):
        holders, passages = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            rows, hits, done = [], [], 0
            docs = batch.column("doc_id").to_pylist()
            for part in W.slices(batch):
                h, first = _hashes(part.column("text"))
                ids = (h >> np.uint64(48)).astype(np.uint16)
                rows += [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                starts = _passages(first, PASSAGE)
                which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
                pairs = np.unique(((which << BITS) | (ids >> (16 - BITS))).astype(np.uint32 if len(starts) < 1 << 32 - BITS else np.int64))
                holders += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
                passages += len(starts)
                hits += [(docs[done + r], *found) for r, *found in _exact(h, first, short.value)]
                done += part.num_rows
            yield _numbered(0, batch.column("doc_id"), ids=pa.array(rows, pa.binary()))
            if hits:
                doc, size, key, place = (pa.array(c, pa.int64()) for c in zip(*hits))
                yield _numbered(2, doc, key, size, place)
        used = np.flatnonzero(holders)
        yield _numbered(1, pa.array(np.append(used, -1)), pa.array(np.append(holders[used], passages)))

    return run


_NUMBERED = "kind int, doc_id long, n long, size long, place long, ids binary"


def _numbered(kind: int, doc_id, n=None, size=None, place=None, ids=None) -> pa.RecordBatch:
    rows = len(doc_id)
    numbers = [pa.nulls(rows, pa.int64()) if c is None else c for c in (n, size, place)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, kind, np.int32)), doc_id, *numbers, pa.nulls(rows, pa.binary()) if ids is None else ids],
        [c.split()[0] for c in _NUMBERED.split(", ")])


def _joined(column: pa.Array, chunk: int = 1 << 16):
    """Numbers of several rows, with the offsets of rows; about ``chunk`` words at a time, or one row."""
    rows = [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
    i = 0
    while i < len(rows):
        j, n = i + 1, len(rows[i])
        while j < len(rows) and n + len(rows[j]) <= chunk:
            n += len(rows[j])
            j += 1
        yield i, np.concatenate(rows[i:j]), np.concatenate([[0], np.cumsum([len(r) for r in rows[i:j]])]).astype(np.int64)
        i = j


def _signatures(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` bits for each run of places that begins at ``starts``: those of its words."""
    ends = np.append(starts[1:], len(ids))
    out = [np.zeros((0, SIGNATURE // 64), np.uint64)]
    for i in range(0, len(starts), 1 << 13):
        start, end = starts[i : i + (1 << 13)], ends[i : i + (1 << 13)]
        bits = np.zeros((len(start), SIGNATURE), np.uint8)
        bits[np.repeat(np.arange(len(start)), end - start), ids[start[0] : end[-1]] % SIGNATURE] = 1
        out.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.concatenate(out)


def _any_of(signatures: np.ndarray, runs: int) -> np.ndarray:
    """The bits of each row and of the ``runs - 1`` rows after it, as far as there are any."""
    out, have = signatures.copy(), 1
    while have < runs:
        step = min(have, runs - have)
        out[:-step] |= out[step:].copy()
        have += step
    return out


def _sketched(idf, random):
    """The task's sum of A'(A R), in parts."""

    def run(batches):
        w = idf.value
        weighted = random.value * w[:, None]
        total = np.zeros(weighted.shape)
        for batch in batches:
            for _, ids, first in _joined(batch.column("ids")):
                if not len(ids):
                    continue
                term = ids >> (16 - BITS)
                starts = _passages(first, PASSAGE)
                square = np.add.reduceat(w[term] ** 2, starts)
                y = _sums(weighted, term, starts, PASSAGE) / (square + 1e-30)[:, None]
                which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
                order = np.argsort(term, kind="stable")
                term = term[order]
                heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                total[term[heads]] += _sums(y, which[order], heads, 8)
        total *= w[:, None]  # each passage has unit length: its weights were divided by their norm, twice
        parts = np.split(total, _PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def randomised_svd(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """For each term its coordinates on the ``RANK`` leading right singular vectors of the passages' TF-IDF
    matrix, divided by the singular values."""
    context = rows.sparkSession.sparkContext
    random = np.random.default_rng(_SEED).normal(size=(len(idf), SKETCH)).astype(np.float32)
    parts = rows.select("ids").mapInArrow(_sketched(context.broadcast(idf), context.broadcast(random)), "part int, sums binary")
    # sums of few tasks first, then of those: no task gathers a row from every other one
    for salts in (64, 1):
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(salts)))
        parts = parts.groupBy("part", "salt").applyInArrow(_added, "part int, sums binary")
    found = sorted((r.part, r.sums) for r in parts.collect())  # _PARTS rows
    if not found:
        return np.zeros((len(idf), RANK), np.float32)
    g = np.concatenate([np.frombuffer(s).reshape(-1, SKETCH) for _, s in found])
    core = random.T.astype(np.float64) @ g
    if not core.any():
        return np.zeros((len(idf), RANK), np.float32)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    use = value > value.max() * 1e-9
    b = g @ (vector[:, use] / np.sqrt(value[use]))
    square, turn = np.linalg.eigh(b.T @ b)
    best = np.argsort(-square)[:RANK]
    best = best[square[best] > square.max() * 1e-9]
    # b = V S: columns are singular vectors times singular values of A; V / S scales each direction alike
    out = np.zeros((len(idf), RANK), np.float32)
    out[:, : len(best)] = (b @ turn[:, best]) / square[best]
    return out


def common_subsequence(item: list[int], places: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence; ``places``: for each word a bit for each place in ``item``."""
    full = (1 << len(item)) - 1
    row = full
    for word in words:
        hit = places.get(word, 0) & row
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _spare(words: int) -> int:
    """Words on each side of a window that count as around it, for an item of so many words."""
    return words // 2 + BLOCK


class Items:
    """A block of benchmark items: latent vectors, words and answers."""

    def __init__(self, ids: list, texts: list[str], coordinates: np.ndarray, idf: np.ndarray):
        self.ids = ids
        numbers, first = _numbers(pa.array(texts, pa.string()))
        self.words = [numbers[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        self.places = []
        for item in self.words:
            places: dict[int, int] = {}
            for i, word in enumerate(item):
                places[word] = places.get(word, 0) | 1 << i
            self.places.append(places)
        self.answers = []
        for text in texts:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
            answer, at = _numbers(pa.array([sentences[-1] if sentences else ""]))
            self.answers.append(answer[: at[-1]].tobytes())
        answer_words = [np.frombuffer(a, np.uint16) for a in self.answers]
        self.answer_signatures = np.stack([
            _signatures(a, np.zeros(1, np.int64))[0] if len(a) else np.full(SIGNATURE // 64, -1, np.int64).view(np.uint64)
            for a in answer_words
        ])
        term = numbers >> (16 - BITS)
        z = np.stack([(coordinates[term[a:b]] * idf[term[a:b]][:, None]).sum(0) for a, b in zip(first[:-1], first[1:])])
        z = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
        self.signatures = _signatures(numbers, first[:-1])
        self.sizes = np.diff(first)
        # a window of the right scale holds the whole item, wherever its blocks begin
        need = -(-np.diff(first) // BLOCK) + 1
        scale = np.minimum(np.searchsorted(SCALES, need), len(SCALES) - 1)
        # (blocks of a window, items of that scale, their latent vectors, blocks on each side that may count)
        self.scales = [
            (SCALES[i], np.flatnonzero(scale == i), np.ascontiguousarray(z[scale == i].T),
             -(-_spare(int(self.sizes[scale == i].max())) // BLOCK))
            for i in np.unique(scale).tolist()
        ]


def _contains(words: np.ndarray, part: bytes) -> bool:
    data, at = words.tobytes(), -1
    while part:
        at = data.find(part, at + 1)
        if at < 0:
            return False
        if at % 2 == 0:
            return True
    return False


def _found(items, coordinates, min_cosine: float, min_overlap: float, min_with_answer: float):
    def run(batches):
        block, c = items.value, coordinates.value
        for batch in batches:
            out = ([], [], [], [], [], [])
            docs = batch.column("doc_id").to_pylist()
            for row, ids, first in _joined(batch.column("ids")):
                if not len(ids):
                    continue
                starts = _passages(first, BLOCK)
                term = ids >> (16 - BITS)
                z = _sums(c, term, starts, BLOCK)
                of = np.searchsorted(first, starts, "right") - 1
                ends = np.append(starts[1:], len(ids))
                best: dict[tuple[int, int], tuple] = {}
                pairs: list[tuple[np.ndarray, ...]] = []
                last = np.searchsorted(of, of, "right") - 1  # the last block of the row
                signatures = _signatures(ids, starts)
                sums = np.zeros((len(z) + 1, z.shape[1]), np.float32)
                np.cumsum(z, axis=0, out=sums[1:])
                for blocks, part, latent, beside in block.scales:
                    to = np.minimum(np.arange(len(starts)) + blocks - 1, last)
                    # of the blocks around each window; those of other rows can only add to them
                    there = _any_of(signatures, blocks + 2 * beside)
                    wanted = block.signatures[part]
                    answers, sizes = block.answer_signatures[part], block.sizes[part]
                    for i in range(0, len(to), 1024):
                        window = sums[to[i : i + 1024] + 1] - sums[i : i + 1024][: len(to) - i]
                        window /= (np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9)[:, None]
                        cosine = window @ latent
                        close = np.flatnonzero(cosine >= min_cosine)
                        for close in np.split(close, range(PAIRS, len(close), PAIRS)):
                            a, column = close // latent.shape[1], close % latent.shape[1]
                            other = ~there[np.maximum(i + a - beside, 0)]
                            most = sizes[column] - np.bitwise_count(wanted[column] & other).sum(1, dtype=np.int64)
                            likely = most >= min_overlap * sizes[column]
                            maybe = np.flatnonzero(~likely & (most >= min_with_answer * sizes[column]))
                            likely[maybe] = ~(answers[column[maybe]] & other[maybe]).any(axis=1)
                            pairs.append((i + a[likely], part[column[likely]], cosine[a[likely], column[likely]], to[i + a[likely]]))
                for at, item, cosine, to in zip(*(np.concatenate(c).tolist() for c in zip(*pairs))):
                    words = block.words[item]
                    spare = _spare(len(words))
                    low, high = first[of[at]], first[of[at] + 1]
                    x, y = max(low, starts[at] - spare), min(high, ends[to] + spare)
                    around = ids[x:y]
                    near = around.tolist()
                    known = set(near)
                    most = sum(word in known for word in words)
                    if most < min(min_overlap, min_with_answer) * len(words):
                        continue
                    answer = _contains(around, block.answers[item])
                    if most < min_overlap * len(words) and not answer:
                        continue
                    overlap = common_subsequence(words, block.places[item], near) / len(words)
                    answer = answer and overlap >= min_with_answer
                    if overlap >= min_overlap or answer:
                        key = (int(of[at]), item)
                        found = (overlap, cosine, answer, int(x - low))
                        best[key] = max(best.get(key, found), found)
                for (r, item), (overlap, cosine_, answer, x) in best.items():
                    values = (docs[row + r], block.ids[item], cosine_, overlap, bool(answer), x)
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()))],
                ["doc_id", "item_id", "cosine", "overlap", "answer", "near_word"])

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_cosine: float = 0.45,
    min_overlap: float = 0.6,
    min_with_answer: float = 0.45,
    min_words: int = 8,
    min_exact: int = 3,
    items_per_block: int = 4096,
) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answer, near_word`` for each document (doc_id, text) and item (item_id,
    text) of which it holds a copy or paraphrase; other columns are ignored.

    A pair counts if the longest common subsequence has ``min_overlap`` of the item's words, or
    ``min_with_answer`` of them and the item's last sentence stands there too. Words are compared without
    punctuation, A-Z lower-cased. Items of ``min_exact`` up to ``min_words`` words count where all their words stand in
    a row (overlap 1, no cosine); shorter ones and those without text are not searched, as they occur anywhere.
    Documents without text hold nothing. Repeated rows each have their rows; a null doc_id is kept.
    Empty tables give no rows. Items are searched in blocks of about ``items_per_block``, so what is broadcast is
    bounded; more than ``MAX_SHORT`` short items are an error. Very long texts are searched whole; of equally good
    windows the one with the largest cosine, then the last, is given. All passages and their statistics are used."""
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    items = items.withColumn("hash", F.xxhash64("item_id", "text")).distinct()
    short = items.mapInArrow(_short_items(min_exact, min_words), "item_id long, size long, key long").distinct()
    keys = short.select("size", "key").distinct().limit(MAX_SHORT + 1).toPandas()
    if len(keys) > MAX_SHORT:
        raise ValueError(f"more than {MAX_SHORT} items are below {min_words} words")
    lookup = context.broadcast({int(n): part["key"].to_numpy() for n, part in keys.groupby("size")})
    rows = saved(docs.mapInArrow(_read(lookup), _NUMBERED), "numbers")
    holders, passages = np.zeros(1 << BITS), 0
    for term, n in rows.filter("kind = 1").groupBy("doc_id").agg(F.sum("n")).collect():  # 2^BITS + 1 rows
        if term < 0:
            passages = n
        else:
            holders[term] = n
    idf = np.log(1 + passages / (1 + holders)).astype(np.float32)
    schema = "doc_id long, item_id long, cosine double, overlap double, answer boolean, near_word long"
    found = spark.createDataFrame([], schema)
    if len(keys):
        exact = rows.filter("kind = 2").select("doc_id", F.col("n").alias("key"), "size", "place")
        found = exact.join(short, ["size", "key"]).select(
            "doc_id", "item_id", F.lit(None).cast("double").alias("cosine"), F.lit(1.0).alias("overlap"),
            F.lit(True).alias("answer"), F.col("place").alias("near_word"))
    rows = rows.filter("kind = 0").select("doc_id", "ids")
    coordinates = randomised_svd(rows, idf)
    term_vectors = context.broadcast(coordinates * idf[:, None])

    blocks = max(1, math.ceil(items.count() / items_per_block))
    for i in range(blocks):
        part = items.filter(F.pmod("hash", F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        part = [r for r in part if len(_numbers(pa.array([r.text]))[0]) >= min_words]
        if part:
            block = context.broadcast(Items([r.item_id for r in part], [r.text for r in part], coordinates, idf))
            found = found.union(rows.mapInArrow(_found(block, term_vectors, min_cosine, min_overlap, min_with_answer), schema))
    return found
