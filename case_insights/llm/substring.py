"""Removal of word passages that also stand in an earlier document, by suffix automata of reference shards.

1. Every window of ``window`` words has an anchor: the smallest hash among its runs of ``ANCHOR`` words. Equal
   windows have equal anchors, so a window can only repeat if its anchor does. One shuffle of distinct
   anchors (about two for nine words), added up in each batch first, finds the repeated ones; a bitmap of
   bounded size takes them back to the texts. Its false hits only cost work.
2. Around repeated anchors documents are cut into segments: the words of successive windows with one anchor.
   The reference shard of an anchor is the set of its segments. A task ships a segment once; for a later
   copy in the same task it is already known that an earlier document has it.
3. A shard's automaton goes where its segments go: there they stream through it in order of doc_id. Each is
   matched first, which gives for each word the longest match with an earlier document, and is added
   afterwards. Where a match reaches ``window`` words, a window repeats.
4. Maximal spans covered by repeated windows are removed from the texts.

Segments carry the words themselves, so hash collisions cannot remove a word. A shard with an anchor in more
than ``shard_segments`` places is split: its windows go each by its own words to other tasks, where an
aggregate with partial sums finds the smallest doc_id. So no task gathers a line that stands in a third of
all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from case_insights.llm import words as W
from case_insights.llm.store import saved

ANCHOR = 6


class SuffixAutomaton:
    """Suffix automaton over sequences of words, with the matching statistics of further ones."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[bytes]) -> None:
        """Add all substrings of ``sequence``."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol: bytes) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            target = self.next[at][symbol]
            same = self.length[target] == self.length[at] + 1
            self.link[new] = target if same else self._split(at, symbol, target)
        return new

    def _state(self, length: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, symbol: bytes, target: int) -> int:
        copy = self._state(self.length[at] + 1, self.next[target].copy())
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def matches(self, sequence: list[bytes]) -> list[int]:
        """For each place the length of the longest substring that ends there and occurs in the automaton."""
        out, at, size = [], 0, 0
        for symbol in sequence:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if symbol in self.next[at]:
                at = self.next[at][symbol]
                size += 1
            out.append(size)
        return out


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window that starts at each place (there must be ``window`` words)."""
    least = W.run_hashes(h, ANCHOR)[: len(h) - ANCHOR + 1]
    size, want = 1, window - ANCHOR + 1
    while size < want:  # minima of ever longer runs
        step = min(size, want - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return least


def _rows(batch: pa.RecordBatch, window: int):
    """Row, word hashes, anchors of windows, and the text's bytes with the ranges of its words, for each row
    that has a window."""
    row = 0
    for part in W.slices(batch):
        data, offsets = W.text_bytes(part.column("text"))
        start, end, first = W.split_words(data, offsets)
        h = W.hash_words(data, start, end)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= window:
                yield row + i, _anchors(h[a:b], window), data, start[a:b], end[a:b]
        row += part.num_rows


def _anchor_counts(window: int):
    def run(batches):
        for batch in batches:
            found = [np.unique(anchors) for _, anchors, *_ in _rows(batch, window)]
            if found:
                anchors, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(counts.astype(np.int64))], ["anchor", "n"]
                )

    return run


def _is_in(bitmap: bytes, anchors: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    at = (anchors % np.uint64(len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _segments(window: int, repeated, busy):
    """Rows of candidates. kind 0: a segment and its anchor; 1: a window of a busy anchor; 2: known to be
    covered, as a smaller doc_id of this task has the same words. from_word: where it starts."""

    def run(batches):
        seen: dict[bytes, int] = {}  # of this task's candidates the smallest doc_id
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            keys = batch.column("text_key").to_pylist()
            out = ([], [], [], [], [], [], [])

            def put(row, kind, anchor, a, b, text=None):
                for column, x in zip(out, (kind, anchor, ids[row], keys[row], a, b, text)):
                    column.append(x)

            for row, anchors, data, start, end in _rows(batch, window):
                candidate = _is_in(repeated.value, anchors)
                if not candidate.any():
                    continue
                hot = candidate & _is_in(busy.value, anchors)
                change = np.flatnonzero((anchors[1:] != anchors[:-1]) | hot[1:] | hot[:-1]) + 1
                known_to = known_from = -1
                for a, b in zip([0, *change.tolist()], [*change.tolist(), len(anchors)]):
                    if not candidate[a]:
                        continue
                    last = b + window - 1
                    text = b" ".join(data[start[a] : end[last - 1]].tobytes().split())
                    unit = text if not hot[a] else b"\0" + text
                    first = seen.get(unit)
                    if first is not None and first < ids[row]:
                        if known_to < a:
                            if known_to > 0:
                                put(row, 2, None, known_from, known_to)
                            known_from = a
                        known_to = last
                        continue
                    seen[unit] = ids[row]
                    put(row, int(hot[a]), int(anchors[a : a + 1].view(np.int64)[0]), a, last, text)
                if known_to > 0:
                    put(row, 2, None, known_from, known_to)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["kind", "anchor", "doc_id", "text_key", "from_word", "to_word", "words"],
            )

    return run


def _streamed(window: int):
    """Covered ranges of segments that come sorted by anchor and doc_id."""

    def run(batches):
        anchor = None
        pending: list[tuple[int, list[bytes]]] = []  # segments of one doc_id that aren't references yet
        for batch in batches:
            out = ([], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "from_word", "words")]
            for a, doc, key, from_word, text in zip(*columns):
                if a != anchor:
                    anchor, exact, automaton, pending, pending_doc = a, set(), None, [], doc
                if doc != pending_doc:
                    for known in pending:
                        if known not in exact:
                            exact.add(known)
                            if automaton is not None:
                                automaton.add(known.split(b" "))
                    pending, pending_doc = [], doc
                pending.append(text)
                if not exact:
                    continue
                if text in exact:
                    spans = [(0, text.count(b" ") + 1)]
                else:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                        for known in exact:
                            automaton.add(known.split(b" "))
                    spans = []
                    for place, size in enumerate(automaton.matches(text.split(b" "))):
                        if size >= window:
                            if spans and spans[-1][1] >= place + 1 - window:
                                spans[-1] = (spans[-1][0], place + 1)
                            else:
                                spans.append((place + 1 - window, place + 1))
                for x, y in spans:
                    for column, value in zip(out, (doc, key, from_word + x, from_word + y)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["doc_id", "text_key", "from_word", "to_word"],
            )

    return run


def _kept(names: list[str]):
    """The words left of each text, joined by one space, with counts, after the columns ``names``."""

    def run(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                found = (text or "").encode().split()
                total.append(len(found))
                if spans:
                    stays = np.ones(len(found), bool)
                    for span in spans:
                        stays[span["from_word"] : span["to_word"]] = False
                    found = [found[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(total[-1] - len(found))
                kept.append(b" ".join(found).decode())
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())],
                [*names, "n_words", "n_removed", "kept"],
            )

    return run


def _bitmap(anchors: DataFrame, bits: int) -> bytes:
    """A bit for each ``anchor`` modulo ``bits``; at most bits / 8 bytes come to the driver."""
    # a hash is stored as a signed number; bits is a power of two, so its remainder is that of the unsigned one
    x = (F.pmod("anchor", F.lit(bits)) + 1).alias("x")
    blocks = (
        anchors.select(x)
        .groupBy(F.bitmap_bucket_number("x").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap"))
    )
    out = bytearray(bits // 8)
    for block, bitmap in blocks.toLocalIterator():
        out[(block - 1) * 4096 : block * 4096] = bitmap
    return bytes(out)


def remove_repeats(
    docs: DataFrame, window: int = 13, shard_segments: int = 1000, filter_bits: int = 1 << 26, keep: bool = False
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs`` (doc_id, text): kept are the text's words
    (runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged), without those covered by a window of
    ``window`` words that also starts in a document with a smaller doc_id, joined by one space. Windows are
    judged on the input. With ``keep`` all columns of ``docs`` come first; the new ones, and the inner columns
    text_key and spans, replace any of the same name.

    A null text has no words. Rows with a null doc_id are kept whole and are no reference; rows that share a
    doc_id don't count as earlier ones for each other. Texts below ``window`` words are kept whole. An empty
    table gives no rows.

    ``filter_bits`` (a power of two; broadcast as bits / 8 bytes) and ``shard_segments`` change the work, never
    the result."""
    if keep:
        docs = docs.drop("n_words", "n_removed", "kept", "spans").withColumn("text_key", F.xxhash64("text"))
    else:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    context = docs.sparkSession.sparkContext
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "text_key").filter("doc_id is not null")
    counts = known.select("text").mapInArrow(_anchor_counts(window), "anchor long, n long")
    counts = saved(counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    repeated = context.broadcast(_bitmap(counts, filter_bits))
    busy = context.broadcast(_bitmap(counts.filter(F.col("n") > shard_segments), 1 << 22))

    schema = "kind int, anchor long, doc_id long, text_key long, from_word int, to_word int, words binary"
    rows = saved(known.mapInArrow(_segments(window, repeated, busy), schema), "segments")
    place = ["doc_id", "text_key", "from_word", "to_word"]
    sharded = (
        rows.filter("kind = 0")
        .select("anchor", *place[:3], "words")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id")
        .mapInArrow(_streamed(window), "doc_id long, text_key long, from_word int, to_word int")
    )
    windows = rows.filter("kind = 1").withColumn("window", F.sha2("words", 256))
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    split = windows.select("window", *place).join(first, "window").filter("doc_id > first").select(place)
    spans = (
        sharded.union(split)
        .union(rows.filter("kind = 2").select(place))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans"))  # at most one for each word
    )
    columns = [c for c in docs.columns if c != "text_key"] if keep else ["doc_id", "text"]
    rows = docs.join(spans, ["doc_id", "text_key"], "left").select(*columns, "spans")
    fields = rows.drop("spans").schema.fields if keep else [f for f in rows.schema.fields if f.name == "doc_id"]
    schema = T.StructType([
        *fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ])
    return rows.mapInArrow(_kept([f.name for f in fields]), schema)
