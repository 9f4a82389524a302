"""Token counts by greedy longest match, in one pass over each word's bytes.

The vocabulary is a trie. A node stands for what was read since the last complete pieces. When no child
continues it, its failure link names the node for the rest that is left after the greedy pieces at its
front are taken off, and a number says how many pieces that is. Both are computed once, so a word costs a
step for each byte and no piece is ever built. Distinct words are looked up in a bounded table first.
"""

from __future__ import annotations

import functools
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 200_000  # words whose counts a task keeps


def byte_vocabulary(path: str) -> list[bytes]:
    """The tokens, as bytes, of a byte-level BPE file of the ``tokenizers`` library, without special tokens."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    # such files write each byte as a printable character: printable ones as they are, others from U+0100 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in content.get("added_tokens", ())}
    tokens = sorted(content["model"]["vocab"].items(), key=lambda x: x[1])
    return [bytes(byte_of[c] for c in token) for token, _ in tokens if token not in special]


class LongestMatch:
    """The automaton of a vocabulary. ``count(word)`` is the number of pieces that greedy longest match
    cuts ``word`` into, or -1 if it comes to a place where no token fits. The empty word has 0."""

    def __init__(self, vocabulary: list[bytes]):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for piece in vocabulary:
            at = 0
            for byte in piece:
                if byte not in child[at]:
                    child[at][byte] = len(child)
                    child.append({})
                    token.append(False)
                at = child[at][byte]
            token[at] = at > 0
        self.child = child
        self.fail, self.popped = [-1] * len(child), [0] * len(child)
        level = [0]
        while level:
            following = []
            for at in level:
                for byte, node in child[at].items():
                    following.append(node)
                    if token[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    rest, pieces = self.fail[at], self.popped[at]
                    while rest >= 0 and byte not in child[rest]:
                        pieces += self.popped[rest]
                        rest = self.fail[rest]
                    if rest >= 0:
                        self.fail[node], self.popped[node] = child[rest][byte], pieces
            level = following

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = pieces = 0
        for byte in word:
            while byte not in child[at]:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = child[at][byte]
        while at > 0:
            pieces += popped[at]
            at = fail[at]
        return pieces if at == 0 else -1


@functools.lru_cache(4)
def _automaton(vocabulary: tuple[bytes, ...]) -> LongestMatch:
    """Made once in a worker process, not in each task."""
    return LongestMatch(list(vocabulary))


def _counted(vocabulary):
    def run(batches):
        automaton = _automaton(vocabulary.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column("text"):
                found = Counter((text.as_py() or "").encode().split())
                pieces = missed = 0
                for word, n in found.items():
                    size = known.get(word)
                    if size is None:
                        size = automaton.count(b" " + word)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = size
                    if size < 0:
                        missed += n
                    pieces += n * (size if size >= 0 else 1)
                words.append(found.total())
                tokens.append(pieces)
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(unknown, pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for each row of ``docs`` (doc_id, text; other columns are
    ignored).

    A word (a run of bytes other than 0x20 and 0x09 to 0x0D) is matched with one space before it, as the
    tokens of byte-level vocabularies write the start of a word. A word that the vocabulary cannot spell is
    one token, and counts in ``n_unknown``. A null or empty text has 0 of each; repeated rows and null ids
    keep their row; an empty table gives no rows. There is no shuffle, and texts are counted whole."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # a vocabulary is a parameter, not data
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _counted(shared), "doc_id long, n_words long, n_tokens long, n_unknown long"
    )
