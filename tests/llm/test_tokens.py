import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from case_insights.llm.entry import vocabulary_path
from case_insights.llm.packing import Encoder, Index, fill_windows, pack_by_retrieval, special_tokens
from case_insights.llm.wordpiece import LongestMatch, byte_vocabulary, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return byte_vocabulary(vocabulary_path())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def greedy(pieces: set[bytes], word: bytes) -> int:
    n = at = 0
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in pieces), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_automaton_counts_as_greedy_matching_does():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        automaton = LongestMatch(sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 15)))
            assert automaton.count(word) == greedy(pieces, word), (pieces, word)


def test_counts_of_documents(docs, no_docs, texts, vocabulary):
    pieces = set(vocabulary)
    expected = sorted(
        (repr(i), len(ws), sum(greedy(pieces, b" " + w) for w in ws), 0)
        for i, ws in ((i, (t or "").encode().split()) for i, t in texts)
    )
    found = token_counts(docs, vocabulary).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in found) == expected
    assert token_counts(no_docs, vocabulary).collect() == []


def test_words_that_cannot_be_spelt_are_one_token(spark):
    rows = spark.createDataFrame([(1, "ab ax ab")], "doc_id long, text string")
    assert token_counts(rows, [b" ", b"a", b"b"]).first()[1:] == (3, 3 + 1 + 3, 1)


def test_ids_are_those_of_the_tokenizer(vocabulary, tokenizer, texts):
    encoder = Encoder(vocabulary, special_tokens(vocabulary_path()))
    rng = random.Random(6)
    odd = ["".join(rng.choice("aB1 \n\t '.s!　é\x1c") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    all_ = [*odd, *(t or "" for _, t in texts), "<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n  b <|endoftext|", "<|endoftext|>"]
    ids, first = encoder.encode_all(pa.array([None, *all_, None], pa.string()).slice(1))
    assert len(first) == len(all_) + 2 and first[-1] == first[-2] == len(ids)
    for text, a, b in zip(all_, first, first[1:]):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == wanted and encoder.encode(text).tolist() == wanted, repr(text)


def check_pieces(rows, texts, tokenizer, window):
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for i, d in ids:
        expected[i, len(d)].append(d)
    assert set(pieces) == set(expected)
    for key, copies in expected.items():
        found = sorted((r.start, r.length, r.ids_crc32) for r in pieces[key])
        covered = np.zeros(key[1], int)
        for start, length, crc in found:
            covered[start : start + length] += 1
            parts = {zlib.crc32(np.array(d[start : start + length], "<u4").tobytes()) for d in copies}
            assert crc in parts
        assert (covered == len(copies)).all()
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
    return sum(window - sum(n for _, n in p) for p in sequences.values())


@pytest.mark.parametrize("window, shard", [(64, 4), (64, 2048), (1024, 2048)])
def test_each_id_lies_in_one_piece(docs, texts, vocabulary, tokenizer, window, shard):
    rows = pack_by_retrieval(docs, vocabulary, window=window, shard_tails=shard).collect()
    padding = check_pieces(rows, texts, tokenizer, window)
    assert padding < window * (len(texts) if shard == 4 else 1)


def test_related_documents_share_a_sequence(spark, vocabulary):
    rng = random.Random(2)
    words = {t: [f"{t}{rng.randrange(40)}" for _ in range(400)] for t in ("lorem", "ipsum", "dolor", "amet")}
    rows = [(i, " ".join(rng.choices(words[t], k=20))) for i, t in enumerate(list(words) * 20)]
    found = pack_by_retrieval(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, window=512).collect()
    topics = defaultdict(lambda: defaultdict(int))
    for r in found:
        topics[r.sequence_id][r.doc_id % 4] += r.length
    most = sum(max(t.values()) for t in topics.values()) / sum(sum(t.values()) for t in topics.values())
    assert most > 0.6


def test_texts_that_spell_a_special_token(spark, vocabulary, tokenizer):
    texts = [(1, "<|endoftext|>"), (2, "one <|endoftext|> two" * 40), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pack_by_retrieval(docs, vocabulary, window=64, special=special_tokens(vocabulary_path())).collect()
    check_pieces(rows, texts, tokenizer, 64)


def test_windows_take_neighbours_by_bm25(monkeypatch):
    """Scores against the formula, and each window against a plain greedy choice."""
    monkeypatch.setattr("case_insights.llm.packing.NEAREST", 2)
    rng = np.random.default_rng(4)
    tails = [rng.integers(0, 50, rng.integers(1, 30)).astype("<u2") for _ in range(60)] + [np.array([1, 2], "<u2")] * 5
    holders = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=50)
    idf = np.maximum(0, np.log((len(tails) - holders + 0.5) / (holders + 0.5)))
    mean = np.mean([len(t) for t in tails])
    index = Index(tails, idf, mean)

    def bm25(query, tail):
        times = [(idf[t], (tail == t).sum()) for t in np.unique(query)]
        return sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tail) / mean)) for w, n in times)

    wanted = [[bm25(q, t) for t in tails] for q in tails]
    for i, scores in enumerate(wanted):
        assert np.allclose(index.scores(i), scores)
    rest, expected = [len(t) for t in tails], []
    for seed in range(len(tails)):
        while rest[seed]:
            free, row = 100, [seed]
            while free and row:
                n = min(rest[row[-1]], free)
                expected.append((row[-1], len(tails[row[-1]]) - rest[row[-1]], n))
                rest[row[-1]] -= n
                free -= n
                left = [i for i in range(len(tails)) if rest[i]]
                row = [max(left, key=lambda i: (index.scores(seed)[i], -i))] if left else []
    found = fill_windows([len(t) for t in tails], index.scores, 100)
    assert [p[:3] for p in found] == expected


def test_nothing_to_pack(no_docs, vocabulary):
    assert pack_by_retrieval(no_docs, vocabulary).collect() == []


def test_related_documents_meet_with_many_shards(spark, vocabulary):
    """Topics of eight documents in 20 shards; a third of all rows are copies of one text."""
    rng = random.Random(8)
    words = [w.decode() for w in vocabulary if w.startswith(b" ") and w[1:].isalpha() and w.isascii() and len(w) > 5][:4000]
    rng.shuffle(words)
    topics = [words[40 * i : 40 * i + 40] for i in range(60)]
    rows = [(8 * t + i, "".join(rng.choices(topic, k=40))) for t, topic in enumerate(topics) for i in range(8)]
    rows += [(1000 + i, "".join(words[3000:3050])) for i in range(240)]
    rng.shuffle(rows)
    found = pack_by_retrieval(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4), vocabulary, window=256, shard_tails=36
    ).collect()
    shards, sizes = defaultdict(set), defaultdict(set)
    for r in found:
        shards[r.doc_id].add(r.sequence_id >> 34)
        sizes[r.sequence_id >> 34].add(r.doc_id)
    assert len(sizes) == 20 and max(map(len, sizes.values())) <= 2 * 36
    met = sum(bool(shards[8 * t + i] & shards[8 * t + j]) for t in range(60) for i in range(8) for j in range(i))
    assert met >= 0.7 * 60 * 28
