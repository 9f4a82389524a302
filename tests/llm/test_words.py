import random

import numpy as np
import pyarrow as pa

from case_insights.llm import words as W


def test_words_and_hashes_follow_the_bytes():
    texts = ["Hello  World\n foo", None, "", "a b c", "hello world", "\x00 \x1c é", "x" * 700_000 + " y", " "]
    data, offsets = W.text_bytes(pa.array(texts))
    start, end, first = W.split_words(data, offsets)
    found = [[bytes(data[a:b]) for a, b in zip(start[i:j], end[i:j])] for i, j in zip(first, first[1:])]
    assert found == [(t or "").encode().split() for t in texts]
    flat = [w for ws in found for w in ws]
    h = W.hash_words(data, start, end)
    assert len(set(h.tolist())) == len(set(flat))
    assert len(set(W.hash_words(data, start, end, lower=True).tolist())) == len({w.lower() for w in flat})


def test_hashes_dont_depend_on_what_stands_around():
    rng = random.Random(1)
    words = ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    column = pa.array([" ".join(words), *words])
    data, offsets = W.text_bytes(column)
    h = W.hash_words(data, *W.split_words(data, offsets)[:2])
    assert (h[:3000] == h[3000:]).all()
    assert len(np.unique(h)) == len(set(words))
    sliced = W.text_bytes(column.slice(5, 9))
    start, end, _ = W.split_words(*sliced)
    assert (W.hash_words(sliced[0], start, end) == h[3004:3013]).all()


def test_runs_name_word_sequences():
    rng = random.Random(2)
    words = [rng.choice(["a", "b", "c"]) for _ in range(2000)]
    data, offsets = W.text_bytes(pa.array([" ".join(words)]))
    h = W.hash_words(data, *W.split_words(data, offsets)[:2])
    runs = W.run_hashes(h, 4)[:-3]
    assert len(set(runs.tolist())) == len({tuple(words[i : i + 4]) for i in range(1997)})


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * n for n in (0, 5, 50, 3, 0, 9)])})
    parts = list(W.slices(batch, size=10))
    assert len(parts) > 1 and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert list(W.slices(batch.slice(0, 0))) == []
