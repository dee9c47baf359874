"""Hashes of text and what is remembered under them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import jaccard, packing, queries, textcore


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += other(word)
    return word[:n]


def other(word):
    return word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 2048, 8192])
def test_a_word_and_its_complement_are_told_apart(n):
    from tokenizers import Tokenizer

    texts = [thue_morse(n), other(thue_morse(n))]
    path = queries.tokenizer_path()
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    sets = list(jaccard.shingle_sets(pa.array([f"{t} one two" for t in texts]), 3))
    assert sets[0].tolist() != sets[1].tolist()


@pytest.mark.parametrize("exact", [False])
def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch, exact):
    from tokenizers import Tokenizer

    whole = textcore.memo_keys
    monkeypatch.setattr(textcore, "memo_keys", lambda *a: [f(x) for f, x in zip((lambda h: h & np.uint64(7), lambda e: e & exact), whole(*a))])
    path, rnd = queries.tokenizer_path(), random.Random(1)
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for _ in range(20):
        text = " ".join("".join(rnd.choices("abcdé", k=rnd.randrange(1, 5))) for _ in range(40))
        assert next(encoder.encode([text])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_hash_hangs_on_the_span_alone():
    rnd = np.random.default_rng(2)
    values = rnd.integers(97, 100, 3 * textcore.SLICE).astype(np.uint8)
    starts = np.sort(rnd.choice(len(values) - 50, 3000, replace=False))
    ends = np.minimum(starts + rnd.integers(0, 40, 3000), len(values))
    got = textcore.span_hashes(values, starts, ends)
    of = {}
    for h, a, b in zip(got.tolist(), starts.tolist(), ends.tolist()):
        assert of.setdefault(values[a:b].tobytes(), h) == h
    assert len(set(of.values())) == len(of)
    long = np.zeros(2 * textcore.SLICE + 7, np.uint8)
    a, b = (textcore.span_hashes(np.concatenate((np.ones(k, np.uint8), long)), np.array([k]), np.array([k + len(long)])) for k in (0, 5))
    assert a == b


def test_short_spans_are_their_own_keys():
    rnd = np.random.default_rng(4)
    values = rnd.choice([0, 1, 97, 98, 255, 256, 0x4E00, 0x10FFFF], 40_000).astype(np.uint32)
    starts = np.sort(rnd.choice(len(values) - 12, 9000, replace=False))
    ends = starts + rnd.integers(0, 11, 9000)
    h, exact = textcore.memo_keys(values, starts, ends)
    of = {}
    for key, e, a, b in zip(h.tolist(), exact.tolist(), starts.tolist(), ends.tolist()):
        span = tuple(values[a:b].tolist())
        assert e == (len(span) <= 7 and all(c < 256 for c in span)) and of.setdefault(span, key) == key
    assert len(set(of.values())) == len(of)
    memo, seen = textcore.Memo(), []
    rows = memo.rows(values, starts, ends, lambda at: seen.extend(at.tolist()), 1 << 60)
    of = {}
    assert all(of.setdefault(tuple(values[a:b].tolist()), r) == r for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist())) and len(set(of.values())) == len(of) == memo.size == len(seen)
    assert all(rows[i] == k for k, i in enumerate(seen)) and (memo.lookup(values, starts, ends) == rows).all()
