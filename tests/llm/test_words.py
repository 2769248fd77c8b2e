"""Distinct words, their hashes and what rests on them, where hashes collide and texts are long."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from kilnworks.llm import bytestext as bt
from kilnworks.llm import token_counts, vocab
from kilnworks.llm.queries import BYTES, PIECES


def doubling(n, a, b):
    """Of the words that a polynomial in an odd number cannot tell from their complements modulo 2**64."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def library(texts):
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokenizers.Tokenizer.from_file(BYTES)
    return [len(sp.encode(t)) for t in texts], [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def ours(counter, bpe, texts):
    ids, n = bpe.ids(pa.array(texts))
    ends = np.cumsum(n)
    return counter.counts(pa.array(texts))[1].tolist(), [ids[a:b].tolist() for a, b in zip(ends - n, ends)]


def test_doubling_words():
    words = [doubling(n, *pair) for n in (1024, 2048, 4096) for ab in ("ab", "xy", "tz", "01", "qe") for pair in (ab, ab[::-1])]
    data, offsets = bt.flat(pa.array(words))
    assert len(set(bt.word_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(words)
    texts = [" ".join(words), *words]
    assert ours(token_counts.PieceCounter(PIECES), vocab.CachedBpe(BYTES), texts) == library(texts)


@pytest.mark.parametrize("room", [20, 10**6])
def test_colliding_words(monkeypatch, room):
    real = bt.word_hashes
    monkeypatch.setattr(bt, "word_hashes", lambda d, a, b, seed=0: real(d, a, b, seed) & np.uint64(127))
    r = random.Random(room)
    counter, bpe = token_counts.PieceCounter(PIECES, room), vocab.CachedBpe(BYTES, room)
    for _ in range(5):
        texts = ["".join(r.choice(["the", "t", "h", " ", "  ", "é", "1", "\n", "in", "word", "long" * 9]) for _ in range(r.randint(0, 120))) for _ in range(100)]
        assert ours(counter, bpe, texts) == library(texts)


def test_groups_and_finds(monkeypatch):
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 9, b"abcdefgh" * 9 + b"x", b"", b"\0", b"\0\0", b"x" * 2000]
    picked = [random.Random(5).choice(words) for _ in range(200)]
    data = np.frombuffer(b"".join(picked), "uint8")
    ends = np.cumsum([len(w) for w in picked])
    starts = ends - np.array([len(w) for w in picked])
    for mask in (2**64 - 1, 1, 0):
        real = bt.word_hashes
        monkeypatch.setattr(bt, "word_hashes", lambda d, a, b, seed=0, m=mask, f=real: f(d, a, b, seed) & np.uint64(m))
        keys, first, back = bt.Words.group(data, starts, ends)
        assert [picked[i] for i in first[back]] == picked and len(keys) == len(set(picked))
        known = bt.Words(100)
        taken = known.learn(keys, data, starts[first], ends[first])
        assert all(len(picked[first[i]]) <= bt.Words.LARGEST for i in taken)
        slot = known.find(keys, data, starts[first], ends[first])
        assert slot[taken].tolist() == list(range(len(taken))) and (np.delete(slot, taken) == -1).all()
        monkeypatch.setattr(bt, "word_hashes", real)


def test_long_runs():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [" " * n + x for n in (15, 16, 17, 400, 5000, 40001) for x in ("", "a", "\n")] + ["a" * 70000, "中文" * 30000, "ab " * 30000]
    for together in (token_counts.TOGETHER, 3):
        old, token_counts.TOGETHER = token_counts.TOGETHER, together
        try:
            assert token_counts.PieceCounter(PIECES).counts(pa.array(texts))[1].tolist() == [len(sp.encode(t)) for t in texts]
        finally:
            token_counts.TOGETHER = old
