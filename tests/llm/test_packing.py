import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_uses_each_length_as_often_as_it_comes(histogram):
    got = {}
    for held, times in packing.plan(histogram, 64):
        assert sum(held) <= 64
        for n in held:
            got[n] = got.get(n, 0) + times
    assert got == histogram


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5, 1, 20_000).astype(int) + 1, 1024)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    used = sum(t for _, t in packing.plan(histogram))
    assert used <= 1.01 * -(-lengths.sum() // 1024)


def test_fit_finds_the_exact_answer():
    columns = [(6, 4), (5, 5), (7, 3)]
    truth = np.array([3, 2, 4])
    histogram = np.zeros(11)
    for p, n in zip(columns, truth):
        for x in p:
            histogram[x] += n
    assert np.allclose(packing.fitted(histogram, columns, sweeps=200), truth, atol=0.05)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(n):
    parts = packing.cut(n)
    assert sum(k for _, k in parts) == n and parts[0][0] == 0
    assert all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
    assert all(k == 1024 for _, k in parts[1:]) and 1 <= parts[0][1] <= 1024


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_fast_ids_equal_the_tokenizers(text):
    tok = _tokenizer()
    assert tok.ids(text) == tok.full.encode(text, add_special_tokens=False).ids


def _tokenizer(cache=[]):  # noqa: B006
    if not cache:
        cache.append(packing.Tokenizer(*packing.tokenizer_paths()))
    return cache[0]


def test_special_strings():
    tok = _tokenizer()
    assert 50256 in tok.ids("a<|endoftext|>b") and 50256 not in tok.plain_ids("a<|endoftext|>b")


def test_round_trip(spark):
    texts = ["", None, "hello there", "word " * 3000, "x", "the same", "the same", "ß" * 700]
    rows = [(i if i else None, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.packed(docs).toPandas()
    tok, end = _tokenizer(), 2
    for i, t in enumerate(texts):
        ids = np.array([*tok.ids(t), end], "<u4")
        own = got[got.doc_id == i] if i else got[got.doc_id.isna()]
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for a, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[a : a + n]) == crc
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 1024 and (seq.length.cumsum() - seq.length == seq.offset).all()
    assert packing.packed(docs.limit(0)).count() == 0
