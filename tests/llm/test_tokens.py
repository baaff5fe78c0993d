"""The tree encoder's joins, the encoder's checks and the token operators' registered queries on odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from scriptorium.llm import _bpe, bpe_tree

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("w", pat_str=PATTERN, mergeable_ranks=_bpe.ranks_from_tiktoken(RANKS), special_tokens={})


def test_every_text_beyond_a_leaf_is_joined(monkeypatch, library):
    joins = []
    inner = bpe_tree.join
    monkeypatch.setattr(bpe_tree, "join", lambda text, *rest: joins.append(text) or inner(text, *rest))
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(n)) for n in (0, 3, 60, 250, 1500)] + ["x" * 3000, " " * 700, "\n a" * 400]
    bpe = _bpe.BatchBPE(_bpe.ranks_from_tiktoken(RANKS), PATTERN)
    for text, ids in zip(texts, bpe_tree.encode_all(texts, bpe), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe_tree.decode(ids, bpe.pieces) == text.encode()
    for text in texts:
        leaves = sum(1 for level in bpe_tree.levels([len(text)], bpe_tree.LEAF_CHARS) for _, a, b in level if b - a <= bpe_tree.LEAF_CHARS)
        assert joins.count(text) == leaves - 1 and (leaves > 1) == (len(text) > 256)


def test_tokens_that_agree_in_one_hash_are_told_apart(library):
    bpe = _bpe.BatchBPE(_bpe.ranks_from_tiktoken(RANKS), PATTERN)
    bpe.hasher.spans = lambda cp, begin, end: (end - begin).astype(np.uint64)  # all words of a length agree
    texts = ["alpha beta gamma", "delta alpha", "", "beta beta", "omega 12 34"]
    for _ in range(2):
        assert [x.tolist() for x in bpe.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_another_pattern_is_refused():
    with pytest.raises(ValueError, match="pattern"):
        _bpe.BatchBPE(_bpe.ranks_from_tiktoken(RANKS), r"\S+|\s+")


def test_a_worker_holds_one_encoder(monkeypatch):
    from scriptorium.llm import _common

    monkeypatch.setattr(_common, "_held", {})
    first = _bpe.encoder(RANKS, PATTERN)
    assert _bpe.encoder(RANKS, PATTERN) is first
    assert _common.held(None) is None and not _common._held
    assert _bpe.encoder(RANKS, PATTERN) is not first and hashlib.sha256(_bpe.encoder(RANKS, PATTERN).encode(["a b"])[0].tobytes()).hexdigest()


def test_few_new_words_leave_the_store_in_place(library):
    bpe = _bpe.BatchBPE(_bpe.ranks_from_tiktoken(RANKS), PATTERN)
    bpe.encode([" ".join(f"w{i}x{i * 7}" for i in range(20_000))])
    before = bpe.keys, bpe.checks, bpe.at, bpe.n, bpe.flat
    for i in range(30):
        text = f"new{i}q w{i}x{i * 7} unseen{i * i}"
        assert bpe.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert all(x is y for x, y in zip(before, (bpe.keys, bpe.checks, bpe.at, bpe.n, bpe.flat), strict=True))


@pytest.mark.parametrize("slots,kept", [(64, 30), (1 << 12, 100), (1 << 12, 1500)])
def test_a_small_store_is_emptied_and_goes_on(monkeypatch, library, slots, kept):
    monkeypatch.setattr(_bpe, "SLOTS", slots, raising=False)
    monkeypatch.setattr(_bpe, "MOST_KEPT", kept)
    bpe = _bpe.BatchBPE(_bpe.ranks_from_tiktoken(RANKS), PATTERN)
    rng = random.Random(3)
    for size in (5, 20, 3, 3000, 4, 25, 25, 25, 400, 400):
        texts = [" ".join(rng.choice("abcdeé") * rng.randint(1, 4) + str(rng.randint(0, 2000)) for _ in range(size)) for _ in range(2)] + ["", None]
        assert [x.tolist() for x in bpe.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]
