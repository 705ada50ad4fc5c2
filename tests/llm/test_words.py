import numpy as np
import pytest

from almanac.llm import words as W


def test_words_are_split_at_ascii_white_space_only():
    assert len(W.hash_texts(["a b c\x0bd\x1ce\x85f\tg".encode()])[0]) == 4


@pytest.mark.parametrize("n", [1, 2, 3, 7, 18, 35, 64])
def test_equal_windows_and_only_they_have_equal_hashes(n):
    rng = np.random.default_rng(n)
    words = W.hash_words([bytes([x]) for x in rng.integers(97, 99, 400).tolist()])
    h = W.ngram_hashes(words, n, seed=3)
    windows = [tuple(words[i : i + n].tolist()) for i in range(len(words) - n + 1)]
    assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows)) == len({*zip(h.tolist(), windows)})


def test_windows_end_with_their_text():
    _, offsets = W.hash_texts([b"a b c", None, b"", b"d e"])
    assert offsets.tolist() == [0, 3, 3, 3, 5] and W.inside(offsets, 2, 4).tolist() == [True, True, False, True]


def test_membership():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for size in (0, 1, 100, 3000):
        chosen = np.sort(np.concatenate([values[:size], rng.integers(0, 1 << 63, size).astype(np.uint64)]))
        assert (W.member(values, chosen) == np.isin(values, chosen)).all()
    assert not len(W.member(np.zeros(0, np.uint64), values))
