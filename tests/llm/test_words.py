import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gamelog.llm.common import plain_words, shingle_hashes, word_hashes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "\t", "\n", " ", "\x0b", "\xa0", "1", "-", "語"]), max_size=40))
def test_word_hashes_follow_words(parts):
    text = "".join(parts)
    words, hashes = plain_words(text), word_hashes(text)
    assert len(words) == len(hashes)
    assert len(set(words)) == len(set(hashes.tolist()))
    assert [w1 == w2 for w1 in words for w2 in words] == [bool(h1 == h2) for h1 in hashes for h2 in hashes]


def test_no_words_and_signs():
    assert len(word_hashes(None)) == len(word_hashes("")) == len(word_hashes(" \n\t")) == 0
    assert np.array_equal(word_hashes("One, two!", signs=False), word_hashes("one two"))
    long = "x" * 100_000
    assert len(word_hashes(long + " y")) == 2


@pytest.mark.parametrize("words, width, count", [(0, 3, 0), (1, 3, 1), (2, 3, 1), (3, 3, 1), (7, 3, 5)])
def test_shingle_counts(words, width, count):
    assert len(shingle_hashes(word_hashes(" ".join(f"w{i}" for i in range(words))), width)) == count
