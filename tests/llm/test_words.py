import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\n\x0b é", max_size=30)), max_size=8)


def plain(text, width):
    seq = (text or "").encode().lower().split()
    if not seq:
        return set()
    return {tuple(seq[i : i + width]) for i in range(max(1, len(seq) - width + 1))}


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_sets_have_the_sizes_and_overlaps_of_plain_shingles(texts, width):
    found = dict(words.shingle_sets(pa.array(texts, pa.string()), width))
    assert len(found) == len(texts)
    for i, a in enumerate(texts):
        assert len(found[i]) == len(plain(a, width))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(found[i], found[j])) == len(plain(a, width) & plain(b, width))


def test_adjacent_texts_do_not_join_words():
    found = dict(words.shingle_sets(pa.array(["ab", "cd", "abcd"]), 1))
    assert len(np.intersect1d(found[0], found[2])) == 0


def test_long_single_word():
    found = dict(words.shingle_sets(pa.array(["x" * 3_000_000, "x" * 3_000_001]), 4))
    assert [len(v) for v in found.values()] == [1, 1] and found[0][0] != found[1][0]
