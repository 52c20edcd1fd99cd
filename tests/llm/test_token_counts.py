import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import token_counts as tc

ALPHABET = st.text(alphabet="abst é1.,'!\n\t  \xa0漢、\u0301\x1c\u3000😀٣", max_size=120)
COUNTS = tc.counter(tc.read_vocabulary(tc.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(0, 120), st.integers(0, 20), ALPHABET), max_size=4), st.integers(1, 20))
def test_updated_trees_count_like_the_whole_text(text, edits, segment):
    tree = tc.Tree.build(text, COUNTS, segment)
    assert tree.tokens[1] == tc.count_tokens(text, tc.VOCABULARY)
    for first, length, replacement in edits:
        first = min(first, len(text))
        last = min(first + length, len(text))
        expected = text[:first] + replacement + text[last:]
        text, _ = tree.edit(text, first, last, replacement, COUNTS)
        assert text == expected
        assert tree.chars[1] == len(text)
        assert tree.tokens[1] == tc.count_tokens(text, tc.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_borders_part_pre_tokens(text):
    assert COUNTS.count(text) == tc.count_tokens(text)
    for k in range(len(text)):
        if tc._BORDER.match(text, k):
            assert tc.count_tokens(text[:k]) + tc.count_tokens(text[k:]) == tc.count_tokens(text)


def test_texts_without_spaces_are_edited_in_part():
    rng = random.Random(3)
    text = "".join(rng.choice("漢字文書處理系統") + rng.choice(["", "", "", "", "、", "。"]) for _ in range(16_000))
    tree = tc.Tree.build(text, COUNTS)
    new, encoded = tree.edit(text, 8000, 8003, "語", COUNTS)
    assert encoded < 2000 and tree.tokens[1] == tc.count_tokens(new)
    word = "a" * 50_000  # one pre-token, one segment
    tree = tc.Tree.build(word, COUNTS)
    assert tree.tokens[1] == tc.count_tokens(word)
    assert tree.edit(word, 5, 6, "b", COUNTS)[1] == 50_000


def test_documents(spark):
    rng = random.Random(2)
    rows, edits, expected = [], [], {}
    for d in range(40):
        text = " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([0, 3, 2000])))
        rows.append((d, text))
        new, at = "", 0
        for first in sorted(rng.sample(range(len(text) + 1), min(3, len(text)))):
            last = min(first + rng.randrange(9), len(text))
            if first >= at:
                edits.append((d, first, last, "[X Y]"))
                new += text[at:first] + "[X Y]"
                at = last
        expected[d] = (text, new + text[at:])
    rows += [(100, None), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).repartition(3)
    edit_table = spark.createDataFrame([*edits, (999, 0, 1, "x"), (100, 0, 5, "new")], "doc_id long, first long, last long, replacement string")
    got = {r.doc_id: r for r in tc.edit_aware_counts(docs, edit_table).collect()}
    assert len(got) == 42
    for d, (old, new) in expected.items():
        assert got[d].tokens_before == tc.count_tokens(old, tc.VOCABULARY)
        assert got[d].tokens_after == tc.count_tokens(new, tc.VOCABULARY)
        assert len(old) < 5000 or got[d].chars_encoded < len(new) / 2
    assert got[100].tokens_after == tc.count_tokens("new", tc.VOCABULARY)
    assert tc.edit_aware_counts(docs.limit(0), edit_table).count() == 0
