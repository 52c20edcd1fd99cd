"""Comparison forms without positions, ranges of what is found, and look-ups that stay small."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_locate import best, corpus, frames, page  # noqa: F401
from test_operators import TEXTS, plain_projection, plain_score

from palimpsest.operators import locate as O
from palimpsest.operators import match as M
from palimpsest.plans import catalog
from palimpsest.session import stored

ODD = ["a ½  b", " ﬁ", "½ ", "İß\xad", "\x1c\x1d", "a　　ﬁ", "ＡＢ  Ｃ", "", "ab c"]


def test_forms_of_all_characters():
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    assert all(M._plain(c) for c in points)  # none goes, so a form of its text's length has moved nothing
    for c in points[::7] + points[:0x3000]:
        assert M.comparison_form(f"a{c}b") == plain_projection(f"a{c}b")[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.booleans())
def test_ranges_are_those_of_the_projection(texts, tight):
    asked, want = [], []
    for t in [*texts, *ODD]:
        form, starts, ends = plain_projection(t)
        kept = [k for k, c in enumerate(form) if not (tight and c == " ")]
        for at in range(len(kept)):
            asked.append((t, at, len(kept) - at, tight))
            want.append((starts[kept[at]], ends[kept[-1]]))
    assert M.original_ranges(*(list(x) for x in zip(*asked, strict=True))) == want


def test_unique_spans_and_ends_carry_no_positions(spark):
    """Texts and pairs of numbers come out of Python, never a number for each character."""
    pairs = [(t, t[1:3]) for t in ODD] + [("Straße", "SSE"), ("aba", "a"), ("a  b", " B"), (None, "a"), ("aaa", "aa"), ("x y", None)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, t string, s string")
    got = frame.select("k", M.unique_span("t", "s").alias("x"), M.comparison_ends("t").alias("y"))
    assert "array" not in got.schema.simpleString()
    for r in got.collect():
        form, starts, ends = plain_projection(pairs[r.k][0])
        needle = plain_projection(pairs[r.k][1])[0]
        places = [k for k in range(len(form)) if needle and form.startswith(needle, k)]
        span = (starts[places[0]], ends[places[0] + len(needle) - 1]) if len(places) == 1 else (None, None)
        assert (r.x.start, r.x.end) == span
        assert (r.y.text, r.y.first_at, r.y.end_at) == (form, starts[0] if starts else None, ends[-1] if ends else None)


@pytest.mark.parametrize("name", ["docx_locators", "comparison_texts", "page_characters"])
def test_plans_carry_no_positions(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "starts" not in plan and "array_repeat" not in plan


def test_prepared_frames_hold_texts_alone(frames):  # noqa: F811
    assert all("array" not in f.schema.simpleString() for f in frames)


def test_ranges_of_page_lines(corpus, frames):  # noqa: F811
    for r in O.page_lines(frames[1]).collect():
        text, ids = page(corpus[r.doc_id][1], r.page)
        assert r.page_text == text and [x.line_id for x in r.lines for _ in range(x["from"], x.to)] == ids


def test_windows_find_what_direct_look_ups_find(spark):
    rng = random.Random(12)
    long = [(k % 3, k, "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    short = sorted({(d, t[a : a + n]) for d, _, t in long for a in (0, 4) for n in (1, 5, 11, 30)})
    left, right = spark.createDataFrame(short, "d long, s string"), spark.createDataFrame(long, "d long, k long, t string")
    rows = lambda direct: sorted((r.d, r.s, r.k, r.t) for r in M.containing(left, right, "s", "t", ["d"], ["k"], direct).collect())
    want = sorted((d, s, k, t) for d, s in short for e, k, t in long if s and d == e and s in t)
    cut = sorted(sum(1 for d, s in short if d == g and s) * sum(len(t) for d, _, t in long if d == g) for g in range(3))[0]
    assert rows(0) == rows(cut) == rows(1 << 40) == want


def test_best_lines_of_a_page(spark):
    """Only lines that could matter beside those within the block are scored; the best one is the same."""
    rng = random.Random(13)
    words = ["erst", "haus", "of", "the", "anna", "tion", "heor", "inon"]
    blocks, lines, want = [], [], {}
    for d in range(30):
        own = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 8, 9, 14]))) for _ in range(6)]
        lines += [(d, 1, k, t) for k, t in enumerate(own)]
        for k, t in enumerate(own):
            text = t if rng.random() < 0.5 else t[: rng.randrange(len(t))] + "z" + t[rng.randrange(len(t)) :]
            text = plain_projection(text)[0]
            blocks.append((d, 1, f"{d}-{k}", text))
            if (got := best([(plain_score(text, x), (n, x)) for n, x in enumerate(own)])) is not None:
                want[f"{d}-{k}"] = (got[0], plain_score(text, got[1]))
    b = spark.createDataFrame(blocks, "doc_id long, page long, block_id string, b_text string")
    n = spark.createDataFrame(lines, "doc_id long, page long, line_no long, l_text string")
    got = {r.block_id: (r.line_no, r.score) for r in O.best_by_text(b, n, "block_id").collect()}
    assert got == {k: (x[0], pytest.approx(x[1])) for k, x in want.items()} and 40 < len(want) < 180


def test_steps_of_selections_are_written_one_by_one(spark, corpus, frames, monkeypatch):  # noqa: F811
    """No step sends the pages to two others at once: their shuffles would lie on disk together."""
    written = []
    monkeypatch.setattr(O, "stored", lambda df, label, codec=None: written.append(label) or stored(df, label, codec))
    rows = [(d, f"{d}", x["page"], x["line_id"], x["text"]) for d, (_, lines) in corpus.items() for x in lines[:1]]
    O.resolve_selections(spark.createDataFrame(rows, "doc_id long, id string, page long, line_id string, exact_text string"), *frames)
    assert written.index("page-lines") < written.index("selections-with-lines") < written.index("selections-on-pages") < written.index("blocks-on-pages")
