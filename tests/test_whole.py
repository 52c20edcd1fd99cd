"""Documents taken whole: the same rows as step by step, with nothing written on the way."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_forms import ODD
from test_locate import corpus, frames, selection  # noqa: F401
from test_operators import TEXTS, plain_projection

from palimpsest.operators import locate as O
from palimpsest.operators import match as M
from palimpsest.operators import whole as W
from palimpsest.session import stored


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.booleans())
def test_origins_are_those_of_the_projection(texts, tight):
    texts = [*texts, *ODD, "Straße ﬁn½", "ΑΣ Σ ǅ"]
    got = W._Origins(texts, [M._plainly(t) for t in texts])
    for k, t in enumerate(texts):
        form, starts, ends = plain_projection(t)
        kept = [i for i, c in enumerate(form) if not (tight and c == " ")]
        for at, i in enumerate(kept):
            for n in (1, 2, len(kept) - at):
                last = kept[min(at + n, len(kept)) - 1]
                if " " not in (form[i], form[last]):
                    assert got.range(k, at, min(n, len(kept) - at), tight) == (starts[i], ends[last])


def _asked(corpus, seed):  # noqa: F811
    rng = random.Random(seed)
    rows, expected = [], {}
    for d, (blocks, lines) in corpus.items():
        for k, x in enumerate(lines):
            words = x["text"].split()
            follow = lines[k + 1]["text"].split() if k + 1 < len(lines) else []
            exact = rng.choice([" ".join(words[:2]), words[-1][:2], " ".join(words[-1:] + follow[:2]), x["text"].title(), ""])
            rows.append((d, f"{d}-{k}", x["page"], x["line_id"], exact))
            if got := selection(blocks, lines, x["page"], x["line_id"], exact):
                expected[f"{d}-{k}"] = got
    return rows, expected


@pytest.mark.parametrize("whole", [0, 150, 1 << 19])
def test_selections_of_whole_documents_and_by_steps(spark, corpus, frames, whole):  # noqa: F811
    rows, expected = _asked(corpus, 14)
    frame = spark.createDataFrame(rows, "doc_id long, id string, page long, line_id string, exact_text string")
    got = O.resolve_selections(frame, *frames, whole=whole).collect()
    assert {r.id: (r.block_id, r.start, r.end) for r in got} == expected and len(got) == len(expected) > 40
    assert all(r.exact_text == corpus[r.doc_id][0][r.block_id][r.start : r.end] for r in got)


def test_selections_of_whole_documents_write_nothing(spark, corpus, frames, monkeypatch):  # noqa: F811
    """Steps were written with all texts before, though no document is too large for a task."""
    written = []
    monkeypatch.setattr(O, "stored", lambda df, label, codec=None: written.append(stored(df, label, codec)) or written[-1])
    frame = spark.createDataFrame(_asked(corpus, 15)[0], "doc_id long, id string, page long, line_id string, exact_text string")
    assert O.resolve_selections(frame, *frames).count() and written and not any(x.count() for x in written)


def test_lines_and_ids_that_are_missing(spark):
    """Nulls on either side, a line twice and an id twice are as they are step by step."""
    own = spark.createDataFrame([(1, "a", "one two three"), (1, "b", None), (1, None, "four five"), (2, "c", "Six six")], "doc_id long, block_id string, text string")
    lines = [(1, 1, "l1", 0, "one two three"), (1, 1, "l2", 1, None), (1, None, "l3", 2, "four five"), (2, 1, "l1", 0, "six"), (2, 1, "l1", 1, "SIX"), (None, 1, "l1", 0, "x")]
    shown = spark.createDataFrame(lines, "doc_id long, page long, line_id string, line_no long, text string")
    asked = [(1, "p", 1, "l1", "TWO"), (1, "q", 1, "l2", "x"), (1, "r", None, "l3", "four"), (1, None, 1, "l1", "one"), (2, "s", 1, "l1", "six"), (2, "s", 1, "l1", "six six"), (1, "t", 1, "l9", "one")]
    frame = spark.createDataFrame(asked, "doc_id long, id string, page long, line_id string, exact_text string")
    rows = lambda whole: sorted(map(tuple, O.resolve_selections(frame, *O.prepared(own, shown), whole=whole).collect()))
    assert rows(1 << 19) == rows(0) and ("p", 1, "a", 4, 7, "two") in rows(0)


def test_locators_write_what_is_asked_of_alone(spark, corpus, frames, monkeypatch):  # noqa: F811
    """Texts of documents without findings were written, sent and put into pages before."""
    written = []
    monkeypatch.setattr(O, "stored", lambda df, label, codec=None: written.append((label, stored(df, label, codec))) or written[-1][1])
    rows = [(d, f"{d}", b, t) for d, (blocks, _) in corpus.items() if d < 3 for b, t in list(blocks.items())[:1]]
    findings = spark.createDataFrame(rows, "doc_id long, id string, block_id string, exact_text string")
    got = O.block_locators(findings, *frames)
    O.valid_locators(got, *frames)
    held = {label: {r.doc_id for r in x.select("doc_id").distinct().collect()} for label, x in written if label in ("block-texts", "line-texts", "page-lines")}
    assert len(held) == 3 and set.union(*held.values()) <= {0, 1, 2}


@pytest.mark.parametrize("forms", [True, False])
def test_blocks_of_equal_documents_do_not_compete(spark, monkeypatch, forms):
    """Blocks of documents with equal texts have equal ids: each has its line, none stands in another one's way.
    Nothing is written, which all texts were before."""
    monkeypatch.setattr(O, "stored", None)
    text, lines = "erst das haus", ["erst das", "erst das haus und", "tion"]
    made = (lambda t: t) if forms else (lambda t: f" {t.upper()}\n")
    blocks = [(d, 1, "b", made(text)) for d in (1, 2)] + [(1, 2, "c", made(text)), (3, 1, "b", made("inon")), (4, 1, "b", None), (1, None, "e", made(text))]
    shown = [(d, 1, k, made(t)) for d in (1, 2) for k, t in enumerate(lines)] + [(3, 1, 0, made("inon")), (3, 1, 1, None), (4, 1, 0, made(text)), (1, None, 9, made(text))]
    b = spark.createDataFrame(blocks, "doc_id long, page long, block_id string, b_text string")
    n = spark.createDataFrame(shown, "doc_id long, page long, line_no int, l_text string")
    got = sorted((r.block_id, r.line_no, r.score) for r in O.best_by_text(b, n, "block_id", forms).collect())
    assert got == [("b", 0, 1.0)] + [("b", 1, pytest.approx(M.score(text, lines[1])))] * 2
