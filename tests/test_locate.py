"""Locators and selections against plain Python versions of their rules, on small documents."""

import random

import pytest
from test_operators import plain_projection, plain_score

from palimpsest.operators import locate as O
from palimpsest.operators import match as M

WORDS = ["Straße", "haus", "inon", "erst", "of", "the", "Anna", "ﬁn", "tion", "heor"]


def compact(text):
    whole = plain_projection(text)
    kept = [k for k, c in enumerate(whole[0]) if c != " "]
    return "".join(whole[0][k] for k in kept), [whole[1][k] for k in kept], [whole[2][k] for k in kept]


def only(haystack, needle):
    n = sum(haystack[k:].startswith(needle) for k in range(len(haystack))) if needle else 0
    return haystack.find(needle) if n == 1 else None


def span(forms, needle):
    at = only(forms[0], needle)
    return None if at is None else (forms[1][at], forms[2][at + len(needle) - 1])


def best(scored):
    ranked = sorted(scored, key=lambda x: -x[0])
    if not ranked or ranked[0][0] < 0.7 or (len(ranked) > 1 and ranked[0][0] - ranked[1][0] < 0.05):
        return None
    return ranked[0][1]


def locator(block, exact, lines):
    found = span(plain_projection(block), plain_projection(exact)[0])
    line = best([(max(plain_score(exact, x["text"]), plain_score(block, x["text"])), x) for x in lines]) if found else None
    return (*found, line["page"], line["line_id"]) if line else None


def page(lines, number):
    own = [(c, x["line_id"]) for x in lines if x["page"] == number for c in compact(x["text"])[0]]
    return "".join(c for c, _ in own), [i for _, i in own]


def context(blocks, lines, number, line_id, exact):
    text, ids = page(lines, number)
    fragment = compact(exact)[0]
    starts = [k for k in range(len(text)) if fragment and text.startswith(fragment, k) and ids[k] == line_id]
    out = set()
    if len(starts) == 1:
        first, last = starts[0], starts[0] + len(fragment)
        for b, t in blocks.items():
            forms = compact(t)
            for k in range(len(text)):
                if forms[0] and text.startswith(forms[0], k) and k <= first and last <= k + len(forms[0]):
                    out.add((b, forms[1][first - k], forms[2][last - k - 1]))
    return out


def selection(blocks, lines, number, line_id, exact):
    line = next(x for x in lines if x["page"] == number and x["line_id"] == line_id)
    found = context(blocks, lines, number, line_id, exact)
    if not found:
        loose = span(plain_projection(line["text"]), plain_projection(exact)[0]) is None
        if loose:
            text, ids = page(lines, number)
            fragment = compact(exact)[0]
            at = only(text, fragment)
            if at is None or ids[at] != line_id or len(set(ids[at : at + len(fragment)])) < 2:
                return None
        forms = compact if loose else plain_projection
        spans = {b: span(forms(t), forms(exact)[0]) for b, t in blocks.items()}
        found = {(b, *s) for b, s in spans.items() if s}
    if len(found) == 1:
        return next(iter(found))
    return best([(max(plain_score(exact, line["text"]), plain_score(blocks[f[0]], line["text"])), f) for f in found])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    docs = {}
    for d in range(25):
        blocks = {f"b{d}-{k}": " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 8, 25]))) for k in range(rng.randrange(1, 6))}
        lines = []
        for text in blocks.values():
            words = text.upper().split() if rng.random() < 0.4 else text.split()
            lines += [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
        lines = [{"page": k // 6 + 1, "line_id": f"l{k % 6 + 1:04d}", "line_no": k, "text": t} for k, t in enumerate(lines)]
        docs[d] = (blocks, lines)
    return docs


@pytest.fixture(scope="module")
def frames(spark, corpus):
    blocks = spark.createDataFrame([(d, b, t) for d, (own, _) in corpus.items() for b, t in own.items()], "doc_id long, block_id string, text string")
    rows = [(d, x["page"], x["line_id"], x["line_no"], x["text"]) for d, (_, lines) in corpus.items() for x in lines]
    return O.prepared(blocks, spark.createDataFrame(rows, "doc_id long, page long, line_id string, line_no long, text string"))


def test_locators_and_their_checks(spark, corpus, frames):
    rng = random.Random(7)
    rows, expected = [], {}
    for d, (blocks, lines) in corpus.items():
        for b, text in blocks.items():
            words = text.split()
            at = rng.randrange(len(words))
            exact = " ".join(words[at : at + rng.randrange(1, 9)]).upper()
            rows.append((d, f"{b}f", b, exact))
            if got := locator(text, exact, lines):
                expected[f"{b}f"] = (b, *got)
    findings = spark.createDataFrame(rows, "doc_id long, id string, block_id string, exact_text string")
    got = O.block_locators(findings, *frames).collect()
    assert {r.id: (r.block_id, r.start, r.end, r.page, r.line_id) for r in got} == expected and len(expected) > 15
    told = []
    for r in got:
        assert r.exact_text == corpus[r.doc_id][0][r.block_id][r.start : r.end]
        shift = rng.choice([0, 0, 0, 1])
        told.append((r.doc_id, r.id, r.block_id, r.start + shift, r.end + shift, r.exact_text, r.page, rng.choice([r.line_id, r.line_id, "l0001"])))
    frame = spark.createDataFrame(told, "doc_id long, id string, block_id string, start int, end int, exact_text string, page long, line_id string")
    valid = {}
    for d, i, b, start, end, exact, number, line_id in told:
        blocks, lines = corpus[d]
        around = context({b: blocks[b]}, lines, number, line_id, exact)
        good = (b, start, end) in around or locator(blocks[b], exact, lines) == (start, end, number, line_id)
        valid[i] = blocks[b][start:end] == exact and good
    assert {r.id: r.valid for r in O.valid_locators(frame, *frames).collect()} == valid and {True, False} == set(valid.values())


def test_selections(spark, corpus, frames):
    rng = random.Random(8)
    rows, expected = [], {}
    for d, (blocks, lines) in corpus.items():
        for k, x in enumerate(lines):
            words = x["text"].split()
            follow = lines[k + 1]["text"].split() if k + 1 < len(lines) else []
            exact = " ".join(words[rng.randrange(len(words)) :][:4]) if rng.random() < 0.6 else " ".join(words[-2:] + follow[:2])
            rows.append((d, f"{d}-{k}", x["page"], x["line_id"], exact))
            if got := selection(blocks, lines, x["page"], x["line_id"], exact):
                expected[f"{d}-{k}"] = got
    frame = spark.createDataFrame(rows, "doc_id long, id string, page long, line_id string, exact_text string")
    got = {r.id: (r.block_id, r.start, r.end) for r in O.resolve_selections(frame, *frames).collect()}
    assert got == expected and 40 < len(expected) < len(rows)
    pages = {(r.doc_id, r.page): (r.page_text, r.line_ids) for r in O.page_characters(frames[1]).collect()}
    assert pages == {(d, n): page(lines, n) for d, (_, lines) in corpus.items() for n in {x["page"] for x in lines}}


def made_rows(df):
    """The most rows that any join of the plan that has run put out."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, most = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_lines_are_looked_up_not_paired(spark):
    """A document of twice the lines makes about twice the candidates, by windows and by parts, a few
    for each of its parts."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    made = {}
    for n in (300, 600):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 12))) for _ in range(n)]
        lines = spark.createDataFrame([(1, 1, str(k), t) for k, t in enumerate(texts)], "doc_id long, page long, line_id string, l_text string")
        inner = spark.createDataFrame([(1, f"f{k}", t[7:25]) for k, t in enumerate(texts)], "doc_id long, id string, x string")
        found = M.containing(inner, lines, "x", "l_text", ["doc_id"], ["page", "line_id"])
        assert len([r for r in found.collect() if r.id == f"f{r.line_id}"]) == n
        changed = [(1, t[:20] + "?" + t[21:], 0.95) for t in texts]
        near = O.similar_lines(spark.createDataFrame(changed, "doc_id long, x string, least double"), lines)
        assert near.count() == n
        near.collect()
        made[n] = made_rows(found), made_rows(near)
    for few, many in zip(made[300], made[600], strict=True):
        assert 300 <= few and many <= 3 * few and many < 600 * 600 / 50


@pytest.mark.parametrize("least", [0.65, 0.8, 0.9, 0.93, 0.97])
def test_similar_lines_are_all_that_score_enough(spark, least):
    rng = random.Random(10)
    alphabet = "abcdefgh "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).strip() or "a"
    lines = [text(rng.choice([3, 10, 40, 60, 64, 90])) for _ in range(60)]
    sought = set()
    for t in lines * 2:
        edited = list(t)
        for _ in range(rng.randrange(1, 1 + max(1, len(t) // 8))):
            edited[rng.randrange(len(edited))] = rng.choice(["", "z", "ab"])
        sought.add("".join(edited) or "b")
    frame = spark.createDataFrame([(1, 1, str(k), t) for k, t in enumerate(lines)], "doc_id long, page long, line_id string, l_text string")
    got = O.similar_lines(spark.createDataFrame([(1, x, least) for x in sorted(sought)], "doc_id long, x string, least double"), frame)
    got = {(r.x, r.line_id): r.score for r in got.collect()}
    want = {(x, str(k)): M.score(x, t) for x in sought for k, t in enumerate(lines) if x not in t and t not in x and M.score(x, t) >= least}
    assert got == want and want


def test_texts_within_texts_of_any_length(spark):
    rng = random.Random(11)
    long = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    short = sorted({t[k : k + n] for t in long for k in (0, 3, 9) for n in (1, 2, 5, 6, 10, 11, 12, 30)} | {""})
    left = spark.createDataFrame([(1, t) for t in short], "doc_id long, s string")
    right = spark.createDataFrame([(1, k, t) for k, t in enumerate(long)], "doc_id long, k long, t string")
    got = sorted((r.s, r.k) for r in M.containing(left, right, "s", "t", ["doc_id"], ["k"]).collect())
    assert got == sorted((s, k) for s in short for k, t in enumerate(long) if s and s in t)
