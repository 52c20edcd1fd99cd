import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import line_dedup as ld


def run(spark, rows, schema="doc_id long, text string", **options):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return {r.doc_id: r for r in ld.line_dedup(docs, **options).collect()}


def sentence(rng, n, end="."):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)) + end


def plain_units(text, least):
    """Lines by a regular expression: (words, length) of each."""
    pieces, out, held = re.findall(r"(?s)[^\n]*?(?:[.!?](?=[\x20\x09-\x0d]|$)|\n|$)", text), [], []
    for piece in pieces:
        own = piece.encode().split()
        held += own
        if len(own) >= least:
            out.append(held)
            held = []
    return out + ([held] if held else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab.! \n\té", max_size=40), max_size=4), st.integers(1, 4))
def test_units_are_sentences_with_the_short_ones_before_them(texts, least):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    u = ld.Units(data, offsets, least)
    for k, t in enumerate(texts):
        own = slice(u.bounds[k], u.bounds[k + 1])
        expected = plain_units(t, least)
        # Short pieces without words of their own end nothing, so compare what holds words.
        assert sum(u.n_words[own]) == sum(map(len, expected))
        alone = ld.Units(np.frombuffer(raw[k], np.uint8), np.array([0, len(raw[k])]), least)
        assert alone.hashes.tolist() == u.hashes[own].tolist()
        starts = [*alone.starts.tolist(), len(raw[k])]
        parts = [raw[k][a:b].split() for a, b in zip(starts, starts[1:], strict=False)]
        assert [len(p) for p in parts] == alone.n_words.tolist()
        for a, ha in zip(parts, alone.hashes, strict=True):
            for b, hb in zip(parts, alone.hashes, strict=True):
                assert (a == b) == (ha == hb) or [x.lower() for x in a] == [x.lower() for x in b]


@given(st.lists(st.integers(0, 30), max_size=30))
def test_longest_increasing(values):
    found = [values[k] for k in ld.increasing(values)]
    assert found == sorted(set(found))
    best = [1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if values[j] < values[i]:
                best[i] = max(best[i], best[j] + 1)
    assert len(found) == max(best, default=0)


def test_passages_go_from_all_but_the_first_document(spark):
    rng = random.Random(4)
    passage = [sentence(rng, 14), "Of it.", sentence(rng, 20), "No!", sentence(rng, 22)]
    rows, own = [(0, "Of it.\n" + sentence(rng, 30))], {}
    for d in range(1, 60):
        before, after = [sentence(rng, 9) for _ in range(3)], [sentence(rng, 9) for _ in range(2)]
        own[d] = before + after
        glue = "\n" if d % 2 else " "
        rows.append((d, glue.join(before + passage + after)))
    got = run(spark, rows)
    assert got[0].text == rows[0][1] and got[1].text == rows[1][1]
    for d in range(2, 60):
        assert got[d].text.split() == " ".join(own[d]).split()
        assert got[d].removed_words == sum(len(x.split()) for x in passage)


def test_short_common_lines_stay(spark):
    rng = random.Random(5)
    rows = [(d, "\n".join([sentence(rng, 12), "All rights are reserved here by us.", sentence(rng, 12)])) for d in range(20)]
    assert {d: r.text for d, r in run(spark, rows).items()} == dict(rows)


def test_every_removed_line_is_in_an_earlier_document(spark):
    rng = random.Random(6)
    pool = [sentence(rng, rng.choice([2, 6, 12])) for _ in range(60)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.choice([1, 2, 3])):
            at = rng.randrange(50)
            lines += pool[at : at + rng.randrange(1, 10)]
        rows.append((d, "\n".join(lines)))
    got = run(spark, rows)
    seen, exact, gone = set(), {}, 0
    for d, text in rows:
        left = got[d].text.split("\n")
        assert all(x in seen for x in text.split("\n") if x not in left)
        gone += got[d].removed_words
        seen.update(text.split("\n"))
        last = text.split("\n")[-1].split()
        if text in exact and len(text.split()) >= 30 and len(last) >= 6:  # an exact copy keeps nothing
            assert got[d].text == "" and got[d].removed_words == len(text.split())
        exact.setdefault(text, d)
    assert gone > 500


def test_many_tasks_give_the_same(spark):
    rng = random.Random(7)
    shared = " ".join(sentence(rng, 10) for _ in range(4))
    rows = [(d, f"{sentence(rng, 8)} {shared} {sentence(rng, 9)}") for d in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        many = {d: r.text for d, r in run(spark, rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many == {d: r.text for d, r in run(spark, rows).items()}
    assert sum(shared in t for t in many.values()) == 1 and shared in many[0]


def test_odd_rows_and_columns(spark):
    text = "one two three four five six seven\neight nine ten eleven twelve thirteen fourteen fifteen\n" * 3
    rows = [(1, text, "a", 5), (1, text, "a", 5), (None, text, None, None), (2, None, "b", 1), (3, "", "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, removed_words int")
    got = sorted(ld.line_dedup(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.text for r in got] == [text, text, None, "", got[4].text]
    assert got[4].doc_id is None and len(got[4].text) < len(text)
    assert ld.line_dedup(docs.limit(0)).count() == 0
    assert ld.line_dedup(docs).columns == ["doc_id", "text", "h", "removed_words"]


def test_lines_seen_elsewhere_do_not_cut_a_passage(spark):
    rng = random.Random(8)
    for size, n in ((12, 5), (10, 5), (7, 8)):  # 60, 50 and 56 words
        passage = [sentence(rng, size) for _ in range(n)]
        own = {d: sentence(rng, 15) for d in range(1, 40)}
        rows = [(d, own[d] + "\n" + passage[d % n]) for d in range(1, 30)]  # each line is frequent, and owned by another
        rows += [(d, "\n".join([own[d], *passage])) for d in range(30, 40)]
        got = run(spark, rows)
        assert {d: got[d].text for d in range(1, 31)} == dict(rows[:30])
        for d in range(31, 40):
            assert got[d].text.split() == own[d].split() and got[d].removed_words == size * n


def test_reordered_and_repeated_passages_go(spark):
    rng = random.Random(9)
    p, q = ([sentence(rng, 12) for _ in range(5)] for _ in range(2))
    other, own = sentence(rng, 30), [sentence(rng, 15) for _ in range(7)]
    rows = [(1, [*p, own[0], *q, other]), (2, [*q, own[1], *p]), (3, [own[2], *p, own[3], *p, own[4]]), (4, [*p, own[5], other, own[6], *p])]
    got = run(spark, [(d, "\n".join(lines)) for d, lines in rows])
    assert got[1].removed_words == 0
    assert [got[d].removed_words for d in (2, 3, 4)] == [120, 120, 150]
    for d, kept in ((2, own[1:2]), (3, own[2:5]), (4, own[5:])):
        assert got[d].text.split() == " ".join(kept).split()


def patience(a, b):
    """Pairs of equal lines by patience diff: lines unique in both anchor it, the stretches between
    them are aligned alike, and blocks grow where no line is unique."""
    if not a or not b:
        return []
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    if head:
        return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in patience(a[head:], b[head:])]
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    anchors = [(a.index(x), b.index(x)) for x in once]
    best, back = [1] * len(anchors), [-1] * len(anchors)
    for i in range(len(anchors)):
        for j in range(i):
            if anchors[j][1] < anchors[i][1] and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    run, k = [], max(range(len(anchors)), key=lambda k: best[k]) if anchors else -1
    while k >= 0:
        run.append(anchors[k])
        k = back[k]
    if not run:
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for x, y in run[::-1]:
        out += [(i + p, j + q) for p, q in patience(a[i:x], b[j:y])] + [(x, y)]
        i, j = x + 1, y + 1
    return out + [(i + p, j + q) for p, q in patience(a[i:], b[j:])]


def blocks(pairs):
    """Runs of pairs that go on in both documents."""
    runs = []
    for i, j in pairs:
        if runs and runs[-1][-1] == (i - 1, j - 1):
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    return runs


def plain_passages(lines, least=20):
    """(first line, line after it, lines) of the shortest run of 20 words from each line on."""
    out = []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            if sum(len(x.split()) for x in lines[i:j]) >= least:
                out.append((i, j, tuple(lines[i:j])))
                break
    return out


def plain_gone(docs):
    """Lines that go from each document: pairs with the first holders of its passages, each aligned."""
    first, gone = {}, {}
    for d, lines in sorted(docs.items()):
        own = plain_passages(lines)
        places = {}
        for i, _, key in own:
            places.setdefault(key, []).append(i)
        pairs, seen = {}, {}
        for i, _, key in own:
            if key in first:
                e, there = first[key]
                nth = seen[key] = seen.get(key, -1) + 1
                pairs.setdefault(e, []).append((i, there[min(nth, len(there) - 1)], len(there) == 1))
        gone[d] = set()
        ends = {i: j for i, j, _ in own}
        once = {i: len(places[key]) == 1 for i, _, key in own}
        for entries in pairs.values():
            for i in ld.aligned(once, ends, entries):
                gone[d] |= set(range(i, ends[i]))
        for key, there in places.items():
            first.setdefault(key, (d, there))
    return gone


def test_alignment_of_all_pairs_decides(spark):
    """What goes is what the alignment of each pair keeps. Recall: nearly every line that a patience diff
    with any earlier document aligns in a block of 20 words is gone. Precision: every line that is gone
    lies in a run of 20 words that some earlier document holds; not every such line goes."""
    rng = random.Random(10)
    pool = [sentence(rng, n) for n in [12] * 30 + [7] * 30 + [25] * 10]
    docs = {1: [pool[0], sentence(rng, 8)], 2: [pool[1], sentence(rng, 8)], 3: pool[:2], 4: pool[:2]}  # no single line ties 4 to 3
    for d in range(5, 130):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(pool) - 8)
            lines += [sentence(rng, 9)] * rng.randrange(2) + pool[at : at + rng.randrange(1, 7)]
        docs[d] = lines
    size = lambda lines: sum(len(x.split()) for x in lines)
    got = run(spark, [(d, "\n".join(lines)) for d, lines in docs.items()])
    gone = plain_gone(docs)
    n_must = n_gone = n_may = found = 0
    for d, lines in docs.items():
        left = [x for k, x in enumerate(lines) if k not in gone[d]]
        assert got[d].text.split() == " ".join(left).split(), d
        must, may = set(), set()
        for e in range(1, d):
            for block in blocks(patience(lines, docs[e])):
                if size(lines[i] for i, _ in block) >= 20:
                    must |= {i for i, _ in block}
            for i in range(len(lines)):
                for j in range(len(docs[e])):
                    n = 0
                    while i + n < len(lines) and j + n < len(docs[e]) and lines[i + n] == docs[e][j + n]:
                        n += 1
                    if size(lines[i : i + n]) >= 20:
                        may |= set(range(i, i + n))
        assert gone[d] <= may
        found, n_must, n_gone, n_may = found + len(must & gone[d]), n_must + len(must), n_gone + len(gone[d]), n_may + len(may)
    assert n_must > 300 and found >= 0.98 * n_must and 0.95 * n_may <= n_gone < n_may


def test_alignment_keeps_each_line_once():
    ends = {k: k + 2 for k in range(20)}
    once = dict.fromkeys(ends, True)
    straight = [(k, k + 5, True) for k in range(6)]
    assert ld.aligned(once, ends, straight) == [0, 1, 2, 3, 4, 5]
    # The passage at 6 shares line 6 with the one at 5, but lies elsewhere in the owner: it is not aligned.
    assert ld.aligned(once, ends, [*straight, (6, 40, True)]) == [0, 1, 2, 3, 4, 5]
    assert ld.aligned(once, ends, [*straight, (7, 40, True)]) == [0, 1, 2, 3, 4, 5, 7]  # behind it, it is
    # The run of anchors begins at 3, whose line 4 the passage at 4 would align again; then what moved before it, but not line 3.
    moved = [(k, k + 30, True) for k in range(3)] + [(3, 0, True)] + [(k, k + 5, True) for k in range(4, 12)]
    assert ld.aligned(once, ends, moved) == [0, 1, 3, *range(5, 12)]
    # Grown over passages that occur more than once in either document.
    repeated = [(k, k, k not in (2, 3)) for k in range(6)]
    assert ld.aligned({k: k not in (2, 3) for k in ends}, ends, repeated) == [0, 1, 2, 3, 4, 5]
    everything = sorted(e[0] for e in moved)
    assert ld.aligned(once, ends, moved) != everything


def test_very_long_and_repeated_rows(spark):
    rng = random.Random(11)
    passage = [sentence(rng, 30) for _ in range(4)]
    long = [sentence(rng, 10) for _ in range(20_000)]
    rows = [(1, "\n".join(passage)), (2, "\n".join([*long[:10_000], *passage, *long[10_000:]])), (2, "\n".join([passage[0], "x."])), (3, "\n".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.removed_words) for r in ld.line_dedup(docs).collect()}
    assert got == {(1, 0), (2, 120), (2, 30), (3, 200_000)}
