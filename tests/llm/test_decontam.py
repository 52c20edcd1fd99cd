import random

from palimpsest.llm import decontam


def shingles(text, width):
    seq = (text or "").encode().lower().split()
    return {tuple(seq[k : k + width]) for k in range(len(seq) - width + 1)}


def brute(docs, items, width, percent):
    out = set()
    for item, text in items:
        w = min(width, len((text or "").encode().lower().split()))
        want = shingles(text, w) if w else set()
        for doc, body in docs:
            shared = len(want & shingles(body, w)) if w else 0
            if want and 100 * shared >= percent * len(want):
                out.add((doc, item, len(want), shared))
    return out


def test_matches_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 20, 40, 60, 150, 400])]
    items += [(100, None), (101, " \n "), (102, items[6][1])]
    docs = []
    for d in range(120):
        seq = [word() for _ in range(rng.choice([0, 2, 30, 900]))]
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items)[1]
            part = (part or "").upper().split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(seq) + 1)
            seq[at:at] = part
        docs.append((d, rng.choice([" ", "\n"]).join(seq)))
    docs.append((500, None))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items, 5, 80)
    assert len(expected) > 40
    for block in (decontam.BLOCK_SHINGLES, 150):
        monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
        got = {tuple(r)[:4] for r in decontam.contained_items(d, i).collect()}
        assert got == expected
    clean = {r.doc_id for r in decontam.without_contaminated(d, i).collect()}
    assert clean == {x for x, _ in docs} - {e[0] for e in expected}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(d, none).count() == 0
    assert decontam.without_contaminated(d, none).count() == 1
    assert decontam.contained_items(d.limit(0), none).count() == 0
