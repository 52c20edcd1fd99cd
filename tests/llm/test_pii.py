import hashlib
import math
import random
import re
from functools import cache

from pyspark.sql import functions as F

from palimpsest.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@cache
def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end(), m[0]))
    return sorted(out)


@cache
def masked(text):
    return re.sub(PLAIN["email"], lambda m: " " * len(m[0]), text)


def terms(docs):
    """All disclosing terms of (id, text) rows by plain counting."""
    total = len(docs)
    held, mention = {}, {}
    for i, text in set(docs):
        text = text or ""
        for m in re.finditer(r"[^\W\d_]+", masked(text)):
            held.setdefault(m[0].lower(), {}).setdefault((i, text), []).append(m.span())
        for _, _, kind, _, value in base(text):
            entity = (kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            mention.setdefault(entity, set()).add((i, text))
    out = set()
    for w, where in held.items():
        for own in mention.values():
            both = own & set(where)
            content = math.log2(total / len(own))
            if len(both) >= 2 and content > 0:
                shared = math.log2(total * len(both) / (len(where) * len(own)))
                if min(1, shared / content) >= 0.8:
                    out |= {(i, text, s, e) for i, text in both for s, e in where[i, text]}
    return out


def check(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    extra = {}
    for i, text, s, e in terms(docs):
        extra.setdefault((i, text), set()).add((s, 5, "term", e))
    text_of = dict(docs)
    for r in pii.find(frame).collect():
        text = text_of[r.doc_id] or ""
        own = base(text)
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(b[2] == k for b in own)
        told = ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in own)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        every = sorted([b[:4] for b in own] + list(extra.get((r.doc_id, text), ())))
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in every), text
    return extra


def test_spans_equal_plain_patterns_and_counts(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "a@b.c_x@d.e", "x.y+z@mail-7.example.com.", "@a.b", "a@b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.2.3.4",
            "4111111111111111", "4111 1111-1111 1111", "4111  1111", "+1 (743) 555-3824", "+1-2", "+12345678901234567890", "é", "ß", "😀",
            "+1 (743) 555-3824 ", "98.7.6.5", "token", "der", "Émile"]
    docs = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", "\n", "-", ".", "x"]) for _ in range(rng.randrange(12)))) for k in range(150)]
    people = [(f"p{k}@x.org", f"Name{chr(97 + k)}") for k in range(6)]
    for k in range(60):
        mail, name = rng.choice(people)
        filler = " ".join(rng.choice(["und", "der", "die", "das"]) for _ in range(rng.randrange(40)))
        docs.append((1000 + k, f"{filler} {name} wrote {mail} and {filler} {rng.choice(people)[1]}"))
    docs += [(5000, None), (5001, ""), (5002, "a." * 20000), (5003, "7" * 30000), (5004, "x" * 15000 + "@"), (5005, "a@" + "b." * 5000 + "c")]
    extra = check(spark, docs)
    assert sum(len(v) for v in extra.values()) > 30


def test_terms_far_from_the_value_are_found(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["und", "der", "die", "das", "wer"]) for _ in range(n))
    docs = [(k, f"Zorbina {filler(200)} write to z@hidden.org or {filler(50)}\nZORBINA {filler(k)}") for k in range(6)]
    docs += [(10, f"{filler(20)} Zorbina alone")] + [(100 + k, filler(60)) for k in range(60)]
    check(spark, docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert all(got[k].spans.startswith("term:0:7,") and got[k].n_terms >= 2 for k in range(6))
    assert got[10].n_terms == 0  # no mention there
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert all("zorbina" not in clean[k].lower() and "z@hidden" not in clean[k] for k in range(6))


def test_rarer_disclosure_keeps_more_of_a_term(spark):
    for others, left in ((4, "[TERM]"), (8, "Q[TERM]")):
        rows = [(k, f"Quill{'' if k else 'a'} wrote a@b.org") for k in range(8)] + [(20 + k, "Quill was here, others write") for k in range(others)]
        rows += [(100 + k, "plain wrote words") for k in range(2002 - others)]
        clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 30").collect()}
        assert clean[3] == f"{left} wrote [EMAIL]" and clean[20] == "Quill was here, others write"


def test_sanitised_texts_hold_no_base_match(spark):
    rows = [(k, f"é Zed{k % 2} writes x{k % 2}@y.org from 10.0.0.{k % 2} or +1 (743) 555-3824", "k") for k in range(8)]
    rows += [(100 + k, f"é plain text number {k} of others", "v") for k in range(60)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("key", F.lit(1))
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    for r in got.where("doc_id < 100").collect():
        assert not base(r.text) and r.text.count("[EMAIL]") == 1 and r.text.startswith("é ")
        assert "Zed" not in r.text
    assert pii.find(docs.limit(0)).count() == 0
