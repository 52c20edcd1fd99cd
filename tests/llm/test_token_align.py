import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import token_align as ta

A = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PAIR = ta.Pair(*ta._files(ta.BYTE_BPE, ta.PIECE_BPE))
TEXT = st.text(alphabet="abst é1.,'!\n\t  \xa0漢、́\x1c　😀٣▁<", max_size=40)


def _bytes_a(k):
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
    return bytes(table[c] for c in A.id_to_token(k))


def _bytes_b(k):
    piece = B.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(k) else piece.replace("▁", " ").encode()


def _encoded(text):
    if not text:
        return None
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    own_a, own_b = [_bytes_a(k) for k in a], [_bytes_b(k) for k in b]
    if not b"".join(own_a) == b"".join(own_b) == f" {text}".encode():
        return None
    span = lambda own: [(sum(map(len, own[:k])), sum(map(len, own[: k + 1]))) for k in range(len(own))]
    span_a, span_b = span(own_a), span(own_b)
    links = [(a[i], b[j]) for i, (p, q) in enumerate(span_a) for j, (r, s) in enumerate(span_b) if max(p, r) < min(q, s)]
    groups, cut = [], 0
    for end in sorted({q for _, q in span_a} & {s for _, s in span_b}):
        own = [",".join(str(k) for k, (p, q) in zip(ids, spans, strict=True) if cut <= p and q <= end) for ids, spans in ((a, span_a), (b, span_b))]
        groups.append("|".join(own))
        cut = end
    return len(a), len(b), groups, links


def brute(rows):
    found = [(i, _encoded(t)) for i, t in rows]
    count = Counter(x for _, e in found if e for x in e[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, e in found:
        if e is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[x] == most[x[1]] for x in e[3])
            digest = hashlib.sha256(";".join(e[2]).encode()).hexdigest()
            out.append((i, e[0], e[1], len(e[2]), len(e[3]), best, sum(count[x] for x in e[3]), digest))
    return sorted(out, key=repr)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_units_are_encoded_like_the_whole_text(text):
    units = PAIR.cut(text)
    assert "".join(f" {u}" for u in units) == f" {text}"
    whole_counts, [groups], [links] = PAIR.align([text])
    counts, parts, part_links = PAIR.align(units)
    assert PAIR.ids_a(f" {text}") == A.encode(f" {text}", add_special_tokens=False).ids
    if counts[:, 0].all():
        assert groups == ";".join(parts) and links == b"".join(part_links)
        assert whole_counts[0, 1:].tolist() == counts[:, 1:].sum(axis=0).tolist()
    else:
        assert not whole_counts.any() and groups == "" and links == b""


@pytest.mark.parametrize("chars", [4_000_000, 300])
def test_documents_equal_brute_force(spark, chars):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    rows = [(k, rng.choice([" ", "  ", "\n", " \t"]).join(word() for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    rows += [(0, rows[0][1]), (None, "a b"), (70, None), (71, ""), (72, " "), (73, "a▁b"), (74, "<|endoftext|> <s> </s>"), (75, "漢字 😀 " * 5), (76, " a  b "), (77, "b" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "pair": F.lit(2), "found": F.lit(3)}).repartition(3)
    got = ta.align_tokenizers(docs, chunk_chars=chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_very_long_texts_and_none(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["the", "one", "ñandú", "x1"]) for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "漢" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in ta.align_tokenizers(docs).collect()}
    assert (got[1].n_a, got[1].n_b) == (len(A.encode(f" {text}", add_special_tokens=False).ids), len(B.encode(text)))
    assert got[1].n_links == got[1].n_a + got[1].n_b - got[1].n_groups and 0 < got[1].n_best <= got[1].n_links
    assert got[2].n_a > 0 and len(got[2].groups_sha256) == 64
    assert ta.align_tokenizers(docs.limit(0)).count() == 0


def test_a_pair_occurs_once_in_a_chunk(spark):
    """However frequent a pair of ids is, the shuffles get it once a chunk."""
    docs = spark.createDataFrame([(k, "the the the of") for k in range(200)], "doc_id long, text string").coalesce(1)
    files = spark.sparkContext.broadcast(ta._files(ta.BYTE_BPE, ta.PIECE_BPE))
    chunks = docs.mapInArrow(ta._chunks(files, 1000), ta.CHUNK).collect()
    assert len(chunks) == 3
    for c in chunks:
        assert len(c.pair) == len(set(c.pair)) == 2 and sum(c.times) == 4 * len(ta._unpacked(pa.py_buffer(c.docs))["doc_id"])
