"""Alignment of two tokenizers' tokens over the same texts, and how often their ids meet in the corpus.

A is a byte-level BPE (a tokenizers file), B a BPE of pieces (a sentencepiece model). Both encode a
text with a space before it; B adds that space itself. The ends of the tokens, in bytes, are the keys
of one dictionary a side, from end to index. The keys that both have, in order, slice the two id lists
into groups; within each slice, the pairs of tokens that share bytes are its links.

Neither tokenizer joins characters across a border between a character that is not white space and a
space (A by its pre-token pattern, B if no piece of its vocabulary goes on with a space, which is
checked), so texts are cut into units there, each different unit is encoded and aligned once, and a
bounded table remembers it. With any other vocabulary a text is one unit.

1. Each task packs its documents into chunks of some million characters: per chunk its different id
   pairs with their numbers of links, its units as lists of these pairs, and its documents as lists of
   units. Chunks are written. A pair occurs once a chunk, so no pair is a hot key, however frequent.
2. The chunks' pairs are summed to the corpus-wide counts. The greatest count of each B id is
   broadcast: it has a row for each id of B's vocabulary at most.
3. Each chunk's pairs meet their counts and go back to their chunk, as large as the chunk was, whose
   documents add them up.

The tokenizers' files are read by the driver and broadcast; their sizes do not depend on the documents.

Defined cases: a null or empty text, or one that either side's tokens do not give back byte by byte
(such as one that holds U+2581), has no tokens, zeros and an empty digest; rows that repeat an id and
null ids are documents of their own; a text of any length is encoded whole, in a chunk of its own if it
is longer than one; strings of special tokens are plain text; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.token_counts import PATTERN
from palimpsest.session import ship, stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in a chunk: what a task holds at a time, as lists of numbers.
CHUNK_CHARS = 4_000_000
#: Different units that a worker remembers from chunk to chunk.
REMEMBERED = 1 << 17
#: Units that are aligned at a time.
BATCH = 20_000
#: From one character that is not white space and a space behind it to the next such place.
_UNIT = re.compile(r"\s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?")
_COMMON = "\u0530"
_LOW = (1 << 32) - 1


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both sides have, in order, and how many tokens of either side lie before each."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    number = lambda values: np.fromiter(values, np.int64, len(common))
    return number(common), number(map(at_a.__getitem__, common)), number(map(at_b.__getitem__, common))


def slice_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two lists of the tokens that share bytes: one pair for each stretch between two
    neighbouring ends of any side, none of which reaches beyond a slice."""
    stretches = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, stretches), np.searchsorted(ends_b, stretches)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: its own if that prints, else
    the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Places(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key):
        self[key] = place = len(self)
        return place


class Pair:
    """Two tokenizers, given as the bytes of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        alphabet = _byte_alphabet()
        added = {k: t.content.encode() for k, t in self.a.get_added_tokens_decoder().items()}
        entries = {k: t for t, k in self.a.get_vocab().items()}
        self.bytes_a = {k: added.get(k) or bytes(alphabet[c] for c in t) for k, t in entries.items()}
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.bytes_b = {k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)}
        ranks = {self.bytes_a[k]: k for k in entries if k not in added}
        self.fast_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        levels = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        self.cuts = levels and all("▁" not in p.lstrip("▁") for p in pieces)
        self.length_a, self.length_b = (np.array([len(own.get(k, b"")) for k in range(max(own) + 1)]) for own in (self.bytes_a, self.bytes_b))
        digits_a, digits_b = ([str(k) for k in range(len(n))] for n in (self.length_a, self.length_b))
        #: An id of A before one of its group and before one of B; an id of B before one of its group, another group and another unit.
        self.shown = [d + mark for digits, marks in ((digits_a, ",|"), (digits_b, ",;\n")) for mark in marks for d in digits]
        #: Units by number; of each whether both sides give its bytes back, tokens of A, tokens of B and groups.
        self.places, self.counts = _Places(), np.zeros((0, 4), np.int64)
        #: Groups as they are shown; links as 64-bit numbers, with an id of A in the high half and one of B in the low half.
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.seen = np.zeros(0, np.int64)

    def note(self, times: np.ndarray) -> None:
        """Add up how often each unit occurs. If there are many, the frequent half of them stays."""
        self.seen = times + np.pad(self.seen, (0, len(times) - len(self.seen)))
        if len(times) <= REMEMBERED and sum(map(len, self.groups)) <= 8 * CHUNK_CHARS:
            return
        kept = np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2]
        kept = np.sort(kept[(self.seen[kept] > 1) & (self.counts[kept, 1] <= 64)])
        names = list(self.places)
        self.places = _Places((names[k], n) for n, k in enumerate(kept.tolist()))
        self.groups, self.links = ([x[k] for k in kept.tolist()] for x in (self.groups, self.links))
        self.counts, self.seen = self.counts[kept], self.seen[kept]

    def cut(self, text: str) -> list[str]:
        """A text in units that both tokenizers encode each on its own, with the space before it that is
        left out here: where a space follows a character that is not white space."""
        if not self.cuts:
            return [text]
        plain = text.split(" ")
        if "" not in plain and not any(map(str.isspace, [u[-1] for u in plain])):
            return plain
        return [u[1:] for u in _UNIT.findall(f" {text}") if u]

    def settle(self) -> None:
        """Align the units that are new since the last time, many at a time."""
        new = [*islice(reversed(self.places), len(self.places) - len(self.groups))][::-1]
        parts = [self.counts]
        for few in range(0, len(new), BATCH):
            counts, groups, links = self.align(new[few : few + BATCH])
            parts.append(counts)
            self.groups += groups
            self.links += links
        self.counts = np.concatenate(parts)

    def ids_a(self, text: str) -> list[int]:
        """A's ids. Letters below _COMMON are classed alike by all versions of Unicode in use, so that the
        same vocabulary in a faster library gives the same ids for them."""
        if text.isascii() or max(text) < _COMMON:
            return self.fast_a.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[bytes]]:
        """Counts, groups and links of texts, with a space before each."""
        spaced = [f" {t}" for t in texts]
        all_a, all_b = list(map(self.ids_a, spaced)), self.b.encode(texts, num_threads=1)
        data = [t.encode() for t in spaced]
        found = self._aligned(all_a, all_b, data)
        if found is None:  # some text is not given back
            joined = lambda ids, own: b"".join(map(own.__getitem__, ids))
            whole = [joined(a, self.bytes_a) == joined(b, self.bytes_b) == t for t, a, b in zip(data, all_a, all_b, strict=True)]
            counts, groups, links = self._aligned(*([x for x, good in zip(side, whole, strict=True) if good] for side in (all_a, all_b, data)))
            at = np.cumsum(whole)
            counts = np.where(np.array(whole)[:, None], np.concatenate([np.zeros((1, 4), np.int64), counts])[at], 0)
            groups = [groups[k - 1] if good else "" for k, good in zip(at.tolist(), whole, strict=True)]
            links = [links[k - 1] if good else b"" for k, good in zip(at.tolist(), whole, strict=True)]
            found = counts, groups, links
        return found

    def _aligned(self, all_a: list[list[int]], all_b: list[list[int]], data: list[bytes]) -> tuple[np.ndarray, list[str], list[bytes]] | None:
        """The alignments of texts as if they were one, as a text's end is an end of both sides; None unless
        both sides give each text's bytes."""
        if not data:
            return np.zeros((0, 4), np.int64), [], []
        size_a, size_b, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (all_a, all_b, data))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((all_a, size_a), (all_b, size_b)))
        ends_a, ends_b, ends_of = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum(size)
        last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        joined = lambda ids, own: b"".join(map(own.__getitem__, ids.tolist()))
        if not (size_a.all() and size_b.all() and (ends_a[last_a] == ends_of).all() and (ends_b[last_b] == ends_of).all()):
            return None
        if not joined(a, self.bytes_a) == joined(b, self.bytes_b) == b"".join(data):
            return None
        ends, until_a, until_b = slices(ends_a, ends_b)
        last = np.searchsorted(ends, ends_of)  # the last group of each text
        from_a, from_b = np.append(0, until_a[:-1]), np.append(0, until_b[:-1])
        # Ids as they are shown, A's of a group before B's of it.
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[until_a - 1], mark_b[until_b - 1], mark_b[until_b[last] - 1] = 1, 1, 2
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(from_b, until_a - from_a)] = mark_a * len(self.length_a) + a
        codes[np.arange(len(b)) + np.repeat(until_a, until_b - from_b)] = (2 * len(self.length_a)) + mark_b * len(self.length_b) + b
        groups = "".join(map(self.shown.__getitem__, codes.tolist())).split("\n")[:-1]
        n_groups = np.diff(last, prepend=-1)
        i, j = slice_links(ends_a, ends_b)
        links, at = (a[i] << 32 | b[j]).tobytes(), (8 * np.cumsum(size_a + size_b - n_groups)).tolist()
        cut = [links[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]
        return np.stack([np.ones(len(data), np.int64), size_a, size_b, n_groups], axis=1), groups, cut


@cache
def tokenizer_pair(files: tuple[bytes, bytes]) -> Pair:
    return Pair(*files)


#: Documents and units of a chunk are one compressed Arrow batch, which Spark does not look into.
CHUNK = "chunk long, pair array<long>, times array<long>, docs binary"
_COMPRESSED = pa.ipc.IpcWriteOptions(compression="zstd")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths, each as the one row of a column."""
    rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch, sink = pa.record_batch(rows, list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_COMPRESSED) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Buffer) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(data) as stream:
        batch = stream.read_next_batch()
    return {name: batch.column(k)[0].values for k, name in enumerate(batch.schema.names)}


class _Chunk:
    """Documents of one chunk; a unit is a list of pairs, and a document one of units."""

    def __init__(self, pair: Pair):
        self.pair, self.chars = pair, 0
        self.ids: list[int | None] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        self.chars += len(text)
        self.ids.append(doc_id)
        self.docs.append(np.array(list(map(self.pair.places.__getitem__, self.pair.cut(text))) if text else [], np.int32))

    def batch(self, number: int) -> pa.RecordBatch:
        pair = self.pair
        pair.settle()
        broken, groups = pair.counts[:, 0] == 0, pair.groups
        docs = [d if not broken[d].any() else d[:0] for d in self.docs]
        digests = [hashlib.sha256(";".join(map(groups.__getitem__, d.tolist())).encode()).hexdigest() if len(d) else "" for d in docs]
        bounds = lambda lengths: np.append(0, np.cumsum(lengths))
        flat, at = np.concatenate(docs), bounds([len(d) for d in docs])
        listed = [np.unique(d, return_counts=True) for d in docs]
        doc_unit, doc_times = (np.concatenate([x[k] for x in listed]) for k in range(2))
        times_of = np.bincount(flat, minlength=len(groups))
        used = np.flatnonzero(times_of)
        links = [pair.links[k] for k in used.tolist()]
        ids, unit_pair = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        sizes = np.fromiter(map(len, links), np.int64, len(links)) // 8
        times = np.bincount(unit_pair, np.repeat(times_of[used], sizes), len(ids)).astype(np.int64)
        n_a, n_b, n_groups = (pa.array(np.diff(bounds(pair.counts[flat, k])[at])) for k in (1, 2, 3))
        small = lambda values: pa.array(np.asarray(values, np.int32))
        docs = _packed(
            {
                "doc_id": pa.array(self.ids, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": pa.array(digests, pa.string()),
                "unit_size": small(sizes), "unit_pair": small(unit_pair), "doc_size": small([len(x[0]) for x in listed]),
                "doc_step": small(np.diff(np.searchsorted(used, doc_unit), prepend=0)), "doc_times": small(doc_times),
            }
        )
        pair.note(times_of)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids, times)]
        return pa.record_batch([pa.array([number], pa.int64()), *lists, pa.array([docs], pa.binary())], ["chunk", "pair", "times", "docs"])


def _chunks(files: Broadcast, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(files.value)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk(pair)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, text.as_py() or "")
                if chunk.chars >= chars:
                    yield chunk.batch(number)
                    number, chunk = number + 1, _Chunk(pair)
        if chunk.ids:
            yield chunk.batch(number)

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the chunks (n_pairs, docs, found) with their pairs' counts summed."""
    before = lambda values: np.append(0, np.cumsum(values))
    for batch in batches:
        for n_pairs, docs, found in zip(*batch.columns, strict=True):
            own = _unpacked(docs.as_buffer())
            number = {k: v.to_numpy() for k, v in own.items() if k not in ("doc_id", "groups_sha256")}
            count = np.zeros((2, n_pairs.as_py()), np.int64)
            if found.is_valid:
                pos, *values = (found.values.field(k).to_numpy() for k in range(3))
                count[:, pos] = values
            sums = []
            for values in count:
                unit = np.diff(before(values[number["unit_pair"]])[before(number["unit_size"])])
                doc = before(unit[np.cumsum(number["doc_step"])] * number["doc_times"])
                sums.append(np.diff(doc[before(number["doc_size"])]))
            n_a, n_b, n_groups = (number[k] for k in ("n_a", "n_b", "n_groups"))
            yield pa.record_batch(
                {
                    "doc_id": own["doc_id"], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
                    "n_best": sums[1], "count_sum": sums[0], "groups_sha256": own["groups_sha256"],
                }
            )


def _files(byte_bpe: str, piece_bpe: str) -> tuple[bytes, bytes]:
    read = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as file:
            read.append(file.read())
    return read[0], read[1]


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (id of A in the high half, id of B in the low one) and how many links hold it, corpus-wide."""
    each = chunks.select(F.explode(F.arrays_zip("pair", "times")).alias("e"))
    return each.groupBy(F.col("e.pair").alias("pair")).agg(F.sum("e.times").alias("count")).where("count > 0")


def align_tokenizers(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts the links whose pair is no rarer than any other pair with their B id, and count_sum
    adds up the pairs' counts over the links.
    """
    ship(docs.sparkSession)
    files = docs.sparkSession.sparkContext.broadcast(_files(byte_bpe, piece_bpe))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = stored(texts.mapInArrow(_chunks(files, chunk_chars), CHUNK), "token-chunks")
    files.destroy()
    counts = stored(pair_counts(chunks), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(_LOW))
    most = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most")))
    asked = chunks.select("chunk", F.posexplode("pair").alias("pos", "pair"))
    found = asked.join(counts, "pair").join(most, "b")
    answer = F.struct("pos", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    answers = found.groupBy("chunk").agg(F.collect_list(answer).alias("found"))
    return chunks.select("chunk", F.size("pair").alias("n_pairs"), "docs").join(answers, "chunk", "left").select("n_pairs", "docs", "found").mapInArrow(
        _scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
