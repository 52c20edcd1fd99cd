"""Edit-aware token counts: one segment tree per document, updated where edits touch it.

A byte-level BPE splits a text into pre-tokens and encodes each on its own, so counts of segments
that begin and end at pre-token borders add up. No pre-token goes on from a character that is not
white space to one that is, from a letter, a digit or another sign to one of another of these kinds
(but from an apostrophe to a letter), whatever else the text holds; such a border lives as long as
the two characters beside it do. Segments are cut there, about ``SEGMENT`` code points apart. A
document's tree holds the code points and tokens of its segments as leaves and their sums above, in
heap order in two arrays.

An edit is located by descending the sums. The segments that it touches, and the neighbour whose
border characters it changes, are re-encoded together and their leaves and ancestors updated; all
other segments are neither read nor encoded again. The result equals encoding the new text whole.

Edits (doc_id, first, last, replacement) give code-point ranges of the old text that do not overlap;
they may come in any number and are applied from the last to the first. Documents, trees and edits
meet by document: one shuffle, no group larger than a document.

The vocabulary's file is read by the driver alone and broadcast: its size is that of the file,
whatever the documents. A worker counts the pre-tokens of common scripts once each, in a bounded
table.

Defined cases: a null text counts as empty, with one empty segment; a text without any border, such
as a long word, is one segment; ranges are cut to the text; of edits that overlap, the later-starting
ones go first and an edit is cut where the next begins; edits of unknown documents are ignored; rows
that repeat an id are joined by id and text; a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import ship, stored

SEGMENT = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_BORDER = regex.compile(
    r"(?<=\S)(?=[ \t\r\n])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
    r"|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
)
#: Letters below this code point are classed alike in all versions of Unicode in use.
_COMMON = 0x0530
#: Different pre-tokens that a worker remembers.
REMEMBERED = 1 << 18


class Counter:
    """Counts tokens by one vocabulary, given as the bytes of its file."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pre_tokens = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text.isascii() and max(text) >= chr(_COMMON):
            return len(self.encoding.encode_ordinary(text))
        total, known = 0, self.known
        for part in self.pre_tokens(text):
            n = known.get(part)
            if n is None:
                n = len(self.encoding.encode_ordinary(part))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(part) <= 64:
                    known[part] = n
            total += n
        return total


@cache
def counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


@cache
def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text that is encoded whole."""
    return len(counter(read_vocabulary(path)).encoding.encode_ordinary(text))


def cut(text: str, segment: int = SEGMENT) -> list[int]:
    """Where segments end: at the first border from ``segment`` code points on."""
    ends, at, n = [], 0, len(text)
    while n - at > segment:
        found = _BORDER.search(text, at + segment)
        if not found:
            break
        at = found.start()
        ends.append(at)
    return [*ends, n]


class Tree:
    """Sums of code points and tokens in heap order: the root at 1, leaves from ``size`` on."""

    def __init__(self, chars, tokens):
        self.chars, self.tokens = np.array(chars, np.int64), np.array(tokens, np.int64)
        self.size = len(self.chars) // 2

    @classmethod
    def build(cls, text: str, counts: Counter, segment: int = SEGMENT) -> Tree:
        ends = cut(text, segment)
        size = 1 << (len(ends) - 1).bit_length()
        tree = cls(np.zeros(2 * size), np.zeros(2 * size))
        starts = [0, *ends[:-1]]
        tree.chars[size : size + len(ends)] = np.diff([0, *ends])
        tree.tokens[size : size + len(ends)] = [counts.count(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        for k in range(size - 1, 0, -1):
            tree.chars[k] = tree.chars[2 * k] + tree.chars[2 * k + 1]
            tree.tokens[k] = tree.tokens[2 * k] + tree.tokens[2 * k + 1]
        return tree

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position (the last one with text, for the end), and where it starts."""
        node, start = 1, 0
        position = min(position, max(int(self.chars[1]) - 1, 0))
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, first: int, last: int, replacement: str, counts: Counter) -> tuple[str, int]:
        """Apply one edit to the tree and the text that it counts; also the code points re-encoded."""
        n = len(text)
        low, begin = self.leaf_at(max(first - 1, 0))  # a border before the edit needs the character after it ...
        high, start = self.leaf_at(min(last, n))  # ... and one behind it the character before it
        end = start + int(self.chars[self.size + high])
        region = text[begin:first] + replacement + text[last:end]
        self.put(low, len(region), counts.count(region))
        for leaf in range(low + 1, high + 1):
            if self.chars[self.size + leaf] or self.tokens[self.size + leaf]:
                self.put(leaf, 0, 0)
        return text[:begin] + region + text[end:], len(region)


def _trees(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary.value)
        for batch in batches:
            built = [Tree.build(t or "", counts) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "key": batch.column(1),
                    "chars": pa.array([t.chars for t in built], pa.list_(pa.int32())),
                    "tokens": pa.array([t.tokens for t in built], pa.list_(pa.int32())),
                }
            )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _sent(docs: DataFrame, path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def build_trees(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), chars, tokens: the trees, to be kept as a table."""
    ship(docs.sparkSession)
    return _keyed(docs, id_col, text_col).mapInArrow(_trees(_sent(docs, path)), "doc_id long, key long, chars array<int>, tokens array<int>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which is what the shuffle then moves."""
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(1), "packed": packed})


def _recount(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary.value)
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            before, after, again, size = [], [], [], []
            for packed, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns[1:5]), strict=True):
                text = expand(packed).decode()
                tree, encoded, limit = Tree(chars, tokens), 0, len(text)
                before.append(int(tree.tokens[1]))
                for e in sorted(edits or [], key=lambda e: (e["first"], e["last"], e["replacement"] or ""), reverse=True):
                    first = min(max(e["first"], 0), limit)
                    last = min(max(e["last"], first), limit)
                    text, n = tree.edit(text, first, last, e["replacement"] or "", counts)
                    encoded, limit = encoded + n, first
                after.append(int(tree.tokens[1]))
                size.append(len(text))
                again.append(encoded)
            columns = {"tokens_before": before, "tokens_after": after, "chars_after": size, "chars_encoded": again}
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


def recount(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, tokens_before, tokens_after, chars_after, chars_encoded for every document."""
    edit = F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("replacement"))
    per = edits.where("first IS NOT NULL AND last IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_edited")).agg(
        F.collect_list(edit).alias("edits")
    )
    # Rows that repeat an id and a text have one tree. Trees meet edits first, so that texts are shuffled once.
    trees = trees.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "chars", "tokens").dropDuplicates(["_id", "_key"])
    trees = trees.join(per, F.col("_id") == F.col("_edited"), "left")
    texts = _keyed(docs, id_col, text_col).mapInArrow(_pack, "doc_id long, key long, packed binary")
    met = texts.join(trees, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return met.select("doc_id", "packed", "chars", "tokens", "edits").mapInArrow(
        _recount(_sent(docs, path)), "doc_id long, tokens_before long, tokens_after long, chars_after long, chars_encoded long"
    )


def edit_aware_counts(docs: DataFrame, edits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Build the trees, keep them as a table, and recount after the edits."""
    return recount(docs, stored(build_trees(docs, path), "token-trees"), edits, path)
