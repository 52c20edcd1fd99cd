"""Vectorised word and shingle hashes over Arrow string columns.

A word is a maximal run of bytes other than space and U+0009 to U+000D, with A-Z lower-cased; UTF-8
never uses those bytes inside a character, so bytes and code points give the same words. Hashes are
64 bits wide and stand for the words: two different shingles of one comparison share a hash with a
probability of about 1 in 10^19.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_BASE = int(_random.integers(1, 2**62)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text hashed at a time; a longer text is hashed whole, on its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base, and of its inverse, as 64-bit integers."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BACK)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers


def string_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, prefixes: list[int] | None = None, places: bool = False
):
    """Hashes of the words of consecutive texts, and for each text where its words begin and end.

    ``space``: the bytes that separate words. With ``prefixes``, a list of hashes by prefix length
    in bytes (0: the whole word), which are 0 where a word is shorter. With ``places``, also where
    each word begins and ends, in bytes from the first text on.
    """
    low = offsets[0]
    text, starts_at = data[low : offsets[-1]], offsets - low
    n = len(text)
    if not n:
        none = np.zeros(0, np.uint64)
        bounds, nowhere = np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        hashes = [none for _ in prefixes] if prefixes else none
        return (hashes, bounds, nowhere, nowhere) if places else (hashes, bounds)
    inside = ~space[text]
    edge = np.zeros(n + 1, bool)
    edge[starts_at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    forth, back = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[text] * forth[:n], out=total[1:])
        if prefixes:
            hashes = []
            for k in prefixes:
                stop = np.minimum(begin + k, end) if k else end
                hashes.append(np.where(end - begin >= k, (total[stop] - total[begin]) * back[begin], U64(0)))
        else:
            hashes = mix((total[end] - total[begin]) * back[begin])
    bounds = np.searchsorted(begin, starts_at, "left")
    return (hashes, bounds, begin, end) if places else (hashes, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text, and each text's bounds in them.

    A text with words, but fewer than ``width``, has its whole sequence as its one shingle.
    """
    n = len(words)
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        if n >= width:
            runs = words[: n - width + 1] * _PLACE[0]
            for k in range(1, width):
                runs += words[k : n - width + 1 + k] * _PLACE[k]
            runs = mix(runs)
        else:
            runs = np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        keep = np.maximum(counts - width + 1, 0)
        out_bounds = np.zeros(len(bounds), np.int64)
        lengths = keep.copy()
        lengths[short] = 1
        np.cumsum(lengths, out=out_bounds[1:])
        out = np.empty(out_bounds[-1], np.uint64)
        full = np.flatnonzero(keep)
        if len(full):
            take = np.repeat(bounds[full] - out_bounds[full], keep[full]) + np.repeat(
                out_bounds[full], keep[full]
            ) + (np.arange(keep[full].sum()) - np.repeat(np.cumsum(keep[full]) - keep[full], keep[full]))
            put = take - np.repeat(bounds[full], keep[full]) + np.repeat(out_bounds[full], keep[full])
            out[put] = runs[take]
        for row in short:
            few = words[bounds[row] : bounds[row + 1]]
            out[out_bounds[row]] = mix((few * _PLACE[: len(few)]).sum(dtype=np.uint64) + U64(len(few)))
    return out, out_bounds


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    data, offsets = string_column(column)
    for first, last in slices(offsets):
        words, bounds = word_hashes(data, offsets[first : last + 1])
        shingles, at = shingle_hashes(words, bounds, width)
        for row in range(last - first):
            yield first + row, np.unique(shingles[at[row] : at[row + 1]])
