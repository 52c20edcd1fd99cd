"""Distances, fuzzy text matching and assignments."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import stored

# The characters that stand for a hyphen at a line's end, and the rules of matching.
SOFT_HYPHENS = "­￾"
CONTAINED, COVERAGE = 0.65, 0.35
LEAST_SCORE, LEAST_MARGIN = 0.7, 0.05


def signature_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference; null if the signatures are empty or of different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


# --- texts for comparison --------------------------------------------------------------------

def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _plain(character: str) -> str:
    return unicodedata.normalize("NFKC", "-" if character in SOFT_HYPHENS else character).casefold()


def projections(values: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Texts for comparison, and where each of their characters begins and ends in the original.

    Soft hyphens become hyphens, all else its compatibility form, case folded; a run of white space
    becomes one space that reaches over the run, and goes at either end. The whole batch is one array
    of characters: each different character is looked up once.
    """
    points = _points("".join(values))
    length = np.array([len(v) for v in values], np.int64)
    begin = np.cumsum(length) - length
    alphabet, kind = np.unique(points, return_inverse=True)
    images = [_plain(chr(p)) for p in alphabet]
    letters, blanks = _points("".join(images)), np.array([c.isspace() for c in "".join(images)], bool)
    size = np.array([len(x) for x in images], np.int64)
    at = np.cumsum(size) - size
    n = size[kind]
    source = np.repeat(np.arange(len(points)), n)
    image = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[kind], n)
    owner = np.repeat(np.repeat(np.arange(len(values)), length), n)
    blank, last = blanks[image], source.copy()
    # Runs of white space: from one whose left neighbour is none, to one whose right neighbour is none.
    first_of_text = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    last_of_text = np.append(owner[1:] != owner[:-1], True)[-len(owner) :] if len(owner) else first_of_text
    opens = np.flatnonzero(blank & (first_of_text | ~np.append(False, blank[:-1])[: len(blank)]))
    closes = np.flatnonzero(blank & (last_of_text | ~np.append(blank[1:], False)[: len(blank)]))
    inner = ~first_of_text[opens] & ~last_of_text[closes]
    keep = ~blank
    keep[opens[inner]] = True
    last[opens[inner]] = source[closes[inner]]
    chosen = np.flatnonzero(keep)
    out = np.where(blank, np.uint32(32), letters[image])[chosen] if len(image) else np.zeros(0, np.uint32)
    starts, ends = source[chosen] - begin[owner[chosen]], last[chosen] + 1 - begin[owner[chosen]]
    bounds = np.searchsorted(owner[chosen], np.arange(len(values) + 1))
    text = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    cut = [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [text[c] for c in cut], [starts[c] for c in cut], [ends[c] for c in cut]


_INTS = T.ArrayType(T.IntegerType())
PROJECTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", _INTS), T.StructField("ends", _INTS)])


def _column(values: pd.Series) -> list[str]:
    return ["" if v is None else v for v in values]


@F.pandas_udf(PROJECTION)
def comparison_projection(values: pd.Series) -> pd.DataFrame:
    """``projections`` of a column; a null is an empty text."""
    texts, starts, ends = projections(_column(values))
    return pd.DataFrame({"text": texts, "starts": [x.astype(np.int32) for x in starts], "ends": [x.astype(np.int32) for x in ends]})


class _Plain(dict):
    """What each character becomes, by code point, found when it is first asked for."""

    def __missing__(self, point: int) -> str:
        self[point] = image = _plain(chr(point))
        return image


_PLAIN = _Plain()


@cache
def _unlike_lower() -> re.Pattern[str]:
    """Characters that may become anything but their lower case, among them all above the first planes' letters."""
    unlike = [c for c in map(chr, range(0x80, 0x3000)) if _plain(c) != c.lower() or len(c.lower()) > 1 or c == "Σ"]
    return re.compile(f"[{''.join(unlike)}\u3000-\U0010ffff]")


def _plainly(text: str) -> str:
    if text.isascii():
        return text.lower()
    unlike = set(_unlike_lower().findall(text))
    if unlike <= {"ß"}:
        return text.lower().replace("ß", "ss")
    return text.translate(_PLAIN)


def comparison_form(text: str) -> str:
    """The text of ``projections``, without where its characters come from."""
    return spaced(_plainly(text))


def spaced(plain: str) -> str:
    """A run of white space becomes one space, and goes at either end."""
    return " ".join(plain.split())


@F.pandas_udf(T.StringType())
def comparison_text(values: pd.Series) -> pd.Series:
    """``comparison_form`` of a column; a null is an empty text."""
    return pd.Series([comparison_form(v) for v in _column(values)], dtype=object)


def original_ranges(texts: list[str], at: list[int], size: list[int], tight: list[bool]) -> list[tuple[int, int]]:
    """Where so many characters of the comparison form from a place on (``tight``: of the form without
    spaces) lie in the original. No character becomes none, so a form that is as long as its text and
    has lost no white space has each character in its own place."""
    out: list[tuple[int, int]] = [(0, 0)] * len(texts)
    moved = []
    for k, text in enumerate(texts):
        plain = _plainly(text)
        if not tight[k] and len(text) == len(plain) == len(" ".join(plain.split())):
            out[k] = (at[k], at[k] + size[k])
        else:
            moved.append(k)
    forms, starts, ends = projections([texts[k] for k in moved])
    for k, form, start, end in zip(moved, forms, starts, ends, strict=True):
        if tight[k]:
            letters = _points(form) != 32
            start, end = start[letters], end[letters]
        out[k] = (int(start[at[k]]), int(end[at[k] + size[k] - 1]))
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_SPAN)
def original_span(texts: pd.Series, at: pd.Series, size: pd.Series, tight: pd.Series) -> pd.DataFrame:
    """``original_ranges`` of columns without nulls."""
    spans = original_ranges(texts.tolist(), at.tolist(), size.tolist(), tight.tolist())
    return pd.DataFrame(spans, columns=["start", "end"], dtype="int32")


@F.pandas_udf(_SPAN)
def unique_span(texts: pd.Series, sought: pd.Series) -> pd.DataFrame:
    """Original range of a text within another one by their comparison forms, null unless it occurs once."""
    rows, whole, at, size = [], [], [], []
    for k, (text, part) in enumerate(zip(_column(texts), _column(sought), strict=True)):
        form, needle = comparison_form(text), comparison_form(part)
        first = form.find(needle) if needle else -1
        if first >= 0 and form.find(needle, first + 1) < 0:
            rows.append(k), whole.append(text), at.append(first), size.append(len(needle))
    out = pd.DataFrame({c: pd.array([None] * len(texts), dtype="Int32") for c in ("start", "end")})
    spans = original_ranges(whole, at, size, [False] * len(rows))
    for c, values in zip(out.columns, zip(*spans, strict=True), strict=False):
        out.loc[rows, c] = values
    return out


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("first_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())]))
def comparison_ends(values: pd.Series) -> pd.DataFrame:
    """``comparison_form`` of a column, where its first character begins and its last one ends."""
    texts = _column(values)
    forms = [comparison_form(t) for t in texts]
    some = [k for k, f in enumerate(forms) if f]
    spans = original_ranges([texts[k] for k in some], [0] * len(some), [len(forms[k]) for k in some], [False] * len(some))
    out = pd.DataFrame({"text": forms, **{c: pd.array([None] * len(texts), dtype="Int32") for c in ("first_at", "end_at")}})
    for c, values in zip(out.columns[1:], zip(*spans, strict=True), strict=False):
        out.loc[some, c] = values
    return out


def only_at(text: Column, sought: Column) -> Column:
    """Where a text that is not empty begins in another one (from 0), null unless it occurs once."""
    first = F.call_function("locate", sought, text)
    once = (F.length(sought) > 0) & (first > 0) & (F.call_function("locate", sought, text, first + 1) == 0)
    return F.when(once, first - 1)


# --- texts within texts ----------------------------------------------------------------------

#: Texts from WINDOW + SPAN - 1 characters on are found by windows of WINDOW characters, the least by hash
#: of each SPAN in a row; shorter ones by windows of their own length.
WINDOW, SPAN = 6, 6
_FACTOR = 0x9E3779B97F4A7C15


def _window_hashes(text: str, n: int) -> np.ndarray:
    """Hashes of all runs of n characters."""
    points = _points(text).astype(np.uint64)
    if not 0 < n <= len(points):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(points) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = (total ^ (total >> np.uint64(29))) * np.uint64(_FACTOR) + points[k : len(points) - n + 1 + k]
        total = (total ^ (total >> np.uint64(32))) * np.uint64(_FACTOR)
    return total ^ (total >> np.uint64(29))


def chosen_windows(text: str) -> np.ndarray:
    """The least of each SPAN windows in a row: a text holds all that are chosen of a part of it."""
    hashes = _window_hashes(text, WINDOW)
    if len(hashes) < SPAN:
        return np.unique(hashes)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, SPAN).min(axis=1))


@F.pandas_udf(T.ArrayType(T.LongType()))
def windows_of(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Different windows of so many characters of each text; of size 0, the chosen ones."""
    found = [chosen_windows(t) if n == 0 else np.unique(_window_hashes(t, n)) for t, n in zip(texts, sizes, strict=True)]
    return pd.Series([x.view(np.int64) for x in found], dtype=object)


@F.pandas_udf(T.LongType())
def one_window(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    """A window of each text by which to look for it: the text itself, or the least of the chosen ones."""
    return pd.Series([int((chosen_windows(t) if n == 0 else _window_hashes(t, n)).view(np.int64)[0]) for t, n in zip(texts, sizes, strict=True)], dtype="int64")


#: Groups in which so many characters at most are to be looked through, once for each text sought, are met
#: row by row.
_DIRECT = 1 << 28


def containing(short: DataFrame, long: DataFrame, sought: str, text: str, on: list[str], keys: list[str], direct: int = _DIRECT) -> DataFrame:
    """Rows of ``short`` with those of ``long`` that are equal in ``on`` and whose ``text`` holds ``sought``.

    ``keys`` tell the rows of ``long`` apart within ``on``; else the two have no name in common. In small
    groups texts are looked through, which sends each of them once and nothing else. In groups that
    are more than ``direct`` to look through they are looked up by their windows, never pair by pair: one
    window of what is sought against all windows of that length, or, from some length on, against
    the chosen ones.
    """
    asked = short.where(F.length(sought) > 0)
    n = asked.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    work = long.groupBy(*on).agg(F.sum(F.length(text)).cast("double").alias("_m")).join(n, on)
    large = stored(work.where(F.col("_n") * F.col("_m") > direct).select(*on), "large-groups")
    holds = F.col(text).contains(F.col(sought))
    met = asked.join(large, on, "left_anti").join(long, on).where(holds)
    asked, long = asked.join(large, on, "left_semi"), long.join(large, on, "left_semi")
    asked = asked.withColumn("_size", F.when(F.length(sought) < WINDOW + SPAN - 1, F.length(sought)).otherwise(F.lit(0)))
    asked = asked.withColumn("_window", one_window(F.col(sought), F.col("_size")))
    sizes = asked.select(*on, "_size").distinct()
    shown = long.join(sizes, on).select(*on, *keys, "_size", F.explode(windows_of(F.col(text), F.col("_size"))).alias("_window"))
    looked_up = asked.join(shown, [*on, "_size", "_window"]).drop("_size", "_window").join(long, [*on, *keys]).where(holds)
    return met.unionByName(looked_up)


# --- similarity ------------------------------------------------------------------------------

def _longest_block(rows: list[int]) -> tuple[int, int, int]:
    """Length and last places of the longest diagonal of ones; of equal ones the first in rows, then in
    bits. Bit j of row i: whether character j of one text is character i of the other.

    Runs of twice the length come from runs that lie so far apart, so a few passes find the longest.
    """
    if not any(rows):
        return 0, 0, 0
    grown = lambda ends, runs, n: [0] * n + [(a << n) & b for a, b in zip(ends, runs[n:], strict=False)]
    doubled = [rows]
    while any(longer := grown(doubled[-1], doubled[-1], 1 << (len(doubled) - 1))):
        doubled.append(longer)
    best, length = doubled[-1], 1 << (len(doubled) - 1)
    for k in reversed(range(len(doubled) - 1)):
        if any(longer := grown(best, doubled[k], 1 << k)):
            best, length = longer, length + (1 << k)
    at = next(i for i, row in enumerate(best) if row)
    return length, at, (best[at] & -best[at]).bit_length() - 1


def matched_characters(a: str, b: str) -> int:
    """Characters in the longest common block, and in those of what lies before and behind it, and so
    on. Of blocks of the same length the first one in ``a`` counts, and there the first one in ``b``."""
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    rows = [places.get(c, 0) for c in a]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        window = (1 << b1) - (1 << b0)
        n, i, j = _longest_block([row & window for row in rows[a0:a1]])
        if n:
            total += n
            last = a0 + i + 1
            todo += [s for s in ((a0, last - n, b0, j + 1 - n), (last, a1, j + 1, b1)) if s[0] < s[1] and s[2] < s[3]]
    return total


def score(a: str, b: str) -> float:
    """Of two projected texts: 0 if one is empty, 1 if they are equal; for one within the other a
    fixed part and one by the share that it covers; else the share of matched characters."""
    if not (a and b):
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return CONTAINED + COVERAGE * len(short) / len(long)
    return 2 * matched_characters(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def projected_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``score`` of columns of projected texts."""
    return pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``score`` of columns of any texts."""
    left, right = (projections(_column(side))[0] for side in (a, b))
    return pd.Series([score(x, y) for x, y in zip(left, right, strict=True)], dtype=float)


def _common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, the shorter one of each of 64
    characters at most: one bit a character of it, all pairs at once."""
    if not a:
        return np.zeros(0, np.int64)
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True)
    n_short, n_long = (np.array([len(x) for x in side]) for side in (short, long))
    order = np.argsort(-n_long, kind="stable")  # pairs drop out from the end as their texts end
    letters = np.zeros((len(a), 64), np.uint32)
    letters[np.arange(64) < n_short[:, None]] = _points("".join(short))
    letters, points = letters[order], _points("".join(long))
    begin, n_long = (np.cumsum(n_long) - n_long)[order], n_long[order]
    inside = np.where(n_short == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n_short, 63).astype(np.uint64)) - np.uint64(1))[order]
    free = np.full(len(a), ~np.uint64(0))
    active = np.searchsorted(-n_long, -np.arange(n_long[0]), "left") if len(n_long) else []
    for k, rows in enumerate(active):
        same = letters[:rows] == points[begin[:rows] + k, None]
        here = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0] & inside[:rows]
        own = free[:rows]
        with np.errstate(over="ignore"):
            free[:rows] = (own + (own & here)) | (own & ~here)
    out = np.empty(len(a), np.int64)
    out[order] = np.bitwise_count(~free & inside)
    return out


def _common_subsequence(a: str, b: str) -> int:
    """The same for one pair of texts of any length."""
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    whole = (1 << len(b)) - 1
    free = whole
    for c in a:
        here = free & places.get(c, 0)
        free = ((free + here) | (free & ~here)) & whole
    return (free ^ whole).bit_count()


#: Pairs that are bounded at a time.
_PAIRS = 1 << 13


def scores_from(a: list[str], b: list[str], least: list[float]) -> list[float | None]:
    """``score`` of pairs of texts that are not empty, None where it is below what is asked for.

    Matched characters are a common subsequence, so the longest one bounds the score; only pairs that
    it lets through are scored.
    """
    out: list[float | None] = []
    for first in range(0, len(a), _PAIRS):
        rows = range(first, min(first + _PAIRS, len(a)))
        brief = [k for k in rows if min(len(a[k]), len(b[k])) <= 64]
        bound = dict(zip(brief, _common_subsequences([a[k] for k in brief], [b[k] for k in brief]).tolist(), strict=True))
        for k in rows:
            common = bound[k] if k in bound else _common_subsequence(a[k], b[k])
            value = score(a[k], b[k]) if 2 * common >= least[k] * (len(a[k]) + len(b[k])) or a[k] in b[k] or b[k] in a[k] else 0.0
            out.append(value if value >= least[k] else None)
    return out


@F.pandas_udf(T.DoubleType())
def similarity_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``score`` of columns of projected texts, null where it is below ``least``."""
    return pd.Series(scores_from(a.tolist(), b.tolist(), least.tolist()), dtype=float)


def may_matter(a: Column, b: Column) -> Column:
    """False for projected texts that score less than a match's least score less its margin: such a
    pair is no match and stands in no other one's way. Only lengths and containment are looked at."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (lengths_allow(a, b, F.lit(LEAST_SCORE - LEAST_MARGIN)) | a.contains(b) | b.contains(a))


def lengths_allow(a: Column, b: Column, least: Column) -> Column:
    """Whether texts of these lengths can share enough characters for a score."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) >= least


def containment_score(a: Column, b: Column) -> Column:
    """``score`` of projected texts of which one holds the other."""
    return F.when(a == b, 1.0).otherwise(CONTAINED + COVERAGE * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def unique_best(scored: DataFrame, key: str | list[str], candidate: str, least: float = LEAST_SCORE, margin: float = LEAST_MARGIN) -> DataFrame:
    """The best candidate of each key if it scores enough and leads the next one by the margin."""
    keys = [key] if isinstance(key, str) else key
    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc(), candidate)
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).withColumn("next", F.lead("score").over(by_score))
    return ranked.where((F.col("rank") == 1) & (F.col("score") >= least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)))


# --- assignment ------------------------------------------------------------------------------

def greedy_assignment(candidates: DataFrame, group: str, limit: float, order: tuple[str, ...] = ("distance", "left_id", "right_id")) -> DataFrame:
    """One-to-one pairs within each group: least in ``order`` first, each side used once.

    ``candidates``: group, left_id, right_id, distance and the columns of ``order``, which tell any two
    pairs apart. A pair that is the best one of both its sides would be taken before any other of
    theirs, so all such pairs are taken at once, what they use goes, and the rest is looked at again,
    until nothing is left: no group has to fit in a task.
    """
    names = list(dict.fromkeys([group, "left_id", "right_id", "distance", *order]))
    left = candidates.where(F.col("distance") <= limit).select(*names)
    left, chosen = stored(left, "assignment-pairs"), None
    while True:
        mark = F.struct(*order)
        best = lambda side, left=left, mark=mark: left.groupBy(group, side).agg(F.min(mark).alias(f"best_{side}"))
        met = left.join(best("left_id"), [group, "left_id"]).join(best("right_id"), [group, "right_id"])
        seen = Observation()
        now = met.where((mark == F.col("best_left_id")) & (mark == F.col("best_right_id"))).select(*names)
        now = stored(now.observe(seen, F.count(F.lit(1)).alias("n")), "assignment-chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        if not seen.get.get("n"):
            return chosen
        rest = left.join(now.select(group, "left_id"), [group, "left_id"], "left_anti").join(now.select(group, "right_id"), [group, "right_id"], "left_anti")
        left = stored(rest.select(*names), "assignment-pairs")
