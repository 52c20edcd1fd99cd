"""Text expressions of redaction: masks, tokens, line models, names."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"@.\-_+/() "
#: All line ends that count for model-input lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def split_lines(text: Column) -> Column:
    """Lines of a text; one line end at its end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\s\x1c-\x1f\x85   ]")


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def partial_mask(x: Column) -> Column:
    """E-mail: first character of the local part. Five digits or more: the last four. Else: the
    first character of each token."""
    local = F.substring_index(x, "@", 1)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(1)))
    email = F.concat(F.left(local, F.lit(1)), stars, F.substring(x, F.length(local) + 1, F.length(x)))
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    number = F.regexp_replace(x, r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*")
    tokens = F.regexp_replace(x, rf"(?s)(?<=[^{SEPARATORS}])[^{SEPARATORS}]", "*")
    return F.when(x.contains("@"), email).when(digits >= 5, number).otherwise(tokens)


def effective_entity_type(reviewed: Column, detected: Column) -> Column:
    """Reviewed, or else detected, or else unknown; an empty string falls through."""
    return F.coalesce(F.nullif(reviewed, F.lit("")), F.nullif(detected, F.lit("")), F.lit("unknown"))


def unique_offset(line: Column, text: Column) -> Column:
    """Start of ``text`` in ``line`` (from 0), null unless it occurs exactly once (overlaps count)."""
    first = F.call_function("locate", text, line)
    again = F.call_function("locate", text, line, first + 1)
    return F.when((F.length(text) > 0) & (first > 0) & (again == 0), first - 1)


def all_starts(line: Column, text: Column) -> Column:
    """Starts (from 0) of all occurrences, overlapping ones too. If there are several, the line is cut before
    each of them, and one fold over the pieces adds up their lengths."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(line, quoted, -1)
    none = F.array().cast("array<int>")
    begun = F.struct(F.lit(0).alias("at"), F.when(line.startswith(text), F.array(F.lit(0))).otherwise(none).alias("starts"))  # there nothing is cut
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.array_append(acc["starts"], acc["at"] + F.length(x)).alias("starts"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), begun, step, lambda acc: acc["starts"])
    first = F.call_function("locate", text, line)
    several = F.call_function("locate", text, line, first + 1) > 0
    return F.when((F.length(text) > 0) & (first > 0), F.when(several, found).otherwise(F.array(first - 1))).otherwise(none)


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that folding changes further: to one character, and to several."""
    folded = {c: c.casefold() for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff" and c.lower() == c != c.casefold()}
    return {c: f for c, f in folded.items() if len(f) == 1}, {c: f for c, f in folded.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding: lower case, and what that leaves apart, such as final sigmas, long s, and the
    sharp s and ligatures, which become several letters."""
    one, several = _foldings()
    folded = F.translate(F.lower(text), "".join(one), "".join(one.values()))
    spelt = reduce(lambda c, f: F.replace(c, F.lit(f[0]), F.lit(f[1])), several.items(), folded)
    return F.when(folded.rlike(f"[{''.join(several)}]"), spelt).otherwise(folded)


def file_stem(name: Column) -> Column:
    """Title of a file: its name without folder and suffix, else its name, else a stand-in."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(stem), F.lit("")), F.nullif(F.trim(base), F.lit("")), F.lit("Untitled review"))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_"), 1, 120)


def line_number(line_id: Column) -> Column:
    """n of a line id t<n>, null for any other."""
    return F.nullif(F.regexp_extract(line_id, r"^t([0-9]+)$", 1), F.lit("")).try_cast("int")


def timecode(seconds: Column) -> Column:
    """HH:MM:SS:mmm of a number of seconds, milliseconds rounded half even."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    part = lambda size, mod: (F.floor(ms / size) % mod).cast("long")
    return F.format_string("%02d:%02d:%02d:%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def parse_timecode(text: Column) -> Column:
    """Seconds of HH:MM:SS:mmm, null for any other text."""
    pattern = r"^([0-9]{2,}):([0-5][0-9]):([0-5][0-9]):([0-9]{3})$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long")
    return (part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)) / 1000.0


def normalise_rotation(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def strictest(*limits: Column) -> Column:
    """The least of the limits that are known."""
    return reduce(lambda a, b: F.least(a, b), limits) if len(limits) > 1 else limits[0]


def regions_match(left: tuple[Column, ...], right: tuple[Column, ...]) -> Column:
    """Whether two regions (x, y, width, height, rotation) count as the same."""
    near = [F.abs(a - b) < (0.01 if k == 4 else 1e-4) for k, (a, b) in enumerate(zip(left, right, strict=True))]
    return reduce(lambda a, b: a & b, near)


def drawn_region(x0: Column, y0: Column, x1: Column, y1: Column, least: float) -> Column:
    """The region between two points, in shares of a picture: within it, and no side below ``least``."""
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), high)
    x, y = F.least(x0, x1), F.least(y0, y1)
    return F.struct(
        clamp(x, 0.0, F.lit(1 - least)).alias("x"),
        clamp(y, 0.0, F.lit(1 - least)).alias("y"),
        clamp(F.abs(x1 - x0), least, 1 - x).alias("width"),
        clamp(F.abs(y1 - y0), least, 1 - y).alias("height"),
    )


def matches_whole(value: Column, pattern: str) -> Column:
    return F.coalesce(value, F.lit("")).rlike(f"^(?:{pattern})$")


# Forms of identifiers.
IDENTIFIERS = {
    "set_id": "[a-z0-9]+(?:-[a-z0-9]+)*",
    "entity_type": "[a-z0-9]+(?:_[a-z0-9]+)*",
    "occurrence_id": "pic_[0-9a-f]{64}",
    "block_id": "b_[0-9a-f]{64}",
}


def display_name(given: Column, filename: Column) -> Column:
    """A session's name: the one given, or if that is blank the title of its file."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), file_stem(filename))
