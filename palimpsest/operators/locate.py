"""From what a preview shows back to the blocks of its source: locators of findings and selections.

``blocks``: doc_id, block_id, text; ``lines`` (of the preview): doc_id, page, line_id, line_no (in
order over all pages), text. A range is found by the texts' comparison forms; where these leave more
than one possibility, the most similar line or block counts, if it is similar enough and leads clearly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import all_starts
from palimpsest.operators import match as M
from palimpsest.operators import whole as W
from palimpsest.session import stored

BEST = ["doc_id", "id"]

def projected(rows: DataFrame, column: str = "text") -> DataFrame:
    """Add a text's comparison form (p_text) and that without spaces (c_text). Where their characters come
    from is only told of what is found (``match.original_span``)."""
    kept = [c for c in rows.columns if c not in ("p_text", "c_text")]
    form = rows.select(*kept, M.comparison_text(F.col(column)).alias("p_text"))
    return form.withColumn("c_text", F.replace("p_text", F.lit(" "), F.lit("")))


#: Whole texts are written with this codec, which halves them once more.
_CODEC = "zstd"


def prepared(blocks: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and lines with their forms. Nothing is written: most documents are read once, by whoever takes
    them whole."""
    return projected(blocks), projected(lines.select("doc_id", "page", "line_id", "line_no", "text"))


#: Documents whose blocks have more characters are not taken whole: their texts are sent from step to step.
_WHOLE = 1 << 19


def _sizes(own: DataFrame) -> DataFrame:
    return own.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))


def _apart(sizes: DataFrame, most: int) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """What keeps of a frame the documents that are taken whole, and what keeps those that are too large."""
    large = stored(sizes.where(F.col("n") > most).select("doc_id"), "large-documents")
    if large.isEmpty():
        return lambda rows: rows, lambda rows: rows.where(F.lit(False))
    return lambda rows: rows.join(large, "doc_id", "left_anti"), lambda rows: rows.join(large, "doc_id", "left_semi")


def _written(own: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prepared`` frames, written, as several steps read them; their forms are made again by each step, as
    they would take as much room as the texts."""
    lines = shown.select("doc_id", "page", "line_id", "line_no", "text")
    own = stored(own.select("doc_id", "block_id", "text"), "block-texts", _CODEC)
    return projected(own), projected(stored(lines, "line-texts", _CODEC))


def page_lines(shown: DataFrame) -> DataFrame:
    """doc_id, page, page_text (all lines without spaces) and lines, the range (line_id, from, to) of each
    line in it that is not empty."""
    rows = shown.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "c_text"))).alias("rows"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line_id:string,from:int,to:int>>").alias("lines"))
    rows = rows.select("doc_id", "page", F.array_join(F.transform("rows", lambda r: r["c_text"]), "").alias("page_text"), F.expr("filter(rows, r -> length(r.c_text) > 0)").alias("rows"))
    to = lambda acc, r: acc["at"] + F.length(r["c_text"])
    own = lambda acc, r: F.struct(r["line_id"].alias("line_id"), acc["at"].alias("from"), to(acc, r).alias("to"))
    step = lambda acc, r: F.struct(to(acc, r).alias("at"), F.array_append(acc["lines"], own(acc, r)).alias("lines"))
    return rows.select("doc_id", "page", "page_text", F.aggregate("rows", none, step, lambda acc: acc["lines"]).alias("lines"))


def page_characters(shown: DataFrame) -> DataFrame:
    """doc_id, page, page_text (all lines without spaces) and line_ids, the line of each character."""
    own = F.transform("lines", lambda r: F.array_repeat(r["line_id"], r["to"] - r["from"]))
    return page_lines(shown).select("doc_id", "page", "page_text", F.flatten(own).alias("line_ids"))


#: From this score on, the parts into which a text is cut are long enough to be looked up.
_PARTS_FROM, _PART = 0.9, 5
#: A candidate that scores less is no match and stands in no other one's way.
LEAST = M.LEAST_SCORE - M.LEAST_MARGIN
#: Texts whose lengths differ by this factor are one class of lengths apart.
_CLASS = 1.25


def _scored(pairs: DataFrame, exact: str, block: str, line: str) -> DataFrame:
    """The higher of how similar a line is to the text sought and to its block."""
    floor = F.lit(LEAST)
    near = M.may_matter(F.col(exact), F.col(line)) | M.may_matter(F.col(block), F.col(line))
    score = F.greatest(M.similarity_from(F.col(exact), F.col(line), floor), M.similarity_from(F.col(block), F.col(line), floor))
    return pairs.where(near).withColumn("score", score).where("score IS NOT NULL")


def _parts(text: Column, least: Column) -> Column:
    """A text in so many parts that one of them stands unbroken in any text with that score.

    Of the characters of both texts, 1 - score are unmatched. Each one that is unmatched breaks one part
    at most, be it within the part or between two of its characters in the other text.
    """
    n = F.length(text)
    unmatched = F.floor((1 - least) * 2 * n / least + 1e-9)
    size = F.floor(n / (unmatched + 1)).cast("int")
    return F.when(size >= _PART, F.transform(F.sequence(F.lit(0), unmatched.cast("int")), lambda k: F.substring(text, (k * size + 1).cast("int"), size)))


def similar_lines(sought: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, x, page, line_id, score of the pairs of a text x and a line of its document, neither
    within the other, that score ``least`` or more.

    ``sought``: doc_id, x, least; ``lines``: doc_id, page, line_id, l_text. A text with a high ``least``
    is looked up by its parts, any other one among the lines of a length that can score so.
    """
    keys = ["page", "line_id"]
    asked = sought.where("least < 1 AND length(x) > 0").withColumn("parts", F.when(F.col("least") >= _PARTS_FROM, _parts(F.col("x"), F.col("least"))))
    by_part = asked.where("parts IS NOT NULL").select("doc_id", "x", "least", F.explode("parts").alias("part"))
    by_part = M.containing(by_part, lines, "part", "l_text", ["doc_id"], keys).drop("part").distinct()
    ratio = (2 - F.col("least")) / F.col("least")
    cls = lambda n: F.floor(F.log(n) / F.log(F.lit(_CLASS))).cast("int")
    n = F.length("x")
    classes = F.sequence(cls(F.greatest(n / ratio, F.lit(1.0)) * 0.999), cls(n * ratio * 1.001))
    by_length = asked.where("parts IS NULL").withColumn("cls", F.explode(classes))
    by_length = by_length.join(lines.where("l_text <> ''").withColumn("cls", cls(F.length("l_text"))), ["doc_id", "cls"])
    columns = ["doc_id", "x", "least", *keys, "l_text"]
    met = by_part.select(*columns).unionByName(by_length.select(*columns))
    met = met.where(M.lengths_allow(F.col("x"), F.col("l_text"), F.col("least")) & ~F.contains("x", "l_text") & ~F.contains("l_text", "x"))
    return met.withColumn("score", M.similarity_from(F.col("x"), F.col("l_text"), F.col("least"))).where("score IS NOT NULL").select("doc_id", "x", *keys, "score")


def least_of_others(scored: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of some scored candidates, the least score from which on another one could matter."""
    top = scored.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("top"))
    first, second = F.get("top", F.lit(0)), F.coalesce(F.get("top", F.lit(1)), F.lit(0.0))
    # One matters that comes near a clear leader, or that leads one of several equal ones.
    least = F.greatest(F.when(first - second >= M.LEAST_MARGIN, first - M.LEAST_MARGIN).otherwise(first) - 1e-9, F.lit(LEAST))
    least = F.when((first - second < M.LEAST_MARGIN) & (first + M.LEAST_MARGIN > 1 + 1e-9), 1.0).otherwise(least)
    return top.select(*keys, least.alias("least"))


def best_by_text(blocks: DataFrame, lines: DataFrame, key: str, forms: bool = True) -> DataFrame:
    """``key``, line_no and score of the line (line_no, l_text) that fits each block (``key``, b_text) best of those
    that are equal in doc_id and page, if it scores enough and leads clearly. Texts are forms already or made such.

    Documents are taken whole, and a key counts within its own. Lines that hold a block or that it holds are scored
    first, by lengths alone; of the others only those are scored that could matter beside them.
    """
    kinds = dict(blocks.dtypes) | dict(lines.dtypes)
    parts = {"blocks": (blocks, ["page", key, "b_text"]), "lines": (lines, ["page", "line_no", "l_text"])}
    return W.by_document(parts, W.matches_of_forms if forms else W.matches, f"{key} {kinds[key]}, line_no {kinds['line_no']}, score double")


def best_lines(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, id, page, line_id: the line of its document that fits each of ``wanted`` (doc_id, id,
    e_text, b_text) best, by either text, if it scores enough and leads clearly.

    Lines that hold a text, or that it holds, are looked up first. They tell from which score on another
    line could matter, which is all that the rest are searched for.
    """
    keys = ["page", "line_id"]
    order = lines.select("doc_id", *keys, "line_no")
    lines = lines.select("doc_id", *keys, F.col("p_text").alias("l_text"))
    each = wanted.select("doc_id", "id", F.explode(F.array_distinct(F.array("e_text", "b_text"))).alias("x")).where("x <> ''")
    texts = stored(each.select("doc_id", "x").distinct(), "texts-sought")
    within = M.containing(texts, lines, "x", "l_text", ["doc_id"], keys)
    around = M.containing(lines, texts.select("doc_id", "x"), "l_text", "x", ["doc_id"], ["x"])
    columns = ["doc_id", "x", *keys]
    held = within.unionByName(around.select(*within.columns)).distinct().withColumn("score", M.containment_score(F.col("x"), F.col("l_text")))
    held = stored(held.select(*columns, "score"), "contained-lines")
    of_key = lambda pairs: each.join(pairs, ["doc_id", "x"]).groupBy(*BEST, *keys).agg(F.max("score").alias("score"))
    top = least_of_others(of_key(held), BEST)
    asked = each.join(top, BEST, "left").groupBy("doc_id", "x").agg(F.min(F.coalesce("least", F.lit(LEAST))).alias("least"))
    found = held.unionByName(similar_lines(asked, lines).select(*columns, "score"))
    scored = of_key(found).join(order, ["doc_id", *keys])
    return M.unique_best(scored, BEST, "line_no").select(*BEST, *keys)


def _cut(rows: DataFrame) -> DataFrame:
    """The text of a range of its block."""
    return rows.withColumn("exact_text", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))


def _of_documents(asked: DataFrame, own: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``own`` and ``shown`` of the documents of which something is asked, written: most have no findings."""
    docs = stored(asked.select("doc_id").distinct(), "documents-asked")
    return _written(*(rows.join(docs, "doc_id", "left_semi") for rows in (own, shown)))


def block_locators(findings: DataFrame, own: DataFrame, shown: DataFrame) -> DataFrame:
    """id, doc_id, block_id, start, end, exact_text, page, line_id of the findings (doc_id, id, block_id,
    exact_text) whose text occurs once in their block and that one line of the preview fits best.

    ``own`` and ``shown`` are ``prepared``.
    """
    return _locators(findings, *_of_documents(findings, own, shown))


def _locators(findings: DataFrame, own: DataFrame, shown: DataFrame) -> DataFrame:
    """``block_locators`` of ``_written`` frames."""
    sought = projected(findings, "exact_text").select("doc_id", "id", "block_id", F.col("p_text").alias("e_text"))
    met = sought.join(own.select("doc_id", "block_id", "text", "p_text"), ["doc_id", "block_id"])
    met = met.withColumn("at", M.only_at(F.col("p_text"), F.col("e_text"))).where("at IS NOT NULL")
    met = met.withColumn("span", M.original_span("text", "at", F.length("e_text"), F.lit(False)))
    met = _cut(met.select("doc_id", "id", "block_id", "span.start", "span.end", "text", "e_text", F.col("p_text").alias("b_text"))).drop("text")
    met = stored(met, "findings-in-blocks")
    best = best_lines(met.select(*BEST, "e_text", "b_text"), shown)
    return met.join(best, BEST).select("id", "doc_id", "block_id", "start", "end", "exact_text", "page", "line_id")


def _selected(selections: DataFrame, pages: DataFrame) -> DataFrame:
    """Selections with their forms, and where they lie in the page's characters: null unless just one
    of the occurrences begins on the line that was selected. ``pages``: ``page_lines``."""
    sought = projected(selections, "exact_text")
    met = sought.withColumnsRenamed({"p_text": "e_text", "c_text": "fragment"}).join(pages, ["doc_id", "page"], "left")
    met = met.withColumn("own", F.filter("lines", lambda x: x["line_id"] == F.col("line_id")))
    met = met.withColumn("starts", F.flatten(F.transform("own", _begin_within)))
    met = met.withColumn("from", F.when(F.size("starts") == 1, F.get("starts", F.lit(0))))
    # Places are columns of their own, lest they be looked for again at each line.
    met = met.withColumn("at", M.only_at(F.col("page_text"), F.col("fragment"))).withColumn("goes_on", _goes_on())
    return met.drop("page_text", "lines", "own", "starts", "at")


def _begin_within(line: Column) -> Column:
    """Where the fragment begins within a line of the page, be it that it goes on into others; of several
    places the first two."""
    n = line["to"] - line["from"] + F.length("fragment") - 1
    part = F.substring("page_text", line["from"] + 1, n)
    first = F.call_function("locate", F.col("fragment"), part)
    second = F.call_function("locate", F.col("fragment"), part, first + 1)
    places = F.filter(F.array(first, F.when(first > 0, second).otherwise(F.lit(0))), lambda k: (k > 0) & (F.length("fragment") > 0))
    return F.transform(places, lambda k: line["from"] + k - 1)


def _goes_on() -> Column:
    """Whether a selection occurs once (``at``) on its page, from its line on into another one."""
    at = F.col("at")
    begins = F.exists("own", lambda x: (x["from"] <= at) & (at < x["to"]))
    over = F.filter("lines", lambda x: (x["from"] < at + F.length("fragment")) & (at < x["to"]))
    return F.coalesce(begins & (F.size(F.array_distinct(F.transform(over, lambda x: x["line_id"]))) > 1), F.lit(False))


def context_candidates(selected: DataFrame, pages: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, id, block_id, start, end: the ranges of blocks that stand whole on the page, around the
    selection."""
    held = M.containing(own.select("doc_id", "block_id", "c_text"), pages.select("doc_id", "page", "page_text"), "c_text", "page_text", ["doc_id"], ["page"])
    held = held.select("doc_id", "page", "block_id", F.length("c_text").alias("n"), F.explode(all_starts(F.col("page_text"), F.col("c_text"))).alias("block_from"))
    held = stored(held, "blocks-on-pages")
    some = selected.where(F.col("from").isNotNull()).select("doc_id", "page", "id", "from", (F.col("from") + F.length("fragment")).alias("to"))
    met = some.join(held, ["doc_id", "page"]).where((F.col("block_from") <= F.col("from")) & (F.col("to") <= F.col("block_from") + F.col("n")))
    met = met.select("doc_id", "id", "block_id", (F.col("from") - F.col("block_from")).alias("at"), (F.col("to") - F.col("from")).alias("n")).distinct()
    met = stored(met, "selections-in-context")
    whole = met.join(own.select("doc_id", "block_id", "text"), ["doc_id", "block_id"])
    return whole.withColumn("span", M.original_span("text", "at", "n", F.lit(True))).select("doc_id", "id", "block_id", "span.start", "span.end").distinct()


def resolve_selections(selections: DataFrame, own: DataFrame, shown: DataFrame, sizes: DataFrame | None = None, whole: int = _WHOLE) -> DataFrame:
    """id, doc_id, block_id, start, end, exact_text of the selections (doc_id, id, page, line_id,
    exact_text) that come from just one place of the source. ``own`` and ``shown`` are ``prepared``.

    Documents of up to so many characters are taken whole; ``sizes`` (doc_id, n) tells what they have, if
    that is known, else blocks are counted.
    """
    small, large = _apart(_sizes(own) if sizes is None else sizes, whole)
    by_steps = _selections_by_steps(large(selections), *_written(large(own), large(shown)))
    parts = {
        "blocks": (small(own), ["block_id", "text"]),
        "lines": (small(shown), ["page", "line_id", "line_no", "text"]),
        "asked": (small(selections), ["id", "page", "line_id", "exact_text"]),
    }
    kinds = dict(by_steps.dtypes)
    return W.by_document(parts, W.resolve, ", ".join(f"{c} {kinds[c]}" for c in by_steps.columns)).unionByName(by_steps)


def _selections_by_steps(selections: DataFrame, own: DataFrame, shown: DataFrame) -> DataFrame:
    """``resolve_selections`` of documents that no task takes whole."""
    # Each step that sends whole texts is written before the next one, so that one such shuffle lies on disk at a time.
    pages = stored(page_lines(shown), "page-lines", _CODEC)
    lines = shown.select("doc_id", "page", "line_id", F.col("p_text").alias("l_text"))
    asked = stored(stored(selections, "selections").join(lines, ["doc_id", "page", "line_id"]), "selections-with-lines", _CODEC)
    selected = stored(_selected(asked, pages), "selections-on-pages", _CODEC)
    context = context_candidates(selected, pages, own)
    # Without context the text is looked for in all blocks, without spaces if it was wrapped.
    rest = selected.join(context.select(*BEST).distinct(), BEST, "left_anti")
    rest = rest.withColumn("loose", M.only_at(F.col("l_text"), F.col("e_text")).isNull()).where("NOT loose OR goes_on")
    rest = rest.select(*BEST, "loose", F.when(F.col("loose"), F.col("fragment")).otherwise(F.col("e_text")).alias("sought"))
    rest = stored(rest, "selections-without-context")
    texts = F.explode(F.array(F.struct(F.lit(False).alias("loose"), F.col("p_text").alias("text")), F.struct(F.lit(True).alias("loose"), F.col("c_text").alias("text"))))
    held = own.select("doc_id", "block_id", texts.alias("t")).select("doc_id", "block_id", "t.loose", "t.text")
    met = M.containing(rest, held, "sought", "text", ["doc_id", "loose"], ["block_id"])
    at = M.only_at(F.col("text"), F.col("sought"))
    met = met.select(*BEST, "block_id", "loose", at.alias("at"), F.length("sought").alias("n")).where("at IS NOT NULL")
    met = stored(met, "selections-in-blocks")
    met = met.join(own.select("doc_id", "block_id", "text"), ["doc_id", "block_id"])
    anywhere = met.withColumn("span", M.original_span("text", "at", "n", "loose")).select(*BEST, "block_id", "span.start", "span.end")
    candidates = stored(context.unionByName(anywhere), "selection-candidates")
    candidates = candidates.join(candidates.groupBy(*BEST).agg(F.count(F.lit(1)).alias("n")), BEST)
    several = candidates.where("n > 1").join(selected.select(*BEST, "e_text", "l_text"), BEST)
    several = several.join(own.select("doc_id", "block_id", F.col("p_text").alias("b_text")), ["doc_id", "block_id"])
    best = M.unique_best(_scored(several, "e_text", "b_text", "l_text"), BEST, "block_id")
    columns = [*BEST, "block_id", "start", "end"]
    chosen = candidates.where("n = 1").select(*columns).unionByName(best.select(*columns))
    return _cut(chosen.join(own.select("doc_id", "block_id", "text"), ["doc_id", "block_id"])).select("id", "doc_id", "block_id", "start", "end", "exact_text")


def valid_locators(locators: DataFrame, own: DataFrame, shown: DataFrame) -> DataFrame:
    """id and whether each locator (doc_id, id, block_id, start, end, exact_text, page, line_id) still
    holds: its block has that text there, and either the page around its line leads to the same range,
    or it is what a new locator would be."""
    own, shown = _of_documents(locators, own, shown)
    met = locators.join(own.select("doc_id", "block_id", "text"), ["doc_id", "block_id"], "left")
    here = (F.col("end") <= F.length("text")) & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("exact_text"))
    met = met.select("doc_id", "id", F.coalesce(here, F.lit(False)).alias("here"))
    pages = stored(page_lines(shown), "page-lines", _CODEC)
    selected = _selected(locators.select("doc_id", "id", "page", "line_id", "exact_text"), pages)
    place = ["doc_id", "id", "block_id", "start", "end"]
    around = context_candidates(selected, pages, own).join(locators.select(*place), place, "left_semi").select(*BEST)
    anew = _locators(locators.select("doc_id", "id", "block_id", "exact_text"), own, shown)
    again = anew.join(locators.select(*place, "page", "line_id"), [*place, "page", "line_id"], "left_semi").select(*BEST)
    found = around.unionByName(again).distinct().withColumn("found", F.lit(True))
    return met.join(found, BEST, "left").select("id", "doc_id", (F.col("here") & F.coalesce("found", F.lit(False))).alias("valid"))
