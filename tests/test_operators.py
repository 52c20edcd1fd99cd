"""Worked examples and properties of the review operators."""

import hashlib
import itertools
import json
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import audit, budget, extract, lines, match, policy, redact, review, timeline
from palimpsest.sources import formats, sinks
from palimpsest.streaming import conflate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "masked"),
    [
        ("alice@example.com", "a****@example.com"),
        ("a@b.c", "a*@b.c"),
        ("@b", "*@b"),
        ("+1 (743) 555-3824", "+* (***) ***-3824"),
        ("John Smith", "J*** S****"),
        ("", ""),
        ("12 34", "1* 3*"),
        ("Émile 😀x\ny", "É**** 😀***"),
    ],
)
def test_masks(spark, value, masked):
    assert one(spark, X.partial_mask(F.lit(value))) == masked


def test_effective_type_and_offsets(spark):
    eff = lambda r, d: one(spark, X.effective_entity_type(F.lit(r).cast("string"), F.lit(d).cast("string")))
    assert (eff("", "email"), eff(None, None), eff("name", "email")) == ("email", "unknown", "name")
    assert one(spark, X.unique_offset(F.lit("xx"), F.lit("x"))) is None
    assert one(spark, X.unique_offset(F.lit("aéx"), F.lit("x"))) == 2
    assert one(spark, X.all_starts(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, X.normalise_rotation(F.lit(190.0))) == -170
    assert one(spark, X.line_number(F.lit("t12"))) == 12 and one(spark, X.line_number(F.lit("l12"))) is None
    assert one(spark, X.timecode(F.lit(3661.0625))) == "01:01:01:062"
    assert one(spark, X.parse_timecode(F.lit("01:01:01:062"))) == 3661.062


def test_line_models(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "a\r\nb\rc\x1cd e\n"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.line_id, r.text) for r in lines.source_lines(docs).collect()]
    assert sorted(got) == [(1, "t1", "a"), (1, "t3", "b"), *[(2, f"t{k}", c) for k, c in enumerate("abcde", 1)]]


def greedy(costs, limit):
    out, batch, used = [], 1, 0
    for c in costs:
        if used and used + c > limit:
            batch, used = batch + 1, 0
        used += c
        out.append(batch)
    return out


def test_batches(spark):
    rng = random.Random(1)
    cases = [(k, [rng.randrange(1, 60) for _ in range(rng.randrange(1, 20))]) for k in range(60)] + [(99, [40, 40, 40])]
    costs = F.transform("c", lambda c, k: F.struct((k + 1).alias("no"), c.alias("cost")))
    rows = spark.createDataFrame(cases, "k long, c array<long>").select("k", lines.greedy_batches(costs, 100).alias("b"))
    for r in rows.collect():
        costs = dict(cases)[r.k]
        assert [k for k, b in enumerate(r.b, 1) for _ in range(b.n_lines)] == greedy(costs, 100)
        assert [b.cost for b in r.b] == [sum(costs[b.first_line - 1 : b.last_line]) for b in r.b]
    docs = spark.createDataFrame([(1, "x" * 39 + "\n" + "x" * 39 + "\n" + "x" * 39), (2, "y\n" + "x" * 100)], "doc_id long, text string")
    got = sorted((r.doc_id, r.batch, r.n_lines) for r in lines.text_batches(docs, 100).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (2, 0, 2)]


def test_policy_pairs_fall_back_as_a_unit(spark):
    rows = spark.createDataFrame([("nonsense", "document"), ("face", "audio"), ("face", "image")], "e string, k string")
    got = {(r.e, r.k): (r.privacy_category, r.privacy_risk, r.action, r.effect) for r in policy.resolve(rows, "gdpr", F.col("e"), F.col("k"), spark).collect()}
    assert got["nonsense", "document"] == ("unknown", "medium", "redact", "box")
    assert got["face", "audio"] == ("personal_data", "medium", "redact", "bleep")
    assert got["face", "image"] == ("personal_data", "medium", "redact", "blur")


def test_tokens(spark):
    rows = [("f1", "A", None), ("f2", "B", "  "), ("f3", "A", None), ("f4", "C", "Own"), ("f5", "D", None)]
    frame = spark.createDataFrame(rows, "finding_id string, exact_text string, custom_text string").withColumns({"s": F.lit(1), "e": F.lit("name")})
    got = redact.with_tokens(frame, "s", "e", "exact_text", ["finding_id"]).orderBy("finding_id").collect()
    assert [r.token for r in got] == ["NAME_001", "NAME_002", "NAME_001", None, "NAME_003"]


def test_merge_overlaps_against_a_direct_rule(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4), float(s := rng.randrange(80)), float(s + rng.randrange(1, 9)), rng.choice([None, 0.5, 0.9])) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, g int, start_time double, end_time double, confidence double")
    got = sorted((r.g, r.start_time, r.end_time, r.kept, r.n_merged) for r in timeline.merge_overlaps(frame, ["g"], ["id"]).collect())
    expected = []
    for g in range(4):
        current = None
        for k, _, s, e, c in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            c = -1 if c is None else c
            if current and s <= current[1]:
                current[1], current[4] = max(current[1], e), current[4] + 1
                if c > current[3]:
                    current[2], current[3] = k, c
            else:
                if current:
                    expected.append((g, current[0], current[1], current[2], current[4]))
                current = [s, e, k, c, 1]
        expected.append((g, current[0], current[1], current[2], current[4]))
    assert got == sorted(expected)


def test_sweep_covers_with_the_strongest(spark):
    spans = spark.createDataFrame([(1, 0.0, 4.0, "bleep"), (1, 2.0, 6.0, "mute"), (1, 8.0, 9.0, "mute"), (1, 9.0, 12.0, "mute")], "s int, start_time double, end_time double, effect string")
    got = sorted((r.start_time, r.end_time, r.effect) for r in timeline.effect_sweep(spans, "s", F.lit(10.0)).collect())
    assert got == [(0, 2, "bleep"), (2, 6, "mute"), (8, 10, "mute")]


@pytest.mark.parametrize(("seconds", "chunks"), [(1, 1), (300, 1), (301, 2), (598, 2), (599, 3)])
def test_chunk_plan(spark, seconds, chunks):
    plan = timeline.chunk_plan(spark.createDataFrame([(seconds,)], "d long"), "d").collect()
    assert len(plan) == chunks
    assert max(r.chunk_start + r.chunk_duration for r in plan) == seconds


def test_regions(spark):
    box = one(spark, extract.clamp_region(F.lit(0.9), F.lit("x"), F.lit(0.5), F.lit(None).cast("string")))
    assert (box.x, box.y, box.height) == (0.9, 0, 0.1) and abs(box.width - 0.1) < 1e-9
    assert one(spark, extract.clamp_region(F.lit(1.0), F.lit(0), F.lit(0.5), F.lit(0.5))) is None


def test_budget(spark):
    none = F.lit(None).cast("long")
    assert one(spark, budget.input_limit(none, F.lit(8000), F.lit(1000))) == 7000
    assert one(spark, budget.input_limit(none, none, none)) is None
    assert one(spark, budget.admission(F.lit(10), F.lit(5), none, F.lit(4), F.lit(1))) == "output_limit"


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ('{"findings":[{"a":1]}', {"findings": [{"a": 1}]}),
        ('text {x} then ```json\n{"a": {"b": "}{"}}\n```', {"a": {"b": "}{"}}),
        ('{"a": [1, 2]', {"a": [1, 2]}),
        ('{"findings":[{"a":[1]}', None),
        ("no object", None),
        (None, None),
        ('[{"a": 1}]', {"a": 1}),
    ],
)
def test_json_objects(raw, found):
    got = extract.first_object(raw)
    assert (json.loads(got) if got else None) == found


def test_response_items(spark):
    good = '{"entity_type":"email","confidence":0.5,"line_id":"t1","exact_text":"x"}'
    rows = [
        (1, f'{{"findings":[{good},{{"confidence":2}},5]}}'),
        (2, f'{{"findings":[{good},{{"action":"redact"}}]}}'),
        (3, '{"findings":{}}'),
        (4, None),
        (5, '{"findings":[{"entity_type":null,"line_id":"t1","exact_text":"y"},{"line_id":"t1","exact_text":"z"}]}'),
        (6, '{"findings":[]}'),
    ]
    got = extract.items(spark.createDataFrame(rows, "k long, raw string"), "k", "raw").orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.reject) for r in got] == [
        (1, 0, None), (1, 1, "confidence"), (1, 2, "not_an_object"), (2, -1, "policy_key"), (3, -1, "no_findings"), (4, -1, "no_findings"),
        (5, 0, None), (5, 1, None),
    ]
    assert [r.entity_type for r in got if r.k == 5] == [None, "unknown"]


def test_chain_detects_tampering(spark):
    rows = [(f"s{k % 3}", k, f"e{k}", "a\"b" if k % 2 else None, "user", "t", '{"k":"é"}', "now") for k in range(30)]
    names = "session_id string, seq long, event_id string, actor_id string, actor_type string, event_type string, payload string, created_at string"
    chain = audit.build_chain(spark.createDataFrame(rows, names))
    previous = {}
    for r in chain.orderBy("seq").collect():
        envelope = {k: r[k] for k in audit.ENVELOPE} | {"payload": json.loads(r.payload), "previous_hash": previous.get(r.session_id)}
        text = json.dumps(envelope, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.event_hash == hashlib.sha256(text.encode()).hexdigest()
        previous[r.session_id] = r.event_hash
    assert audit.verify_chain(chain).where("linked AND intact").count() == 30
    forged = chain.where("seq <> 13").withColumn("event_type", F.when(F.col("seq") == 7, "x").otherwise(F.col("event_type")))
    bad = audit.verify_chain(forged).where("NOT linked OR NOT intact").orderBy("seq").collect()
    assert [(r.seq, r.linked, r.intact) for r in bad] == [(7, True, False), (16, False, True)]


def plain_projection(text):
    """Text for comparison and its ranges, by the rule: character by character, then runs of white space."""
    flat = [(c, k) for k, source in enumerate(text or "") for c in unicodedata.normalize("NFKC", "-" if source in "\xad\ufffe" else source).casefold()]
    runs = [(blank, list(run)) for blank, run in itertools.groupby(flat, key=lambda x: x[0].isspace())]
    runs = runs[1:] if runs and runs[0][0] else runs
    runs = runs[:-1] if runs and runs[-1][0] else runs
    out = [x for blank, run in runs for x in ([(" ", run[0][1], run[-1][1] + 1)] if blank else [(c, k, k + 1) for c, k in run])]
    return "".join(x[0] for x in out), [x[1] for x in out], [x[2] for x in out]


def plain_score(a, b):
    a, b = plain_projection(a)[0], plain_projection(b)[0]
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.65 + 0.35 * min(len(a), len(b)) / max(len(a), len(b))
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


TEXTS = st.text(alphabet="aAbßﬁ \t\xad\u3000é\ufffe½", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_projections_of_a_batch(texts):
    got = match.projections(texts)
    for k, text in enumerate(texts):
        assert (got[0][k], got[1][k].tolist(), got[2][k].tolist()) == plain_projection(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abc ", max_size=40))
def test_matched_characters(a, b):
    assert match.matched_characters(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_similarity(spark):
    rng = random.Random(4)
    words = ["Straße", "haus", "STRASSE", "of  the", "ﬁn", "inon", "erst"]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(60)]
    pairs += [("", "a"), (None, None), ("A b", "a  B "), ("x" * 3000, "x" * 2999 + "y"), ("ab" * 700, "ba" * 900)]
    frame = spark.createDataFrame(pairs, "a string, b string").withColumn("s", match.similarity("a", "b"))
    forms = frame.withColumns({"x": match.comparison_projection("a")["text"], "y": match.comparison_projection("b")["text"]})
    for r in forms.withColumn("near", match.may_matter(F.col("x"), F.col("y"))).collect():
        expected = plain_score(r.a, r.b)
        assert abs(r.s - expected) < 1e-12
        assert r.near or expected < 0.65


def test_fuzzy_ratio_compares_all_lines(spark, tmp_path):
    from palimpsest.plans import catalog

    rows = [(1, 0, "same\nabcd\n"), (1, 1, "same\nabce\n\nmore"), (1, 2, None), (2, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.line_no): r.ratio for r in catalog.QUERIES["fuzzy_ratio"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 1): 1, (1, 0, 2): 0.75, (1, 0, 3): 0, (1, 0, 4): 0, **{(1, 1, k): 0 for k in (1, 2, 3, 4)}}


def test_session_listing_numbers_sessions_in_several_tasks(spark, tmp_path):
    from palimpsest.plans import catalog

    spark.range(3000).selectExpr("id AS event_id", "id % 700 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = catalog.QUERIES["session_listing"](spark, str(tmp_path))
        got = sorted((r.position, r.updated) for r in frame.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(k + 1, 2999 - k) for k in range(700)]
    assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()


def test_projection_offsets(spark):
    rows = spark.createDataFrame([("Straße­1 \n ﬁn ",), ("  ",), (None,)], "t string")
    got = [r.p for r in rows.select(match.comparison_projection(F.col("t")).alias("p")).collect()]
    assert got[0].text == "strasse-1 fin" and got[0].starts[4:7] == [4, 4, 5] and got[0].ends[-1] == 13
    assert got[1].text == "" and got[2].text == ""


def test_greedy_assignment_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = [(g, i, j, rng.choice([0.1, 0.2, 0.3, 0.5]), rng.choice([0.0, 1.0])) for g in range(4) for i in range(9) for j in range(rng.randrange(8, 12)) if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "g long, left_id long, right_id long, distance double, aspect double")
    order = ("distance", "aspect", "left_id", "right_id")
    expected, used = set(), set()
    for g, i, j, d, _ in sorted(rows, key=lambda r: (r[3], r[4], r[1], r[2])):
        if d <= 0.3 and (g, "l", i) not in used and (g, "r", j) not in used:
            used |= {(g, "l", i), (g, "r", j)}
            expected.add((g, i, j))
    got = match.greedy_assignment(frame.repartition(3), "g", 0.3, order).collect()
    assert {(r.g, r.left_id, r.right_id) for r in got} == expected and len(got) == len(expected)
    assert match.greedy_assignment(frame.limit(0), "g", 1.0).count() == 0


def test_lines_without_a_place_are_looked_for_everywhere(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob\n\nBob left Ann\n"), (2, "Ann"), (3, None)], "doc_id long, text string")
    layers = [(1, "t1", "Bob", "[B]", 1), (1, "t99", "Ann", "Bob", 2), (1, "x", "left", "l", 3), (1, "t3", "Bob", "[3]", 4), (2, "t1", "Ann", "A", 5)]
    frame = spark.createDataFrame(layers, "doc_id long, line_id string, exact_text string, replacement string, at long")
    got = sorted((r.doc_id, r.line_id, r.redacted, r.n_layers) for r in redact.render_lines(docs, frame, "at").collect())
    assert got == [(1, "t1", "Bob met [B]", 3), (1, "t3", "[3] l [3]", 3), (2, "t1", "A", 1)]


def test_long_sessions_are_chained_over_batches(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS session_id", "id AS seq", "concat('e', id) AS event_id", "'a' AS actor_id", "'u' AS actor_type", "'t' AS event_type", "'{}' AS payload", "'now' AS created_at")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        chain = audit.build_chain(rows)
        assert audit.verify_chain(chain).where("linked AND intact").count() == 5000
        assert {r.event_count for r in audit.last_hash(chain).collect()} == {2500}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ('```json\n{"a": [{"b": 1]\n```', {"a": [{"b": 1}]}),
        ('{"a": 1\n```', None),
        ('{"findings":[{"a":1]} and {more', {"findings": [{"a": 1}]}),
        ('{"findings":[{"a":1]} and }', None),
        ('{"findings":[{"a":1],"b":[{"c":2]}', None),
        ('{"a": {"b": 1}', {"a": {"b": 1}}),
        ('{"a": "}', None),
        ('{"x": nope {"a": 1}} {"b": 2}', {"b": 2}),
        ('{"x": ] {"a": 1}', {"a": 1}),
        ('see "{" then {"a": "\\"}"}', None),
        ('say {"a": "\\"}"} now', {"a": '"}'}),
    ],
)
def test_objects_in_odd_texts(raw, found):
    got = extract.first_object(raw)
    assert (json.loads(got) if got else None) == found


def test_archives_and_binary_files(spark, tmp_path):
    rows = [("a", "x", 10, 10), ("b", "../x", 10, 10), ("c", "x", 10, 10), ("c", "X", 10, 10), ("d", "x", 60 << 20, 60 << 20), ("e", "x", 10**6, 10)]
    got = formats.archive_admission(spark.createDataFrame(rows, "p string, name string, size long, packed long"), "p").collect()
    assert {r.p: r.reason for r in got} == {"a": None, "b": "unsafe_name", "c": "duplicate_name", "d": "entry_too_large", "e": "ratio"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    (tmp_path / "in/b.bin").write_bytes(b"x" * 100)
    files = formats.read_binary(spark, str(tmp_path / "in"), 50).collect()
    assert [r.sha256 for r in files] == [hashlib.sha256(b"abc").hexdigest()]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "doc_id long, line_no int, redacted string")
    sinks.write_redacted(rows, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t/doc_id=1"), wholetext=True).collect()] == ["a\nb\n"]
    sinks.overwrite_sessions(rows, str(tmp_path / "s"), "doc_id")
    sinks.overwrite_sessions(rows.where("doc_id = 2").withColumn("redacted", F.lit("new")), str(tmp_path / "s"), "doc_id")
    assert sorted(r.redacted for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["a", "b", "new"]


def test_terminal_events_are_not_displaced(spark):
    rows = spark.createDataFrame([(1, 1, "progress"), (1, 2, "complete"), (1, 3, "progress"), (2, 4, "progress"), (2, 5, "progress")], "k long, seq long, e string")
    got = {r.k: (r.e, r.seq, r.n_events) for r in conflate.conflate(rows, "k", F.col("e") == "complete", F.col("seq"), ["e", "seq"]).collect()}
    assert got == {1: ("complete", 2, 3), 2: ("progress", 5, 2)}


def test_hydration_violations(spark):
    f = spark.createDataFrame([("f1", 1), ("f2", 1), ("f3", 1), ("f4", 1)], "finding_id string, s long")
    w = spark.createDataFrame([("f1", 1), ("f2", 2), ("f3", 1), ("f3", 1), ("f9", 1)], "finding_id string, s long")
    got = {r.finding_id: r.reason for r in review.integrity_violations(f, w, "finding_id", "s").collect()}
    assert got == {"f2": "cross_session", "f3": "several_layers", "f4": "missing_layer", "f9": "orphan_layer"}


def test_all_starts(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice("ab\\E.é😀") for _ in range(rng.randrange(30))), "".join(rng.choice("ab\\E.é😀") for _ in range(rng.randrange(4)))) for _ in range(200)]
    rows += [("aaa", "aa"), ("", "a"), ("x\\Ey", "\\E"), (None, "a")]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("s", X.all_starts(F.col("a"), F.col("b"))).collect():
        expected = [k for k in range(len(r.a or "")) if r.b and r.a.startswith(r.b, k)]
        assert r.s == expected, (r.a, r.b)


def test_edits_meet_their_lines_whatever_the_block(spark):
    rng = random.Random(12)
    docs, layers, expected = [], [], {}
    for d, n in enumerate([1, 63, 64, 65, 128, 200, 0]):
        lines = [f"a{rng.randrange(3)} b c{k}" for k in range(n)]
        docs.append((d, "\n".join(lines) + "\n" * (d % 2)))
        edits = [(rng.choice(["a0", "b", "c1", "X"]), rng.choice(["X", "b", ""]), rng.choice([rng.randrange(1, n + 3), rng.randrange(1, 1000), None])) for _ in range(40)]
        layers += [(d, f"t{no}" if no else "p1", old, new, f"{at:03d}") for at, (old, new, no) in enumerate(edits)]
        for k, text in enumerate(lines, 1):
            own = [(old, new) for old, new, no in edits if no == k or not no or no > n]
            for old, new in own:
                text = text.replace(old, new)
            expected[d, k] = (text, len(own))
    frame = spark.createDataFrame(layers, "doc_id long, line_id string, exact_text string, replacement string, at string").repartition(3)
    got = redact.render_lines(spark.createDataFrame(docs, "doc_id long, text string"), frame, "at").collect()
    assert {(r.doc_id, r.line_no): (r.redacted, r.n_layers) for r in got} == expected


def test_items_are_checked_by_their_json_types(spark):
    base = {"entity_type": "email", "line_id": "t1", "exact_text": "x"}
    cases = [
        ({"label": None}, "label"), ({"entity_type": 7}, "entity_type"), ({"data_subject_context": "nonsense"}, "data_subject_context"),
        ({"confidence": True}, None), ({"confidence": "0_1.5e-1"}, None), ({"confidence": "1d"}, "confidence"), ({"confidence": "inf"}, "confidence"), ({"confidence": None}, None),
        ({"description": ["a"]}, "description"), ({"reason": False}, "reason"), ({"line_id": {}}, "line_id"), ({"line_id": {"a": 1}}, None), ({"exact_text": 0.0}, "exact_text"),
    ]
    rows = [(k, json.dumps({"findings": [base | change]})) for k, (change, _) in enumerate(cases)]
    got = {r.k: r for r in extract.items(spark.createDataFrame(rows, "k long, raw string"), "k", "raw").collect()}
    assert [got[k].reject for k in range(len(cases))] == [want for _, want in cases]
    assert (got[3].confidence, got[4].confidence, got[7].confidence) == (1.0, 0.15, None)
    audio = [({"start_time": "1.0", "end_time": "2.5"}, None), ({"start_time": 0, "end_time": True}, None), ({"start_time": 1}, "audio_range"), ([1, 2], "audio_range"),
             ({"start_time": -1, "end_time": 1}, "audio_range"), ({"start_time": "nan", "end_time": 1}, "audio_range"), ({"start_time": 2, "end_time": 2}, "audio_range"), ({"start_time": "x", "end_time": 2}, "audio_range")]
    rows = [(k, json.dumps({"findings": [{"audio_range": r}]})) for k, (r, _) in enumerate(audio)]
    found = extract.items(spark.createDataFrame(rows, "k long, raw string"), "k", "raw", "audio").orderBy("k").collect()
    assert [r.reject for r in found] == [want for _, want in audio]
    assert (found[0].start_time, found[0].end_time, found[1].end_time) == (1.0, 2.5, 1.0)
    region = [({"x": "0.5", "width": True}, None, 0.5), ({"x": 1}, "target_region", None), ("none", "target_region", None), ({"x": "?", "y": None}, None, 0.0)]
    rows = [(k, json.dumps({"findings": [{"target_region": r}]})) for k, (r, _, _) in enumerate(region)]
    found = extract.items(spark.createDataFrame(rows, "k long, raw string"), "k", "raw", "image").orderBy("k").collect()
    assert [(r.reject, r.region and r.region.x) for r in found] == [(want, x) for _, want, x in region]


def test_keys_are_found_at_any_depth(spark):
    deep = '{"a":' * 200 + '{"te\\u0078t":1}' + "}" * 200
    rows = [(1, '{"x":[{"y":{"text":"a"}}]}'), (2, '{"x":"\\"text\\":1"}'), (3, deep), (4, '{"filename":1,"reason":2}'), (5, "{text"), (6, None), (7, '["text"]'), (8, json.dumps({"a": '\\"' * 20_000, "text": 1}))]
    got = {r.k: r.forbidden_key for r in audit.forbidden_keys(spark.createDataFrame(rows, "k long, p string"), "p", ["text", "reason", "filename"]).collect()}
    assert got == {1: "text", 2: None, 3: "text", 4: "filename", 5: None, 6: None, 7: None, 8: "text"}


def test_signatures_are_hmacs(spark):
    import hmac

    for key in (b"k", b"x" * 64, b"y" * 100):
        for message in ("", "a", "é漢" * 100):
            assert one(spark, audit.hmac_sha256(key, F.lit(message))) == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_batches_of_long_sources_are_cut_in_blocks(spark):
    rng = random.Random(13)
    rows, expected = [], []
    for d in range(60):
        no, cost = 0, []
        for _ in range(rng.choice([1, 5, 40, 200])):
            no += rng.choice([1, 1, 2, 30])
            cost.append((no, rng.choice([0, 1, 3, 10, 50, 100] + [101] * (d % 20 == 0))))
        rows += [(d, n, c) for n, c in cost]
        if max(c for _, c in cost) > 100:
            expected.append((d, 0, cost[0][0], cost[-1][0], len(cost), max(c for _, c in cost)))
            continue
        batch = []
        found = [batch]
        for n, c in cost:
            if sum(x for _, x in batch) + c > 100:
                batch = []
                found.append(batch)
            batch.append((n, c))
        expected += [(d, k, b[0][0], b[-1][0], len(b), sum(c for _, c in b)) for k, b in enumerate(found, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, line_no long, cost long").repartition(5)
    for block in (1, 7, 64, 1024):
        got = lines.batches(frame, 100, block_lines=block).select("doc_id", "batch", "first_line", "last_line", "n_lines", "cost").collect()
        assert sorted(map(tuple, got)) == sorted(expected), block
    assert lines.batches(frame.limit(0), 100).count() == 0


def test_case_folding_is_full(spark):
    """Every character by itself, and words; the dotless i keeps apart from i."""
    characters = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    words = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁn ﬃ", "ıI İ", "ſpeak", "ŉ", "ΐ", "", "Ꭰꭰ"]
    rows = spark.createDataFrame([(x,) for x in characters + words], "x string").withColumn("y", X.casefold(F.col("x"))).collect()
    known = lambda x: all(unicodedata.category(c) != "Cn" for c in x)
    assert [r.y for r in rows if known(r.x)] == [r.x.casefold() for r in rows if known(r.x)]
    assert one(spark, X.casefold(F.lit("ı"))) == "ı" != one(spark, X.casefold(F.lit("I")))
