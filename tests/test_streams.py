"""Streams with state, in parts and over restarts, against plain versions."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException

from palimpsest.operators import audit
from palimpsest.streaming import stateful

EVENT = "session_id string, seq long, event_id string, actor_id string, actor_type string, event_type string, payload string, created_at string"


def events(low, high):
    return [(f"s{k % 4}", k, f"e{k}", None if k % 5 == 0 else "a", "user", "t", '{"k":"é"}', "now") for k in range(low, high)]


def test_a_chain_goes_on_over_restarts(spark):
    whole = spark.createDataFrame(events(0, 60), EVENT)
    parts = [spark.createDataFrame(events(a, b), EVENT).repartition(2) for a, b in ((0, 1), (1, 30), (30, 60))]
    got = stateful.run_in_parts(parts, stateful.chained)
    want = audit.build_chain(whole).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert audit.verify_chain(got).where("linked AND intact").count() == 60
    late = [spark.createDataFrame(events(10, 20), EVENT), spark.createDataFrame(events(0, 9), EVENT)]
    with pytest.raises(StreamingQueryException):
        stateful.run_in_parts(late, stateful.chained)


class PlainQueue:
    """One place, written down from the rule: close beats all, a terminal item is not displaced by progress."""

    def __init__(self):
        self.place, self.closed, self.asked = None, False, False

    def do(self, op, item, terminal):
        if self.closed:
            return ("closed", None) if op == "drain" else None
        if op == "close":
            self.place, self.closed = None, True
            return ("closed", None) if self.asked else None
        if op == "drain":
            if self.place:
                (item, _), self.place = self.place, None
                return ("item", item)
            self.asked = True
            return None
        if self.asked:
            self.asked = False
            return ("item", item)
        if not (self.place and self.place[1] and not terminal):
            self.place = (item, terminal)
        return None


def test_queues_of_one_place(spark):
    rng = random.Random(1)
    rows, want, plain = [], [], {}
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    for seq in range(600):
        who = rng.randrange(12)
        op = rng.choices(["publish", "drain", "close"], [6, 3, 0.3])[0]
        terminal = rng.random() < 0.3
        rows.append((who, start + datetime.timedelta(seconds=seq), seq, op, f"i{seq}", terminal))
        if told := plain.setdefault(who, PlainQueue()).do(op, f"i{seq}", terminal):
            want.append((who, seq, *told))
    frame = lambda part: spark.createDataFrame(part, "who long, ts timestamp, seq long, op string, item string, terminal boolean").repartition(2)
    got = stateful.run_in_parts([frame(rows[:100]), frame(rows[100:350]), frame(rows[350:])], lambda s: stateful.queues(s, "who"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[2] == "closed" for w in want)


def test_a_closed_queue_is_forgotten_in_time(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)
    parts = [[(1, at(0), 0, "close", None, False)], [(1, at(1), 1, "drain", None, False), (2, at(300), 2, "publish", "x", False)], [(2, at(301), 3, "drain", None, False)], [(1, at(302), 4, "publish", "y", False), (1, at(303), 5, "drain", None, False)]]
    frames = [spark.createDataFrame(p, "who long, ts timestamp, seq long, op string, item string, terminal boolean") for p in parts]
    got = stateful.run_in_parts(frames, lambda s: stateful.queues(s, "who", "1 minute", 60_000))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "closed", None), (1, 5, "item", "y"), (2, 3, "item", "x")]
