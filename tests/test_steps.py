"""Step pipelines: combinators, pauses, caches, events."""

import time

import pytest
from pyspark.sql import functions as F

from spindrel.plans import pipeline as P


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "bb", "y"), (3, None, "z")], "id long, text string, key string")


def test_alternatives_feed_forward_and_without_acceptance_the_last_wins(docs):
    plus = lambda c: lambda x: F.concat(x, F.lit(c))
    of = lambda f: [r[0] for r in docs.orderBy("id").select(f(F.col("text"))).collect()]
    assert of(P.with_alternatives(F.upper, plus("B"))) == ["AB", "BBB", None]
    assert of(P.with_alternatives(F.upper, plus("B"), accept=lambda x: F.length(x) > 1)) == ["AB", "BB", None]
    assert of(P.with_alternatives(F.upper, plus("B"), feed_forward=False)) == ["aB", "bbB", None]
    assert of(P.pipe_steps(F.upper, plus("!"), F.reverse)) == ["!A", "!BB", None]
    with pytest.raises(ValueError):
        P.with_alternatives()


def test_combinators_of_twelve_steps_stay_small(docs):
    began = time.perf_counter()
    steps = [lambda x: F.concat(x, F.lit("-"))] * 12
    rows = docs.select(P.with_sequence(*steps, stop=lambda x: F.length(x) > 9)(F.col("text")).alias("s"), P.with_alternatives(*steps)(F.col("text")).alias("a")).collect()
    assert {(r.s, r.a) for r in rows} == {("a" + "-" * 9, "a" + "-" * 12), ("bb" + "-" * 8, "bb" + "-" * 12), (None, None)}
    assert time.perf_counter() - began < 20


def test_python_forms_hand_pauses_on():
    wait = lambda x: P.Outcome(reason="wait", payload=x)
    up, bang = str.upper, lambda x: x + "!"
    assert P.sequence_steps(up, bang)("a").value == "A!"
    assert P.sequence_steps(up, bang, stop=lambda x: x == "A")("a").value == "A"
    assert P.sequence_steps(up, wait, bang)("a") == P.Outcome(reason="wait", payload="A")
    assert P.alternative_steps(up, bang, accept=lambda x: len(x) > 1)("a").value == "A!"
    assert P.alternative_steps(up, wait)("a").reason == "wait"


def test_retry_timeout_and_cache():
    calls = []

    def slow(x):
        calls.append(x)
        time.sleep(0.3)
        return x + 1

    assert P.with_timeout(slow, 0.05)(1).reason == "timeout"
    assert P.with_timeout(slow, 5)(1).value == 2 and P.with_timeout(slow, 0)(1).value == 2
    assert P.with_retry(P.with_error_handling(lambda x: 1 / 0), 2)(1) == P.Outcome(reason="retryExceeded", payload=1, attempts=3)
    assert P.with_retry(P.with_timeout(slow, 0.05), 2)(1).reason == "timeout"  # other pauses aren't tried again
    calls.clear()
    kept = P.with_cache(slow, key=lambda x: x % 2)
    assert [kept(x).value for x in (1, 3, 2)] == [2, 2, 3] and calls == [1, 2]
    pausing = P.with_cache(lambda x: P.Outcome(reason="wait"), key=lambda x: x)
    assert not pausing(1).done and not pausing.memory


def test_cached_keeps_columns_and_null_keys(docs):
    made = lambda keys: keys.select("key", F.coalesce(F.upper("key"), F.lit("none")).alias("made"))
    got = P.cached(docs, F.col("text"), made, "made")
    assert got.columns == ["id", "text", "key", "made"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "x", "A"), (2, "bb", "y", "BB"), (3, None, "z", "none")]


def test_next_step_by_step_and_resume(docs):
    p = P.Pipeline().add("up", F.upper).add("gate", lambda x: x, lambda x: F.when(F.length(x) > 1, "long")).add("bang", lambda x: F.concat(x, F.lit("!")))
    now = p.start(docs.select("id", "text"), F.col("text"))
    for _ in range(3):
        now = p.next(now)
    assert {(r.id, r.doc, r.status, r.next_step) for r in now.collect()} == {(1, "A!", "done", 3), (2, "BB", "paused", 1), (3, None, "done", 3)}
    free = P.Pipeline().add("up", F.upper).add("gate", lambda x: x).add("bang", lambda x: F.concat(x, F.lit("!")))
    assert {r.doc for r in free.run(free.resumed(now)).collect()} == {"A!", "BB!", None}


def test_events_of_many_steps_take_no_longer_than_the_run(docs):
    p = P.Pipeline()
    for k in range(8):
        p = p.add(f"s{k}", lambda x: F.concat(F.upper(x), F.lit("-")), lambda x: F.when(F.length(x) > 8, "long"))
    start = docs.withColumn("__doc", F.lit(1))
    began = time.perf_counter()
    ran = p.run(p.start(start, F.col("text"))).collect()
    once = time.perf_counter()
    events = p.events(p.start(start, F.col("text"))).collect()
    assert time.perf_counter() - once < 2 * (once - began) + 3
    for r in ran:
        last = max((e for e in events if e.id == r.id), key=lambda e: e.step)
        assert (last.doc, last.next_step, last.reason) == (r.doc, r.next_step, r.reason)
    assert len(events) == 8 + 8 + 8 and {e["__doc"] for e in events} == {1}


def test_tap_changes_nothing(docs):
    assert P.tap(docs, "sizes", F.count("*").alias("n")).collect() == docs.collect()


def test_a_failed_step_is_an_error_event_and_the_doc_goes_on(docs):
    p = P.Pipeline().add("number", lambda x: x.try_cast("int").cast("string")).add("up", F.upper)
    events = {(e.id, e.step): (e.type, e.doc) for e in p.events(p.start(docs, F.col("text"))).collect()}
    assert events[1, 0] == ("error", "a") and events[1, 1] == ("progress", "A") and events[3, 0] == ("progress", None)
