"""Stateful streams over several batches, rows out of order within the lateness, against plain Python."""

import random
from collections import deque
from datetime import UTC, datetime, timedelta

from sedimark.operators import logs, stages
from sedimark.streaming import monitors, state

KIND = "id bigint, ts timestamp, run bigint, event string, value double"
START = datetime(2024, 1, 1, tzinfo=UTC)
KINDS = {"a": "start", "b": "start", "end": "end", "bad": "failure"}


def made(seed, n=240):
    """Rows of four hours; none in two of the quarters of the last two."""
    r = random.Random(seed)
    rows = [(i, r.randrange(4 * 3600_000), r.randrange(3), r.choice([*KINDS, "other"]), r.choice([1.0, 50.0])) for i in range(n)]
    return sorted((x for x in rows if not 7_500_000 < x[1] < 9_400_000), key=lambda x: x[1] + r.randrange(600_000))


def streamed(spark, rows, folder, parts):
    at = len(rows) // parts + 1
    for k in range(parts):
        some = [(i, START + timedelta(milliseconds=ms), run, event, value) for i, ms, run, event, value in rows[k * at : (k + 1) * at]]
        spark.createDataFrame(some, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def base():
    return int(START.timestamp() * 1000)


def test_alerts_of_windows_that_the_watermark_passed(spark, tmp_path):
    rows = made(1)
    rules = [state.Rule("none", "event = 'a'", "fewer", 1, 900), state.Rule("many", "true", "more", 12, 600), state.Rule("high", "event = 'b'", "mean", 30, 900)]
    stream = streamed(spark, rows, tmp_path, 4)
    out = state.with_store(spark, lambda: monitors.drain(state.alerts(stream, rules, "20 minutes"), ["rule", "start_ms"], str(tmp_path / "out"), "append"))
    got = {(r.rule, r.start_ms - base(), r.events) for r in out.collect()}
    mark, want = max(r[1] for r in rows) - 20 * 60_000, set()
    for rule, fits, width, holds in (("none", lambda e: e == "a", 900_000, lambda v: not v), ("many", lambda e: True, 600_000, lambda v: len(v) > 12), ("high", lambda e: e == "b", 900_000, lambda v: v and sum(v) / len(v) > 30)):
        mine = [(ms, v) for _, ms, _, e, v in rows if fits(e)]
        at = min(ms for ms, _ in mine) // width * width
        while at + width <= mark:
            values = [v for ms, v in mine if at <= ms < at + width]
            want |= {(rule, at, len(values))} if holds(values) else set()
            at += width
    assert got == want and len({r for r, _, _ in got}) == 3


def test_a_silent_rule_sleeps(spark, tmp_path):
    rows = [(0, 0, 0, "a", 1.0), (1, 10_000_000, 0, "x", 1.0), (2, 20_000_000, 0, "a", 1.0), (3, 30_000_000, 0, "x", 1.0)]
    rules = [state.Rule("none", "event = 'a'", "fewer", 1, 900, give_up=3), state.Rule("all", "true", "more", 99, 900)]
    stream = streamed(spark, rows, tmp_path, 4)
    out = state.with_store(spark, lambda: monitors.drain(state.alerts(stream, rules, "1 minute"), ["rule", "start_ms"], str(tmp_path / "out"), "append"))
    assert sorted((r.start_ms - base()) // 900_000 for r in out.collect()) == [1, 2, 3, 23, 24, 25]


def test_spans_close_by_the_next_event(spark, tmp_path):
    rows = made(2)
    stream = streamed(spark, rows, tmp_path, 4)
    out = state.with_store(spark, lambda: monitors.drain(state.spans(stream, KINDS, "20 minutes", "run", "ts", "event", "id"), ["run", "start_ms", "stage"], str(tmp_path / "out"), "append"))
    batch = stages.spans(spark.read.parquet(f"{tmp_path}/in"), KINDS, "run", "ts", "event", "id")
    mark = base() + max(r[1] for r in rows if r[3] in KINDS) - 20 * 60_000
    show = lambda d: {tuple(r) for r in d.collect()}
    whole = show(batch)
    assert show(out) == {r for r in whole if r[3] + r[4] < mark}
    want, open_ = set(), {}
    for i, ms, run, event, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if event in KINDS:
            if run in open_:
                want.add((run, open_[run][0], "failed" if event == "bad" else "done", open_[run][1], base() + ms - open_[run][1]))
                del open_[run]
            if KINDS[event] == "start":
                open_[run] = (event, base() + ms)
    assert whole == want


def test_breaker_counts_anew_after_it_opens(spark):
    r = random.Random(5)
    rows = [(i, r.choice([0, 0, 0, 1, None]), r.randrange(4000) + (5000 if i % 3 else 0)) for i in range(400)]
    events = spark.createDataFrame([(i, k, START + timedelta(seconds=s), 9) for i, k, s in rows], "id bigint, key int, ts timestamp, run int").repartition(5)
    got = {tuple(x) for x in logs.breaker(events, "key", "ts", "id", 60, 3).collect()}
    want = set()
    for key in (0, 1, None):
        recent = deque()
        for i, _, s in sorted((x for x in rows if x[1] == key), key=lambda x: (x[2], x[0])):
            recent = deque([t for t in recent if s - t < 60] + [s])
            if len(recent) > 3:
                want.add((key, i))
                recent.clear()
    assert got == want and len(got) > 10
    assert logs.breaker(events.where("false"), "key", "ts", "id", 60, 3).collect() == []
