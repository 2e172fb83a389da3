"""Alerts and traces that need state and event-time timers.

A window without events, a span that a later event closes: both are known only once the
watermark has passed them, so a timer settles them. Rows older than the watermark are out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """An alert on windows of ``width`` seconds of the events that ``where`` (SQL) holds for.

    kind: ``fewer`` or ``more`` events than ``threshold``, or a ``mean`` of the value above it. Windows
    without events count for ``fewer`` alone, from the first event on and up to ``give_up`` of them in a row; then
    the rule sleeps until the next event.
    """

    name: str
    where: str
    kind: str
    threshold: float
    width: int
    give_up: int = 96


# The alerts on a service's log as its operators set them: what counts, the threshold, minutes.
SERVICE_RULES = [
    Rule("silence", "true", "fewer", 1, 900),
    Rule("errors", "level = 'error'", "more", 3, 600),
    Rule("overload", "code = 'surcharge'", "more", 10, 300),
    Rule("latency", "event = 'distillation'", "mean", 15_000, 900),
    Rule("engine", "code = 'moteur_indisponible'", "more", 0, 300),
    Rule("refused_keys", "event = 'cleRefusee'", "more", 5, 300),
]
ALERT = "rule string, start_ms bigint, events bigint, mean_value double"


class _Alerts(StatefulProcessor):
    """Per rule: counts and sums of the windows that the watermark has not passed, the next window to settle, and empty ones in a row."""

    def __init__(self, rules: list[Rule]):
        self.rules = {r.name: r for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start bigint", "n bigint, total double")
        self.next = handle.getValueState("next", "start bigint, empty bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        width, first = self.rules[key[0]].width * 1000, None
        at = self.next.get()[0] if self.next.exists() else None
        for r in rows:
            if at is not None and r.start < at and r.start + width <= timerValues.getCurrentWatermarkInMs():
                continue
            n, total = self.windows.getValue((r.start,)) if self.windows.containsKey((r.start,)) else (0, 0.0)
            self.windows.updateValue((r.start,), (n + r.n, total + r.total))
            first = r.start if first is None else min(first, r.start)
        if first is not None and (at is None or first < at):
            if at is not None:
                self.handle.deleteTimer(at + width)
            self.next.update((first, 0))
            self.handle.registerTimer(first + width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        rule, mark = self.rules[key[0]], timerValues.getCurrentWatermarkInMs()
        width = rule.width * 1000
        at, empty = self.next.get()
        out = []
        while at + width <= mark:
            n, total = self.windows.getValue((at,)) if self.windows.containsKey((at,)) else (0, 0.0)
            if n:
                self.windows.removeKey((at,))
            empty = 0 if n else empty + 1
            mean = total / n if n else None
            if rule.kind == "fewer" and n < rule.threshold or rule.kind == "more" and n > rule.threshold or rule.kind == "mean" and n and mean > rule.threshold:
                out.append(Row(rule=key[0], start_ms=at, events=n, mean_value=mean))
            at += width
            if empty >= rule.give_up or rule.kind != "fewer" and empty:
                pending = [k[0] for k in self.windows.keys()]
                if not pending:
                    self.next.clear()
                    return iter(out)
                at, empty = min(pending), 0
        self.next.update((at, empty))
        self.handle.registerTimer(at + width)
        return iter(out)

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, rules: list[Rule], lateness: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """rule, start_ms (of the window), events, mean_value of the windows that a rule warns of.

    Each task adds up its rows by rule and window before anything is shuffled, so a rule that all events
    fall under brings a few rows a task. The state of a rule is the windows within ``lateness`` of the latest event.
    """
    ship(stream.sparkSession)
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    hit = F.array(*[F.when(F.expr(r.where), F.struct(F.lit(r.name).alias("rule"), (F.floor(ms / (r.width * 1000)) * (r.width * 1000)).alias("start"))) for r in rules])
    rows = stream.select(F.explode(F.filter(hit, lambda h: h.isNotNull())).alias("h"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def summed() -> pd.DataFrame:
            return pd.concat(held).groupby(["rule", "start"], as_index=False).agg({"ts": "max", "n": "sum", "total": "sum"})

        for batch in batches:
            part = batch.to_pandas()
            part["n"], part["total"] = 1, part["value"].fillna(0.0)
            held.append(part.groupby(["rule", "start"], as_index=False).agg({"ts": "max", "n": "sum", "total": "sum"}))
            if len(held) == 64:
                held[:] = [summed()]
        if held:
            yield pa.RecordBatch.from_pandas(summed()[["rule", "start", "ts", "n", "total"]], preserve_index=False)

    sums = rows.select("h.rule", "h.start", "ts", "value").mapInArrow(add_up, "rule string, start bigint, ts timestamp, n bigint, total double")
    return sums.withWatermark("ts", lateness).groupBy("rule").transformWithState(_Alerts(rules), ALERT, "Append", "EventTime")


SPAN = "run bigint, stage string, status string, start_ms bigint, duration_ms bigint"


class _Spans(StatefulProcessor):
    """Per run: the open stage, and the rows that the watermark has not passed, since rows come in any order."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "stage string, start bigint")
        self.ahead = handle.getListState("ahead", "at bigint, tie bigint, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        before = [tuple(r) for r in self.ahead.get()] if self.ahead.exists() else []
        new = [(r.at, r.tie, r.event) for r in rows]
        self.ahead.put(before + new)
        first = min(r[0] for r in before + new)
        if not before or first < min(r[0] for r in before):
            if before:
                self.handle.deleteTimer(min(r[0] for r in before) + 1)
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(tuple(r) for r in self.ahead.get())
        stage, start = self.open.get() if self.open.exists() else (None, None)
        for at, _, event in rows:
            if at >= mark:
                break
            kind = self.kinds[event]
            if stage is not None:
                out.append(Row(run=key[0], stage=stage, status="failed" if kind == "failure" else "done", start_ms=start, duration_ms=at - start))
            stage, start = (event, at) if kind == "start" else (None, None)
        if stage is None:
            self.open.clear()
        else:
            self.open.update((stage, start))
        rest = [r for r in rows if r[0] >= mark]
        if rest:
            self.ahead.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
        else:
            self.ahead.clear()
        return iter(out)

    def close(self) -> None:
        pass


def spans(stream: DataFrame, kinds: dict[str, str], lateness: str, run: str, ts: str, event: str, tie: str) -> DataFrame:
    """run, stage, status, start_ms, duration_ms of the stages that are over.

    kinds: per event ``start`` (opens a stage of its name and closes the open one as done), ``end`` (closes it) or
    ``failure`` (closes it as failed); other events, and failures and ends with nothing open, say nothing. Rows at the same
    millisecond count in order of ``tie``. A run keeps its open stage and the rows within ``lateness`` of the latest one.
    """
    ship(stream.sparkSession)
    rows = stream.where(F.col(event).isin(list(kinds))).select(F.col(run).cast("bigint").alias("run"), F.col(ts).cast("timestamp").alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("bigint").alias("tie"), F.col(event).alias("event"))
    return rows.withWatermark("ts", lateness).groupBy("run").transformWithState(_Spans(kinds), SPAN, "Append", "EventTime")


def with_store(spark, work: Callable[[], DataFrame]) -> DataFrame:
    """``work`` with the state store that timers need; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        return work()
    finally:
        spark.conf.set(key, before)
