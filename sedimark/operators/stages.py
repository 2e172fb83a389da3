"""Runs of a pipeline of stages: durations, shares, worst status, what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses from best to worst, our own names.
SEVERITY = ["ok", "skipped", "degraded", "failed"]


def durations(traces: DataFrame, run: str = "run", stage: str = "stage") -> DataFrame:
    """run, stage, ms, share of the run (at least 2 % for display), status (the worst), steps."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    per = traces.groupBy(run, stage).agg(F.sum("ms").alias("ms"), F.max(rank).alias("worst"), F.count("*").alias("steps"))
    share = F.greatest(F.lit(0.02), F.col("ms") / F.sum("ms").over(Window.partitionBy(run)))
    return per.select(run, stage, "ms", share.alias("share"), F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("worst").cast("int")).alias("status"), "steps")


#: Steps that a plan has at most.
MOST_STEPS = 1000


def next_step(plan: DataFrame, traces: DataFrame, run: str = "run") -> DataFrame:
    """The first step of the plan (step, ord) that a run has no trace of; runs that are through have none."""
    steps = [r["step"] for r in plan.orderBy("ord").limit(MOST_STEPS + 1).collect()]
    if len(steps) > MOST_STEPS:
        raise ValueError(f"a plan of more than {MOST_STEPS} steps")
    taken = traces.groupBy(run).agg(F.collect_set(F.when(F.col("step").isin(steps), F.col("step"))).alias("taken"))
    todo = F.filter(F.array(*[F.lit(s) for s in steps]).cast("array<string>"), lambda s: ~F.array_contains("taken", s))
    return taken.where(F.size(todo) > 0).select(run, F.get(todo, F.lit(0)).alias("next_step"))


def filled_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Filled fields of each row, and how many there are: null, empty texts and empty arrays are not filled."""
    kinds = dict(rows.dtypes)
    full = [F.col(f).isNotNull() & (F.size(f) > 0 if kinds[f].startswith("array") else F.col(f).cast("string") != "") for f in fields]
    return rows.withColumn("filled", sum((x.cast("int") for x in full), F.lit(0))).withColumn("fields", F.lit(len(fields)))


def batches(rows: DataFrame, key: str, order: str, size: int = 6) -> DataFrame:
    """Rows of a document in batches of ``size`` by an order: batch, place."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("n", n).withColumn("batch", F.floor(F.col("n") / size)).withColumn("place", F.col("n") % size).drop("n")


def mean_of_successes(runs: DataFrame, value: str = "ms", error: str = "error") -> DataFrame:
    """One row: runs, successes (no error) and the mean of their ``value``, 0 without any."""
    ok = F.col(error).isNull()
    return runs.agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.coalesce(F.avg(F.when(ok, F.col(value))), F.lit(0.0)).alias("mean"))


def spans(events: DataFrame, kinds: dict[str, str], run: str, ts: str, event: str, tie: str) -> DataFrame:
    """run, stage, status, start_ms, duration_ms: the batch twin of the stream's spans, by the event after each start."""
    rows = events.where(F.col(event).isin(list(kinds))).select(F.col(run).cast("bigint").alias("run"), F.unix_millis(F.col(ts).cast("timestamp")).alias("start_ms"), F.col(event).alias("stage"), F.col(tie).alias("tie"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    w = Window.partitionBy("run").orderBy("start_ms", "tie")
    rows = rows.withColumn("next_ms", F.lead("start_ms").over(w)).withColumn("closer", F.lead(kind[F.col("stage")]).over(w))
    closed = rows.where((kind[F.col("stage")] == "start") & F.col("next_ms").isNotNull())
    return closed.select("run", "stage", F.when(F.col("closer") == "failure", "failed").otherwise("done").alias("status"), "start_ms", (F.col("next_ms") - F.col("start_ms")).alias("duration_ms"))
