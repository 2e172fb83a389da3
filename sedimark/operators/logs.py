"""Log records: flattening, windowed alerts, sliding counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField, StructType

from ..session import ship


def flatten(rows: DataFrame, record: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a struct as columns: _x for strings, _x_num for numbers, _x_bool for booleans (as text); points in names become _.

    One level of structs is taken, its names joined by _; what lies deeper, arrays and the fields of ``skip`` are left out.
    """
    out: list[Column] = []

    def walk(kind: StructType, path: str, name: str, deeper: bool) -> None:
        for f in kind.fields:
            at, as_name = F.col(f"{path}.`{f.name}`"), f"{name}_{f.name.replace('.', '_')}"
            if isinstance(f.dataType, StructType):
                if deeper:
                    walk(f.dataType, f"{path}.`{f.name}`", as_name, False)
            elif isinstance(f.dataType, NumericType):
                out.append(at.cast("double").alias(f"{as_name}_num"))
            elif isinstance(f.dataType, BooleanType):
                out.append(at.cast("string").alias(f"{as_name}_bool"))
            elif isinstance(f.dataType, StringType) and not (path == record and f.name in skip):
                out.append(at.alias(as_name))

    kind = rows.schema[record].dataType
    walk(StructType([f for f in kind.fields if f.name not in skip]), record, "", True)
    return rows.select(*[c for c in rows.columns if c != record], *out)


# Severities and names of numeric log levels, those of any other level, the message of a line without one, and the fields that the envelope takes up.
LEVELS = {10: (7, "trace"), 20: (7, "debug"), 30: (6, "info"), 40: (4, "warn"), 50: (3, "error"), 60: (2, "fatal")}
OTHER_LEVEL, NO_MESSAGE, ENVELOPE = (6, "info"), "(sans message)", ("level", "time", "msg", "hostname", "pid")


def severity(level: Column) -> Column:
    """struct(level, name) of a numeric log level; null and unknown ones count as info."""
    made = lambda pair: F.struct(F.lit(pair[0]).alias("level"), F.lit(pair[1]).alias("name"))
    out = made(OTHER_LEVEL)
    for number, pair in LEVELS.items():
        out = F.when(level == number, made(pair)).otherwise(out)
    return out


def envelope(lines: DataFrame, line: str, schema: StructType, fixed: dict[str, str], now: Column) -> DataFrame:
    """Log lines (JSON) as messages to ship: the columns of ``lines`` but ``line``, those of ``fixed``, version, short_message, timestamp (seconds), level,
    _niveau, _conteneur (the host name), and all other fields of ``schema`` as ``flatten`` names them. Lines that are no JSON object are left out; a field of another
    type than the schema says is null. ``now``: the time in milliseconds of lines without one.
    """
    bad = "_bad"
    names = {f.name for f in schema.fields}
    given = StructType([*schema.fields, StructField(bad, StringType())])
    rows = lines.withColumn("_r", F.from_json(line, given, {"columnNameOfCorruptRecord": bad})).where(F.col("_r").isNotNull() & F.col(f"_r.{bad}").isNull()).drop(line)
    field = lambda name, kind: F.col(f"_r.{name}") if name in names else F.lit(None).cast(kind)
    s = severity(field("level", "bigint"))
    made = rows.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit("1.1").alias("version"), F.coalesce(field("msg", "string"), F.lit(NO_MESSAGE)).alias("short_message"), (F.coalesce(field("time", "bigint"), now) / 1000).alias("timestamp"), s["level"].alias("level"), s["name"].alias("_niveau"), field("hostname", "string").alias("_conteneur"))
    return flatten(made, "_r", (*ENVELOPE, bad))


def alert_counts(events: DataFrame, width: str, most: int) -> DataFrame:
    """Windows with more than ``most`` events: start_ts, events."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("events")).where(F.col("events") > most).select(F.col("w.start").alias("start_ts"), "events")


def alert_means(events: DataFrame, width: str, value: str, most: float) -> DataFrame:
    """Windows whose mean value is above ``most``: start_ts, mean_value."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.avg(value).alias("mean_value")).where(F.col("mean_value") > most).select(F.col("w.start").alias("start_ts"), "mean_value")


def alert_absence(events: DataFrame, width: str) -> DataFrame:
    """Windows between the first and the last event without any: start_ts."""
    seen = events.select(F.window("ts", width)["start"].alias("start_ts")).distinct()
    span = seen.agg(F.min("start_ts").alias("a"), F.max("start_ts").alias("b"))
    every = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("start_ts"))
    return every.join(seen, "start_ts", "left_anti")


def sliding_counts(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the seconds up to it, itself included: recent."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("micros", at).withColumn("recent", F.count("*").over(w)).drop("micros")


def breaker(events: DataFrame, key: str, ts: str, event_id: str, seconds: int, tolerated: int) -> DataFrame:
    """key, event_id of the events that open a key's breaker: the event is one of more than ``tolerated`` within ``seconds``.

    An opening begins the count anew, so no window function gives it: a fold over the times does. It need not look across
    a gap of ``seconds``, so a key falls into runs of neighbouring buckets of that width, found from its distinct buckets; runs are dealt out
    one by one, and each is read in order with as many times in memory as are tolerated. Events of one time count in order of id.
    """
    ship(events.sparkSession)
    width = seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(event_id).cast("bigint").alias("event_id")).where("at is not null")
    rows = rows.withColumn("bucket", F.floor(F.col("at") / width))
    w = Window.partitionBy("key").orderBy("bucket")
    runs = rows.select("key", "bucket").distinct().withColumn("new", (F.col("bucket") - F.lag("bucket").over(w) != 1).cast("int"))
    runs = runs.select("key", "bucket", F.sum(F.coalesce("new", F.lit(1))).over(w).alias("run"))
    placed = rows.alias("a").join(runs.alias("b"), F.expr("a.key <=> b.key and a.bucket = b.bucket")).select("a.key", "b.run", "a.at", "a.event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, recent = None, deque()
        for batch in batches:
            opens = []
            for i, (k, run, at) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "run", "at")], strict=True)):
                if (k, run) != place:
                    place = (k, run)
                    recent.clear()
                while recent and at - recent[0] >= width:
                    recent.popleft()
                recent.append(at)
                if len(recent) > tolerated:
                    recent.clear()
                    opens.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id")], names=["key", "event_id"]).take(pa.array(opens, pa.int64()))

    kind = rows.schema["key"].dataType.simpleString()
    return placed.repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id").mapInArrow(fold, f"key {kind}, event_id bigint").withColumnRenamed("key", key)


#: Headers whose values must not be logged.
SECRET_HEADERS = ["authorization", "cookie", "x-api-key"]


def redacted(headers: Column, secret: list[str] = SECRET_HEADERS) -> Column:
    """A map of request headers with the values of secret ones (in lower case) replaced."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(list(secret)), "[Redacted]").otherwise(v))
