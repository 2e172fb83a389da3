"""Structured Streaming twins of the log alerts.

Late records are taken up to the watermark; the reference of the batch twins has none, so this
is a definition of ours. Results go to Parquet batch by batch with the batch's number, and
the last value of a window counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

LATENESS = "1 hour"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, whether it is one file or a folder of them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, lateness: str = LATENESS) -> DataFrame:
    """The events table as a stream with a watermark."""
    return files(spark, sf_dir).withWatermark("ts", lateness)


def windowed(stream: DataFrame, width: str) -> DataFrame:
    """start_ts, events, mean_value per window."""
    w = stream.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
    return w.select(F.col("w.start").alias("start_ts"), "events", "mean_value")


def refusals(stream: DataFrame, limit: int = 1, width: str = "1 hour") -> DataFrame:
    """user_id, hour, events, refused of users and windows beyond the limit.

    Windows are kept until the watermark has passed them, however many a user has; what comes later
    than LATENESS is out, as in any windowed count.
    """
    w = stream.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("events"))
    return w.where(F.col("events") > limit).select("user_id", F.col("w.start").alias("hour"), "events", (F.col("events") - limit).alias("refused"))


def drain(result: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there now and read the last value of each key."""
    out, marks = f"{folder}/{uuid.uuid4().hex}", f"{folder}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    spark = result.sparkSession
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("_batch", IntegerType())])).parquet(out)
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_batch")
