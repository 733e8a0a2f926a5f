"""Incremental loads: the latest event of each key as a stream, and appends that never rewrite what is known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from papertide.functions.runtime import checkpoint, shared_folder

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


STATE = "user_id bigint, n bigint, last struct<at:timestamp,event_id:bigint,event_type:string>"


def append_new(known: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """What is known, and the offered rows whose key is not."""
    return known.unionByName(offered.join(known.select(*key).distinct(), key, "left_anti"))


def latest_by_key(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Counts and the latest event of each user, from a stream over event files: each event counts once, whenever it comes and however often.

    `folder` holds the table, the ids seen so far and the stream's progress: called again with it, only files that are new are read. Without one, a new folder in the shared one is
    taken. No watermark decides what is late: an event is new if its id is not among those of earlier batches. Of several events of one id
    in a batch the latest counts; a batch that runs again replaces what it wrote."""
    folder = folder or f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(path)

    def merge(batch: DataFrame, number: int) -> None:
        one = batch.groupBy("event_id").agg(F.max(F.struct(F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type")).alias("e")).select("event_id", "e.*")
        seen = spark.read.schema("event_id bigint, batch bigint").parquet(f"{folder}/seen").where(F.col("batch") < number)
        fresh = checkpoint(one.join(seen, "event_id", "left_anti"))
        fresh.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "event_id", "event_type")).alias("last")).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        fresh.select("event_id").write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    for part, schema in (("state", STATE), ("seen", "event_id bigint")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{part}/batch=-1")  # a table, even where there is no batch
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.schema(STATE).parquet(f"{folder}/state")
    return state.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("user_id", "n", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def running(events: DataFrame) -> DataFrame:
    """Each day's events by type, stacked: where each type's band begins and ends."""
    daily = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = F.sum("n").over(Window.partitionBy("day").orderBy("event_type").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("day", "event_type", (top - F.col("n")).alias("low"), top.alias("high"))
