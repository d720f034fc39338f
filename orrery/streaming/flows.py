"""Streaming twins of the event grid and the gap sessions (X1): the same results on the same data."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import shared_dir


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of the Parquet files that match ``folder/events.parquet``."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def binned_counts(events: DataFrame, width: str = "2 hours", lateness: str = "1 day") -> DataFrame:
    """Counts per window and type; windows close once the watermark passes."""
    w = F.window("ts", width)
    g = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start_ts"), "event_type", "n")


def gap_sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions per user by the gap between events."""
    s = F.session_window("ts", gap)
    g = events.withWatermark("ts", lateness).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("s.start").alias("start_ts"), "n")


def sliding_counts(events: DataFrame, width: str = "12 hours", step: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Counts and peaks per sliding window and type."""
    w = F.window("ts", width, step)
    g = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return g.select(F.col("w.start").alias("start_ts"), "event_type", "n", "peak")


def running_users(events: DataFrame) -> DataFrame:
    """Per user the count, sum and number of kinds of all events so far: state of our own, kept from batch to batch."""

    def update(key, parts, state):
        n, total, kinds = state.get if state.exists else (0, 0.0, "")
        seen = set(filter(None, kinds.split("\x1f")))
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
            seen |= set(part["event_type"])
        state.update((n, total, "\x1f".join(sorted(seen))))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "kinds": [len(seen)]})

    out = "user_id long, events long, total double, kinds long"
    kept = events.select("user_id", "event_type", "value").groupBy("user_id")
    made = kept.applyInPandasWithState(update, out, "n long, total double, kinds string", "update", "NoTimeout")
    rows = collected(made, "update")
    last = F.max(F.struct("events", "total", "kinds")).alias("s")  # counts grow, so the largest is the latest
    return rows.groupBy("user_id").agg(last).select("user_id", "s.events", "s.total", "s.kinds")


def collected(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now and return the result table.

    Every batch is written to a folder of its own in the shared one, so a batch that runs twice is written once, and nothing
    passes through the driver. In complete mode the last batch is the result, otherwise all of them are.
    """
    spark = stream.sparkSession
    base, seen = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        seen.append(batch)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    wanted = seen[-1:] if mode == "complete" else seen
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/rows/batch={b}" for b in sorted(set(wanted))])
