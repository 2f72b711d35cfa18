"""Chunk arrivals as a stream: the state of each chunk follows from the events seen so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import idiv
from ..plans.tables import Tables

#: States of a chunk and what asks for a new download.
STATES = ("Queuing", "Downloading", "Done", "Failed", "Delayed", "Pruned")
RELOAD = ("Failed", "Delayed", "Pruned")


def needs_reload(state: Column) -> Column:
    return state.isin(*RELOAD)


def arrivals(events: DataFrame) -> DataFrame:
    """(cx, cy, cz, state, ts) from an event table or stream: each event reports on one chunk."""
    n = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, STATES)), (n % len(STATES) + 1).cast("int"))
    return events.select((n % 10).alias("cx"), (idiv(n, 10) % 10).alias("cy"), (F.col("user_id") % 5).alias("cz"), state.alias("state"), "ts")


def latest(reports: DataFrame) -> DataFrame:
    """The last report on each chunk; on a stream, state for each chunk only."""
    return reports.groupBy("cx", "cy", "cz").agg(F.max(F.struct("ts", "state")).alias("l"), F.count("*").alias("n_reports")).select("cx", "cy", "cz", F.col("l.state").alias("state"), "n_reports")


def _timed(reports: DataFrame) -> DataFrame:
    """Watermarks take timestamps of the session's time zone only."""
    return reports.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(reports: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One report of each chunk and state within the watermark: downloads in flight are asked for once."""
    return _timed(reports).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["cx", "cy", "cz", "state"])


def windowed(reports: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Reports by time window and state; late ones within the watermark count."""
    return _timed(reports).withWatermark("ts", delay).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n"))


def run_available(spark: SparkSession, source: str, schema, work: Tables) -> DataFrame:
    """Reads all files at `source` as a stream, a few a batch, and returns the state of each chunk at its end.

    Each batch is written to the shared folder under its number, so a batch that is run again replaces its own output.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    top = f"{work.top}/arrivals"

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("cx", "cy", "cz").agg(F.max(F.struct("ts", "state")).alias("l"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{top}/batch={number}")

    query = arrivals(stream).writeStream.foreachBatch(put).option("checkpointLocation", f"{work.top}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.parquet(top)
    return seen.groupBy("cx", "cy", "cz").agg(F.max("l").alias("l"), F.sum("n").alias("n_reports")).select("cx", "cy", "cz", F.col("l.state").alias("state"), "n_reports")


#: Fixed value: seconds after which a delayed chunk is asked for again.
RETRY_SECONDS = 10


def tracked(reports: DataFrame, retry: int | None = RETRY_SECONDS) -> DataFrame:
    """(cx, cy, cz, state, n_reports) of a stream, in update mode: a chunk to reload becomes Missing after `retry` seconds.

    State is two values for each chunk; the timer is the stream's processing time, so a run over available data
    takes no timer (None).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(key, batches, state):
        if state.hasTimedOut:
            now, n = "Missing", state.get[1]
        else:
            now, n = state.get if state.exists else ("Missing", 0)
            last = None
            for batch in batches:
                n += len(batch)
                top = batch.sort_values(["ts", "state"]).iloc[-1]
                if last is None or (top.ts, top.state) > last:
                    last, now = (top.ts, top.state), top.state
        state.update((now, n))
        if retry is not None and now in RELOAD:
            state.setTimeoutDuration(retry * 1000)
        yield pd.DataFrame({"cx": [key[0]], "cy": [key[1]], "cz": [key[2]], "state": [now], "n_reports": [n]})

    out = "cx bigint, cy bigint, cz bigint, state string, n_reports bigint"
    return reports.groupBy("cx", "cy", "cz").applyInPandasWithState(follow, out, "state string, n bigint", "update", GroupStateTimeout.NoTimeout if retry is None else GroupStateTimeout.ProcessingTimeTimeout)
