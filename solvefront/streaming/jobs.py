"""Structured Streaming: running frontier, event windows, epochs, and results read from state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts", **options) -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone become instants of the session's zone, which watermarks need."""
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def running_rates(attempts: DataFrame, by: str = "task_id") -> DataFrame:
    """For update or complete mode: any prefix of a log is a valid sample, so each batch's state is a valid estimate."""
    return attempts.groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("passed").alias("n_correct"))


def first_solutions(attempts: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First sight of each solution within the watermark."""
    return attempts.where("passed").withWatermark(time, delay).dropDuplicatesWithinWatermark(["task_id", "species"])


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 day", slide: str | None = None, delay: str = "1 hour", key: str = "event_type") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, size, slide) if slide else F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def epoch_totals(calls: DataFrame, epochs: DataFrame, time: str = "ts", delay: str = "10 minutes", key: str = "session_id") -> DataFrame:
    """Totals per epoch (epoch, starts, ends): a call counts in the epoch it began in, however late it arrives within ``delay``.

    That is what waiting for calls in flight before a reset achieves: none is
    lost, none counts in the next epoch.  ``epochs`` is a static table of the
    same key, so the join keeps no state.
    """
    late = calls.withWatermark(time, delay)
    inside = (late[key] == epochs[key]) & (late[time] >= epochs["starts"]) & (late[time] < epochs["ends"])
    return late.join(epochs, inside).groupBy(epochs[key], "epoch").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def periodic_snapshot(totals: DataFrame, path: str, checkpoint: str, every: str | None = "120 seconds"):
    """Write the whole running result to path/snapshot=<batch> at each trigger; nothing is reset by it.

    ``every`` None takes all that is there and ends.  A batch that is run again replaces its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_available(stream: DataFrame, mode: str, checkpoint: str, seconds: int = 600):
    """Run all that is there for its state alone: the state store under the checkpoint holds the result, no sink does."""
    return finished(stream.writeStream.outputMode(mode).format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), seconds)


def finished(query, seconds: int | None = 600):
    """Wait for a query that ends by itself; stop it and raise where it does not within ``seconds`` (None: however long it takes)."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(query.id)
    return query


def state_of(spark: SparkSession, checkpoint: str, *, operator: int = 0, batch: int | None = None, variable: str | None = None) -> DataFrame:
    """A stateful operator's keys and values after a batch (the last one), read from its state store; nothing is cleared by it.

    The state is read in a distributed way, a task for each of its partitions,
    while the stream runs or after it.  ``variable`` names a state of a keyed
    processor; a map's own keys come as ``user_key``.  Aggregates are named by
    their functions (``count``, ``sum``), repeated ones with a number.
    """
    read = spark.read.format("statestore").option("operatorId", operator)
    for name, value in (("batchId", batch), ("stateVarName", variable)):
        read = read if value is None else read.option(name, value)
    found = read.load(checkpoint)
    if "user_map_key" in found.columns:
        return found.select("key.*", F.col("user_map_key").alias("user_key"), "user_map_value.*")
    return found.select("key.*", F.col("value").cast(_told_apart(found.schema["value"].dataType)).alias("value")).select("*", "value.*").drop("value")


def _told_apart(kind: T.StructType) -> T.StructType:
    """The struct with numbers after names that occur again: two counts are ``count`` and ``count_2``."""
    seen: dict[str, int] = {}
    for f in kind.fields:
        seen[f.name] = seen.get(f.name, 0) + 1
        f.name = f.name if seen[f.name] == 1 else f"{f.name}_{seen[f.name]}"
    return T.StructType(kind.fields)
