"""Streams with keyed state over the driver's tables, their results read from shared storage."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.plans.bindings import SQL_INDEXED, attempts, indexed, shared_path, table
from solvefront.plans.registry import query


def shuffled_arrival(spark: SparkSession, rows: DataFrame, order: str, key: str, size: int, batches: int = 3) -> DataFrame:
    """The rows as a stream of at most ``batches`` batches: chunks of ``size`` rows of a key arrive in an order of their own.

    The rows are computed and written once, each task's by batch; the files
    then move to where they arrive, older batches with earlier times.  A batch
    is as many files as its rows need tasks, so none holds a batch; a trigger
    takes as many as the largest has.
    """
    path, staged = shared_path(spark, "arrival"), shared_path(spark, "arriving")
    arrives = F.pmod(F.xxhash64(F.col(key), F.floor(F.col(order) / size)), F.lit(batches))
    rows.withColumn("_arrives", arrives).write.partitionBy("_arrives").parquet(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(at(path))
    now, most = int(time.time() * 1000), 1
    for k in range(batches):
        written = files.globStatus(at(f"{staged}/_arrives={k}/*.parquet"))
        for status in written:
            here = at(f"{path}/{k}-{status.getPath().getName()}")
            if not files.rename(status.getPath(), here):
                raise OSError(f"{here.toString()} has not arrived")
            files.setTimes(here, now - 1000 * (batches - k), -1)
        most = max(most, len(written))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", most).parquet(path)


@query("WITH " + SQL_INDEXED + """, first_sight AS (
  SELECT task_id, species, MIN(i) AS first FROM idx WHERE passed GROUP BY ALL),
sp AS (SELECT task_id, COUNT(*) AS n_species, SUM(first)::BIGINT AS first_sum FROM first_sight GROUP BY 1)
SELECT idx.task_id, COUNT(*) AS n_samples, MAX(i)::BIGINT AS last, COUNT(*) FILTER (passed) AS n_correct, SUM(tokens)::BIGINT AS tokens,
  COALESCE(ANY_VALUE(n_species), 0) AS n_species, COALESCE(ANY_VALUE(first_sum), 0) AS first_sum
FROM idx LEFT JOIN sp ON idx.task_id = sp.task_id GROUP BY idx.task_id""")
def attempt_log_stream(spark, sf):
    """Attempts that arrive out of order over three batches, appended to the log with two outputs, then read back."""
    from solvefront.streaming.attempt_log import append_attempts, read_log
    from solvefront.streaming.jobs import finished

    rows = indexed(attempts(spark, sf)).select(F.lit("c").alias("condition_key"), "task_id", F.col("i").cast("bigint").alias("i"), "passed", "species", "tokens")
    path = shared_path(spark, "log")
    finished(append_attempts(spark, shuffled_arrival(spark, rows, "i", "task_id", 64), path, shared_path(spark, "log-checkpoint"), also=("tokens",)), None)
    samples = read_log(spark, path).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("i").alias("last"), F.count_if("passed").alias("n_correct"), F.sum("tokens").alias("tokens"),
    )
    seen = read_log(spark, path, "species").groupBy("task_id").agg(F.count(F.lit(1)).alias("n_species"), F.sum("i").alias("first_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return samples.join(seen, "task_id", "left").select("task_id", "n_samples", "last", "n_correct", "tokens", zero("n_species"), zero("first_sum"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations),
e AS (SELECT *, turn % 5 + length(role) AS n, role = 'assistant' AS ok FROM c),
l AS (SELECT *, n - SUM(ok::INT) OVER (PARTITION BY conv_id ORDER BY seq) + ok::INT AS lead FROM e)
SELECT conv_id, seq, GREATEST(0, COALESCE(MAX(lead) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
  + COALESCE(SUM(ok::INT) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen
FROM l""")
def streamed_traces(spark, sf):
    """The known length before each call of a conversation, from turns that arrive out of order over three batches."""
    from pyspark.sql import Window as W

    from solvefront.streaming.jobs import finished
    from solvefront.streaming.ordered import stateful_seen

    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf, "conversations").select(
        "conv_id", seq.cast("bigint").alias("seq"), (F.col("turn") % 5 + F.length("role")).cast("bigint").alias("n_messages"), (F.col("role") == "assistant").alias("ok"),
    )
    out, checkpoint = shared_path(spark, "traces"), shared_path(spark, "traces-checkpoint")
    stream = stateful_seen(shuffled_arrival(spark, rows, "seq", "conv_id", 2), "conv_id")
    finished(stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), None)
    return spark.read.parquet(out).select("conv_id", "seq", "seen")
