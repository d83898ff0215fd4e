"""The engine's relations over the driver's tables, and the same as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rounded(column: str, digits: int = 8) -> Column:
    return F.round(column, digits)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, gone when the application ends.

    It lies in spark.checkpoint.dir; only where that is unset, on one machine, in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    made = f"{base.rstrip('/')}/solvefront-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)  # only what exists can be marked
    files.deleteOnExit(path)
    return f"{made}/data"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an attempt log: the supplier is the task, a returned line a pass, (discount, tax) the solution's species."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("task_id"), F.col("l_linestatus").alias("system"), (F.col("l_returnflag") == "R").alias("passed"),
        F.format_string("%.2f|%.2f", "l_discount", "l_tax").alias("species"), F.col("l_quantity").cast("bigint").alias("tokens"),
        F.col("l_linenumber").cast("bigint").alias("calls"), (F.col("l_quantity") > 45).alias("exhausted"), (F.col("l_linenumber") > 3).alias("used_expanding"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


def indexed(rows: DataFrame, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(*ORDER)) - 1)


def arm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as result rows: the priority is the arm, the year the language."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").cast("string").alias("language"), (F.col("o_orderstatus") == "F").alias("passed"),
        F.when(F.col("o_orderkey") % 11 == 0, "incomplete").when(F.col("o_orderkey") % 13 == 0, "error").when(F.col("o_orderkey") % 17 == 0, "empty_patch").when(F.col("o_orderkey") % 19 != 0, "resolved").alias("eval_result"),
        (F.col("o_custkey") % 4).alias("tool_calls"), (F.col("o_custkey") % 4 + 1).alias("generations"), F.col("o_totalprice").alias("elapsed_s"), (F.col("o_orderkey") % 3 == 0).alias("pass_at_n"))


SQL_ATTEMPTS = """attempts AS (SELECT l_suppkey AS task_id, l_linestatus AS system, l_returnflag = 'R' AS passed, printf('%.2f|%.2f', l_discount, l_tax) AS species,
  l_quantity::BIGINT AS tokens, l_linenumber::BIGINT AS calls, l_quantity > 45 AS exhausted, l_linenumber > 3 AS used_expanding, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem)"""
SQL_INDEXED = SQL_ATTEMPTS + """, idx AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS i FROM attempts)"""
SQL_COUNTS = SQL_ATTEMPTS + """, counts AS (SELECT task_id, species, COUNT(*) AS n FROM attempts WHERE passed GROUP BY ALL)"""
SQL_ARMS = """rows_ AS (SELECT o_orderpriority AS arm, year(o_orderdate)::VARCHAR AS language, o_orderstatus = 'F' AS passed,
  CASE WHEN o_orderkey % 11 = 0 THEN 'incomplete' WHEN o_orderkey % 13 = 0 THEN 'error' WHEN o_orderkey % 17 = 0 THEN 'empty_patch' WHEN o_orderkey % 19 <> 0 THEN 'resolved' END AS eval_result,
  o_custkey % 4 AS tool_calls, o_custkey % 4 + 1 AS generations, o_totalprice AS elapsed_s, o_orderkey % 3 = 0 AS pass_at_n FROM orders),
valid AS (SELECT * FROM rows_ WHERE COALESCE(eval_result NOT IN ('incomplete', ''), true))"""
#: Interval ends by bisection on the binomial tail, as scalar lists: c successes of n.
SQL_CP = """cp_pairs AS (SELECT DISTINCT c, n FROM cp_in),
cp_steps(c, n, k, lo1, hi1, lo2, hi2) AS (
  SELECT c, n, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM cp_pairs
  UNION ALL
  SELECT c, n, k + 1,
    CASE WHEN t1 < 0.025 THEN (lo1 + hi1) / 2 ELSE lo1 END, CASE WHEN t1 < 0.025 THEN hi1 ELSE (lo1 + hi1) / 2 END,
    CASE WHEN t2 > 0.025 THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN t2 > 0.025 THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT *, COALESCE(list_sum(list_transform(range(c, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo1 + hi1) / 2) + (n - i) * ln(1 - (lo1 + hi1) / 2)))), 0) AS t1,
          COALESCE(list_sum(list_transform(range(0, c + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo2 + hi2) / 2) + (n - i) * ln(1 - (lo2 + hi2) / 2)))), 0) AS t2
        FROM cp_steps WHERE k < 45)),
cp AS (SELECT c, n, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE lo1 END AS low, CASE WHEN c = n THEN 1.0::DOUBLE ELSE lo2 END AS high FROM cp_steps WHERE k = 45)"""
