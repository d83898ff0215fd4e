"""Helpers shared by the operators: staging, folds, word patterns, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.functions.arrow import give_back, rows_of  # noqa: F401

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session has none (tests, local use) one under the warehouse is set.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        place = warehouse.rstrip("/") + "/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and a result used twice is computed once.  The files go when the
    application's file system handle closes.
    """
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def unstage(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete staged tables whose successors are staged themselves, and let Spark drop shuffles nothing refers to any more.

    Spark cleans a shuffle when the driver's garbage collector finds it
    unreachable, which may be long after the last use; hence the call.
    """
    for df in staged:
        where, files = _place(spark, df._staged_at)
        files.delete(where, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass(frozen=True)
class Sealed:
    """A table under private column names, so that an operator's own columns cannot meet the caller's."""

    df: DataFrame
    names: tuple[str, ...]

    def name(self, column: str) -> str:
        return f"_in_{self.names.index(column)}"

    def open(self, df: DataFrame) -> DataFrame:
        """The caller's columns again, in order; whatever was added goes."""
        return df.select([F.col(f"_in_{i}").alias(c) for i, c in enumerate(self.names)])


def sealed(df: DataFrame) -> Sealed:
    return Sealed(df.toDF(*[f"_in_{i}" for i in range(len(df.columns))]), tuple(df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds`` (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Spark re-evaluates an outer expression for every element when it occurs
    inside a higher-order function's lambda; binding it avoids that.
    """
    return F.transform(F.array(value), body).getItem(0)
