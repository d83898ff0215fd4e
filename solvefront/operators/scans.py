"""Running sums, numbers and maxima within a key, where one key may hold most rows.

A window by key is one task for each key.  Here a key's rows are cut into
ranges of its order, each range is scanned by itself, the ranges' totals are
scanned in turn, and what stood before a range is joined back.  Keys of few
rows have one range, so they cost what a window costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range about.
RANGE_ROWS = 1 << 20
RANGE = "_range"


def _place(column: Column, kind: T.DataType) -> Column | None:
    """The order as a number, rising with it; None where there is none."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return column.cast("timestamp").cast("double")
    return None


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_range``, from 0 on: of two rows of a key, the one in the earlier range comes first.

    A key of n rows has about n / ``range_rows`` ranges of equal width in its
    first order column, equal values in one; null values are in the first.
    They are told from the key's least and greatest value alone, so they are
    the same whenever they are computed.  Where the column is text, a key has one range.
    """
    place = _place(F.col(order[0]), rows.schema[order[0]].dataType)
    if place is None:
        return rows.withColumn(RANGE, F.lit(0).cast("long"))
    facts = rows.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    large = facts.where(F.col("_n") > range_rows).withColumn("_ranges", F.ceil(F.col("_n") / range_rows))
    same = [rows[c].eqNullSafe(large[f"_by{i}"]) for i, c in enumerate(by)]
    part = F.floor((place - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_ranges"))
    joined = rows.join(large, same, "left")
    inside = F.coalesce(F.least(part, F.col("_ranges") - 1), F.lit(0)).cast("long")
    return joined.withColumn(RANGE, F.when(F.col("_ranges").isNull() | (F.col("_high") == F.col("_low")), F.lit(0)).otherwise(inside).cast("long")).select(*[rows[c] for c in rows.columns], RANGE)


def within(by: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*by, RANGE).orderBy(*order)


def joined_back(rows: DataFrame, totals: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of a range with what ``totals`` says of it."""
    named = totals.select(*[F.col(c).alias(f"_to{i}") for i, c in enumerate((*by, RANGE))], *names)
    same = [rows[c].eqNullSafe(named[f"_to{i}"]) for i, c in enumerate((*by, RANGE))]
    return rows.join(named, same, "left").drop(*[f"_to{i}" for i in range(len(by) + 1)])


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the sum of ``value`` from the key's first row to this one, rows as ``order`` says; it must tell a key's rows apart."""
    cut = ranged(rows.withColumn("_value", value), by, order, range_rows)
    local = cut.withColumn("_local", F.sum("_value").over(within(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    totals = cut.groupBy(*by, RANGE).agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.sum("_total").over(earlier))
    # Null until a value has come, as a window's sum is.
    total = F.when(F.col("_local").isNull(), F.col("_before")).otherwise(F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
    made = joined_back(local, before, by, ["_before"]).withColumn(name, total.cast(local.schema["_local"].dataType))
    return made.drop("_value", "_local", "_before", RANGE)


def running_number(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the row's number within its key, from 0."""
    cut = ranged(rows, by, order, range_rows)
    local = cut.withColumn("_local", F.row_number().over(within(by, order)) - 1)
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    before = cut.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    return joined_back(local, before, by, ["_before"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", RANGE)


def known_length(rows: DataFrame, by: Sequence[str], order: Sequence[str], length: Column, ok: Column, name: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the known length before each row: a row makes max(known, length) known, and one more if ``ok``.

    With S the successes before a row, known is S + max(0, greatest length - S
    of earlier rows).  A range is summed up by (successes, greatest length - S
    counted from its own start); after k earlier successes that second part is k less.
    """
    cut = ranged(rows.withColumns({"_length": length, "_ok": ok.cast("long")}), by, order, range_rows)
    past = within(by, order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_s", F.coalesce(F.sum("_ok").over(past), F.lit(0)))
    local = local.withColumn("_peak", F.max(F.col("_length") - F.col("_s")).over(past))
    totals = local.groupBy(*by, RANGE).agg(F.coalesce(F.sum("_ok"), F.lit(0)).alias("_sum"), F.max(F.col("_length") - F.col("_s")).alias("_most"))
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("_s0", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    before = before.withColumn("_peak0", F.max(F.col("_most") - F.col("_s0")).over(earlier))
    made = joined_back(local, before, by, ["_s0", "_peak0"])
    peak = F.greatest(F.lit(0), F.col("_peak0"), F.col("_peak") - F.col("_s0"))  # nulls do not count
    return made.withColumn(name, F.col("_s0") + F.col("_s") + peak).drop("_length", "_ok", "_s", "_peak", "_s0", "_peak0", RANGE)
