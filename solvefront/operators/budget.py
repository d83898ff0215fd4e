"""Budgets: caps, ledgers as paths, matched-compute reports, truncation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvefront.operators.scans import running_sum

#: The order in which dimensions are tested.
DIMENSIONS = ("calls", "prompt_tokens", "completion_tokens", "total_tokens", "usd")


def headroom(cap: Column, spent: Column) -> Column:
    """What is left, not below 0; null where there is no cap."""
    return F.when(cap.isNotNull(), F.greatest(F.lit(0), cap - spent))


def first_breach(caps: str, spent: str, usage: str, dimensions: Sequence[str] = DIMENSIONS) -> Column:
    """Name of the first dimension that spent + usage takes over its cap, else null; arguments are struct columns."""
    return F.coalesce(*[F.when(F.col(f"{spent}.{d}") + F.col(f"{usage}.{d}") > F.col(f"{caps}.{d}"), F.lit(d)) for d in dimensions])


def scaled(cap: Column, factor: Column, *, whole: bool) -> Column:
    """A cap times a factor; whole dimensions are truncated."""
    return (cap * factor).cast("bigint") if whole else cap * factor


def ancestors(path: Column) -> Column:
    """The path and all its prefixes: a/b/c gives a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ledger(charges: DataFrame, path: str = "path", amounts: Sequence[str] = ("calls", "tokens")) -> DataFrame:
    """(account, level, amounts): every charge counts on its account and all above.

    Charges are summed by account before anything is spread to the accounts above.
    """
    leaves = charges.groupBy(path).agg(*[F.sum(a).alias(a) for a in amounts])
    spread = leaves.withColumn("account", F.explode(ancestors(F.col(path))))
    return spread.groupBy("account").agg(*[F.sum(a).alias(a) for a in amounts]).withColumn("level", F.size(F.split("account", "/")))


def snapshot(balances: DataFrame, amounts: Sequence[str] = ("calls", "tokens")) -> DataFrame:
    """Each account with its direct children as an array."""
    parent = F.when(F.col("level") > 1, F.regexp_replace("account", r"/[^/]*$", ""))
    kids = balances.withColumn("_p", parent).where("_p is not null").groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("account", *amounts))).alias("children"))
    return balances.join(kids, F.col("account") == F.col("_p"), "left").drop("_p")


def snapshot_tree(balances: DataFrame, amounts: Sequence[str] = ("calls", "tokens")) -> DataFrame:
    """(account, tree): each root account with its whole tree as one VARIANT, children in order of their names, however deep.

    Folded from the deepest level up, one join a level, so the number of steps
    is the depth.  Each step carries the nodes of one level as JSON text; only
    roots are parsed.  The tree of a root is one value by what it is: ask for
    subtrees (their balances alone, levels from 1) where accounts are too many for one.
    """
    depth = balances.agg(F.max("level")).first()[0] or 0
    parent = F.regexp_replace("account", r"/[^/]*$", "")
    label = F.to_json(F.struct(F.regexp_extract("account", r"[^/]*$", 0).alias("label"), *amounts))
    below = None
    for level in range(depth, 0, -1):
        nodes = balances.where(F.col("level") == level).select("account", label.alias("_own"))
        kids = F.lit("")
        if below is not None:
            nodes, kids = nodes.join(below, F.col("account") == F.col("_parent"), "left"), F.coalesce("_kids", F.lit(""))
        tree = F.concat(F.expr("left(_own, length(_own) - 1)"), F.lit(',"children":['), kids, F.lit("]}"))
        made = nodes.select("account", tree.alias("tree"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("account", "tree"))), lambda x: x["tree"])
        below = made.groupBy(parent.alias("_parent")).agg(F.array_join(texts, ",").alias("_kids")) if level > 1 else made
    if below is None:
        return balances.select("account", F.lit(None).cast("variant").alias("tree"))
    return below.select("account", F.parse_json("tree").alias("tree"))


def affordable(requests: DataFrame, balances: DataFrame, caps: DataFrame, path: str = "path", amount: str = "calls") -> DataFrame:
    """Whether a request fits the caps of its whole chain; ``caps`` (account, cap), no row or null: no cap."""
    chain = requests.withColumn("account", F.explode(ancestors(F.col(path))))
    fits = F.coalesce(F.coalesce(F.col("_spent"), F.lit(0)) + F.col(amount) <= F.col("cap"), F.lit(True))
    joined = chain.join(balances.select("account", F.col(amount).alias("_spent")), "account", "left").join(caps, "account", "left")
    return joined.groupBy(path, amount).agg(F.bool_and(fits).alias("can_afford"))


def match_report(spend: DataFrame, task: str = "task_id", system: str = "system", dimensions: Sequence[str] = ("calls", "tokens"), tolerance: float = 0.05) -> DataFrame:
    """Per task, whether every system is within the tolerance of the largest; one system, or all zero, matches."""
    close = [F.coalesce((F.max(d) - F.min(d)) <= F.lit(tolerance) * F.max(d), F.lit(True)) | (F.max(d) == 0) for d in dimensions]
    both = close[0]
    for c in close[1:]:
        both = both & c
    return spend.groupBy(task).agg(F.count(F.lit(1)).alias("n_systems"), ((F.count(F.lit(1)) < 2) | both).alias("matched"))


def relative_spend(spend: DataFrame, task: str = "task_id", dimensions: Sequence[str] = ("calls", "tokens")) -> DataFrame:
    """Each value over its task's largest; 1 where that is 0."""
    return spend.withColumns({f"{d}_ratio": F.when(F.max(d).over(W.partitionBy(task)) == 0, F.lit(1.0)).otherwise(F.try_divide(F.col(d), F.max(d).over(W.partitionBy(task)))) for d in dimensions})


def overall_report(matches: DataFrame, task: str = "task_id") -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(~F.col("matched")).alias("n_unmatched"), F.array_sort(F.collect_list(F.when(~F.col("matched"), F.col(task)))).alias("unmatched"))


def take_affordable(samples: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, cap: Column, **options) -> DataFrame:
    """Stop at the first sample that does not fit: add ``spent`` and ``exhausted`` (that sample and all after it).

    Costs are not negative, so the running sum decides; a null cap is none.
    An account of any size is scanned by ranges of its order.
    """
    return running_sum(samples, by, order, F.col(cost), "spent", **options).withColumn("exhausted", F.coalesce(F.col("spent") > cap, F.lit(False)))


def charge_in_order(samples: DataFrame, by: Sequence[str], order: str, cost: str, cap: float) -> DataFrame:
    """Reject-and-continue: a sample that does not fit is refused and later ones may still fit.

    Each decision needs all before it, so an account is folded in one task,
    but as a stream: rows come sorted, in Arrow batches, and only the account's
    sums are carried from batch to batch.  Equal places are taken by cost; a null cost is refused.
    """
    keys = samples.select(*by, F.col(order).alias("_order"), F.col(cost).cast("double").alias("_cost"))
    rows = keys.repartition(*by).sortWithinPartitions(*by, "_order", "_cost")
    schema = T.StructType([*(samples.schema[c] for c in by), *T._parse_datatype_string("spent double, taken bigint, refused bigint").fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, spent, taken, refused = None, 0.0, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*account.columns, pa.array([spent]), pa.array([taken], pa.int64()), pa.array([refused], pa.int64())], names=[*by, "spent", "taken", "refused"])

        for batch in batches:
            names = batch.select(list(by))
            changes = np.zeros(batch.num_rows, bool)
            for column in names.columns:
                now, last = column.slice(1), column.slice(0, max(0, len(column) - 1))
                same = pc.fill_null(pc.equal(now, last), False).to_numpy(zero_copy_only=False) | (now.is_null().to_numpy(zero_copy_only=False) & last.is_null().to_numpy(zero_copy_only=False))
                changes[1:] |= ~same
            starts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:]):
                if account is None or not account.equals(names.slice(a, 1)):
                    if account is not None:
                        yield closed()
                    account, spent, taken, refused = names.slice(a, 1), 0.0, 0, 0
                for c in batch.column("_cost").slice(a, b - a).to_pylist():
                    if c is not None and spent + c <= cap:
                        spent += c
                        taken += 1
                    else:
                        refused += 1
        if account is not None:
            yield closed()

    return rows.mapInArrow(fold, schema)
