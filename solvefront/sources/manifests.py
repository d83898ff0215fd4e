"""Frozen splits: written aside, compared, published by one rename; a frozen split is never replaced."""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.operators.selection import manifest_diff

#: Digests of ids fall into so many groups, each folded by itself.
BUCKETS = 4096
#: Shares may miss a sum of one by so much.
SLACK = 1e-9


@dataclass(frozen=True)
class SplitRatios:
    """Shares of train, held-out and transfer tasks: none negative, one in sum."""

    train: float = 0.5
    held_out: float = 0.5
    transfer: float = 0.0

    def __post_init__(self) -> None:
        shares = (self.train, self.held_out, self.transfer)
        if min(shares) < 0 or not math.isclose(sum(shares), 1.0, rel_tol=0, abs_tol=SLACK):
            raise ValueError(f"split shares must not be negative and must sum to 1: {shares}")


class FrozenSplitError(Exception):
    """Another content is frozen at this place."""


def content_digest(tasks: DataFrame) -> str:
    """SHA-256 over ids, content hashes and splits, whatever their order: groups by the id's hash are folded in order of ids, then the groups."""
    line = F.concat_ws("\0", "task_id", F.coalesce("hash", F.lit("")), F.coalesce("split", F.lit("unassigned")))
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).alias("bucket")
    each = tasks.groupBy(bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\1"), 256).alias("digest"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest"))), ","), 256)).first()[0]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def frozen(spark: SparkSession, path: str) -> dict | None:
    """What is said of the frozen split at ``path``; None where there is none."""
    place, files = _files(spark, f"{path.rstrip('/')}/frozen/about.json")
    return json.loads(spark.read.text(place.toString(), wholetext=True).first().value) if files.exists(place) else None


def frozen_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/frozen/tasks")


def freeze(spark: SparkSession, tasks: DataFrame, path: str, ratios: SplitRatios, *, salt: str, name: str = "suite") -> dict:
    """Freeze (task_id, hash, split) at ``path`` and return what is said of it.

    Equal content, in whatever order, passes a second time; other content
    raises.  All is written aside first, so one that dies midway leaves what
    was there; the rename refuses an existing place, so of two at once one wins and the other compares.
    """
    rows = tasks.select("task_id", "hash", F.coalesce("split", F.lit("unassigned")).alias("split"))
    digest = content_digest(rows)

    def same(said: dict) -> dict:
        if said["suite_hash"] != digest:
            raise FrozenSplitError(f"{path} holds a frozen split {said['suite_hash'][:12]}, not {digest[:12]}")
        return said

    if (said := frozen(spark, path)) is not None:
        return same(said)
    aside = f"{path.rstrip('/')}/pending-{uuid.uuid4().hex}"
    rows.write.parquet(f"{aside}/tasks")
    counts = {r.split: r["count"] for r in spark.read.parquet(f"{aside}/tasks").groupBy("split").count().collect()}
    said = {
        "suite_name": name, "suite_hash": digest, "salt": salt, "ratios": asdict(ratios), "counts": counts,
        "created_utc": dt.datetime.now(dt.UTC).isoformat(),
    }
    about, files = _files(spark, f"{aside}/about.json")
    out = files.create(about, False)
    out.write(json.dumps(said, indent=1).encode())
    out.close()
    return said if _publish(spark, aside, f"{path.rstrip('/')}/frozen") else same(frozen(spark, path))


def _publish(spark: SparkSession, aside: str, target: str) -> bool:
    """Rename where nothing is yet; else false, and what lay aside goes."""
    source, files = _files(spark, aside)
    place, _ = _files(spark, target)
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(files.makeQualified(source), files.makeQualified(place), gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        if not files.exists(place):
            raise
        files.delete(source, True)
        return False
    return True


def verify(spark: SparkSession, tasks: DataFrame, path: str) -> DataFrame:
    """(task_id, problem) of all drift from the frozen split, none if it holds; it reports and does not raise."""
    if frozen(spark, path) is None:
        raise FileNotFoundError(path)
    return manifest_diff(frozen_tasks(spark, path), tasks.withColumn("split", F.coalesce("split", F.lit("unassigned"))))
