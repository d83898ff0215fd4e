"""An append log of attempts as a streaming sink: samples and first-seen species under one commit.

Tasks write Parquet files under names nobody reads yet; committing a batch
publishes one manifest that names its files of both outputs, by a rename.
Readers follow manifests alone, so a batch that dies leaves nothing to be seen, a batch
that is run again finds its manifest and changes nothing, and the log says
itself where a new run goes on.

What waits, and where each key goes on, is kept in one of two ways.  In
``files`` each batch is a plan over its rows, those that wait and the species
of the log, and leaves its state as files that the same manifest names: no row
passes through Python, but a batch reads the whole state.  In the ``store`` a
keyed processor asks RocksDB for the keys of a batch alone, row by row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from solvefront.streaming.ordered import InOrder, fold_in_order, require_plain

OUTPUTS = ("samples", "species")
#: What a batch leaves in files for the next of its run: where each key goes on, and the attempts that wait.
STATE = ("points", "held")


@dataclass
class Written(WriterCommitMessage):
    """The files one task has written, by output."""

    files: dict[str, str]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class AttemptLogWriter(DataSourceStreamArrowWriter):
    """Rows with ``first_seen`` go to both outputs, all others to samples alone."""

    def __init__(self, path: str, run: str, schema: str):
        self.path, self.run, self.schema = path, run, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _place(self.path)
        name, writers, made = f"part-{uuid.uuid4().hex}.parquet", {}, {}
        for batch in iterator:
            # A null flag is no sighting.
            parts = {"samples": batch, "species": batch.filter(pc.fill_null(batch.column("first_seen"), False))}
            for output, part in parts.items():
                if part.num_rows:
                    if output not in writers:
                        made[output] = f"{output}/{name}"
                        files.create_dir(f"{root}/{output}", recursive=True)
                        writers[output] = pq.ParquetWriter(f"{root}/{made[output]}", part.schema, filesystem=files)
                    writers[output].write_batch(part)
        for w in writers.values():
            w.close()
        return Written(made)

    def _manifest(self, batch: int) -> str:
        return f"manifests/{self.run}-{batch:09d}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, root = _place(self.path)
        target = f"{root}/{self._manifest(batchId)}"
        if files.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # this batch is in the log already
            return
        files.create_dir(f"{root}/manifests", recursive=True)
        listed = {o: sorted(m.files[o] for m in messages if m and o in m.files) for o in (*OUTPUTS, *STATE)}
        aside = f"{root}/manifests/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps({"run": self.run, "batch": batchId, "schema": self.schema, **listed}).encode())
        files.move(aside, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, root = _place(self.path)
        for m in messages:
            for name in (m.files if m else {}).values():
                files.delete_file(f"{root}/{name}")


class AttemptLog(DataSource):
    """The sink ``attempt_log``: options ``path`` and ``run``, which names what belongs to one checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "attempt_log"

    def schema(self) -> str:
        return "first_seen boolean"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> AttemptLogWriter:
        return AttemptLogWriter(self.options["path"], self.options["run"], schema.json())


class FirstSeen(InOrder):
    """Every attempt in turn, and whether it is the first of its key with its species; the species are a map in state."""

    KNOWN = "n_species bigint"

    def __init__(self, *args: Any, passed: str, species: str):
        super().__init__(*args)
        self.passed, self.species = passed, species

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sightings = handle.getMapState("species", "species string", "first bigint")
        self.told: set[str] = set()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.told = set()  # species of this key that the state is known to hold: it is asked once for each
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.told = set()
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def start(self) -> tuple:
        return (0,)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """One call for each species of the log, or one without for a key that has none."""
        known = self.at.get()[3] if self.at.exists() else 0
        if initialState["species"] is not None:
            self.sightings.updateValue((initialState["species"],), (initialState["first"],))
            known += 1
        self.at.update((initialState["next"], 0, 0, known))

    def fold(self, known: tuple, row: dict[str, Any]) -> tuple[tuple, tuple]:
        species = row[self.species]
        asked = bool(row[self.passed]) and species is not None and species not in self.told
        new = asked and not self.sightings.containsKey((species,))
        if new:
            self.sightings.updateValue((species,), (row[self.order],))
        if asked:
            self.told.add(species)
        values = tuple(row[c] for c in self.columns if c != self.order)
        return (known[0] + int(new),), (*values, new)


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """What batches have been committed, oldest first: their names, schemas and files, no rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifests")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        return []
    return [json.loads(r.value) for r in spark.read.text(f"{path.rstrip('/')}/manifests/*.json", wholetext=True).orderBy(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name")).collect()]


def read_log(spark: SparkSession, path: str, output: str = "samples") -> DataFrame | None:
    """The committed rows of an output; None for a log without a committed batch."""
    batches = manifests(spark, path)
    if not batches:
        return None
    schema = T.StructType.fromJson(json.loads(batches[-1]["schema"]))
    listed = [f"{path.rstrip('/')}/{name}" for b in batches for name in b[output]]
    return spark.read.schema(schema).parquet(*listed) if listed else spark.createDataFrame([], schema)


def resume_points(spark: SparkSession, path: str, by: list[str], order: str, species: str) -> DataFrame | None:
    """(by, next, species, first): where each key goes on and what it has seen, a row for each species; None for a new log."""
    samples = read_log(spark, path)
    if samples is None:
        return None
    ends = samples.groupBy(*by).agg((F.max(order) + 1).alias("next"))
    seen = read_log(spark, path, "species").select(*by, F.col(species).cast("string").alias("species"), F.col(order).alias("first"))
    return ends.join(seen, by, "left").select(*by, "next", "species", "first")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/attempt-log-run")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        out = files.create(place, False)
        out.write(uuid.uuid4().hex.encode())
        out.close()
    return spark.read.text(place.toString(), wholetext=True).first().value


#: Where a row of a batch's plan comes from, in the order in which they are taken.
POINT, SEEN, HELD, NEW = range(4)
#: Where it goes: it waits, it is a sample, it is a sample and the first of its species.
WAITS, SAMPLE, SIGHTING = range(3)


def fold_batch(new: DataFrame, held: DataFrame, points: DataFrame, seen: DataFrame, by: list[str], order: str, passed: str, species: str, also: list[str]) -> DataFrame:
    """(by, order, passed, species, also, first_seen, goes) of the attempts that are new or waited, each number once, without those that have had their turn.

    ``points`` has (by, next), ``seen`` the (by, species) of the log.  All meet
    in one shuffle by key: points and species come before a key's attempts.
    """
    of = {f.name: f.dataType for f in new.schema.fields}
    columns = [*by, order, passed, species, *also]

    def lines(rows: DataFrame, kind: int, has: list[str]) -> DataFrame:
        given = [(F.col(c) if c in has else F.lit(None)).cast(of[c]).alias(c) for c in columns]
        return rows.select(*given, F.lit(kind).alias("_kind"), (F.col("next") if kind == POINT else F.lit(None)).cast("bigint").alias("_next"))

    rows = lines(points, POINT, by).union(lines(seen, SEEN, [*by, species])).union(lines(held, HELD, columns)).union(lines(new, NEW, columns)).repartition(*by)
    # Hashes come first in a window's order for the sort, which compares a number before it looks into rows.
    turn = W.partitionBy(F.xxhash64(*by), *by).orderBy(order, "_kind", passed, species, *also)
    so_far = turn.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", F.coalesce(F.max("_next").over(so_far), F.lit(0)).alias("_from"), F.lag(order).over(turn).alias("_before"))
    fresh = (F.col("_kind") >= HELD) & (F.col(order) >= F.col("_from")) & ~F.col(order).eqNullSafe(F.col("_before"))
    rows = rows.withColumn("_fresh", fresh).withColumn("_count", F.sum(F.col("_fresh").cast("bigint")).over(so_far))
    rows = rows.where(F.col("_fresh") | (F.col("_kind") == SEEN)).withColumn("_ready", F.col("_fresh") & (F.col(order) - F.col("_from") == F.col("_count") - 1))
    told = F.col("_ready") & F.coalesce(F.col(passed).cast("boolean"), F.lit(False)) | (F.col("_kind") == SEEN)
    rows = rows.withColumn("_told", F.when(told, F.col(species)))
    alone = F.when(F.col("_told").isNull(), F.col(order))  # what is no sighting is compared with nothing
    sight = W.partitionBy(F.xxhash64(*by, "_told", alone), *by, "_told", alone).orderBy(order)
    first = F.col("_told").isNotNull() & (F.row_number().over(sight) == 1)
    rows = rows.withColumn("first_seen", first).where(F.col("_kind") >= HELD)
    goes = F.when(~F.col("_ready"), WAITS).when(F.col("first_seen"), SIGHTING).otherwise(SAMPLE)
    return rows.select(*columns, "first_seen", goes.alias("goes"))


#: For a batch's own session: tasks of a size that is sorted in memory, and writers side by side rather than one more sort.
PLANS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "4",
}
PARTITIONS, ROW_GROUP = 240, 32 << 20


class InFiles:
    """A batch at a time, for ``foreachBatch``: the plan's rows are written by where they go, and one manifest names them and the state."""

    def __init__(self, spark: SparkSession, path: str, run: str, schema: T.StructType, by: list[str], order: str, passed: str, species: str, also: list[str]):
        self.path, self.run, self.schema = path.rstrip("/"), run, schema
        self.by, self.order, self.passed, self.species, self.also = by, order, passed, species, also
        self.log = manifests(spark, path)

    def _read(self, spark: SparkSession, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:  # known to be empty by the plan itself
            return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        return spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, [m for m in self.log if m["run"] == self.run]
        if any(m["batch"] == number for m in mine):
            return  # this batch is in the log already
        last = max(mine, key=lambda m: m["batch"], default=None)
        for name, value in PLANS.items():
            spark.conf.set(name, value)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        keys = [f for f in self.schema.fields if f.name in self.by]
        kept, ends = self.schema[:-1], T.StructType([*keys, T.StructField("next", T.LongType())])
        next_of = lambda rows: rows.groupBy(*self.by).agg((F.max(self.order) + 1).alias("next"))
        if last:
            points = self._read(spark, last["points"], ends)
        else:
            points = next_of(self._read(spark, [n for m in self.log for n in m["samples"]], self.schema))
        held = self._read(spark, last["held"] if last else [], kept)
        seen = self._read(spark, [n for m in self.log for n in m["species"]], self.schema)
        there = f"batches/{uuid.uuid4().hex}"
        folded = fold_batch(batch, held, points, seen, self.by, self.order, self.passed, self.species, self.also)
        folded.write.partitionBy("goes").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{there}/attempts")
        waits, samples, sightings = (self._made(spark, f"{there}/attempts/goes={k}") for k in (WAITS, SAMPLE, SIGHTING))
        more = next_of(self._read(spark, samples + sightings, self.schema))
        points.union(more).groupBy(*self.by).agg(F.max("next").alias("next")).write.parquet(f"{self.path}/{there}/points")
        made = {"samples": samples + sightings, "species": sightings, "points": self._made(spark, f"{there}/points"), "held": waits}
        AttemptLogWriter(self.path, self.run, self.schema.json()).commit([Written({o: n}) for o, names in made.items() for n in names], number)
        self.log.append({"run": self.run, "batch": number, **made})
        if last:
            at = spark._jvm.org.apache.hadoop.fs.Path
            files = at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            for name in (n for o in STATE for n in last[o]):
                files.delete(at(f"{self.path}/{name}"), False)

    def _made(self, spark: SparkSession, folder: str) -> list[str]:
        at = spark._jvm.org.apache.hadoop.fs.Path
        found = at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at(f"{self.path}/{folder}/*.parquet"))
        return sorted(f"{folder}/{s.getPath().getName()}" for s in found or [])


def _kept_in(spark: SparkSession, checkpoint: str, state: str | None) -> str:
    """What a checkpoint has begun with, or else what is asked for."""
    there = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/{name}")
    files = there("offsets").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    begun = ("store" if files.exists(there("state")) else "files") if files.exists(there("offsets")) else None
    if state not in (None, "files", "store") or (state and begun and state != begun):
        raise ValueError(f"state in {state}; this checkpoint has it in {begun or 'neither files nor the store yet'}")
    return begun or state or "files"


def append_attempts(
    spark: SparkSession, attempts: DataFrame, path: str, checkpoint: str, *, by: tuple[str, ...] = ("condition_key", "task_id"), order: str = "i",
    passed: str = "passed", species: str = "species", also: tuple[str, ...] = (), trigger: dict[str, Any] | None = None,
    state: str | None = None,
) -> StreamingQuery:
    """Append a stream of attempts to the log at ``path``: each (by, order) once, in order, species marked where first seen.

    A restart from the same checkpoint goes on; a new checkpoint takes its
    state from the log, so that reading the input again adds only what is
    missing.  Attempts wait in state until their predecessor has come, so
    numbers without a hole are in the log at any time.  ``state`` is ``files``
    (large batches) or ``store`` (many small ones over a long log); a
    checkpoint stays with the one it began with.
    """
    needs = [passed, species, *also]
    types = {f.name: f.dataType for f in attempts.schema.fields}
    where = _kept_in(spark, checkpoint, state)
    run = _run_of(spark, checkpoint)
    trigger = trigger or {"availableNow": True}
    if where == "files":
        require_plain(attempts, [order, *needs])
        number = F.coalesce(F.col(order).cast("bigint"), F.raise_error(F.lit("an attempt has no number")).cast("bigint")).alias(order)
        rows = attempts.select(*by, number, *needs)
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), T.StructField("first_seen", T.BooleanType())])
        fold = InFiles(spark, path, run, schema, list(by), order, passed, species, list(also))
        return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    spark.dataSource.register(AttemptLog)
    yields = ", ".join([*(f"`{c}` {types[c].simpleString()}" for c in needs), "first_seen boolean"])
    initial = resume_points(spark, path, list(by), order, species)
    folded = fold_in_order(attempts, FirstSeen, list(by), order, needs, yields, initial=initial, passed=passed, species=species)
    stream = folded.drop("in_order").writeStream.format("attempt_log").outputMode("append").option("path", path).option("run", run)
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()
