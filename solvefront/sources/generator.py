"""A data source that draws attempts: ``spark.read.format("mock_attempts")``, one partition a block of tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from solvefront.operators.simulate import TOY, mock_draw


class MockAttempts(DataSource):
    """Exact draws of the mock model over the toy family.

    Options: n (samples a task, 100), temperature (0.8), seed (0), model
    ("mock"), tasks (comma-separated, default all), partitions (8).  The draw
    of (task, index) needs no other, so any cut into partitions gives the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "mock_attempts"

    def schema(self) -> str:
        return "task_id string, i bigint, temperature double, passed boolean, species int"

    def reader(self, schema) -> DataSourceReader:
        return _Draws(self.options)


class _Draws(DataSourceReader):
    def __init__(self, options) -> None:
        self.n, self.seed = int(options.get("n", 100)), int(options.get("seed", 0))
        self.temperature, self.model = float(options.get("temperature", 0.8)), options.get("model", "mock")
        self.blocks = max(1, int(options.get("partitions", 8)))
        self.tasks = [t for t in options.get("tasks", ",".join(TOY)).split(",") if t]
        if unknown := [t for t in self.tasks if t not in TOY]:
            raise ValueError(f"unknown tasks {unknown}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.blocks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(partition.value, self.n, self.blocks):
            for task in self.tasks:
                p, weights = TOY[task]
                power = min(50.0, 1.0 / max(self.temperature, 1e-6))
                raised = [w**power for w in weights] if self.temperature > 0 else list(weights)
                total = sum(raised)
                even = [1.0 / len(raised)] * len(raised)
                passed, species = mock_draw(self.seed, self.model, task, self.temperature, i, p, [w / total for w in raised] if total > 0 else even)
                yield task, i, self.temperature, passed, species


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MockAttempts)
