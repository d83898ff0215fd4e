"""Folds over sequences that arrive in any order: keyed state that holds early rows, with event-time expiry.

Each key's rows are numbered.  A row is folded once all before it are; rows
that come early wait in a state map, in chunks of consecutive numbers, over as
many batches as it takes.  So what a stream yields equals the batch window
over the same rows, whatever the order of arrival.  Where the caller names a
gap, a key that has seen no row for that long of event time gives up what is
missing, folds what it holds, and leaves the state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What can wait in the map as JSON and come back as it was.
PLAIN = ("string", "bigint", "int", "double", "boolean")


class InOrder(StatefulProcessor):
    """The common part: numbering, holding, expiry.  A subclass says what is known at first and what a row makes of it."""

    KNOWN = "known bigint"

    def __init__(self, order: str, columns: list[str], names: list[str], first: int, time: str | None, gap_ms: int):
        self.order, self.columns, self.first, self.time, self.gap_ms = order, columns, first, time, gap_ms
        self.row = Row(*names)

    def start(self) -> tuple:
        """The fields of ``KNOWN`` before any row."""
        raise NotImplementedError

    def fold(self, known: tuple, row: dict[str, Any]) -> tuple[tuple, tuple]:
        """(what is known after the row, the values it yields)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", f"next bigint, held bigint, until bigint, {self.KNOWN}")
        self.held = handle.getMapState("held", "first bigint", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        position, count, until, *known = self.at.get() if self.at.exists() else (self.first, 0, 0, *self.start())
        known, fresh, latest = tuple(known), {}, until
        for r in rows:
            if self.gap_ms:
                latest = max(latest, int(r[self.time].timestamp() * 1000) + self.gap_ms)
            if r[self.order] >= position:  # earlier numbers have had their turn: repeats change nothing
                fresh.setdefault(r[self.order], {c: r[c] for c in self.columns})
        if count:
            # Chunks that may go on from here, or that hold what has come again.
            for (first,) in sorted(tuple(k) for k in self.held.keys()):
                if first in fresh or first <= position or first - 1 in fresh:
                    for row in json.loads(self.held.getValue((first,))[0]):
                        fresh.setdefault(row[self.order], row)
                    self.held.removeKey((first,))
                    count -= 1
        while position in fresh:
            known, made = self.fold(known, fresh.pop(position))
            yield self.row(*self._key(key), position, True, *made)
            position += 1
        for chunk in self._chunks({n: r for n, r in fresh.items() if n > position}):
            self.held.updateValue((chunk[0][self.order],), (json.dumps(chunk),))
            count += 1
        if latest != until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.at.update((position, count, latest, *known))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        position, _, _, *known = self.at.get()
        known = tuple(known)
        waiting = {row[self.order]: row for k in list(self.held.keys()) for row in json.loads(self.held.getValue(tuple(k))[0])}
        for n in sorted(waiting):
            known, made = self.fold(known, waiting[n])
            yield self.row(*self._key(key), n, n == position, *made)
            position = n + 1 if n == position else position
        self.held.clear()
        self.at.clear()

    def _chunks(self, rows: dict[int, dict]) -> Iterator[list[dict]]:
        chunk: list[dict] = []
        for n in sorted(rows):
            if chunk and n != chunk[-1][self.order] + 1:
                yield chunk
                chunk = []
            chunk.append(rows[n])
        if chunk:
            yield chunk

    @staticmethod
    def _key(key: Any) -> tuple:
        return tuple(key) if isinstance(key, tuple) else (key,)


class Seen(InOrder):
    """The messages of a conversation known before each call: the longest request so far, and one more for each reply."""

    def start(self) -> tuple:
        return (0,)

    def fold(self, known: tuple, row: dict[str, Any]) -> tuple[tuple, tuple]:
        return (max(known[0], int(row["n_messages"])) + int(bool(row["ok"])),), (known[0],)


class Budget(InOrder):
    """Running spend: a charge that does not fit is refused, and later ones may still fit."""

    KNOWN = "spent double"

    def __init__(self, *args: Any, cost: str, cap: float):
        super().__init__(*args)
        self.cost, self.cap = cost, cap

    def start(self) -> tuple:
        return (0.0,)

    def fold(self, known: tuple, row: dict[str, Any]) -> tuple[tuple, tuple]:
        after = known[0] + float(row[self.cost])
        return ((after,), (True, after)) if after <= self.cap else (known, (False, known[0]))


def require_plain(rows: DataFrame, columns: list[str]) -> None:
    odd = [f.name for f in rows.schema.fields if f.name in columns and f.dataType.simpleString() not in PLAIN]
    if odd:
        raise TypeError(f"these columns cannot wait in state: {odd}")


def fold_in_order(
    rows: DataFrame, kind: type[InOrder], by: list[str], order: str, needs: list[str], yields: str, *, first: int = 0, time: str | None = None,
    delay: str = "10 minutes", gap_seconds: int = 0, initial: DataFrame | None = None, **options: Any,
) -> DataFrame:
    """(by, order, in_order, what the fold yields), in append mode.

    ``in_order`` is false for rows that were folded after a hole was given up,
    which happens only where ``time`` and ``gap_seconds`` are given.  Rows that
    come again are ignored; rows behind the watermark are late and ignored.
    State is one row a key and the rows that wait.  Keyed processors need the
    RocksDB state store, which is set for the session's streams started from here on.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    require_plain(rows, [order, *needs])
    if gap_seconds and not time:
        raise ValueError("a gap needs the column of event time")
    kept = [*by, order, *[c for c in needs if c not in by]]
    if gap_seconds:
        rows = rows.withWatermark(time, delay)
    narrow = rows.select(*[F.col(c).cast("bigint").alias(c) if c == order else F.col(c) for c in kept], *([time] if gap_seconds else []))
    schema = T._parse_datatype_string(", ".join([*(f"`{c}` {types[c]}" for c in by), f"`{order}` bigint", "in_order boolean", yields]))
    processor = kind(order, [order, *[c for c in needs if c not in by]], schema.names, first, time, gap_seconds * 1000, **options)
    mode = "eventtime" if gap_seconds else "none"
    return narrow.groupBy(*by).transformWithState(processor, schema, "append", mode, initial.groupBy(*by) if initial is not None else None)


def stateful_seen(events: DataFrame, key: str = "conversation", order: str = "seq", **options: Any) -> DataFrame:
    """(key, order, in_order, seen) of rows with n_messages and ok: the stream's form of ``trace.seen_before``."""
    return fold_in_order(events, Seen, [key], order, ["n_messages", "ok"], "seen bigint", **options)


def stateful_budget(charges: DataFrame, cap: float, key: str = "account", order: str = "seq", cost: str = "cost", **options: Any) -> DataFrame:
    """(key, order, in_order, accepted, spent): the stream's form of ``budget.charge_in_order``."""
    return fold_in_order(charges, Budget, [key], order, [cost], "accepted boolean, spent double", cost=cost, cap=float(cap), **options)
