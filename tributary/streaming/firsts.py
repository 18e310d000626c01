"""The first record of each key on a stream, by an order id, whatever the order in which records arrive.

Two forms. ``first_changes`` is exact under any disorder: it sends a record as soon as it is the first of its key so far,
with the id of the one it replaces, and keeps an id a key. ``first_settled`` sends one record a key, when the watermark has
passed it, and keeps the record until then; where order ids do not fall while event times rise, this is the record that
``exact_dedup`` keeps in a table of the same rows.

Repeats go before the shuffle: of an Arrow batch only the first record of each key is sent on, so that a key that a third of
all rows have costs its task one row a batch of rows.

Defined results: rows without order id (for ``first_settled``: or event time) are left out; of rows with one key and one
order id one stays; a null key is a key of its own; records keep all their columns under any names, except that
``first_changes`` adds ``fingerprint`` and ``replaces`` in place of columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The state store that processors with several states need; a session's setting, read when a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Batches then add logs of their changes to the checkpoint in place of whole snapshots of every partition.
CHANGELOG = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the first row of every ``fp``, by ``id``."""
    for batch in batches:
        if batch.num_rows > 1:
            ranked = pc.sort_indices(batch.select(["fp", "id"]), sort_keys=[("fp", "ascending"), ("id", "ascending")])
            keys = batch.column("fp").take(ranked)
            begins = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])])
            batch = batch.take(ranked.filter(begins))
        yield batch


def _keyed(records: DataFrame, key: Column, order: str, event_time: str | None = None) -> DataFrame:
    at = {"at": F.col(event_time)} if event_time else {}
    columns = {"fp": F.coalesce(F.md5(key), F.lit("")), "id": F.col(order), **at, "rec": F.struct("*")}
    rows = records.select(*(c.alias(n) for n, c in columns.items()))
    for c in ("id", *at):
        rows = rows.where(F.col(c).isNotNull())
    return rows.mapInArrow(_first_of_batch, rows.schema)


class _Changes(StatefulProcessor):
    """Keeps the smallest id of a key; a record below it goes out."""

    def __init__(self, order: T.DataType):
        self.state = T.StructType([T.StructField("id", order)])

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, known = min(rows, key=lambda r: r["id"]), self.first.get()
        if known is None or best["id"] < known[0]:
            self.first.update((best["id"],))
            yield Row(fingerprint=key[0], rec=best["rec"], replaces=None if known is None else known[0])


class _Settled(StatefulProcessor):
    """Holds the first record of a key until the watermark passes it, and then a mark that the key is done."""

    def __init__(self, row: T.StructType, forget_ms: int | None):
        self.row = T.StructType([row["id"], T.StructField("due", T.LongType()), row["rec"]])
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.row)
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.done.exists():
            best, known = min(rows, key=lambda r: r["id"]), self.held.get()
            if known is None or best["id"] < known[0]:
                due = math.ceil(best["at"].timestamp() * 1000)
                if known is not None:
                    self.handle.deleteTimer(known[1])
                self.handle.registerTimer(due)
                self.held.update((best["id"], due, best["rec"]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.done.exists():
            self.done.clear()
            return
        _, due, rec = self.held.get()
        self.held.clear()
        self.done.update((True,))
        if self.forget_ms is not None:
            self.handle.registerTimer(due + self.forget_ms)
        yield Row(rec=rec)


def first_changes(records: DataFrame, key: Column, order: str = "rec_id") -> DataFrame:
    """An append-only log of firsts: the records that were the first of their key when they came, with ``fingerprint`` and
    ``replaces``, the order id of the record that is the first no longer. ``current_firsts`` gives what stands. A
    million keys take some tens of MB of state; it is spread by key and kept outside the heap."""
    rows = _keyed(records, key, order)
    order_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField("fingerprint", T.StringType()), rows.schema["rec"], T.StructField("replaces", order_type)])
    changes = rows.groupBy("fp").transformWithState(_Changes(order_type), out, "Append", "None")
    return changes.select(*(F.col("rec")[c].alias(c) for c in records.columns if c not in ("fingerprint", "replaces")), "fingerprint", "replaces")


def current_firsts(changes: DataFrame, order: str = "rec_id") -> DataFrame:
    """What stands of a log that ``first_changes`` wrote: the records that no later one replaces."""
    gone = changes.where(F.col("replaces").isNotNull()).select("fingerprint", F.col("replaces").alias(order))
    return changes.join(gone, ["fingerprint", order], "left_anti").select(*(c for c in changes.columns if c not in ("fingerprint", "replaces")))


def first_settled(records: DataFrame, key: Column, event_time: str, delay: str, order: str = "rec_id", forget_ms: int | None = None) -> DataFrame:
    """The first record of each key, once, when the watermark (the latest event time less ``delay``) has passed its event
    time. Rows behind the watermark are left out. A key's mark stays for good, or for ``forget_ms`` of event time, after
    which the key counts as new."""
    rows = _keyed(records, key, order, event_time).withWatermark("at", delay)
    out = T.StructType([rows.schema["rec"]])
    settled = rows.groupBy("fp").transformWithState(_Settled(rows.schema, forget_ms), out, "Append", "EventTime")
    return settled.select("rec.*")
