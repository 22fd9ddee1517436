"""Event-time order over streams: rows of a key wait in state until the watermark has passed them and are then folded in (ts, event_id) order.

The result doesn't depend on triggers, on the order of arrival or on restarts, as long as no row comes later than the watermark allows; rows
that do are dropped, as with any watermark. State is bounded by the rows inside the watermark's span and one row for each key seen within
`idle`, after which the key is forgotten. Keys share a state and a timer by buckets. The states need the RocksDB store (`rocksdb`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Groups of keys that share a state. A query's checkpoint holds to this number.
BUCKETS = 256
#: Columns of the rows that wait, and the schema of a state of packed rows.
HELD, PACKED = ("key", "us", "event_id", "value"), "rows binary"

#: (values in order, places where runs of one key start, state before each run or None) -> (state after each run, output columns)
Fold = Callable[[np.ndarray, np.ndarray, list[tuple | None]], tuple[list[tuple], dict]]


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their states on disk; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def dealt(key: str) -> Column:
    """The bucket of a key. Calls of the state store and timers go from Python to the JVM one by one, so states are kept by bucket and
    not by key; a bucket holds the share of a BUCKETS-th of all keys."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def packed(columns: dict[str, list] | pa.Table) -> tuple[bytes]:
    """Rows as one value of a state, an Arrow table; the state's schema is PACKED."""
    table, sink = columns if isinstance(columns, pa.Table) else pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def tabled(value: tuple) -> pa.Table:
    """The table of `packed`."""
    return pa.ipc.open_stream(bytes(value[0])).read_all()


def unpacked(value: tuple) -> list[tuple]:
    """The rows of `packed`."""
    return list(zip(*(c.to_pylist() for c in tabled(value).columns), strict=True))


def _typed(table: pa.Table) -> pa.Table:
    """Columns of nothing but nulls as strings, which can be sorted."""
    return table.cast(pa.schema([(f.name, pa.string() if pa.types.is_null(f.type) else f.type) for f in table.schema]))


def ends_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The last place of each run of n rows."""
    return np.append(starts[1:], n) - 1


class InOrder(StatefulProcessor):
    """Holds the rows of a bucket of keys in a list state, an element for each arrival, with one timer: at the earliest held row, or when the
    first key has been idle for long enough."""

    def __init__(self, fold: Fold, columns: list[str], idle_ms: int):
        self.fold, self.columns, self.idle_us = fold, columns, idle_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.last = handle.getValueState("last", PACKED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [pdf for pdf in rows if len(pdf)]
        self.waiting.appendList([packed(pa.Table.from_pandas(pdf[list(HELD)], preserve_index=False).replace_schema_metadata()) for pdf in new])
        self._set_timer(min(int(pdf.us.min()) for pdf in new) // 1000)
        return iter(())

    def _set_timer(self, at_ms: int) -> None:
        """The bucket's timer, unless an earlier one is set."""
        timers = list(self.handle.listTimers())
        if all(at_ms < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(at_ms))

    def _judged(self, ready: pa.Table, last: dict[str | None, tuple]) -> pd.DataFrame:
        """The output for rows in the order of (key, us, event_id). last has the time of each key's last row with the fold's state, and is
        brought up to date. Rows are judged by columns; only keys and their runs are gone through one by one."""
        key, us = ready["key"].to_numpy(), ready["us"].to_numpy()
        other = np.ones(len(key), dtype=bool)
        other[1:] = key[1:] != key[:-1]
        new = other.copy()  # a key is forgotten after the idle time, whenever its timer comes
        new[1:] |= us[1:] - us[:-1] > self.idle_us
        starts = np.flatnonzero(new)
        found = [last.get(key[i]) if other[i] else None for i in starts]
        states = [v[1:] if v is not None and us[i] - v[0] <= self.idle_us else None for i, v in zip(starts, found, strict=True)]
        after, out = self.fold(ready["value"].to_numpy(), starts, states)
        for i, state in zip(ends_of(starts, len(key)), after, strict=True):
            last[key[i]] = (int(us[i]), *state)
        return pd.DataFrame({"key": key, "event_id": ready["event_id"].to_numpy(), **out}, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        for t in list(self.handle.listTimers()):  # the expired one among them
            self.handle.deleteTimer(t)
        last = {r[0]: r[1:] for r in unpacked(self.last.get())} if self.last.exists() else {}
        out, ahead, parts = pd.DataFrame(columns=self.columns), [], [tabled(part) for part in self.waiting.get()]
        if parts:
            held = _typed(pa.concat_tables(parts, promote_options="permissive"))
            come = pc.less_equal(held["us"], now_us)
            ready, later = held.filter(come), held.filter(pc.invert(come))
            if len(ready):
                out = self._judged(ready.sort_by([(c, "ascending") for c in HELD]), last)
            if len(later):
                self.waiting.put([packed(later)])
                ahead = [pc.min(later["us"]).as_py() // 1000]
            else:
                self.waiting.clear()
        last = {k: v for k, v in last.items() if v[0] + self.idle_us >= now_us}  # what comes later than that finds its key forgotten
        if last:
            self.last.update(packed({str(i): list(c) for i, c in enumerate(zip(*((k, *v) for k, v in last.items()), strict=True))}))
        else:
            self.last.clear()
        ahead = ahead or [(v[0] + self.idle_us) // 1000 + 1 for v in last.values()]
        if ahead:
            self._set_timer(min(ahead))
        yield out

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, value: str, fold: Fold, output: str, late: str, idle_ms: int = 90 * DAY_MS) -> DataFrame:
    """key and the columns of `output` for the rows of events (key, event_id, ts, value), folded in order. Keys pass as strings, so that a null
    among them changes no other."""
    kind = events.schema[key].dataType
    slim = events.select(dealt(key), F.col(key).cast("string").alias("key"), F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).alias("value"))
    slim = slim.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    names = [part.split()[0] for part in output.split(",")]
    found = slim.groupBy("bucket").transformWithStateInPandas(InOrder(fold, ["key", *names], idle_ms), f"key string, {output}", "append", "EventTime")
    return found.select(F.col("key").cast(kind).alias(key), *names)
