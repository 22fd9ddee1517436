"""Streaming twins of the lifecycle and telemetry operators. Every state is bounded by the watermark on ts or by one row a key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import PACKED, dealt, ends_of, in_order, packed, unpacked

LATE = "1 hour"


def json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON files of a folder; the query's checkpoint remembers what has been read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events with a zoned ts and a watermark on it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def running_cost(costed: DataFrame, keys: tuple[str, ...] = ("project_id", "task_name")) -> DataFrame:
    """Counts, tokens and cost so far; for update mode into sinks.KeyedLog, or for complete mode."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_micros")]
    return costed.groupBy(*keys).agg(F.count("*").alias("invocations"), *sums)


# --- queue ---------------------------------------------------------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    """slug, status by the latest (ts, event_id); for complete mode and for batch."""
    return events.groupBy("slug").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def status_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("status").agg(F.count("*").alias("jobs"))


class _Latest(StatefulProcessor):
    """The latest status of each job of a bucket as state. A change is one job less of the old status and one more of the new; the changes of
    a batch are added up, so both sides of a change come at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", PACKED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = {r[0]: r[1:] for r in unpacked(self.now.get())} if self.now.exists() else {}
        new = dict(old)
        for pdf in rows:
            for slug, *at in zip(*(pdf[c].tolist() for c in ("slug", "us", "event_id", "status")), strict=True):
                if slug not in new or (at[0], at[1]) > new[slug][:2]:
                    new[slug] = tuple(at)
        if new != old:
            self.now.update(packed({str(i): list(c) for i, c in enumerate(zip(*((k, *v) for k, v in new.items()), strict=True))}))
        jobs = Counter(v[2] for v in new.values())
        jobs.subtract(v[2] for v in old.values())
        yield pd.DataFrame([(status, n) for status, n in jobs.items() if n], columns=["status", "jobs"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """status, jobs: signed numbers of jobs as they change their status, by the latest (ts, event_id), whatever the order of arrival. events:
    slug, status, ts, event_id. One state row a job, kept by buckets; for append mode into sinks.Totals. Needs the RocksDB store."""
    slim = events.where("ts is not null").select(dealt("slug"), F.col("slug").cast("string").alias("slug"), "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("bigint").alias("event_id"))
    return slim.groupBy("bucket").transformWithStateInPandas(_Latest(), "status string, jobs bigint", "append", "None")


# --- cache keys ----------------------------------------------------------------------------------------------------


def distinct_keys(events: DataFrame, key: str = "cache_key", late: str = LATE) -> DataFrame:
    """The event of each key that arrives first; a key is forgotten when the watermark passes."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])


def span_of(ts: Column, span: str) -> Column:
    return F.window(ts, span)


def first_calls(keyed: DataFrame, key: str = "cache_key", span: str = "1 day", late: str = LATE) -> DataFrame:
    """key, since, event_id, hits: the first call of each key in each span of time by (ts, event_id), and the calls after it that the cache
    answers. It comes when the watermark passes the span, so neither triggers nor the order of arrival matter; the state is dropped with it."""
    groups = timed(keyed, late).groupBy(span_of(F.col("ts"), span).alias("span"), key)
    found = groups.agg(F.min(F.struct("ts", "event_id")).alias("first"), (F.count("*") - 1).alias("hits"))
    return found.select(key, F.col("span.start").alias("since"), F.col("first.event_id").alias("event_id"), "hits")


# --- states and budgets --------------------------------------------------------------------------------------------


def transition_checks(events: DataFrame, allowed: set[tuple[str, str]], late: str = LATE) -> DataFrame:
    """project_id, event_id, from_state, state, verdict for events (project_id, event_id, ts, state): allowed, disallowed or first, in the order
    of (ts, event_id). Rows wait for the watermark, so a row that comes late, but within `late`, is judged in its place. Needs the RocksDB
    store; see ordered.in_order."""
    pairs = set(allowed)

    def fold(states: np.ndarray, starts: np.ndarray, before: list[tuple | None]) -> tuple[list[tuple], dict]:
        old = np.append([None], states[:-1]).astype(object)
        old[starts] = [b[0] if b else None for b in before]
        verdicts = ["allowed" if p in pairs else "disallowed" for p in zip(old, states, strict=True)]
        for i, b in zip(starts, before, strict=True):
            if b is None:
                verdicts[i] = "first"
        return [(x,) for x in states[ends_of(starts, len(states))]], {"from_state": old, "state": states, "verdict": verdicts}

    return in_order(events, "project_id", "state", fold, "event_id bigint, from_state string, state string, verdict string", late)


def budget_checks(costed: DataFrame, limit_micros: int, late: str = LATE) -> DataFrame:
    """project_id, event_id, spent_before, refused: the cost so far, carried as state, in the order of (ts, event_id). Rows wait for the
    watermark. Needs the RocksDB store; see ordered.in_order."""

    def fold(micros: np.ndarray, starts: np.ndarray, before: list[tuple | None]) -> tuple[list[tuple], dict]:
        ends = ends_of(starts, len(micros))
        earlier = np.cumsum(micros) - micros
        carried = np.array([b[0] if b else 0 for b in before], dtype=np.int64) - earlier[starts]
        spent = earlier + np.repeat(carried, ends - starts + 1)
        return [(int(x),) for x in (spent + micros)[ends]], {"spent_before": spent, "refused": spent >= limit_micros}

    costs = costed.withColumn("cost_micros", F.coalesce(F.col("cost_micros").cast("bigint"), F.lit(0)))
    return in_order(costs, "project_id", "cost_micros", fold, "event_id bigint, spent_before bigint, refused boolean", late)
