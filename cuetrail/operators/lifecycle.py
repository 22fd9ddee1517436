"""Project states, queues and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(keys):
    return W.partitionBy(*keys).orderBy("ts", "event_id")


def transitions(history: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """history: keys, state, ts, event_id. Adds from_state (null at first), dwell_us and dwell_s, the time until the next state (null at last)."""
    w = _order(keys)
    dwell = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return history.withColumns({"from_state": F.lag("state").over(w), "dwell_us": dwell}).withColumn("dwell_s", F.col("dwell_us").cast("double") / 1e6)


def violations(history: DataFrame, allowed: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """State changes that `allowed` (from_state, state) lacks; the first state of a project is no change."""
    return transitions(history, keys).where("from_state is not null").join(allowed, ["from_state", "state"], "left_anti")


def latest_state(history: DataFrame, keys: tuple[str, ...] = ("project_id",), error: str = "error") -> DataFrame:
    """keys, state and ts of the last state by (ts, event_id), changes, and error_ts, the time of the last error state (null without one)."""
    at = F.struct("ts", "event_id")
    return history.groupBy(*keys).agg(F.max_by("state", at).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("changes"), F.max(F.when(F.col("state") == error, F.col("ts"))).alias("error_ts"))


def next_state(state: Column, path: list[str]) -> Column:
    """The state after this one on the path; null at its end and for states beside it."""
    p = F.array(*(F.lit(s) for s in path))
    at = F.array_position(p, state).cast("int")
    return F.when(at > 0, F.get(p, at))


def queue_status(jobs: DataFrame) -> DataFrame:
    """status, jobs: the number of jobs of each status. jobs: slug, status."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def queue_listing(jobs: DataFrame) -> DataFrame:
    """status, place, slug: the jobs of each status by (enqueued_at, slug), numbered from 1. Rows, not arrays: a status may hold most jobs.
    A window by status would number them in one task, so each is numbered within its day, and days are added up."""
    day = jobs.withColumn("__day", F.to_date("enqueued_at"))
    sizes = day.groupBy("status", "__day").agg(F.count("*").alias("__n"))
    before = sizes.select("status", "__day", F.coalesce(F.sum("__n").over(W.partitionBy("status").orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(W.partitionBy("status", "__day").orderBy("enqueued_at", "slug"))
    same = F.col("a.status").eqNullSafe(F.col("b.status")) & F.col("a.__day").eqNullSafe(F.col("b.__day"))
    return day.withColumn("__at", at).alias("a").join(before.alias("b"), same).select("a.status", (F.col("__before") + F.col("__at")).alias("place"), "slug")


def fifo_head(jobs: DataFrame, n: int, status: str) -> DataFrame:
    """The n oldest jobs of a status."""
    return jobs.where(F.col("status") == status).orderBy("enqueued_at", "slug").limit(n)


def target_minutes(minutes: Column, share: Column, explicit: Column) -> Column:
    """Struct of target, low, high: the explicit target or the share of the source's length (half a minute at least), with 15 % to either
    side; 20 to 30 minutes where the length is unknown."""
    t = F.coalesce(explicit, F.when(minutes.isNotNull(), F.greatest(F.lit(0.5), minutes * share)))
    return F.struct(F.coalesce(t, F.lit(25.0)).alias("target"), F.coalesce(t * 0.85, F.lit(20.0)).alias("low"), F.coalesce(t * 1.15, F.lit(30.0)).alias("high"))
