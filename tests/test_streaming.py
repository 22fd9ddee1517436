"""Streaming twins against their batch forms, over several turns, rows out of order and repeated batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuetrail.operators import lifecycle as L
from cuetrail.operators import telemetry as T
from cuetrail.plans import tables
from cuetrail.sources.scratch import scratch_dir
from cuetrail.streaming import jobs, sinks
from cuetrail.streaming.ordered import ends_of, in_order, rocksdb
from cuetrail.streaming.replay import play, played

SF = "/root/testdata/sf0.001"
EVENTS = "project_id bigint, event_id bigint, ts timestamp, state string"


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / f"{name}-in")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("turns", [1, 4])
def test_transitions_whatever_the_turns(spark, turns):
    h = tables.history(spark, SF)
    got = played(h, lambda s: jobs.transition_checks(s, set(tables.ALLOWED)), turns=turns)
    allowed = spark.createDataFrame(tables.ALLOWED, "from_state string, state string")
    want = {(r.event_id, r.from_state, r.state) for r in L.violations(h, allowed).collect()}
    assert {(r.event_id, r.from_state, r.state) for r in got.where("verdict = 'disallowed'").collect()} == want
    assert got.count() == h.count()


def test_late_rows_null_keys_and_forgotten_projects(spark):
    """A row within the watermark is judged in its place, one beyond it is dropped; rows without a project are a project; after 90 idle days
    a project is new again."""
    folder = scratch_dir(spark)
    rows = [
        [(1, 1, at(0), "view"), (1, 3, at(20), "purchase"), (None, 4, at(5), "error")],
        [(1, 2, at(10), "click"), (None, 5, at(6), "view")],  # late, but within the hour
        [(2, 6, at(300), "view")],
        [(1, 7, at(1), "error")],  # beyond it
        [(2, 8, at(300 + 200 * 1440), "view")],
        [(1, 9, at(301 + 200 * 1440), "signup"), (2, 10, at(400 + 200 * 1440), "click")],
        [(3, 11, at(500_000), "view")],
    ]
    build = None
    for part in rows:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        build = build or jobs.transition_checks(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), set(tables.ALLOWED))
        with rocksdb(spark):
            q = build.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
    got = {r.event_id: (r.project_id, r.from_state, r.verdict) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {
        1: (1, None, "first"), 2: (1, "view", "allowed"), 3: (1, "click", "allowed"), 4: (None, None, "first"), 5: (None, "error", "allowed"),
        6: (2, None, "first"), 8: (2, None, "first"), 9: (1, None, "first"), 10: (2, "view", "allowed"),
    }


def test_budget_of_one_hot_project(spark):
    """All rows are one project's, ties in ts included; the batch form deals them by days."""
    c = spark.range(3000).select(F.lit(7).alias("project_id"), F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id / 3) * 7)").alias("ts"), (F.col("id") % 11).alias("cost_micros"))
    batch = {r.event_id: (r.spent_before, r.refused) for r in T.budget_guard(c, 5000, slice_by="hour").collect()}
    spent = 0
    for i in range(3000):
        assert batch[i] == (spent, spent >= 5000)
        spent += i % 11
    got = played(c, lambda s: jobs.budget_checks(s, 5000), disorder_s=60)
    assert {r.event_id: (r.spent_before, r.refused) for r in got.collect()} == batch


def test_budget_without_keys_or_times(spark):
    rows = [(None, 1, None, 5), (None, 2, at(1), 6), (1, 3, at(0), 7), (1, 4, at(2000), 8)]
    c = spark.createDataFrame(rows, "project_id bigint, event_id bigint, ts timestamp, cost_micros bigint")
    assert {r.event_id: r.spent_before for r in T.budget_guard(c, 6).collect()} == {1: 0, 2: 5, 3: 0, 4: 7}
    assert T.budget_guard(c.limit(0), 6).count() == 0


def test_running_cost(spark, tmp_path):
    c = tables.costed(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    total = run(jobs.running_cost(stream(spark, c, tmp_path, "r")), "complete", tmp_path, "running_cost")
    assert {(r.project_id, r.task_name): r.cost_micros for r in total.collect()} == {(r.project_id, r.task_name): r.m for r in c.groupBy("project_id", "task_name").agg(F.sum("cost_micros").alias("m")).collect()}


def test_keys_and_status(spark, tmp_path):
    e = tables.history(spark, SF).select(F.col("project_id").alias("cache_key"), "event_id", "ts", F.col("project_id").alias("slug"), F.col("state").alias("status")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(jobs.distinct_keys(stream(spark, e, tmp_path, "k"), late="3650 days"), "append", tmp_path, "distinct_keys")
    assert got.count() == e.select("cache_key").distinct().count()
    last = run(jobs.latest_status(stream(spark, e, tmp_path, "s")), "complete", tmp_path, "latest_status")
    assert {r.status: r.jobs for r in jobs.status_counts(last).collect()} == {r.status: r.jobs for r in jobs.status_counts(jobs.latest_status(e)).collect()}


def test_status_whatever_the_order_and_repeated_batches(spark):
    """An older status that comes later changes nothing, and neither does a batch that is published twice."""
    folder = scratch_dir(spark)
    totals = sinks.Totals(spark, f"{folder}/status", ("status",), "jobs")
    counts = lambda: {r.status: r.jobs for r in totals.read().collect()}

    def twice(changes, batch_id):
        totals.publish(changes, batch_id)
        totals.publish(changes, batch_id)

    rows = [[(1, "pending", at(0), 1), (2, "pending", at(0), 2)], [(1, "done", at(9), 3), (2, None, at(5), 4)], [(1, "failed", at(4), 5), (3, "pending", at(1), 6)]]
    want = [{"pending": 2}, {"done": 1, None: 1}, {"done": 1, None: 1, "pending": 1}]
    build, schema = None, "slug bigint, status string, ts timestamp, event_id bigint"
    for part, counted in zip(rows, want, strict=True):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        build = build or jobs.status_changes(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        with rocksdb(spark):
            build.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        assert counts() == counted


def test_keyed_log_keeps_the_last_row(spark):
    log = sinks.KeyedLog(spark, scratch_dir(spark), ("k",))
    row = lambda *r: spark.createDataFrame(list(r), "k int, n int")
    log.write(row((1, 1), (None, 5)), 0)
    log.write(row((1, 2), (2, 7)), 1)
    log.write(row((1, 2), (2, 7)), 1)
    want = {(1, 2), (2, 7), (None, 5)}
    assert {tuple(r) for r in log.read().collect()} == want
    log.compact()
    assert {tuple(r) for r in log.read().collect()} == want


def test_first_calls_and_an_empty_stream(spark):
    schema = "cache_key string, event_id bigint, ts timestamp"
    rows = [("a", 1, at(0)), ("a", 2, at(1)), ("a", 3, at(1500)), (None, 4, at(3)), (None, 5, at(2)), ("b", 6, None)]
    got = played(spark.createDataFrame(rows, schema), jobs.first_calls)
    assert {(r.cache_key, r.event_id, r.hits) for r in got.collect()} == {("a", 1, 1), ("a", 3, 0), (None, 5, 1)}
    empty = play(spark.createDataFrame([], schema), lambda s, folder: jobs.first_calls(s).writeStream.format("parquet").option("path", f"{folder}/out"))
    assert spark.read.schema("cache_key string").parquet(f"{empty}/out").count() == 0


def state_rows(build):
    """Rows of the state after one batch."""
    with rocksdb(build.sparkSession):
        q = build.writeStream.format("noop").option("checkpointLocation", f"{scratch_dir(build.sparkSession)}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])


def test_budget_states_by_buckets(spark, tmp_path):
    """Keys share states, so calls of the store don't grow with them; keys beyond 2**53 beside a null one stay what they are."""
    many = spark.range(6000).selectExpr("id as project_id", "id as event_id", "timestamp'2024-01-01' as ts", "1L as cost_micros")
    assert state_rows(jobs.budget_checks(stream(spark, many, tmp_path, "many"), 5)) < 6000
    big = 2**53
    rows = [(big + i % 2 if i < 6 else None, i, at(i), 10 + i) for i in range(8)]
    got = played(spark.createDataFrame(rows, "project_id bigint, event_id bigint, ts timestamp, cost_micros bigint"), lambda s: jobs.budget_checks(s, 20), turns=2)
    want = {(big, 0, 0), (big, 2, 10), (big, 4, 22), (big + 1, 1, 0), (big + 1, 3, 11), (big + 1, 5, 24), (None, 6, 0), (None, 7, 16)}
    assert {(r.project_id, r.event_id, r.spent_before) for r in got.collect()} == want


def test_transition_states_by_buckets(spark, tmp_path):
    many = spark.range(6000).selectExpr("id as project_id", "id as event_id", "timestamp'2024-01-01' as ts", "'view' as state")
    assert state_rows(jobs.transition_checks(stream(spark, many, tmp_path, "many"), set(tables.ALLOWED))) < 6000


def test_rows_are_judged_by_columns(spark):
    """The rows of a bucket's keys pass in one call; a null key and null values among them, and keys that were idle start anew."""

    def fold(values, starts, before):
        after = [(values[i],) for i in ends_of(starts, len(values))]
        known = [b is not None for b in before]
        return after, {"runs": [len(starts)] * len(values), "known": [k for k, n in zip(known, ends_of(starts, len(values)) - starts + 1, strict=True) for _ in range(n)]}

    events = spark.range(3000).selectExpr("if(id % 1000 = 7, null, id % 1000) as project_id", "id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 100 * int(id / 2000), 0, 0, id / 10) as ts", "cast(null as string) as state")
    got = played(events, lambda s: in_order(s, "project_id", "state", fold, "event_id bigint, runs bigint, known boolean", "1 hour"), turns=1).collect()
    assert sorted(r.event_id for r in got) == list(range(3000)) and max(r.runs for r in got) > 1
    assert {r.project_id for r in got} == {None, *range(1000)} - {7} and not any(r.known for r in got)


def test_status_states_by_buckets(spark, tmp_path):
    """Jobs share states, and a batch gives sums of changes and not a row a job."""
    many = spark.range(6000).selectExpr("id as slug", "if(id % 3 = 0, null, 'done') as status", "timestamp'2024-01-01' as ts", "id as event_id")
    build = jobs.status_changes(stream(spark, many, tmp_path, "many"))
    assert state_rows(build) < 6000
    with rocksdb(spark):
        rows = run(build, "append", tmp_path, "status_rows").collect()
    assert len(rows) < 1000 and {s: sum(r.jobs for r in rows if r.status == s) for s in (None, "done")} == {None: 2000, "done": 4000}
