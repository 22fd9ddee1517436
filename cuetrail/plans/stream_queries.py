"""The streaming jobs over a replay of `events` in several turns, each equal to the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..streaming import jobs, sinks
from ..streaming.replay import play, played
from ..sources.scratch import scratch_dir
from .tables import ALLOWED, COSTED, HISTORY, costed, history, invocations, table
from .telemetry_queries import LIMIT
from .telemetry_queries import SQL as BATCH


def stream_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that aren't allowed, judged in event time."""
    judged = played(history(spark, sf_dir), lambda s: jobs.transition_checks(s, set(ALLOWED)))
    return judged.where("verdict = 'disallowed'").select("project_id", "event_id", "from_state", "state")


def stream_new_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that arrive as packages of files in three turns, with a restart between them: the checkpoint knows the files that were read, so
    each is read once."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"), (F.col("page_id") % 16).alias("package"))
    root = scratch_dir(spark)
    for turn in range(3):
        pages.where(F.pmod("page_id", F.lit(3)) == turn).write.mode("append").partitionBy("package").json(f"{root}/in")
        stream = jobs.json_stream(spark, f"{root}/in", "page_id bigint, url string, n_bytes bigint, package bigint")
        out = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("page_id", "url", "n_bytes", "package")


def stream_budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = costed(spark, sf_dir).select("project_id", "event_id", "ts", "cost_micros")
    return played(slim, lambda s: jobs.budget_checks(s, LIMIT)).select("project_id", "event_id", "spent_before", "refused")


def stream_queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs and event types as their status, as published after the last batch."""
    events = history(spark, sf_dir).select(F.col("project_id").alias("slug"), F.col("state").alias("status"), "ts", "event_id")

    def totals(folder: str) -> sinks.Totals:
        return sinks.Totals(spark, f"{folder}/status", ("status",), "jobs")

    def job(stream: DataFrame, folder: str):
        return jobs.status_changes(stream.where("event_id >= 0")).writeStream.outputMode("append").foreachBatch(totals(folder).publish)

    return totals(play(events, job)).read().select("status", "jobs")


def stream_first_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First call and cache hits of each key and day."""
    keyed = invocations(spark, sf_dir).select("project_id", "task_name", "model_name", "event_id", "ts")
    key = cache_key(F.col("project_id").cast("string"), F.col("task_name"), F.col("model_name"))
    found = played(keyed, lambda s: jobs.first_calls(s.withColumn("cache_key", key)))
    first = keyed.select("event_id", "project_id", "task_name", "model_name")
    return found.join(first, "event_id").select("project_id", "task_name", "model_name", "event_id", "hits")


def stream_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each project and task."""
    slim = costed(spark, sf_dir).select("project_id", "task_name", "input_tokens", "output_tokens", "cost_micros", "ts", "event_id")
    keys = ("project_id", "task_name")

    def job(stream: DataFrame, folder: str):
        log = sinks.KeyedLog(spark, f"{folder}/log", keys)
        return jobs.running_cost(stream.where("event_id >= 0"), keys).writeStream.outputMode("update").foreachBatch(log.write)

    folder = play(slim, job)
    return sinks.KeyedLog(spark, f"{folder}/log", keys).read()


QUERIES = {f.__name__: f for f in (stream_transition_violations, stream_budget_guard, stream_queue_status, stream_first_calls, stream_running_cost, stream_new_packages)}
SQL = {
    "stream_transition_violations": BATCH["state_transition_violations"],
    "stream_budget_guard": f"select project_id, event_id, spent_before, refused from ({BATCH['budget_guard']})",
    "stream_queue_status": f"with {HISTORY}, latest as (select arg_max(state, (ts, event_id)) as status from history group by project_id) select status, CAST(count(*) AS BIGINT) as jobs from latest group by all",
    "stream_first_calls": f"""with {COSTED}, placed as (select *, row_number() over w as place, count(*) over (partition by project_id, task_name, model_name, CAST(ts AS DATE)) as n
  from inv window w as (partition by project_id, task_name, model_name, CAST(ts AS DATE) order by ts, event_id))
select project_id, task_name, model_name, event_id, CAST(n - 1 AS BIGINT) as hits from placed where place = 1""",
    "stream_running_cost": f"""with {COSTED} select project_id, task_name, CAST(count(*) AS BIGINT) as invocations, CAST(sum(input_tokens) AS BIGINT) as input_tokens,
  CAST(sum(output_tokens) AS BIGINT) as output_tokens, CAST(sum(cost_micros) AS BIGINT) as cost_micros from costed group by all""",
    "stream_new_packages": "select page_id, url, CAST(strlen(html) AS BIGINT) as n_bytes, CAST(page_id % 16 AS BIGINT) as package from pages",
}
