"""Telemetry, budget and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..operators import lifecycle as L
from ..operators import telemetry as T
from .tables import ALLOWED, COSTED, HISTORY, PATH, costed, history, invocations, table

_SUMS = "CAST(count(*) AS BIGINT) as invocations, CAST(sum(input_tokens) AS BIGINT) as input_tokens, CAST(sum(output_tokens) AS BIGINT) as output_tokens, CAST(count(*) filter (cache_hit) AS BIGINT) as cache_hits, CAST(sum(cost_micros) AS BIGINT)::DOUBLE / 1e6::DOUBLE as cost_usd"


def cost_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cost_by_task(costed(spark, sf_dir))


def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cost_by_model(costed(spark, sf_dir))


def project_cost_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    projects = customers.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 90).alias("source_minutes"), F.length("c_name").alias("script_chars"))
    return T.project_profile(costed(spark, sf_dir), projects)


def cost_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cost_grouping_sets(costed(spark, sf_dir))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ledger_totals(costed(spark, sf_dir))


def telemetry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of two kinds of artifact, one without latencies, as one table."""
    inv = invocations(spark, sf_dir)
    a = inv.where("task_name in ('view', 'click')").withColumn("artifact", F.lit("script"))
    b = inv.where("task_name not in ('view', 'click')").drop("latency_ms").withColumn("artifact", F.lit("story"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("artifact", "task_name").agg(F.count("*").alias("rows"), F.count("latency_ms").alias("timed"), F.sum("input_tokens").alias("input_tokens"))


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return T.suite_summary(rows.select((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("is_slop"), F.col("n_chars").alias("score"), (F.col("doc_id") % 1000).alias("tokens")))


LIMIT = 5_000


def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.budget_guard(costed(spark, sf_dir), LIMIT).select("project_id", "event_id", "cost_micros", "spent_before", "refused")


def cache_key_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = invocations(spark, sf_dir).withColumn("cache_key", cache_key(F.col("project_id").cast("string"), F.col("task_name"), F.col("model_name")))
    return T.cache_key_repeats(keyed).groupBy("project_id", "task_name").agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))


def costly_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three costliest tasks of each project."""
    by = costed(spark, sf_dir).groupBy("project_id", "task_name").agg(F.sum("cost_micros").alias("cost_micros"))
    w = W.partitionBy("project_id").orderBy(F.desc("cost_micros"), "task_name")
    return by.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def _allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED, "from_state string, state string")


def state_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.violations(history(spark, sf_dir), _allowed(spark)).select("project_id", "event_id", "from_state", "state")


def state_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.transitions(history(spark, sf_dir))
    return d.select("project_id", "event_id", "state", "from_state", F.round(F.col("dwell_us") / 1000.0).cast("bigint").alias("dwell_ms"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_state(history(spark, sf_dir)).select("project_id", "state", "changes")


def next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).withColumn("next", L.next_state(F.col("state"), PATH)).groupBy("state", "next").agg(F.count("*").alias("rows"))


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.queue_status(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderstatus").alias("status")))


def fifo_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("enqueued_at"))
    return L.fifo_head(jobs, 20, "O").select("slug", "status")


def latest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order placed last by each customer."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


def duration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey is not null")
    t = L.target_minutes(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("double")), F.lit(0.25), F.when(F.col("c_custkey") % 11 == 0, F.lit(4.5)))
    return c.select(F.col("c_custkey").alias("project_id"), t.alias("t")).select("project_id", "t.*")


QUERIES = {f.__name__: f for f in (cost_by_task, cost_by_model, project_cost_profile, cost_grouping_sets, ledger_totals, telemetry_union, suite_summary, budget_guard, cache_key_dups, costly_tasks, state_transition_violations, state_dwell, latest_state, next_state, queue_status, fifo_head, latest_project, duration_targets)}

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)
SQL = {
    "cost_by_task": f"""with {COSTED}, sums as (select project_id, task_name, {_SUMS}, CAST(sum(latency_ms) AS BIGINT)::DOUBLE / count(latency_ms) / 1000 as avg_latency_s from costed group by all),
firsts as (select project_id, task_name, model_name, min((ts, event_id)) as f from costed group by all)
select sums.*, (select string_agg(model_name, ',' order by f) from firsts where firsts.project_id = sums.project_id and firsts.task_name = sums.task_name) as models from sums""",
    "cost_by_model": f"""with {COSTED}, m as (select project_id, model_name, {_SUMS}, sum(cost_micros) as c from costed group by all)
select project_id, model_name, invocations, input_tokens, output_tokens, cache_hits, cost_usd,
  case when t <> 0 then CAST(c AS DOUBLE) / CAST(t AS DOUBLE) else 0.0 end * 100 as cost_percent from (select *, sum(c) over (partition by project_id) as t from m)""",
    "project_cost_profile": f"""with {COSTED}, t as (select project_id, {_SUMS} from costed group by all),
p as (select c_custkey as project_id, case when c_custkey % 7 <> 0 then c_custkey % 90 end as m, length(c_name) as n from customer)
select t.project_id, invocations, input_tokens, output_tokens, cost_usd, cache_hits::DOUBLE / invocations::DOUBLE as cache_hit_rate,
  case when m <> 0 then (input_tokens + output_tokens)::DOUBLE / m::DOUBLE else 0.0 end as tokens_per_minute,
  case when m <> 0 then cost_usd / m::DOUBLE else 0.0 end as cost_per_minute,
  case when n <> 0 then (input_tokens + output_tokens)::DOUBLE / n::DOUBLE else 0.0 end as tokens_per_char from t left join p using (project_id)""",
    "cost_grouping_sets": f"with {COSTED} select project_id, task_name, model_name, {_SUMS} from costed group by grouping sets ((project_id, task_name), (project_id, model_name), (project_id))",
    "ledger_totals": f"with {COSTED} select task_name, {_SUMS}, CAST(count(*) filter (cache_hit) AS BIGINT)::DOUBLE / count(*)::DOUBLE as cache_hit_rate from costed group by all",
    "telemetry_union": f"""with {COSTED} select case when task_name in ('view', 'click') then 'script' else 'story' end as artifact, task_name, CAST(count(*) AS BIGINT) as rows,
  CAST(count(case when task_name in ('view', 'click') then latency_ms end) AS BIGINT) as timed, CAST(sum(input_tokens) AS BIGINT) as input_tokens from inv group by all""",
    "suite_summary": """select CAST(count(*) AS BIGINT) as tested, CAST(count(*) filter (quality = 1) AS BIGINT) as passed, CAST(count(*) filter (toxic = 1) AS BIGINT) as slop,
  case when count(*) <> 0 then (count(*) filter (quality = 1))::DOUBLE / count(*)::DOUBLE else 0.0 end * 100 as pass_rate,
  case when count(*) <> 0 then CAST(sum(n_chars) AS DOUBLE) / count(*)::DOUBLE else 0.0 end as avg_score, CAST(coalesce(sum(doc_id % 1000), 0) AS BIGINT) as tokens
  from labels join documents using (doc_id)""",
    "budget_guard": f"""with {COSTED} select project_id, event_id, cost_micros, spent_before, spent_before >= {LIMIT} as refused from (select *, CAST(coalesce(sum(cost_micros) over
  (partition by project_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) AS BIGINT) as spent_before from costed)""",
    "cache_key_dups": f"""with {COSTED}, r as (select *, row_number() over (partition by project_id, task_name, model_name order by ts, event_id) > 1 as hit from inv)
select project_id, task_name, CAST(count(*) filter (hit) AS BIGINT) as hits, CAST(count(*) filter (not hit) AS BIGINT) as misses from r group by all""",
    "costly_tasks": f"""with {COSTED}, b as (select project_id, task_name, CAST(sum(cost_micros) AS BIGINT) as cost_micros from costed group by all)
select * from (select *, CAST(row_number() over (partition by project_id order by cost_micros desc, task_name) AS INTEGER) as rank from b) where rank <= 3""",
    "state_transition_violations": f"""with {HISTORY}, h as (select *, lag(state) over (partition by project_id order by ts, event_id) as from_state from history)
select project_id, event_id, from_state, state from h where from_state is not null and (from_state, state) not in ({_PAIRS})""",
    "state_dwell": f"""with {HISTORY} select project_id, event_id, state, lag(state) over w as from_state, CAST(round((epoch_us(lead(ts) over w) - epoch_us(ts)) / 1000.0) AS BIGINT) as dwell_ms
from history window w as (partition by project_id order by ts, event_id)""",
    "latest_state": f"with {HISTORY} select project_id, arg_max(state, (ts, event_id)) as state, CAST(count(*) AS BIGINT) as changes from history group by project_id",
    "next_state": f"with {HISTORY} select state, case state when 'view' then 'click' when 'click' then 'signup' when 'signup' then 'purchase' end as next, CAST(count(*) AS BIGINT) as rows from history group by all",
    "queue_status": "select o_orderstatus as status, CAST(count(*) AS BIGINT) as jobs from orders group by all",
    "fifo_head": "select o_orderkey as slug, o_orderstatus as status from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 20",
    "latest_project": "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by all",
    "duration_targets": """select c_custkey as project_id, coalesce(t, 25.0::DOUBLE) as target, coalesce(t * 0.85::DOUBLE, 20.0::DOUBLE) as low, coalesce(t * 1.15::DOUBLE, 30.0::DOUBLE) as high from
(select c_custkey, case when c_custkey % 11 = 0 then 4.5::DOUBLE when c_custkey % 5 <> 0 then greatest(0.5::DOUBLE, c_custkey::DOUBLE * 0.25::DOUBLE) end as t from customer)""",
}
