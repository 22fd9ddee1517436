"""Token, cost, cache and latency roll-ups over invocation rows.

Money is carried as whole micro-dollars, so sums don't depend on the order of rows; the last step divides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rate of a model that the rate card lacks: US cents for a million tokens, in and out.
UNKNOWN_RATE = (50, 200)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def with_cost(invocations: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost_micros long. rates: model_name, in_cents, out_cents for a million tokens; a small table, broadcast if its size allows."""
    joined = invocations.join(rates, "model_name", "left")
    units = F.col("input_tokens") * F.coalesce("in_cents", F.lit(UNKNOWN_RATE[0])) + F.col("output_tokens") * F.coalesce("out_cents", F.lit(UNKNOWN_RATE[1]))
    return joined.withColumn("cost_micros", F.floor((units + 50) / 100).cast("long")).drop("in_cents", "out_cents")


def usd(micros: Column) -> Column:
    return micros.cast("double") / 1e6


def _sums() -> list[Column]:
    return [F.count("*").alias("invocations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if("cache_hit").alias("cache_hits"), usd(F.sum("cost_micros")).alias("cost_usd")]


def cost_by_task(costed: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """By task: counts, tokens, cost, mean latency, and the models in the order in which they were first used."""
    firsts = costed.groupBy(*keys, "task_name", "model_name").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "model_name"))), lambda x: x["model_name"])
    models = firsts.groupBy(*keys, "task_name").agg(F.array_join(order, ",").alias("models"))
    sums = costed.groupBy(*keys, "task_name").agg(*_sums(), (F.sum("latency_ms").cast("double") / F.count("latency_ms") / 1000).alias("avg_latency_s"))
    return sums.join(models, [*keys, "task_name"])


def cost_by_model(costed: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """By model, with its share of the project's cost in percent."""
    by = costed.groupBy(*keys, "model_name").agg(*_sums(), F.sum("cost_micros").alias("m"))
    total = F.sum("m").over(W.partitionBy(*keys))
    return by.withColumn("cost_percent", ratio(F.col("m"), total) * 100).drop("m")


def project_profile(costed: DataFrame, projects: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Project totals and ratios; projects: the keys, source_minutes, script_chars. What can't be divided is 0."""
    t = costed.groupBy(*keys).agg(*_sums()).join(projects, list(keys), "left")
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return t.select(*keys, "invocations", "input_tokens", "output_tokens", "cost_usd", ratio(F.col("cache_hits"), F.col("invocations")).alias("cache_hit_rate"), ratio(tokens, F.col("source_minutes")).alias("tokens_per_minute"), ratio(F.col("cost_usd"), F.col("source_minutes")).alias("cost_per_minute"), ratio(tokens, F.col("script_chars")).alias("tokens_per_char"))


def cost_grouping_sets(costed: DataFrame) -> DataFrame:
    """By task, by model and by project in one pass; a null stands for all."""
    cols = [F.col("project_id"), F.col("task_name"), F.col("model_name")]
    return costed.groupingSets([[cols[0], cols[1]], [cols[0], cols[2]], [cols[0]]], *cols).agg(*_sums())


def ledger_totals(costed: DataFrame) -> DataFrame:
    """By task over all projects, with the cache-hit rate."""
    return costed.groupBy("task_name").agg(*_sums()).withColumn("cache_hit_rate", ratio(F.col("cache_hits"), F.col("invocations")))


def suite_summary(results: DataFrame) -> DataFrame:
    """results: passed, is_slop boolean, score, tokens. One row of totals."""
    n = F.count("*")
    return results.agg(n.alias("tested"), F.count_if("passed").alias("passed"), F.count_if("is_slop").alias("slop"), (ratio(F.count_if("passed"), n) * 100).alias("pass_rate"), ratio(F.sum("score"), n).alias("avg_score"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def budget_guard(costed: DataFrame, limit_micros: int, keys: tuple[str, ...] = ("project_id",), slice_by: str = "day") -> DataFrame:
    """Adds spent_before (micro-dollars) and refused: the project had reached the limit before the invocation, in (ts, event_id) order.

    A scan of two levels: sums of slices of time (a unit of date_trunc) are added up first, then the rows inside each slice, so the rows of a
    project are as many tasks as it has slices. Both levels are dealt by project and slice, so rows are shuffled once. Rows without a ts are a
    slice of their own, before the others.
    """
    sliced = costed.withColumn("__slice", F.date_trunc(slice_by, F.col("ts").cast("timestamp")))
    sums = sliced.groupBy(*keys, "__slice").agg(F.sum("cost_micros").alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__earlier", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    inside = W.partitionBy(*keys, "__slice").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = sliced.withColumn("__inside", F.coalesce(F.sum("cost_micros").over(inside), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "__slice")]
    met = rows.alias("r").join(sums.alias("s"), same)
    before = (F.col("s.__earlier") + F.col("r.__inside")).alias("spent_before")
    return met.select(*(F.col(f"r.{c}") for c in costed.columns), before).withColumn("refused", F.col("spent_before") >= limit_micros)


def cache_key_repeats(keyed: DataFrame, key: str = "cache_key") -> DataFrame:
    """Adds is_hit: the same key came before, in (ts, event_id) order. The firsts are found by an aggregate, so a common key is no hot window."""
    first = keyed.groupBy(key).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return keyed.join(first, key).withColumn("is_hit", F.struct("ts", "event_id") > F.col("first")).drop("first")


def model_of_tier(tier: Column, models: dict[str, str], default: str) -> Column:
    """Name of the model that serves a tier; the default one for other tiers and nulls."""
    named = F.create_map(*(F.lit(x) for kv in models.items() for x in kv))
    return F.coalesce(F.try_element_at(named, tier), F.lit(default)) if models else F.lit(default)
