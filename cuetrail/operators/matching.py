"""Narration against scenes: affinity of every pair within a project, and the best scenes of each narration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_summaries(scenes: DataFrame, summaries: DataFrame, keys=("project_id",)) -> DataFrame:
    """Adds section_pos, summary: of n scenes in order and m summaries, scene i has summary min(i // ceil(n/m), m-1). Projects without
    summaries have nulls. scenes: keys, scene_pos from 0; summaries: keys, section_pos from 0, summary."""
    n = scenes.groupBy(*keys).agg(F.count("*").alias("n"))
    m = summaries.groupBy(*keys).agg(F.count("*").alias("m"))
    sized = scenes.join(n.join(m, list(keys)), list(keys), "left")
    at = F.least(F.floor(F.col("scene_pos") / F.ceil(F.col("n") / F.col("m"))), F.col("m") - 1)
    return sized.withColumn("section_pos", at).drop("n", "m").join(summaries, [*keys, "section_pos"], "left")


def affinity(narration: Column, context: Column, summary: Column, concepts: Column, start: Column, target: Column, total: Column, last_start: Column, window_start: Column, window_end: Column) -> Column:
    """Affinity of a narration and a scene from five signals; place and order can make it negative.

    narration, context, summary: token sets; concepts: summed weight of the concepts that narration and scene share; window_start and
    window_end: the expected part of the source, null if none is; last_start: where the clip before starts, null or negative at first.
    """
    n = F.size(narration)
    common = lambda other: F.size(F.array_intersect(narration, other)).cast("double")
    c = F.when(concepts > 0, F.least(F.lit(1.0), 0.6 + 0.4 * (concepts - 1))).otherwise(F.lit(0.0))
    t = F.least(F.lit(1.0), common(context) / F.greatest(F.lit(3.0), 0.15 * n))
    u = F.least(F.lit(1.0), common(summary) / F.greatest(F.lit(4.0), 0.20 * n))
    away = F.least(F.abs(start - window_start), F.abs(start - window_end))
    inside = (start >= window_start - 30) & (start <= window_end + 30)
    free = F.greatest(F.lit(0.0), 1 - F.abs(start - target) / F.greatest(F.lit(120.0), 0.25 * total))
    p = F.when(window_start.isNull(), free).when(inside, F.lit(1.0)).otherwise(-2 - away / 100)
    d = start - last_start
    ahead = F.least(F.lit(1.0), 0.5 + 0.5 * (1 - F.least(F.lit(1.0), d / F.greatest(F.lit(1.0), 0.1 * total))))
    h = F.when(last_start.isNull() | (last_start < 0), F.lit(0.5)).when(d >= 0, ahead).when(d >= -30, F.lit(0.2)).otherwise(-1 - F.abs(d) / 100)
    return F.when(n == 0, F.lit(0.0)).otherwise(0.30 * c + 0.20 * t + 0.15 * u + 0.25 * p + 0.10 * h)


def best_scenes(scored: DataFrame, k: int, spacing: float = 8.0, keys=("project_id", "narration_pos"), used: str = "used") -> DataFrame:
    """The k best scenes of each narration by score, the earlier first among equals, at least `spacing` seconds from every used start; if
    no scene is, all are ranked. scored: keys, scene_pos, start_s, score, used array<double>."""
    free = ~F.exists(F.coalesce(F.col(used), F.array().cast("array<double>")), lambda u: F.abs(F.col("start_s") - u) < spacing)
    d = scored.withColumn("__free", free).withColumn("__any", F.max("__free").over(W.partitionBy(*keys)))
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "scene_pos")
    return d.where("__free or not __any").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__free", "__any", used)
