"""Ordered audits over segments and edit decisions: rows of a project in the order of pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("project_id",)


def ordered(keys=KEYS, pos: str = "pos"):
    return W.partitionBy(*keys).orderBy(pos)


def before(keys=KEYS, pos: str = "pos"):
    """All earlier rows."""
    return ordered(keys, pos).rowsBetween(W.unboundedPreceding, -1)


def timeline(segments: DataFrame, keys=KEYS) -> DataFrame:
    """Adds start_s and end_s: the durations before a row, and with it; rows with blank texts are left out."""
    spoken = segments.where(F.trim(F.col("text")) != "")
    start = F.coalesce(F.sum("duration").over(before(keys)), F.lit(0.0))
    return spoken.withColumn("start_s", start).withColumn("end_s", F.col("start_s") + F.col("duration"))


def loops(clips: DataFrame, near: float = 5.0, keys=KEYS) -> DataFrame:
    """Per project: clips that start within `near` seconds of the clip before."""
    jump = F.abs(F.col("source_start") - F.lag("source_start").over(ordered(keys))) < near
    return clips.withColumn("l", F.coalesce(jump, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("clips"), F.count_if("l").alias("loops"))


def backward_jumps(clips: DataFrame, keys=KEYS) -> DataFrame:
    """Per project: jumps back by more than 2 and by more than 15 s, and the score 100 - 5 and - 25 for them, not below 0. Rows without
    a start are left out before their neighbours are compared."""
    back = F.col("source_start") - F.lag("source_start").over(ordered(keys))
    d = clips.where("source_start is not null").withColumn("d", back)
    far, small = F.count_if(F.col("d") < -15), F.count_if((F.col("d") < -2) & (F.col("d") >= -15))
    return d.groupBy(*keys).agg(far.alias("far_jumps"), small.alias("small_jumps"), F.greatest(F.lit(0), 100 - 25 * far - 5 * small).alias("score"))


def forward_jumps(clips: DataFrame, markers: list[str], strong: list[str], gap: float = 45.0, keys=KEYS) -> DataFrame:
    """Per project: leaps ahead by `gap` seconds or more, those bridged by a marker in the first 50 characters or a strong one anywhere,
    and the bridged share (1.0 without leaps)."""
    has = lambda text, words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))
    leap = F.coalesce(F.col("source_start") - F.lag("source_end").over(ordered(keys)) >= gap, F.lit(False))
    low = F.lower("text")
    d = clips.withColumn("leap", leap).withColumn("bridged", has(F.substring(low, 1, 50), markers) | has(low, strong))
    n, ok = F.count_if("leap"), F.count_if(F.col("leap") & F.col("bridged"))
    return d.groupBy(*keys).agg(n.alias("leaps"), ok.alias("bridged"), F.when(n > 0, ok.cast("double") / n).otherwise(F.lit(1.0)).alias("bridged_share"))


def entity_threading(segments: DataFrame, names: list[str], shifts: list[str], keys=KEYS) -> DataFrame:
    """Per project: neighbours that both name someone but nobody in common, with no marker of a shift in the first 40 characters."""
    named = F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(F.lower("text"), n))
    d = segments.withColumn("names", named).withColumn("prior", F.lag("names").over(ordered(keys)))
    shift = F.exists(F.array(*(F.lit(w) for w in shifts)), lambda w: F.contains(F.substring(F.lower("text"), 1, 40), w))
    pair = (F.size("names") > 0) & (F.coalesce(F.size("prior"), F.lit(0)) > 0)
    return d.groupBy(*keys).agg(F.count_if(pair).alias("pairs"), F.count_if(pair & ~F.arrays_overlap("names", "prior") & ~shift).alias("breaks"))


def out_of_order(refs: DataFrame, factor: float = 0.5, keys=KEYS) -> DataFrame:
    """Rows that start before `factor` times the furthest end so far. refs: keys, pos, s, e."""
    furthest = F.max("e").over(before(keys))
    return refs.withColumn("furthest", furthest).where((F.col("furthest") > 0) & (F.col("s") < F.col("furthest") * factor))


def regressions(clips: DataFrame, seconds: float = 45.0, keys=KEYS) -> DataFrame:
    """Clips that start more than `seconds` before the clip in front of them."""
    prior = F.lag("source_start").over(ordered(keys))
    return clips.withColumn("prior_start", prior).where(F.col("source_start") < F.col("prior_start") - seconds)


def context(scenes: DataFrame, column: str, gap: float = 8.0, keys=KEYS) -> DataFrame:
    """Adds context: the row's set united with those of its neighbours that are at most `gap` seconds away."""
    w = ordered(keys)
    none = F.array().cast("array<string>")
    back = F.when(F.abs(F.col("start_s") - F.lag("end_s").over(w)) <= gap, F.lag(column).over(w))
    ahead = F.when(F.abs(F.lead("start_s").over(w) - F.col("end_s")) <= gap, F.lead(column).over(w))
    return scenes.withColumn("context", F.array_union(F.array_union(column, F.coalesce(back, none)), F.coalesce(ahead, none)))


def anchors(clips: DataFrame, total: Column, need: Column, keys=KEYS) -> DataFrame:
    """Adds anchor: the row's share of the way through the project's rows, of the length left for it."""
    n = F.count("*").over(W.partitionBy(*keys))
    at = F.row_number().over(ordered(keys)) - 1
    return clips.withColumn("anchor", at.cast("double") / n * F.greatest(F.lit(0.0), total - need))


def monotone(clips: DataFrame, column: str, keys=KEYS) -> DataFrame:
    """Adds clamped: a value below an earlier one is raised to it."""
    return clips.withColumn("clamped", F.max(column).over(ordered(keys).rowsBetween(W.unboundedPreceding, W.currentRow)))


def spine_contiguity(clips: DataFrame, keys=KEYS) -> DataFrame:
    """Per project: mean length as a share of 25 s in percent, within 40 and 100, less 100 times the share of clips under 4 s beyond a fifth."""
    n = F.count("*")
    short = F.count_if(F.col("duration") < 4).cast("double") / n
    mean = F.greatest(F.lit(40.0), F.least(F.lit(100.0), F.sum("duration") / n / 25 * 100))
    return clips.groupBy(*keys).agg(n.alias("clips"), (mean - F.when(short > 0.2, (short - 0.2) * 100).otherwise(F.lit(0.0))).alias("contiguity"))


def fixed_chunks(rows: DataFrame, size: int, keys=KEYS, pos: str = "pos") -> DataFrame:
    """Adds chunk: rows in blocks of `size`."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(ordered(keys, pos)) - 1) / size))


def silent_chunks(rows: DataFrame, size: int, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, chunk, rows, silent: whether all texts of a chunk are blank."""
    return fixed_chunks(rows, size, keys).groupBy(*keys, "chunk").agg(F.count("*").alias("rows"), F.bool_and(F.trim(F.coalesce(text, F.lit(""))) == "").alias("silent"))


def even_points(scenes: DataFrame, k: int) -> DataFrame:
    """k evenly spaced times of each scene, its middle if k is 1: adds point_no and t."""
    if k == 1:
        return scenes.select("*", F.lit(0).alias("point_no"), ((F.col("s") + F.col("e")) / 2).alias("t"))
    step = (F.col("e") - F.col("s")) / (k - 1)
    return scenes.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("point_no")).withColumn("t", F.col("s") + F.col("point_no") * step)


def allocate(strata: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Adds share_n: of n items max(1, the stratum's part rounded), the third stratum taking what is over or short. strata: keys, stratum, lines."""
    total = F.sum("lines").over(W.partitionBy(*keys))
    exact = F.col("lines") * F.lit(n).cast("double") / total
    raw = F.greatest(F.lit(1).cast("long"), F.rint(exact).cast("long"))
    d = strata.withColumn("raw", raw).withColumn("at", F.row_number().over(ordered(keys, "stratum")))
    over = n - F.sum("raw").over(W.partitionBy(*keys))
    return d.withColumn("share_n", F.when(F.col("at") == 3, F.greatest(F.lit(1).cast("long"), F.col("raw") + over)).otherwise(F.col("raw"))).drop("raw", "at")


def even_sample(rows: DataFrame, allocated: DataFrame, keys=KEYS) -> DataFrame:
    """Of each stratum's rows (line_no from 0) those at floor(j * lines / share_n); adds j. Strata with fewer lines than items repeat lines."""
    picks = allocated.select(*keys, "stratum", "lines", "share_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share_n") - 1)).alias("j"))
    picks = picks.withColumn("line_no", F.floor(F.col("j") * F.col("lines") / F.col("share_n")))
    return picks.join(rows, [*keys, "stratum", "line_no"])


def sample_times(sampled: DataFrame, start: str = "start_s", seconds: str = "seconds") -> DataFrame:
    """Adds t, the time of item j of share_n of a stratum: that share of its length (10 s at least) less 15 s, after its start."""
    return sampled.withColumn("t", F.col(start) + F.col("j").cast("double") / F.greatest(F.lit(1), "share_n") * (F.greatest(F.lit(10.0), F.col(seconds)) - 15.0))


def composite(jumps: Column, bridged: Column, threading: Column, contiguity: Column, penalty: Column) -> Column:
    """Continuity out of 100 from four scores, less the penalty for repeated sentences; not below 0."""
    return F.greatest(F.lit(0.0), 0.35 * jumps + 0.35 * bridged + 0.15 * threading + 0.15 * contiguity - penalty)
