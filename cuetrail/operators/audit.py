"""Audits as rows of findings, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("project_id",)
#: What must not stand in a narration.
LEAKS = ['"text":', '"segments":', '"supporting_scenes":', '"confidence":', "```", "{", "}", "_"]


def schema_findings(segments: DataFrame, keys=KEYS, projects: DataFrame | None = None) -> DataFrame:
    """keys, pos, check, severity: empty text fails, a missing id warns, a confidence (1.0 if null) under 0.5 warns. Projects (keys) without
    any segment fail, with a null pos."""
    finding = lambda when, check, severity: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = F.array_compact(F.array(finding(blank("text"), "empty_text", "fail"), finding(blank("segment_id"), "missing_id", "warning"), finding(F.coalesce("confidence", F.lit(1.0)) < 0.5, "low_confidence", "warning")))
    rows = segments.select(*keys, "pos", F.explode(found).alias("f")).select(*keys, "pos", "f.check", "f.severity")
    if projects is None:
        return rows
    none = projects.select(*keys).distinct().join(segments.select(*keys), list(keys), "left_anti")
    return rows.unionByName(none.select(*keys, F.lit(None).cast(segments.schema["pos"].dataType).alias("pos"), F.lit("no_segments").alias("check"), F.lit("fail").alias("severity")))


def leak_findings(segments: DataFrame, leaks: list[str] = LEAKS, keys=KEYS) -> DataFrame:
    """keys, pos, leak: one row for each leak of a segment."""
    return segments.select(*keys, "pos", F.explode(F.filter(F.array(*(F.lit(x) for x in leaks)), lambda x: F.contains("text", x))).alias("leak"))


def length_audit(segments: DataFrame, low_minutes: float, high_minutes: float, rate: float = 250.0, keys=KEYS) -> DataFrame:
    """keys, chars, minutes, severity: estimated length against the target range."""
    d = segments.groupBy(*keys).agg(F.sum(F.char_length("text")).alias("chars")).withColumn("minutes", F.col("chars") / F.lit(rate))
    m = F.col("minutes")
    return d.withColumn("severity", F.when((m < 0.8 * low_minutes) | (m > 1.2 * high_minutes), "fail").when((m < low_minutes) | (m > high_minutes), "warning").otherwise("pass"))


def segment_types(segments: DataFrame, keys=KEYS) -> DataFrame:
    """keys, segments, has_hook, has_conclusion, commentary_share, sparse_commentary."""
    n, c = F.count("*"), F.count_if(F.col("segment_type") == "commentary")
    return segments.groupBy(*keys).agg(n.alias("segments"), F.bool_or(F.col("segment_type") == "hook").alias("has_hook"), F.bool_or(F.col("segment_type") == "conclusion").alias("has_conclusion"), (c.cast("double") / n).alias("commentary_share"), (c.cast("double") / n < 0.3).alias("sparse_commentary"))


FREE_TYPES = ("hook", "conclusion", "transition")


def evidence_coverage(segments: DataFrame, refs: DataFrame, scenes: DataFrame, keys=KEYS) -> DataFrame:
    """keys, segments, missing, invalid, failed. missing: segments without a reference, hooks, conclusions and transitions aside; invalid:
    references that end before they start or after 1.1 times the last scene's end (both count). Fails from 30 % missing on."""
    end = scenes.groupBy(*keys).agg(F.max("e").alias("last"))
    per_ref = refs.join(end, list(keys), "left").withColumn("bad", (F.col("s") > F.col("e")).cast("int") + (F.col("e") > 1.1 * F.col("last")).cast("int"))
    per_seg = per_ref.groupBy(*keys, "pos").agg(F.count("*").alias("refs"), F.sum("bad").alias("bad"))
    d = segments.join(per_seg, [*keys, "pos"], "left")
    missing = F.count_if(F.col("refs").isNull() & ~F.col("segment_type").isin(*FREE_TYPES))
    return d.groupBy(*keys).agg(F.count("*").alias("segments"), missing.alias("missing"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"), (missing >= 0.3 * F.count("*")).alias("failed"))


def grounded_score(segments: DataFrame, disordered: Column, keys=KEYS) -> DataFrame:
    """keys, grounded, score: the share of segments with a reference (has_ref), hooks and conclusions aside (1.0 if there are none); 100 less
    40 for what isn't grounded and 20 for disorder."""
    counted = F.count_if(~F.col("segment_type").isin("hook", "conclusion"))
    ok = F.count_if(~F.col("segment_type").isin("hook", "conclusion") & F.col("has_ref"))
    d = segments.groupBy(*keys).agg(F.when(counted > 0, ok.cast("double") / counted).otherwise(F.lit(1.0)).alias("grounded"))
    return d.withColumn("score", 100 - 40 * (1 - F.col("grounded")) - F.when(disordered, 20).otherwise(0))


def roll_up(findings: DataFrame, keys=KEYS) -> DataFrame:
    """keys, fails, warnings, passes, status: the worst severity."""
    f, w = F.count_if(F.col("severity") == "fail"), F.count_if(F.col("severity") == "warning")
    return findings.groupBy(*keys).agg(f.alias("fails"), w.alias("warnings"), F.count_if(F.col("severity") == "pass").alias("passes"), F.when(f > 0, "fail").when(w > 0, "warning").otherwise("pass").alias("status"))


def pacing_score(chars: Column, seconds: Column) -> Column:
    """100 within 200 to 290 characters a minute (250 where there is no time); beyond, less 1.5 a character, 40 at most."""
    rate = F.when(seconds > 0, chars.cast("double") / seconds * 60).otherwise(F.lit(250.0))
    excess = F.greatest(F.lit(0.0), 200 - rate, rate - 290)
    return 100 - F.least(F.lit(40.0), 1.5 * excess)


def coupling(clips: DataFrame, keys=KEYS, total_seconds: float = 600.0) -> DataFrame:
    """clips: keys, pos, duration, audio, source_start, source_end, score, mismatch. keys, drift, longest, loops, coverage, mismatches,
    content, coupling, hard_fail; the score is 100 less what each fault costs, not below 0."""
    w = W.partitionBy(*keys).orderBy("pos")
    near = F.coalesce(F.abs(F.col("source_start") - F.lag("source_start").over(w)) < 5, F.lit(False))
    d = clips.withColumn("loop", near)
    timed = (F.col("duration") > 0) & (F.col("audio") > 0)
    span = (F.max("source_end") - F.min("source_start")) / total_seconds
    a = d.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(timed, F.abs(F.col("duration") - F.col("audio")))), F.lit(0.0)).alias("drift"),
        F.max("duration").alias("longest"),
        F.count_if("loop").alias("loops"),
        F.when(F.count("*") >= 3, F.least(F.lit(1.0), span)).otherwise(F.lit(1.0)).alias("coverage"),
        F.count_if("mismatch").alias("mismatches"),
        F.least(F.lit(100.0), F.sum("score") / F.count("*") / 0.5 * 100).alias("content"),
    )
    c = F.col
    score = F.lit(100.0) - F.when(c("drift") > 1, F.least(F.lit(30.0), 10 * c("drift"))).otherwise(0.0)
    score = score - F.when(c("longest") > 35, 15.0).otherwise(0.0) - F.when(c("loops") > 0, F.least(F.lit(40), 15 * c("loops"))).otherwise(0)
    score = score - F.when(c("coverage") < 0.35, 40 * (0.35 - c("coverage"))).otherwise(0.0) - F.when(c("mismatches") > 0, F.least(F.lit(60), 25 * c("mismatches"))).otherwise(0)
    score = score - F.when(c("content") < 40, F.least(F.lit(25.0), 0.5 * (40 - c("content")))).otherwise(0.0)
    return a.withColumn("coupling", F.greatest(F.lit(0.0), score)).withColumn("hard_fail", (c("loops") > 0) | (c("mismatches") > 0))


def clip_verdicts(clips: DataFrame) -> DataFrame:
    """Adds verdict (score of a clip) and ok. clips: has_scene, affinity, subs (characters of cue text), common (shared tokens), tokens
    (tokens of the narration), shared_activity, conflict, regressed."""
    c = F.col
    by_scene = F.greatest(F.lit(20.0), F.least(F.lit(100.0), 120 * c("affinity")))
    by_cues = F.greatest(F.lit(30.0), F.least(F.lit(100.0), 100 * c("common") / F.greatest(F.lit(2.0), 0.15 * c("tokens"))))
    v = F.when(c("has_scene"), by_scene).when(c("subs") >= 8, by_cues).when(c("subs") == 0, F.when(c("conflict"), 40.0).otherwise(90.0)).otherwise(100.0)
    v = F.when(c("shared_activity") & ~c("conflict"), F.greatest(v, F.lit(85.0))).otherwise(v)
    weak = c("has_scene") & (c("affinity") < 0.10) & ~c("conflict") & (c("subs") >= 8)
    return clips.withColumn("verdict", F.when(c("conflict"), F.least(v, F.lit(40.0))).otherwise(v)).withColumn("ok", ~c("conflict") & ~c("regressed") & ~weak)


def clip_findings(clips: DataFrame, keys=KEYS) -> DataFrame:
    """keys, pos, finding, amount: a row for each fault of a clip. activity_conflict: domains that conflict (amount: how many);
    backward_jump: it starts over 45 s before the clip in front of it (by how much); duration_drift: stretch and narration, both longer than
    0, differ by over 1 s (by how much); low_correlation: an affinity under 0.10 with a scene, though 8 characters of cues or more were
    said and nothing conflicts (the affinity). A clip passes if it has none, or drift alone.

    clips: keys, pos, source_start, source_end, duration (of the narration), conflicts, has_scene, affinity, subs. Nulls are no fault.
    """
    c = F.col
    prior = F.lag("source_start").over(W.partitionBy(*keys).orderBy("pos"))
    d = clips.withColumns({"__prior": prior, "__cut": c("source_end") - c("source_start")})
    drift = F.abs(c("__cut") - c("duration"))
    faults = {
        "activity_conflict": (c("conflicts") > 0, c("conflicts")),
        "backward_jump": (c("source_start") < c("__prior") - 45, c("__prior") - c("source_start")),
        "duration_drift": ((c("__cut") > 0) & (c("duration") > 0) & (drift > 1), drift),
        "low_correlation": (c("has_scene") & (c("affinity") < 0.10) & (c("conflicts") == 0) & (c("subs") >= 8), c("affinity")),
    }
    found = F.array(*(F.when(met, F.struct(F.lit(k).alias("finding"), amount.cast("double").alias("amount"))) for k, (met, amount) in faults.items()))
    return d.select(*keys, "pos", F.inline(F.filter(found, lambda x: x.isNotNull())))


def clip_report(clips: DataFrame, keys=KEYS) -> DataFrame:
    """keys, clips, passed, failed, pass_rate, avg_verdict of rows with ok and verdict."""
    n, ok = F.count("*"), F.count_if("ok")
    return clips.groupBy(*keys).agg(n.alias("clips"), ok.alias("passed"), (n - ok).alias("failed"), (ok.cast("double") / n * 100).alias("pass_rate"), (F.sum("verdict") / n).alias("avg_verdict"))


def rubric(duplicates: Column, cliches: Column) -> Column:
    """Struct depth, hook, voice, resonance where no judge is at hand."""
    bad, some = (duplicates >= 3) | (cliches >= 2), (duplicates > 0) | (cliches > 0)
    tier = lambda a, b, c: F.when(bad, a).when(some, b).otherwise(c)
    return F.struct(tier(F.lit(48), F.greatest(F.lit(55), 80 - 10 * duplicates - 8 * cliches), F.lit(92)).alias("depth"), tier(F.lit(55), F.lit(75), F.lit(94)).alias("hook"), tier(F.lit(50), F.lit(72), F.lit(91)).alias("voice"), tier(F.lit(45), F.lit(70), F.lit(89)).alias("resonance"))


#: Weights of the dimensions (their sum is 1), and those that fail the whole when they fail.
WEIGHTS = {"identity": 0.08, "cleanliness": 0.05, "diversity": 0.08, "evidence": 0.07, "continuity": 0.12, "coupling": 0.15, "pacing": 0.05, "depth": 0.20, "voice": 0.10, "hook": 0.10}
CRITICAL = ("identity", "cleanliness", "continuity", "coupling")


def grade(scores: DataFrame, keys=KEYS, weights: dict[str, float] = WEIGHTS, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """keys, total, critical_failed, grade. scores: keys, dimension, score, passed, hard_fail. The total is the weighted sum within 0 and
    100 over the dimensions that are there; F for a hard failure, a failed critical dimension or less than 70; S from 90, A from 82, B
    from 75 on, else C. Sums go by hundredths of points, so the order of rows doesn't matter."""
    hundredths = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, round(100 * v))))
    part = F.coalesce(F.try_element_at(hundredths, F.col("dimension")), F.lit(0)) * F.floor(F.col("score") * 1000 + 0.5)
    d = scores.groupBy(*keys).agg((F.sum(part).cast("double") / 100_000).alias("total"), F.bool_or(F.col("dimension").isin(*critical) & ~F.col("passed")).alias("critical_failed"), F.bool_or("hard_fail").alias("hard"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("total")))
    return d.select(*keys, t.alias("total"), "critical_failed", F.when(F.col("hard") | F.col("critical_failed") | (t < 70), "F").when(t >= 90, "S").when(t >= 82, "A").when(t >= 75, "B").otherwise("C").alias("grade"))


def media_findings(media: DataFrame) -> DataFrame:
    """project_id, check, ok of each file: a video codec, an audio codec, a length."""
    return media.select("project_id", F.expr("stack(3, 'video_codec', video_codec != 'unknown', 'audio_codec', audio_codec != 'none', 'duration', duration_seconds > 0) as (check, ok)"))


def registry(events: DataFrame, cast: DataFrame, keys=KEYS) -> DataFrame:
    """keys, names: the distinct characters of the events with their aliases, of the cast where no event names one. Both: keys, characters
    array<string> and, if there are any, aliases array<string>."""

    def gather(d: DataFrame, name: str) -> DataFrame:
        none = F.array().cast("array<string>")
        known = F.array_union(F.coalesce("characters", none), F.coalesce("aliases", none)) if "aliases" in d.columns else F.col("characters")
        return d.select(*keys, F.explode(known).alias("c")).where("c != ''").groupBy(*keys).agg(F.sort_array(F.collect_set("c")).alias(name))

    return gather(events, "a").join(gather(cast, "b"), list(keys), "full").select(*keys, F.coalesce("a", "b").alias("names"))


def registry_findings(projects: DataFrame, registered: DataFrame, keys=KEYS) -> DataFrame:
    """keys, check, severity, known: a warning for projects without a name in the registry (keys, names), else a pass with their number."""
    known = F.coalesce(F.size("names"), F.lit(0))
    d = projects.select(*keys).distinct().join(registered, list(keys), "left").withColumn("known", known)
    return d.select(*keys, F.lit("character_registry").alias("check"), F.when(F.col("known") > 0, "pass").otherwise("warning").alias("severity"), "known")


def below(rows: DataFrame, column: str, cut: float) -> DataFrame:
    """Rows under a cut: confidences under 0.5, matches under 0.20 or 0.15."""
    return rows.where(F.col(column) < cut)


def content_match(clips: DataFrame, cut: float = 0.20, keys=KEYS) -> DataFrame:
    """keys, content, low: the mean score as a share of 0.5 in percent, 100 at most, and the positions of clips under the cut, in order."""
    low = F.array_sort(F.collect_list(F.when(F.col("score") < cut, F.col("pos"))))
    return clips.groupBy(*keys).agg(F.least(F.lit(100.0), F.sum("score") / F.count("*") / 0.5 * 100).alias("content"), low.alias("low"))


def end_findings(clips: DataFrame, total: float, keys=KEYS) -> DataFrame:
    """keys, pos, check: of projects with three clips or more and a source of more than 180 s, a first clip that starts after a quarter of it
    (late_hook) and a last one before 70 % (early_end)."""
    w = W.partitionBy(*keys)
    d = clips.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy("pos"))}).where((F.col("__n") >= 3) & F.lit(total > 180))
    check = F.when((F.col("__i") == 1) & (F.col("source_start") > total * 0.25), "late_hook").when((F.col("__i") == F.col("__n")) & (F.col("source_start") < total * 0.70), "early_end")
    return d.select(*keys, "pos", check.alias("check")).where("check is not null")


def rule_findings(clips: DataFrame, rules: list[tuple[str, str, list[str], float, float]], total: float, keys=KEYS) -> DataFrame:
    """keys, pos, check: where a text that belongs to one part of the story stands in another. rules, the first that is met counts: check,
    domain, cues, and the least and greatest share of the source at which it is met. clips: text, domains array<string>, source_start.
    Sources of 300 s or less have none."""
    share = F.col("source_start") / total
    told = lambda domain, cues: F.array_contains("domains", domain) | F.exists(F.array(*(F.lit(c) for c in cues)), lambda c: F.contains("text", c))
    met = [F.when(told(domain, cues) & share.between(low, high), check) for check, domain, cues, low, high in rules]
    return clips.where(F.lit(total > 300)).select(*keys, "pos", F.coalesce(*met).alias("check")).where("check is not null")


def alignment(clips: DataFrame, rules: list, total: float, keys=KEYS) -> DataFrame:
    """keys, checks, mismatches, alignment: the share of checks that clips pass in percent, 100 where nothing is checked.

    clips: keys, pos, text, source_start, scene_text, affinity, domains, conflicts (number of conflicting domains). Every conflict is a check
    that fails; a scene text is a check that fails if it has 12 characters or more, the affinity is under 0.15 and nothing conflicts;
    findings of the rules and of the ends fail.
    """
    spoken = F.trim(F.coalesce("scene_text", F.lit(""))) != ""
    weak = spoken & (F.char_length("scene_text") >= 12) & (F.col("affinity") < 0.15) & (F.col("conflicts") == 0)
    own = clips.select(*keys, (F.col("conflicts") + spoken.cast("int")).cast("bigint").alias("checks"), (F.col("conflicts") + weak.cast("int")).cast("bigint").alias("bad"))
    found = rule_findings(clips, rules, total, keys).unionByName(end_findings(clips, total, keys)).select(*keys, F.lit(1).cast("bigint").alias("checks"), F.lit(1).cast("bigint").alias("bad"))
    d = own.unionByName(found).groupBy(*keys).agg(F.sum("checks").alias("checks"), F.sum("bad").alias("mismatches"))
    return d.withColumn("alignment", F.when(F.col("checks") > 0, F.greatest(F.lit(0.0), (F.col("checks") - F.col("mismatches")).cast("double") / F.col("checks")) * 100).otherwise(F.lit(100.0)))


def source_seconds(declared: Column, last_scene: Column, default: float = 600.0) -> Column:
    return F.coalesce(F.nullif(declared, F.lit(0.0)), last_scene, F.lit(default))


def narration_seconds(clips: DataFrame, keys=KEYS, estimated_minutes: Column | None = None) -> DataFrame:
    """keys, seconds: the lengths of the clips together, or the estimate where they have none."""
    d = clips.groupBy(*keys).agg(F.sum("duration").alias("seconds"))
    return d if estimated_minutes is None else d.withColumn("seconds", F.coalesce(F.nullif("seconds", F.lit(0.0)), estimated_minutes * 60))


def headed(items: Column, n: int) -> Column:
    """The first n distinct items of a list, blanks left out: names for a prompt, events, tags."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, n)


def tags(title: Column, fixed: list[str], stars: Column, genre: Column, n: int = 20) -> Column:
    """The title, fixed tags, up to five stars and the parts of a comma-separated genre, n at most and each once."""
    kinds = F.transform(F.split(F.coalesce(genre, F.lit("")), ","), lambda x: F.trim(x))
    return headed(F.concat(F.array(title, *(F.lit(t) for t in fixed)), F.slice(F.coalesce(stars, F.array().cast("array<string>")), 1, 5), kinds), n)
