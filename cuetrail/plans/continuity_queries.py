"""Ordered audits and sampling over clips, cues and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import latin_tokens
from ..operators import continuity as K
from .tables import CLIPS, CUES, LINES, SEGMENTS, clips, cues, grid, grid_sql, lines, segments

MARKERS, STRONG = ["the ", "and", "der"], ["tion of"]
NAMES, SHIFTS = ["anti", "ere", "isch"], ["then", "dann"]


def _clips_with_text(spark, sf_dir):
    """Cues as clips that leap: the source start grows with the square of the position."""
    c = cues(spark, sf_dir)
    return c.select("project_id", "pos", "text", (F.col("pos") * F.col("pos") * 10.0).alias("source_start"), (F.col("pos") * F.col("pos") * 10.0 + F.col("duration")).alias("source_end"))


_LEAPS = CUES + ", leap as (select project_id, pos, text, pos * pos * 10.0::DOUBLE as source_start, pos * pos * 10.0::DOUBLE + duration as source_end from cues)"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("project_id", "pos", "start_s", "end_s")


def loop_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.loops(clips(spark, sf_dir), near=20.0)


def backward_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumn("source_start", F.when(F.col("flag") != "R", F.col("source_start")))
    return K.backward_jumps(c).select("project_id", "far_jumps", "small_jumps", F.col("score").cast("bigint").alias("score"))


def forward_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.forward_jumps(_clips_with_text(spark, sf_dir), MARKERS, STRONG)


def entity_threading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.entity_threading(segments(spark, sf_dir), NAMES, SHIFTS)


def running_max_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = clips(spark, sf_dir).select("project_id", "pos", F.col("source_start").alias("s"), F.col("source_end").alias("e"))
    return K.out_of_order(refs, 0.4).select("project_id", "pos", "furthest")


def clip_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.regressions(clips(spark, sf_dir)).select("project_id", "pos", "prior_start")


def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("tokens", latin_tokens(F.col("text")))
    return K.context(c, "tokens").select("project_id", "pos", F.array_join(F.sort_array("context"), " ").alias("context"))


def anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.anchors(clips(spark, sf_dir), F.lit(1000.0), F.col("duration")).select("project_id", "pos", "anchor")


def monotone_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.monotone(clips(spark, sf_dir), "source_start").select("project_id", "pos", "clamped")


def spine_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spine_contiguity(clips(spark, sf_dir))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fixed_chunks(lines(spark, sf_dir), 15).groupBy("project_id", "chunk").agg(F.count("*").alias("rows"), F.min("pos").alias("first_pos"))


def silent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = segments(spark, sf_dir).withColumn("text", F.when(F.col("project_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text")))
    return K.silent_chunks(quiet, 3)


def even_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.even_points(grid(cues(spark, sf_dir)), 3).select("project_id", "scene_pos", "point_no", "t")


def _strata(spark, sf_dir):
    s = cues(spark, sf_dir).select("project_id", (F.col("pos") % 4).alias("stratum"), "pos")
    numbered = K.fixed_chunks(s, 1, ("project_id", "stratum")).withColumnRenamed("chunk", "line_no")
    return numbered, numbered.groupBy("project_id", "stratum").agg(F.count("*").alias("lines"))


def allocate_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.allocate(_strata(spark, sf_dir)[1], 7)


def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, strata = _strata(spark, sf_dir)
    return K.even_sample(rows, K.allocate(strata, 7)).select("project_id", "stratum", "j", "pos")


def continuity_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    jumps, spine = K.backward_jumps(c), K.spine_contiguity(c)
    score = K.composite(F.col("score"), F.lit(100.0), F.lit(80.0), F.col("contiguity"), F.when(F.col("far_jumps") > 1, 20.0).otherwise(0.0))
    return jumps.join(spine, "project_id").select("project_id", score.alias("continuity"))


QUERIES = {f.__name__: f for f in (timeline, loop_clips, backward_jumps, forward_jumps, entity_threading, running_max_order, clip_regressions, context_tokens, anchor, monotone_clamp, spine_contiguity, fixed_chunks, silent_chunks, even_points, allocate_strata, sample_strata, continuity_composite)}

_W = "(partition by project_id order by pos)"
_HAS = lambda t, ws: "(" + " or ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_TOK = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)))"
_NAMED = "list_filter([" + ", ".join(f"'{n}'" for n in NAMES) + "], lambda n: contains(lower(text), n))"
_BACK = "select project_id, far, small, greatest(0, 100 - 25 * far - 5 * small) as score from (select project_id, CAST(count(*) filter (d < -15) AS BIGINT) as far, CAST(count(*) filter (d < -2 and d >= -15) AS BIGINT) as small from (select *, source_start - lag(source_start) over " + _W + " as d from {t}) group by all)"
_SPINE = """select project_id, n as clips, greatest(40.0::DOUBLE, least(100.0::DOUBLE, total / n / 25 * 100)) - case when short > 0.2::DOUBLE then (short - 0.2::DOUBLE) * 100 else 0.0::DOUBLE end as contiguity
from (select project_id, CAST(count(*) AS BIGINT) as n, sum(duration) as total, (count(*) filter (duration < 4))::DOUBLE / count(*) as short from clips group by all)"""
_ALLOC = CUES + """, st as (select project_id, pos % 4 as stratum, pos, CAST(row_number() over (partition by project_id, pos % 4 order by pos) - 1 AS BIGINT) as line_no from cues),
sz as (select project_id, stratum, CAST(count(*) AS BIGINT) as lines from st group by all),
raw as (select *, greatest(1, CAST(round_even(lines * 7.0::DOUBLE / sum(lines) over (partition by project_id), 0) AS BIGINT)) as raw, row_number() over (partition by project_id order by stratum) as place from sz),
al as (select project_id, stratum, lines, CAST(case when place = 3 then greatest(1, raw + 7 - sum(raw) over (partition by project_id)) else raw end AS BIGINT) as share_n from raw)"""
SQL = {
    "timeline": f"with {CUES} select project_id, pos, start_s, end_s from cues",
    "loop_clips": f"with {CLIPS}, l as (select *, abs(source_start - lag(source_start) over {_W}) < 20.0 as l from clips) select project_id, CAST(count(*) AS BIGINT) as clips, CAST(count(*) filter (l) AS BIGINT) as loops from l group by all",
    "backward_jumps": f"with {CLIPS}, some_clips as (select project_id, pos, source_start from clips where flag <> 'R'), b as ({_BACK.format(t='some_clips')}) select project_id, far as far_jumps, small as small_jumps, CAST(score AS BIGINT) as score from b",
    "forward_jumps": f"""with {_LEAPS}, x as (select *, coalesce(source_start - lag(source_end) over {_W} >= 45.0, false) as leap, {_HAS('substring(lower(text), 1, 50)', MARKERS)} or {_HAS('lower(text)', STRONG)} as ok from leap),
n as (select project_id, CAST(count(*) filter (leap) AS BIGINT) as leaps, CAST(count(*) filter (leap and ok) AS BIGINT) as bridged from x group by all)
select *, case when leaps > 0 then bridged::DOUBLE / leaps else 1.0::DOUBLE end as bridged_share from n""",
    "entity_threading": f"""with {SEGMENTS}, x as (select *, {_NAMED} as names from segs), y as (select *, lag(names) over {_W} as prior from x)
select project_id, CAST(count(*) filter (len(names) > 0 and len(prior) > 0) AS BIGINT) as pairs,
  CAST(count(*) filter (len(names) > 0 and len(prior) > 0 and not list_has_any(names, prior) and not {_HAS('substring(lower(text), 1, 40)', SHIFTS)}) AS BIGINT) as breaks from y group by all""",
    "running_max_order": f"""with {CLIPS}, f as (select *, max(source_end) over (partition by project_id order by pos rows between unbounded preceding and 1 preceding) as furthest from clips)
select project_id, pos, furthest from f where furthest > 0 and source_start < furthest * 0.4::DOUBLE""",
    "clip_regressions": f"with {CLIPS}, p as (select *, lag(source_start) over {_W} as prior_start from clips) select project_id, pos, prior_start from p where source_start < prior_start - 45",
    "context_tokens": f"""with {CUES}, t as (select *, {_TOK} as tokens from cues), n as (select *, lag(end_s) over {_W} as pe, lag(tokens) over {_W} as pt, lead(start_s) over {_W} as ns, lead(tokens) over {_W} as nt from t)
select project_id, pos, array_to_string(list_sort(list_distinct(list_concat(tokens, case when abs(start_s - pe) <= 8 then pt else [] end, case when abs(ns - end_s) <= 8 then nt else [] end))), ' ') as context from n""",
    "anchor": f"with {CLIPS} select project_id, pos, (row_number() over {_W} - 1)::DOUBLE / count(*) over (partition by project_id) * greatest(0.0::DOUBLE, 1000.0::DOUBLE - duration) as anchor from clips",
    "monotone_clamp": f"with {CLIPS} select project_id, pos, max(source_start) over (partition by project_id order by pos rows between unbounded preceding and current row) as clamped from clips",
    "spine_contiguity": f"with {CLIPS} {_SPINE}",
    "fixed_chunks": f"with {LINES}, c as (select *, CAST((row_number() over {_W} - 1) // 15 AS BIGINT) as chunk from lines) select project_id, chunk, CAST(count(*) AS BIGINT) as rows, min(pos) as first_pos from c group by all",
    "silent_chunks": f"""with {SEGMENTS}, c as (select *, CAST((row_number() over {_W} - 1) // 3 AS BIGINT) as chunk from segs)
select project_id, chunk, CAST(count(*) AS BIGINT) as rows, bool_and(trim(case when project_id % 3 = 0 then '  ' else text end) = '') as silent from c group by all""",
    "even_points": f"with {CUES}, {grid_sql('cues')} select project_id, scene_pos, p as point_no, s + p * ((e - s) / 2) as t from scenes, (select unnest([0, 1, 2])::INTEGER as p)",
    "allocate_strata": f"with {_ALLOC} select * from al",
    "sample_strata": f"""with {_ALLOC}, p as (select project_id, stratum, lines, share_n, CAST(unnest(range(share_n)) AS BIGINT) as j from al)
select p.project_id, p.stratum, p.j, st.pos from p join st on st.project_id = p.project_id and st.stratum = p.stratum and st.line_no = (p.j * p.lines) // p.share_n""",
    "continuity_composite": f"""with {CLIPS}, b as ({_BACK.format(t='clips')}), s as ({_SPINE})
select project_id, greatest(0.0::DOUBLE, 0.35::DOUBLE * score + 0.35::DOUBLE * 100.0::DOUBLE + 0.15::DOUBLE * 80.0::DOUBLE + 0.15::DOUBLE * contiguity - case when far > 1 then 20.0::DOUBLE else 0.0::DOUBLE end) as continuity from b join s using (project_id)""",
}
