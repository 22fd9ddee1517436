"""Findings, coupling, clip and media audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, latin_tokens, timed_references
from ..operators import audit as A
from ..operators import continuity as K
from .tables import CLIPS, CUES, SEGMENTS, clips, cues, segments, table


def _flawed(spark, sf_dir):
    """Segments with some texts and ids blanked and a confidence."""
    s = segments(spark, sf_dir)
    return s.withColumns({"text": F.when((F.col("project_id") + F.col("pos")) % 11 == 0, F.lit(" ")).otherwise(F.concat("text", F.when(F.col("project_id") % 4 == 0, F.lit(" {x_y}")).otherwise(F.lit("")))), "segment_id": F.when(F.col("pos") % 5 == 4, F.lit(None)).otherwise(F.col("segment_id")), "confidence": F.when(F.col("pos") % 3 == 0, (F.col("project_id") % 10) / 10.0)})


def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.schema_findings(_flawed(spark, sf_dir))


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.leak_findings(_flawed(spark, sf_dir))


def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.roll_up(A.schema_findings(_flawed(spark, sf_dir)))


def length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.length_audit(segments(spark, sf_dir), 5.0, 8.0)


def segment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_types(segments(spark, sf_dir))


def _refs(spark, sf_dir):
    """References of two thirds of the segments; some end before they start."""
    c = cues(spark, sf_dir).where("pos % 3 <> 1")
    return c.select("project_id", "pos", F.col("start_s").alias("s"), F.when(F.col("pos") % 4 == 2, F.col("start_s") - 1).otherwise(F.col("end_s") * 1.2).alias("e"))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return A.evidence_coverage(segments(spark, sf_dir), _refs(spark, sf_dir), c.select("project_id", F.col("end_s").alias("e")))


def grounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("has_ref", F.col("pos") % 3 != 1)
    return A.grounded_score(s, F.col("project_id") % 2 == 0)


def pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("project_id", "pos", A.pacing_score(F.length("text"), F.col("pos") * 25.0).alias("pacing"))


def av_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).select("project_id", "pos", "duration", (F.col("duration") + F.when(F.col("pos") % 2 == 0, 0.5).otherwise(0.0)).alias("audio"), "source_start", "source_end", (F.col("duration") / 64).alias("score"), (F.col("flag") == "A").alias("mismatch"))
    return A.coupling(c, total_seconds=1024.0)


def _judged(spark, sf_dir):
    c = clips(spark, sf_dir)
    k = F.col("project_id") + F.col("pos")
    x = c.select("project_id", "pos", (k % 3 != 0).alias("has_scene"), (F.col("duration") / 64).alias("affinity"), ((k * 7) % 40).alias("subs"), (k % 6).alias("common"), (k % 30).alias("tokens"), (k % 8 == 0).alias("shared_activity"), (k % 13 == 0).alias("conflict"), (k % 17 == 0).alias("regressed"), F.lit(0.0).alias("drift"))
    return A.clip_verdicts(x)


def clip_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("project_id", "pos", "verdict", "ok")


def clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clip_report(_judged(spark, sf_dir).withColumn("verdict", F.floor("verdict").cast("bigint")))


def media_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    media = o.select(F.col("o_orderkey").alias("project_id"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("h264").alias("video_codec"), F.when(F.col("o_orderpriority").startswith("5"), "none").otherwise("aac").alias("audio_codec"), (F.col("o_custkey") % 3).cast("double").alias("duration_seconds"))
    return A.media_findings(media).groupBy("check", "ok").agg(F.count("*").alias("files"))


def character_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    names = F.filter(F.array(F.lit("anti"), F.lit("ere"), F.lit("isch")), lambda n: F.contains("text", n))
    events = s.where("pos % 2 = 0").select("project_id", names.alias("characters"))
    cast = s.select("project_id", F.array(F.lit("narrator")).alias("characters"))
    return A.registry(events, cast).select("project_id", F.array_join("names", ",").alias("names"))


def source_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = clips(spark, sf_dir).groupBy("project_id").agg(F.max("source_end").alias("last"))
    return d.select("project_id", A.source_seconds(F.when(F.col("project_id") % 2 == 0, 0.0).when(F.col("project_id") % 3 == 0, 90.0), F.when(F.col("project_id") % 5 != 0, F.col("last"))).alias("seconds"))


def timed_reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    line = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("[t="), F.col("pos").cast("string"), F.lit(".5s] (talk) turn (Characters: a, b)"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("s - 9s] words")))
    text = c.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\nnothing\n").alias("text"))
    return text.select("project_id", F.explode(timed_references(F.col("text"))).alias("r")).select("project_id", "r.start_s", "r.end_s", "r.kind", "r.description", F.array_join("r.characters", "+").alias("characters"))


QUERIES = {f.__name__: f for f in (schema_audit, leak_audit, findings_rollup, length_audit, segment_types, evidence_coverage, grounded_evidence, pacing, av_coupling, clip_verdicts, clip_report, media_audit, character_registry, source_length, timed_reference_lines)}

_FLAWED = SEGMENTS + """, fl as (select project_id, pos, case when (project_id + pos) % 11 = 0 then ' ' else text || case when project_id % 4 = 0 then ' {x_y}' else '' end end as text,
  case when pos % 5 = 4 then null else segment_id end as segment_id, case when pos % 3 = 0 then (project_id % 10)::DOUBLE / 10.0::DOUBLE end as confidence from segs),
fi as (select project_id, pos, 'empty_text' as check, 'fail' as severity from fl where trim(text) = '' union all select project_id, pos, 'missing_id', 'warning' from fl where segment_id is null
  union all select project_id, pos, 'low_confidence', 'warning' from fl where coalesce(confidence, 1.0) < 0.5::DOUBLE)"""
_REFS = CUES + ", refs as (select project_id, pos, start_s as s, case when pos % 4 = 2 then start_s - 1 else end_s * 1.2::DOUBLE end as e from cues where pos % 3 <> 1)"
_JUDGED = CLIPS + """, j as (select project_id, pos, (project_id + pos) as k, duration / 64 as affinity from clips),
f as (select *, k % 3 <> 0 as has_scene, (k * 7) % 40 as subs, k % 6 as common, k % 30 as tokens, k % 8 = 0 as shared, k % 13 = 0 as conflict, k % 17 = 0 as regressed from j),
v as (select *, case when has_scene then greatest(20.0::DOUBLE, least(100.0::DOUBLE, 120 * affinity)) when subs >= 8 then greatest(30.0::DOUBLE, least(100.0::DOUBLE, (100 * common)::DOUBLE / greatest(2.0::DOUBLE, 0.15::DOUBLE * tokens)))
  when subs = 0 then case when conflict then 40.0::DOUBLE else 90.0::DOUBLE end else 100.0::DOUBLE end as a from f),
w as (select *, case when shared and not conflict then greatest(a, 85.0::DOUBLE) else a end as b from v),
judged as (select project_id, pos, case when conflict then least(b, 40.0::DOUBLE) else b end as verdict, not conflict and not regressed and not (has_scene and affinity < 0.10::DOUBLE and not conflict and subs >= 8) as ok from w)"""
SQL = {
    "schema_audit": f"with {_FLAWED} select * from fi",
    "leak_audit": f"with {_FLAWED}, l as (select unnest(['\"text\":', '\"confidence\":', '\"supporting_scenes\":', '\"segments\":', '```', '{{', '}}', '_']) as leak) select project_id, pos, leak from fl join l on contains(text, leak)",
    "findings_rollup": f"""with {_FLAWED}, c as (select project_id, CAST(count(*) filter (severity = 'fail') AS BIGINT) as fails, CAST(count(*) filter (severity = 'warning') AS BIGINT) as warnings,
  CAST(count(*) filter (severity = 'pass') AS BIGINT) as passes from fi group by all) select *, case when fails > 0 then 'fail' when warnings > 0 then 'warning' else 'pass' end as status from c""",
    "length_audit": f"""with {SEGMENTS}, c as (select project_id, CAST(sum(length(text)) AS BIGINT) as chars from segs group by all), m as (select *, chars / 250.0::DOUBLE as minutes from c)
select *, case when minutes < 0.8::DOUBLE * 5.0::DOUBLE or minutes > 1.2::DOUBLE * 8.0::DOUBLE then 'fail' when minutes < 5 or minutes > 8 then 'warning' else 'pass' end as severity from m""",
    "segment_types": f"""with {SEGMENTS}, c as (select project_id, CAST(count(*) AS BIGINT) as segments, bool_or(segment_type = 'hook') as has_hook, bool_or(segment_type = 'conclusion') as has_conclusion,
  (count(*) filter (segment_type = 'commentary'))::DOUBLE / count(*) as commentary_share from segs group by all) select *, commentary_share < 0.3::DOUBLE as sparse_commentary from c""",
    "evidence_coverage": f"""with {_REFS}, l as (select project_id, max(end_s) as last from cues group by all),
b as (select r.project_id, r.pos, sum(CAST(s > e AS INTEGER) + CAST(e > 1.1::DOUBLE * last AS INTEGER)) as bad from refs r left join l using (project_id) group by all),
c as (select s.project_id, CAST(count(*) AS BIGINT) as segments, CAST(count(*) filter (b.pos is null and segment_type not in ('hook', 'conclusion', 'transition')) AS BIGINT) as missing,
  CAST(coalesce(sum(bad), 0) AS BIGINT) as invalid from segs s left join b on b.project_id = s.project_id and b.pos = s.pos group by all)
select *, missing >= 0.3::DOUBLE * segments as failed from c""",
    "grounded_evidence": f"""with {SEGMENTS}, c as (select project_id, count(*) filter (segment_type not in ('hook', 'conclusion')) as n, count(*) filter (segment_type not in ('hook', 'conclusion') and pos % 3 <> 1) as ok from segs group by all),
g as (select project_id, case when n > 0 then ok::DOUBLE / n else 1.0::DOUBLE end as grounded from c) select *, 100 - 40 * (1 - grounded) - case when project_id % 2 = 0 then 20 else 0 end as score from g""",
    "pacing": f"""with {SEGMENTS}, r as (select project_id, pos, case when pos * 25.0::DOUBLE > 0 then length(text)::DOUBLE / (pos * 25.0::DOUBLE) * 60 else 250.0::DOUBLE end as rate from segs)
select project_id, pos, 100 - least(40.0::DOUBLE, 1.5::DOUBLE * greatest(0.0::DOUBLE, 200 - rate, rate - 290)) as pacing from r""",
    "av_coupling": f"""with {CLIPS}, c as (select *, duration + case when pos % 2 = 0 then 0.5::DOUBLE else 0.0::DOUBLE end as audio, abs(source_start - lag(source_start) over (partition by project_id order by pos)) < 5 as lp from clips),
a as (select project_id, coalesce(sum(case when duration > 0 and audio > 0 then abs(duration - audio) end), 0.0::DOUBLE) as drift, max(duration) as longest, CAST(count(*) filter (lp) AS BIGINT) as loops,
  case when count(*) >= 3 then least(1.0::DOUBLE, (max(source_end) - min(source_start)) / 1024.0::DOUBLE) else 1.0::DOUBLE end as coverage, CAST(count(*) filter (flag = 'A') AS BIGINT) as mismatches,
  least(100.0::DOUBLE, sum(duration / 64) / count(*) / 0.5::DOUBLE * 100) as content from c group by all)
select *, greatest(0.0::DOUBLE, 100.0::DOUBLE - case when drift > 1 then least(30.0::DOUBLE, 10 * drift) else 0.0::DOUBLE end - case when longest > 35 then 15.0::DOUBLE else 0.0::DOUBLE end - case when loops > 0 then least(40, 15 * loops) else 0 end
  - case when coverage < 0.35::DOUBLE then 40 * (0.35::DOUBLE - coverage) else 0.0::DOUBLE end - case when mismatches > 0 then least(60, 25 * mismatches) else 0 end - case when content < 40 then least(25.0::DOUBLE, 0.5::DOUBLE * (40 - content)) else 0.0::DOUBLE end) as coupling,
  loops > 0 or mismatches > 0 as hard_fail from a""",
    "clip_verdicts": f"with {_JUDGED} select * from judged",
    "clip_report": f"""with {_JUDGED} select project_id, CAST(count(*) AS BIGINT) as clips, CAST(count(*) filter (ok) AS BIGINT) as passed, CAST(count(*) filter (not ok) AS BIGINT) as failed,
  (count(*) filter (ok))::DOUBLE / count(*) * 100 as pass_rate, CAST(sum(CAST(floor(verdict) AS BIGINT)) AS DOUBLE) / count(*) as avg_verdict from judged group by all""",
    "media_audit": """with m as (select case when o_orderstatus = 'P' then 'unknown' else 'h264' end as v, case when starts_with(o_orderpriority, '5') then 'none' else 'aac' end as a, (o_custkey % 3)::DOUBLE as d from orders),
f as (select 'video_codec' as check, v <> 'unknown' as ok from m union all select 'audio_codec', a <> 'none' from m union all select 'duration', d > 0 from m) select "check", ok, CAST(count(*) AS BIGINT) as files from f group by all""",
    "character_registry": f"""with {SEGMENTS}, e as (select distinct project_id, n from segs join (select unnest(['anti', 'ere', 'isch']) as n) on contains(text, n) where pos % 2 = 0),
g as (select project_id, string_agg(n, ',' order by n) as names from e group by all) select p.project_id, coalesce(names, 'narrator') as names from (select distinct project_id from segs) p left join g using (project_id)""",
    "source_length": f"""with {CLIPS}, l as (select project_id, max(source_end) as last from clips group by all)
select project_id, coalesce(nullif(case when project_id % 2 = 0 then 0.0::DOUBLE when project_id % 3 = 0 then 90.0::DOUBLE end, 0.0::DOUBLE), case when project_id % 5 <> 0 then last end, 600.0::DOUBLE) as seconds from l""",
    "timed_reference_lines": f"""with {CUES} select project_id, case when pos % 2 = 0 then pos + 0.5::DOUBLE else pos::DOUBLE end as start_s, case when pos % 2 = 0 then null else 9.0::DOUBLE end as end_s, case when pos % 2 = 0 then 'talk' else '' end as kind,
  case when pos % 2 = 0 then 'turn' else 'words' end as description, case when pos % 2 = 0 then 'a+b' else '' end as characters from cues""",
}
