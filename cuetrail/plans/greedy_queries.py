"""Segmentation, clustering and greedy selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_contained, latin_tokens
from ..operators import dictionary as D
from ..operators import greedy as G
from ..operators.continuity import anchors
from .tables import CLIPS, CUES, LINES, clips, cues, grid, grid_sql, lines


def segment_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.segment_transcript(lines(spark, sf_dir).select("project_id", "pos", "start_s", "end_s", "text"))
    return out.select("project_id", "chunk_id", "start_s", "end_s", "word_count", "source_entries")


def _scenes(spark, sf_dir):
    c = lines(spark, sf_dir)
    s = grid(c, 20).select("project_id", F.col("scene_pos").alias("pos"), F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    return s, c


def cluster_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _scenes(spark, sf_dir)
    return G.cluster_scenes(s, c)


def _sequences(spark, sf_dir):
    c = clips(spark, sf_dir)
    weight = F.floor(F.col("duration") / 5)
    return c.select("project_id", "pos", F.col("source_start").alias("start_s"), F.col("duration").alias("duration_s"), D.phase(F.col("source_start"), F.lit(1000.0)).alias("event_type"), weight.cast("double").alias("weight"), (weight >= 4.5).alias("is_main"))


def select_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.select_phases(_sequences(spark, sf_dir), 300.0)


def label_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by words of a turn, each topic once in a conversation."""
    c = cues(spark, sf_dir)
    topics = {"articles": ["the", "der", "les"], "motion": ["ing", "tion"], "voice": ["an", "er", "is"], "other": ["ou", "th"]}
    scored = F.array(*(F.struct(F.lit(i).alias("topic_no"), F.lit(t).alias("topic"), F.aggregate(any_contained(F.col("text"), w), F.lit(0.0), lambda a, x: a + F.when(F.length(x) >= 3, 3.0).otherwise(2.0)).alias("score")) for i, (t, w) in enumerate(topics.items())))
    scores = c.select("project_id", "pos", F.explode(scored).alias("s")).select("project_id", "pos", "s.*")
    phases = c.select("project_id", "pos", D.phase(F.col("start_s"), F.lit(400.0)).alias("phase"))
    return G.label_topics(scores, phases)


def plan_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of a conversation placed on its scenes of 30 s; some conversations have no scenes."""
    c = cues(spark, sf_dir).withColumn("tokens", latin_tokens(F.col("text")))
    s = grid(c).select("project_id", "scene_pos", F.col("s").alias("start_s"), "e").where("project_id % 10 <> 3")
    texts = c.select("project_id", F.col("start_s").alias("cs"), F.col("end_s").alias("ce"), "tokens")
    scene_tokens = s.join(texts, "project_id").where("start_s < ce and e > cs").groupBy("project_id", "scene_pos", "start_s").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    n = anchors(c.where("segment_type = 'commentary'"), F.lit(600.0), F.col("duration"))
    n = n.select("project_id", "pos", F.col("duration").alias("need"), "anchor", F.when(F.col("pos") % 4 == 1, F.col("start_s")).alias("proposed_start"), F.when(F.col("pos") % 4 == 1, F.col("end_s")).alias("proposed_end"), "tokens")
    return G.plan_clips(n, scene_tokens, 600.0)


def sequence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the documents' scenes with transcripts, characters and keyframes. Every seventh scene has no transcript of its own."""
    s, c = _scenes(spark, sf_dir)
    key = F.concat(F.lit("k"), F.floor(F.col("pos") / 2).cast("string"))
    scenes = s.withColumns({"spoken": (F.col("project_id") % 7 != 0) & (F.col("pos") % 7 != 3), "keyframes": F.array(key)})
    names = any_contained(F.col("text"), ["the", "der", "que", "les"])  # a cue's name is one of every scene that it overlaps
    out = G.sequence_rollup(scenes, c.select("project_id", F.col("pos").alias("cue_pos"), "start_s", "end_s", "text", names.alias("characters")))
    return out.select("project_id", "sequence_id", "start_s", "end_s", F.sha2("transcript", 256).alias("transcript_sha256"), F.array_join("characters", ",").alias("characters"), F.array_join("keyframes", ",").alias("keyframes"), "dialogue_count")


QUERIES = {f.__name__: f for f in (segment_transcript, cluster_scenes, select_phases, label_topics, plan_clips, sequence_rollup)}
_CLUSTERED = f"""with recursive {LINES}, {grid_sql('lines', 20)},
b as (select project_id, scene_pos as i, s, e, lead(s) over (partition by project_id order by scene_pos) as nx from scenes),
br as (select *, nx is not null and not exists (select 1 from lines l where l.project_id = b.project_id and l.start_s >= b.e - 1 and l.start_s <= b.nx + 1) as brk from b),
st as (select project_id, i, s as st, e, brk, 0 as seq from br where i = 0
  union all select n.project_id, n.i, case when x.e - x.st >= 120 or (x.e - x.st >= 45 and x.brk) then n.s else x.st end, n.e, n.brk, case when x.e - x.st >= 120 or (x.e - x.st >= 45 and x.brk) then x.seq + 1 else x.seq end
    from st x join br n on n.project_id = x.project_id and n.i = x.i + 1)"""
_TOPICS = [("articles", ["the", "der", "les"]), ("motion", ["ing", "tion"]), ("voice", ["an", "er", "is"]), ("other", ["ou", "th"])]
_TOPIC_SCORES = " union all ".join(f"select project_id, pos, {i} as topic_no, '{t}' as topic, " + " + ".join(f"case when contains(text, '{w}') then {3 if len(w) >= 3 else 2} else 0 end" for w in words) + " as score from cues" for i, (t, words) in enumerate(_TOPICS))
_PART = "case when {r} < 0.18::DOUBLE then 'setup' when {r} < 0.45::DOUBLE then 'inciting_incident' when {r} < 0.75::DOUBLE then 'investigation' when {r} < 0.90::DOUBLE then 'climax' else 'resolution' end"
SQL = {
    "segment_transcript": f"""with recursive {LINES},
n as (select project_id, start_s, end_s, CAST(length(trim(text)) AS BIGINT) as c, row_number() over (partition by project_id order by pos) as i from lines),
st as (select project_id, i, c as used, start_s as st, 0 as chunk from n where i = 1
  union all select n.project_id, n.i, case when n.end_s - st.st > 60 or st.used + n.c > 200 then n.c else st.used + n.c end,
    case when n.end_s - st.st > 60 or st.used + n.c > 200 then n.start_s else st.st end, case when n.end_s - st.st > 60 or st.used + n.c > 200 then st.chunk + 1 else st.chunk end
    from st join n on n.project_id = st.project_id and n.i = st.i + 1)
select project_id, printf('chunk-%04d', chunk) as chunk_id, min(start_s) as start_s, arg_max(end_s, i) as end_s, CAST(sum(c) AS BIGINT) as word_count, CAST(count(*) AS BIGINT) as source_entries
from st join n using (project_id, i) group by project_id, chunk""",
    "cluster_scenes": f"""{_CLUSTERED}
select project_id, printf('seq-%03d', seq) as sequence_id, min(st) as start_s, max(e) as end_s, CAST(count(*) AS BIGINT) as scenes from st group by project_id, seq""",
    "select_phases": f"""with recursive {CLIPS},
a as (select project_id, pos, source_start as start_s, duration as duration_s, floor(duration / 5) as weight, {_PART.format(r='source_start / 1000.0::DOUBLE')} as part from clips),
m as (select *, weight >= 4.5 as is_main, case part when 'setup' then 0.22::DOUBLE when 'inciting_incident' then 0.26::DOUBLE when 'investigation' then 0.28::DOUBLE when 'climax' then 0.16::DOUBLE else 0.08::DOUBLE end * 300.0::DOUBLE as budget,
  part = 'setup' and start_s < 300 and weight >= 7 as may from a),
o as (select *, may and row_number() over (partition by project_id, part order by may desc, weight desc, pos) = 1 as opens from m),
c as (select *, row_number() over (partition by project_id, part order by opens desc, weight desc, pos) as i from o),
st as (select project_id, part, i, case when true then [start_s] end as picks, duration_s as spent, duration_s >= budget and not opens as done, true as picked from c where i = 1
  union all select n.project_id, n.part, n.i, case when n.ok then list_append(n.picks, n.start_s) else n.picks end, n.spent + case when n.ok then n.duration_s else 0 end,
    n.done or (n.ok and n.spent + n.duration_s >= n.budget), n.ok from
    (select c.*, st.picks, st.spent, st.done, not st.done and c.is_main and len(list_filter(st.picks, lambda p: abs(c.start_s - p) < 30)) = 0 and st.spent + c.duration_s <= c.budget * 1.30::DOUBLE as ok
     from st join c on c.project_id = st.project_id and c.part = st.part and c.i = st.i + 1) n)
select c.project_id, c.part, c.pos, c.start_s, c.duration_s, c.weight, c.is_main, CAST(row_number() over (partition by c.project_id order by c.start_s, c.pos) AS INTEGER) as place from c join st using (project_id, part, i) where st.picked""",
    "label_topics": f"""with recursive {CUES}, s as ({_TOPIC_SCORES}),
r as (select project_id, pos, list(topic order by score desc, topic_no) as topics from s where score >= 2 group by all),
n as (select c.project_id, c.pos, coalesce(r.topics, []) as topics, 'phase_' || {_PART.format(r='(c.start_s / 400.0::DOUBLE)')} || '_' || CAST(c.pos AS VARCHAR) as fallback,
  row_number() over (partition by c.project_id order by c.pos) as i from cues c left join r on r.project_id = c.project_id and r.pos = c.pos),
st as (select project_id, pos, i, coalesce(topics[1], fallback) as topic, [coalesce(topics[1], fallback)] as used from n where i = 1
  union all select x.project_id, x.pos, x.i, x.t, list_append(x.used, x.t) from
    (select n.project_id, n.pos, n.i, st.used, coalesce(list_filter(n.topics, lambda t: not list_contains(st.used, t))[1], n.fallback) as t from st join n on n.project_id = st.project_id and n.i = st.i + 1) x)
select project_id, pos, topic from st""",
    "plan_clips": f"""with recursive {CUES}, {grid_sql('cues')},
k as (select project_id, pos, start_s, end_s, duration, segment_type, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) as tokens from cues),
sc as (select s.project_id, s.scene_pos, s.s as start_s, list_distinct(flatten(list(k.tokens))) as t from scenes s join k on k.project_id = s.project_id and s.s < k.end_s and s.e > k.start_s where s.project_id % 10 <> 3 group by all),
n0 as (select project_id, pos, duration as need, tokens, case when pos % 4 = 1 then start_s end as lo, case when pos % 4 = 1 then end_s end as hi,
  row_number() over (partition by project_id order by pos) as i, count(*) over (partition by project_id) as n from k where segment_type = 'commentary'),
n1 as (select *, (i - 1)::DOUBLE / n * greatest(0.0::DOUBLE, 600.0::DOUBLE - need) as anchor from n0),
offered as (select n1.project_id, n1.pos, list({{'p': sc.scene_pos, 's': sc.start_s, 'b': 0.20::DOUBLE * least(1.0::DOUBLE, len(list_intersect(n1.tokens, sc.t))::DOUBLE / greatest(3.0::DOUBLE, 0.15::DOUBLE * len(n1.tokens)))}} order by sc.scene_pos) as c
  from n1 join sc using (project_id) group by all),
nar as (select n1.project_id, n1.pos, n1.i, n1.need, n1.anchor, n1.lo, n1.hi, coalesce(o.c, []) as c from n1 left join offered o using (project_id, pos)),
st as (select project_id, CAST(0 AS BIGINT) as i, CAST(null AS INTEGER) as pos, CAST(null AS DOUBLE) as source_start, CAST(null AS DOUBLE) as need, CAST(null AS INTEGER) as scene_pos, CAST(null AS DOUBLE) as score, CAST([] AS DOUBLE[]) as used, CAST([] AS DOUBLE[]) as made from (select distinct project_id from nar)
  union all select y.project_id, y.i, y.pos, y.at, y.need, y.best.p, coalesce(y.best.v, 0.0::DOUBLE), list_append(y.used, y.at), case when y.lo is null then y.made else list_append(y.made, y.lo) end from
   (select x.*, greatest(0.0::DOUBLE, least(coalesce(x.best.s, x.anchor), greatest(0.0::DOUBLE, 600.0::DOUBLE - x.need))) as at from
    (select v.*, coalesce(list_filter(v.scored, lambda z: z.f), list_filter(v.scored, lambda z: false)) as fr, case when len(list_filter(v.scored, lambda z: z.f)) > 0 then list_sort(list_filter(v.scored, lambda z: z.f), 'DESC')[1] else list_sort(v.scored, 'DESC')[1] end as best from
     (select w.*, list_transform(w.c, lambda z: {{'v': floor((z.b + 0.25::DOUBLE * (case when w.fits then case when z.s >= w.lo - 40 - 30 and z.s <= w.hi + 40 + 30 then 1.0::DOUBLE else -2 - least(abs(z.s - (w.lo - 40)), abs(z.s - (w.hi + 40))) / 100 end
        else greatest(0.0::DOUBLE, 1 - abs(z.s - w.anchor) / 150.0::DOUBLE) end) + 0.10::DOUBLE * (case when w.last is null then 0.5::DOUBLE when z.s - w.last >= 0 then least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * (1 - least(1.0::DOUBLE, (z.s - w.last) / 60.0::DOUBLE)))
        when z.s - w.last >= -30 then 0.2::DOUBLE else -1 - abs(z.s - w.last) / 100 end)) * 10000 + 0.5::DOUBLE) / 10000, 'q': -z.p, 'p': z.p, 's': z.s, 'f': len(list_filter(w.used, lambda u: abs(z.s - u) < 8)) = 0}}) as scored from
      (select n.*, st.used, st.made, st.source_start as last, coalesce(n.lo >= 0 and n.lo <= 600 and not (st.source_start is not null and st.source_start > 0 and n.lo < st.source_start - 120) and not list_contains(st.made, n.lo)
         and len(list_filter(st.used, lambda u: abs(n.lo - u) < 15)) = 0, false) as fits from st join nar n on n.project_id = st.project_id and n.i = st.i + 1) w) v) x) y)
select project_id, pos, source_start, source_start + need as source_end, scene_pos, score from st where i > 0""",
    "sequence_rollup": f"""{_CLUSTERED},
tx as (select s.project_id, s.scene_pos as pos, coalesce(string_agg(l.text, ' ' order by l.pos), '') as text from scenes s left join lines l on l.project_id = s.project_id and s.s < l.end_s and s.e > l.start_s group by all),
sp as (select project_id, seq, min(st) as start_s, max(e) as end_s from st group by all),
sn as (select st.project_id, st.seq, tx.pos, tx.text as full_text, case when tx.project_id % 7 <> 0 and tx.pos % 7 <> 3 then trim(tx.text) else '' end as own from st join tx on tx.project_id = st.project_id and tx.pos = st.i),
names as (select project_id, seq, string_agg(n, ',' order by n) as characters from (select distinct project_id, seq, n from sn join (select unnest(['the', 'der', 'que', 'les']) as n) on contains(full_text, n)) group by all),
keys as (select project_id, seq, string_agg(k, ',' order by p) as keyframes from (select project_id, seq, 'k' || CAST(pos // 2 AS VARCHAR) as k, min(pos) as p from sn group by all) group by all),
own as (select project_id, seq, string_agg(own, ' ' order by pos) as t, count(*) as n from sn where own <> '' group by all),
cu as (select sp.project_id, sp.seq, count(*) as n, string_agg(l.text, ' ' order by l.pos) as t from sp join lines l on l.project_id = sp.project_id and l.start_s >= sp.start_s - 0.2::DOUBLE and l.start_s <= sp.end_s + 0.2::DOUBLE group by all)
select project_id, printf('seq-%03d', seq) as sequence_id, sp.start_s, sp.end_s, sha256(coalesce(own.t, cu.t, '')) as transcript_sha256, coalesce(characters, '') as characters, coalesce(keyframes, '') as keyframes, CAST(coalesce(cu.n, own.n, 0) AS BIGINT) as dialogue_count
from sp left join names using (project_id, seq) left join keys using (project_id, seq) left join own using (project_id, seq) left join cu using (project_id, seq)""",
}
