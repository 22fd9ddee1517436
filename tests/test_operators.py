"""Literals of small films, scripts and logs."""

import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetrail.functions import grams
from cuetrail.functions import text as X
from cuetrail.functions import timecode as C
from cuetrail.operators import audit as A
from cuetrail.operators import continuity as K
from cuetrail.operators import dictionary as D
from cuetrail.operators import greedy as G
from cuetrail.operators import intervals as I
from cuetrail.operators import lifecycle as L
from cuetrail.operators import matching as M
from cuetrail.operators import telemetry as T
from cuetrail.operators import textmetrics as TM
from cuetrail.sources import artifacts, subtitles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def scenes(spark):
    rows = [("p", 0, "scene-0001", 0.0, 30.0, "Hello, welcome to the story.", ["Alice", "Bob"], []), ("p", 1, "scene-0002", 30.0, 60.0, "The conflict begins here.", ["Alice"], []), ("p", 2, "scene-0003", 60.0, 90.0, "Resolution and ending.", ["Bob", "Charlie"], ["mild_violence"])]
    return spark.createDataFrame(rows, "project_id string, pos int, scene_id string, start_s double, end_s double, text string, characters array<string>, labels array<string>")


def test_scene_filters(scenes):
    ids = lambda d: [r.scene_id for r in d.orderBy("pos").collect()]
    assert ids(I.contains_text(scenes, "text", "CONFLICT")) == ["scene-0002"]
    assert ids(I.contains_text(scenes, "text", "nonexistent")) == []
    assert len(ids(I.contains_text(scenes, "text", ""))) == 3
    assert len(ids(I.overlapping(scenes, 25, 55))) == 2
    assert ids(I.member_contains(scenes, "characters", "charl")) == ["scene-0003"]
    assert ids(I.non_empty(scenes, "labels")) == ["scene-0003"]
    assert ids(I.first_row(scenes, F.col("scene_id") == "scene-0002", "pos")) == ["scene-0002"]


def test_time_codes(spark):
    r = one(spark, *(C.to_seconds(F.lit(t)).alias(f"c{i}") for i, t in enumerate(["00:01:02,000", "01:00:00,500", "02:03.5", "7", "x"])), C.srt_time(F.lit(3661.2509)).alias("srt"), C.vtt_time(F.lit(1.5)).alias("vtt"), C.duration_text(F.lit(5025.0)).alias("d"), C.duration_text(F.lit(45.0)).alias("s"))
    assert tuple(r)[:5] == (62.0, 3600.5, 123.5, 7.0, None)
    assert (r.srt, r.vtt, r.d, r.s) == ("01:01:01,250", "00:00:01.500", "1h 23m 45s", "45s")


def test_srt_and_vtt(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello world\n\nx\n00:00:03,000 --> 00:00:04,000\nbad\n\n3\r\n00:00:05,000 --> 00:00:06,500\r\ntwo\r\nlines\n")
    got = [tuple(r)[1:] for r in subtitles.read_srt(spark, str(tmp_path / "a.srt")).orderBy("pos").collect()]
    assert got == [(0, 1, 1.0, 2.0, "Hello world"), (1, 3, 5.0, 6.5, "two\nlines")]
    assert subtitles.rejected_srt(spark, str(tmp_path / "a.srt")).count() == 1
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE hi\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\none\ntwo\n\n00:03.000 --> 00:04.000\nthree\n")
    got = [tuple(r)[1:] for r in subtitles.read_vtt(spark, str(tmp_path / "b.vtt")).orderBy("pos").collect()]
    assert got == [(0, 1, 1.0, 2.0, "one\ntwo"), (1, 2, 3.0, 4.0, "three")]


def test_tokens_and_cleaning(spark):
    text = "2031年，山雨在港口面包店使用GPU写字！"
    r = one(spark, X.tokens(F.lit(text)).alias("t"), X.clean_narration(F.lit('{"text": "He_said hi", "confidence": 0.9}')).alias("c"), X.clean_narration(F.lit("```json\nplain `x`\n```")).alias("p"), X.slug(F.lit(' a: b/c? ')).alias("s"), X.recover_json(F.lit('Sure! {"a": 1} done')).alias("j"), X.recover_json(F.lit("no")).alias("n"), X.normal_title(F.lit("《A_b c》")).alias("title"))
    assert {"2031", "gpu", "GPU", "山", "山雨", "面包店", "港口"} <= set(r.t)
    assert (r.c, r.p, r.s, json.loads(r.j), r.n, r.title) == ("He said hi", "plain x", "a_bc", {"a": 1}, None, "abc")


def test_grams_of_astral_text(spark):
    d = spark.createDataFrame([(1, "a😀ba😀b😀"), (2, "a"), (3, None), (4, "")], "doc_id int, text string")
    rows = sorted((r.doc_id, r.gram, r["count"], r.first_pos) for r in TM.repeated_phrases(d, 2, 2).collect())
    assert rows == [(1, "a😀", 2, 0), (1, "😀b", 2, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 8, 13])
def test_grams_equal_plain_counting(n):
    import random

    r = random.Random(n)
    for _ in range(60):
        text = "".join(r.choice("ab😀é") for _ in range(r.randint(0, 40)))
        plain = [text[i : i + n] for i in range(len(text) - n + 1)]
        ids = grams._grams(grams._codes(text), n).tolist()
        assert len(ids) == len(plain) and len(set(zip(ids, plain, strict=True))) == len(set(ids)) == len(set(plain))


def test_contained_terms(spark):
    texts = [(1, "one red fish, two blue fish."), (1, "one red fish, two blue fish."), (2, "redfish"), (3, None), (None, "a red fish here"), (1, "other text")]
    terms = [("x", "e red f"), ("y", "fish"), ("z", "two blue fish"), ("x", "e red f"), ("n", None), ("w", "red, fish")]
    t, d = spark.createDataFrame(texts, "doc_id int, text string").withColumn("title", F.lit("clash")), spark.createDataFrame(terms, "title string, needle string")
    got = sorted(((r.doc_id, r.text, r.needle) for r in D.contained(t, d, ("doc_id",), "needle").collect()), key=str)
    distinct = {x for x in terms if x[1]}
    assert got == sorted(((i, x, n) for i, x in texts if x for _, n in distinct if n in x), key=str)


def test_map_hash_equals_canonical_json(spark):
    import hashlib

    m = {"b": "é😀\"x\\", "a": "1", "c": "line\nnext"}
    r = one(spark, X.map_hash(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))).alias("h"))
    assert r.h == hashlib.sha256(json.dumps(m, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_cleaning_of_payloads(spark):
    texts = {'["a", {"text": "b"}, {"x": 1}]': "a b", '{"segments": ["skipped", {"text": "kept"}]}': "kept", r'path\to \"it\" a\nb': r"path\to it a b"}
    r = one(spark, *(X.clean_narration(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)))
    assert list(r) == list(texts.values())


def test_groups_stream_past_in_any_batches(spark):
    rows = [(k, i) for k in [None, 1.0, float("nan"), 2.0, 5.0] for i in range(1 if k == 2.0 else 700)]
    d = spark.createDataFrame(rows, "project_id double, pos int").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = G._grouped(d, ["project_id"], ["pos"], "n int", lambda g: [len(g["pos"])] * len(g["pos"])).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and all(r.n == (1 if r.project_id == 2.0 else 700) for r in got if r.project_id in (1.0, 2.0, 5.0))
    assert {r.n for r in got if r.project_id is None or r.project_id != r.project_id} <= {700, 1400}


def test_text_metrics(spark):
    d = spark.createDataFrame([(1, "钟楼" * 6), (2, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳")], "doc_id int, text string").select("doc_id", TM.lexical_diversity(F.col("text")).alias("d"))
    a, b = [r.d for r in d.orderBy("doc_id").collect()]
    assert a.ttr < 0.35 and b.ttr > 0.7 and b.distinct_2 > 0.85
    docs = spark.createDataFrame([(1, "蓝色风铃的回声，蓝色风铃的回声。蓝色风铃的回声"), (2, "")], "doc_id int, text string")
    top = TM.top_phrases(TM.repeated_phrases(docs, 4, 3), 1).collect()
    assert [(r.doc_id, r.gram, r["count"]) for r in top] == [(1, "蓝色风铃", 3)]
    r = one(spark, TM.lexical_diversity(F.lit("")).alias("e"), F.size(TM.pattern_matches(F.lit("in a world where at the end of the day little did he know"), TM.CLICHES)).alias("n"), F.size(TM.pattern_matches(F.lit("clean"), TM.CLICHES)).alias("z"))
    assert tuple(r.e) == (1.0, 1.0, 1.0) and (r.n, r.z) == (3, 0)


def test_duplicate_sentences(spark):
    s = spark.createDataFrame([("p", 0, "一个很长的句子在这里反复出现。短句"), ("p", 1, "另起。一个很长的句子在这里反复出现！")], "project_id string, pos int, text string")
    assert [(r.sentence, r.segments) for r in TM.duplicate_sentences(s).collect()] == [("一个很长的句子在这里反复出现", 2)]


def test_segmentation(spark):
    cues = [(0.0, 5.0, "Welcome to the story."), (5.5, 10.0, "Something happens here."), (10.5, 15.0, "The plot thickens."), (60.0, 65.0, "A new chapter begins."), (65.5, 70.0, "Find the answer.")]
    d = spark.createDataFrame([("p", i, *c) for i, c in enumerate(cues)], "project_id string, pos int, start_s double, end_s double, text string")
    short = G.segment_transcript(d, 20, 100).collect()
    assert sum(r.source_entries for r in short) == 5 and len(short) >= 2
    assert I.contains_text(G.segment_transcript(d, 120, 500), "text", "find").count() == 1
    assert I.overlapping(d, 4, 12).count() >= 1


def test_clustering_and_selection(spark):
    s = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate([(0.0, 15.0), (15.0, 35.0), (35.0, 55.0), (55.0, 110.0)])], "project_id string, pos int, start_s double, end_s double")
    c = spark.createDataFrame([("p", i, x, x + 2) for i, x in enumerate([2.0, 20.0, 40.0])], "project_id string, pos int, start_s double, end_s double")
    rows = G.cluster_scenes(s, c, 40, 120).orderBy("sequence_id").collect()
    assert all(r.end_s - r.start_s >= 40 for r in rows[:-1]) and sum(r.scenes for r in rows) == 4
    seqs = spark.range(20).select(F.lit("p").alias("project_id"), F.col("id").alias("pos"), (F.col("id") * 100.0).alias("start_s"), F.lit(60.0).alias("duration_s"), D.phase(F.col("id") * 100.0, F.lit(1960.0)).alias("event_type"), F.lit(6.0).alias("weight"), F.lit(True).alias("is_main"))
    picked = G.select_phases(seqs, 300.0).orderBy("pos").collect()
    assert len(picked) >= 3 and 200 <= sum(r.duration_s for r in picked) <= 450


def test_sequences_of_a_line_dealt_and_sorted_once(spark):
    # scenes of odd lengths with gaps, cues on and beside their edges; a film without cues, a cue without scenes, a cue without a start
    scenes, cues = [], []
    for p in range(12):
        at = 0.0
        for i in range(40):
            length = 5.0 + (i * 7 + p * 13) % 31
            scenes.append((p, i + (1 << 53) + 1, at, at + length))
            at += length + (i * p) % 3
            if p and (i * 5 + p) % 4 < 2:
                cues.append((p, at - 1 + (i + p) % 4 * 0.5 if i % 3 else scenes[-1][3] - 1 - (i % 2) * 0.25))
    cues += [(99, 3.0), (3, None)]
    want, broken = [], {}
    for p in range(12):
        film, seq, held = [x[1:] for x in scenes if x[0] == p], 0, []
        for k, (pos, s, e) in enumerate(film):
            held.append((s, e))
            last = k + 1 == len(film)
            b = not last and not any(q == p and c is not None and e - 1 <= c <= film[k + 1][1] + 1 for q, c in cues)
            broken[p, pos] = (b, seq)
            if last or e - held[0][0] >= 120 or (e - held[0][0] >= 45 and b):
                want.append((p, f"seq-{seq:03d}", held[0][0], e, len(held)))
                seq, held = seq + 1, []
    s = spark.createDataFrame(scenes[::-1], "project_id bigint, pos bigint, start_s double, end_s double")
    c = spark.createDataFrame(cues[::-1], "project_id bigint, start_s double")
    out = G.cluster_scenes(s, c)
    assert sorted(map(tuple, out.collect())) == want
    assert {(r.project_id, r.pos): (r.has_break, r.seq) for r in G.number_sequences(s, c).collect()} == broken
    assert {b for b, _ in broken.values()} == {True, False} and len({r[4] for r in want}) > 2
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not any(x in plan for x in ("Join", "Aggregate")) and plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_rollup_of_a_line_dealt_and_sorted_once(spark, monkeypatch):
    """Cues that overlap, come in any order or lack a time or text; own, overheard and missing transcripts; films without cues or keys."""
    rng = random.Random(3)
    scenes, cues = [], []
    for p in [*range(8), None]:
        at = 0.0
        for i in range(25 if p is not None else 1):
            e = at + rng.choice([5.0, 20.0, 40.0])
            start = None if p == 5 and i in (3, 4) else at
            scenes.append((p, i, start, e, rng.choice([None, None, "", "  own ", f"own{i}"]), rng.choice([None, True, True, False]) if p != 6 else None, rng.choice([None, [], ["z", "", None], ["a"]]), rng.choice([None, ["k", f"k{i // 3}", ""]])))
            at = e + rng.choice([0.0, 0.0, 3.0])
        for c in range(40) if p != 7 else ():
            b = None if c == 8 else round(rng.uniform(-20, at + 20) * 4) / 4
            end = None if b is None or c == 9 else b + rng.choice([0.0, 2.0, 10.0, 300.0])
            cues.append((p, c, b, end, rng.choice([None, "", " ", f"é{c} ", f"t{c}"]), rng.choice([None, ["b", "a"], [f"n{c % 4}"]])))
    want = []
    for p in [*range(8), None]:
        film, said = [x[1:] for x in scenes if x[0] == p], [x[1:] for x in cues if x[0] == p]
        seqs = {(r.project_id, r.pos): r.seq for r in G.number_sequences(*_of_film(spark, scenes, cues, p)).collect()}
        for seq in sorted(set(seqs.values())):
            held = [x for x in film if seqs[p, x[0]] == seq]
            starts, end = [x[1] for x in held if x[1] is not None], held[-1][2]
            own, names, frames = [], set(), []
            for pos, s, e, text, spoken, chars, keys in held if p is not None else ():
                met = [c for c in said if None not in (s, c[1], c[2]) and s < c[2] and e > c[1]]
                text = text if text is not None else " ".join(c[3] for c in met if c[3] is not None) if spoken else ""
                own += [text.strip(" ")] if text.strip(" ") else []
                names |= {x for of in (chars, *(c[4] for c in met)) for x in of or () if x}
                frames += [x for x in keys or () if x and x not in frames]
            near = [c for c in said if p is not None and starts and c[1] is not None and min(starts) - 0.2 <= c[1] <= end + 0.2]
            own = own or [c[3] for c in near if c[3]]
            want.append((p, f"seq-{seq:03d}", min(starts, default=None), end, " ".join(own), sorted(names), frames, len(near) or len(own)))
    for sizes in ({}, {"batch": "9", "handed_on": 1}):
        monkeypatch.setattr(G, "HANDED_ON", sizes.get("handed_on", G.HANDED_ON))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sizes.get("batch", "10000"))
        try:
            got = sorted((tuple(r) for r in G.sequence_rollup(*_of_film(spark, scenes[::-1], cues[::-1])).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
    assert len(want) > 30 and {len(r[5]) > 2 for r in want} == {True, False} and any(r[4] == "" for r in want) and any(r[7] == 0 for r in want)


def _of_film(spark, scenes, cues, film="all"):
    of = lambda rows: [r for r in rows if film in ("all", r[0])]
    return (spark.createDataFrame(of(scenes), "project_id bigint, pos bigint, start_s double, end_s double, transcript string, spoken boolean, characters array<string>, keyframes array<string>"),
            spark.createDataFrame(of(cues), "project_id bigint, cue_pos int, start_s double, end_s double, text string, characters array<string>"))


def test_texts_of_a_rollup_are_dealt_once(spark):
    """A cue of 100,000 characters lies under 1,250 scenes, whose transcripts were shuffled twice."""
    from cuetrail import catalog

    how = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        plan = catalog.QUERIES["sequence_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the films' ends, and the line of cues and scenes
    assert "Join" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_clip_plan_moves_through_the_film(spark):
    scenes = spark.range(100).select(F.lit("p").alias("project_id"), F.col("id").alias("scene_pos"), (F.col("id") * 50.0).alias("start_s"))
    none = F.lit(None).cast("double")
    n = spark.range(10).select(F.lit("p").alias("project_id"), F.col("id").alias("pos"), F.lit(10.0).alias("need"), (F.col("id") / 10 * 4990).alias("anchor"), none.alias("proposed_start"), none.alias("proposed_end"))
    starts = [r.source_start for r in G.plan_clips(n, scenes, 5000.0).orderBy("pos").collect()]
    assert len(starts) == 10 and max(starts) > 3500 and all(abs(b - a) >= 8 for a, b in zip(starts, starts[1:], strict=False))
    assert [r.source_start for r in G.plan_clips(n, scenes.limit(0), 5000.0).orderBy("pos").collect()] == [min(499.0 * i, 4990.0) for i in range(10)]
    followed = G.plan_clips(n.withColumns({"proposed_start": F.col("pos") * 7.0, "proposed_end": F.col("pos") * 7.0 + 9}), scenes, 5000.0, aligned=True)
    assert [(r.source_start, r.scene_pos, r.score) for r in followed.orderBy("pos").collect()] == [(7.0 * i, None, 1.0) for i in range(10)]


def test_clip_plan_scores_as_the_affinity_of_a_pair(spark):
    word = lambda seed, i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(12)).cast("string"))
    terms = lambda seed, n: F.array(*(word(seed, i) for i in range(n)))
    scenes = spark.range(300).select((F.col("id") % 30).alias("project_id"), F.floor(F.col("id") / 30).cast("int").alias("scene_pos"), (F.col("id") * 2.0).alias("start_s"), terms(1, 4).alias("tokens"), F.when(F.col("id") % 3 > 0, terms(2, 5)).alias("summary"), terms(3, 1).alias("concepts"))
    none = F.lit(None).cast("double")
    first = spark.range(30).select(F.col("id").alias("project_id"), F.lit(0).alias("pos"), F.lit(5.0).alias("need"), (F.col("id") * 20.0).alias("anchor"), none.alias("proposed_start"), none.alias("proposed_end"), terms(4, 6).alias("tokens"), terms(5, 2).alias("concepts"))
    got = {r.project_id: (r.scene_pos, r.score) for r in G.plan_clips(first, scenes, 700.0).collect()}
    s = scenes.select("project_id", "scene_pos", "start_s", F.col("tokens").alias("context"), F.coalesce("summary", F.array().cast("array<string>")).alias("summary"), F.col("concepts").alias("of_scene"))
    pairs = first.withColumn("tokens", F.array_distinct("tokens")).join(s, "project_id")
    shared = F.size(F.array_intersect("concepts", "of_scene")).cast("double")
    score = M.affinity(F.col("tokens"), F.col("context"), F.col("summary"), shared, F.col("start_s"), F.col("anchor"), F.lit(700.0), none, none, none)
    best = pairs.select("project_id", "scene_pos", (F.floor(score * 10000 + 0.5) / 10000).alias("score")).groupBy("project_id").agg(F.max("score").alias("score"), F.max_by("scene_pos", F.struct("score", -F.col("scene_pos"))).alias("scene_pos")).collect()
    assert len(got) == 30 and got == {r.project_id: (r.scene_pos, r.score) for r in best}
    assert len({s for s, _ in got.values()}) > 3


def test_clip_plan_deals_each_row_once(spark):
    none = F.lit(None).cast("double")
    tokens = F.array(F.concat(F.lit("w"), (F.col("id") % 50).cast("string")))
    scenes = spark.range(3000).select(F.lit("p").alias("project_id"), F.col("id").alias("scene_pos"), (F.col("id") * 10.0).alias("start_s"), tokens.alias("tokens"))
    n = spark.range(400).select(F.lit("p").alias("project_id"), F.col("id").alias("pos"), F.lit(9.0).alias("need"), (F.col("id") * 75.0).alias("anchor"), none.alias("proposed_start"), none.alias("proposed_end"), tokens.alias("tokens"))
    out = G.plan_clips(n, scenes, 30000.0)
    assert "Join" not in out._jdf.queryExecution().toString()
    rows = out.orderBy("pos").collect()
    assert len(rows) == 400 and len({r.source_start for r in rows}) == 400
    assert sum(r.scene_pos % 50 == r.pos % 50 for r in rows) > 20


def test_selection_is_placed_by_time(spark):
    parts = F.when(F.col("id") % 2 == 0, "climax").otherwise("setup")
    seqs = spark.range(20).select(F.lit("p").alias("project_id"), F.col("id").alias("pos"), (F.floor(F.col("id") / 2) * 100.0).alias("start_s"), F.lit(10.0).alias("duration_s"), parts.alias("event_type"), F.lit(6.0).alias("weight"), F.lit(True).alias("is_main"))
    rows = G.select_phases(seqs, 300.0).collect()
    assert {r.part for r in rows} == {"setup", "climax"}
    placed = sorted(rows, key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(1, len(rows) + 1))
    assert [(r.start_s, r.pos) for r in placed] == sorted((r.start_s, r.pos) for r in rows)


def test_titles_of_the_first_segment_and_the_whole_script(spark):
    segs = spark.createDataFrame([
        ("right", 0, "Now 《The  Long Night》 begins"), ("right", 1, "《Other Film》 is named later"),
        ("wrong", 1, "Quiet"), ("wrong", 0, "《Other Film》 and 《Other Film》 and 《 》"),
        ("foreign", 0, "The captain of"), ("foreign", 1, "the ark, and Zed"), ("own", 0, "Zed came"),
        ("untitled", 0, "Zed of 《Other Film》"), ("silent", 0, None), ("silent", 1, "《Other Film》"),
    ], "project_id string, pos int, text string")
    titles = spark.createDataFrame([(p, "TheLongNight") for p in ("right", "wrong", "foreign", "silent")] + [("own", "The_ark: Zed Returns"), ("untitled", None)], "project_id string, own_title string")
    signs = spark.createDataFrame([("The Ark Film", "captain of the ark"), ("The Ark Film", "Zed"), ("The Long Night", "ark"), ("Nobody", None)], "title string, signature string")
    got = sorted((r.project_id, r.check, r.severity, r.title, r.signatures) for r in D.title_findings(segs, titles, signs, ("project_id",)).collect())
    ok = lambda p: (p, "title_isolation", "pass", None, [])
    bad = ("wrong", "title_mismatch", "fail", "Other Film", [])
    assert got == [("foreign", "title_isolation", "fail", "The Ark Film", ["Zed", "captain of the ark"]), ok("own"), ok("right"), ok("silent"), ok("untitled"), bad, bad]
    assert D.title_findings(segs.limit(0), titles, signs, ("project_id",)).count() == 0
    assert {r.severity for r in D.title_findings(segs.where("project_id = 'foreign'"), titles, signs.limit(0), ("project_id",)).collect()} == {"pass"}


def test_clip_findings_are_rows(spark):
    rows = [("p", 0, 100.0, 110.0, 10.5, 0, True, 0.5, 20), ("p", 1, 54.0, 64.0, 11.5, 2, True, 0.01, 20), ("p", 2, 9.0, 9.0, 5.0, 0, True, 0.05, 8), ("p", 3, 8.0, 8.5, None, 0, True, 0.05, 7), ("q", 0, 0.0, 4.0, 5.5, 0, None, None, None)]
    clips = spark.createDataFrame(rows, "project_id string, pos int, source_start double, source_end double, duration double, conflicts int, has_scene boolean, affinity double, subs int")
    got = sorted((r.project_id, r.pos, r.finding, r.amount) for r in A.clip_findings(clips).collect())
    assert got == [("p", 1, "activity_conflict", 2.0), ("p", 1, "backward_jump", 46.0), ("p", 1, "duration_drift", 1.5), ("p", 2, "low_correlation", 0.05), ("q", 0, "duration_drift", 1.5)]
    assert A.clip_findings(clips.limit(0)).count() == 0


def test_topics_are_not_reused(spark):
    scores = spark.createDataFrame([("p", 0, 0, "a", 3.0), ("p", 0, 1, "b", 3.0), ("p", 1, 0, "a", 6.0), ("p", 1, 1, "b", 2.0), ("p", 2, 0, "a", 9.0)], "project_id string, pos int, topic_no int, topic string, score double")
    phases = spark.createDataFrame([("p", i, "setup") for i in range(3)], "project_id string, pos int, phase string")
    assert [r.topic for r in G.label_topics(scores, phases).orderBy("pos").collect()] == ["a", "b", "phase_setup_2"]


def test_interval_buckets_change_nothing(spark):
    a = spark.range(200).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("x"), (F.col("id") * 7 % 50 * 1.5).alias("s")).withColumn("e", F.col("s") + F.col("x") % 5 * 10)
    b = spark.range(200).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("y"), (F.col("id") * 11 % 60 * 1.25).alias("s2")).withColumn("e2", F.col("s2") + F.col("y") % 4 * 7)
    for inclusive in (False, True):
        plain = {(r.x, r.y) for r in I.interval_join(a, b, inclusive=inclusive).collect()}
        bucketed = [(r.x, r.y) for r in I.interval_join(a, b, bucket_seconds=12.0, inclusive=inclusive).collect()]
        assert len(bucketed) == len(set(bucketed)) and set(bucketed) == plain


def test_clip_texts_fall_back(spark):
    clips = spark.createDataFrame([("p", 0, 15.0, 30.0), ("p", 1, 100.0, 110.0)], "project_id string, clip_pos int, s double, e double")
    cues = spark.createDataFrame([("p", 0, 10.0, 20.0, "First line"), ("p", 1, 25.0, 35.0, "Second line"), ("p", 2, 40.0, 50.0, "Third line")], "project_id string, cue_pos int, s2 double, e2 double, text string")
    sc = spark.createDataFrame([("p", 0, 90.0, 120.0, "scene")], "project_id string, scene_pos int, s2 double, e2 double, transcript string")
    assert {r.clip_pos: r.text for r in I.clip_texts(clips, cues, sc).collect()} == {0: "First line Second line", 1: "scene"}


def test_context_and_affinity(spark):
    s = spark.createDataFrame([("p", i, i * 10.0, i * 10.0 + 10, ["x"] if i == 1 else []) for i in range(3)], "project_id string, pos int, start_s double, end_s double, tokens array<string>")
    assert [r.context for r in K.context(s, "tokens").orderBy("pos").collect()] == [["x"], ["x"], ["x"]]
    null = F.lit(None).cast("double")
    words = F.array(F.lit("cut"), F.lit("hair"))
    near = M.affinity(words, words, F.array().cast("array<string>"), F.lit(1.0), F.lit(100.0), F.lit(100.0), F.lit(1000.0), null, null, null)
    far = M.affinity(words, words, F.array().cast("array<string>"), F.lit(1.0), F.lit(100.0), F.lit(100.0), F.lit(1000.0), F.lit(900.0), null, null)
    r = one(spark, near.alias("near"), far.alias("far"))
    assert r.near > 0.35 and r.far < r.near
    scored = spark.createDataFrame([("p", 0, 0, 2600.0, 0.9, [2600.0]), ("p", 0, 1, 100.0, 0.2, [2600.0])], "project_id string, narration_pos int, scene_pos int, start_s double, score double, used array<double>")
    assert [r.scene_pos for r in M.best_scenes(scored, 1).collect()] == [1]


def test_coupling_and_grade(spark):
    c = spark.createDataFrame([("a", 0, 20.0, 20.0, 35.0, 55.0, 1.0, False), *[("b", i, 10.0, 10.0, 35.0, 45.0, 1.0, False) for i in range(3)]], "project_id string, pos int, duration double, audio double, source_start double, source_end double, score double, mismatch boolean")
    r = {x.project_id: x for x in A.coupling(c, total_seconds=100.0).collect()}
    assert r["a"].coupling == 100 and not r["a"].hard_fail and r["b"].hard_fail and r["b"].loops == 2
    rows = [("x", d, 95.0, True, False) for d in A.WEIGHTS] + [("y", d, 95.0, d != "identity", False) for d in A.WEIGHTS]
    g = {x.project_id: x for x in A.grade(spark.createDataFrame(rows, "project_id string, dimension string, score double, passed boolean, hard_fail boolean")).collect()}
    assert (g["x"].total, g["x"].grade, g["y"].grade) == (95.0, "S", "F")


def test_titles(spark):
    texts = spark.createDataFrame([("p", "《Night Train》", "the Night Train leaves and the Silver Key turns")], "project_id string, own_title string, text string")
    sig = spark.createDataFrame([("night_train", "Night Train"), ("Silver Key", "Silver Key")], "title string, signature string")
    assert [r.title for r in D.signature_contamination(texts, sig, ("project_id",)).collect()] == ["Silver Key"]


def test_costs_and_targets(spark):
    inv = spark.createDataFrame([("m", 1000, 500), ("unknown", 1_000_000, 0)], "model_name string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("m", 10, 40)], "model_name string, in_cents int, out_cents int")
    assert {r.model_name: r.cost_micros for r in T.with_cost(inv, rates).collect()} == {"m": 300, "unknown": 500_000}
    r = one(spark, L.target_minutes(F.lit(10.0), F.lit(0.2), F.lit(None).cast("double")).alias("a"), L.target_minutes(F.lit(None).cast("double"), F.lit(0.2), F.lit(None).cast("double")).alias("b"), L.next_state(F.lit("x"), ["x", "y"]).alias("n"), L.next_state(F.lit("y"), ["x", "y"]).alias("z"))
    assert (round(r.a.low, 2), round(r.a.high, 2)) == (1.7, 2.3) and tuple(r.b) == (25.0, 20.0, 30.0) and (r.n, r.z) == ("y", None)


def test_artifacts(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/project.json").write_text(json.dumps({"project_id": "a", "state": "RECEIVED"}))
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2/project.json").write_text("{broken")
    assert [r.project_id for r in artifacts.read_projects(spark, str(tmp_path), "received").collect()] == ["a"]
    (tmp_path / "scenes.json").write_text(json.dumps({"project_id": "a", "scenes": [{"start_seconds": 1.0}, {"scene_id": "x", "start_seconds": 2.0, "end_seconds": 5.0, "transcript_text": "t"}]}))
    rows = artifacts.read_scenes(spark, str(tmp_path / "scenes.json")).orderBy("pos").collect()
    assert [(r.scene_id, r.end_seconds, r.transcript_text, r.characters) for r in rows] == [("scene-0001", 2.0, "", []), ("x", 5.0, "t", [])]
    probe = spark.createDataFrame([("a", json.dumps({"format": {"duration": "600.0"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 10, "height": 5, "r_frame_rate": "30000/1001"}, {"codec_type": "audio", "codec_name": "aac"}]}))], "project_id string, j string").select("project_id", F.from_json("j", artifacts.PROBE).alias("p")).select("project_id", "p.*")
    r = artifacts.media_info(probe).first()
    assert (r.duration_seconds, r.video_codec, r.audio_tracks, round(r.frame_rate, 2), r.has_subtitles) == (600.0, "h264", 1, 29.97, False)
    (tmp_path / "in/film1").mkdir(parents=True)
    (tmp_path / "in/film1/a.mp4").write_bytes(b"x")
    assert artifacts.incoming(spark, str(tmp_path / "in")).count() == 1
    assert artifacts.fingerprints(spark, str(tmp_path / "in/film1/*.mp4")).first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_telemetry_source(spark, tmp_path):
    (tmp_path / "script.json").write_text(json.dumps({"project_id": "a", "telemetry": {"per_task": {"script_generation": {"input_tokens": 1000, "output_tokens": 200, "cost_usd": 0.001, "cache_hits": 1}}}}))
    (tmp_path / "story.json").write_text(json.dumps({"project_id": "a", "telemetry": {"per_task": {"story_synthesis": {"input_tokens": 500, "output_tokens": 100}}}}))
    rows = artifacts.read_telemetry(spark, {"script": str(tmp_path / "script.json"), "story": str(tmp_path / "story.json")}, {"script_generation": "big"}, "small").collect()
    assert sorted((r.task_name, r.input_tokens, r.cache_hit, r.model_name) for r in rows) == [("script_generation", 1000, True, "big"), ("story_synthesis", 500, False, "small")]


def test_dwell_rounds_halves_up(spark, tmp_path):
    """Half a millisecond is rounded up whatever the length: seconds as a double lie just below some halves."""
    from cuetrail import catalog

    gaps = [1057178526500, 1067363188500, 66368625500]
    rows, at = [(0, 7, 1_704_067_200_000_000)], 1_704_067_200_000_000
    for i, gap in enumerate(gaps, 1):
        at += gap
        rows.append((i, 7, at))
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint").selectExpr("event_id", "user_id", "'view' as event_type", "cast(timestamp_micros(us) as timestamp_ntz) as ts").write.parquet(str(tmp_path / "events.parquet"))
    got = [r.dwell_ms for r in catalog.QUERIES["state_dwell"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [(g + 500) // 1000 for g in gaps] + [None]


def test_groups_of_two_sides_stay_whole(spark):
    """Scenes and narrations that windows have dealt by project already: the sides shrink to different numbers of tasks, projects stay whole."""
    how = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        dealt = F.row_number().over(W.partitionBy("project_id").orderBy("pos")) - 1
        rows = spark.range(600).select((F.col("id") % 200).alias("project_id"), F.floor(F.col("id") / 200).alias("pos"))
        scenes = rows.withColumn("filler", F.repeat(F.sha2(F.col("project_id").cast("string"), 512), 10)).withColumn("scene_pos", dealt).select("project_id", "scene_pos", (F.col("scene_pos") * 100.0).alias("start_s"), F.array("filler").alias("tokens"))
        n = rows.withColumn("i", dealt).select("project_id", "pos", F.lit(5.0).alias("need"), (F.col("i") * 100.0).alias("anchor"), F.lit(None).cast("double").alias("proposed_start"), F.lit(None).cast("double").alias("proposed_end"))
        got = G.plan_clips(n, scenes, 300.0).collect()
        assert len(got) == 600 and all(r.scene_pos is not None for r in got)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
