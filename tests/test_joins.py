"""Joins on one long film and large dictionaries, against brute force; their work must stay in proportion to the rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuetrail.operators import dictionary as D
from cuetrail.operators import intervals as I


def nearest(t, scenes):
    """scene_pos by the definition."""
    holding = [p for p, s, e in scenes if e is not None and s <= t <= e]
    return min(holding) if holding else min((abs(s - t), p) for p, s, _ in scenes)[1]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_scene_equals_brute_force(spark, seed):
    """Scenes overlap, come in any order, start at one time, have no end or end before they start; points lie on borders."""
    rng = random.Random(seed)
    scenes, points = [], []
    for film in (1, 2, None):
        starts = [rng.choice([rng.randrange(0, 60), rng.uniform(0, 60)]) for _ in range(25)]
        ends = [rng.choice([None, s - 1, s, s + rng.randrange(1, 5), s + rng.uniform(0, 40)]) for s in starts]
        scenes += [(film, p, float(s), None if e is None else float(e)) for p, (s, e) in enumerate(zip(starts, ends, strict=True))]
        points += [(film, i, float(rng.choice([rng.randrange(-5, 70), rng.uniform(-5, 70)]))) for i in range(60)]
    points += [(3, 0, 1.0), (1, 999, None)]
    sc = spark.createDataFrame([*scenes, (1, 77, None, 5.0)], "project_id int, scene_pos int, s double, e double")
    pt = spark.createDataFrame(points, "project_id int, point_id int, t double")
    for stretch in (7.0, 3600.0):
        got = {(r.project_id, r.point_id): r.scene_pos for r in I.nearest_scene(pt, sc, bucket_seconds=stretch).collect()}
        want = {(f, i): nearest(t, [x[1:] for x in scenes if x[0] == f]) for f, i, t in points if f in (1, 2) and t is not None}
        assert got == want
    assert I.nearest_scene(pt, sc.limit(0)).count() == 0 and I.nearest_scene(pt.limit(0), sc).count() == 0


def test_nearest_scene_deals_its_rows_once(spark):
    """One shuffle of the rows, and those of what is carried between stretches; rows aren't joined with it."""
    scenes = spark.range(100).selectExpr("id % 3 as project_id", "cast(id as int) as scene_pos", "id * 2.0D as s", "id * 2.0D + 1 as e")
    points = spark.range(100).selectExpr("id % 3 as project_id", "id as point_id", "id * 1.5D as t")
    plan = I.nearest_scene(points, scenes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan


def test_searches_leave_the_texts_behind(spark):
    """Python hands back keys and terms, not a copy of the text for each term found; what is found doesn't depend on slices."""
    texts = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, concat(repeat('x', 5000), if(id % 2 = 0, 'ab', 'b'))) as text").coalesce(1)
    cues = spark.createDataFrame([("p", "ab"), ("p", "b"), ("q", "x"), ("q", "none")], "concept string, cue string")
    found = D.hits(texts, cues, ("id",))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert all("text" not in line.split("MapInArrow", 1)[1].split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "MapInArrow" in line)
    want = {(i, c, n) for i in range(3000) if i % 7 for c, n in (("p", 2 if i % 2 == 0 else 1), ("q", 1))}
    assert {tuple(r) for r in found.collect()} == want


def test_one_long_film(spark):
    """100,000 points and scenes of one film: all pairs would be ten thousand million rows."""
    n = 100_000
    scenes = spark.range(n).select(F.lit(1).alias("project_id"), F.col("id").cast("int").alias("scene_pos"), (F.col("id") * 2.0).alias("s"), (F.col("id") * 2.0 + 1).alias("e"))
    points = spark.range(n).select(F.lit(1).alias("project_id"), F.col("id").alias("point_id"), (F.col("id") * 2.0 + (F.col("id") % 3) * 0.9).alias("t"))
    wrong = I.nearest_scene(points, scenes).where(F.col("scene_pos") != F.col("point_id") + (F.col("point_id") % 3 == 2).cast("int"))
    assert wrong.where("point_id < 99999").count() == 0
    clips = scenes.select("project_id", F.col("scene_pos").alias("clip_pos"), "s", "e")
    cues = scenes.select("project_id", F.col("scene_pos").alias("cue_pos"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("scene_pos").cast("string").alias("text"))
    spoken = scenes.select("project_id", "scene_pos", F.col("s").alias("s2"), F.col("e").alias("e2"), F.lit("x").alias("transcript"))
    assert I.clip_texts(clips, cues, spoken).where("text = cast(clip_pos as string)").count() == n
    refs, names = clips.withColumnRenamed("clip_pos", "seg_pos"), scenes.select("project_id", F.col("scene_pos").alias("seg_pos"), F.lit("x").alias("name"))
    assert I.refs_with_names(refs, spoken, names).where("present").count() == n


def test_contained_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    terms = [("".join(rng.choice("ab é") for _ in range(rng.randrange(0, 4))), i % 2) for i in range(60)] + [(None, 0), ("ab", 0), ("ab", 0), ("ab", 1), ("a.b", 1), ("😀", 0)]
    texts = [(i, "".join(rng.choice("abé .😀") for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(3, "ab"), (3, "ab"), (None, "ab"), (4, None), (5, "")]
    te, tx = spark.createDataFrame(terms, "cue string, concept int"), spark.createDataFrame(texts, "id int, text string")
    want = sorted((str(i), t, c, k) for i, t in texts if t is not None for c, k in set(terms) if c is not None and c in t)
    for most in (200_000, 7):  # one automaton, and blocks
        monkeypatch.setattr(D, "BLOCK_TERMS", most)
        got = sorted((str(r.id), r.text, r.cue, r.concept) for r in D.contained(tx, te, ("id",), "cue").collect())
        assert got == want
    assert D.contained(tx, te.limit(0), ("id",), "cue").count() == 0
    assert D.contained(tx.limit(0), te, ("id",), "cue").columns == ["id", "text", "cue", "concept"]


def test_many_terms_are_one_pass(spark):
    """50,000 terms without a word inside them: a row only for what is found, and no join of texts with terms."""
    terms = spark.range(50_000).select(F.concat(F.lit("t"), "id", F.lit("z")).alias("cue"), F.lit(1).alias("concept"))
    texts = spark.range(2000).select("id", F.concat(F.lit("x t"), "id", F.lit("z t"), F.col("id") + 60_000, F.lit("z")).alias("text"))
    found = D.contained(texts, terms, ("id",), "cue")
    assert found.count() == 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("name", "most"), [("sequence_rollup", 20), ("clip_cues_fallback", 13), ("clip_audit", 30), ("clip_findings", 30)])
def test_texts_are_dealt_no_oftener_than_needed(spark, name, most):
    """Time lines of documents, scenes without cues and repeated texts under a clip take no exchange of their own."""
    from cuetrail import catalog

    how = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= most
