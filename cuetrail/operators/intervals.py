"""Range filters, and interval, nearest and fallback joins within a key (one film, one transcript)."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("project_id",)
#: Seconds of the stretches to which the joins of one film are dealt.
STRETCH = 60.0


def overlapping(df: DataFrame, low, high, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows whose interval shares more than a point with (low, high)."""
    return df.where((F.col(start) < high) & (F.col(end) > low))


def starting_in(df: DataFrame, low, high, start: str = "start_s") -> DataFrame:
    """Rows that start between low and high, both included."""
    return df.where(F.col(start).between(low, high))


def contains_text(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle in any case; an empty needle matches all rows but null texts."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(needle))))


def member_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows of whose array an element holds the needle in any case."""
    return df.where(F.exists(column, lambda x: F.contains(F.lower(x), F.lower(F.lit(needle)))))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.size(column) > 0)


def first_row(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first matching row, if any."""
    return df.where(condition).orderBy(order).limit(1)


def interval_join(left: DataFrame, right: DataFrame, keys=KEYS, bucket_seconds: float | None = None, inclusive: bool = False) -> DataFrame:
    """Pairs of left (s, e, ...) and right (s2, e2, ...) whose intervals overlap, inclusive of touching ends if asked.

    Without buckets an equi-join on the keys with the range as residue. With buckets both sides are dealt to the stretches of time that
    they reach, for keys with very many rows; a pair is kept only in the stretch in which its overlap starts.
    """
    hit = (F.col("s") <= F.col("e2")) & (F.col("e") >= F.col("s2")) if inclusive else (F.col("s") < F.col("e2")) & (F.col("e") > F.col("s2"))
    if not bucket_seconds:
        return left.join(right, list(keys)).where(hit)
    deal = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket_seconds), F.floor(F.greatest(s, e) / bucket_seconds)))
    a, b = left.withColumn("__b", deal("s", "e")), right.withColumn("__b", deal("s2", "e2"))
    return a.join(b, [*keys, "__b"]).where(hit & (F.col("__b") == F.floor(F.greatest("s", "s2") / bucket_seconds))).drop("__b")


def attach_cues(scenes: DataFrame, cues: DataFrame, rule: str = "overlap", keys=KEYS, bucket_seconds: float | None = None) -> DataFrame:
    """keys, scene_pos, text, cues: the texts of a scene's cues joined by spaces in cue order, "" and 0 where there is none.

    scenes: keys, scene_pos, s, e; cues: keys, cue_pos, s2, e2, text. rule overlap: strict overlap. rule midpoint: the cue's start or middle
    lies in [s, e), or the cue covers the scene and is no longer than 20 s; a cue may belong to several scenes.
    """
    if rule == "overlap":
        pairs = interval_join(scenes, cues, keys, bucket_seconds)
    else:
        mid = (F.col("s2") + F.col("e2")) / 2
        inside = lambda t: (t >= F.col("s")) & (t < F.col("e"))
        covers = (F.col("s2") <= F.col("s")) & (F.col("e2") >= F.col("e")) & (F.col("e2") - F.col("s2") <= 20)
        pairs = interval_join(scenes, cues, keys, bucket_seconds, inclusive=True).where(inside(F.col("s2")) | inside(mid) | covers)
    cue = F.struct("cue_pos", "text").alias("cue")
    none = scenes.select(*keys, "scene_pos", F.lit(None).cast(pairs.select(cue).schema["cue"].dataType).alias("cue"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("cue")), lambda x: x["text"]), " ")  # of no cue: ""
    return pairs.select(*keys, "scene_pos", cue).unionByName(none).groupBy(*keys, "scene_pos").agg(listed.alias("text"), F.count("cue").alias("cues"))


def clip_texts(clips: DataFrame, cues: DataFrame, scenes: DataFrame, keys=KEYS, bucket_seconds: float | None = STRETCH) -> DataFrame:
    """keys, clip_pos, text: the distinct non-blank cue texts under a clip in the order in which they first come, else the transcripts of
    the scenes under it. clips: keys, clip_pos, s, e; scenes: keys, scene_pos, s2, e2, transcript."""
    def ordered(pairs, pos, text):
        listed = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text])
        return pairs.where(F.trim(F.col(text)) != "").groupBy(*keys, "clip_pos").agg(F.array_join(F.array_distinct(listed), " ").alias(f"by_{text}"))

    by_cue = ordered(interval_join(clips, cues, keys, bucket_seconds), "cue_pos", "text")
    by_scene = ordered(interval_join(clips, scenes, keys, bucket_seconds), "scene_pos", "transcript")
    return clips.join(by_cue, [*keys, "clip_pos"], "left").join(by_scene, [*keys, "clip_pos"], "left").select(*keys, "clip_pos", F.coalesce("by_text", "by_transcript", F.lit("")).alias("text"))


#: Kinds of rows on the line of time of a stretch: the nearest starts in other stretches, before and after it, then scenes and points.
BEFORE, AFTER, SCENE, POINT = range(-2, 2)


def _carried(marks: DataFrame, keys) -> DataFrame:
    """keys, __b, kind, at, scene_pos: for each stretch of the marks (keys, __b, at, scene_pos; without scene_pos where there are points only)
    the last start in the stretches before it (BEFORE) and the first one in those after it (AFTER), if any."""
    start = lambda pos: F.when(F.col("scene_pos").isNotNull(), F.struct("at", pos.alias("pos")))
    whole = marks.groupBy(*keys, "__b").agg(F.max(start(-F.col("scene_pos"))).alias("last"), F.min(start(F.col("scene_pos"))).alias("next"))
    earlier, later = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("__b", F.desc("__b")))
    met = whole.select(*keys, "__b", F.max("last").over(earlier).alias("last"), F.min("next").over(later).alias("next")).where("last is not null or next is not null")
    sides = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c)["at"].alias("at"), (sign * F.col(c)["pos"]).cast(marks.schema["scene_pos"].dataType).alias("scene_pos")) for kind, c, sign in ((BEFORE, "last", -1), (AFTER, "next", 1))))
    return met.select(*keys, "__b", F.inline(sides)).where("at is not null")


def _swept(line: DataFrame, keys) -> DataFrame:
    """keys, point_id, scene_pos of the points of the line (keys, __b, at, kind, e, scene_pos, point_id; of carried starts, the time is e). One
    pass over each sorted stretch keeps the scenes that are open, the least scene_pos on top (one that has ended goes when it comes to the
    top), the last start, and the points that no scene holds until the next start."""
    names = [*keys, "point_id", "scene_pos"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in line.select(*names).schema)
    dealt = line.repartition(*keys, "__b").sortWithinPartitions(*keys, "__b", "at", "kind", "scene_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, last, ahead, opened, open_points, types = None, None, None, [], [], None

        def settled(following: tuple | None) -> list[tuple]:
            near = []
            for t, point in open_points:
                sides = [(abs(c[0] - t), c[1]) for c in (last, following) if c is not None]
                if sides:
                    near.append((*stretch[:-1], point, min(sides)[1]))
            open_points.clear()
            return near

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

        for b in batches:
            types, found = [b.schema.field(c).type for c in names], []
            columns = [b.column(c).to_pylist() for c in ("at", "kind", "e", "scene_pos", "point_id")]
            for own, at, kind, end, pos, point in zip(zip(*(b.column(k).to_pylist() for k in (*keys, "__b")), strict=True), *columns, strict=True):
                if own != stretch:
                    found += settled(ahead)
                    stretch, last, ahead, opened = own, None, None, []
                if kind == SCENE:
                    if open_points:
                        found += settled((at, pos))
                    if last is None or at > last[0]:
                        last = (at, pos)
                    if end is not None and end >= at:
                        heappush(opened, (pos, end))
                elif kind == POINT:
                    while opened and opened[0][1] < at:
                        heappop(opened)
                    if opened:
                        found.append((*own[:-1], point, opened[0][0]))
                    else:
                        open_points.append((at, point))
                elif kind == BEFORE:
                    last = (end, pos)
                else:
                    ahead = (end, pos)
            if found:
                yield batch(found)
        found = settled(ahead)
        if found:
            yield batch(found)

    return dealt.mapInArrow(run, schema)


def nearest_scene(points: DataFrame, scenes: DataFrame, keys=KEYS, bucket_seconds: float = 3600.0) -> DataFrame:
    """keys, point_id, scene_pos: the first scene, by scene_pos, that holds the time t (ends included), else the one that starts nearest
    (ties: the lesser scene_pos). points: keys, point_id, t; scenes: keys, scene_pos (a number), s, e.

    A merge of both lines of time in work proportional to their rows and the stretches that scenes reach: both are dealt to stretches and
    sorted once and swept in one pass; only the starts next to a stretch come from a scan over whole stretches. Scenes may overlap and come in
    any order. Points without a time, a film or scenes in it have no row; a scene without a start is left out, one without an end holds
    nothing.
    """
    stretch = lambda c: F.floor(c / bucket_seconds)
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    s, t, e = F.col("s").cast("double"), F.col("t").cast("double"), F.col("e").cast("double")
    no_end, no_point = F.lit(None).cast("double").alias("e"), none("point_id", points)
    scenes, points = scenes.where("s is not null").dropna(subset=list(keys)), points.where("t is not null").dropna(subset=list(keys))
    reach = F.explode(F.sequence(stretch(s), stretch(F.greatest(s, e)))).alias("__b")  # of no end: its start
    held = scenes.select(*keys, reach, s.alias("at"), F.lit(SCENE).alias("kind"), e.alias("e"), "scene_pos", no_point)
    asked = points.select(*keys, stretch(t).alias("__b"), t.alias("at"), F.lit(POINT).alias("kind"), no_end, none("scene_pos", scenes), "point_id")
    marks = scenes.select(*keys, stretch(s).alias("__b"), s.alias("at"), "scene_pos").unionByName(asked.select(*keys, "__b", "at", "scene_pos"))
    carried = _carried(marks, keys).select(*keys, "__b", F.lit(float("-inf")).alias("at"), "kind", F.col("at").alias("e"), "scene_pos", no_point)
    return _swept(held.unionByName(asked).unionByName(carried), keys)


def refs_with_names(refs: DataFrame, scenes: DataFrame, names: DataFrame, keys=KEYS, bucket_seconds: float | None = STRETCH) -> DataFrame:
    """keys, seg_pos, name, present: whether a scene that touches the segment's reference (ends included) names the name of its text.
    refs: keys, seg_pos, s, e; names: keys, seg_pos, name; scenes: keys, scene_pos, s2, e2, transcript."""
    pairs = interval_join(refs, scenes, keys, bucket_seconds, inclusive=True).join(names, [*keys, "seg_pos"])
    return pairs.groupBy(*keys, "seg_pos", "name").agg(F.bool_or(F.contains("transcript", F.col("name"))).alias("present"))


def by_id_or_position(segments: DataFrame, decisions: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """segments with the decision's value: of the first decision with the segment's id, else of the decision at its position."""
    by_id = decisions.groupBy(*keys, "segment_id").agg(F.min_by(value, "pos").alias("__a"))
    by_pos = decisions.groupBy(*keys, "pos").agg(F.min(value).alias("__b"))
    return segments.join(by_id, [*keys, "segment_id"], "left").join(by_pos, [*keys, "pos"], "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
