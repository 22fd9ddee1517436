"""Subtitle files as cue rows, and caption files out of edit decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_narration
from ..functions.timecode import minutes_seconds, srt_time, to_seconds, vtt_time

CUES = "path string, pos int, cue_index int, start_s double, end_s double, text string"


#: Order of what a file holds: the split it was read in, the record of the split, the place in the record.
PLACE = ("split", "record", "part")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, PLACE, block: what blank lines part, with \\n as the only line end. Records end at a blank line, so a large file is read by many
    tasks; one with other line ends is a single record, parted afterwards."""
    records = spark.read.option("lineSep", "\n\n").text(path)
    placed = records.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("record"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return placed.select("path", "split", "record", F.posexplode(F.split("value", "\n\n")).alias("part", "block"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place in the file from 0: counts of whole splits are added up, rows are numbered inside theirs."""
    sizes = rows.groupBy("path", "split").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("path", "split", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("path", "split").orderBy(*order)) - 1
    return rows.withColumn("__at", inside).join(before, ["path", "split"]).withColumn("pos", (F.col("__before") + F.col("__at")).cast("int")).drop("__before", "__at")


def srt_blocks(pieces: DataFrame) -> DataFrame:
    """path, PLACE, block, good, cue_index, start_s, end_s, text of every block of SRT files that isn't blank. A good one has three lines or
    more, a number in the first and two times around an arrow in the second. White space before a file's first block doesn't count."""
    some = pieces.where(F.col("block").rlike(r"\S"))
    first = some.groupBy("path").agg(F.min(F.struct(*PLACE)).alias("first"))
    some = some.join(first, "path").withColumn("block", F.when(F.struct(*PLACE) == F.col("first"), F.regexp_replace("block", r"^\s+", "")).otherwise(F.col("block"))).drop("first")
    lines = some.withColumn("l", F.split("block", "\n"))
    times = F.split(F.get("l", F.lit(1)), " --> ")
    text = F.array_join(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), "\n")
    d = lines.select(
        "path", *PLACE, "block", F.size("l").alias("n"), F.trim(F.get("l", F.lit(0))).try_cast("int").alias("cue_index"), F.size(times).alias("nt"),
        to_seconds(F.get(times, F.lit(0))).alias("start_s"), to_seconds(F.get(times, F.lit(1))).alias("end_s"), F.regexp_replace(text, r"^\s+|\s+\z", "").alias("text"),
    )
    good = (F.col("n") >= 3) & F.col("cue_index").isNotNull() & (F.col("nt") == 2) & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    return d.withColumn("good", F.coalesce(good, F.lit(False)))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files: path, pos, cue_index, start_s, end_s, text; bad blocks are left out (rejected_srt has them)."""
    return _numbered(srt_blocks(_pieces(spark, path)).where("good"), "record", "part").select("path", "pos", "cue_index", "start_s", "end_s", "text")


def rejected_srt(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the blocks that read_srt leaves out."""
    return srt_blocks(_pieces(spark, path)).where("not good").select("path", F.col("block").alias("text"))


def _vtt_cues(spark: SparkSession, path: str) -> DataFrame:
    """path, PLACE, cue (in the piece), line, start_s, end_s, text. A cue never reaches over a blank line, so each piece is read by itself."""
    piece = ["path", *PLACE]
    lines = _pieces(spark, path).select(*piece, F.posexplode(F.split("block", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    w = W.partitionBy(*piece).orderBy("n")
    timed = F.contains("line", F.lit("-->"))
    stop = (F.col("line") == "") | F.startswith("line", F.lit("WEBVTT")) | F.startswith("line", F.lit("NOTE"))
    marked = lines.withColumns({"cue": F.sum(timed.cast("int")).over(w), "ended": F.sum((timed | stop).cast("int")).over(w), "timed": timed, "stop": stop})
    own = F.when(~F.col("timed") & ~F.col("stop"), F.struct("n", "line", "ended"))
    begins = F.max(F.when(F.col("timed"), F.struct("line", "ended"))).alias("time")
    cues = marked.where("cue > 0").groupBy(*piece, "cue").agg(begins, F.array_sort(F.collect_list(own)).alias("lines"))
    body = F.filter("lines", lambda x: x["ended"] == F.col("time.ended"))  # lines up to the first stop
    t = F.split("time.line", "-->")
    end = F.regexp_extract(F.trim(F.get(t, F.lit(1))), r"^\S+", 0)
    return cues.select(*piece, "cue", F.col("time.line").alias("line"), to_seconds(F.get(t, F.lit(0))).alias("start_s"), to_seconds(end).alias("end_s"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"))


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of WebVTT files, as read_srt's. A blank line, the header or a NOTE ends a cue; what follows the end time is dropped; cues without
    a line have an empty text; they are numbered from 1. Cues without two times are left out (rejected_vtt has them)."""
    good = _numbered(_vtt_cues(spark, path).where("start_s is not null and end_s is not null"), "record", "part", "cue")
    return good.select("path", "pos", (F.col("pos") + 1).alias("cue_index"), "start_s", "end_s", "text")


def rejected_vtt(spark: SparkSession, path: str) -> DataFrame:
    """path, text (the line of the times) of the cues that read_vtt leaves out."""
    return _vtt_cues(spark, path).where("start_s is null or end_s is null").select("path", F.col("line").alias("text"))


def _listed(decisions: DataFrame, line: Column, between: str, keys) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return decisions.groupBy(*keys).agg(F.array_join(lines, between).alias("value"))


def captions(decisions: DataFrame, kind: str = "srt", keys=("project_id",)) -> DataFrame:
    """keys, value: the SRT, VTT or chapter text of each project's edit decisions (keys, pos, timeline_start, timeline_end, text).

    Chapters have a line each: the first at 00:00, then MM:SS, with the first 12 characters of the cleaned text.
    """
    text = clean_narration(F.trim("text"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("pos"))
    d = decisions.withColumn("__n", number)
    if kind == "chapters":
        short = F.trim(F.substring(text, 1, 12))
        at = F.when(F.col("__n") == 1, F.lit("00:00")).otherwise(minutes_seconds(F.col("timeline_start")))
        return _listed(d, F.concat(at, F.lit(" "), F.when(short == "", F.lit("...")).otherwise(short)), "\n", keys)
    clock = srt_time if kind == "srt" else vtt_time
    line = F.concat(F.col("__n").cast("string"), F.lit("\n"), clock(F.col("timeline_start")), F.lit(" --> "), clock(F.col("timeline_end")), F.lit("\n"), text, F.lit("\n"))
    out = _listed(d, line, "\n", keys)
    return out if kind == "srt" else out.withColumn("value", F.concat(F.lit("WEBVTT\n\n"), "value"))


def write_captions(decisions: DataFrame, path: str, kind: str = "srt", key: str = "project_id") -> None:
    """One text file or more under a folder of each project."""
    captions(decisions, kind, (key,)).select(key, "value").write.mode("overwrite").partitionBy(key).text(path)
