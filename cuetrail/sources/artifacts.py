"""JSON artifacts of projects as tables, and files as rows.

Many small files may lie in a pack: a Parquet table with a row a file (PACK). Readers with `packed` take a pack's folder in place of the root;
its paths end as those of the files would, and nothing is listed or opened for each of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = "scene_id string, start_seconds double, end_seconds double, duration_seconds double, transcript_text string, keyframe_paths array<string>, visual_description string, characters array<string>, location string, actions array<string>, emotional_tone string, sensitivity_labels array<string>"
CHUNK = "chunk_id string, start_seconds double, end_seconds double, text string, word_count bigint, source_entries bigint"
PROJECT = "project_id string, title string, state string, source_hash string, source_language string, target_language string, created_at string, updated_at string, cost_usd double, error_info string"
JOB = "slug string, movie_title string, duration_s double, enqueued_at string, custom_target_duration double, duration_ratio double"
TELEMETRY = "project_id string, telemetry struct<per_task:map<string,struct<input_tokens:bigint,output_tokens:bigint,cost_usd:double,cache_hits:bigint>>>"
MEDIA_SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm", "m4v")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in ddl.split(", ")))


CORRUPT = "_corrupt_record"
PACK = "path string, length bigint, content binary"


def pack(files: DataFrame, path: str) -> None:
    """Adds files (path, content) to a pack."""
    files.select("path", F.octet_length("content").cast("bigint").alias("length"), "content").write.mode("append").parquet(path)


def _matches(path: Column, glob: str) -> Column:
    """Whether the last steps of a path are those of a glob with *, ? and {a,b}."""
    words = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    return path.rlike(f"(?s)(^|/){''.join(words.get(c) or re.escape(c) for c in glob)}\\z")


def _files(spark: SparkSession, root: str, glob: str, packed: bool = False) -> DataFrame:
    """path, length, content of the files under root."""
    if packed:
        return spark.read.schema(PACK).parquet(root).where(_matches(F.col("path"), glob))
    return spark.read.format("binaryFile").load(f"{root}/{glob}")


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """JSON of a schema, an object a file or (lines) a line, with CORRUPT, the text of what can't be read so. Large files of lines split."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=not lines)


def _objects(spark: SparkSession, root: str, glob: str, schema: str, packed: bool) -> DataFrame:
    """path, the fields of a schema and CORRUPT of the files under root, an object each."""
    if not packed:
        return _json(spark, f"{root}/{glob}", schema, lines=False).select(F.col("_metadata.file_path").alias("path"), "*")
    read = F.from_json(F.col("content").cast("string"), f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return _files(spark, root, glob, packed).select("path", read.alias("j")).where("j is not null").select("path", "j.*")


def quarantine(spark: SparkSession, path: str, schema: str, lines: bool = False, packed: bool = False) -> DataFrame:
    """path, record: files, or lines, that aren't JSON of the schema, for the side table of what readers leave out. path: a glob, or a pack."""
    if packed:
        return _objects(spark, path, "*", schema, packed).select("path", F.col(CORRUPT).alias("record")).where("record is not null")
    first = schema.split(" ", 1)[0]
    # the reader refuses to read CORRUPT alone, so nothing of another column is added to it
    record = F.concat(CORRUPT, F.coalesce(F.left(F.col(first).cast("string"), F.lit(0)), F.lit("")))
    return _json(spark, path, schema, lines).select(F.col("_metadata.file_path").alias("path"), record.alias("record")).where("record is not null")


def read_scenes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scenes of scene indexes (one JSON object a file, or a line, as write_scenes has them): project_id, pos and the scene's fields; missing
    texts are "", lists empty, ends a second after the start. Indexes that can't be read are left out."""
    schema = f"project_id string, duration_seconds double, scenes array<struct<{_fields(SCENE)}>>"
    rows = _json(spark, path, schema, lines).where(F.col(CORRUPT).isNull()).select(F.coalesce("project_id", F.col("_metadata.file_path")).alias("project_id"), F.posexplode("scenes").alias("pos", "s")).select("project_id", "pos", "s.*")
    start = F.coalesce("start_seconds", F.lit(0.0))
    end = F.coalesce("end_seconds", start + 1.0)
    texts = {c: F.coalesce(c, F.lit("")) for c in ("transcript_text", "visual_description", "location", "emotional_tone")}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keyframe_paths", "characters", "actions", "sensitivity_labels")}
    return rows.withColumns({"scene_id": F.coalesce("scene_id", F.format_string("scene-%04d", F.col("pos") + 1)), "duration_seconds": F.coalesce("duration_seconds", end - start), "end_seconds": end, "start_seconds": start, **texts, **lists})


def write_scenes(scenes: DataFrame, path: str) -> None:
    """One JSON object a project, its scenes in order."""
    fields = [c for c in scenes.columns if c not in ("project_id", "pos")]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))), lambda x: x["s"])
    scenes.groupBy("project_id").agg(listed.alias("scenes")).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Transcript chunks (a JSON array a file, or a chunk a line), with the file they come from. What can't be read is left out."""
    rows = _json(spark, path, CHUNK, lines).where(F.col(CORRUPT).isNull())
    return rows.select(F.col("_metadata.file_path").alias("path"), "*").drop(CORRUPT)


def write_table(df: DataFrame, path: str, *partition_by: str, form: str = "parquet") -> None:
    """Ledgers, profiles, reports and chunks as Parquet or JSON."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_telemetry(spark: SparkSession, paths: dict[str, str], model_of: dict[str, str], default_model: str, lines: bool = False) -> DataFrame:
    """project_id, artifact, task_name, model_name, tokens, cost_usd, cache_hit: a row for each task of the `telemetry.per_task` maps of
    several kinds of artifact (kind: path), an object a file or (lines) a line; the model follows from the task."""
    model = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in model_of.items() for x in kv)), F.col("task_name")), F.lit(default_model)) if model_of else F.lit(default_model)
    out = None
    for kind, path in paths.items():
        rows = spark.read.schema(TELEMETRY).json(path, multiLine=not lines).select("project_id", F.lit(kind).alias("artifact"), F.explode("telemetry.per_task").alias("task_name", "t"))
        rows = rows.select("project_id", "artifact", "task_name", F.coalesce("t.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("t.output_tokens", F.lit(0)).alias("output_tokens"), F.coalesce("t.cost_usd", F.lit(0.0)).alias("cost_usd"), (F.coalesce("t.cache_hits", F.lit(0)) > 0).alias("cache_hit"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("model_name", model)


def read_projects(spark: SparkSession, root: str, state: str | None = None, name: str = "project.json", packed: bool = False) -> DataFrame:
    """Projects, one file `name` a folder; unreadable files are left out (quarantine has them); states in lower case."""
    rows = _objects(spark, root, f"*/{name}", PROJECT, packed).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "path")
    rows = rows.where("project_id is not null").withColumn("state", F.lower("state"))
    return rows.where(F.col("state") == state.lower()) if state else rows


def read_jobs(spark: SparkSession, root: str, job: str = "job.json", metadata: str = r"metadata\.json", packed: bool = False) -> DataFrame:
    """Jobs under root/<status>/<slug>/: job.json, what it lacks from metadata.json, else the folder's name; status is the folder's.
    `job` is the glob of the first kind of file, `metadata` the pattern of the second's names, which end in .json."""
    of = lambda n: F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", n)
    jobs = _objects(spark, root, f"*/*/{job}", JOB, packed).select(of(1).alias("status"), of(2).alias("folder"), "*")
    meta = _objects(spark, root, "*/*/*.json", "title string, duration double", packed).where(F.regexp_extract("path", r"([^/]+)$", 1).rlike(f"^({metadata})$"))
    meta = meta.select(of(1).alias("status"), of(2).alias("folder"), "title", "duration")
    return jobs.join(meta, ["status", "folder"], "full").select(F.coalesce("slug", "folder").alias("slug"), "status", F.coalesce("movie_title", "title", "folder").alias("movie_title"), F.coalesce("duration_s", "duration").alias("duration_s"), "enqueued_at", "custom_target_duration", "duration_ratio")


def incoming(spark: SparkSession, root: str, marker: str = ".ingested", suffixes: tuple[str, ...] = MEDIA_SUFFIXES, packed: bool = False) -> DataFrame:
    """folder, path, length of media files in folders under root that hold no marker file. Contents aren't read."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")
    found = _files(spark, root, "*/*", packed).select("path", "length", folder)
    media = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    marks = f"*/{{{marker},_{marker.lstrip('.')}}}"
    done = _files(spark, root, marks, packed).select(folder) if packed or _exists(spark, f"{root}/{marks}") else None
    return media if done is None else media.join(done, "folder", "left_anti")


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def fingerprints(spark: SparkSession, glob: str, packed: bool = False) -> DataFrame:
    """path, length, sha256 of files under 2 GB. glob: of files, or a pack."""
    found = _files(spark, glob, "*", packed) if packed else spark.read.format("binaryFile").load(glob)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


PROBE = "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>"


def media_info(probes: DataFrame) -> DataFrame:
    """project_id and duration_seconds, width, height, frame_rate, video_codec, audio_codec, audio_tracks, has_subtitles of probe rows
    (project_id and the columns of PROBE); the first stream of a kind counts."""
    of = lambda kind: F.filter("streams", lambda s: s["codec_type"] == kind)
    v, a = F.get(of("video"), F.lit(0)), F.get(of("audio"), F.lit(0))
    rate = F.split(v["r_frame_rate"], "/")
    fps = F.coalesce(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))), F.lit(0.0))
    return probes.select("project_id", F.coalesce(F.col("format.duration").try_cast("double"), F.lit(0.0)).alias("duration_seconds"), F.coalesce(v["width"], F.lit(0)).alias("width"), F.coalesce(v["height"], F.lit(0)).alias("height"), fps.alias("frame_rate"), F.coalesce(v["codec_name"], F.lit("unknown")).alias("video_codec"), F.coalesce(a["codec_name"], F.lit("none")).alias("audio_codec"), F.size(of("audio")).alias("audio_tracks"), (F.size(of("subtitle")) > 0).alias("has_subtitles"))


def summary_line(title: Column, genre: Column, year: Column, directors: Column, stars: Column, synopsis: Column) -> Column:
    """One dense line of the fields that are there."""
    some = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    one = F.regexp_replace(F.regexp_replace(synopsis, r"(?U)\s+", " "), r"^ | \z", "")
    return F.concat_ws(" | ", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), some("Genre", genre), some("Year", year), some("Director", F.array_join(directors, ", ")), some("Cast", F.array_join(stars, ", ")), some("Synopsis", one))
