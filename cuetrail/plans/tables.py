"""The given tables as the engine's tables, in Spark and as common table expressions of the SQL beside it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.timecode import speech_seconds
from ..operators.continuity import timeline
from ..operators.telemetry import with_cost

#: A rate card: cents for a million tokens, in and out. The sixth model is on no card.
RATES = [("model-0", 10, 40), ("model-1", 125, 1000), ("model-2", 15, 60), ("model-3", 250, 1000), ("model-4", 300, 1500)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(F.col("user_id").alias("project_id"), F.col("event_type").alias("task_name"), F.concat(F.lit("model-"), (F.col("k") % 6).cast("string")).alias("model_name"), (F.col("k") * 100).alias("input_tokens"), (F.col("k") * 7).alias("output_tokens"), (F.col("k") % 5 == 0).alias("cache_hit"), (F.col("k") * 13).alias("latency_ms"), "ts", "event_id")


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame(RATES, "model_name string, in_cents int, out_cents int")
    return with_cost(invocations(spark, sf_dir), rates)


_RATE_ROWS = ", ".join(f"('{m}', {a}, {b})" for m, a, b in RATES)
COSTED = f"""rates(model_name, in_cents, out_cents) as (values {_RATE_ROWS}),
ev as (select *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) as k from events),
inv as (select user_id as project_id, event_type as task_name, 'model-' || CAST(k % 6 AS VARCHAR) as model_name, k * 100 as input_tokens,
  k * 7 as output_tokens, k % 5 = 0 as cache_hit, k * 13 as latency_ms, ts, event_id from ev),
costed as (select inv.*, CAST((input_tokens * coalesce(in_cents, 50) + output_tokens * coalesce(out_cents, 200) + 50) // 100 AS BIGINT) as cost_micros
  from inv left join rates using (model_name))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as narration segments."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("pos"), F.concat(F.lit("seg-"), F.col("turn").cast("string")).alias("segment_id"), F.when(F.col("role") == "system", "hook").when(F.col("role") == "user", "commentary").otherwise("plot").alias("segment_type"), "text", speech_seconds(F.col("text")).alias("duration"))


SEGMENTS = """segs as (select conv_id as project_id, turn as pos, 'seg-' || CAST(turn AS VARCHAR) as segment_id,
  case role when 'system' then 'hook' when 'user' then 'commentary' else 'plot' end as segment_type, text,
  greatest(2.0::DOUBLE, CAST(length(text) AS DOUBLE) / 4.0::DOUBLE) as duration from conversations)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cues on a timeline."""
    return timeline(segments(spark, sf_dir))


CUES = SEGMENTS + """,
cues as (select *, start_s + duration as end_s from (select *, coalesce(sum(duration) over (partition by project_id order by pos
  rows between unbounded preceding and 1 preceding), 0.0::DOUBLE) as start_s from segs where trim(text) <> ''))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as cues on a timeline: project_id, pos, text, start_s, end_s."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.split("text", "\n").alias("texts"))
    spoken = d.select("project_id", F.filter(F.transform("texts", lambda x, i: F.struct(i.alias("pos"), x.alias("text"), speech_seconds(x).alias("duration"))), lambda x: F.trim(x["text"]) != "").alias("x"))
    # a document is one row, so its time line needs no window
    timed = spoken.select("project_id", F.inline(F.arrays_zip("x", _starts(F.col("x.duration")).alias("start_s"))))
    return timed.select("project_id", "x.pos", "x.text", "x.duration", "start_s", (F.col("start_s") + F.col("x.duration")).alias("end_s"))


@F.arrow_udf(ArrayType(DoubleType()))
def _starts(durations: pa.Array) -> pa.Array:
    """The sums of the durations before each one of a list. They are whole quarters of a second, so sums over a batch are exact."""
    of, values = durations.offsets.to_numpy(), durations.values.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0.0], np.cumsum(values)])
    starts = before[:-1]
    starts = starts[of[0]:of[-1]] - np.repeat(before[of[:-1]], np.diff(of))
    return pa.ListArray.from_arrays(pa.array(of - of[0], pa.int32()), pa.array(starts, pa.float64()))


LINES = """doclines as (select doc_id as project_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) as pos, unnest(string_split(text, chr(10))) as text from documents),
timed as (select *, greatest(2.0::DOUBLE, CAST(length(text) AS DOUBLE) / 4.0::DOUBLE) as duration from doclines where trim(text) <> ''),
lines as (select *, start_s + duration as end_s from (select *, coalesce(sum(duration) over (partition by project_id order by pos
  rows between unbounded preceding and 1 preceding), 0.0::DOUBLE) as start_s from timed))"""


def grid(cue_rows: DataFrame, seconds: int = 30) -> DataFrame:
    """Scenes of equal length under a timeline: project_id, scene_pos, s, e."""
    end = cue_rows.groupBy("project_id").agg(F.max("end_s").alias("last"))
    return on_grid(end.select("project_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / seconds).cast("int"))).alias("scene_pos")), seconds)


def on_grid(scenes: DataFrame, seconds: int = 30) -> DataFrame:
    """Adds s and e to scenes of a grid."""
    return scenes.select("*", (F.col("scene_pos") * F.lit(float(seconds))).alias("s"), ((F.col("scene_pos") + 1) * F.lit(float(seconds))).alias("e"))


def grid_sql(cue_table: str, seconds: int = 30) -> str:
    return f"""scenes as (select project_id, scene_pos, scene_pos * {seconds}.0::DOUBLE as s, (scene_pos + 1) * {seconds}.0::DOUBLE as e from
  (select project_id, CAST(unnest(range(CAST(floor(max(end_s) / {seconds}) AS BIGINT) + 1)) AS INTEGER) as scene_pos from {cue_table} group by project_id))"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edit decisions: project_id, pos, duration, source_start, source_end, flag."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_extendedprice") / 100
    d = li.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("duration"), start.alias("source_start"), (start + F.col("l_quantity")).alias("source_end"), F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    # line numbers may repeat within an order
    w = W.partitionBy("project_id").orderBy("pos", "l_partkey", "l_suppkey", "source_start", "duration", "tax", "discount", "flag")
    return d.withColumn("pos", F.row_number().over(w)).drop("l_partkey", "l_suppkey")


CLIPS = """clips as (select l_orderkey as project_id, CAST(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
  l_extendedprice / 100, l_quantity, l_tax, l_discount, l_returnflag) AS INTEGER) as pos, l_quantity as duration, l_extendedprice / 100 as source_start,
  l_extendedprice / 100 + l_quantity as source_end, l_returnflag as flag, l_tax as tax, l_discount as discount from lineitem)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("state"), "ts", "event_id")


HISTORY = "history as (select user_id as project_id, event_type as state, ts, event_id from events)"
#: Allowed state changes and the happy path of the events' five states.
ALLOWED = [("view", "click"), ("view", "signup"), ("view", "error"), ("click", "signup"), ("click", "purchase"), ("click", "view"), ("signup", "purchase"), ("signup", "view"), ("error", "view")]
PATH = ["view", "click", "signup", "purchase"]
