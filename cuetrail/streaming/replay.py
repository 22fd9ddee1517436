"""A table of events played as a stream in several turns, with rows out of order, and a restart between the turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.scratch import scratch_dir
from .ordered import rocksdb

#: Writer of a stream, and its checkpoint and output folders.
Job = Callable[[DataFrame, str], DataStreamWriter]


def play(events: DataFrame, job: Job, turns: int = 3, disorder_s: int = 1800, close_s: int = 30 * 86_400) -> str:
    """Runs job(stream, folder) over the rows of events (event_id, ts, ...) until all are read; returns the folder.

    Rows arrive up to `disorder_s` seconds after their ts, by a hash of the event. Each turn appends the rows of one stretch of arrival and
    starts the query again from its checkpoint. A last row, `close_s` seconds after all others, without a key and with event_id -1, moves the
    watermark past them; it is itself never released. Rows without a ts aren't played.
    """
    spark, folder = events.sparkSession, scratch_dir(events.sparkSession)
    events = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(disorder_s * 1_000_000))
    low, high, last = events.agg(F.min(arrival), F.max(arrival), F.max("ts")).first()
    stream = None
    for turn in range(turns + 1):
        if turn < turns:
            part = events if low is None else events.where(F.floor((arrival - low) * turns / (high - low + 1)) == turn)
        elif low is not None:
            end = F.lit(last) + F.make_interval(secs=F.lit(close_s))
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in ("event_id", "ts")]
            part = spark.range(1).select(F.lit(-1).cast(events.schema["event_id"].dataType).alias("event_id"), end.alias("ts"), *blank).select(*events.columns)
        part.write.mode("append").parquet(f"{folder}/in")
        stream = stream if stream is not None else spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        with rocksdb(spark):
            query = job(stream, folder).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    return folder


def played(events: DataFrame, build: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """What a stream in append mode has written after all turns."""
    folder = play(events, lambda stream, folder: build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), **how)
    return events.sparkSession.read.parquet(f"{folder}/out")
