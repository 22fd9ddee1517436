"""Token counts as delta-maintained rollups."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
_SYMBOLS = "[#*$%&|<>]"
_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text: null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}|{_SPACE}\\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPACE))).cast("bigint")


#: Counters of the query, by tokenizer version.
TOKENIZERS = {"words-1": word_count, "bytes-1": lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")}


def inserts(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """A signed row for each document and tokenizer: source, lang, tokenizer, sign, n_tokens. Null keys are groups of their own."""
    counts = F.explode(F.array(*(F.struct(F.lit(k).alias("tokenizer"), count(F.col("text")).alias("n_tokens")) for k, count in tokenizers.items()))).alias("c")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), counts).select("source", "lang", "c.tokenizer", F.lit(1).alias("sign"), "c.n_tokens")


def deletes(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    return inserts(docs, tokenizers).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """The old counts go and the new ones come; unchanged documents cancel out."""
    return deletes(old, tokenizers).unionByName(inserts(new, tokenizers))


def _batches(path: str) -> str:
    return f"{path}/published"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(deltas: DataFrame, path: str, batch_id: str) -> None:
    """Store the batch's additive totals under its id. Rows of a key are summed in each task before the shuffle.

    The totals are written to a folder of their own; then an empty file that names it publishes them, at one stroke. Of several
    publications of a batch, after a failure or by two writers, readers take the last, so every batch counts once, and at no time is one
    missing or half there. Any string is a batch id.
    """
    spark, name = deltas.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    summed = deltas.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
    summed.write.parquet(f"{path}/data/{name}")
    marker, fs = _file_system(spark, f"{_batches(path)}/{quote(batch_id, safe='')}/{name}")
    fs.create(marker, False).close()


def published(spark: SparkSession, path: str) -> list[str]:
    """The folders of the last publication of each batch."""
    top, fs = _file_system(spark, _batches(path))
    if not fs.exists(top):
        return []
    last = [max(f.getPath().getName() for f in fs.listStatus(batch.getPath())) for batch in fs.listStatus(top)]
    return [f"{path}/data/{name}" for name in sorted(last)]


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals by source, language and tokenizer version over all published batches; groups without documents left are not shown."""
    folders = published(spark, path)
    rows = spark.read.schema(_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], _SCHEMA)
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")


def _counted(docs: DataFrame, *texts: Column) -> DataFrame:
    """doc_id, source, lang, hash (null texts have one of their own) and the counts c0, c1, ... of each of the texts by tokenizer."""
    counts = (F.array(*(F.struct(F.lit(k).alias("tokenizer"), count(t).alias("n_tokens")) for k, count in TOKENIZERS.items())).alias(f"c{i}") for i, t in enumerate(texts))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash"), *counts)


def _signed(counted: DataFrame, counts: str, sign: int) -> DataFrame:
    return counted.select("source", "lang", F.explode(counts).alias("c")).select("source", "lang", "c.tokenizer", F.lit(sign).alias("sign"), "c.n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents loaded, exact copies of a smaller doc_id and copies without one deleted, texts with symbols revised to texts without
    them, the load committed again. Each row is marked through the hash of its own text: repeated rows of the least doc_id all stay."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/rollup"
    commit(inserts(docs), path, "load")
    text, is_first = F.col("text"), F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))
    counted = _counted(docs, text)
    firsts = staged(counted.groupBy("hash").agg(F.min("doc_id").alias("first")), "firsts")
    commit(_signed(counted.join(firsts, "hash").where(~is_first), "c0", -1), path, "copies")
    marked = _counted(docs.where(text.rlike(_SYMBOLS)), text, F.regexp_replace("text", _SYMBOLS, "")).join(firsts, "hash").where(is_first)
    commit(_signed(marked, "c0", -1).unionByName(_signed(marked, "c1", 1)), path, "symbols")
    commit(inserts(docs), path, "load")
    return totals(spark, path)


_WORDS_SQL = "CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT)"
SQL = {
    "op8_token_counts": f"""
with firsts as (select text, min(doc_id) as first from documents group by text),
kept as (
  select d.source, d.lang, regexp_replace(coalesce(d.text, ''), '{_SYMBOLS}', '', 'g') as t
  from documents d join firsts f on d.text is not distinct from f.text where d.doc_id = f.first),
counted as (
  select source, lang, 'words-1' as tokenizer, {_WORDS_SQL} as n from kept
  union all select source, lang, 'bytes-1', CAST(octet_length(encode(t)) AS BIGINT) from kept)
select source, lang, tokenizer, CAST(count(*) AS BIGINT) as n_docs, CAST(sum(n) AS BIGINT) as n_tokens from counted group by all"""
}
