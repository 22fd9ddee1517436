"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetrail.llm.bpe import encode
from cuetrail.llm.common import bounded_broadcast, in_files, staged, table
from cuetrail.llm.decontamination import decontaminate
from cuetrail.llm.neardup import near_duplicates
from cuetrail.llm.secrets import scan
from cuetrail.llm.toxicity import score, train_on_folds

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Column by which the filters tell rows apart.
ROW = "__row"
#: Score from which a document is rejected as toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under TOXIC stay. The model is fitted on the labels of all folds but the one that is held out."""
    model = train_on_folds(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of its own for each row whatever its doc_id: the file's number and the row's place in it."""
    docs = in_files(docs, *COLUMNS)
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = staged(placed.select("__file").distinct().select("__file", F.row_number().over(W.orderBy("__file")).cast("bigint").alias("__no")), "files")
    return placed.join(bounded_broadcast(files), "__file").select(*COLUMNS, (F.shiftleft("__no", 40) + F.col("__at")).alias(ROW))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed rows less those that go. Their keys are written first, so that the texts aren't shuffled where few go."""
    return rows.join(bounded_broadcast(staged(gone, "gone")), ROW, "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more over five-word shingles, one stays: the one with the least doc_id; rows without an
    id come last, and among rows of one id the first in the files stays."""
    rows = _keyed(docs)
    near = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), w=5, percent=80)
    linked = staged(near.select(F.col("doc_id").alias(ROW), "component_id"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)
    stays = linked.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return _without(rows, linked.select(ROW).join(stays, ROW, "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark stay."""
    rows = _keyed(docs)
    judged = decontaminate(rows, table(spark, sf_dir, "benchmark"), doc_id=ROW, row_key=ROW)
    return _without(rows, judged.where("contaminated").select(F.col("doc_id").alias(ROW)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by <secret>."""
    return scan(docs, keep=("doc_id", "lang", "source", "n_chars"), redact=True).select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("redacted").isNotNull(), F.length("redacted").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the digest of what they decode to."""
    return encode(docs, keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("minhash_neardup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("byte_bpe", tokenize)]

#: SQL can't express the first stage's model; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
