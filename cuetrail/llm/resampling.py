"""Importance resampling towards a target distribution: hashed n-gram gains, Gumbel keys, and a distributed quickselect of the winners."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stages, batch, bound_batches, split_words, table, utf8

BUCKETS = 10_000
#: Longest run of words that is a feature.
GRAMS = 3
#: Random pivot keys of one round of the selection; each round divides the rows that are still open by about as much.
PIVOTS = 16


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Bucket of each feature of a text, and its number of words. A checksum goes on from the run that is one word shorter."""
    words = split_words(text)
    runs = list(map(crc32, words))
    found = [runs]
    tails = [b" " + w for w in words] if len(words) > 1 else []
    for n in range(1, GRAMS):
        runs = list(map(crc32, islice(tails, n, None), runs))
        found.append(runs)
    return np.fromiter((c for r in found for c in r), dtype=np.int64, count=sum(map(len, found))) % BUCKETS, len(words)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in the whole column `text`. A task adds up all its texts before anything is shuffled."""
    bound_batches(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in utf8(b.column(0)):
                total += np.bincount(features(text)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight of each document. `gain` has BUCKETS values whatever the corpus."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    counts = pa.schema([("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            rows = []
            for text in utf8(b.column(1)):
                buckets, n = features(text)
                rows.append((len(buckets), n, int(gain[buckets].sum())))
            out = batch(counts, *(zip(*rows, strict=True) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=["doc_id", *counts.names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def gumbel(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the digest of seed and doc_id; null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, k: int, seed: int = 0) -> tuple[int, int]:
    """(score, doc_id) of the k-th row by (score descending, doc_id ascending), 1 <= k <= rows. Quickselect: random rows of the open range are
    pivots, one scan counts what lies before, at and between them, and the range shrinks to the stretch that holds the k-th key. The driver
    sees the pivots and their counts only."""
    before = lambda key: (F.col("score") > key[0]) | ((F.col("score") == key[0]) & (F.col("doc_id") < key[1]))
    at = lambda key: (F.col("score") == key[0]) & (F.col("doc_id") == key[1])
    open_rows, skipped, turn = rows, 0, 0
    while True:
        drawn = open_rows.orderBy(F.xxhash64("doc_id", "score", F.lit(seed), F.lit(turn))).limit(PIVOTS).select("score", "doc_id").collect()
        pivots = sorted({(r.score, r.doc_id) for r in drawn}, key=lambda p: (-p[0], p[1]))
        sums = [F.count_if(c(p)) for p in pivots for c in (before, at)]
        counts = open_rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
        low = high = None
        passed = 0
        for i, p in enumerate(pivots):
            less, same = counts[2 * i], counts[2 * i + 1]
            if skipped + less < k <= skipped + less + same:
                return p
            if k <= skipped + less:
                high = p
                break
            low, passed = p, less + same
        if low is not None:
            open_rows = open_rows.where(~before(low) & ~at(low))
        if high is not None:
            open_rows = open_rows.where(before(high))
        skipped, turn = skipped + passed, turn + 1


def ranked(rows: DataFrame, stages: Stages) -> DataFrame:
    """rows with rank (1, 2, 3, ... by score descending, doc_id ascending). Sorted by ranges; the places before a range are added up from one
    number a task."""
    placed = rows.repartitionByRange(F.desc("score"), "doc_id").sortWithinPartitions(F.desc("score"), "doc_id")
    placed = stages.write(placed.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", earlier.alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each task of the sort
    return joined.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_features, weight, score, rank, all long.

    Features are runs of 1 to GRAMS words, hashed to BUCKETS; a document's weight is the sum of the gains of its features, score adds a Gumbel
    variate of its id, and the `percent` % highest scores of the documents with `min_words` words or more are drawn without replacement and
    ranked; rank is null for the rest. Null and empty texts have no features, weight 0, and aren't drawn. A document without an id has no
    score, isn't drawn and doesn't count among those that are drawn from. Repeated rows are documents of their own with equal scores; where
    the last place falls among them, any of them takes it. Other columns are dropped; empty tables give an empty result, an empty target
    still gives weights.
    """
    stages = Stages(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = stages.write(scored, "scored")
    enough = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    k = scored.where(enough).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    score, doc_id = kth_key(scored.where(enough).select("score", "doc_id"), k)
    wins = enough & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") <= doc_id)))
    winners = ranked(scored.where(wins), stages).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = scored.where(~F.coalesce(wins, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return winners.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of the documents, drawn towards the benchmark's distribution."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
