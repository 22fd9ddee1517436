"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_AS_IS, blocks, bound_batches, bounded_broadcast, mix64, table, utf8, words_of
from .trees import Forest, fit

#: Labelled documents that the trees are fitted on, at most (those with the smallest hash of the id).
SAMPLE = 12_000
#: Statistics beside the base counts; sign: the direction in which the score may go as the statistic grows, 0 for either.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0, "upper": 0, "digits": 0, "marks": 0, "non_ascii": 0, "words_per_line": 0, "single_chars": 0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = np.zeros(256, dtype=np.int64)  # 1 upper, 2 digit, 3 punctuation, 4 first byte of a non-ASCII character
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[65:91], _KIND[48:58], _KIND[192:] = 1, 2, 4


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each text, a row each."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    doc_of_byte = np.repeat(np.arange(n), sizes)
    words, doc, length, at = words_of(texts, SPACED_AS_IS)
    n_words = np.bincount(doc, minlength=n)
    # code points in words: bytes of words that don't continue a character
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = lead[at + length] - lead[at] if len(at) else np.zeros(0, dtype=np.int64)
    word_chars = np.bincount(doc, chars, minlength=n).astype(np.int64)
    n_symbols = np.bincount(doc_of_byte[_SYMBOL[data]], minlength=n)
    dup, lines = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        some = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(some)
        dup[i] = len(some) - len(set(some))
    repeat = np.zeros(n, dtype=np.int64)
    full = len(words) - WINDOW + 1
    if full > 0:
        acc = np.zeros(full, dtype=np.uint64)
        for k in range(WINDOW):
            acc = mix64(acc + words[k : k + full] + np.uint64(k))
        head = np.flatnonzero(doc[:full] == doc[WINDOW - 1 :])
        h, d = acc[head], doc[head]
        order = np.lexsort((h, d))
        same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
        often = np.zeros(len(head), dtype=bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, head[often], 1)
        np.add.at(edge, head[often] + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    kinds = np.bincount(doc_of_byte * 5 + _KIND[data], minlength=5 * n).reshape(n, 5)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([np.log1p(n_words), word_chars / w, n_symbols / w, dup / np.maximum(lines, 1), repeat / w, distinct / w, kinds[:, 1] / c, kinds[:, 2] / c, kinds[:, 3] / c, kinds[:, 4] / c, n_words / np.maximum(lines, 1), np.bincount(doc, chars == 1, minlength=n) / w], axis=1)
    return np.stack([n_words, word_chars, n_symbols, dup, repeat], axis=1), features


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most `sample` labelled documents; only their statistics come to the driver. Null labels and ids are left out."""
    bound_batches(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").alias("__text")).join(bounded_broadcast(chosen, sample), "doc_id").select("__text", "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(0))
            x = np.concatenate([statistics(texts[lo:hi])[1] for lo, hi in blocks(texts)]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j], pa.float64()) for j in range(x.shape[1])), b.column(1)], names=[*FEATURES, "y"])

    got = rows.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas().sort_values([*FEATURES, "y"], ignore_index=True)
    return fit(got[list(FEATURES)].to_numpy(), got.y.to_numpy(), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The base counts of each whole text, base_failed boolean, quality double and kept boolean, with the `keep` columns.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. kept: not base_failed and quality >= threshold.
    Null and empty texts have zero counts and fail the base rule. Repeated rows stay repeated.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(b.num_columns - 1))
            parts = [statistics(texts[lo:hi]) for lo, hi in blocks(texts)]
            base = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, len(BASE)), dtype=np.int64)
            score = np.concatenate([forest.score(x) for _, x in parts]) if parts else np.zeros(0)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(base[:, j], pa.int64()) for j in range(len(BASE))), pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= threshold))], names=[*b.schema.names[:-1], *BASE, "base_failed", "quality", "kept"])

    return rows.mapInArrow(run, kept + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, quality double, kept boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text of documents and the verdict of trees trained on labels. Null texts have no words and fail."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
