"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, bounded_broadcast, mix64, powers, staged, table, utf8, word_bytes, words_of

#: Labelled documents that the model is fitted on, at most (those with the smallest hash of the id).
SAMPLE = 12_000
BUCKETS = 1 << 18
_WORD = np.zeros(256, dtype=bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LETTERS = word_bytes(_WORD)
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 63]] = True  # newline ! . ?


#: Lengths in bytes of the word beginnings that are features beside the word itself: compounds share them.
PREFIXES = (4, 5, 6)


def sentence_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature bucket, sentence of each feature, document of each sentence, byte position of each sentence's first word): the features
    are the words and their beginnings; sentences that hold a word are numbered from 0 over all texts."""
    h, doc, n, at = words_of(texts, _LETTERS)
    if not len(h):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(_END[data])[at]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    features, of = [h], [sentence]
    acc = np.zeros(len(h), dtype=np.uint64)
    last = len(data) - 1
    for k in range(max(PREFIXES)):
        acc += _LETTERS[data[np.minimum(at + k, last)]] * powers(max(PREFIXES))[k]
        if k + 1 in PREFIXES:
            longer = n > k + 1
            features.append(mix64(acc[longer] + np.uint64(k + 1)))
            of.append(sentence[longer])
    return (np.concatenate(features) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(of), doc[new], at[new]


@dataclass
class Model:
    """weights: of each word bucket; bias: of a sentence; empty: score of a text without words."""

    weights: np.ndarray
    bias: float
    empty: float

    def sentences(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Score of each sentence; a feature counts once in a sentence."""
        weighty = self.weights[words] != 0
        entries = np.unique(sentence[weighty] * BUCKETS + words[weighty])
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(entries // BUCKETS, self.weights[entries % BUCKETS], minlength=n), -30, 30)))

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences of each document."""
        out = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        return np.where(np.bincount(doc, minlength=n) > 0, out, self.empty)


def choose_features(df: np.ndarray, hits: np.ndarray, n: int, mean: float, least: int = 4, most: int = 4000) -> np.ndarray:
    """Which features (documents with each, toxic ones of them) stand out by four standard errors; the `most` clearest, in order."""
    z = np.abs(hits - mean * df) / np.sqrt(np.maximum(df, 1) * max(mean * (1 - mean), 1e-9))
    used = np.flatnonzero((df >= least) & (z >= 4))
    return np.sort(used[np.argsort(-z[used], kind="stable")[:most]])


def fit(columns: list[np.ndarray], sentences: list[np.ndarray], n_sentences: np.ndarray, labels: np.ndarray, n_features: int, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of maximum likelihood of the document labels under noisy-or, by Adam over all rows.

    columns and sentences: of each document the (feature, sentence) pairs that occur; n_sentences: how many sentences it has.
    """
    n = len(labels)
    y = np.asarray(labels, dtype=np.float64)
    n_sentences = np.asarray(n_sentences, dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(n_sentences)))
    n_sent = int(base[-1])
    col = np.concatenate(columns).astype(np.int64) if n else np.zeros(0, np.int64)
    sent = np.concatenate([s.astype(np.int64) + b for s, b in zip(sentences, base[:-1], strict=True)]) if n else np.zeros(0, np.int64)
    doc_of_sent = np.repeat(np.arange(n), n_sentences)
    mean = float(y.mean()) if n else 0.0
    w = np.zeros(n_features)
    bias = float(np.log(max(mean, 1e-3) / max(1.0, n_sent / max(n, 1))))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1 if n_sent else 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sent, w[col], minlength=n_sent), -30, 30)))
        none = np.exp(np.bincount(doc_of_sent, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)  # d loss / d sum of logits
        g_sent = p * pull[doc_of_sent]
        g = np.append(np.bincount(col, g_sent[sent], minlength=n_features) / n + ridge * w, g_sent.sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents. labels: doc_id and the label (null labels and ids are left out; the larger of several
    labels of one document counts). Features are counted and chosen over the sample in tasks; the driver gets the counts of the buckets
    and the sample's occurrences of the chosen features only."""
    bound_batches(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = staged(docs.select("doc_id", F.col("text").alias("__text")).join(bounded_broadcast(chosen, sample), "doc_id").select("__text", "__y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, hits = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t, y in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                f = np.unique(sentence_words([t])[0])
                df[f] += 1
                hits[f] += y
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(hits[some])], names=["f", "df", "hits"])

    head = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("__y"), F.lit(0.0)).alias("mean")).first()
    n, mean = head["n"], float(head["mean"])
    bounds = 4 / (mean * (1 - mean)) ** 0.5 if 0 < mean < 1 else 0.0
    counts = rows.coalesce(8).mapInArrow(count, "f bigint, df bigint, hits bigint").groupBy("f").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).where((F.col("df") >= 4) & (F.abs(F.col("hits") - F.col("df") * mean) >= F.sqrt("df") * mean * (1 - mean) * bounds)).orderBy("f").toPandas()
    df, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    df[counts.f], hits[counts.f] = counts.df, counts.hits
    used = choose_features(df, hits, n, mean)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in utf8(b.column(0)):
                f, s, doc, _ = sentence_words([t])
                keep = place[f] >= 0
                pairs = np.unique(s[keep] * len(used) + place[f[keep]])
                out.append(((pairs % max(len(used), 1)).astype("<u4").tobytes(), (pairs // max(len(used), 1)).astype("<u4").tobytes(), len(doc)))
            c, s, k = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(s, pa.binary()), pa.array(k, pa.int64()), b.column(1)], names=["c", "s", "k", "y"])

    got = rows.mapInArrow(occurrences, "c binary, s binary, k bigint, y int").toPandas().sort_values(["c", "s", "k", "y"], ignore_index=True)  # the order of rows doesn't reach the model
    w, bias = fit([np.frombuffer(x, dtype="<u4") for x in got.c], [np.frombuffer(x, dtype="<u4") for x in got.s], got.k.to_numpy(), got.y.to_numpy(), len(used))
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w
    empty = got[got.k == 0]
    return Model(weights, float(bias), float((empty.y.sum() + mean) / (len(empty) + 1)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), locate: bool = False, threshold: float = 0.5) -> DataFrame:
    """score double of each whole text, with the `keep` columns; with locate also offending array<string>: the sentences whose own
    score reaches the threshold, in order.

    Null and empty texts, and texts without letters, get the model's score of empty texts. Repeated rows stay repeated.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(b.num_columns - 1))
            scores, found = [], []
            for lo, hi in blocks(texts):
                part = texts[lo:hi]
                words, sentence, doc, at = sentence_words(part)
                p = model.sentences(words, sentence, len(doc))
                scores.append(model.documents(p, doc, len(part)))
                if locate:
                    marked: list[list[str]] = [[] for _ in part]
                    first = np.cumsum([0, *map(len, part)])
                    for s in np.flatnonzero(p >= threshold):
                        d = int(doc[s])
                        end = at[s + 1] if s + 1 < len(doc) and doc[s + 1] == d else first[d + 1]
                        marked[d].append(part[d][at[s] - first[d] : end - first[d]].decode("utf-8", "replace").strip())
                    found += marked
            more = [pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            if locate:
                more.append(pa.array(found, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "score", *["offending"] * locate])

    return rows.mapInArrow(run, kept + "score double" + ", offending array<string>" * locate)


def fold(doc_id) -> F.Column:
    """Fold of a document: crc32 of its id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def train_on_folds(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return train(docs, labels.where(fold(F.col("doc_id")) != 0), sample=sample)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, with the sentences that offend. Null and empty texts have the score of empty texts."""
    docs = table(spark, sf_dir, "documents")
    model = train_on_folds(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, locate=True).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
