"""Removal of repeated byte strings with suffix arrays.

Every window of SPAN bytes is looked for at the place of its anchor: the least hash among its GRAM-byte strings. Equal windows have equal
anchors at equal distances, so a window can only repeat where its anchor does, and the windows of one anchor are a segment of the text.
Segments of one anchor meet in one task, equal segments only once. There the suffixes of the segments are sorted in two stages: only the
suffixes smaller than their successors directly, the others by scans over the buckets of first bytes. Adjacent common prefixes of SPAN
bytes then tell which windows are equal, and all but the first of each are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, bound_batches, mix64, partitions, staged, table, utf8

SPAN, GRAM = 100, 16
#: Segments of one anchor that are sorted together; an anchor with more is dealt out, and its windows meet once more by their hash.
TOGETHER = 2000
#: Bytes of segments whose suffixes are sorted together.
SORTED_BYTES = 1 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h = data.astype(np.uint64)
    step = 1
    while step < GRAM:
        h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return mix64(h)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, its position, first window, last window) of each run of windows with one anchor."""
    n = len(text) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    h = _gram_hashes(np.frombuffer(text, dtype=np.uint8))
    width = SPAN - GRAM + 1
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the first; texts have fewer than 2**32 bytes
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[width - have : width - have + n])
    at = (least & low).astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    return h[at[first]], at[first], first, np.append(first[1:], n) - 1


def _occurrences(docs: DataFrame) -> DataFrame:
    """anchor, segment (hash), doc_id, lo, hi (first and last window), at (of the anchor in the segment), gone: a row for each segment;
    gone if an equal one came before in the same batch, and then under an anchor of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = utf8(b.column(1))
            out, seg = [], []
            for i, t in enumerate(texts):
                h, at, lo, hi = anchors(t)
                out.append((h, np.full(len(h), ids[i]), lo, hi, at - lo))
                seg += [xxhash.xxh3_64_intdigest(t[x : y + SPAN]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            if not seg:
                continue
            h, doc, lo, hi, at = (np.concatenate(x) for x in zip(*out, strict=True))
            s = np.array(seg, dtype=np.uint64)
            order = np.lexsort((lo, doc, at, s, h))
            same = np.zeros(len(s), dtype=bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1]) & (at[order][1:] == at[order][:-1])
            twice = same.copy()  # a repeated row of the table
            twice[1:] &= (doc[order][1:] == doc[order][:-1]) & (lo[order][1:] == lo[order][:-1])
            gone, keep = np.zeros(len(s), dtype=bool), np.ones(len(s), dtype=bool)
            gone[order], keep[order] = same, ~twice
            h = np.where(gone, mix64(s + np.arange(len(s), dtype=np.uint64) + doc.astype(np.uint64)), h)
            h, s, doc, lo, hi, at, gone = (x[keep] for x in (h, s, doc, lo, hi, at, gone))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int16)), pa.array(at.astype(np.int16)), pa.array(gone)], names=["anchor", "segment", "doc_id", "lo", "more", "at", "gone"])

    return docs.mapInArrow(run, "anchor bigint, segment bigint, doc_id bigint, lo int, more smallint, at smallint, gone boolean")


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the text."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` bytes at least (ties in any order, but together).

    First stage: the suffixes smaller than their successors are sorted directly, eight bytes at a time, those still tied once more. Second
    stage: buckets of first bytes are scanned from the least on, and each suffix puts its predecessor, if that is larger, next in its bucket.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # the type of a position is that of the end of its run of equal bytes; the text's end is smaller than anything
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    smaller_at_end = np.zeros(len(ends), dtype=bool)
    smaller_at_end[:-1] = data[ends[:-1]] < data[ends[:-1] + 1]
    smaller = np.repeat(smaller_at_end, np.diff(np.append(-1, ends)))
    direct = _direct_sort(words8(data), np.flatnonzero(smaller), depth)
    bucket_of_direct = data[direct]
    cuts = np.searchsorted(bucket_of_direct, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = n - 1  # nothing precedes it in the order of larger suffixes: it is induced by the end of the text
    waiting[data[last]].append(np.array([last]))
    done = []

    def hand_on(sorted_now: np.ndarray, c: int) -> np.ndarray:
        """Give the predecessors that are larger to their buckets; those of this bucket are returned."""
        before = sorted_now[sorted_now > 0] - 1
        before = before[~smaller[before]]
        first = data[before]
        here = before[first == c]
        up = before[first > c]
        if len(up):
            order = np.argsort(data[up], kind="stable")
            up = up[order]
            kinds = data[up]
            edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
            for a, z in zip(edges, np.append(edges[1:], len(up)), strict=True):
                waiting[kinds[a]].append(up[a:z])
        return here

    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        while len(now):  # a round for each length of a run of this byte
            done.append(now)
            now = hand_on(now, c)
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            done.append(own)
            hand_on(own, c)
    return np.concatenate(done)


def _direct_sort(words: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    n = len(words)
    order = positions[np.argsort(words[positions], kind="stable")]
    key = words[order]
    tied = np.zeros(len(order) + 1, dtype=bool)
    tied[1:-1] = key[1:] == key[:-1]  # tied[i]: place i has the same bytes as place i-1
    for at in range(8, depth + 8, 8):
        active = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(active):
            break
        group = np.cumsum(~tied[active])
        where = order[active] + at
        w = np.where(where < n, words[np.minimum(where, n - 1)], np.uint64(0))
        again = np.lexsort((w, group))
        order[active] = order[active][again]
        w, group = w[again], group[again]
        same = np.zeros(len(active), dtype=bool)
        same[1:] = (group[1:] == group[:-1]) & (w[1:] == w[:-1])
        tied[active] = same
    return order


def equal_windows(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in the suffix array, whether its common prefix with the place before has SPAN bytes or more."""
    words, n = words8(data), len(data)
    same = np.zeros(len(sa), dtype=bool)
    near = np.arange(1, len(sa))
    for at in [*range(0, SPAN - 8, 8), SPAN - 8]:
        a, b = sa[near] + at, sa[near - 1] + at
        ok = (a + 8 <= n) & (b + 8 <= n)
        ok[ok] = words[a[ok]] == words[b[ok]]
        near = near[ok]
    same[near] = True
    return same


def repeats(segments: list[bytes]) -> np.ndarray:
    """The segments joined, a flag for each byte: 0 where no window of a segment starts, 1 where a window starts for the first time,
    2 where it has been before. The segments are in the order in which their windows count as earlier."""
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    window = left >= SPAN
    sa = suffix_array(data)
    group = np.cumsum(~equal_windows(data, sa))
    keep = window[sa]
    at, group = sa[keep], group[keep]
    out = window.astype(np.int8)
    if len(at):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(at, heads)
        later = at != np.repeat(least, np.diff(np.append(heads, len(at))))
        out[at[later]] = 2
    return out


def _cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, salt, hot, doc_id, lo, bytes of the wanted segments, taken from the texts."""
    of_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "more", "anchor", "salt", "hot")).alias("s"))
    rows = docs.join(of_doc.hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, s in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("s").to_pylist(), strict=True):
                out += [(x["anchor"], x["salt"], x["hot"], doc, x["lo"], t[x["lo"] : x["lo"] + x["more"] + SPAN]) for x in s]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "salt", "hot", "doc_id", "lo", "bytes"])

    return rows.select("doc_id", "text", "s").mapInArrow(run, "anchor bigint, salt int, hot boolean, doc_id bigint, lo int, bytes binary")


def _sorted_segments(segments: DataFrame) -> DataFrame:
    """doc_id, start, end, window: the removed windows of the segments as runs (window null), and for hot anchors a row for each first
    window with its hash. Segments of one anchor and salt are in one task, side by side."""
    rows = segments.repartition(partitions(segments.sparkSession), "anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "lo")

    def judged(keys, hot, docs, los, texts):
        place = sorted({(docs[i], los[i]): i for i in range(len(texts))}.values(), key=lambda i: (docs[i], los[i]))
        flags = repeats([texts[i] for i in place])
        out, base = ([], [], [], []), 0
        for i in place:
            f = flags[base : base + len(texts[i])]
            base += len(texts[i])
            edge = np.diff(np.concatenate(([0], (f == 2).astype(np.int8), [0])))
            for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                for c, v in zip(out, (docs[i], los[i] + a, los[i] + z - 1 + SPAN, None), strict=True):
                    c.append(v)
            if hot[i]:
                for a in np.flatnonzero(f == 1).tolist():
                    for c, v in zip(out, (docs[i], los[i] + a, los[i] + a + SPAN, xxhash.xxh3_128_digest(texts[i][a : a + SPAN])), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "start", "end", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for anchor, salt, hot, doc, lo, text in zip(*columns, strict=True):
                key = (anchor, salt)
                if size >= SORTED_BYTES and held[0][-1] != key:
                    yield judged(*held)
                    held, size = ([], [], [], [], []), 0
                for c, v in zip(held, (key, hot, doc, lo, text), strict=True):
                    c.append(v)
                size += len(text)
        if held[0]:
            yield judged(*held)

    return rows.mapInArrow(run, "doc_id bigint, start int, end int, window binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: stretches of bytes (they may overlap) that windows which were before cover."""
    found = _occurrences(docs)
    by = W.partitionBy("anchor")
    ordered = by.orderBy("segment", "at", "doc_id", "lo")
    # the anchors' own hashes are the key and equal segments stand together; the first of them in the corpus stays
    same = (F.lag("segment").over(ordered) == F.col("segment")) & (F.lag("at").over(ordered) == F.col("at"))
    twice = same & ~F.col("gone") & (F.lag("doc_id").over(ordered) == F.col("doc_id")) & (F.lag("lo").over(ordered) == F.col("lo"))
    found = found.withColumn("again", F.col("gone") | F.coalesce(same, F.lit(False))).withColumn("twice", F.coalesce(twice, F.lit(False)))
    marked = found.where("not twice").withColumn("segments", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(by))
    rows = staged(marked.where("again or segments > 1").select("anchor", "segment", "doc_id", "lo", "more", "again", "segments"), "rows")
    whole = rows.where("again").select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + SPAN).alias("end"))
    many = F.ceil(F.col("segments") / TOGETHER)
    wanted = rows.where("not again").select("doc_id", "lo", "more", "anchor", F.pmod(F.col("segment"), many).cast("int").alias("salt"), (many > 1).alias("hot"))
    runs = staged(_sorted_segments(_cut_segments(docs, wanted)), "runs")
    # windows of hot anchors: the first of each dealt-out part meet by their hash; there are as many as parts at most
    again = F.row_number().over(W.partitionBy("window").orderBy("doc_id", "start")) > 1
    late = runs.where("window is not null").withColumn("again", again).where("again").select("doc_id", "start", "end")
    return whole.unionByName(runs.where("window is null").select("doc_id", "start", "end")).unionByName(late)


def deduplicate(docs: DataFrame, texts: bool = False) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans long, kept_sha256 string, and with texts also kept binary: its bytes
    without each byte that a string of SPAN bytes covers which also starts earlier (smaller doc_id, or the same and an earlier start).

    Strings are judged on the input and never cross documents. Null and empty texts have no bytes. Repeated rows are one document and
    are all returned; rows of one id must not differ in text; rows without an id are returned whole. Texts under 2**31 bytes.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(docs.where("doc_id is not null"))
    of_doc = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = docs.join(of_doc.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s, e in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                kept, removed, count, at = [], 0, 0, 0
                end = -1
                for x, y in sorted(zip(s or (), e or (), strict=True)):
                    if x > end:
                        kept.append(t[at:x])
                        count += 1
                    removed += max(0, y - max(x, end))
                    end = max(end, y)
                    at = end
                kept = b"".join([*kept, t[at:]])
                out.append((len(t), removed, count, hashlib.sha256(kept).hexdigest(), *[kept] * texts))
            columns = list(zip(*out, strict=True)) if out else [[]] * (4 + texts)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * texts, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text of documents that strings of 100 bytes cover which also start earlier. Null texts have no bytes."""
    return deduplicate(table(spark, sf_dir, "documents"))
