"""What the corpus operators share: table reading, staged tables, bounded broadcasts, Arrow and numpy helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Column by which rows are told apart, whatever their ids.
ROW = "__row"
#: Rows handed to Python at a time; with the long texts of a crawl the default of 10,000 would not fit a worker.
ARROW_ROWS = 512
#: Largest table that may be broadcast, in rows and in bytes; larger ones are joined by shuffle, with the same result.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes of text that a numpy pass handles at a time (a longer single text is its own block).
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. Where that is unset, a local master (tests) gets a local folder, which is
    set; on a cluster executors would not see each other's files there, so an error is raised."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cuetrail-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # with the cluster's default file system if it names none
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file:///") else base
    return f"{base.rstrip('/')}/cuetrail-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}", *partition_by, **options)


def _written(df: DataFrame, path: str, *partition_by: str, **options: str) -> DataFrame:
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stages:
    """Tables of one job under one new shared folder. Those that nothing reads any more are dropped; the result may go on reading the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, shared_dir(spark), 0
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n:03d}-{name}"
        self.paths.setdefault(name, []).append(path)
        return _written(df, path, *partition_by)

    def drop(self, *names: str, but: int = 0) -> None:
        """Delete the tables of these names, but for the last `but` of each."""
        for name in names:
            paths = self.paths.get(name, [])
            for path in paths[: len(paths) - but]:
                delete(self.spark, path)
            self.paths[name] = paths[len(paths) - but :]


def in_files(df: DataFrame, *columns: str) -> DataFrame:
    """df if its rows have places in files, else its columns written and read again."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return staged(df.select(*columns), "rows")
    return df


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, text and ROW, a bigint of each row's own: the number of its file, and its place in it."""
    df = in_files(df, *dict.fromkeys((*keep, "text")))
    placed = df.select(*keep, "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = placed.select("__file").distinct().select("__file", F.row_number().over(W.orderBy("__file")).cast("bigint").alias("__no"))
    return placed.join(bounded_broadcast(staged(files, "files")), "__file").select(*keep, "text", (F.shiftleft("__no", 40) + F.col("__at")).alias(ROW))


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most `rows` rows and `size` bytes, as JSON, else df for a shuffled join."""
    bytes_of = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint")), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), bytes_of).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def ascii_lower(col: str | Column) -> Column:
    """Lower-case A-Z only. lower() does the same on pure ASCII text and is faster there."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- numpy helpers -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 256), _BASE, dtype=np.uint64)
        full[0] = 1
        _powers = np.cumprod(full, dtype=np.uint64)
    return _powers[:n]


def blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) index ranges whose texts have at most `limit` bytes together, one text at least."""
    start = size = 0
    i = -1
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if i >= start:
        yield start, i + 1


def word_bytes(is_word: np.ndarray, lower: bool = True) -> np.ndarray:
    """A table from byte to its value in a word, 0 outside words."""
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[65:91] += np.uint64(32)
    return values * is_word


#: Words as `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased or as they are.
SPACED, SPACED_AS_IS = word_bytes(~_SPACE), word_bytes(~_SPACE, lower=False)


def words_of(texts: list[bytes], lut: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, length in bytes, byte position in the joined texts) of each word of the texts, in order."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, none
    bounds = np.concatenate(([0], np.cumsum(lens)))
    inside = lut[data] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][lens > 0]
    first[edges] = inside[edges]  # a word never runs on from one document into the next
    at = np.flatnonzero(inside)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    heads = np.flatnonzero(first)
    cuts = np.searchsorted(at, heads)
    n = np.diff(np.append(cuts, len(at)))
    offset = np.arange(len(at)) - np.repeat(cuts, n)
    values = lut[data[at]] * powers(int(n.max()))[offset]
    hashes = mix64(np.add.reduceat(values, cuts) + mix64(n.astype(np.uint64)))
    return hashes, np.searchsorted(bounds, heads, side="right") - 1, n, heads


def shingle_sets(texts: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct w-word shingle hashes of each text: (values sorted within each document, bounds by document).
    A text of fewer words, but not none, has its whole sequence as its one shingle."""
    words, doc, _, _ = words_of(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    start = np.concatenate(([0], np.cumsum(count)))[:-1]
    salt = [mix64(np.uint64([1000003 * (k + 1)]))[0] | np.uint64(1) for k in range(w)]
    full = max(0, len(words) - w + 1)
    acc = np.zeros(full, dtype=np.uint64)
    for k in range(w):
        acc += words[k : k + full] * salt[k]
    ok = np.zeros(full, dtype=bool) if full == 0 else doc[:full] == doc[w - 1 : w - 1 + full]
    h, d = mix64(acc[ok]), doc[:full][ok]
    short = np.flatnonzero((count > 0) & (count < w))
    if len(short):
        extra = np.array([mix64(np.array([sum(int(x) * int(s) for x, s in zip(words[start[i] : start[i] + count[i]], salt, strict=False)) % (1 << 64)], dtype=np.uint64) + np.uint64(count[i]))[0] for i in short], dtype=np.uint64)
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n))))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of words as `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased; every other byte is a space.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, letters and digits of ASCII and all else beyond it, with A-Z lower-cased."""
    return text.translate(_LOWERED).split()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
