"""Training-order materialisation: fixed-stride shards in the order of a keyed Feistel permutation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, delete, in_files, mix64, shared_dir, staged, table

ROUNDS = 6
#: Ids that a task holds, in bytes, before it hands on whole sequences.
PACK_BYTES = 4 << 20
_UNFINISHED = "_unfinished"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even power of two; values of n and above walk on
    along their cycle until they are inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << shift) | right

    x = once(np.asarray(index, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def record_bytes(length: int, width: int) -> int:
    """Bytes of a record: the number of ids as four bytes, then `length` ids of `width` bytes."""
    return 4 + length * width


def materialise(docs: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id", width: int = 1, length: int = 2048, key: int = 20_240_501, shard_records: int = 4096) -> DataFrame:
    """Pack the ids of all rows into sequences of `length` ids and write every sequence into its slot of the shards under `path`; returns the
    manifest, a row for each piece of a document in a sequence: doc_id, doc_offset long (ids of the document before the piece), slot long,
    seq_offset int (ids of the sequence before it), n_ids int, shard long, byte_offset long (where the piece starts in the shard).

    ids: binary, packed little-endian ids of `width` bytes. The rows of a scan task are packed one after the other, so only its last sequence
    is padded with zeros. Tasks are numbered by a first scan that sums their ids, as zipWithIndex does: all that the driver holds is a number
    for each task, and texts are shuffled once. docs is read from files, or written first. Null and empty rows have no pieces; repeated rows
    have pieces of their own. A shard is written under a name of its own and then renamed, so a task that runs twice leaves one whole file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = in_files(docs, doc_id, ids).select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).where(F.octet_length("ids") > 0)
    size, stride = length * width, record_bytes(length, width)
    with _same_splits(spark):
        sums = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.octet_length("ids").cast("bigint")).alias("bytes")).collect()
        count = np.zeros(1 + max((r.task for r in sums), default=0), dtype=np.int64)
        for r in sums:
            count[r.task] = -(-r.bytes // size)
        first, n = np.cumsum(count) - count, int(count.sum())
        if n == 0:
            return spark.createDataFrame([], _manifest(kind))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            done, held, pieces = 0, bytearray(), []

            def cut(all_of_it: bool) -> Iterator[pa.RecordBatch]:
                nonlocal done, held, pieces
                whole = -(-len(held) // size) if all_of_it else len(held) // size
                if whole:
                    slot = feistel(first[task] + done + np.arange(whole), n, key)
                    own: list[list[dict]] = [[] for _ in range(whole)]
                    rest, at = [], 0
                    for owner, offset, length_of in pieces:  # in the order of held
                        while length_of:
                            k = at // size
                            take = min(length_of, (k + 1) * size - at)
                            if k == whole:
                                rest.append((owner, offset, length_of))
                                break
                            own[k].append({"doc_id": owner, "doc_offset": offset, "seq_offset": at % size // width, "n_ids": take // width})
                            at, offset, length_of = at + take, offset + take // width, length_of - take
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array([bytes(held[i * size : (i + 1) * size]) for i in range(whole)], pa.binary()), pa.array(own, pieces_type)], names=["slot", "ids", "pieces"])
                    del held[: whole * size]
                    done, pieces = done + whole, rest

            pieces_type = None
            for b in batches:
                pieces_type = pieces_type or pa.list_(pa.struct([("doc_id", b.schema.field(0).type), ("doc_offset", pa.int64()), ("seq_offset", pa.int32()), ("n_ids", pa.int32())]))
                for owner, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held += x
                    pieces.append((owner, 0, len(x)))
                    if len(held) >= PACK_BYTES:
                        yield from cut(False)
            if pieces_type is not None:
                yield from cut(True)
            if done != (count[task] if task < len(count) else 0):
                raise RuntimeError("the scan was split in another way than when its ids were counted")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow.fs import FileSystem

            fs, root = FileSystem.from_uri(path)
            fs.create_dir(f"{root}/{_UNFINISHED}", recursive=True)
            shard, out, name = -1, None, ""

            def close() -> None:
                if out is not None:
                    out.close()
                    fs.move(name, f"{root}/{shard_name(shard)}")

            for b in batches:
                slots = b.column("slot").to_numpy()
                for s, x in zip(slots.tolist(), b.column("ids").to_pylist(), strict=True):
                    if s // shard_records != shard:
                        close()
                        shard, name = s // shard_records, f"{root}/{_UNFINISHED}/{uuid.uuid4().hex}"
                        out = fs.open_output_stream(name)
                    out.write((len(x) // width).to_bytes(4, "little") + x + bytes(size - len(x)))
                lists = b.column("pieces")
                p, slot = lists.flatten(), np.repeat(slots, np.diff(lists.offsets.to_numpy()))
                seq = p.field("seq_offset")
                place = slot % shard_records * stride + 4 + seq.to_numpy().astype(np.int64) * width
                yield pa.RecordBatch.from_arrays([p.field("doc_id"), p.field("doc_offset"), pa.array(slot), seq, p.field("n_ids"), pa.array(slot // shard_records), pa.array(place)], names=["doc_id", "doc_offset", "slot", "seq_offset", "n_ids", "shard", "byte_offset"])
            close()

        sequences = rows.mapInArrow(pack, f"slot bigint, ids binary, pieces array<struct<doc_id:{kind},doc_offset:bigint,seq_offset:int,n_ids:int>>")
        shards = -(-n // shard_records)
        tasks = min(shards, 100_000)
        ranged = sequences.repartitionById(tasks, F.floor(F.floor(F.col("slot") / shard_records) * tasks / shards).cast("int")).sortWithinPartitions("slot")
        manifest = staged(ranged.mapInArrow(write, _manifest(kind)), "manifest")
    delete(spark, f"{path}/{_UNFINISHED}")  # what tasks that died have left
    return manifest


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans of a file are split alike, even if executors come or go in between."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def _manifest(kind: str) -> str:
    return f"doc_id {kind}, doc_offset bigint, slot bigint, seq_offset int, n_ids int, shard bigint, byte_offset bigint"


def shard_name(shard: int) -> str:
    return f"shard-{shard:012d}.bin"


def read_slots(path: str, start: int, count: int, width: int = 1, length: int = 2048, shard_records: int = 4096) -> Iterator[np.ndarray]:
    """The ids of `count` slots from `start` on, in order, read straight from their places; a stopped reader goes on from its last slot."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(path)
    stride = record_bytes(length, width)
    slot, end = start, start + count
    while slot < end:
        shard = slot // shard_records
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(slot % shard_records * stride)
            while slot < end and slot // shard_records == shard:
                record = f.read(stride)
                if len(record) < stride:
                    return
                yield np.frombuffer(record, dtype=f"<u{width}", count=int.from_bytes(record[:4], "little"), offset=4)
                slot += 1


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as byte-level ids (one byte an id), packed into sequences and materialised in training order; the manifest of
    all pieces. Null and empty texts have none."""
    docs = table(spark, sf_dir, "documents")
    return materialise(docs.withColumn("ids", F.encode("text", "UTF-8")), f"{shared_dir(spark)}/shards")
