"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table

#: Pieces whose ids a worker remembers; beyond it the memory is emptied.
MEMORY = 500_000
#: A space before a character that no tokenizer takes for white space always starts a new match of the pattern.
_GAP = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
#: Pieces on whose matches every regular-expression library agrees; only the tokenizers library splits the others.
_PLAIN = re.compile(r"[\n -~\u00c0-\u00ff]+")


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for one file of ranks; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = self.tokenizer.model
        self.matches = regex.compile(pattern).findall
        self.to_chars = dict(enumerate(chars))
        size = max(ranks.values()) + 1
        back = {c: b for b, c in enumerate(chars)}
        tokens = [b""] * size
        for shape, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(back[c] for c in shape)
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.table = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        """Ids of one piece of text; matches are remembered, as pieces share them."""
        if not _PLAIN.fullmatch(p):
            ids = self.tokenizer.encode(p, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for m in self.matches(p):
            coded = self.seen.get(m)
            if coded is None:
                ids = [t.id for t in self.model.tokenize(m.encode().decode("latin-1").translate(self.to_chars))]
                coded = self.seen[m] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(coded)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts are cut where the pattern always cuts, and a piece seen before isn't encoded again."""
        cut = [_GAP.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        for memory in (self.known, self.seen):
            if len(memory) > MEMORY:
                memory.clear()
        known = self.known  # by the piece without its leading space
        for p in {p for parts in cut for p in parts[1:]}.difference(known):
            known[p] = self.piece(" " + p)
        return [self.piece(parts[0]) + b"".join([known[p] for p in parts[1:]]) for parts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; a character split over tokens is whole again, as bytes are joined before anything reads them as UTF-8."""
        n = self.lengths[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.table[at].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset in the text at which each token starts."""
        n = self.lengths[ids]
        return np.cumsum(n) - n


_made: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def defaults() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


#: What encode() can add, with the Spark types.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "offsets": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "offsets"), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token ids of each whole text, with the `keep` columns and the `outputs`: n_tokens long, ids array<int>, offsets array<int> (byte
    offset of each token), ids_sha256 string (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 string (of the bytes
    that the ids decode to).

    Null and empty texts have no ids. Repeated rows stay repeated; other columns are dropped, so their names can't clash. One pass
    without a shuffle; a worker holds one Arrow batch and the memory of pieces.
    """
    p, pat = defaults()
    p, pat = path or p, pattern or pat
    bound_batches(df.sparkSession)
    rows = df.select(*keep, df[text].alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(p, pat)
        gc.disable()  # the memories hold no cycles, and scanning them took a third of the time
        for b in batches:
            coded = bpe.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            ids = [np.frombuffer(c, dtype="<u4") for c in coded]
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32))
            made = {
                "n_tokens": lambda: pa.array([len(i) for i in ids], pa.int64()),
                "ids": lambda: pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32))),
                "offsets": lambda: pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([bpe.offsets(i) for i in ids] or [np.zeros(0)]).astype(np.int32))),
                "ids_sha256": lambda: pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(made[o]() for o in outputs)], names=[*b.schema.names[:-1], *outputs])

    return rows.mapInArrow(run, ", ".join([*kept, *(f"{o} {OUTPUTS[o]}" for o in outputs)]))


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Bytes and text of each array of ids: adds decoded binary and text string (bytes that aren't UTF-8 as U+FFFD). Null or empty ids give no bytes; an id outside the vocabulary is an error."""
    p, pat = defaults()
    p = path or p
    bound_batches(df.sparkSession)
    rows = df.select(*keep, df[ids].alias("__ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(p, pat)
        for b in batches:
            out = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], names=[*b.schema.names[:-1], "decoded", "text"])

    return rows.mapInArrow(run, f"{kept}, decoded binary, text string" if kept else "decoded binary, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of documents and what they decode to, as digests. Null texts have no ids."""
    return encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
