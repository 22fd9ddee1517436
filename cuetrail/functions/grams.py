"""Character n-grams of a text counted where the text is: Arrow batches, numpy inside, nothing shuffled and no string for each gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _small(ids: np.ndarray) -> bool:
    """Whether a table of all numbers up to the greatest costs no more than a sort."""
    return int(ids.max(initial=0)) <= 16 * len(ids) + 4096


def _seen(ids: np.ndarray) -> np.ndarray:
    seen = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    seen[ids] = True
    return seen


def _dense(ids: np.ndarray) -> np.ndarray:
    """The numbers replaced by 0, 1, ..., equal ones alike."""
    return (np.cumsum(_seen(ids)) - 1)[ids] if _small(ids) else np.unique(ids, return_inverse=True)[1].astype(np.int64)


def _distinct(ids: np.ndarray) -> int:
    return 0 if not len(ids) else int(_seen(ids).sum()) if _small(ids) else len(np.unique(ids))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram, the same for the same gram and for no other: numbers of two shorter grams that cover it are paired."""
    if len(codes) < n:
        return codes[:0]
    ids, k = codes, 1
    while k < n:
        ids = _dense(ids)
        step = min(k, n - k)
        ids, k = ids[:-step] * (int(ids.max()) + 1) + ids[step:], k + step
    return ids


def distinct_shares(first: Column, whole: Column) -> Column:
    """Struct ttr, distinct_2, distinct_3: distinct share of the characters of `first`, and of the pairs and triples of `whole`, of which as
    many are taken as `first` has; 1.0 where there are none. With first = whole all of them are taken."""

    @F.arrow_udf("ttr double, distinct_2 double, distinct_3 double")
    def shares(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.ones((3, len(a)))
        for i, (bare, text) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
            own = _codes(bare or "")
            codes = own if text == bare else _codes(text or "")
            for n in (1, 2, 3):
                ids = _grams(own if n == 1 else codes, n)[: max(0, len(own) - n + 1)]
                if len(ids):
                    out[n - 1, i] = _distinct(ids) / len(ids)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["ttr", "distinct_2", "distinct_3"])

    return shares(first, whole)


def repeated(text: Column, n: int, least: int) -> Column:
    """Array of (gram, count, first_pos) of the n-grams that the text holds `least` times or more; null texts have none."""

    @F.arrow_udf("array<struct<gram:string,count:bigint,first_pos:int>>")
    def found(texts: pa.Array) -> pa.Array:
        grams, counts, places, sizes = [], [], [], [0]
        for t in texts.to_pylist():
            ids = _grams(_codes(t or ""), n)
            _, first, count = np.unique(ids, return_index=True, return_counts=True)
            often = count >= least
            grams += [t[i : i + n] for i in first[often].tolist()]
            counts.append(count[often])
            places.append(first[often])
            sizes.append(int(often.sum()))
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        rows = pa.StructArray.from_arrays([pa.array(grams, pa.string()), join(counts, np.int64), join(places, np.int32)], names=["gram", "count", "first_pos"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return found(text)
