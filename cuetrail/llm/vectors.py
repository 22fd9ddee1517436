"""Near-duplicate vectors by sorted projection passes.

A pass orders the vectors of a label lexicographically by a string of random hyperplane signs and compares each vector with the WINDOW before
it. Verified links of all passes are united, and the links of each component are then counted among its members. The windows are bounded;
what they cut off is made good by that count, which is exact inside a component: members within half the threshold's angle of one pivot are
all linked with each other and are counted without comparisons, the others are compared with all members in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stages, bound_batches, bounded_broadcast, partitions, table
from .neardup import connected_components, in_blocks

WINDOW = 64
#: Signs that are joined to a key.
BITS = 48
#: Chance that no pass brings a pair at the threshold into one window, for vectors spread evenly over the keys.
MISS = 0.01
#: Rows and columns of a block in which members of a component are compared, and pivots that are tried in larger components.
ROWS, COLUMNS, PIVOTS = 1024, 1024, 4
SEED = 20


def passes_for(largest: int, threshold: float, window: int = WINDOW) -> int:
    """Passes that a label of `largest` vectors needs: a pair must agree on so many signs that a window's worth of vectors is left."""
    agree = 1 - acos(threshold) / pi
    p = agree ** max(0.0, log2(max(largest, 1) / window))
    return 1 if p >= 1 - MISS else ceil(log(MISS) / log(1 - p))


def unit_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, dim, unit binary (doubles of length 1; null for what links with nothing)."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = [], []
            usable = pc.and_(b.column(0).is_valid(), b.column(1).is_valid()).to_pylist()
            for ok, vector in zip(usable, b.column(2), strict=True):
                unit = None
                if ok and vector.is_valid and len(vector) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False)
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        x = x / most  # no square overflows or vanishes
                        unit = x / np.sqrt(x @ x)
                dims.append(0 if unit is None else len(unit))
                units.append(None if unit is None else unit.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    slim = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id bigint, label string, dim int, unit binary")


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), -1)


def with_key(classes: DataFrame, turn: int) -> DataFrame:
    """classes with key, the signs of BITS projections of this pass as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims, units = b.column("dim").to_numpy(), b.column("unit").to_pylist()
            key = np.zeros(b.num_rows, dtype=np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes = {d: np.random.default_rng([SEED, turn, d]).standard_normal((d, BITS))}
                signs = _matrix([units[i] for i in at]) @ planes[d] > 0
                key[at] = signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield b.append_column("key", pa.array(key))

    return classes.select("cid", "label", "dim", "unit").mapInArrow(run, "cid bigint, label string, dim int, unit binary, key bigint")


def joined(near: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that join what belongs together, at most one for each b. near: the last rows of a run x all of it, `row` the first of them."""
    x, y = np.nonzero(near)
    x = x + row
    group = np.arange(near.shape[1])
    while True:
        least = np.minimum(group[x], group[y])
        new = group.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, group):
            break
        group = new
    b = np.flatnonzero(group != np.arange(len(group)))
    return group[b], b


class _Windows:
    """Links of sorted runs of one label: each vector with those at most `window` places before it."""

    def __init__(self, threshold: float, window: int):
        self.threshold, self.window = threshold, window
        self.run, self.cid, self.at, self.x = None, None, None, None

    def add(self, run, cid: np.ndarray, at: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The links that these vectors bring, as class ids."""
        x = _matrix(units)
        held = 0
        if run == self.run:
            held = len(self.cid)
            cid, at, x = np.concatenate((self.cid, cid)), np.concatenate((self.at, at)), np.concatenate((self.x, x))
        self.run, self.cid, self.at, self.x = run, cid[-self.window :], at[-self.window :], x[-self.window :]
        if len(cid) == 1:
            return cid[:0], cid[:0]
        back = at[held:, None] - at[None, :]
        a, b = joined((x[held:] @ x.T >= self.threshold) & (back > 0) & (back <= self.window), held)
        return cid[a], cid[b]


def _runs(b: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted batch with equal values in the columns."""
    keys = [b.column(c) for c in columns]
    codes = [pc.run_end_encode(k).run_ends.to_numpy() for k in keys]
    cuts = np.unique(np.concatenate([[0], *codes]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield tuple(k[lo].as_py() for k in keys), b.slice(lo, hi - lo)


def window_pass(classes: DataFrame, turn: int, threshold: float, window: int, stages: Stages) -> DataFrame:
    """Links (lo, hi) of one pass. A task compares inside its range; the vectors within a window of its ends are written beside the links and
    compared over the borders of the ranges afterwards, by their places in the whole order."""
    order = ["label", "dim", "key", "cid"]
    ordered = with_key(classes, turn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ["lo", "hi", "part", "at", "cid", "label", "dim", "unit"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]

    def packed(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, windows, last = 0, _Windows(threshold, window), None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.arange(seen, seen + b.num_rows)
            b, seen = b.append_column("at", pa.array(at)), seen + b.num_rows
            for key, part in _runs(b, "label", "dim"):
                lo, hi = windows.add(key, part.column("cid").to_numpy(), part.column("at").to_numpy(), part.column("unit").to_pylist())
                yield packed(lo=lo, hi=hi)
            slim = b.select(names[2:])
            yield packed(**{c: slim.column(c) for c in names[2:]}).slice(0, max(0, window - int(at[0])))  # the first of the range
            slim = slim.slice(max(0, window - int(at[0])))
            last = pa.concat_batches([last, slim]) if last is not None else slim
            last = last.slice(max(0, last.num_rows - window))
        if last is not None:
            yield packed(**{c: last.column(c) for c in names[2:]})

    found = stages.write(ordered.mapInArrow(run, "lo bigint, hi bigint, part int, at bigint, cid bigint, label string, dim int, unit binary"), "pass")
    ends = found.where("part is not null")
    sizes = ends.groupBy("part").agg((F.max("at") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", before.alias("before")))  # a row for each task
    placed = ends.join(offsets, "part").withColumn("at", F.col("before") + F.col("at"))
    cell = F.floor(F.col("at") / window)
    celled = placed.select(F.explode(F.array(cell, cell + 1)).alias("cell"), "at", "cid", "label", "dim", "unit")
    celled = celled.repartition(partitions(classes.sparkSession), "cell").sortWithinPartitions("cell", "at")

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(threshold, window)
        for b in batches:
            for key, part in _runs(b, "cell", "label", "dim") if b.num_rows else ():
                lo, hi = windows.add(key, part.column("cid").to_numpy(), part.column("at").to_numpy(), part.column("unit").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])

    links = celled.mapInArrow(seams, "lo bigint, hi bigint").unionByName(found.where("lo is not null").select("lo", "hi")).distinct()
    return stages.write(links, "links")


# --- links of a component ------------------------------------------------------------------------------------------


def _balls(members: DataFrame, sizes: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """cid, component, weight, unit, inside: whether a member lies within half the threshold's angle of its component's pivot, the one of
    PIVOTS with most members there. Components of one block have no pivot."""
    half = cos(acos(threshold) / 2) + 1e-9  # beyond rounding
    large = sizes.where(F.col("size") > ROWS).select("component", F.ceil(F.col("size") / ROWS).alias("salts"))
    salted = members.join(bounded_broadcast(large), "component").withColumn("salt", F.pmod(F.xxhash64("cid"), "salts"))
    tried = [F.min_by("unit", F.xxhash64("cid", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = salted.groupBy("component", "salts").agg(*tried)
    pivots = pivots.select("component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.array(*(f"p{i}" for i in range(PIVOTS))).alias("pivots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [(_matrix(p.as_py()) @ np.frombuffer(u.as_py()) >= half).tolist() for u, p in zip(b.column(3), b.column(4), strict=True)]
            yield b.drop_columns(["pivots"]).append_column("near", pa.array(near, pa.list_(pa.bool_())))

    met = salted.join(pivots, ["component", "salt"]).select("cid", "component", "weight", "unit", "pivots")
    measured = stages.write(met.mapInArrow(run, "cid bigint, component bigint, weight bigint, unit binary, near array<boolean>"), "measured")
    inside = [F.sum(F.when(F.col("near")[i], F.col("weight")).otherwise(0)).alias(f"n{i}") for i in range(PIVOTS)]
    best = F.greatest(*(F.struct(F.col(f"n{i}").alias("n"), F.lit(i).alias("i")) for i in range(PIVOTS)))
    chosen = measured.groupBy("component").agg(*inside).select("component", best["i"].alias("i"))
    flagged = measured.join(bounded_broadcast(chosen), "component").select("cid", "component", "weight", "unit", F.expr("near[i]").alias("inside"))
    rest = members.join(bounded_broadcast(large), "component", "left_anti").select("cid", "component", "weight", "unit", F.lit(False).alias("inside"))
    return stages.write(flagged.unionByName(rest), "flagged")


class _Count:
    """Weights of the linked partners: of the row members among the columns, and of columns inside the ball among the rows."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def rows(self, t: pa.Table):
        return t.column("cid").to_numpy(), t.column("weight").to_numpy(), _matrix(t.column("unit").to_pylist())

    def columns(self, block, ready, part):
        (cid, weight, x), (cid2, weight2, y) = ready, self.rows(part)
        linked = (x @ y.T >= self.threshold) & (cid[:, None] != cid2[None, :])
        sums, sums2 = linked @ weight2, (weight @ linked) * part.column("inside").to_numpy(zero_copy_only=False)
        for ids, n in ((cid, sums), (cid2, sums2)):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64))], names=["cid", "n"])


def link_counts(members: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """cid, n_links: rows that the rows of each class are linked with. members: cid, component, weight (rows of the class), unit."""
    sizes = stages.write(members.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    flagged = _balls(members, sizes, threshold, stages)
    parts = flagged.groupBy("component").agg(F.count("*").alias("size"), F.count_if(~F.col("inside")).alias("outside"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("ball"))
    parts = stages.write(parts.select("component", "ball", F.ceil(F.col("outside") / ROWS).alias("p"), F.ceil(F.col("size") / COLUMNS).alias("q")), "parts")
    met = flagged.join(bounded_broadcast(parts), "component")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    none = F.array().cast("array<struct<p:bigint,q:bigint,role:int>>")
    own_p, own_q = F.pmod(F.xxhash64("cid"), "p"), F.pmod(F.xxhash64("cid", F.lit(1)), "q")
    as_row = F.when(~F.col("inside"), F.transform(upto("q"), lambda q: F.struct(own_p.alias("p"), q.alias("q"), F.lit(0).alias("role")))).otherwise(none)
    as_column = F.when(F.col("p") > 0, F.transform(upto("p"), lambda p: F.struct(p.alias("p"), own_q.alias("q"), F.lit(1).alias("role")))).otherwise(none)
    dealt = met.select(F.col("component").alias("key"), F.explode(F.concat(as_row, as_column)).alias("to"), "cid", "weight", "unit", "inside")
    dealt = dealt.select("key", "to.*", "cid", "weight", "unit", "inside")
    counted = in_blocks(dealt, _Count(threshold), "cid bigint, n bigint").groupBy("cid").agg(F.sum("n").alias("n"))
    own = F.when(F.col("inside"), F.col("ball")).otherwise(F.col("weight")) - 1
    return met.select("cid", own.alias("own")).join(counted, "cid", "left").select("cid", (F.col("own") + F.coalesce("n", F.lit(0))).alias("n_links"))


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.93, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each row: vec_id, n_links long (rows linked directly), component_id long, kept boolean (vec_id = component_id).

    Vectors of one label and one length are linked at a cosine of `threshold` or more, in doubles; component_id is the least vec_id that links
    reach. Vectors that are null, empty, zero or hold nulls, NaN or infinities link with nothing, nor do those without a label or an id (an
    id of null gives a component of null and is kept). Repeated rows are vectors of their own, linked with each other. Every link that is
    reported is verified; a component is found as far as the passes bring its vectors together (see MISS), and the links inside it are
    counted exactly. Other columns are dropped; an empty table gives an empty result.
    """
    stages = Stages(rows.sparkSession)
    units = unit_vectors(rows, vec_id, embedding, label)
    hashed = units.withColumns({f"h{i}": F.when(F.col("unit").isNotNull(), F.xxhash64("label", "dim", "unit", F.lit(i))) for i in (1, 2)})
    hashed = stages.write(hashed, "units")
    # copies are one class
    classes = hashed.where("unit is not null").groupBy("h1", "h2", "label", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.any_value("unit").alias("unit"))
    classes = stages.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    links = None
    for turn in range(passes_for(largest, threshold, window)):
        found = window_pass(classes, turn, threshold, window, stages)
        links = found if links is None else links.unionByName(found)
        stages.drop("pass")
    component = connected_components(links.distinct(), stages)
    members = stages.write(classes.join(component.withColumnRenamed("node", "cid"), "cid").select("cid", "component", "weight", "unit", "node"), "members")
    least = members.groupBy("component").agg(F.min("node").alias("component_id"))
    counts = link_counts(members, threshold, stages)
    of_member = members.select("cid", "component").join(least, "component").join(counts, "cid")
    joined_classes = classes.select("cid", "h1", "h2", "node", "weight").join(of_member, "cid", "left").where("component is not null or weight > 1")
    known = joined_classes.select("h1", "h2", F.coalesce("n_links", F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    known = stages.write(known, "known")
    stages.drop("links", "members", "measured", "flagged", "parts", "sizes", "classes", "edges", "labels")
    out = hashed.select("vec_id", "h1", "h2").join(bounded_broadcast(known), ["h1", "h2"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("vec_id")).alias("kept"))


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings, within a label and at a cosine of 0.93 or more."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
