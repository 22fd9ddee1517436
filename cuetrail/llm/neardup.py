"""Near-duplicate groups from bottom-k sketches of one hash function.

The sketch of a set is the `SKETCH` least values of one hash of its shingles. Each of the `POSTED` least is an inverted list of the sets that
retain it. Two sets of the threshold's similarity share at least t of these values, but for one case in 10**8, so of the values that a set
shares with others, rarest first, all but t - 1 are enough: every pair still meets in a list, and values that a third of the corpus retains
are posted only by sets that hold little else. Overlaps come from the lists and the sketches of their members, the sketch of the union
estimates the similarity of a pair, and the full shingle sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, blocks, bound_batches, mix64, partitions, shingle_sets, table, utf8

SKETCH, POSTED = 128, 24
#: Chance that a pair at the threshold shares fewer posted values than are asked for.
MISS = 1e-8
#: Standard errors by which the estimate of a pair that is still confirmed may lie below the threshold.
ERRORS = 6
#: Rounds in which members of a list are held against one of them, before those that are still apart are compared with all.
HUB_ROUNDS = 2
#: Rows and columns of a block in which members of a list are compared.
ROWS, COLUMNS = 1024, 1024
#: Pairs of one document that are confirmed in one group of rows.
PARTNERS = 128
_PAD = np.uint32(0xFFFFFFFF)


def least_shared(percent: int) -> int:
    """The most values of POSTED that two large sets at the threshold share but for one case in 1 / MISS: each of the least values of the
    union is in both sets with the probability of their similarity."""
    s, t, below = percent / 100, 0, 0.0
    while (below := below + comb(POSTED, t) * s**t * (1 - s) ** (POSTED - t)) <= MISS:
        t += 1
    return max(t, 1)


def sketch_table(docs: DataFrame, w: int) -> DataFrame:
    """doc_id, n (size of the set), h1, h2 (which set it is), lists array<long> (the POSTED least values), sketch binary (the upper halves of
    the SKETCH least values, ascending)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in blocks(texts):
                h, bounds = shingle_sets(texts[lo:hi], w)
                size = np.diff(bounds)
                sums = [np.add.reduceat(np.append(mix64(h + np.uint64(s)), np.uint64(0)), np.minimum(bounds[:-1], len(h))) for s in (1, 2)]
                for s in sums:
                    s[size == 0] = 0
                few = np.minimum(size, POSTED)
                offsets = np.concatenate(([0], np.cumsum(few)))
                at = np.repeat(bounds[:-1], few) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], few)  # values of a set are sorted
                short = np.minimum(h >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32)
                sketch = [short[a : min(a + SKETCH, z)].tobytes() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), *(pa.array(s.view(np.int64)) for s in sums), lists, pa.array(sketch, pa.binary())], names=["doc_id", "n", "h1", "h2", "lists", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, lists array<bigint>, sketch binary")


def post(classes: DataFrame, percent: int) -> DataFrame:
    """doc_id, h1, n, keys array<long>: the lists in which a set is posted; sets that can't reach the threshold with any other are left out."""
    listed = classes.select("doc_id", "h1", "n", F.explode("lists").alias("key"))
    lists = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    least = F.when(F.col("n") >= POSTED, least_shared(percent)).otherwise(F.least(F.lit(least_shared(percent)), F.ceil(F.col("n") * percent / 100)))
    shared = listed.join(lists, "key").groupBy("doc_id", "h1", "n").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("all"))
    return shared.withColumn("t", least.cast("int")).where("size(all) >= t").selectExpr("doc_id", "h1", "n", "transform(slice(all, 1, size(all) - t + 1), x -> x.key) as keys")


# --- estimates -----------------------------------------------------------------------------------------------------


def _matrix(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of ascending values, padded."""
    out = np.full((len(sketches), SKETCH), _PAD, dtype=np.uint32)
    for i, s in enumerate(sketches):
        out[i, : len(s) // 4] = np.frombuffer(s, dtype=np.uint32)
    return out


def _bound(sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value up to which the sketch holds all of its set."""
    return np.where(n > SKETCH, sketch[:, -1], _PAD - np.uint32(1))


def _may_reach(shared: np.ndarray, seen: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may reach the threshold: the estimate shared / seen is no more than ERRORS standard errors of a sample without
    replacement below it, and the sizes allow it."""
    s = percent / 100
    seen = np.maximum(seen, 1)
    union = np.maximum((na + nb) / (1 + s), seen)
    error = np.sqrt(s * (1 - s) / seen * (union - seen) / np.maximum(union - 1, 1))
    return (shared / seen >= s - ERRORS * error - 2 / seen) & (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def near_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs of rows of two sketch matrices may reach the threshold. The sketch of the union is what both hold up to the lower
    of their bounds."""
    bound = np.minimum(_bound(a, na), _bound(b, nb))[:, None]
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)).sum(axis=1)
    return _may_reach(shared, (a <= bound).sum(axis=1) + (b <= bound).sum(axis=1) - shared, na, nb, percent)


def near_block(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Like near_pairs, for every row of a with every row of b. Overlaps are counted by the values that both sides retain."""
    words = np.unique(a)
    words = words[words != _PAD]
    place = np.minimum(np.searchsorted(words, b), max(len(words) - 1, 0))
    hit = (words[place] == b) if len(words) else np.zeros(b.shape, dtype=bool)
    used = np.unique(place[hit])
    shared = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, len(used), 4096):
        part = words[used[lo : lo + 4096]]
        sides = []
        for m in (a, b):
            at = np.minimum(np.searchsorted(part, m), len(part) - 1)
            row, col = np.nonzero(part[at] == m)
            x = np.zeros((len(m), len(part)), dtype=np.float32)
            x[row, at[row, col]] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
    below = lambda m, bounds: np.stack([np.searchsorted(x, bounds, side="right") for x in m]) if len(m) else np.zeros((0, len(bounds)), int)
    own, other = below(a, _bound(b, nb)), below(b, _bound(a, na)).T
    # a sketch has no more values than its set
    seen = np.minimum(own, np.minimum(na, SKETCH)[:, None]) + np.minimum(other, np.minimum(nb, SKETCH)[None, :]) - shared
    return _may_reach(shared, seen, na[:, None], nb[None, :], percent)


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (lo, hi) whose estimate is near the threshold or above it."""
    s = nodes.select("doc_id", "sketch", "n")
    joined = pairs.join(s.toDF("lo", "a", "na"), "lo").join(s.toDF("hi", "b", "nb"), "hi").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("lo", "hi", "a", "b", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(i).to_pylist()) for i in (2, 3))
                yield b.select(["lo", "hi"]).filter(pa.array(near_pairs(x, y, b.column(4).to_numpy(), b.column(5).to_numpy(), percent)))

    return joined.mapInArrow(run, "lo bigint, hi bigint")


# --- pairs ---------------------------------------------------------------------------------------------------------


def _split_lists(placed: DataFrame, salt: int) -> DataFrame:
    """key, size, others, main, hub of each list of `placed` (key, doc_id, component) that holds several components: main is the one with
    most members, others the number of members outside it, hub one of its members, the same for all lists where that is possible."""
    found = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc_id", F.lit(salt)).alias("h"), "doc_id")).alias("hub"))
    best = F.max(F.struct("n", (-F.col("hub.h")).alias("h"), "component", F.col("hub.doc_id").alias("hub"))).alias("best")
    lists = found.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), best).where("parts > 1")
    return lists.select("key", "size", (F.col("size") - F.col("best.n")).alias("others"), F.col("best.component").alias("main"), F.col("best.hub").alias("hub"))


def in_blocks(met: DataFrame, judge, schema: str) -> DataFrame:
    """Feed judge(rows, part) with the row members (role 0) of each block and, a batch at a time, its column members (role 1). met: key, p, q,
    role, ...; a task holds the rows of one block and a batch."""
    met = met.repartition(partitions(met.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids = [b.column(c).to_numpy() for c in ("key", "p", "q", "role")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            for start, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                block, part = tuple(int(x[start]) for x in ids[:3]), b.slice(start, end - start)
                if block != last:
                    last, rows, ready = block, [], None
                if ids[3][start] == 0:
                    rows.append(part)
                elif rows or ready:
                    if ready is None:  # what is kept of the rows lasts for the whole block
                        ready, rows = judge.rows(pa.Table.from_batches(rows)), []
                    yield from judge.columns(block, ready, part)

    return met.mapInArrow(run, schema)


class _Estimate:
    """The members of a block that have a partner of another component in it, at or near the threshold, for whom this is the first list
    that both are in."""

    def __init__(self, percent: int):
        self.percent = percent

    def rows(self, t: pa.Table | pa.RecordBatch):
        return *(t.column(c).to_numpy() for c in ("doc_id", "component", "n")), _matrix(t.column("sketch").to_pylist()), np.asarray(t.column("outside")), t.column("keys").to_pylist()

    def columns(self, block, ready, part):
        doc, component, n, sketch, _, keys = ready
        doc2, component2, n2, sketch2, outside, keys2 = self.rows(part)
        ok = near_block(sketch, sketch2, n, n2, self.percent) & (component[:, None] != component2[None, :])
        ok &= (doc[:, None] < doc2[None, :]) | ~outside[None, :]  # a pair of two outside members meets twice
        x, y = np.nonzero(ok)
        sets, sets2 = {i: frozenset(keys[i]) for i in set(x.tolist())}, {i: frozenset(keys2[i]) for i in set(y.tolist())}
        first = np.array([min(sets[i] & sets2[j]) == block[0] for i, j in zip(x.tolist(), y.tolist(), strict=True)], dtype=bool)
        for role, ids, own, at in ((0, doc, component, x[first]), (1, doc2, component2, y[first])):
            at = np.unique(at)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), v)) for v in block), pa.array(np.full(len(at), role, dtype=np.int32)), pa.array(ids[at]), pa.array(own[at])], names=["key", "p", "q", "role", "doc_id", "component"])


class _Exact:
    """Links of a block by the full shingle sets of its members: of all that it finds, those that join parts that aren't joined yet."""

    def __init__(self, w: int, percent: int):
        self.w, self.percent = w, percent

    def _sets(self, t: pa.Table | pa.RecordBatch):
        texts = [x for c in t.column("text").chunks for x in utf8(c)] if isinstance(t, pa.Table) else utf8(t.column("text"))
        parts = [shingle_sets(texts[lo:hi], self.w) for lo, hi in blocks(texts)]
        return [h[a:z] for h, bounds in parts for a, z in zip(bounds[:-1], bounds[1:], strict=True)]

    def rows(self, t: pa.Table):
        sets = self._sets(t)
        size = np.array([len(x) for x in sets])
        values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        return t.column("doc_id").to_pylist(), t.column("component").to_pylist(), size, values[order], of[order], {}

    def columns(self, block, ready, part):
        doc, component, size, values, of, up = ready

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        for doc2, component2, mine in zip(part.column("doc_id").to_pylist(), part.column("component").to_pylist(), self._sets(part), strict=True):
            lo, hi = np.searchsorted(values, mine, side="left"), np.searchsorted(values, mine, side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(of[at], minlength=len(doc))
            for i in np.flatnonzero((shared > 0) & (100 * shared >= self.percent * (size + len(mine) - shared))).tolist():
                a, b = root(component[i]), root(component2)
                if a != b:
                    up[a] = b
                    found[0].append(doc[i])
                    found[1].append(doc2)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["lo", "hi"])


def _across(placed: DataFrame, lists: DataFrame, nodes: DataFrame, docs: DataFrame, w: int, percent: int, stages: Stages) -> DataFrame:
    """Links (lo, hi) between members of one list in different components, enough of them to join all that belong together. Members outside
    the list's main component are compared with all its members, in blocks of about ROWS by COLUMNS: by sketches, which are joined once a
    document, and then by the texts of those that have likely partners."""
    lists = lists.select("key", "main", F.ceil(F.col("others") / ROWS).alias("p"), F.ceil(F.col("size") / COLUMNS).alias("q"))
    of_doc = placed.join(lists, "key").groupBy("doc_id", "component").agg(F.collect_list(F.struct("key", "p", "q", (F.col("component") != F.col("main")).alias("outside"))).alias("at"))
    wide = of_doc.join(nodes.select("doc_id", "n", "sketch"), "doc_id").select("doc_id", "component", "n", "sketch", F.col("at.key").alias("keys"), F.explode("at").alias("at")).select("doc_id", "component", "n", "sketch", "keys", "at.*")
    own_p, own_q = F.pmod(F.xxhash64("doc_id", "key"), "p"), F.pmod(F.xxhash64("key", "doc_id", F.lit(1)), "q")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    as_row = F.when(F.col("outside"), F.transform(upto("q"), lambda q: F.struct(own_p.alias("p"), q.alias("q"), F.lit(0).alias("role")))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint,role:int>>"))
    as_column = F.transform(upto("p"), lambda p: F.struct(p.alias("p"), own_q.alias("q"), F.lit(1).alias("role")))
    dealt = wide.select("key", F.explode(F.concat(as_row, as_column)).alias("to"), "doc_id", "component", "outside", "n", "sketch", "keys").select("key", "to.*", "doc_id", "component", "outside", "n", "sketch", "keys")
    likely = stages.write(in_blocks(dealt, _Estimate(percent), "key bigint, p bigint, q bigint, role int, doc_id bigint, component bigint").distinct(), "likely")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(likely.hint("shuffle_hash"), "doc_id")
    return in_blocks(texts.select("key", "p", "q", "role", "doc_id", "component", "text"), _Exact(w, percent), "lo bigint, hi bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, w: int, percent: int, stages: Stages) -> DataFrame:
    """The pairs (lo, hi) whose full shingle sets are similar enough. The text of lo comes once for every PARTNERS of its pairs."""
    many = stages.write(pairs.groupBy("lo").count().where(F.col("count") > PARTNERS), "many")
    salted = pairs.join(many, "lo", "left").select("lo", "hi", F.pmod(F.xxhash64("hi"), F.ceil(F.coalesce("count", F.lit(1)) / PARTNERS)).alias("salt"))
    wanted = salted.select("lo", "salt", F.col("hi").alias("doc_id"), F.lit(True).alias("partner")).unionByName(salted.select("lo", "salt", F.col("lo").alias("doc_id"), F.lit(False).alias("partner")).distinct())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.hint("shuffle_hash"), "doc_id")
    rows = texts.repartition(partitions(docs.sparkSession), "lo", "salt").sortWithinPartitions("lo", "salt", "partner", "doc_id").select("lo", "salt", "partner", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, []
        for b in batches:
            lo, salt, partner, doc = (b.column(i).to_pylist() for i in range(4))
            texts, links = utf8(b.column(4)), ([], [])
            for start, end in blocks(texts):
                h, bounds = shingle_sets(texts[start:end], w)
                for i in range(start, end):
                    mine = h[bounds[i - start] : bounds[i - start + 1]]
                    if not partner[i]:
                        if held != (lo[i], salt[i]):
                            held, own = (lo[i], salt[i]), []
                        if not any(np.array_equal(mine, x) for x in own):  # rows of one id with different texts
                            own.append(mine)
                    elif held == (lo[i], salt[i]):
                        for x in own:
                            common = len(np.intersect1d(x, mine, assume_unique=True))
                            if len(mine) and 100 * common >= percent * (len(x) + len(mine) - common):
                                links[0].append(lo[i])
                                links[1].append(doc[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["lo", "hi"])

    return rows.mapInArrow(run, "lo bigint, hi bigint").distinct()


# --- components ----------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, stages: Stages | None = None) -> DataFrame:
    """node, component (the least node reachable) for the nodes of the edges (lo, hi). Every round points each node at its least neighbour
    and that one's least neighbour, and goes on with the edges between what they point at."""
    stages = stages or Stages(edges.sparkSession)
    left = stages.write(edges.where("lo != hi").select(F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        step = stages.write(up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("node"), F.col("y.p").alias("p")), "step")
        at = step.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        bt = step.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        left = stages.write(left.join(at, "a").join(bt, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        moved = step.withColumnRenamed("p", "component")
        if labels is not None:
            onward = step.select(F.col("node").alias("component"), "p")
            moved = labels.join(onward, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = stages.write(moved, "labels")
        stages.drop("step")
        stages.drop("edges", "labels", but=1)
    return labels if labels is not None else edges.select(F.col("lo").alias("node"), F.col("hi").alias("component")).limit(0)


def near_duplicates(docs: DataFrame, w: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles long, component_id long, kept boolean (doc_id = component_id).

    Documents whose sets of distinct `w`-word shingles have a similarity of `percent` % or more are linked; the component is the least
    doc_id that links reach. Null and empty texts have no shingles and no links. doc_id names a document: rows of one id with different
    texts count as one; rows without an id are kept, in no component. Other columns are dropped; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession)
    sets = stages.write(sketch_table(docs, w), "sets")
    real = sets.where("n > 0 and doc_id is not null")
    # rows of one set are a class; its least document stands for it
    classes = stages.write(real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("lists", "doc_id").alias("lists")), "classes")
    posted = stages.write(post(classes, percent), "posted")
    nodes = stages.write(posted.join(sets.select("doc_id", "h1", "sketch"), ["doc_id", "h1"]).dropDuplicates(["doc_id", "h1"]), "nodes")
    members = nodes.select(F.explode("keys").alias("key"), "doc_id").distinct()

    def placed(component: DataFrame | None) -> DataFrame:
        if component is None:
            return members.withColumn("component", F.col("doc_id"))
        return members.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))

    links, component = None, None
    for turn in range(HUB_ROUNDS + 1):
        here = placed(component)
        lists = stages.write(_split_lists(here, turn).where(f"size > {2 if turn else 1}"), "lists")  # the only pair of a list of two is settled
        if turn < HUB_ROUNDS:
            pairs = here.join(lists, "key").where("component != main").select(F.col("hub").alias("lo"), F.col("doc_id").alias("hi")).distinct()
            likely = stages.write(_likely(stages.write(pairs, "pairs"), nodes, percent), "likely")
            found = stages.write(_confirmed(likely, docs, w, percent, stages), "links")
        else:
            found = stages.write(_across(here, lists, nodes, docs, w, percent, stages), "links")
        stages.drop("lists", "pairs", "likely", "many")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        component = stages.write(connected_components(links, stages), "component")
        stages.drop("component", but=1)
    of_class = classes.select("h1", "h2", "n", F.col("doc_id").alias("node"))
    if component is not None:
        of_class = of_class.join(component, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    else:
        of_class = of_class.withColumnRenamed("node", "component")
    out = sets.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    stages.drop("posted", "nodes", "links", "edges", "labels")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), w=3, percent=85)
