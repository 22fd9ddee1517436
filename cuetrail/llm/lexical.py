"""Exact ranked lexical search of a set of items against all documents by a search of two trees.

Every document is a vector of what each term of the items adds to a score for one unit of the term's weight, every item a vector of weights.
Documents lie in the order of their weightiest terms; LEAF of them in a row are a leaf and BRANCH leaves a branch, and each node holds the
coordinate maxima of its documents. The items form a binary tree in the same way, down to single ones. The product of the maxima of two nodes
bounds the score of every pair below them, so where it can't reach the weakest k-th best score of the items of a node, the whole pair of nodes
is dropped. The first k-th best scores come from some leaves of high bounds for each item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stages, bound_batches, bounded_broadcast, split_words, table, utf8

#: Documents of a leaf, leaves of a branch, leaves that give an item its first k-th best score.
LEAF, BRANCH, SEEDS = 16, 64, 4
#: Most items and different terms of a block of items; each block is searched in all documents. An item with more terms is its own block.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 16_384
#: Coordinates of a dense matrix of nodes that a task fills at a time.
CELLS = 1 << 22
#: The kinds of rows of the documents' tree.
DOCUMENT, LEAF_NODE, BRANCH_NODE = 0, 1, 2
#: Largest impact: tf of one in a document of length 0.
IMPACT = 10**9 // 1200 + 10**6
_LAST = np.iinfo(np.int64).max


# --- items ---------------------------------------------------------------------------------------------------------


def item_blocks(items: DataFrame, item_id: str, k: int = BLOCK_ITEMS) -> Iterator[list[tuple[object, Counter]]]:
    """The items with a term, (id, occurrences of its terms), in blocks of bounded size. They are read one partition at a time."""
    block, terms = [], set()
    for r in items.select(item_id, F.col("text").cast("binary")).toLocalIterator():
        own = Counter(split_words(bytes(r[1] or b"")))
        if not own:
            continue
        if block and (len(block) >= k or len(terms | own.keys()) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append((r[0], own))
        terms |= own.keys()
    if block:
        yield block


@dataclass
class ItemTree:
    """Items in the order of their weightiest terms under a binary tree. weights: terms x items, with empty items up to a power of two;
    levels: from the root down to the items, the maxima, terms x nodes; a node's children are nodes 2i and 2i + 1 of the next level."""

    weights: np.ndarray
    levels: list[np.ndarray]

    @property
    def n(self) -> int:
        return self.weights.shape[1]


def item_tree(weights: np.ndarray) -> tuple[ItemTree, np.ndarray]:
    """The tree over the columns of `weights`, and the column that each place of the tree holds."""
    lead = np.argsort(-weights, axis=0, kind="stable")[:2]
    order = np.lexsort((*lead[::-1], lead[0])) if len(weights) else np.arange(weights.shape[1])
    weights = weights[:, order]
    n, depth = weights.shape[1], 0
    while n > 1 << depth:
        depth += 1
    weights = np.pad(weights, ((0, 0), (0, (1 << depth) - n)))  # places without an item have no weights and never any result
    levels = [weights]
    while levels[0].shape[1] > 1:
        levels.insert(0, np.maximum(levels[0][:, ::2], levels[0][:, 1::2]))
    return ItemTree(weights, levels), order


def reachable(tree: ItemTree, maxima: np.ndarray, least_doc: np.ndarray, alive: np.ndarray | None, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """nodes of documents x items: whether a pair may hold a result. maxima: nodes x terms; alive: what the nodes above left (all at first);
    score, doc: the k-th best result of each item so far. A bound that equals the k-th score counts only with a lesser doc_id."""
    open_pairs = np.ones((len(maxima), 1), dtype=bool)
    for depth, top in enumerate(tree.levels):
        if depth:
            open_pairs = np.repeat(open_pairs, 2, axis=1)
        if alive is not None:  # a node is open above if an item under it is
            open_pairs &= alive.reshape(len(alive), top.shape[1], -1).any(axis=2)
        rows, nodes = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
        bound = np.full(open_pairs.shape, -1, dtype=np.int64)
        bound[np.ix_(rows, nodes)] = (maxima[rows] @ top[:, nodes]).astype(np.int64)
        weakest, latest = score.reshape(top.shape[1], -1).min(axis=1), doc.reshape(top.shape[1], -1).max(axis=1)
        open_pairs &= (bound > weakest) | ((bound == weakest) & (least_doc[:, None] < latest[None, :]))
        open_pairs &= bound > 0
    return open_pairs


# --- documents -----------------------------------------------------------------------------------------------------


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms array<int> (those of the vocabulary, ascending), tf array<int>."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            n, terms, tf, ends = [], [], [], [0]
            for text in utf8(b.column(1)):
                words = split_words(text)
                own = sorted(Counter([place[w] for w in words if w in place]).items())
                n.append(len(words))
                terms += [t for t, _ in own]
                tf += [c for _, c in own]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the bounds of each list."""
    lengths = np.asarray(lists.value_lengths())
    return np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(lengths)))


def _dense(lists: pa.Array, values: pa.Array, columns: np.ndarray, kind) -> np.ndarray:
    """Rows x the numbered columns (-1: left out) of sparse rows."""
    terms, ends = _flat(lists)
    out = np.zeros((len(lists), int(columns.max(initial=-1)) + 1), dtype=kind)
    row, col = np.repeat(np.arange(len(lists)), np.diff(ends)), columns[terms]
    keep = col >= 0
    out[row[keep], col[keep]] = _flat(values)[0][keep]
    return out


def impacts(rows: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impacts array<int>, lead1, lead2: the two terms that can add most to a score. Documents without a term are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            n, (terms, ends), tf = b.column(1).to_numpy(), _flat(b.column(2)), _flat(b.column(3))[0].astype(np.int64)
            m = 25 + np.array([75 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            by_value = np.lexsort((terms, -(weight[terms] * impact), row))
            first = terms[by_value[ends[:-1]]]
            second = terms[by_value[np.minimum(ends[:-1] + 1, ends[1:] - 1)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(impact.astype(np.int32))), pa.array(first), pa.array(second)], names=["doc_id", "terms", "impacts", "lead1", "lead2"])

    return rows.where("size(terms) > 0").mapInArrow(run, "doc_id bigint, terms array<int>, impacts array<int>, lead1 int, lead2 int")


def document_tree(rows: DataFrame) -> DataFrame:
    """kind, branch, leaf, doc_id, terms, impacts: the documents in order, and a row for each leaf and each branch, whose doc_id is the least
    below them (documents without an id come last) and whose impacts are the coordinate maxima."""
    # repeated documents are no hot key: the last column tells them apart
    placed = rows.withColumn("__row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange("lead1", "lead2", "doc_id", "__row").sortWithinPartitions("lead1", "lead2", "doc_id", "__row")
    schema = pa.schema([("kind", pa.int32()), ("branch", pa.int64()), ("leaf", pa.int64()), ("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32()))])

    def maxima(terms: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, v = np.concatenate(terms), np.concatenate(values)
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        return t[first], np.maximum.reduceat(v, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaf, held, above, out = 0, 0, [], [], []

        def branch_row() -> tuple:
            row = (BRANCH_NODE, above[0][0], None, min(x[1] for x in above), *maxima([x[2] for x in above], [x[3] for x in above]))
            above.clear()
            return row

        def leaf_rows() -> Iterator[tuple]:
            nonlocal leaf
            at, branch = (part << 33) + leaf, (part << 33) + leaf // BRANCH
            yield from ((DOCUMENT, branch, at, *x) for x in held)
            least = min(_LAST if x[0] is None else x[0] for x in held)
            top = maxima([x[1] for x in held], [x[2] for x in held])
            yield (LEAF_NODE, branch, at, least, *top)
            above.append((branch, least, *top))
            held.clear()
            leaf += 1
            if len(above) == BRANCH:
                yield branch_row()

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            (terms, ends), values = _flat(b.column(1)), _flat(b.column(2))[0]
            if b.num_rows:
                part = b.column(3)[0].as_py()
            for i, doc in enumerate(b.column(0).to_pylist()):
                held.append((doc, terms[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]))
                if len(held) == LEAF:
                    out += leaf_rows()
            if out:
                yield packed()
        if held:
            out += leaf_rows()
        if above:
            out.append(branch_row())
        if out:
            yield packed()

    numbered = placed.select("doc_id", "terms", "impacts", F.spark_partition_id().cast("bigint").alias("part"))
    return numbered.mapInArrow(run, "kind int, branch bigint, leaf bigint, doc_id bigint, terms array<int>, impacts array<int>")


# --- search --------------------------------------------------------------------------------------------------------


class _Search:
    """The steps of a search of one block of items, as functions over batches of rows of the documents' tree."""

    def __init__(self, spark: SparkSession, tree: ItemTree, k: int):
        self.spark, self.tree, self.k = spark, spark.sparkContext.broadcast(tree), k

    def best_leaves(self, leaves: DataFrame) -> DataFrame:
        """item, leaf: leaves with high bounds for each item, the best ones of the tasks."""
        shared = self.tree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            best, at = np.zeros(tree.n), np.zeros(tree.n, dtype=np.int64)
            every = np.arange(len(tree.weights))
            step = max(1, CELLS // max(len(every), 1))
            for whole in batches:
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    bound = _dense(b.column(1), b.column(2), every, tree.weights.dtype)
                    bound = np.pad(bound, ((0, 0), (0, len(every) - bound.shape[1]))) @ tree.weights
                    top = bound.argmax(axis=0)
                    high = bound[top, np.arange(tree.n)]
                    at = np.where(high > best, b.column(0).to_numpy()[top], at)
                    best = np.maximum(best, high)
            found = np.flatnonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(at[found]), pa.array(best[found].astype(np.int64))], names=["item", "leaf", "bound"])

        found = leaves.select("leaf", "terms", "impacts").mapInArrow(run, "item bigint, leaf bigint, bound bigint")
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "leaf"))
        return found.withColumn("place", place).where(F.col("place") <= SEEDS).select("item", "leaf")

    def open_pairs(self, nodes: DataFrame, thresholds: tuple[np.ndarray, np.ndarray], key: str) -> DataFrame:
        """key, open array<boolean>: the nodes of documents, and whether they may hold a result of each item. nodes: key, doc_id, terms,
        impacts, open (of the node above, null at the root)."""
        shared, best = self.tree, self.spark.sparkContext.broadcast(thresholds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, (score, doc) = shared.value, best.value
            every = np.arange(len(tree.weights))
            step = max(1, CELLS // max(len(every), 1))
            for whole in batches:
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    top = _dense(b.column(2), b.column(3), every, tree.weights.dtype)
                    top = np.pad(top, ((0, 0), (0, len(every) - top.shape[1])))
                    above = None if b.column(4).null_count else np.asarray(b.column(4).flatten()).reshape(-1, tree.n)
                    found = reachable(tree, top, b.column(1).to_numpy(), above, score, doc)
                    some = np.flatnonzero(found.any(axis=1))
                    ends = np.arange(len(some) + 1, dtype=np.int32) * tree.n
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(found[some].ravel()))], names=[key, "open"])

        return nodes.select(key, "doc_id", "terms", "impacts", "open").mapInArrow(run, f"{key} bigint, open array<boolean>")

    def scores(self, rows: DataFrame, thresholds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """item, doc_id, score: of the documents (leaf, doc_id, terms, impacts, open), the task's k best of each item that beat its threshold."""
        shared, best, k = self.tree, self.spark.sparkContext.broadcast(thresholds), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, (least, latest) = shared.value, best.value
            top = np.zeros((tree.n, k), dtype=np.int64)  # 0: no result
            docs = np.full((tree.n, k), _LAST, dtype=np.int64)
            for b in batches:
                leaf = b.column(0).to_numpy()
                cuts = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                    if lo == hi:
                        continue
                    part = b.slice(lo, hi - lo)
                    items = np.flatnonzero(np.asarray(part.column(4)[0].values))
                    used = np.unique(_flat(part.column(2))[0])
                    columns = np.full(len(tree.weights), -1)
                    columns[used] = np.arange(len(used))
                    score = (_dense(part.column(2), part.column(3), columns, tree.weights.dtype) @ tree.weights[np.ix_(used, items)]).astype(np.int64)
                    ids = part.column(1).fill_null(_LAST).to_numpy()
                    hit = (score > 0) & (score >= np.maximum(least[items], top[items, -1]))
                    hit &= (score > least[items]) | (ids[:, None] <= latest[items])
                    for j in np.flatnonzero(hit.any(axis=0)).tolist():
                        i, at = items[j], np.flatnonzero(hit[:, j])
                        s, d = np.concatenate((top[i], score[at, j])), np.concatenate((docs[i], ids[at]))
                        order = np.lexsort((d, -s))[:k]
                        top[i], docs[i] = s[order], d[order]
            item, place = np.nonzero(top)  # empty places have no score
            ids = pa.array(docs[item, place], mask=docs[item, place] == _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(top[item, place])], names=["item", "doc_id", "score"])

        return rows.select("leaf", "doc_id", "terms", "impacts", "open").mapInArrow(run, "item bigint, doc_id bigint, score bigint")

    def best(self, found: DataFrame) -> DataFrame:
        """item, rank, doc_id, score of the k best of each item."""
        w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k).select("item", "rank", "doc_id", "score")

    def kth(self, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """score and doc_id of the k-th best of each item, 0 and the last id where there are fewer. The driver gets one row an item of the block."""
        score, doc = np.zeros(self.tree.value.n, dtype=np.int64), np.full(self.tree.value.n, _LAST, dtype=np.int64)
        for r in self.best(found).where(F.col("rank") == self.k).collect():
            score[r.item], doc[r.item] = r.score, _LAST if r.doc_id is None else r.doc_id
        return score, doc


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], k: int, stages: Stages) -> tuple[DataFrame, np.ndarray] | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    rows = stages.write(vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[r.t] = r["count"]
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    wanted = np.zeros((len(vocabulary), len(block)), dtype=np.int64)
    for j, (_, own) in enumerate(block):
        for t, c in own.items():
            wanted[vocabulary[t], j] = c * weight[vocabulary[t]]
    # products of whole numbers are exact in doubles up to 2**53
    kind = np.float64 if int(wanted.sum(axis=0).max()) * IMPACT < 1 << 53 else np.int64
    tree, order = item_tree(wanted.astype(kind))
    search = _Search(spark, tree, k)

    nodes = stages.write(document_tree(impacts(rows, weight, n_docs, n_terms)), "tree", "kind")
    at = {kind: nodes.where(F.col("kind") == kind) for kind in (DOCUMENT, LEAF_NODE, BRANCH_NODE)}
    all_open = F.array_repeat(F.lit(True), tree.n).alias("open")
    seeds = stages.write(search.best_leaves(at[LEAF_NODE]).select("leaf").distinct(), "seeds")
    none = np.zeros(tree.n, dtype=np.int64), np.full(tree.n, _LAST, dtype=np.int64)
    first = at[DOCUMENT].join(bounded_broadcast(seeds), "leaf").select("leaf", "doc_id", "terms", "impacts", all_open)
    thresholds = search.kth(search.scores(first, none))

    branches = search.open_pairs(at[BRANCH_NODE].withColumn("open", F.lit(None).cast("array<boolean>")), thresholds, "branch")
    branches = stages.write(branches, "branches")
    leaves = search.open_pairs(at[LEAF_NODE].join(bounded_broadcast(branches), "branch"), thresholds, "leaf")
    leaves = stages.write(leaves, "leaves")
    found = stages.write(search.best(search.scores(at[DOCUMENT].join(bounded_broadcast(leaves), "leaf"), thresholds)), "found")
    stages.drop("vectors", "tree", "seeds", "branches", "leaves")
    return found, order


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank int, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), by score and then the lesser doc_id.

    Terms are runs of letters and digits, A-Z lower-cased; the score is the contract's integer form of a saturated term frequency with
    inverse document frequency. Null and empty texts have no terms and are never results; an item without a term, or with none that a
    document holds, has no rows. Repeated rows of either table count as rows of their own. Documents without an id come after the others of
    their score. Other columns are dropped; an empty table gives an empty result.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_id} {kind}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, item_id, block_items):
        found = _search_block(docs, block, k, stages)
        if found is not None:
            best, order = found
            names = spark.createDataFrame([Row(item=i, name=block[j][0]) for i, j in enumerate(order.tolist())], f"item bigint, name {kind}")
            out = out.unionByName(best.join(F.broadcast(names), "item").select(F.col("name").alias(item_id), "rank", "doc_id", "score"))  # a block is bounded
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = {
    "op11_lexical_search": f"""with lowered as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
listed as (select doc_id, regexp_extract_all(t, '{_WORDS}') as w from lowered),
sized as (select doc_id, CAST(len(w) AS BIGINT) as n, w from listed where len(w) > 0),
totals as (select CAST(count(*) AS BIGINT) as nd, CAST(sum(n) AS BIGINT) as nt from sized),
asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')) as term from benchmark),
vocabulary as (select distinct term from asked),
occurrences as (select doc_id, n, unnest(w) as term from sized),
held as (select doc_id, n, term, CAST(count(*) AS BIGINT) as tf from occurrences semi join vocabulary using (term) group by all),
frequencies as (select term, CAST(count(*) AS BIGINT) as df from held group by term),
weighted as (select term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) as w from frequencies, totals),
wanted as (select item_id, term, CAST(count(*) AS BIGINT) as c from asked group by all),
scored as (select item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // nt))))) AS BIGINT) as score
  from wanted join weighted using (term) join held using (term), totals group by all)
select item_id, CAST(rank AS INTEGER) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10""",
}
