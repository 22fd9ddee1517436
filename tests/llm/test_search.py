"""Lexical search, vector near-duplicates and importance resampling against brute force; nulls, ties, repeated rows, empty tables."""

import hashlib
import random
import re
from collections import Counter
from math import floor, log
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuetrail.llm import lexical, resampling, vectors
from cuetrail.llm.common import Stages, split_words

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id bigint, text string, score string, rank string"
ITEMS = "item_id string, text string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def prose(rng, n, size=40):
    return " ".join(f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))


@pytest.fixture(scope="module")
def documents():
    """Ties, copies, repeated rows, null ids and texts, words beyond ASCII, a long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 80))) for i in range(300)]
    rows += [(1000 + i, "same words w1 w2 w3 for all of these documents") for i in range(40)]
    rows += [(7, prose(rng, 30)), (9, "same words w1 w2"), (9, "same words w1 w2"), (None, "w1 w2 w3 w4 w5"), (2000, None), (2001, ""), (2002, "!?"), (2003, "Äpfel ÄPFEL w1"), (2004, prose(rng, 30_000, 900))]
    return rows


# --- lexical search ------------------------------------------------------------------------------------------------


def ranked(documents, items, k):
    """item place, rank, doc_id, score by the contract."""
    texts = [(d, words(t)) for d, t in documents]
    texts = [(d, w, Counter(w)) for d, w in texts if w]
    n_docs, n_terms = len(texts), sum(len(w) for _, w, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, w, c in texts:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def test_search_equals_brute_force(spark, documents, monkeypatch):
    rng = random.Random(6)
    items = [(f"i{i}", prose(rng, rng.randrange(1, 12))) for i in range(21)]
    items += [("rep", "same words"), ("rep", "same words"), ("all", "w1 w1 w1 w2"), ("null", None), ("none", "?!"), ("unknown", "zzz"), ("é", "äpfel Äpfel"), (None, "w3 w5")]
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in documents], DOCS)
    key = lambda rows: sorted(rows, key=str)
    for block, k in ((lexical.BLOCK_ITEMS, 10), (4, 3)):
        got = lexical.search(docs, spark.createDataFrame(items, ITEMS), k=k, block_items=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert key((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == key(ranked(documents, items, k))


def test_search_of_empty_tables(spark, documents):
    docs, items = spark.createDataFrame([(1, "w1", None, None)], DOCS), spark.createDataFrame([("a", "w1 w2")], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, spark.createDataFrame([("a", None), ("b", "")], ITEMS)).count() == 0
    one = lexical.search(docs, items.withColumn("item_id", F.lit(5))).first()  # ids of any type; ln(4 / 3) of the only document's term
    assert (one.item_id, one["rank"], one.doc_id) == (5, 1, 1)


def test_bounds_hold_for_all_pairs():
    """No pair of nodes that holds a result is dropped, whatever the thresholds."""
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((30, 13)) < 0.2, rng.integers(1, 50, (30, 13)), 0).astype(float)
    tree, order = lexical.item_tree(weights)
    assert np.array_equal(tree.weights[:, :13], weights[:, order])
    docs = np.where(rng.random((64, 30)) < 0.2, rng.integers(1, 50, (64, 30)), 0).astype(float)
    leaves = docs.reshape(16, 4, 30).max(axis=1)
    scores = (docs @ tree.weights).reshape(16, 4, -1)
    for _ in range(5):
        score, doc = rng.integers(0, 400, tree.n), rng.integers(0, 64, tree.n)
        ids = np.arange(64).reshape(16, 4)
        wins = (scores > 0) & ((scores > score) | ((scores == score) & (ids[:, :, None] < doc)))
        kept = lexical.reachable(tree, leaves, ids.min(axis=1), None, score, doc)
        assert not (wins.any(axis=1) & ~kept).any()
        assert kept.mean() < 1


def test_search_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.execute(f"select item_id, rank, doc_id, score from ({lexical.SQL['op11_lexical_search']})").fetchall()
    assert sorted(tuple(r) for r in lexical.op11_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()) == sorted(want)


# --- vectors -------------------------------------------------------------------------------------------------------


def linked(rows, threshold):
    """(vec_id, n_links, component_id) of each row by comparing all pairs."""
    unit = []
    for _, v, label in rows:
        ok = v and label is not None and None not in v and np.isfinite(v).all() and any(v)
        scaled = np.array(v) / np.abs(v).max() if ok else None
        unit.append(scaled / np.linalg.norm(scaled) if ok else None)
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _, x) in enumerate(rows):
        for j, (b, _, y) in enumerate(rows[:i]):
            if a is None or b is None or x != y or unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (a, _, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return sorted(((a, n[i], None if a is None else least[root(i)]) for i, (a, _, _) in enumerate(rows)), key=str)


SCHEMA = "vec_id bigint, embedding array<double>, label int, key string, unit string"


def vector_rows():
    """Random vectors, a dense group, chains, exact copies, opposite and scaled vectors, and all kinds of unusable ones."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(24), i % 3) for i in range(200)]
    centre = rng.standard_normal(24)
    rows += [(300 + i, centre + 0.02 * rng.standard_normal(24), 1) for i in range(250)]
    rows += [(600 + i, centre + 0.25 * rng.standard_normal(24), 1) for i in range(60)]  # about the threshold
    rows += [(700 + i, centre, 2) for i in range(80)] + [(800 + i, rows[3][1], 0) for i in range(3)]
    rows += [(900, 5 * rows[1][1], 1), (901, -rows[1][1], 1), (902, 1e200 * rows[1][1], 1), (903, 1e-200 * rows[1][1], 1), (904, rows[1][1][:12], 1), (905, rows[1][1], None)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    rows += [(910, None, 1), (911, [0.0] * 24, 1), (912, [None] + [1.0] * 23, 1), (913, [float("nan")] * 24, 1), (914, [float("inf")] * 24, 1), (915, [], 1), (None, rows[1][1], 1), (916, rows[7][1], 1), (916, rows[7][1], 1), (1, rows[1][1], 1)]
    return rows


@pytest.mark.parametrize("rows_a_block", [1024, 50])
def test_vectors_equal_brute_force(spark, monkeypatch, rows_a_block):
    """With small blocks components have pivots and outsiders."""
    for name in ("ROWS", "COLUMNS"):
        monkeypatch.setattr(vectors, name, rows_a_block)
    rows = vector_rows()
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = got.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == linked(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    only = vectors.near_duplicate_vectors(spark.createDataFrame([(1, None, 1, None, None)], SCHEMA)).first()
    assert tuple(only) == (1, 0, 1, True)


def test_windows_find_links_across_ranges(spark):
    """A pass finds the same links whether the order is one range or many small ones, and nearly all pairs at the threshold are found."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):  # pairs at a cosine of 0.93 to 0.94
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        c = rng.uniform(0.9301, 0.94)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    units = vectors.unit_vectors(df, "vec_id", "embedding", "label").withColumn("cid", F.col("vec_id"))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        links = vectors.window_pass(units, 0, 0.93, 32, Stages(spark))
        found.append({tuple(sorted(r)) for r in links.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[0] == found[1] and len(found[0]) > 100
    groups = vectors.near_duplicate_vectors(df, window=32).where("n_links > 0").count()
    assert groups >= 0.97 * 800  # MISS is a hundredth


def test_passes_grow_with_the_label():
    assert vectors.passes_for(0, 0.93) == vectors.passes_for(64, 0.93) == 1
    assert vectors.passes_for(10**4, 0.93) < vectors.passes_for(10**6, 0.93) < vectors.passes_for(10**9, 0.93) < 200


# --- resampling ----------------------------------------------------------------------------------------------------


def grams(text):
    w = words(text)
    return [crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn(documents, target, percent, least):
    s, t = Counter(b for _, x in documents for b in grams(x)), Counter(b for x in target for b in grams(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in s}
    out, open_ = [], []
    for d, x in documents:
        own = grams(x)
        weight = sum(gain[b] for b in own)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
            if len(words(x)) >= least:
                open_.append((-score, d))
        out.append((d, len(own), weight, score))
    k = percent * len(open_) // 100
    return Counter(out), sorted(open_)[:k]


def test_resampling_equals_brute_force(spark, documents):
    target = ["w1 w2 w3 w4 same words", "w1 w2", None, ""]
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in documents], DOCS)
    for percent, least in ((5, 20), (60, 3), (100, 0), (0, 20), (5, 10**6)):
        got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, least).collect()
        rows, winners = drawn(documents, target, percent, least)
        assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows
        assert [(-r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == winners
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(winners) + 1))


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", None, None)], DOCS), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    row = resampling.resample(docs, none, percent=100, min_words=1).first()
    assert (row.n_features, row["rank"]) == (3, 1) and row.weight == 3 * floor(1000 * log(10_003 / 20_000))


def test_kth_key_of_ties(spark):
    """Many equal scores, and rows that are equal altogether."""
    rng = random.Random(4)
    keys = [(rng.randrange(5), rng.randrange(300)) for _ in range(900)]
    rows = spark.createDataFrame(keys, "score bigint, doc_id bigint")
    order = sorted(keys, key=lambda p: (-p[0], p[1]))
    for k in (1, 2, 17, 450, 899, 900):
        assert resampling.kth_key(rows, k) == order[k - 1]


def test_words_are_those_of_the_pattern():
    for text in ("Äpfel_und2Birnen, ÉTÉ\x00\x7f😀", "", "  x y ", "a\x1fb\x1cc\x85d"):
        assert [w.decode() for w in split_words(text.encode())] == words(text)
