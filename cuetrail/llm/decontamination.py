"""Benchmark decontamination with a stored positional inverted index; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, bounded_broadcast, numbered, staged, table

#: What stands between words, after A-Z are lower-cased: all of ASCII but letters and digits.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Lists that are intersected for a window: its rarest terms.
RAREST = 2
#: Words by which the distance of a window's rarest terms may differ in a proximity match of the query.
SLOP = 5
#: Bits of a document's number in its block and of a word's position in its stretch: what one list of the index covers.
BLOCK_BITS, STRETCH_BITS = 13, 18
_IN_BLOCK = (1 << BLOCK_BITS) - 1
_IN_STRETCH = (1 << STRETCH_BITS) - 1
#: Bits of a stretch's number in a part, no more than a block's: an array has less than 2**31 words.
_STRETCHES_BITS = 31 - STRETCH_BITS
_STRETCHES = (1 << _STRETCHES_BITS) - 1
#: Tasks that share the rows of one split of the files when lists are made, so that none holds the tokens of a whole split.
SHARES = 4


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, terms array<string>: each distinct run of `size` words of an item; a shorter item that has words is one window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")
    return w.select("item_id", "w", at).select("item_id", F.slice("w", F.col("at"), size).alias("terms")).distinct()


def in_shares(docs: DataFrame, key: str) -> DataFrame:
    """docs, each row once, with SHARES tasks for each split of the files; a task drops the rows of other shares before texts are split."""
    share = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(SHARES))
    return reduce(DataFrame.unionAll, (docs.where(share == i) for i in range(SHARES)))


def build_index(docs: DataFrame, key: str = "uid") -> DataFrame:
    """The positional inverted index of docs, whatever it will be searched for: term, part, n, places array<int>.

    `key` is a bigint of each row's own. A row of the index is the list of one term in one block of 2**BLOCK_BITS keys (and in one stretch of
    2**STRETCH_BITS words of them; `part` has the numbers of both): `n` places, each the key's number in the block and the word's in the stretch, in this order. The place of the
    null term is the end of a document, its number of words, so that documents without words are held too. Tasks make lists of their own
    tokens before anything is shuffled; a block bounds what meets, so a term that all documents hold is as many lists as there are blocks.
    A task sorts its tokens in memory, so a split of the files is read by SHARES tasks, each of which takes its share of the rows.
    """
    ends = F.concat(words(F.col("text")), F.array(F.lit(None).cast("string")))
    k = F.col(key).cast("bigint")
    tokens = in_shares(docs, key).select(F.shiftright(k, BLOCK_BITS).alias("block"), k.bitwiseAND(_IN_BLOCK).cast("int").alias("doc"), F.posexplode(ends).alias("pos", "term"))
    part = F.shiftleft("block", _STRETCHES_BITS) + F.shiftright("pos", STRETCH_BITS)
    place = F.shiftleft("doc", STRETCH_BITS) + F.col("pos").bitwiseAND(_IN_STRETCH)
    # rows that tasks sort to make their lists hold these three columns only
    lists = tokens.select("term", part.alias("part"), place.alias("place")).groupBy("term", "part").agg(F.collect_list("place").alias("places"))
    return lists.select("term", "part", F.size("places").alias("n"), F.sort_array("places").alias("places")).sortWithinPartitions("term", "part")


def _unpacked(lists: DataFrame, key: str) -> DataFrame:
    """term, key, pos of each place of the lists."""
    each = lists.select("term", "part", F.explode("places").alias("place"))
    block, stretch = F.shiftright("part", _STRETCHES_BITS), F.col("part").bitwiseAND(_STRETCHES).cast("int")
    doc, at = F.shiftright("place", STRETCH_BITS), F.col("place").bitwiseAND(_IN_STRETCH)
    return each.select("term", (F.shiftleft(block, BLOCK_BITS) + doc).alias(key), (F.shiftleft(stretch, STRETCH_BITS) + at).alias("pos"))


def store_index(index: DataFrame) -> DataFrame:
    """The index as a table. Its files are sorted by term, with statistics by which a search opens only the parts of its terms; places are
    stored as differences."""
    return staged(index, "index", **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})


def lengths(index: DataFrame, key: str = "uid") -> DataFrame:
    """key, n_words of every document of the index."""
    return _unpacked(index.where("term is null"), key).select(key, F.col("pos").alias("n_words"))


def query_plan(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """terms, n int, picks array<struct<term, offset>>: each distinct window with its `rarest` terms, rarest first by the lengths
    of their lists in the index, whose places aren't read."""
    distinct = staged(windows(benchmark, size), "windows").select("terms").distinct()
    vocabulary = distinct.select(F.explode("terms").alias("term")).distinct()
    wanted = bounded_broadcast(vocabulary)
    counts = index.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("count"))
    counts = staged(counts, "counts")
    placed = distinct.select("terms", F.posexplode("terms").alias("offset", "term")).join(bounded_broadcast(counts), "term", "left")
    # a window with a term that no document has can't occur
    possible = placed.groupBy("terms").agg(F.min(F.coalesce("count", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct("count", "offset", "term"))).alias("by_count"))
    return possible.where("least > 0").select("terms", F.size("terms").alias("n"), F.transform(F.slice("by_count", 1, rarest), lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset"))).alias("picks"))


def postings(index: DataFrame, plan: DataFrame, key: str = "uid") -> DataFrame:
    """term, key, pos: the lists of the index that the plan's windows are looked up by."""
    terms = plan.select(F.explode("picks.term").alias("term")).distinct()
    return _unpacked(index.join(bounded_broadcast(terms), "term"), key)


def phrase_matches(lists: DataFrame, plan: DataFrame, docs: DataFrame, key: str = "uid") -> DataFrame:
    """key, start, n, terms: every place at which a whole window stands. The lists of a window's rarest terms are moved by the distance
    of the terms and intersected, once for all windows that share the terms and the distance; what is left is compared word by word: the
    words at those places of docs are joined with the windows. Only texts with such places are split again."""
    rarest, other = F.col("picks")[0], F.get("picks", F.lit(1))
    shift = other["offset"] - rarest["offset"]
    paired = plan.select("terms", "n", rarest["offset"].alias("offset"), F.size("picks").alias("lists"), rarest["term"].alias("t1"), other["term"].alias("t2"), shift.alias("shift"), F.xxhash64(rarest["term"], other["term"], shift).alias("pair"))
    pairs = paired.select("pair", "lists", "t1", "t2", "shift").distinct()
    wanted = pairs.select("pair", "lists", F.lit(0).alias("rank"), F.col("t1").alias("term"), F.lit(0).alias("shift")).unionByName(pairs.where("lists > 1").select("pair", "lists", F.lit(1).alias("rank"), F.col("t2").alias("term"), "shift"))
    moved = lists.join(bounded_broadcast(wanted), "term").withColumn("at", F.col("pos") - F.col("shift")).where("at >= 0")
    met = moved.groupBy(key, "at", "pair").agg(F.bit_or(F.col("rank") + 1).alias("seen"), F.max("lists").alias("lists")).where("seen = case when lists = 1 then 1 else 3 end")
    offsets = paired.select("pair", "n", "offset").distinct()
    placed = met.join(bounded_broadcast(offsets), "pair").select(key, (F.col("at") - F.col("offset")).alias("start"), "n").where("start >= 0")
    of_doc = staged(placed.groupBy(key).agg(F.collect_set(F.struct("start", "n")).alias("places")), "places")
    split = docs.join(bounded_broadcast(of_doc), key).select(key, "places", words(F.col("text")).alias("w"))
    phrases = split.select(key, "w", F.explode("places").alias("p")).select(key, "p.*", F.slice("w", F.col("p.start") + 1, F.col("p.n")).alias("terms"))
    return phrases.join(bounded_broadcast(plan.select("terms")), "terms").select(key, "start", "n", "terms")


def proximity_matches(lists: DataFrame, plan: DataFrame, key: str = "uid", slop: int = SLOP) -> DataFrame:
    """key, start, terms: places at which a window's two rarest terms stand at most `slop` words (30 at most) off their distance in the
    window (exact phrases included); a window of one word is matched by every such word. The stored lists, moved by the distance of the
    terms, meet in stretches of positions: a bit stands for a position, so that a stretch is one row however many postings it has.
    """
    if not 0 <= slop <= 30:
        raise ValueError("slop must be from 0 to 30")
    width = 62 - 2 * slop
    rarest, other = F.col("picks")[0], F.get("picks", F.lit(1))
    planned = plan.select("terms", rarest["offset"].alias("offset"), rarest["term"].alias("t1"), other["term"].alias("t2"), (other["offset"] - rarest["offset"]).alias("shift"))
    single = planned.where("t2 is null").select("terms", "offset", F.col("t1").alias("term"))
    alone = lists.join(bounded_broadcast(single), "term").select(key, "pos", "offset", "terms")
    paired = planned.where("t2 is not null").withColumn("pair", F.xxhash64("t1", "t2", "shift"))
    pairs = paired.select("pair", "t1", "t2", "shift").distinct()
    wanted = pairs.select("pair", "shift", F.col("t1").alias("term"), F.lit(0).alias("rank"), F.lit(0).alias("move"), F.col("t1") == F.col("t2")).toDF("pair", "shift", "term", "rank", "move", "same")
    wanted = wanted.unionByName(pairs.select("pair", "shift", F.col("t2").alias("term"), F.lit(1).alias("rank"), F.col("shift").alias("move"), (F.col("t1") == F.col("t2")).alias("same")))
    moved = lists.join(bounded_broadcast(wanted), "term").withColumn("at", F.col("pos") - F.col("move"))
    # the second term comes to each stretch from which it is within slop, the rarest to its own
    reach = F.col("rank") * slop
    stretch = F.explode(F.sequence(F.floor((F.col("at") - reach) / width), F.floor((F.col("at") + reach) / width))).alias("stretch")
    placed = moved.select(key, "pair", "shift", "same", "rank", "at", stretch)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") - F.col("stretch") * width + reach).cast("int"))
    met = placed.groupBy(key, "pair", "stretch").agg(F.max("shift").alias("shift"), F.max("same").alias("same"), *(F.bit_or(F.when(F.col("rank") == r, bit)).alias(f"m{r}") for r in (0, 1))).where("m0 is not null and m1 is not null")
    drop = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(slop - F.col("shift"), F.lit(0)))

    def near(i: Column) -> Column:
        around = F.call_function("shiftright", F.col("m1"), i).bitwiseAND(F.lit((1 << (2 * slop + 1)) - 1))
        # a token isn't its own neighbour where both terms are the same word
        own = F.when(F.col("same") & (F.abs("shift") <= slop), drop).otherwise(F.lit(0).cast("bigint"))
        return (F.call_function("shiftright", F.col("m0"), i).bitwiseAND(F.lit(1)) == 1) & (around.bitwiseAND(F.bitwise_not(own)) != 0)

    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), near)).alias("i")
    hits = met.select(key, "pair", "stretch", at).select(key, "pair", (F.col("stretch") * width + F.col("i")).alias("pos"))
    found = hits.join(bounded_broadcast(paired.select("pair", "terms", "offset")), "pair").select(key, "pos", "offset", "terms")
    return found.unionByName(alone).select(key, F.greatest(F.col("pos") - F.col("offset"), F.lit(0)).cast("int").alias("start"), "terms")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", size: int = WINDOW, slop: int | None = None, row_key: str | None = None) -> DataFrame:
    """For each row of docs: the id, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean (by exact phrases); with slop
    also n_near long, the places of proximity matches (exact ones included), and near_items array<string>, the items they belong to.

    Null and empty texts have no words and aren't contaminated. Repeated rows (also of one id) stay repeated rows: rows are told apart by
    row_key, a bigint that is different in each, or their place in the files (a DataFrame that isn't read from files is written first). Items with null or wordless texts have no windows; an empty benchmark contaminates nothing.
    """
    key = "row"
    placed, row = (docs, row_key) if row_key else (numbered(docs, doc_id), ROW)
    rows = placed.select(F.col(row).alias(key), F.col(doc_id).alias("doc_id"), "text")
    index = store_index(build_index(rows, key))
    plan = staged(query_plan(index, benchmark, size), "plan")
    lists = staged(postings(index, plan, key), "lists")
    items = windows(benchmark, size).groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    found = phrase_matches(lists, plan, rows, key).join(bounded_broadcast(items), "terms").select(key, "start", "n", "items")
    # one row for each place first; then places of a document side by side: its own hits are new up to the next place's start
    per_place = found.groupBy(key, "start").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    ordered = W.partitionBy(key).orderBy("start")
    end = F.max(F.col("start") + F.col("n")).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    hit = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(end, F.lit(0))))
    merged = F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    hits = per_place.select(key, "items", hit.alias("hit")).groupBy(key).agg(F.sum("hit").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    heads = rows.select(key, "doc_id").join(lengths(index, key), key)
    none = F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")
    sorted_items = lambda c: F.array_sort(F.transform(F.coalesce(c, none), lambda x: x.cast("string")))
    listed = sorted_items(F.col("items"))
    out = heads.join(hits, key, "left")
    extra = []
    if slop is not None:
        near = proximity_matches(lists, plan, key, slop).join(bounded_broadcast(items), "terms").groupBy(key, "start").agg(merged)
        out = out.join(near.groupBy(key).agg(F.count("*").alias("n_near"), merged.alias("near")), key, "left")
        extra = [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), sorted_items(F.col("near")).alias("near_items")]
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *extra)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in every whole text of documents, exact windows and proximity matches. Null texts have no words."""
    docs = table(spark, sf_dir, "documents")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), slop=SLOP)
