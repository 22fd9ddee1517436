"""Lexical diversity, repetition, clichés and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grams import distinct_shares, repeated
from ..functions.text import phrase_text, without_space

#: Generic defaults; pass lists of your own for a house style.
CLICHES = ["in a world where", "little did (?:he|she|they) know", "at the end of the day", "against all odds", "a race against time", "nothing will ever be the same", "the calm before the storm", "edge of (?:your|their) seats?"]
META = ["as an ai", "in this (?:video|recap|episode)", "let(?:'s| us) dive in", "don't forget to (?:like|subscribe)", "in conclusion", "to sum up", "thanks for watching"]
SENTENCE_END = "[。！？\\n]"


def lexical_diversity(text: Column, mode: str = "clean") -> Column:
    """Struct ttr, distinct_2, distinct_3: distinct share of the characters, pairs and triples; 1.0 where there are none.

    mode clean takes the grams of the text without white space; mode prefix those of the text as it is, as many as the text without white
    space would have, so the tail of a spaced text doesn't count.
    """
    text = F.coalesce(text, F.lit(""))
    bare = without_space(text)
    return distinct_shares(bare, bare if mode == "clean" else text)


def repeated_phrases(docs: DataFrame, n: int = 5, least: int = 3, strip: bool = True, key: str = "doc_id") -> DataFrame:
    """key, gram, count, first_pos of the n-grams that a text holds `least` times or more. They are counted inside the row; only what is
    found becomes rows, and nothing is shuffled."""
    text = phrase_text(F.col("text")) if strip else F.col("text")
    return docs.select(key, F.explode(repeated(text, n, least)).alias("g")).select(key, "g.gram", "g.count", "g.first_pos")


def top_phrases(phrases: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The k most frequent phrases of each text, the earlier first among equals."""
    w = W.partitionBy(key).orderBy(F.desc("count"), "first_pos")
    return phrases.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicate_sentences(segments: DataFrame, least_chars: int = 12, end: str = SENTENCE_END, keys=("project_id",), pos: str = "pos") -> DataFrame:
    """keys, sentence, segments: trimmed sentences of `least_chars` characters or more that stand in two segments or more."""
    parts = segments.select(*keys, pos, F.explode(F.split("text", end)).alias("s")).select(*keys, pos, F.trim("s").alias("sentence")).where(F.char_length("sentence") >= least_chars)
    return parts.groupBy(*keys, "sentence").agg(F.count_distinct(pos).alias("segments")).where("segments > 1")


def first_duplicates(segments: DataFrame, k: int = 3, least_chars: int = 12, end: str = SENTENCE_END, keys=("project_id",), pos: str = "pos") -> DataFrame:
    """keys, rank, sentence: the first k of a project's duplicate sentences, by where they first stand."""
    parts = segments.select(*keys, pos, F.posexplode(F.split("text", end)).alias("at", "s")).select(*keys, pos, "at", F.trim("s").alias("sentence")).where(F.char_length("sentence") >= least_chars)
    found = parts.groupBy(*keys, "sentence").agg(F.count_distinct(pos).alias("segments"), F.min(F.struct(pos, "at")).alias("first")).where("segments > 1")
    w = W.partitionBy(*keys).orderBy("first")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", "sentence")


def pattern_matches(text: Column, patterns: list[str]) -> Column:
    """All matches of all patterns, pattern by pattern; a dot stops at a newline only."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?d){p}"), F.lit(0)) for p in patterns)))


def diversity_score(ttr: Column, distinct_2: Column, cliches: Column, repeated: Column, meta: Column) -> Column:
    """Out of 100: half from the characters' share (0.45 is full), half from the pairs' (0.90), less what clichés, repeats and
    commentary on itself cost; not below 0."""
    score = 0.5 * F.least(F.lit(100.0), ttr / 0.45 * 100) + 0.5 * F.least(F.lit(100.0), distinct_2 / 0.90 * 100)
    return F.greatest(F.lit(0.0), score - F.least(F.lit(40), 10 * cliches) - F.least(F.lit(30), 5 * repeated) - F.least(F.lit(50), 15 * meta))


def passes_diversity(score: Column, meta: Column) -> Column:
    return (score >= 70) & (meta < 3)
