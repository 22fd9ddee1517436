"""Text metrics of documents, and the scorecard made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grams import repeated
from ..functions.text import phrase_text
from ..operators import audit as A
from ..operators import textmetrics as T
from ..operators.dictionary import contained
from .tables import SEGMENTS, segments, table

#: Patterns that the given prose can match; a cliché list of its own for the oracle.
CLICHES = ["(?:the|of) an[a-z]+", "wh[a-z]{4,}", "les? [a-z]+tion"]
META = ["this [a-z]+ing", "und der"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.lexical_diversity(F.col("text")).alias("d")).select("doc_id", "d.*")


def lexical_diversity_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.lexical_diversity(F.col("text"), "prefix").alias("d")).select("doc_id", "d.*")


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.repeated_phrases(_docs(spark, sf_dir), n=8)


def repeated_raw6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_phrases(T.repeated_phrases(_docs(spark, sf_dir), n=6, strip=False), 5).select("doc_id", "gram", "count", "rank")


def duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that stand in two lines or more of a document."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return T.duplicate_sentences(lines, 12, "[.!?]", ("doc_id",))


def first_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of a document that stand in two lines or more."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return T.first_duplicates(lines, 3, 12, "[.!?]", ("doc_id",))


def cliche_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.pattern_matches(F.col("text"), CLICHES)
    return _docs(spark, sf_dir).select("doc_id", F.size(found).alias("matches"), F.sha2(F.array_join(found, "|"), 256).alias("matches_sha256"))


def _measured(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    text = F.col("text")
    repeats = F.size(repeated(phrase_text(text), 8, 3)).cast("bigint")
    d = docs.select("doc_id", T.lexical_diversity(text).alias("d"), F.size(T.pattern_matches(text, CLICHES)).alias("cliches"), F.size(T.pattern_matches(text, META)).alias("meta"), F.size(F.filter(F.array(*(F.lit(x) for x in A.LEAKS)), lambda x: F.contains(text, x))).alias("leaks"), F.char_length("text").alias("chars"), repeats.alias("repeated"))
    return d.withColumn("diversity", T.diversity_score(F.col("d.ttr") * 4, F.col("d.distinct_2"), F.col("cliches"), F.col("repeated"), F.col("meta")))


def diversity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("doc_id", "cliches", "meta", "repeated", "diversity", T.passes_diversity(F.col("diversity"), F.col("meta")).alias("passed"))


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity, cleanliness, pacing and a rubric for every document, weighed into a grade."""
    m = _measured(spark, sf_dir)
    r = A.rubric(F.least(F.col("repeated"), F.lit(2)) - 1, F.least(F.col("cliches"), F.lit(1)))
    clean = F.when(F.col("leaks") > 0, 0.0).otherwise(100.0)
    pacing = A.pacing_score(F.col("chars"), F.greatest(F.lit(1.0), F.col("chars") / 4.2))
    row = lambda name, score, passed: F.struct(F.lit(name).alias("dimension"), score.cast("double").alias("score"), passed.alias("passed"))
    rows = m.withColumn("r", r).select("doc_id", "meta", F.explode(F.array(row("diversity", F.col("diversity"), T.passes_diversity(F.col("diversity"), F.col("meta"))), row("cleanliness", clean, clean == 100), row("pacing", pacing, pacing >= 70), row("depth", F.col("r.depth"), F.col("r.depth") >= 75), row("voice", F.col("r.voice"), F.col("r.voice") >= 75), row("hook", F.col("r.hook"), F.col("r.hook") >= 75))).alias("x"))
    scores = rows.select("doc_id", "x.*", (F.col("meta") >= 3).alias("hard_fail"))
    weights = {"diversity": 0.3, "cleanliness": 0.2, "pacing": 0.1, "depth": 0.2, "voice": 0.1, "hook": 0.1}
    return A.grade(scores, ("doc_id",), weights, ("cleanliness",))


def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items inside documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.trim("text").alias("needle"))
    return contained(_docs(spark, sf_dir), items, ("doc_id",), "needle").select("doc_id", "item_id")


def duplicate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts less the distinct ones, of each conversation."""
    return segments(spark, sf_dir).groupBy("project_id").agg((F.count("text") - F.count_distinct("text")).alias("duplicates"))


QUERIES = {f.__name__: f for f in (lexical_diversity, lexical_diversity_prefix, repeated_phrases, repeated_raw6, duplicate_sentences, first_duplicates, cliche_scan, diversity_score, scorecard, benchmark_contamination, duplicate_turns)}

#: White space of Unicode as a class that RE2 reads.
_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}]"
_GRAMS = lambda t, n: f"list_transform(range(1, greatest(1, length({t}) - {n} + 2)), lambda i: substring({t}, i, {n}))"
_SHARE = lambda g: f"case when len({g}) > 0 then len(list_distinct({g}))::DOUBLE / len({g}) else 1.0::DOUBLE end"
_BARE = f"bare as (select doc_id, text, regexp_replace(text, '{_WS}', '', 'g') as b from documents)"
_GRAMMED = f"{_BARE}, g as (select doc_id, {_GRAMS('b', 1)} as g1, {_GRAMS('b', 2)} as g2, {_GRAMS('b', 3)} as g3 from bare)"
_LEX = f"{_GRAMMED}, lex as (select doc_id, {_SHARE('g1')} as ttr, {_SHARE('g2')} as distinct_2, {_SHARE('g3')} as distinct_3 from g)"
_PHRASE = f"regexp_replace(text, '[，。！？、“”《》]|{_WS}', '', 'g')"


def _repeats(n: int, text: str, least: int = 3) -> str:
    return f"""(select doc_id, gram, count(*) as count, min(pos) as first_pos from (select doc_id, unnest({_GRAMS('t', n)}) as gram, CAST(unnest(range(greatest(0, length(t) - {n} + 1))) AS INTEGER) as pos
  from (select doc_id, {text} as t from documents)) group by all having count(*) >= {least})"""


def _found(ps: list[str]) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in ps) + ")"


_MEASURED = f"""{_LEX}, rep as (select doc_id, count(*) as n from {_repeats(8, _PHRASE)} group by all),
m as (select d.doc_id, ttr * 4 as ttr, distinct_2, len({_found(CLICHES)}) as cliches, len({_found(META)}) as meta, CAST(coalesce(n, 0) AS BIGINT) as repeated, length(text) as chars,
  {' + '.join(f"CAST(contains(text, '{x}') AS INTEGER)" for x in A.LEAKS)} as leaks from documents d join lex using (doc_id) left join rep using (doc_id)),
s as (select *, greatest(0.0::DOUBLE, 0.5::DOUBLE * least(100.0::DOUBLE, ttr / 0.45::DOUBLE * 100) + 0.5::DOUBLE * least(100.0::DOUBLE, distinct_2 / 0.90::DOUBLE * 100)
  - least(40, 10 * cliches) - least(30, 5 * repeated) - least(50, 15 * meta)) as diversity from m)"""
_MILLI = lambda x: f"CAST(floor(({x}) * 1000 + 0.5::DOUBLE) AS BIGINT)"
SQL = {
    "lexical_diversity": f"with {_LEX} select * from lex",
    "lexical_diversity_prefix": f"""with {_BARE}, g as (select doc_id, {_GRAMS('b', 1)} as g1, list_slice({_GRAMS('text', 2)}, 1, greatest(0, length(b) - 1)) as g2, list_slice({_GRAMS('text', 3)}, 1, greatest(0, length(b) - 2)) as g3 from bare)
select doc_id, {_SHARE('g1')} as ttr, {_SHARE('g2')} as distinct_2, {_SHARE('g3')} as distinct_3 from g""",
    "repeated_phrases": f"select doc_id, gram, CAST(count AS BIGINT) as count, first_pos from {_repeats(8, _PHRASE)}",
    "repeated_raw6": f"select * from (select doc_id, gram, CAST(count AS BIGINT) as count, CAST(row_number() over (partition by doc_id order by count desc, first_pos) AS INTEGER) as rank from {_repeats(6, 'text')}) where rank <= 5",
    "duplicate_sentences": """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as t from documents),
s as (select doc_id, pos, trim(unnest(regexp_split_to_array(t, '[.!?]'))) as sentence from l)
select doc_id, sentence, CAST(count(distinct pos) AS BIGINT) as segments from s where length(sentence) >= 12 group by all having count(distinct pos) > 1""",
    "first_duplicates": """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as t from documents),
p as (select doc_id, pos, regexp_split_to_array(t, '[.!?]') as parts from l), s as (select doc_id, pos, unnest(range(len(parts))) as nth, trim(unnest(parts)) as sentence from p),
g as (select doc_id, sentence, min(pos * 1000000 + nth) as first from s where length(sentence) >= 12 group by all having count(distinct pos) > 1)
select doc_id, rank, sentence from (select doc_id, CAST(row_number() over (partition by doc_id order by first) AS INTEGER) as rank, sentence from g) where rank <= 3""",
    "cliche_scan": f"select doc_id, CAST(len({_found(CLICHES)}) AS INTEGER) as matches, sha256(array_to_string({_found(CLICHES)}, '|')) as matches_sha256 from documents",
    "diversity_score": f"with {_MEASURED} select doc_id, CAST(cliches AS INTEGER) as cliches, CAST(meta AS INTEGER) as meta, repeated, diversity, diversity >= 70 and meta < 3 as passed from s",
    "scorecard": f"""with {_MEASURED}, q as (select *, case when leaks > 0 then 0.0::DOUBLE else 100.0::DOUBLE end as clean, least(repeated, 2) - 1 as d, least(cliches, 1) as c,
  case when greatest(1.0::DOUBLE, chars / 4.2::DOUBLE) > 0 then chars::DOUBLE / greatest(1.0::DOUBLE, chars / 4.2::DOUBLE) * 60 else 250.0::DOUBLE end as rate from s),
p as (select *, 100 - least(40.0::DOUBLE, 1.5::DOUBLE * greatest(0.0::DOUBLE, 200 - rate, rate - 290)) as pacing, (d > 0 or c > 0) as some_fault from q),
t as (select doc_id, meta, clean, CAST(30 * {_MILLI('diversity')} + 20 * {_MILLI('clean')} + 10 * {_MILLI('pacing')} + 20 * {_MILLI('case when some_fault then greatest(55, 80 - 10 * d - 8 * c) else 92 end')}
  + 10 * {_MILLI('case when some_fault then 72 else 91 end')} + 10 * {_MILLI('case when some_fault then 75 else 94 end')} AS BIGINT)::DOUBLE / 100000 as raw from p),
u as (select doc_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, raw)) as total, clean <> 100 as critical_failed, meta >= 3 as hard from t)
select doc_id, total, critical_failed, case when hard or critical_failed or total < 70 then 'F' when total >= 90 then 'S' when total >= 82 then 'A' when total >= 75 then 'B' else 'C' end as grade from u""",
    "benchmark_contamination": "select doc_id, item_id from documents d join benchmark b on contains(d.text, trim(b.text))",
    "duplicate_turns": f"with {SEGMENTS} select project_id, CAST(count(text) - count(distinct text) AS BIGINT) as duplicates from segs group by all",
}
