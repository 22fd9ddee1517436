"""Texts against small dictionaries: concepts, domains, names, signatures of titles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_title


#: Bytes of the terms that one automaton holds, and terms of it; longer dictionaries are searched in blocks of these sizes.
BLOCK_BYTES, BLOCK_TERMS = 8 << 20, 200_000


def _blocks(terms: DataFrame, term: str) -> Iterator[list[str]]:
    """The different terms in blocks of bounded size."""
    block, size = [], 0
    for (t,) in terms.select(term).where(F.col(term).isNotNull()).distinct().toLocalIterator():
        n = len(t.encode())
        if block and (size + n > BLOCK_BYTES or len(block) >= BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append(t)
        size += n
    if block:
        yield block


#: Rows found, and characters of texts read, after which a task hands over what it has; a text's own rows stay together.
SLICE_ROWS, SLICE_CHARS = 4096, 4 << 20


def _search(texts: DataFrame, block: list[str], term: str, kept: list[str]) -> DataFrame:
    """The columns `kept` of texts with a row for each of the block's terms that a text contains, in the column `term`."""
    shared = texts.sparkSession.sparkContext.broadcast(block)
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept) + f", `{term}` string"
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, everywhere = Automaton(), []
        for t in shared.value:
            if t:
                automaton.add_word(t, t)
            else:
                everywhere.append(t)
        automaton.make_automaton()
        for b in batches:
            own, rows, found, read = b.select(kept), [], [], 0
            for i, text in enumerate(b.column(at)):
                text = text.as_py()
                if text is not None:
                    hits = {t for _, t in automaton.iter(text)} if len(automaton) else set()
                    rows += [i] * (len(hits) + len(everywhere))
                    found += [*hits, *everywhere]
                    read += len(text)
                if rows and (len(rows) >= SLICE_ROWS or read >= SLICE_CHARS or i == b.num_rows - 1):
                    out = own.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.string())], names=[*kept, term])
                    rows, found, read = [], [], 0

    return texts.mapInArrow(run, schema)


def contained(texts: DataFrame, terms: DataFrame, keys: tuple[str, ...], term: str, with_text: bool = True) -> DataFrame:
    """keys, text (unless left out by with_text) and the columns of terms: a row for each text and each term that it contains.

    One automaton holds all terms of a block, so a text is read once for each block, however many terms there are, and nothing is shuffled but
    by the terms that were found. Null texts and terms match nothing, an empty term every text; repeated texts stay repeated, repeated terms
    count once.
    """
    texts, terms = texts.select(*keys, "text"), terms.where(F.col(term).isNotNull()).distinct()
    found, kept = None, [*keys, "text"] if with_text else [*keys]
    for block in _blocks(terms, term):
        rows = _search(texts, block, term, kept)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return texts.limit(0).select(*kept, *(F.lit(None).cast(f.dataType).alias(f.name) for f in terms.schema))
    return found.join(terms, term).select(*kept, *terms.columns)


def hits(texts: DataFrame, cues: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, concept, cues: how many cues of each concept the text holds. cues: concept, cue."""
    return contained(texts, cues, keys, "cue", with_text=False).groupBy(*keys, "concept").agg(F.count_distinct("cue").alias("cues"))


def domain_conflicts(text_domains: DataFrame, scene_domains: DataFrame, conflicts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, text_domain, scene_domain: pairs that `conflicts` (text_domain, scene_domain) names, unless the text has the scene's domain too."""
    pairs = text_domains.withColumnRenamed("domain", "text_domain").join(scene_domains.withColumnRenamed("domain", "scene_domain"), list(keys)).join(conflicts, ["text_domain", "scene_domain"])
    own = text_domains.withColumnRenamed("domain", "scene_domain")
    return pairs.join(own, [*keys, "scene_domain"], "left_anti").select(*keys, "text_domain", "scene_domain")


def token_overlap(a: DataFrame, b: DataFrame, keys: tuple[str, ...], a_id: str, b_id: str) -> DataFrame:
    """keys, a_id, b_id, common: tokens that both hold; a, b: keys, id, tokens. By the inverted list of tokens, so pairs without a common
    token are never made."""
    x = a.select(*keys, a_id, F.explode("tokens").alias("token"))
    y = b.select(*keys, b_id, F.explode("tokens").alias("token"))
    return x.join(y, [*keys, "token"]).groupBy(*keys, a_id, b_id).agg(F.count("*").alias("common"))


def signature_contamination(texts: DataFrame, signatures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, title, signature of each signature of a different title in a text. texts: keys, own_title, text; signatures: title, signature.
    A title is the text's own if, after normalisation, it or one of its signatures holds the own title or is held by it; an own title of
    which normalisation leaves nothing is no other title."""
    own = normal_title(F.col("own_title"))
    alike = lambda name: (own != "") & (F.contains(own, name) | F.contains(name, own))
    found = contained(texts, signatures, (*keys, "own_title"), "signature", with_text=False).where(~alike(normal_title(F.col("title"))))
    # only titles that were found are held against the other signatures of theirs
    sign = normal_title(F.col("signature"))
    pairs = found.select("own_title", "title").distinct().join(signatures.select("title", "signature"), "title")
    known = pairs.where((sign != "") & alike(sign)).select("own_title", "title").distinct()
    return found.join(known, ["own_title", "title"], "left_anti").select(*keys, "title", "signature")


def quoted_titles(text: Column) -> Column:
    """Titles in 《》 marks."""
    return F.regexp_extract_all(text, F.lit("《([^》]+)》"), F.lit(1))


def title_mismatches(segments: DataFrame, titles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, title: the titles in 《》 that a script's first segment names, each as often as it does, unless without white space the title
    holds the script's own or is held by it. segments: keys, pos, text; titles: keys, own_title. Without an own title nothing is held
    against it; only the least pos is looked at, a null text there names nothing."""
    opening = segments.groupBy(*keys).agg(F.min_by("text", "pos").alias("text")).join(titles.where("own_title <> ''"), list(keys))
    named = opening.select(*keys, "own_title", F.explode(quoted_titles(F.col("text"))).alias("title"))
    bare = F.regexp_replace("title", r"(?U)\s", "")
    return named.where((bare != "") & ~F.contains("own_title", bare) & ~F.contains(bare, F.col("own_title"))).select(*keys, "title")


def title_findings(segments: DataFrame, titles: DataFrame, signatures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, check, severity, title, signatures of each script: a failure for each other title of which the whole script holds signatures
    (listed in order), one for each title that the first segment names wrongly, else one row that passes.

    segments: keys, pos, text; titles: keys, own_title (null or empty: nothing to compare with, so the script passes); signatures: title,
    signature. Texts are joined by one space in the order of pos, so a signature may run on from one segment into the next.
    """
    said = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    scripts = segments.groupBy(*keys).agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    texts = scripts.join(titles.where("own_title <> ''"), list(keys))
    foreign = signature_contamination(texts, signatures, keys).groupBy(*keys, "title").agg(F.array_sort(F.collect_set("signature")).alias("signatures"))
    none = F.array().cast("array<string>").alias("signatures")
    fail, isolation = F.lit("fail").alias("severity"), F.lit("title_isolation").alias("check")
    wrong = title_mismatches(segments, titles, keys).select(*keys, F.lit("title_mismatch").alias("check"), fail, "title", none)
    failed = foreign.select(*keys, isolation, fail, "title", "signatures").unionByName(wrong)
    clean = segments.select(*keys).distinct().join(failed.select(*keys), list(keys), "left_anti")
    return failed.unionByName(clean.select(*keys, isolation, F.lit("pass").alias("severity"), F.lit(None).cast("string").alias("title"), none))


def phase(start: Column, total: Column) -> Column:
    """Part of the story by the share of the way to `start`."""
    r = start / F.greatest(F.lit(1.0), total)
    return F.when(r < 0.18, "setup").when(r < 0.45, "inciting_incident").when(r < 0.75, "investigation").when(r < 0.90, "climax").otherwise("resolution")


def importance(text: Column, start: Column, duration: Column, total: Column, dialogue: Column, opening: Column, keyword_hits: Column, main_named: Column) -> Column:
    """Struct weight, is_main, event_type of a sequence. opening: whether the text has a cue of an everyday opening."""
    silent = (F.trim(text) == "") & (dialogue == 0)
    filler = silent & (duration < 60) & (keyword_hits == 0)
    n = F.char_length(text)
    w = F.lit(5.0) + F.when(opening & (start < 500), 2.5).otherwise(0.0) + F.least(F.lit(4.0), 0.8 * keyword_hits)
    w = w + F.when((dialogue >= 15) | (n >= 200), 3.0).when((dialogue >= 8) | (n >= 100), 2.0).when(dialogue >= 3, 1.0).otherwise(0.0)
    w = w + F.when(main_named, 0.5).otherwise(0.0) - F.when(silent, 2.0).otherwise(0.0)
    w = F.when(filler, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), w)))
    return F.struct(w.alias("weight"), (~filler & (w >= 4.5)).alias("is_main"), F.when(filler, F.lit("filler")).otherwise(phase(start, total)).alias("event_type"))
