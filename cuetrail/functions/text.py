"""Text functions as column expressions: n-grams, tokens, cleaning, slugs, payload recovery. Positions are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s is ASCII without (?U).
SPACE = r"(?U)\s"
#: Marks that are dropped before phrases are counted.
PHRASE_MARKS = "，。！？、“”《》"
#: Han, Hiragana and Katakana ranges.
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}"
#: Keys of structured payloads that must not be read aloud.
PAYLOAD_KEYS = ("supporting_scenes", "start_seconds", "end_seconds", "confidence", "segment_type", "segments")


def _runs(items: Column, n: int) -> Column:
    """Every n items in a row, joined."""
    joined = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), ""))
    return F.when(F.size(items) >= n, joined).otherwise(F.array().cast("array<string>"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def phrase_text(text: Column) -> Column:
    """Text without phrase marks and white space."""
    return F.regexp_replace(text, rf"(?U)[{PHRASE_MARKS}\s]", "")


def tokens(text: Column) -> Column:
    """Distinct tokens: ASCII words in lower and in upper case, CJK characters, and pairs and triples over the CJK characters alone."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    c = F.regexp_extract_all(t, F.lit(f"[{CJK}]"), F.lit(0))
    return F.array_distinct(F.concat(F.transform(words, F.lower), F.transform(words, F.upper), c, _runs(c, 2), _runs(c, 3)))


def latin_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower))


def clean_narration(text: Column) -> Column:
    """Text fit to be read aloud: payload structure, fences, keys, brackets, quotes and underscores go, white space becomes one space.
    Fixed values: the patterns below."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")
    spoken = F.try_parse_json(t)
    inner = F.try_variant_get(spoken, "$.text", "string")
    inside = lambda v: F.try_variant_get(v, "$.text", "string")
    several = F.array_join(F.filter(F.transform(F.try_variant_get(spoken, "$.segments", "array<variant>"), inside), lambda x: x.isNotNull() & (x != "")), " ")
    plain = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), inside(v)).otherwise(F.try_variant_get(v, "$", "string"))
    listed = F.array_join(F.transform(F.try_variant_get(spoken, "$", "array<variant>"), lambda v: F.coalesce(plain(v), F.lit(""))), " ")
    t = F.when(t.rlike(r"^[{\[]"), F.coalesce(inner, several, listed, t)).otherwise(t)
    t = F.regexp_replace(t, r"```\w*\n?|`", "")
    keyed = F.regexp_extract_all(t, F.lit("[\"']text[\"']\\s*:\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    t = F.when(F.size(keyed) > 0, F.array_join(keyed, " ")).otherwise(t)
    t = F.regexp_replace(t, "[\"']?(?:" + "|".join(PAYLOAD_KEYS) + ")[\"']?\\s*:\\s*[^,\\n]+", "")
    t = F.regexp_replace(t, r"[{}\[\]]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\\n", " "), r"\\\"|[\"']", "")  # other backslashes stay
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "_", " "), r"(?U)\s+", " "), r"^ | \z", "")


def slug(title: Column, default: str = "untitled") -> Column:
    """File-safe name: reserved characters go, white space becomes underscores."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/*?:"<>|]', ""), r"(?U)\s+", "_")
    t = F.regexp_replace(t, r"^_+|_+\z", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def normal_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"(?U)[\s_\-“”\"《》']", ""))


def any_contained(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order given."""
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(text, t)) if terms else F.array().cast("array<string>")


def recover_json(content: Column) -> Column:
    """JSON text of a model's answer: fences stripped; else the outermost object or array; null if there is none."""
    t = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+\z", "")
    t = F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"\n?\s*```\s*\z", "")).otherwise(t)
    obj, arr = F.locate("{", t), F.locate("[", t)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    inner = F.when((obj > 0) & ((arr == 0) | (obj < arr)), braces).when(arr > 0, brackets)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(t), good(inner))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def timed_references(text: Column) -> Column:
    """Lines like `[t=12.5s] (kind) what (Characters: a, b)` and `[3 s - 8 s] what` as structs start, end, kind, description, characters."""
    point, span = r"^\[t=([0-9.]+)s\]\s*(?:\(([^)]*)\))?\s*(.*?)(?:\s*\(Characters:\s*([^)]*)\))?\s*$", r"^\[([0-9.]+)\s*s\s*-\s*([0-9.]+)\s*s\]\s*(.*)$"
    def read(line):
        a, b = F.regexp_extract(line, point, 1), F.regexp_extract(line, span, 1)
        timed = F.when(a != "", F.struct(a.try_cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.regexp_extract(line, point, 2).alias("kind"), F.regexp_extract(line, point, 3).alias("description"), F.split(F.regexp_extract(line, point, 4), r",\s*").alias("characters")))
        ranged = F.when(b != "", F.struct(b.try_cast("double").alias("start_s"), F.regexp_extract(line, span, 2).try_cast("double").alias("end_s"), F.lit("").alias("kind"), F.regexp_extract(line, span, 3).alias("description"), F.array(F.lit("")).alias("characters")))
        return F.coalesce(timed, ranged)
    return F.filter(F.transform(F.split(text, "\n"), read), lambda x: x.isNotNull())


def map_hash(entries: Column) -> Column:
    """SHA-256 of a map<string, string> as JSON with sorted keys, no blanks and everything beyond ASCII escaped."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 65536
        pair = F.concat(unit(F.lit(55296) + F.shiftright(over, 10)), unit(F.lit(56320) + over.bitwiseAND(1023)))
        return F.when(code < 127, c).when(code < 65536, unit(code)).otherwise(pair)

    return F.sha2(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), ""), 256)
