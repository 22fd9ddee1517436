"""Time codes and durations as column expressions; times are seconds as double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(code: Column) -> Column:
    """H:M:S, M:S or S with a comma or a point before the fraction; null where a part is no number."""
    p = F.split(F.replace(F.trim(code), F.lit(","), F.lit(".")), ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1)).when(F.size(p) == 1, part(0))


def _clock(seconds: Column, mark: str) -> Column:
    whole = F.floor(seconds)
    millis = F.floor((seconds - whole) * 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long"), millis.cast("long"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; what is finer than a millisecond is cut off."""
    return _clock(seconds, ",")


def vtt_time(seconds: Column) -> Column:
    return _clock(seconds, ".")


def duration_text(seconds: Column) -> Column:
    """Like 1h 23m 45s; hours and minutes only from the first that is not zero."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long")
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))), F.concat(s.cast("string"), F.lit("s")))


def minutes_seconds(seconds: Column) -> Column:
    """MM:SS; minutes go on past 59."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long"))


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def speech_seconds(text: Column, least: float = 2.0, chars_per_second: float = 4.0) -> Column:
    """Estimated length of a spoken text."""
    return F.greatest(F.lit(least), F.length(text) / F.lit(chars_per_second))


def speech_minutes(chars: Column, rate: float = 250.0) -> Column:
    return chars / F.lit(rate)


def target_chars(duration: Column, rate: float = 240.0, least: int = 40) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.floor(duration / 60 * rate).cast("long"))
