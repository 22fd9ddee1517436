"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table

#: Kinds in the order in which spans of one start are listed: base kinds, then the weak ones that need a partner.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
#: Characters between two parts of one credential, at most, where linked_spans isn't told otherwise; scans join over the whole scope.
REACH = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run of these characters is one match whatever comes after it, so asking for the length at once drops the same matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""\b(?:client|account|user|access[_-]?key)(?:[_-]?(?:id|name))?["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""", re.IGNORECASE | re.ASCII)
# Whole runs of 20 characters or more, also directly after '='; a run before '=' and more of these characters is a name, not a value.
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?!=*[A-Za-z0-9+/_-])")
_KEY = re.compile(r"access[_-]?key(?![_-]?(?:id|name))", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]{4,}""")
_BREAK = re.compile(r"\n[\x20\t]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base match, leftmost non-overlapping per kind, in code points."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _joined(at: list[tuple[int, int, int]], parts: list[tuple[int, int, int]], reach: int, own: Counter) -> set[tuple[int, int, int]]:
    """Those of `at` that lie within reach of one of the parts, both sorted. Parts that begin early enough, less those that end too early,
    are the ones within reach; own: how many of them don't count."""
    starts, ends = [x[0] for x in parts], sorted(x[2] for x in parts)
    return {p for p in at if bisect_right(starts, p[2] + reach) - bisect_left(ends, p[0] - reach) > own[p]}


def _values(names: list[tuple[int, int, int]], weak: list[tuple[int, int, int]]) -> Counter:
    """How many weak secrets overlap each of the names, identifiers whose value is no second part beside them, and the other way round."""
    out, i = Counter(), 0
    for n in names:
        while i < len(weak) and weak[i][2] <= n[0]:
            i += 1
        j = i
        while j < len(weak) and weak[j][0] < n[2]:
            out[n] += 1
            out[weak[j]] += 1
            j += 1
    return out


def _weak(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak candidates that no base span touches."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found = [(m.start(), 4, m.end()) for m in _WEAK.finditer(text)]
    return [p for p in found if not (i := bisect_left(starts, p[2])) or ends[i - 1] <= p[0]]


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int | None = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates that a complementary part joins: an interval join of the parts' spans, widened by `reach` (None: without
    bounds), inside each scope (a paragraph). A weak identifier needs a secret, a weak secret an access identifier, an endpoint both.
    The value of an identifier is no second part beside it, but for an access key, whose value is the key.
    """
    reach = len(text) if reach is None else reach
    ident = [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
    identifiers = sorted([s for s in base if s[1] == 1] + ident)
    weak = _weak(text, base) if identifiers else []
    secrets = sorted([s for s in base if s[1] != 1] + weak)
    if not identifiers or not secrets:
        return []
    endpoints = [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if not ident and not weak and not endpoints:
        return []
    own = _values([p for p in ident if not _KEY.match(text, p[0])], weak)
    cuts = [m.start() for m in _BREAK.finditer(text)]
    scoped: dict[int, tuple[list, list, list]] = {}
    for role, parts in enumerate((identifiers, secrets, endpoints)):
        for p in parts:
            scoped.setdefault(bisect_left(cuts, p[0]), ([], [], []))[role].append(p)
    out = []
    for ids, keys, ends in scoped.values():
        out += [p for p in _joined(ids, keys, reach, own) if p[1] == 3]
        out += [p for p in _joined(keys, ids, reach, own) if p[1] == 4]
        out += _joined(ends, ids, reach, own) & _joined(ends, keys, reach, own)
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int | None = None, redact: bool = False) -> DataFrame:
    """Secrets of each whole text, with the `keep` columns: n_assign, n_access, n_hex long, base_sha256 and spans string
    (kind:start:end in code points, end exclusive, by start and then kind); with redact also redacted string, in which each covered
    stretch is replaced by <secret>.

    Parts join over their whole scope unless `reach` bounds the characters between them.
    Null and empty texts have no spans (redacted: null stays null). Repeated rows stay repeated; columns that aren't kept are dropped.
    Scopes lie inside one document, so the interval join runs beside the scan and nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    rows = df.select(*keep, df[text].alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1).to_pylist():
                base = base_spans(t or "")
                spans = sorted(base + linked_spans(t or "", base, reach))
                row = (*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans))
                if redact:
                    row += (t if t is None else _redacted(t, spans),)
                found.append(row)
            columns = list(zip(*found, strict=True)) if found else [[]] * (6 if redact else 5)
            types = [pa.int64()] * 3 + [pa.string()] * (len(columns) - 3)
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"][: len(columns)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*b.schema.names[:-1], *names])

    return rows.mapInArrow(run, kept + "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string" + ", redacted string" * redact)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for s, _, e in spans:
        if s >= done:
            out += [text[done:s], "<secret>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents, single ones and those that complementary parts confirm. Null texts have none."""
    return scan(table(spark, sf_dir, "documents"))
