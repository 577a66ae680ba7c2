"""Secret scans with multipart credential linking.

Strong spans (assignments, access identifiers, long hex) are found by their
patterns. Weak candidates - identifier-like, secret-like and endpoint spans -
are common in clean text (identifiers and secrets are the parts between the
equals signs of a run, so a key name does not hide its value), so one is reported only if its complementary parts
lie within ``reach`` code points in the same document: an identifier needs a
secret, a secret needs an identifier, an endpoint needs both. That is an
interval join inside each document, answered by counting interval starts and
ends with binary search; no pair is ever listed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import fresh

# The kinds, in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("identifier", "secret", "endpoint")
KINDS = BASE_KINDS + LINKED_KINDS
# The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

REACH = 400
_LONG_RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_PART = re.compile(r"[^=]+(?:=+\Z)?")  # equals signs at a run's end are padding
_ENDPOINT = re.compile(r"https?://[^\s\"'<>]{4,}")
_IDENTIFIER = re.compile(r"[A-Z0-9]{16,32}")
LEAST_SECRET = 32
_MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

Span = tuple[int, int, int]


def _near(starts: list[int], ends: list[int], lo: int, hi: int) -> int:
    """How many intervals touch [lo, hi]; both lists are sorted."""
    return bisect_right(starts, hi) - bisect_left(ends, lo)


def find_spans(text: str, reach: int = REACH) -> list[Span]:
    """(start, kind number, end) of every span, sorted; ends are exclusive."""
    strong = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    weak: list[Span] = []
    for run in _LONG_RUN.finditer(text):  # long hex and access spans lie inside long runs
        a, part = run.start(), run.group()
        if "AKIA" in part:
            strong += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if len(m.group()) >= LEAST_ACCESS]
        if len(part) >= LEAST_HEX:
            strong += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part) if len(m.group()) >= LEAST_HEX]
        for m in _PART.finditer(part):
            at, value = a + m.start(), m.group()
            name = value.rstrip("=")
            if not name.startswith("AKIA") and _IDENTIFIER.fullmatch(name) and not name.isalpha() and not name.isdigit():
                weak.append((at, 3, at + len(name)))
            elif len(value) >= LEAST_SECRET and all(p.search(value) for p in _MIXED):
                weak.append((at, 4, a + m.end()))
    if "://" in text:
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if weak:
        ids = [s for s in strong if s[1] == 1] + [s for s in weak if s[1] == 3]
        keys = [s for s in strong if s[1] in (0, 2)] + [s for s in weak if s[1] == 4]
        ids_at, keys_at = ((sorted(s[0] for s in x), sorted(s[2] for s in x)) for x in (ids, keys))
        for s in weak:
            lo, hi = s[0] - reach, s[2] + reach
            if (s[1] == 3 or _near(*ids_at, lo, hi)) and (s[1] == 4 or _near(*keys_at, lo, hi)):
                strong.append(s)
    return sorted(strong)


def scan(docs: DataFrame, reach: int = REACH, name: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end) in code points.

    A null or empty text has an empty array. All columns pass through (one
    called ``spans`` is replaced); repeated rows stay repeated. One narrow job
    over whole texts; memory is one Arrow batch and one text's spans.
    """
    rest = [c for c in docs.columns if c != name]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": i, "end": j} for i, k, j in find_spans(t.as_py() or "", reach)] for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, arrow)], names=[*rest, name])

    return docs.select(*rest, F.col("text").alias(fresh(rest, "_text"))).mapInArrow(
        run, T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.ArrayType(span))]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def only_base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
