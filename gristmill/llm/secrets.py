"""Secret scans with linking of credentials that come in several parts.

Strong findings stand for themselves: assignments to telling names, access identifiers, long hexadecimal runs.  Weak
parts are reported only together with what complements them: an identifier (a value assigned to a name such as
client_id or user) with a secret, a secret (an unassigned token that mixes cases and digits at random) with an
identifier, an endpoint (a URL or host) with both.  Parts complement each other when they stand in one scope: text
without a blank line between, however long.  Strong findings take part: access identifiers as identifiers, assignments and
hexadecimal runs as secrets.  A weak part overlaps no strong finding and no other weak part; endpoints come first, then
identifiers, then secrets, each from left to right.

A weak part touches nothing else, so its complement is any part of the kind in its scope: the join of intervals is one of
scopes, over sorted starts, and a text of any length costs n log n in its parts.

Positions count code points; ends are exclusive.  Rows: null text counts as empty and has no findings.  Repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
MIN_BITS = 3.5
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_IDENT = re.compile(r"\b(?:client_?id|access_?key_?id|key_?id|account|username|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s\"'<>]{4,}|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.:/-]{4,}", re.IGNORECASE | re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _random_looking(token: str) -> bool:
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and len(re.findall("[0-9]", token)) >= 2):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIN_BITS


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ground as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def weak_parts(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that don't overlap a strong finding or an earlier kind of part."""
    kinds = [
        ("endpoint", [m.span() for m in _ENDPOINT.finditer(text)]),
        ("ident", [m.span() for m in _IDENT.finditer(text)]),
        ("secret", [m.span() for m in _TOKEN.finditer(text) if _random_looking(m[0])]),
    ]
    taken, out = _merged([(a, b) for a, b, _ in strong]), []
    for kind, found in kinds:
        starts, free = [x for x, _ in taken], []
        for a, b in found:
            k = bisect_left(starts, b)  # of disjoint spans, only the last that begins before b can reach into this one
            if not k or taken[k - 1][1] <= a:
                free.append((a, b))
        out += [(a, b, kind) for a, b in free]
        taken = _merged(taken + free) if free else taken
    return out


#: what a strong finding is as a part, and what each part needs in its scope
_PART = {"access": "ident", "assign": "secret", "hex": "secret"}
_NEEDS = {"ident": ("secret",), "secret": ("ident",), "endpoint": ("ident", "secret")}


def complemented(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, weak or strong, in whose scope what complements them stands."""
    if len(spans) < 2:
        return []
    borders = [m.start() for m in _BLANK.finditer(text)]
    part = lambda kind: _PART.get(kind, kind)
    there = {(bisect_right(borders, a), part(kind)) for a, _, kind in spans}
    return [(a, b, kind) for a, b, kind in spans if all((bisect_right(borders, a), k) in there for k in _NEEDS[part(kind)])]


def linked(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The weak parts in whose scope what complements them stands."""
    weak = weak_parts(text, strong)
    return [s for s in complemented(text, [*strong, *weak]) if s[2] not in _PART] if weak else []


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str) -> tuple[int, int, int, str, str, str]:
    base = base_spans(text)
    every = base + linked(text, base)
    n = Counter(k for _, _, k in base)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(every), written(complemented(text, every))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links (those spans, strong ones too, that complement each other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                cols = list(zip(*(scan(t or "") for t in part.column(1).to_pylist()), strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string")


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
