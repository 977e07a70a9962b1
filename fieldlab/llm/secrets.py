"""Secret scans: assignment-aware lexing of source and configuration text.

The lexer finds `name = value` pairs (also `:=`, `:`, `=>`), where a value is a chain of literals and names joined by `+`. Names are
constants: a value that names an earlier constant takes over its text. A literal counts as a secret when its target's name is
sensitive and its text looks random enough. Three fixed token patterns (assign, access, hex) are reported besides.

Null and empty texts have no span. Repeated rows give repeated results. Spans are [start, end) in code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from fieldlab.llm.common import per_row

KINDS = ("assign", "access", "hex", "literal")

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")

PAIR = re.compile(
    r"""(?<![A-Za-z0-9_.-])(?P<quote>["']?)[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=quote)[ \t]*(?::=|=>|[:=])[ \t]*(?P<value>(?:"[^"\n]*"|'[^'\n]*'|[^\s"',;#+]+)(?:[ \t]*\+[ \t]*(?:"[^"\n]*"|'[^'\n]*'|[A-Za-z_][\w.]*))*)""",
    re.ASCII,
)
ATOM = re.compile(r""""([^"\n]*)"|'([^'\n]*)'|([^\s"',;#+]+)""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# How much each part of a target's name says about its value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "private": 0.6, "access": 0.4, "signing": 0.5, "encryption": 0.5, "key": 0.5, "api": 0.4,
    "bearer": 0.8, "salt": 0.6, "cookie": 0.5, "session": 0.4,
}
SHORT = 16  # characters of a value whose text is kept; no harmless word is longer
HARMLESS = {"example", "changeme", "none", "null", "true", "false", "placeholder", "undefined"}


def name_score(name: str) -> float:
    """0 for an ordinary name, up to 1 for one that holds a secret."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in set(parts)))


class Value:
    """What a name stands for: how often it has each character, its length, its text while that is short, and where its literals are.

    Values are joined without their texts, so that constants that double from line to line cost no more than others. Counts are floats
    and scaled down together once they are huge, which leaves the bits per character as they are.
    """

    __slots__ = ("counts", "size", "short", "parts")

    def __init__(self, counts: dict[str, float], size: float, short: str | None, parts):
        self.counts, self.size, self.short, self.parts = counts, size, short, parts

    @classmethod
    def literal(cls, text: str, span: tuple[int, int]) -> Value:
        return cls({c: float(n) for c, n in Counter(text).items()}, float(len(text)), text if len(text) <= SHORT else None, span)

    @classmethod
    def chain(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        counts: dict[str, float] = {}
        for v in values:
            for c, n in v.counts.items():
                counts[c] = counts.get(c, 0.0) + n
        size = sum(v.size for v in values)
        if size > 1e100:
            counts, size = {c: n / 1e50 for c, n in counts.items()}, size / 1e50
        short = "".join(v.short for v in values) if size <= SHORT and all(v.short is not None for v in values) else None
        return cls(counts, size, short, values)


def literals(value: Value, seen: set[int]) -> list[tuple[int, int]]:
    """The spans of a value's literals; `seen` holds the values of this text that were listed before."""
    todo, spans = [value], []
    while todo:
        v = todo.pop()
        if id(v) not in seen:
            seen.add(id(v))
            if isinstance(v.parts, tuple):
                spans.append(v.parts)
            else:
                todo += v.parts
    return spans


def text_score(value: Value) -> float:
    """0 to 1 by length and by bits per character."""
    n = value.size
    if n < 8 or (value.short is not None and value.short.lower() in HARMLESS) or any(c.isspace() for c in value.counts):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in value.counts.values() if c)
    return min(1.0, bits / 3.0) * min(1.0, n / 12)


def pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value with constants put in) of every assignment, in text order."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, Value] = {}
    found = []
    for m in PAIR.finditer(text):
        values = []
        for a in ATOM.finditer(text, m.start("value"), m.end("value")):
            group = a.lastindex
            known = constants.get(a.group(3)) if group == 3 else None
            values.append(known or Value.literal(a.group(group), a.span(group)))
        value = Value.chain(values) if values else Value({}, 0.0, "", [])
        constants[m.group("name")] = value
        found.append((m.group("name"), value))
    return found


def scan(text: str | None, threshold: float) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end) of every span, in order."""
    text = text or ""
    spans = set()
    for m in ASSIGN.finditer(text):
        if len(m.group(1)) >= 12:
            spans.add((m.start(), 0, "assign", m.end()))
    if "AKIA" in text:
        spans.update((m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18)
    spans.update((m.start(), 2, "hex", m.end()) for m in LONG_HEX.finditer(text))  # greedy runs: the long ones are the same
    listed: set[int] = set()
    found = pairs(text)
    for name, value in found:
        if (weight := name_score(name)) > 0 and weight * text_score(value) >= threshold:
            spans.update((s, 3, "literal", e) for s, e in literals(value, listed) if e > s)
    return sorted(spans)


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def find_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal: one row per row of docs(doc_id, text)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            spans = scan(text, threshold)
            counts = Counter(kind for _, _, kind, _ in spans)
            base = hashlib.sha256(written(s for s in spans if s[1] < 3).encode()).hexdigest()
            rows.append((doc_id, *(counts[k] for k in KINDS[:3]), base, written(spans), counts["literal"]))
        return pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return per_row(docs, schema, ["doc_id", "text"], work)
