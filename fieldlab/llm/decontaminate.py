"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, each text scanned once.

Texts become words (see `common.words_of`) joined by single spaces. Every window of `window` words of an item is a key of the
automaton, an item of fewer words is one key, and an item without words has none. A match at a character of the normalised text is
mapped back to word numbers. Items with equal ids count as one; items without id are left out.

A benchmark above `max_bytes` is cut by item into several automata, and each text is passed through one after the other; what is
shipped at a time stays bounded, and the result is the same.

Null and empty texts: no word, not contaminated. An empty benchmark hits nothing. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import carried, carried_type, per_row, uncarried, words_of

_BUILT: dict[str, tuple] = {}


def windows_of(text: str | None, window: int) -> list[bytes]:
    words = words_of(text or "")
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _automaton(items: list[tuple[int, str]], window: int):
    owners: dict[bytes, set[int]] = {}
    for item, text in items:
        for key in windows_of(text, window):
            owners.setdefault(key, set()).add(item)
    machine = ahocorasick.Automaton()
    for key, ids in owners.items():
        machine.add_word(f" {key.decode()} ", (key.count(b" ") + 1, len(key.decode()) + 2, tuple(ids)))
    if owners:
        machine.make_automaton()
    return machine if owners else None


def _machines(token: str, parts, window: int) -> tuple:
    """The automata of one call, built once per Python worker."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = tuple(m for p in parts if (m := _automaton(p.value, window)))
    return _BUILT[token]


def _scan(text: str | None, machines) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Word count, hit word ranges and items with hits of one text."""
    words = words_of(text or "")
    spans, items = [], set()
    if words:
        line = f" {b' '.join(words).decode()} "
        for machine in machines:
            gaps = None
            for end, (n, chars, ids) in machine.iter(line):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
                first = int(np.searchsorted(gaps, end - chars + 1))
                spans.append((first, first + n))
                items.update(ids)
    return len(words), spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 64 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits and the `carry` columns: one row per row of docs(doc_id, text)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // max_bytes))
    parts = [
        spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()])
        for b in range(blocks)
    ]

    token = uuid.uuid4().hex

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows, machines = [], _machines(token, parts, window)
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            n_words, spans, found = _scan(text, machines)
            covered, reach, merged = 0, 0, []
            for start, end in sorted(spans):
                covered += max(0, end - max(start, reach))
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
                reach = max(reach, end)
            names = sorted(str(i) for i in found)
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            rows.append((doc_id, n_words, covered, len(names), digest, covered > 0, sorted(found), ",".join(f"{s}:{e}" for s, e in merged)))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"]).assign(carried=frame["carried"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, hits string"
    rows = docs.select("doc_id", "text", carried(carry))
    return uncarried(per_row(rows, f"{schema}, {carried_type(rows)}", rows.columns, work), carry)
