"""Language identification by partial matching (PPM).

One variable-order context tree of bytes per language: for contexts of 4, 3, 2, 1 and 0 bytes, how often each byte followed. A byte
costs -log2 of its share in the longest context that knows it, plus the price of an escape (distinct / (total + distinct), method C)
from each longer context. Statistics are frozen after training; a text's code length is the exact sum over all its bytes, and the
language with the shortest code wins (ties: the first by name).

The trees are learned from a sample of labelled rows: by hash of the text, about `train_bytes` per language, so that the broadcast
trees are bounded. Texts are scored whole. A text is lower-cased and starts after four line ends.

Null texts and texts without a letter: `und`, score 0. No labelled row: every text is `und`. Repeated rows give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import held_out, per_row

ORDER = 4
LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 22


def grams(data: bytes) -> np.ndarray:
    """Each byte with the four before it, packed in 40 bits."""
    b = np.frombuffer(b"\n" * ORDER + data, np.uint8).astype(np.int64)
    packed = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        packed = (packed << 8) | b[k : k + len(data)]
    return packed


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over labelled(lang, text), counted in each task first."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, part in frame.groupby("lang"):
            gram, n = np.unique(np.concatenate([grams(t.lower().encode()) for t in part["text"]]), return_counts=True)
            out.append(pd.DataFrame({"lang": lang, "gram": gram, "n": n.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "gram": [], "n": []})

    return per_row(labelled, "lang string, gram long, n long", ["lang", "text"], work).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique))


def tree(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per order, longest first: known (context, byte) keys and their bits; contexts and the bits of an escape."""
    levels = []
    for k in range(ORDER, -1, -1):
        keys, count = _summed(gram & ((1 << (8 * (k + 1))) - 1), n)
        contexts, first = np.unique(keys >> 8, return_index=True)
        distinct = np.diff(np.append(first, len(keys))).astype(float)
        total = np.add.reduceat(count, first)
        place = np.searchsorted(contexts, keys >> 8)
        levels.append((keys, -np.log2(count / (total + distinct)[place]), contexts, -np.log2(distinct / (total + distinct))))
    return levels


def code_bits(levels, gram: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram under one language."""
    bits, todo = np.zeros(len(gram)), np.arange(len(gram))
    for level, (keys, cost, contexts, escape) in enumerate(levels):
        key = gram[todo] & ((1 << (8 * (ORDER + 1 - level))) - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[at] == key
        bits[todo[known]] += cost[at[known]]
        todo, context = todo[~known], key[~known] >> 8
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        bits[todo] += np.where(contexts[at] == context, escape[at], 0.0)
    bits[todo] += 8.0
    return bits


def train(docs: DataFrame, train_bytes: int = 2_000_000) -> dict[str, list]:
    """lang -> tree, from the rows of docs(doc_id, text, lang) outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and text != ''").where(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(min(1.0, train_bytes / r.b))) for r in sizes])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)
    table = gram_counts(sample).toPandas()
    return {str(lang): tree(part["gram"].to_numpy(np.int64), part["n"].to_numpy(float)) for lang, part in sorted(table.groupby("lang"), key=lambda x: x[0])}


def lengths(texts: list[str], trees: dict[str, list]) -> np.ndarray:
    """Code length in bits, text by language. Grams that recur in a batch are looked up once; long texts go in pieces."""
    out = np.zeros((len(texts), len(trees)))
    batch, owner, held = [], [], 0

    def flush():
        nonlocal batch, owner, held
        if batch:
            codes, unique = pd.factorize(np.concatenate(batch))
            of = np.repeat(owner, [len(g) for g in batch])
            for j, levels in enumerate(trees.values()):
                out[:, j] += np.bincount(of, weights=code_bits(levels, unique)[codes], minlength=len(texts))
        batch, owner, held = [], [], 0

    for i, text in enumerate(texts):
        packed = grams(text.lower().encode())
        for start in range(0, len(packed), _PIECE):
            batch.append(packed[start : start + _PIECE])
            owner.append(i)
            held += len(batch[-1])
            if held >= _PIECE:
                flush()
    flush()
    return out


def identify(docs: DataFrame, labelled: DataFrame | None = None, train_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: one row per row of docs(doc_id, text). score: posterior per 16 bytes of text."""
    trees = train(docs if labelled is None else labelled, train_bytes)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        names, texts = list(model.value), [t or "" for t in frame["text"]]
        lang, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        readable = [i for i, t in enumerate(texts) if LETTER.search(t)]
        if names and readable:
            length = lengths([texts[i] for i in readable], model.value)
            best = length.argmin(axis=1)
            for row, i in enumerate(readable):
                lang[i], bits[i] = names[best[row]], length[row, best[row]]
                scale = 16 / max(16, len(texts[i].encode()))
                score[i] = 1 / np.exp2(-(length[row] - bits[i]) * scale).sum()
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": lang, "score": score, "bits": bits})

    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return per_row(rows, "doc_id long, held_out boolean, lang_pred string, score double, bits double", ["doc_id", "held_out", "text"], work)
