"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has a bit for each bit of a 64-bit hash that is set in over half of its shingles. Equal fingerprints are collapsed.
The distinct ones are dealt by a vantage-point tree: a node has a vantage fingerprint and a radius; what is within the radius belongs
inside, all else outside. By the triangle inequality two fingerprints within `reach` bits that a node parts lie both within `reach` of its
boundary. So the inner ones of that margin go outside as well, as visitors, and every pair meets in at least one shard; branches that a
fingerprint cannot reach never see it. Inside a shard the same partition goes on, down to small blocks, whose pairs are compared exactly.
A shard hands on a forest of its links, not the links, and the forests of all shards are joined into classes.

The tree is fitted on a hashed sample of the distinct fingerprints, at most `SAMPLE` per shard and `MOST_SHARDS` shards; a sample that
represents them badly makes shards uneven, never the result wrong. Fingerprints so close together that no radius parts them (all within a
few bits) are compared in blocks.

Null and empty texts and texts without words have fingerprint zero. Rows without id are linked like others, but only ids name a class;
a class without any has component_id null. Repeated rows are equal fingerprints. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldlab.functions.reuse import stored
from fieldlab.llm.common import per_row
from fieldlab.llm.stars import components

SHINGLE, SEED = 3, 42
SHARD, SAMPLE, MOST_SHARDS = 8192, 16, 1 << 16  # fingerprints wanted in a shard, sampled ones per shard, shards
BLOCK = 256
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_HASHES = 1 << 16  # of one text at a time


def shingle_hashes(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some at a time."""
    words = [w for w in text.encode().translate(_LOWER).split(b" ") if w]
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    last = min(SHINGLE, len(words)) - 1
    for a in range(0, n, _HASHES):
        b = min(n, a + _HASHES)
        yield np.array([xxh64_intdigest(joined[x:y], SEED) for x, y in zip(starts[a:b], ends[a + last : b + last])], np.uint64)


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number; bit 63 is the hash's highest."""
    total, count = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text or ""):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(h)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.int64)[0])


def parted(points: np.ndarray, reach: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage and a radius that leave little work on both sides, of some vantages and all radii; None if nothing is gained."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        outside = len(points) - np.concatenate([np.zeros(reach, np.int64), within[: 65 - reach]])
        work = within.astype(float) ** 2 + outside.astype(float) ** 2
        radius = int(work[:64].argmin())
        if best is None or work[radius] < best[0]:
            best = work[radius], vantage, radius
    return best[1:] if best[0] < 0.9 * len(points) ** 2 else None


def sides(points: np.ndarray, vantage: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points are inside, and which are outside or near enough to what is."""
    far = np.bitwise_count(points ^ vantage).astype(np.int64)
    return np.flatnonzero(far <= radius), np.flatnonzero(far > radius - reach)


def tree_of(points: np.ndarray, least: int, reach: int) -> tuple | int:
    """Nested (vantage, radius, inside, outside) with shard numbers as leaves."""
    number = iter(range(1 << 62))

    def grown(part: np.ndarray):
        cut = parted(part, reach) if len(part) > least else None
        if cut is None:
            return next(number)
        inside, outside = sides(part, *cut, reach)
        return *cut, grown(part[inside]), grown(part[outside])

    return grown(points)


def dealt(points: np.ndarray, tree: tuple | int, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in points) of every shard that gets any."""
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            yield node, at
            continue
        for child, side in zip(node[2:], sides(points[at], *node[:2], reach)):
            if len(side):
                todo.append((child, at[side]))


def _tied(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; parent points straight to the smallest member, before and after."""
    while len(a):
        x, y = parent[a], parent[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def forest(points: np.ndarray, reach: int) -> np.ndarray:
    """The number of the smallest point (by place) that each point is linked to, over links within these points."""
    parent, todo = np.arange(len(points)), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        cut = parted(points[at], reach) if len(at) > BLOCK else None
        if cut is not None:
            todo += [at[side] for side in sides(points[at], *cut, reach)]
            continue
        for start in range(0, len(at), BLOCK):
            for other in range(start, len(at), 64 * BLOCK):
                i, j = np.nonzero(np.bitwise_count(points[at[start : start + BLOCK], None] ^ points[None, at[other : other + 64 * BLOCK]]) <= reach)
                _tied(parent, at[i + start], at[j + other])
    return parent


def links(prints: DataFrame, reach: int = 2, shard: int = SHARD) -> DataFrame:
    """(low, high): links that connect what is connected, from distinct prints(fp)."""
    n = prints.count()
    shards = min(MOST_SHARDS, -(-n // shard))
    every = max(1, n // (SAMPLE * max(1, shards)))
    sample = prints.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0) if shards > 1 else prints.limit(0)
    points = np.sort(sample.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)  # about SAMPLE * shards
    tree = tree_of(np.random.default_rng(0).permutation(points), SAMPLE, reach) if len(points) else 0

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            found = list(dealt(points, tree, reach))
            if found:
                shards = np.repeat(np.array([number for number, _ in found], np.int64), [len(at) for _, at in found])
                yield pd.DataFrame({"shard": shards, "fp": points[np.concatenate([at for _, at in found])].view(np.int64)})

    def tie(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64).view(np.uint64)
        parent = forest(points, reach)
        high = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"low": points[parent[high]].view(np.int64), "high": points[high].view(np.int64)})

    return prints.mapInPandas(deal, "shard long, fp long").groupBy("shard").applyInPandas(tie, "low long, high long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: one row per row of docs(doc_id, text)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array([fingerprint(t) for t in frame["text"]], np.int64)})

    return per_row(docs, "doc_id long, fp long", ["doc_id", "text"], work)


def near_classes(docs: DataFrame, reach: int = 2, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id, n_copies (rows of this fingerprint): one row per row of docs(doc_id, text)."""
    rows = stored(fingerprints(docs))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies")))
    root = stored(components(links(prints.select("fp"), reach, shard)))
    member = stored(prints.join(root.select(F.col("id").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = stored(member.groupBy("root").agg(F.min("first").alias("component_id")))
    known = stored(member.join(named, "root").select("fp", "component_id", "n_copies"))
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
