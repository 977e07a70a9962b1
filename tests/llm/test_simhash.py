"""Fingerprints and classes against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldlab.llm import simhash, stars
from fieldlab.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def print_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes_of(prints, reach=2):
    label = list(range(len(prints)))
    x = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= reach)

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(prints))]


def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [print_of(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, classes_of(prints))}
    got = queries()["op13_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(want)


def test_hash_is_sparks(spark):
    r = spark.sql("select xxhash64('a b ü') as h").first()
    assert r.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b ü".encode(), 42)


def clustered(n, seed):
    """Random fingerprints, chains of near ones, and one dense ball."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 1, 2, 5, 30))):
            out.append(x)
            for _ in range(rng.choice((1, 2, 2, 3, 4))):
                x ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    return list(dict.fromkeys(out + [ball] + [ball ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]))


@pytest.mark.parametrize("shard", [60, 700, 100000])
def test_trees_find_all_links(spark, shard):
    prints = clustered(3000, shard)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard=shard)
    root = {r.id: r.root for r in stars.components(links).collect()}
    label = classes_of(prints)
    want: dict = {}
    for x, k in zip(signed, label):
        want.setdefault(k, set()).add(x)
    got: dict = {}
    for x in signed:
        got.setdefault(root.get(x, x), set()).add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
    assert all(min(v) == k for k, v in got.items())


def test_every_close_pair_shares_a_shard():
    points = np.array(clustered(1500, 5), np.uint64)
    tree = simhash.tree_of(points[::3], 16, 2)
    homes: dict = {}
    for number, at in simhash.dealt(points, tree, 2):
        for k in at.tolist():
            homes.setdefault(k, set()).add(number)
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    assert len(i) > 1000 and len({n for h in homes.values() for n in h}) > 20
    assert all(homes[a] & homes[b] for a, b in zip(i.tolist(), j.tolist()))


def test_classes_of_long_chains_and_hubs(spark):
    rng = random.Random(3)
    nodes = rng.sample(range(-(2**60), 2**60), 1200)
    pairs = [(a, b) for a, b in zip(nodes[:400], nodes[1:400])] + [(nodes[500], x) for x in nodes[501:900]] + [(nodes[901], nodes[901])]
    pairs += [tuple(rng.sample(nodes[950:], 2)) for _ in range(150)] + pairs[:50]
    got = {r.id: r.root for r in stars.components(spark.createDataFrame(pairs, "low long, high long")).collect()}
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert stars.components(spark.createDataFrame([], "low long, high long")).collect() == []


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, ""), (5, None), (4, " \n\t"), (None, "lone text here"), (None, "lone text here"), (9, many), (9, many), (3, many), (6, "A b C"), (8, "a\nb  c"), (7, "one"), (2, "\xa0")]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = simhash.near_classes(frame).collect()
    assert len(got) == len(rows) and {r.fingerprint for r in got} == {f"{print_of(t):016x}" for _, t in rows}
    by = {(r.doc_id, r.fingerprint): (r.component_id, r.n_copies) for r in got}
    zero, lone = f"{0:016x}", f"{print_of('lone text here'):016x}"
    assert by[None, zero] == by[5, zero] == by[4, zero] == (4, 3) and by[None, lone] == (None, 2)
    assert by[9, f"{print_of(many):016x}"] == (3, 3) and by[8, f"{print_of('a b c'):016x}"] == (6, 2)
    assert simhash.near_classes(frame.limit(0)).collect() == []
    assert simhash.fingerprints(frame.where(F.col("doc_id") == 9)).count() == 2
