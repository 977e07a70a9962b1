"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from fieldlab.llm import spelling
from fieldlab.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(texts):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return out


def rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_of_given_texts(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = rows(queries()["op11_spelling"](spark, FOLDER))
    assert len(got) == len(set(got)) > 100 and set(got) == by_hand(texts)


def test_chains_ties_accents_and_odd_rows(spark):
    random.seed(2)
    pool = ["separate"] * 700 + ["seperate"] * 130 + ["seperatte"] * 25 + ["seperattes"] * 5 + ["Été×÷ement"] * 60 + ["étéxement"] * 6 + ["abcdef"] * 5 + ["abcdeg"] * 30 + ["abcdeh"] * 30
    pool += ["".join(random.choice("abc") for _ in range(random.randint(6, 8))) for _ in range(4000)]
    random.shuffle(pool)
    texts = [(i, random.choice((" ", "1", "\n")).join(pool[i * 50 : i * 50 + 50])) for i in range(len(pool) // 50 + 1)]
    texts += [(None, "strasse straße " * 9), (1, None), (2, ""), texts[0], texts[0], (7, "x" * 100000), (8, "日本語日本語日本語 " * 9)]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = rows(spelling.variants(frame))
    assert len(got) == len(set(got)) and set(got) == by_hand(texts)
    found = {r[0]: r for r in got}
    assert found["seperattes"][2] == "separate" and found["abcdef"][1] == "abcdeg"
    assert spelling.variants(frame.limit(0)).collect() == []


def test_a_full_filter_drops_nothing(spark):
    words = spark.createDataFrame([("colour", 50), ("color", 9), ("colours", 5), ("colouur", 7), ("kolour", 6)], "word string, n long")
    pairs = {frozenset((r.word, r.near)) for r in spelling.near_words(words, filter_bits=32).collect()}
    assert pairs == {frozenset(p) for p in (("colour", "color"), ("colour", "colours"), ("colour", "colouur"), ("colour", "kolour"))}


def test_neighbourhood_is_complete():
    random.seed(4)
    for n in (1, 2, 6, 9):
        word = [random.randint(1, 3) for _ in range(n)]
        whole = {tuple(word)} | {tuple(word[:i] + word[i + 1 :]) for i in range(n)}
        whole |= {tuple(word[:i] + [t] + word[i + 1 :]) for i in range(n) for t in (1, 2, 3)} | {tuple(word[:i] + [t] + word[i:]) for i in range(n + 1) for t in (1, 2, 3)}
        want = {int(spelling.reduced(np.array([w], np.uint64))[0]) for w in whole if w} | ({0} if n == 1 else set())
        assert set(map(int, spelling.neighbourhood(np.array([word], np.uint64), 3)[0])) == want
