"""Brute-force comparisons, held-out accuracy and odd inputs for the corpus operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlab.llm import decontaminate, divergence, html, language, licenses, linededup, mixing, neardup, quality, secrets
from fieldlab.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, n int, row long, id long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def words(text):
    return TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, 0.0, "x", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


def result(df):
    return {r.doc_id: r for r in df.collect()}


def rows_of(spark, name):
    return result(queries()[name](spark, FOLDER))


# Secrets


def by_hand(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m.group(2)) >= 12 else []
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_match_brute_force(spark, docs):
    for doc_id, r in rows_of(spark, "op1_secrets").items():
        base = by_hand(docs[doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


def test_secrets_follow_constants(spark):
    texts = ['part = "q8Zr1LmX0p"\nDB_PASSWORD = part + "Yt7"\ncolor = "b9fKq81LmZ0t"', '{"client_secret": "q8Zr1LmX0pYt7"}', "token token= token :", None, ""]
    got = result(secrets.find_secrets(frame(spark, texts)))
    text = texts[0]
    for piece in ("q8Zr1LmX0p", "Yt7"):
        assert f"literal:{text.index(piece)}:{text.index(piece) + len(piece)}" in got[0].spans.split(",")
    assert f":{text.index('b9fK')}:" not in got[0].spans
    assert "literal:19:32" in got[1].spans and "assign" in got[1].spans
    assert got[2].spans == got[3].spans == got[4].spans == ""


def test_constants_that_double_cost_nothing(spark):
    start = 'a = "k9Zq"\n'
    texts = [start + "a = a + a\n" * n + "db_password = a" for n in (0, 1, 60, 5000)]
    texts += ["x" * 300 + '_password = "q8Zr1LmX0pYt7"', "n" * 200000, "a-" * 100000, '--db-secret = "q8Zr1LmX0pYt7"']
    texts.append("c0 = \"k9Zq81Lm\"\n" + "".join(f"c{i} = c{i - 1} + \"w{i}\"\n" for i in range(1, 3000)) + "".join(f"key_token{i} = c2999\n" for i in range(300)))
    got = result(secrets.find_secrets(frame(spark, texts)))
    spot = lambda t, x: f"literal:{t.index(x)}:{t.index(x) + len(x)}"
    assert got[0].n_literal == 0 and all(got[i].spans.split(",")[0] == spot(texts[i], "k9Zq") and got[i].n_literal == 1 for i in (2, 3))
    assert spot(texts[4], "q8Zr1LmX0pYt7") in got[4].spans and spot(texts[7], "q8Zr1LmX0pYt7") in got[7].spans
    assert got[5].spans == got[6].spans == "" and got[8].n_literal == 3000


# Languages, quality


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = rows_of(spark, "op3_language")
    held = [r for r in got.values() if r.held_out]
    assert set(got) == set(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_length_is_exact():
    """The packed lookup against a walk through plain dictionaries."""
    import numpy as np

    sample, text = b"abracadabra abra", "cadabra xyz\nabra"
    packed, n = np.unique(language.grams(sample), return_counts=True)
    tree = language.tree(packed, n.astype(float))
    follow: dict[bytes, Counter] = {}
    padded = b"\n" * 4 + sample
    for i in range(4, len(padded)):
        for k in range(5):
            follow.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
    bits, padded = 0.0, b"\n" * 4 + text.encode()
    for i in range(4, len(padded)):
        for k in range(4, -1, -1):
            seen = follow.get(padded[i - k : i])
            if seen is None:
                continue
            total = seen.total() + len(seen)
            if padded[i] in seen:
                bits -= np.log2(seen[padded[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
        else:
            bits += 8
    assert language.lengths([text], {"x": tree})[0, 0] == pytest.approx(bits)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = result(queries()["op4_quality"](spark, "/root/testdata/sf0.01"))
    held = [r for r in got.values() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


# Benchmark, licenses, rules


def test_decontamination_matches_brute_force(spark, docs):
    items = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            items.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    for doc_id, r in rows_of(spark, "op5_decontaminate").items():
        w, hit, ids = words(docs[doc_id]), set(), set()
        for n in {len(k) for k in items}:
            for i in range(len(w) - n + 1):
                if found := items.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def test_decontamination_blocks_and_odd_items(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "beta é5 gamma"), (3, ""), (4, None), (11, "alpha BETA")], "item_id long, text string")
    df = frame(spark, ["x alpha, beta é5 gamma!", "alphabeta", None, "", "beta alpha"])
    one, many = result(decontaminate.decontaminate(df, items)), result(decontaminate.decontaminate(df, items, max_bytes=5))
    assert one == many
    assert (one[0].n_hit, one[0].items, one[0].hits) == (4, [1, 2, 11], "1:5")
    assert not any(one[i].contaminated for i in range(1, 5))
    assert not decontaminate.decontaminate(df, items.limit(0)).where("contaminated").count()


def test_licenses_match_brute_force(spark, docs):
    extra = {10**6: "cc by cc by CC-BY-SA 4.0 all rights reserved all rights reserved", 10**6 + 1: "general public license", 10**6 + 2: "", 10**6 + 3: None}
    df = spark.createDataFrame([(i, t) for i, t in {**docs, **extra}.items()], "doc_id long, text string")
    for doc_id, r in result(licenses.scan_licenses(df)).items():
        w, places, labels = words({**docs, **extra}[doc_id]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_suppression(spark):
    texts = [
        "Released under the MIT License.", "licensed under the Apache License, Version 2.0", "GNU General Public License, version 3",
        "SPDX-License-Identifier: MIT", "the mitten license", "CC BY-SA 4.0",
    ]
    got = result(licenses.scan_licenses(frame(spark, texts)))
    assert [got[i].labels for i in range(6)] == ["mit", "apache-2.0", "gpl,gpl-3", "mit", "", "cc-by,cc-by-sa-4.0"]


def test_rules_match_brute_force(spark, docs):
    extra = {10**6: "a b c a b c a", 10**6 + 1: "x\n\nx\n \nx y", 10**6 + 2: "", 10**6 + 3: None, 10**6 + 4: "a b\x0bc", 10**6 + 5: "z " * 60}
    df = spark.createDataFrame([(i, t, "en") for i, t in {**docs, **extra}.items()], "doc_id long, text string, lang string")
    for doc_id, r in result(divergence.judge(df)).items():
        text = {**docs, **extra}[doc_id] or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(three)
        again = {i + k for i, t in enumerate(three) if times[t] > 1 for k in range(3)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_jensen_shannon(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    assert [round(r[0], 9) for r in df.select(divergence.jensen_shannon(F.col("p"), F.col("q"))).collect()] == [0.0, 1.0]


def test_word_histogram_decides(spark):
    """Texts of rare words only, with ordinary characters, fail by their words; and the limits are the fences of all rows."""
    random.seed(41)
    rare = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) + "q"
    rows = []
    for i in range(80):
        share = 0.0 if i >= 72 else random.uniform(0.3, 0.5)
        rows.append((i, " ".join(random.choice(divergence.COMMON["en"]) if random.random() < share else rare() for _ in range(200)) + ".", "en"))
    got = result(divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not any(r.base_failed for r in got.values()) and all(r.word_distance is not None for r in got.values())
    assert not any(got[i].kept for i in range(72, 80)) and sum(got[i].kept for i in range(72)) > 60
    limits = []
    for c in ("char_distance", "word_distance"):
        low, high = np.quantile([r[c] for r in got.values()], [0.25, 0.75])
        limits.append(high + 1.5 * (high - low) + 1e-6)
    assert all(r.kept == (r.char_distance <= limits[0] and r.word_distance <= limits[1]) for r in got.values())
    assert all(got[i].word_distance > limits[1] for i in range(72, 80))


def test_license_numbers_without_end(spark):
    texts = ["SPDX-License-Identifier: MIT " + "7 " * 10**6, "cc by nc " + "creative commons attribution " + "international license " * 10**5 + "4.0", "SPDX-License-Identifier: MIT 3 words"]
    got = result(licenses.scan_licenses(frame(spark, texts)))
    assert got[0].labels == got[2].labels == "mit" and got[0].n_words == 10**6 + 4 and "cc-by" in got[1].labels


# Pages


def test_malformed_pages(spark):
    bodies = ["<p>a</p><![1 x]>", "<![foo[ x ]]><p>a</p>", "<p>a</p><![CDATA[ x", "<p>a</p>" + "<div" * 50, "<p>a</p><!", "<p>a</p><!-- x", "<!DOCTYPE [<p>a</p>", "<p>a</p></", "<p>a &lt; b</p> c < d"]
    rows = [(i, f"http://h{i}.example/", b) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == ["a"] * 6 and got[7] == "a" and got[8] == "a < b\nc < d"


# Pages, whole


def test_pages_against_the_articles(spark):
    """In these pages, the main text is what stands between the article's tags."""
    import html as entities

    got = {r.page_id: r for r in queries()["op6_html"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_pages_without_main_region(spark):
    notice = "this site uses small files and you agree to them by reading"
    rows = [(i, f"http://h.example/{i}", f"<body><p>{notice}</p><p>story number {i} tells of w{i} x{i} y{i} &amp; z{i}</p><nav>menu</nav></body>") for i in range(3)]
    rows += [(7, None, None), (8, "http://h.example/8", ""), (8, "http://h.example/8", ""), (9, "//other.example", f"<p>{notice}")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 7 and text[1] == "story number 1 tells of w1 x1 y1 & z1" and text[7] == text[8] == "" and text[9] == notice


def test_pages_are_parsed_and_shuffled_once(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = html.extract(spark.read.parquet(f"{FOLDER}/pages.parquet"))
        assert found.count() and found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "ReusedExchange" in plan and "blocks" in plan and "texts" not in plan
    blocks = [(2, "a b"), (0, "\u00e9 c"), (1, "menu")]
    assert html.unpacked(html.packed(blocks)) == blocks and html.unpacked(html.packed([])) == []


def test_runs_match_brute_force(spark):
    """Hosts of more pages than a batch has rows; runs that two pages share, far apart, or that one page has twice."""
    random.seed(3)
    word = lambda: f"w{random.randint(0, 40)}"
    rows = []
    for i in range(1200):
        own = [" ".join(word() for _ in range(random.randint(1, 9))) for _ in range(3)]
        often = ["all pages of this host have these words"] * (i % 3 > 0) + ["one page has this twice in itself it has"] * (2 if i == 5 else 0)
        rows.append((i, f"http://h{i % 2}.example/{i}", "".join(f"<p>{t}</p>" for t in own + often)))
    tokens = {i: [(k, t) for k, b in enumerate(re.findall("<p>(.*?)</p>", h)) for t in b.split()] for i, _, h in rows}
    pages = {}
    for i, t in tokens.items():
        for at in range(len(t) - 5):
            pages.setdefault((i % 2, *(x for _, x in t[at : at + 6])), set()).add(i)
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i, t = r.page_id, tokens[r.page_id]
        hit = {x for at in range(len(t) - 5) if len(pages[(i % 2, *(x for _, x in t[at : at + 6]))]) > 1 for x in range(at, at + 6)}
        blocks = re.findall("<p>(.*?)</p>", rows[i][2])
        sizes, covered = Counter(k for k, _ in t), Counter(t[x][0] for x in hit)
        assert (r.n_boiler, r.text) == (len(hit), "\n".join(b for k, b in enumerate(blocks) if covered[k] <= 0.5 * sizes[k])), i


# Lines


def line_removals(texts):
    """The same rule with one dictionary."""
    first, places = {}, {}
    for i, text in enumerate(texts):
        for n, chunk in linededup._eligible(text or "", 3, 50, 10):
            places.setdefault(chunk, []).append((i, n))
    return Counter(i for at in places.values() for i, _ in at[1:]), first


def test_lines_match_brute_force(spark):
    random.seed(5)
    line = lambda n: " ".join(random.choice("abcdefgh") * random.randint(1, 9) + str(random.randint(0, 999)) for _ in range(n))
    shared, long_line = [line(14) for _ in range(12)], line(70)
    texts = []
    for i in range(12):
        own = [line(8) for _ in range(5)]
        texts.append("\n".join(own[:2] + (shared if i % 2 else []) + own[2:4] + ([long_line] if i % 3 == 0 else []) + own[4:]))
    texts += [texts[0], "", None, "a\nb"]
    got = result(linededup.dedup_lines(frame(spark, texts)))
    want, _ = line_removals(texts)
    assert {i: r.n_removed for i, r in got.items()} == {i: want.get(i, 0) for i in range(len(texts))}
    assert long_line in got[0].text and not any(long_line in (got[i].text or "") for i in range(1, 13))
    assert got[14].text is None and got[13].text == "" and got[15].text == "a\nb"
    assert all(got[i].text == texts[i] for i in range(len(texts)) if not got[i].n_removed)


def words_left(texts, rows, window=51):
    """Per text, the words that stay if all windows that occur before are cut, by one dictionary of all windows."""
    first, left = {}, {}
    for i in rows:
        w = (texts[i] or "").split()
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            where, q = first.setdefault(tuple(w[at : at + window]), (i, at))
            if (where, q) != (i, at):
                start = max(at, q + window) if where == i else at
                gone[start : at + window] = [True] * (at + window - start)
        left[i] = [x for x, dead in zip(w, gone) if not dead]
    return left


def test_passages_match_brute_force(spark):
    """Passages over short lines, inside lines, wrapped anew, repeated in one text, and periodic texts: no cut of chunks meets their edges."""
    random.seed(31)
    number = iter(range(10**6))
    own = lambda n: [f"o{next(number)}" for _ in range(n)]
    shared = [own(n) for n in (51, 60, 60, 75, 120, 200, 50)]
    texts = []
    for i in range(40):
        parts = [own(random.randint(1, 30))]
        for k in random.sample(range(len(shared)), random.randint(0, 3)):
            parts += [shared[k], own(random.randint(1, 9))]
        flat, lines = [x for p in parts for x in p], []
        while flat:
            n = random.choice((4, 10, 12, 20, 30, 45))
            lines.append(" ".join(flat[:n]))
            flat = flat[n:]
        texts.append("\n".join(lines))
    texts += [" ".join(own(5) + shared[4] + own(5) + shared[4][20:100] + own(5)), "a b c " * 40, "  x " + " ".join(shared[1]) + " y  z\n", texts[3], "a b c " * 18, None, ""]
    got = result(linededup.dedup_lines(frame(spark, texts), least_words=10**9, long_words=10**9))
    want = words_left(texts, range(len(texts)))
    assert {i: (r.text or "").split() for i, r in got.items()} == want
    assert sum(len(w) for w in want.values()) + sum(r.n_words_removed for r in got.values()) == sum(len((t or "").split()) for t in texts)
    assert all(r.n_removed == 0 for r in got.values()) and got[42].text == "  x y  z\n" and got[45].text is None
    assert all(got[i].text == texts[i] for i in got if not got[i].n_words_removed)
    no_ids = spark.createDataFrame([(None, " ".join(own(9) + shared[3])), (None, " ".join(own(9) + shared[3]))], "doc_id long, text string")
    assert sorted(r.n_words_removed for r in linededup.dedup_lines(no_ids).collect()) == [0, 75]


def test_lines_shuffle_texts_once(spark, docs):
    """The texts are dealt once, for the comparison and the result; the places of one stretch travel together."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = linededup.dedup_lines(spark.read.parquet(f"{FOLDER}/documents.parquet"))
        assert {r.doc_id for r in cut.collect()} == set(docs)
        plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "ReusedExchange" in plan and plan.count("FileScan parquet [doc_id") + plan.count("FileScan parquet [text") <= 2  # the second one is named by the reuse


def test_many_copies_match_brute_force(spark):
    """More copies than a batch has rows, of a passage, a long line, whole texts and a line that one text has many times."""
    random.seed(11)
    own = lambda n: [f"w{random.randint(0, 10**9)}" for _ in range(n)]
    passage, line, whole, again = own(60), own(70), own(90), own(9)
    texts = []
    for i in range(1300):
        flat = [own(7), passage if i % 2 else [], own(5), line if i % 3 == 0 else [], *[again] * (i % 11)]
        texts.append("\n".join(" ".join(x) for x in flat if x) if i % 4 else " ".join(whole) + "\n" + " ".join(own(i % 3)))
    got = result(linededup.dedup_lines(frame(spark, texts), least_words=10**9, long_words=10**9))
    assert {i: (r.text or "").split() for i, r in got.items()} == words_left(texts, range(len(texts)))
    want, _ = line_removals(texts)
    assert {i: r.n_removed for i, r in result(linededup.dedup_lines(frame(spark, texts))).items()} == {i: want.get(i, 0) for i in range(len(texts))}


def test_word_hashes_and_first_smallest():
    words = ["a", "bb", "abcdefgh", "abcdefghi", "\u00e9" * 20, "\x00", "\x00\x00", "x" * 1000, "x" * 1001]
    h = linededup.numbered(words)
    assert len(set(h.tolist())) == len(words) and (linededup.numbered(words[::-1])[::-1] == h).all() and not len(linededup.numbered([]))
    x = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    for n in (1, 2, 3, 5, 26):
        assert (linededup.least_in(x, n) == np.arange(301 - n) + np.lib.stride_tricks.sliding_window_view(x, n).argmin(1)).all()


# Near-duplicates


def jaccard(a, b):
    def bag(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = bag(a), bag(b)
    return len(x & y) / max(1, len(x | y))


def test_near_duplicates_match_brute_force(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(120, 300))] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(random.randint(0, 4)):
            c = list(b)
            for _ in range(random.choice((1, 2, 3, 30))):
                c[random.randrange(len(c))] = random.choice(vocabulary)
            texts.append(" ".join(c))
    texts += [texts[0], texts[3], "", None, "one two", "one two", "one two three"]
    got = result(neardup.near_duplicates(frame(spark, texts)))
    near = [[j for j in range(len(texts)) if jaccard(texts[i], texts[j]) >= 0.8 or (texts[i] or "") == (texts[j] or "")] for i in range(len(texts))]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in near[i]) for i in range(len(texts))]
    assert [got[i].class_id for i in range(len(texts))] == label
    assert [i for i in got if got[i].stays] == sorted(set(label)) or {i for i in got if got[i].stays} == set(label)
    assert {r.doc_id for r in neardup.first_of_each(frame(spark, texts)).collect()} == set(label)


def test_drifting_copies_stay_linked(spark):
    """Copies of copies: many are unlike the bucket's first members and linked through others only."""
    random.seed(23)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(4):
        family = [[random.choice(vocabulary) for _ in range(150)]]
        for _ in range(39):
            c = list(random.choice(family[-6:]))
            for _ in range(random.choice((1, 2, 3))):
                c[random.randrange(len(c))] = random.choice(vocabulary)
            family.append(c)
        texts += [" ".join(c) for c in family]
    runs = [neardup.shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [(i, j) for i in label for j in range(i) if neardup.aligned(runs[j], runs[i], 0.8) >= 0.8]
    while True:
        before = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = result(neardup.near_duplicates(frame(spark, texts)))
    assert [got[i].class_id for i in range(len(texts))] == label


@pytest.mark.parametrize("copies,edits", [(150, 3), (200, 4)])
def test_star_family_without_its_original(spark, copies, edits):
    """Copies of a text that isn't there: most pairs are just below the limit, and the links that exist are spread over many buckets."""
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, texts = [random.choice(vocabulary) for _ in range(150)], []
    for _ in range(copies):
        c = list(base)
        for _ in range(edits):
            c[random.randrange(len(c))] = random.choice(vocabulary)
        texts.append(" ".join(c))
    runs = [neardup.shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [(i, j) for i in label for j in range(i) if neardup.aligned(runs[j], runs[i], 0.8) >= 0.8]
    while True:
        before = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = result(neardup.near_duplicates(frame(spark, texts)))
    assert [got[i].class_id for i in range(len(texts))] == label


def test_rarest_shingles_lose_no_pair_of_different_classes(spark):
    """The exact end alone, with classes dealt at random: every pair across classes that is similar enough is among its pairs."""
    random.seed(11)
    vocabulary, texts = [f"w{i}" for i in range(400)], []
    for _ in range(5):
        base = [random.choice(vocabulary) for _ in range(random.choice((1, 7, 60, 200)))]
        for _ in range(16):
            c = list(base)
            for _ in range(random.choice((0, 1, 2, 4, 8))):
                at = random.randrange(len(c))
                c[at : at + random.choice((0, 1))] = [random.choice(vocabulary)] * random.choice((1, 1, 3))
            texts.append(" ".join(c))
    texts = sorted(set(texts))
    label = [random.randrange(4) for _ in texts]
    runs = [neardup.shingles(t) for t in texts]
    wanted = {(j, i) for i in range(len(texts)) for j in range(i) if label[i] != label[j] and neardup.aligned(runs[j], runs[i], 0.8) >= 0.8}
    stock = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = neardup._across(stock, spark.createDataFrame(list(enumerate(label)), "id long, label long"), 0.8).collect()
    got = {(r.low, r.high) for r in found}
    assert wanted and wanted <= got and len(got) == len(found)
    assert all(label[a] != label[b] for a, b in got)


def test_alignment_is_a_longest_common_subsequence():
    import numpy as np

    random.seed(3)
    for _ in range(200):
        a = [random.randint(0, 30) for _ in range(random.randint(1, 30))]
        b = [x for x in a if random.random() > 0.06] + [random.randint(0, 30)] * random.randint(0, 2)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        m = table[-1][-1]
        exact = m / (len(a) + len(b) - m)
        got = neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == pytest.approx(exact) if exact >= 0.8 else got == 0.0


def test_a_repeated_shingle_changes_no_other_label():
    import numpy as np

    once = np.array([5, 6, 7, 8], np.uint64)
    twice = np.array([5, 6, 7, 8, 6], np.uint64)
    assert list(neardup.labelled(twice)[:4]) == list(neardup.labelled(once)) and neardup.labelled(twice)[4] not in once


def test_near_copies_without_id_are_linked(spark):
    many = [f"w{i}" for i in range(200)]
    near = " ".join([*many[:-1], "other"])
    rows = [(1, " ".join(many)), (1, " ".join(many)), (None, near), (2, "a text of its own with nothing in common")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links, r.stays) for r in got) == [(0, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True), (2, 2, 0, True)]


# Mixing, pipeline, odd inputs


def test_mixing_meets_targets(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for targets in (None, {"en": 1, "fr": 2, "de": 1, "es": 1}):
        rows = mixing.mix(df, targets).collect()
        names = ["de", "en", "es", "fr"]
        total = sum(r.n_tokens for r in rows)
        have = [sum(r.rate * r.n_tokens * r.posterior[i] for r in rows) / total for i in range(4)]
        weights = [1.0] * 4 if targets is None else [targets[n] for n in names]
        assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in rows)
        assert have == pytest.approx([w / sum(weights) for w in weights], abs=2e-3)


def test_pipeline(spark):
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, df = whole, whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, before, FOLDER).collect(), whole.schema)
        assert df.columns == whole.columns and 0.6 * before.count() < df.count() <= before.count(), name
        before = df
    ids = [r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in df.collect())


def test_odd_inputs_everywhere(spark):
    long_text = "lorem ipsum dolor sit amet consectetur " * 20000
    texts = [None, "", " \n\t", "é", "\x00\x01", "AKIA", long_text, long_text, "token =", "\n" * 500]
    odd = frame(spark, texts).union(spark.createDataFrame([(None, "no id", None, None, None, None, None, None, None, None)] * 2, SCHEMA))
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "lorem ipsum"), (None, "dolor"), (2, None)], "item_id long, text string")
    jobs = {
        "secrets": lambda d: secrets.find_secrets(d), "language": lambda d: language.identify(d), "quality": lambda d: quality.score(d, labels),
        "decontaminate": lambda d: decontaminate.decontaminate(d, items), "licenses": lambda d: licenses.scan_licenses(d), "rules": lambda d: divergence.judge(d),
        "lines": lambda d: linededup.dedup_lines(d), "near": lambda d: neardup.near_duplicates(d), "mix": lambda d: mixing.mix(d),
    }
    for name, job in jobs.items():
        got = job(odd).collect()
        assert len(got) == 12, name
        pair = [r.asDict() for r in got if r.doc_id is None]
        assert pair[0] == pair[1], name
        assert job(odd.limit(0)).collect() == [], name


def test_rules_look_words_up_in_a_set_and_count_classes_in_the_rest(spark):
    common = sorted({w for words in divergence.COMMON.values() for w in words})
    texts = ["THE cat, of. M\u00c1s m\u00e1s und! The #1 <b>\u00e9\U0001f600</b>\tof the\x0bend ", "a b c a b c", "one two three four", "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    measured = divergence.measures(docs, common)
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() and plan.count("regexp_replace(text") == 1  # one pass over the whole text, a-z taken out
    for r in measured.collect():
        text = texts[r.doc_id] or ""
        assert r.chars == [sum(map(len, re.findall(p, text))) for p in divergence.CLASSES.values()]
        assert r.word_chars == len(re.sub(divergence.SPACE, "", text)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        bare = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.rstrip(".,;:!?")) for w in re.split(divergence.SPACE, text) if w]
        assert r.common == [bare.count(w) for w in common] + [sum(w not in common for w in bare)]
        assert r.n_repeat_words == (6 if r.doc_id == 1 else 0)
