"""Near-duplicates by order MinHash.

Equal texts are collapsed first. Of each distinct text, the shingles of five words are labelled with their occurrence number. Each of
`bands` sketches takes the `picks` labelled shingles of smallest keyed hash and keeps them in text order; texts with an equal sketch
share a bucket. The members of a bucket are compared with its most central member (the text whose buckets hold the most texts, as an
original among its copies does), never all with all, so a bucket costs as much as it has members. Buckets whose members then belong to
several classes take leads from two of these classes, by a keyed hash, which are compared with the members of other classes, in two turns.
Buckets of up to eight members are finished at once, as all of them lead. What is still mixed then is finished exactly: two texts as similar
as wanted share one of their rarest shingles, if of each text so many are taken that the others cannot make the similarity; all pairs
of different classes that meet on such a shingle are verified. Pairs whose lengths alone rule the
similarity out are dropped before their texts are fetched. A candidate pair is verified by a banded alignment of the shingle sequences: with m aligned shingles, the
similarity is m / (a + b - m), and the band is as wide as the wanted similarity permits. Verified links are joined into classes by
passing the smallest label along.

Texts of fewer than five words are one shingle; texts without words are alike. Null counts as empty. Repeated rows are equal texts.
Distinct texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions.reuse import materialize, stored
from fieldlab.llm.common import per_row, words_of
from fieldlab.llm.stars import components

WORDS = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
SMALL = 8  # members of a bucket that is finished at once, as all of them lead
LEADS = 2  # of a larger bucket in a later turn, each from another class
TURNS = 2  # with drawn leads, before the rest is finished exactly
CELLS = 1 << 20  # of the table of shingle counts that orders shingles by rarity
_HASHES = 1 << 18  # of one text at a time


class _Known(dict):
    """Word to number, for the last words met; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        number = self[word] = zlib.crc32(word) | (zlib.adler32(word[::-1]) << 32)
        return number


_known = _Known()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """A hash per run of five words, in text order."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = mixed(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = mixed(out * np.uint64(31) + h[k : k + n])
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """The hashes with the number of their occurrence mixed in; a first occurrence keeps its hash, whether others follow or not."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return h
    at = np.arange(len(s))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(number == 0, s, mixed(s + number.astype(np.uint64) * np.uint64(_STEP)))
    return out


def sketches(h: np.ndarray, bands: int, picks: int) -> list[int]:
    """One signed 64-bit key per band for a text's shingles. Bands are hashed together, as many at a time as keep a long text's hashes
    within a few MB.
    """
    if not len(h):
        return [0] * bands
    h, seeds, out = labelled(h), [(band + 1) * _STEP & (2**64 - 1) for band in range(bands)], []
    at_once = max(1, _HASHES // len(h))
    for start in range(0, bands, at_once):
        v = mixed(h[None, :] ^ np.array(seeds[start : start + at_once], np.uint64)[:, None])
        if v.shape[1] > picks:
            v = np.take_along_axis(v, np.sort(np.argpartition(v, picks, axis=1)[:, :picks], axis=1), axis=1)
        key = np.arange(start, start + len(v)).astype(np.uint64)
        for x in v.T:
            key = mixed(key * np.uint64(31) + x)
        out += key.view(np.int64).tolist()
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """m / (len a + len b - m) for the longest common subsequence m, or 0 where that is below the wanted similarity."""
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    need = similarity * total / (1 + similarity)  # the least m
    if min(len(a), len(b)) < need - 1e-9 or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need - 1e-9:
        return 0.0
    width = int(total - 2 * need + 1e-9)  # unaligned shingles that are allowed: the band
    lead = 0
    shortest = min(len(a), len(b))
    differ = np.flatnonzero(a[:shortest] != b[:shortest])
    lead = int(differ[0]) if len(differ) else shortest
    x, y = a[lead:].tolist(), b[lead:].tolist()
    n, m = len(x), len(y)
    reach = {1: 0}
    for d in range(width + 1):
        for k in range(-d, d + 1, 2):
            i = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            reach[k] = i
            if i >= n and j >= m:
                common = (total - d) // 2
                return common / (total - common)
    return 0.0


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (low, high) of pairs(id, lead) whose texts are as similar as wanted. A pair ships the text of `id`; that of a lead goes once
    to each task that needs it.
    """
    half = pairs.join(texts, "id")
    both = half.join(texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        good, last, run = [], None, None
        for lead, text, lead_text in zip(frame["lead"], frame["text"], frame["lead_text"]):
            if lead != last:  # pairs with one lead follow each other
                last, run = lead, shingles(lead_text)
            good.append(aligned(run, shingles(text), similarity) >= similarity - 1e-12)
        found = frame.loc[good, ["id", "lead"]]
        return pd.DataFrame({"low": found.min(axis=1), "high": found.max(axis=1)})

    return stored(per_row(both, "low long, high long", ["id", "lead", "text", "lead_text"], verify))


def _apart(pairs: DataFrame) -> DataFrame:
    """(low, high, id, lead), once per pair of texts."""
    ordered = pairs.groupBy(F.least("id", "lead").alias("low"), F.greatest("id", "lead").alias("high")).agg(F.min("lead").alias("lead"))
    return ordered.withColumn("id", F.when(F.col("lead") == F.col("low"), F.col("high")).otherwise(F.col("low")))


def _sizes_permit(a: str, b: str | Column, similarity: float) -> Column:
    """Whether texts of so many shingles can be as similar as wanted: m aligned ones are at most the shorter text, m / (a + b - m) at most min / max."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(1e-6)


def linked(rows: DataFrame, similarity: float = 0.8, bands: int = 16, picks: int = 4) -> DataFrame:
    """(id, label, links) of the texts that have verified links, from rows(id, doc_id, text) where equal texts have equal ids."""

    def sketch(frame: pd.DataFrame) -> pd.DataFrame:
        once = frame.drop_duplicates("id")
        out = []
        for i, t in zip(once["id"], once["text"]):
            h = shingles(t)
            out += [(key, i, len(h)) for key in set(sketches(h, bands, picks))]
        return pd.DataFrame(out, columns=["key", "id", "size"])

    placed = stored(per_row(rows.where("text != ''"), "key long, id long, size int", ["id", "text"], sketch).distinct())
    sizes = stored(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = placed.join(sizes, "key").withColumn("weight", F.sum("n").over(Window.partitionBy("id")))  # at most one row per band in a window
    placed = members = stored(shared.select("key", "id", "size", "n", "weight"))
    wanted = stored(members.select("id").distinct())
    texts = stored(rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))  # equal ids have equal texts
    # First everyone meets the most central member of each bucket: the one whose buckets are the largest, as those of an original among its copies are.
    centre = members.groupBy("key").agg(F.max(F.struct("weight", "id", "size")).alias("lead"))
    centre = stored(centre.select("key", F.col("lead.id").alias("lead"), F.col("lead.size").alias("lead_size")))
    met = members.join(centre, "key").where((F.col("id") != F.col("lead")) & _sizes_permit("size", "lead_size", similarity))
    tested = stored(_apart(met.select("id", "lead").distinct()))
    found = _verified(texts, tested.select("id", "lead"), similarity)
    label = stored(components(found))

    def verify(pairs: DataFrame) -> None:
        nonlocal tested, found, label
        fresh = stored(pairs.join(tested.select("low", "high"), ["low", "high"], "left_anti"))
        more = _verified(texts, fresh.select("id", "lead"), similarity)
        tested, found, label = stored(tested.union(fresh)), stored(found.union(more)), stored(_merged(label, more))

    def marked() -> DataFrame:
        named = label.select("id", F.col("root").alias("label"))
        return placed.select("key", "id", "size", "n").join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))

    for turn in range(TURNS):  # buckets that still hold several classes: leads of several classes
        # Each bucket draws for itself: the buckets of a family then try different members, which finds rare links sooner.
        drawn_class, drawn_member = F.xxhash64("label", "key", F.lit(turn)), F.xxhash64("id", "key", F.lit(turn))
        slot = F.when(F.col("n") <= SMALL, F.col("id")).otherwise(F.pmod(drawn_class, F.lit(LEADS)))
        drawn = marked().groupBy("key", slot.alias("slot")).agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.min(F.struct(drawn_class.alias("by"), drawn_member.alias("then"), "id", "label", "size")).alias("lead"),
        )
        several = drawn.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("lead.id", "lead.label", "lead.size")).alias("leads"))
        several = stored(several.where("low != high").select("key", "leads"))
        placed = stored(marked().join(several, "key"))  # one row per member, with its bucket's leads beside it
        other = F.explode(F.filter("leads", lambda lead: (lead["label"] != F.col("label")) & _sizes_permit("size", lead["size"], similarity))).alias("lead")
        verify(_apart(placed.select("id", other).select("id", F.col("lead.id").alias("lead")).distinct()))
        placed = placed.where(F.col("n") > SMALL)  # all pairs of the others are tested
    verify(_across(texts, marked().select("id", "label").distinct(), similarity))
    both = found.select(F.col("low").alias("id")).union(found.select("high"))
    return label.select("id", F.col("root").alias("label")).join(both.groupBy("id").agg(F.count("*").alias("links")), "id")


def _across(texts: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """Every pair of texts of different classes that can be as similar as wanted, from named(id, label).

    With a similarity s, a text of a shingles shares at least s * a of them, so one of any a - s * a + 1 that come first in an order that
    holds for all texts. The order is by rarity, which the counts of hashed cells tell well enough: it decides about the work, not the
    result. On a shingle of several classes, the members outside its largest class meet the members of other classes. On the first
    shingle that two texts share, what follows it in the shorter remainder bounds all that they share.
    """
    texts = stored(texts.join(named, "id"))

    def cell(h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(CELLS)).astype(np.int64)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CELLS, np.int64)
        for frame in frames:
            for text in frame["text"]:
                np.add.at(n, cell(labelled(shingles(text))), 1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cell": at, "n": n[at]})

    counts = texts.select("text").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    common = np.zeros(CELLS, np.int64)
    common[counts["cell"].to_numpy()] = counts["n"].to_numpy()

    def rarest(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, np.int64),) * 5]
        for i, label, text in zip(frame["id"], frame["label"], frame["text"]):
            h = labelled(shingles(text))
            n = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1
            first = h[np.lexsort((h, common[cell(h)]))[:n]]
            same = (np.full(len(first), x, np.int64) for x in (i, label, len(h)))
            parts.append((first.view(np.int64), *same, len(h) - np.arange(len(first))))
        return pd.DataFrame(dict(zip(("token", "id", "label", "size", "rest"), map(np.concatenate, zip(*parts)))))

    rare = stored(per_row(texts, "token long, id long, label long, size long, rest long", ["id", "label", "text"], rarest))
    held = rare.groupBy("token", "label").agg(F.count("*").alias("n"))
    most = held.groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
    mixed = stored(rare.join(most.select("token", F.col("most.label").alias("most")), "token"))
    outside = mixed.where("label != most").select("token", *[F.col(c).alias(as_) for c, as_ in (("id", "lead"), ("label", "lead_label"), ("size", "lead_size"), ("rest", "lead_rest"))])
    needed = (F.col("size") + F.col("lead_size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)  # implies the permitted sizes, too
    met = mixed.join(outside, "token").where((F.col("label") != F.col("lead_label")) & (F.least("rest", "lead_rest") >= needed))
    return _apart(met.select("id", "lead").distinct())


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) of label and of the ends of these links, where the links join classes. Only their roots are passed along."""
    root = lambda end: F.coalesce(f"{end}_root", end).alias(end)
    ends = links
    for end in ("low", "high"):
        ends = ends.join(label.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    moved = stored(components(ends.select(root("low"), root("high")).distinct()))
    old = label.join(moved.select(F.col("id").alias("root"), F.col("root").alias("now")), "root", "left").select("id", F.coalesce("now", "root").alias("root"))
    return old.union(moved.join(label, "id", "left_anti"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 16, picks: int = 4) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, stays, text_id: one row per row of docs(doc_id, text).

    class_id is the smallest doc_id of the class, n_links and n_copies count the links and the rows of this text, and `stays` marks the
    rows of the class's first document. Rows without id have a class, but only those with ids name it.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))
    counted = materialize(rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies")))
    label = linked(rows, similarity, bands, picks)
    known = counted.join(label, "id", "left").select("id", "first", "n_copies", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0)).alias("n_links"))
    heads = known.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "id")).alias("head"))
    named = materialize(known.join(heads, "label").select("id", F.col("head.first").alias("class_id"), F.col("head.id").alias("head"), "n_links", "n_copies"))
    return rows.select("doc_id", "id").join(named, "id").select(
        "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "n_copies",
        ((F.col("id") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"), F.col("id").alias("text_id"),
    )


def first_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one per class, with all their columns."""
    stays = near_duplicates(docs, similarity).where("stays").select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")).distinct()
    marked = docs.withColumn("_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = marked.join(stays, (F.col("_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_id"]).drop("_id")
