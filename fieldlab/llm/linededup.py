"""Line dedup over content-defined chunks of lines, and over all passages of `window` words.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so that an inserted line moves the boundaries near
it only. A line of `long_words` words or more is a chunk by itself, wherever it stands. A chunk of two lines or more, and such a long
line, is removed where the same bytes occur before: in a document with a smaller id, or earlier in the same document. Short single
lines stay. Repeats are found by MD5; the chunks of such a group are then compared byte by byte, by the smallest and largest of them, and
a group that fails this comparison is left alone.

Chunks miss repeats whose edges are no cuts. So all words go, too, that lie in a run of `window` words which occurs before, over however
many lines, or inside a line, and whatever white space is between them; where a run overlaps its own first occurrence, the words of that
stay. To find these runs (windows) without listing all, each names as its seed the run of half its length inside it that has the smallest
hash; equal windows name equal seeds. The neighbouring windows with one seed are a stretch of text, and equal stretches are settled as a
whole. Windows are listed, and counted one by one, only where a seed has unlike stretches, and from one of each kind. Stretches and
windows are compared by 128 bits of hash.

The hashes of a whole table are shuffled once, by seed or chunk; only what repeats is written. The texts are shuffled once, by row, for
the windows, the bytes of chunks and the result alike.

Null texts stay null, empty ones empty. Rows with equal id and text are one document and get the same result. A row without id comes
after all others; among rows that differ in text only, a hash decides. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions.reuse import stored
from fieldlab.llm.common import carried, carried_type, per_row, uncarried
from fieldlab.llm.neardup import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)  # odd, one per hash of a run
_AT_ONCE = 1 << 16  # words whose hashes are taken together


def numbered(words: Iterable[str]) -> np.ndarray:
    """A hash per word, over its UTF-8 bytes in steps of eight. Words have no white space, so a blank ends each."""
    data = " ".join([*words, ""]).encode() + bytes(8)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    at = np.append(0, ends[:-1] + 1)
    left = ends - at
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = left.astype(np.uint64)
    todo = np.arange(len(h))
    while len(todo):
        step = (h[todo] * np.uint64(31) + (eights[at] & _MASKS[np.minimum(left, 8)])) * _STEP
        h[todo] = mixed(step)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


@lru_cache(16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


def rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every run of n of the numbers h: a polynomial modulo 2^64, from differences of running sums."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(base, 1 << (len(h) - 1).bit_length())
    sums = np.append(np.uint64(0), np.cumsum(h * powers[: len(h)]))
    return mixed((sums[n:] - sums[:-n]) * inverse[: len(h) - n + 1])


def least_in(h: np.ndarray, n: int) -> np.ndarray:
    """Where the first smallest of every n neighbours stands."""
    at, size = np.arange(len(h)), 1
    while size < n:
        step = min(size, n - size)
        take = h[step:] < h[:-step]
        h, at = np.where(take, h[step:], h[:-step]), np.where(take, at[step:], at[:-step])
        size += step
    return at


def hashed(texts: list[list[str]], window: int) -> tuple[np.ndarray, ...]:
    """Of texts given as words: where each begins among all words, the text that each window lies in and its place there, and the hashes
    of all runs: one of `half` words, two of `window` words. What reaches into the next text is no window.
    """
    half, sizes = (window + 1) // 2, np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    h = numbered(chain.from_iterable(texts))
    within = np.repeat(np.arange(len(texts)), sizes)
    places = np.flatnonzero(within[window - 1 :] == within[: len(within) - window + 1]) if len(h) >= window else np.zeros(0, np.int64)
    return starts, within[places], places, rolled(h, half, _BASES[0]), rolled(h, window, _BASES[1]), rolled(mixed(h ^ _STEP), window, _BASES[2])


def seeds_of(texts: list[list[str]], window: int) -> tuple[np.ndarray, ...]:
    """Per seed: its text, its hash, two hashes of its stretch (the windows that name it, put together), the first of these windows and their number."""
    starts, within, places, h, low, high = hashed(texts, window)
    if not len(places):
        return (np.zeros(0, np.int64),) * 6
    at = least_in(h, window - (window + 1) // 2 + 1)[places]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    end = np.append(begin[1:], len(at)) - 1
    n = end - begin + 1
    both = [mixed(mixed(x[places[begin]] * _STEP + x[places[end]]) + n.astype(np.uint64)).view(np.int64) for x in (low, high)]
    return within[begin], h[at[begin]].view(np.int64), *both, places[begin] - starts[within[begin]], n


def in_parts(texts: Iterable[list[str]]) -> Iterator[tuple[int, list[list[str]]]]:
    """Neighbouring texts of about _AT_ONCE words in all, with the number of the first."""
    part, total, start = [], 0, 0
    for words in texts:
        part.append(words)
        total += len(words)
        if total >= _AT_ONCE:
            yield start, part
            start, part, total = start + len(part), [], 0
    if part:
        yield start, part


def without(lines: list[str], sizes: list[int], lines_gone: set[int], gone: np.ndarray) -> str:
    """The lines, of so many words, without these lines and these words (one flag per word). A line without any word left goes; a gap inside a line is one blank."""
    out, at = [], 0
    for k, (line, n) in enumerate(zip(lines, sizes)):
        dead, at = gone[at : at + n], at + n
        if k in lines_gone or (n and dead.all()):
            continue
        if dead.any():
            spans = [m.span() for m in re.finditer(r"\S+", line)]
            edges = [0, *(np.flatnonzero(dead[1:] != dead[:-1]) + 1).tolist(), n]
            runs = [(a, b) for a, b in zip(edges, edges[1:]) if not dead[a]]
            line = " ".join(line[0 if a == 0 else spans[a][0] : len(line) if b == n else spans[b - 1][1]] for a, b in runs)
        out.append(line)
    return "\n".join(out)


def _edges(lines: list[str], sizes: list[int], mean_lines: int, long_words: int) -> list[tuple[int, int]]:
    """Line ranges [start, end) of the chunks of these lines of so many words."""
    cuts, previous = {0, len(lines)}, 0
    for i, (line, size) in enumerate(zip(lines, sizes)):
        if size >= long_words:
            cuts.update((i, i + 1))
            previous = 0
        else:
            here = zlib.crc32(line.encode())
            if zlib.crc32(previous.to_bytes(4, "little"), here) % mean_lines == 0:
                cuts.add(i + 1)
            previous = here
    edges = sorted(cuts)
    return list(zip(edges, edges[1:]))


def chunks_of(text: str, mean_lines: int = 3, long_words: int = 50) -> list[tuple[int, int]]:
    """Line ranges [start, end) of the chunks of a text."""
    lines = text.split("\n")
    return _edges(lines, [len(x.split()) for x in lines], mean_lines, long_words)


def _chunks(lines: list[str], sizes: list[int], mean_lines: int, long_words: int, least_words: int) -> list[tuple[int, str]]:
    out = []
    for n, (start, end) in enumerate(_edges(lines, sizes, mean_lines, long_words)):
        inside = sizes[start:end]
        words = sum(inside)
        if words >= long_words or (words >= least_words and len(inside) - inside.count(0) > 1):
            out.append((n, "\n".join(lines[start:end])))
    return out


def _eligible(text: str, mean_lines: int, long_words: int, least_words: int) -> list[tuple[int, str]]:
    """(chunk number, chunk) of the chunks that may be removed."""
    lines = text.split("\n")
    return _chunks(lines, [len(x.split()) for x in lines], mean_lines, long_words, least_words)


def _numbers(digests: list[bytes]) -> np.ndarray:
    """Two numbers per MD5."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T


def _table(columns: str, parts: list[tuple]) -> pd.DataFrame:
    names = columns.split()
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip((np.zeros(0, np.int64),) * len(names), *parts)))))


def _gathered(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Rows alike in `by` as one, that of their first place; the places of the others go along as lists."""
    met = frame[frame["low"].duplicated(keep=False)].sort_values([*by, "rank", "row", "at"])
    keep, rest_row, rest_at = np.ones(len(frame), bool), np.full(len(frame), None, object), np.full(len(frame), None, object)
    where, row, at = met.index.to_numpy(), met["row"].to_numpy(np.int64), met["at"].to_numpy(np.int32)
    begin = np.flatnonzero((met[by] != met[by].shift()).any(axis=1))
    end = np.append(begin[1:], len(met))[: len(begin)]
    keep[where] = False
    keep[where[begin]] = True
    for a, b in zip(begin[end - begin > 1], end[end - begin > 1]):
        rest_row[where[a]], rest_at[where[a]] = row[a + 1 : b], at[a + 1 : b]
    return frame.assign(rest_row=rest_row, rest_at=rest_at)[keep]


def _scattered(met: DataFrame) -> DataFrame:
    """The places of gathered rows, one per row; `head` marks the first of each."""
    rest = F.transform(F.arrays_zip("rest_row", "rest_at"), lambda x: F.struct(x["rest_row"].alias("row"), x["rest_at"].alias("at")))
    places = F.concat(F.array(F.struct("row", "at")), F.coalesce(rest, F.array().cast("array<struct<row:bigint,at:int>>")))
    others = [c for c in met.columns if c not in ("row", "at", "rest_row", "rest_at")]
    met = met.select(*others, F.posexplode(places).alias("head", "place"))
    return met.select(*others, (F.col("head") == 0).alias("head"), "place.row", "place.at")


_REST = "rest_row array<long>, rest_at array<int>"


def repeats(rows: DataFrame, cut: tuple[int, int, int], window: int) -> DataFrame:
    """Per place of rows(row, rank, text) that matters: (row, at, n, chunk, first, span). A chunk (number `at`) that has its MD5 in common with
    another one; a stretch that occurs before, as a span, its first word << 32 | its end; and of each kind of stretches the first one
    (windows at, at + 1 .. at + n), where their seed has several kinds.

    All places of a seed meet in one task, as a sorted stream; those of one stretch among 500 rows travel as one.
    """

    def places(frame: pd.DataFrame) -> pd.DataFrame:
        row, rank = frame["row"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
        numbers, digests, owner, out = [], [], [], []

        def split() -> Iterator[list[str]]:
            for k, text in enumerate(frame["text"]):
                lines = text.split("\n")
                parts = [x.split() for x in lines]
                for n, chunk in _chunks(lines, list(map(len, parts)), *cut):
                    numbers.append(n)
                    digests.append(hashlib.md5(chunk.encode()).digest())
                    owner.append(k)
                yield list(chain.from_iterable(parts))

        for start, part in in_parts(split()):
            k, key, low, high, at, n = seeds_of(part, window)
            out.append((key, low, high, row[start + k], rank[start + k], at, n))
        low, high = _numbers(digests)
        k = np.array(owner, np.int64)
        out.append((low, low, high, row[k], rank[k], np.array(numbers, np.int64), np.zeros(len(k), np.int64)))
        return _gathered(_table("key low high row rank at n", out), ["key", "low", "high", "n"])

    schema = f"key long, low long, high long, row long, rank long, at int, n int, {_REST}"
    sown = per_row(rows.where("text is not null and text != ''"), schema, ["row", "rank", "text"], places)
    sown = sown.withColumn("chunk", F.col("n") == 0).repartition("key")
    alike = Window.partitionBy("key", "chunk", "low", "high").orderBy("rank", "row", "at")
    met = sown.withColumns({
        "number": F.row_number().over(alike), "times": F.count("*").over(alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "first_row": F.first("row").over(alike), "first_at": F.first("at").over(alike),
    })
    met = met.withColumn("kinds", F.sum(F.when(F.col("number") == 1, 1).otherwise(0)).over(Window.partitionBy("key", "chunk")))
    lists = ~F.col("chunk") & (F.col("number") == 1) & (F.col("kinds") > 1)
    met = met.withColumn("lists", lists).where("lists or times > 1 or rest_row is not null").drop("key", "low", "high", "rank", "number", "times", "kinds")
    span = F.when(~F.col("chunk") & _later(), _span(F.col("n") + (window - 1), window))
    seen = _scattered(met).select("row", "at", "n", "chunk", (F.col("lists") & F.col("head")).alias("listed"), span.alias("span"))
    return stored(seen.where("listed or chunk or span is not null"))


def _later():
    return (F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at"))


def _span(words, window: int):
    """From the place `at`, or from the end of the first occurrence in the same text, so many words from `at` on."""
    begin = F.when(F.col("row") == F.col("first_row"), F.greatest("at", F.col("first_at") + window)).otherwise(F.col("at")).cast("long")
    return F.shiftleft(begin, 32).bitwiseOR((F.col("at") + words).cast("long"))


def confirmed(texts: DataFrame, seen: DataFrame, cut: tuple[int, int, int], window: int) -> DataFrame:
    """(row, span, removed): windows inside unlike stretches that occur before, and repeated chunks whose bytes are alike, by their numbers.

    Of equal chunks among 500 rows, the bytes are sent once.
    """
    wanted = seen.where("listed or chunk").groupBy("row").agg(
        F.collect_set(F.when(F.col("listed"), F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("n").cast("long")))).alias("listed"),
        F.collect_set(F.when(F.col("chunk"), F.col("at"))).alias("chunks"),
    )

    def places(frame: pd.DataFrame) -> pd.DataFrame:
        row, rank = frame["row"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
        out = []
        spans = [(k, x) for k, listed in enumerate(frame["listed"]) for x in listed]

        def slices() -> Iterator[list[str]]:
            for k, (text, listed) in enumerate(zip(frame["text"], frame["listed"])):
                words = text.split() if len(listed) else None
                for x in listed:
                    yield words[x >> 32 : (x >> 32) + (x & 0xFFFFFFFF) + window - 1]

        for start, part in in_parts(slices()):
            begins, within, where, _, low, high = hashed(part, window)
            k, first = np.array([(k, x >> 32) for k, x in spans[start : start + len(part)]], np.int64)[within].T
            out.append((low[where].view(np.int64), high[where].view(np.int64), row[k], rank[k], where - begins[within] + first, k * 0, k * 0 - 1))
        numbers, found, owner = [], [], []
        for k, (text, chunks) in enumerate(zip(frame["text"], frame["chunks"])):
            if len(chunks):
                lines, edges = text.split("\n"), chunks_of(text, *cut[:2])
                for n in chunks:
                    numbers.append(n)
                    found.append("\n".join(lines[slice(*edges[n])]))
                    owner.append(k)
        low, high = _numbers([hashlib.md5(x.encode()).digest() for x in found])
        k = np.array(owner, np.int64)
        codes = pd.factorize(np.array(found, object))[0]
        out.append((low, high, row[k], rank[k], np.array(numbers, np.int64), k * 0 + 1, codes))
        gathered = _gathered(_table("low high row rank at chunk code", out), ["low", "high", "chunk", "code"])
        kinds = dict(zip(codes.tolist(), found))
        return gathered.assign(chunk=gathered["chunk"] == 1, bytes=[kinds.get(x) for x in gathered["code"]])

    # `carried` is taken along unread, so that this join and that of the result share one shuffle of the texts.
    rows = texts.join(wanted, "row").withColumn("rank", _rank())
    schema = f"low long, high long, row long, rank long, at int, chunk boolean, bytes string, {_REST}"
    met = per_row(rows, schema, ["row", "rank", "text", "listed", "chunks"], places, unread=["carried"])
    alike = Window.partitionBy("low", "high", "chunk").orderBy("rank", "row", "at")
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumns({
        "first_row": F.first("row").over(alike), "first_at": F.first("at").over(alike), "same": F.min("bytes").over(whole) == F.max("bytes").over(whole),
    })
    met = met.where((_later() | F.col("rest_row").isNotNull()) & (~F.col("chunk") | F.col("same")))
    found = _scattered(met.drop("low", "high", "rank", "bytes", "same")).where(_later())
    return found.select("row", F.when(~F.col("chunk"), _span(F.lit(window), window)).alias("span"), F.when(F.col("chunk"), F.col("at")).alias("removed"))


def _rank():
    return F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))


def dedup_lines(docs: DataFrame, mean_lines: int = 3, long_words: int = 50, least_words: int = 10, carry: tuple[str, ...] = (), window: int = 51) -> DataFrame:
    """doc_id, text, n_chunks, n_removed, n_words_removed and the `carry` columns: one row per row of docs(doc_id, text), the text without
    its repeated chunks and passages. n_removed counts the chunks that go by themselves, n_words_removed all words that go.
    """
    rows = docs.select("doc_id", "text", carried(carry)).withColumn("row", F.xxhash64("doc_id", "text"))
    cut = (mean_lines, long_words, least_words)
    seen = repeats(rows.withColumn("rank", _rank()), cut, window)
    found = seen.where("span is not null").select("row", "span", F.lit(None).cast("int").alias("removed")).union(confirmed(rows, seen, cut, window))
    gone = found.groupBy("row").agg(F.collect_set("span").alias("spans"), F.collect_set("removed").alias("removed"))
    joined = rows.join(gone, "row", "left")

    def rebuild(frame: pd.DataFrame) -> pd.DataFrame:
        texts, counts, chunks, lost = [], [], [], []
        for text, removed, found in zip(frame["text"], frame["removed"], frame["spans"]):
            lines = text.split("\n") if text else []
            sizes = [len(x.split()) for x in lines]
            edges = _edges(lines, sizes, mean_lines, long_words) if text else []
            dead, n_words = set() if removed is None else set(removed), 0
            if found is not None:
                gone, starts = np.zeros(sum(sizes), bool), np.concatenate([[0], np.cumsum(sizes)])
                lines_gone = {k for n in dead for k in range(*edges[n])}
                for k in lines_gone:
                    gone[starts[k] : starts[k + 1]] = True
                step = np.zeros(len(gone) + 1, np.int64)
                np.add.at(step, found >> 32, 1)
                np.add.at(step, found & 0xFFFFFFFF, -1)
                gone |= np.cumsum(step)[:-1] > 0
                text, n_words = without(lines, sizes, lines_gone, gone), int(gone.sum())
            texts.append(text)
            counts.append(len(edges))
            chunks.append(len(dead))
            lost.append(n_words)
        out = pd.DataFrame({"doc_id": frame["doc_id"], "text": texts, "n_chunks": counts, "n_removed": chunks, "n_words_removed": lost})
        return out.assign(carried=frame["carried"])

    schema = f"doc_id long, text string, n_chunks long, n_removed long, n_words_removed long, {carried_type(rows)}"
    return uncarried(per_row(joined, schema, ["doc_id", "text", "removed", "spans", "carried"], rebuild), carry)
