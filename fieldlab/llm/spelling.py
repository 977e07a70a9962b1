"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so a word has a short reduced form. Words that differ by one edit have reduced forms that are equal
or one edit apart. So of each word the whole neighbourhood of its reduced form (itself, each symbol deleted, each replaced by each other
symbol, each symbol inserted everywhere) is generated and joined with the reduced vocabulary; what meets is verified on the words
themselves. Reduced forms travel as 64-bit polynomial hashes, which numpy derives for a whole neighbourhood at once; a collision only
adds a pair that the verification drops.

Before the join, a bit table of fixed size that marks the reduced forms of all words drops the generated forms that no word has. It holds
`filter_bits` bits at most, whatever the vocabulary; a full table would merely drop less.

Null texts have no words. A null doc_id counts as an empty one in the hash that decides on damage. Repeated rows count as often as they
stand there. Ties between forms go to the word that is smaller in code-point order. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.reuse import stored

LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FLUSH = 1 << 18  # words that a task counts before it hands them on


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of letters, A-Z lower-cased, one byte per code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(words: Counter, doc_id: int | None, every: int) -> Iterator[tuple[bytes, int]]:
    """The words of one document, of which each `every`-th (by hash) loses a code point."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in words.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= LEAST_LETTERS:
            yield word, n


def vocabulary(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word, n): all words of docs(doc_id, text) after damage that are long and common enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    for word, n in damaged(Counter(w for w in runs_of(text) if len(w) >= LEAST_LETTERS), doc_id, every):
                        total[word] += n
                if len(total) >= _FLUSH:
                    yield out()
                    total.clear()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbols_of(words: list[str], symbols: int) -> np.ndarray:
    """One row per word (all of one length): the symbol, from 1, of each letter."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)
    return (letters * np.uint64(_BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def reduced(s: np.ndarray) -> np.ndarray:
    """The hash of each row of symbols."""
    return (s * _powers(s.shape[1])).sum(axis=1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)


def neighbourhood(s: np.ndarray, symbols: int) -> np.ndarray:
    """Per row of symbols, the hashes of everything at most one edit away; an edit that gives the same as another repeats it."""
    power, n = _powers(s.shape[1] + 1), s.shape[1]
    parts = s * power[:n]
    before = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(parts, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    after = whole - before  # of the symbols from each place on
    out = [whole, before[:, :n] + after[:, 1:] * np.uint64(_INVERSE)]
    for t in range(1, symbols + 1):
        out.append(whole - parts + np.uint64(t) * power[:n])
        out.append(before + np.uint64(t) * power + after * np.uint64(_BASE))
    return np.concatenate(out, axis=1)


def _by_length(frame: pd.DataFrame, at_once: int = 2000) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for _, same in frame.groupby(frame["word"].str.len()):
        step = max(1, at_once * 8 // len(same["word"].iat[0]))  # long words have large neighbourhoods
        for start in range(0, len(same), step):
            part = same.iloc[start : start + step]
            yield part, part["word"].tolist()


def near_words(words: DataFrame, symbols: int = 8, filter_bits: int = 1 << 26) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words(word, n) that differ by exactly one inserted, deleted or replaced code point."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, texts in _by_length(frame):
                yield part.assign(key=reduced(symbols_of(texts, symbols)).view(np.int64))

    vocabulary = stored(words.select("word", "n").mapInPandas(keyed, "word string, n long, key long"))
    bit = vocabulary.select(F.pmod("key", F.lit(filter_bits)).alias("bit"))
    marks = bit.groupBy(F.expr("bit div 32").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits"))
    marks = marks.toArrow()  # filter_bits / 32 rows at most
    table = np.zeros((filter_bits + 31) // 32, np.uint32)
    table[marks["cell"].to_numpy()] = marks["bits"].to_numpy().astype(np.uint32)
    table = vocabulary.sparkSession.sparkContext.broadcast(table)

    def generated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = table.value
        for frame in frames:
            for part, texts in _by_length(frame):
                keys = np.sort(neighbourhood(symbols_of(texts, symbols), symbols).view(np.int64), axis=1)
                at = np.mod(keys, filter_bits)
                wanted = (known[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
                wanted[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                row, column = np.nonzero(wanted)
                yield pd.DataFrame({"word": part["word"].to_numpy()[row], "n": part["n"].to_numpy()[row], "key": keys[row, column]})

    forms = vocabulary.mapInPandas(generated, "word string, n long, key long")
    met = forms.join(vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    return met.where("word != near").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by jumping from words to the roots known so far. A form is at least `LEAST_RATIO` times as common as its word, so
    there are no circles, and a chain is as long as a logarithm of the counts; every turn doubles the steps.
    """
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, every: int = 199, symbols: int = 8) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of docs(doc_id, text). `form` is its commonest near word, if that is common enough."""
    words = stored(vocabulary(docs, every))
    near = near_words(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    common = -F.col("best.less") >= LEAST_RATIO * F.col("n")
    named = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")
    ))
    found = named.join(roots(named.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
