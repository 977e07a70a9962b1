"""Quality rules by distribution divergence, in column functions only.

Each text has two histograms: characters by class, and common words by language with one bin for all other words, so that a text without
common words diverges, too. They are compared with references, one per language (the sums over all rows of that language), by
Jensen-Shannon distance (base 2, 0 to 1). The smallest distance over the languages counts. A text fails where the distance of a histogram
is above the limit of its language (of the nearest one, if it has none); a histogram with fewer than its least number of observations
gives no verdict. The limit is the upper fence of these distances over the rows of a language: the third quartile and `fence` times the distance between the quartiles,
with exact quartiles over all rows with a verdict. The fixed rules (few words, repeated three-word windows) fail a text by themselves.

Null and empty texts have no word and fail. Rows without a language do not enter a reference; without any reference only the fixed
rules count. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.arrays import let
from fieldlab.functions.reuse import stored
from fieldlab.llm.common import lower_ascii
from fieldlab.operators.quantiles import exact_quantiles

SPACE = r"[\x20\x09-\x0D]+"
# The same lists serve every language; a list may be replaced by a parameter.
COMMON = {
    "en": "the of and to in is that it was for with be".split(),
    "de": "der die und das nicht mit den ist von zu ein auch".split(),
    "fr": "le la les des et que une dans pour qui est pas".split(),
    "es": "el los las una por con para del se como más su".split(),
}
CLASSES = {"lower": r"[a-z]+", "upper": r"[A-Z]+", "digit": r"[0-9]+", "mark": r"[.,;:!?'\x22()-]+", "symbol": r"[#*$%&|<>@=+/\\_{}~^`\[\]]+", "wide": r"[^\x00-\x7F]+"}


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Windows are put in order only where one occurs twice."""
    n = F.size(words)
    keys = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    placed = lambda a: F.sort_array(F.transform(a, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))

    def covered(ordered: Column) -> Column:
        last = F.size(ordered)
        same = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when((x["key"] == F.get(ordered, i + 1)["key"]) | ((i > 0) & (x["key"] == F.get(ordered, i - 1)["key"])), x["at"]),
            ),
            lambda at: at.isNotNull(),
        )
        return F.when(last > 1, F.size(F.array_distinct(F.flatten(F.transform(same, lambda at: F.array(at, at + 1, at + 2)))))).otherwise(0)

    several = lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), let(placed(a), covered)).otherwise(0)
    return F.when(n > 3, let(keys, several)).otherwise(0).cast("long")


def _duplicates(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _times(found: Column, k: int) -> Column:
    return (F.size(found) - F.size(F.array_remove(found, k))).cast("long")


def measures(docs: DataFrame, common: list[str]) -> DataFrame:
    """The fixed counts and both histograms of each row of docs(doc_id, text, lang)."""
    rows = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE, -1), lambda w: w != ""))
    listed = F.array(*[F.lit(w) for w in common])
    bare = lambda w: F.rtrim(w, F.lit(".,;:!?"))
    likely = F.filter("words", lambda w: F.lower(bare(w)).isin(common))  # a set of constants; what follows goes through the list
    place = F.filter(F.transform(likely, lambda w: F.array_position(listed, lower_ascii(bare(w)))), lambda i: i > 0)
    # Most characters are a-z: they are taken out once, and the others are counted in the rest, which is short.
    rows = rows.withColumn("rest", F.regexp_replace("text", CLASSES["lower"], ""))
    letters = [(F.length("text") - F.length("rest")).cast("long") if k == "lower" else _removed(F.col("rest"), p) for k, p in CLASSES.items()]
    return rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _removed(F.col("rest"), SPACE)).cast("long").alias("word_chars"),
        _removed(F.col("rest"), r"[#*$%&|<>]+").alias("n_symbols"),
        _duplicates(F.col("text")).alias("n_dup_lines"),
        let(F.col("words"), _repeated).alias("n_repeat_words"),
        F.array(*letters).alias("chars"),
        let(place, lambda found: F.array(*[_times(found, k) for k in range(1, len(common) + 1)], (F.size("words") - F.size(found)).cast("long"))).alias("common"),
    )


def _shares(histogram: Column, smooth: float) -> Column:
    return let(
        F.aggregate(histogram, F.lit(0.0), lambda s, v: s + v + smooth),
        lambda total: F.transform(histogram, lambda v: (v + smooth) / F.greatest(total, F.lit(1e-300))),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the divergence in bits, between two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def fences(rows: DataFrame, name: str, languages: int, fence: float) -> list[float | None]:
    """The upper fence of the distances in each language; None where it has no distance."""
    near = rows.select(F.col(name)["lang"].alias("lang"), F.col(name)["distance"].alias("distance")).where("lang is not null")
    quartiles = {(r["lang"], r["prob"]): r["quantile"] for r in exact_quantiles(near, ["lang"], "distance", [0.25, 0.75]).collect()}
    upper = [(quartiles.get((k + 1, 0.25)), quartiles.get((k + 1, 0.75))) for k in range(languages)]
    return [None if high is None else high + fence * (high - low) for low, high in upper]


def references(measured: DataFrame, common: int) -> DataFrame:
    """One row: an array with the summed histograms of every language."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(common)]
    by_lang = measured.where("lang is not null").groupBy("lang").agg(*sums)
    pair = F.struct(F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("chars"), F.array(*[F.col(f"w{i}") for i in range(common)]).alias("common"))
    return by_lang.select("lang", pair.alias("pair"))


def judge(docs: DataFrame, fence: float = 1.5, least_chars: int = 200, least_words: int = 20, max_languages: int = 1000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance per row of docs.

    References are one row per language; more than `max_languages` of them are refused.
    """
    common = sorted({w for words in COMMON.values() for w in words})
    measured = stored(measures(docs, common))
    table = references(measured, len(common) + 1).orderBy("lang").limit(max_languages + 1).collect()
    if len(table) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")

    def nearest(name: str, smooth: float) -> Column:
        if not table:
            return F.lit(None).cast("struct<distance: double, lang: int>")
        known = []
        for r in table:
            total = sum(v + smooth for v in r["pair"][name]) or 1.0
            known.append(F.array(*[F.lit((v + smooth) / total) for v in r["pair"][name]]))
        found = let(_shares(F.col(name), 0.0), lambda p: F.transform(F.array(*known), lambda q: jensen_shannon(p, q)))
        own = F.array_position(F.array(*[F.lit(r["lang"]) for r in table]), F.col("lang"))
        place = lambda d: F.coalesce(own, F.array_position(d, F.array_min(d))).cast("int")
        return let(found, lambda d: F.struct(F.array_min(d).alias("distance"), place(d).alias("lang")))

    count = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, v: s + v)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(count("chars") >= least_chars, nearest("chars", 0.0)).alias("char"),
        F.when(count("common") >= least_words, nearest("common", 0.5)).alias("word"),
    ))

    def odd(name: str) -> Column:
        if not table:
            return F.lit(False)
        limits = F.array(*[F.lit(x).cast("double") for x in fences(rows, name, len(table), fence)])
        return F.coalesce(F.col(name)["distance"] > F.get(limits, F.col(name)["lang"] - 1) + 1e-6, F.lit(False))

    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd("char") & ~odd("word")).alias("kept"),
        F.col("char")["distance"].alias("char_distance"), F.col("word")["distance"].alias("word_distance"),
    )
