"""License scans by ordered signature rules, in column functions only.

A text becomes words joined by two blanks, with a blank at either end of each word, so that a phrase is found at every place. Three
fixed phrases are counted and located. The rules are regular expressions over the same form: each has a keyword that must occur before
its expression is run, a priority, a weight and a label. Detections lie in word numbers; one that lies inside another of a higher
priority, or inside a longer or earlier one of the same priority, is suppressed. `labels` holds the fixed phrases' labels and those of
the detections that are left.

Null and empty texts: no word, no detection, score 0. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.arrays import let
from fieldlab.llm.common import WORD_GAPS, lower_ascii

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}  # fixed values of the contract


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # higher ones win
    weight: float
    keyword: str
    pattern: str  # over words with a blank at either end of each

    def literal(self) -> Column:
        return F.struct(
            F.lit(self.label).alias("label"), F.lit(self.priority).alias("priority"), F.lit(self.weight).alias("weight"),
            F.lit(self.keyword).alias("keyword"), F.lit(self.pattern).alias("pattern"),
        )


def phrase(*words: str) -> str:
    """Words as they stand in the scanned form; `?` after a word makes it optional."""
    return "".join(f"(?: {w[:-1]} )?" if w.endswith("?") else f" {w} " for w in words)


# Label, keyword, words of the name, versions.
FAMILIES = (
    ("mit", "mit", ("mit",), ()),
    ("apache", "apache", ("apache",), ("1 0", "1 1", "2 0")),
    ("bsd", "bsd", ("bsd",), ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("gpl", "general", ("gnu?", "general", "public"), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "lesser", ("gnu?", "lesser", "general", "public"), ("2", "2 1", "3", "3 0")),
    ("agpl", "affero", ("gnu?", "affero", "general", "public"), ("1", "3", "3 0")),
    ("mpl", "mozilla", ("mozilla", "public"), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", ("eclipse", "public"), ("1 0", "2 0")),
    ("cddl", "distribution", ("common", "development", "and", "distribution"), ("1 0", "1 1")),
    ("isc", "isc", ("isc",), ()),
    ("zlib", "zlib", ("zlib",), ()),
    ("bsl", "boost", ("boost", "software"), ("1 0",)),
    ("artistic", "artistic", ("artistic",), ("1 0", "2 0")),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("osl", "open", ("open", "software"), ("1 0", "2 0", "2 1", "3 0")),
    ("eupl", "european", ("european", "union", "public"), ("1 0", "1 1", "1 2")),
    ("ofl", "font", ("sil", "open", "font"), ("1 0", "1 1")),
    ("postgresql", "postgresql", ("postgresql",), ()),
    ("python", "python", ("python", "software", "foundation"), ("2",)),
    ("odbl", "database", ("open", "database"), ("1 0",)),
)
CC_PARTS = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_NAMES = {"by": ("attribution",), "sa": ("sharealike",), "nd": ("noderivatives",), "nc": ("noncommercial",)}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Label, keyword, words of a sentence that stands in a license's own text.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "endorse", "used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("mpl", "subject", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "dedicated to the public domain"),
    ("public-domain", "domain", "in the public domain"),
    ("cc0", "cc0", "cc0"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized copying of this file"),
    ("reserved", "reserved", "all rights reserved"),
    ("reserved", "rights", "no rights are granted"),
    ("noai", "training", "may not be used for training"),
)


def rules() -> list[Rule]:
    """Every rule: families by phrasing and version, public shorthands, and sentences of license texts."""
    out = []
    lead = r"(?: licensed  under | released  under | distributed  under | available  under | covered  by | under  the  terms  of )(?: the | a | an )?"
    close = "(?: license | licence )"
    for label, key, name, versions in FAMILIES:
        words = phrase(*name)
        out.append(Rule(label, 1, 0.7, key, words + close))
        out.append(Rule(label, 2, 0.9, key, lead + words + close))
        out.append(Rule(label, 2, 0.9, "spdx", rf" spdx  license  identifier  {label} (?: \d+ ){{0,3}}+"))
        for version in versions:
            numbered = words + (phrase(*version.split()) if "clause" in version else "")
            tail = "" if "clause" in version else "(?: version | v )?" + phrase(*version.split())
            full = f"{label}-{version.replace(' clause', '').replace(' ', '.')}"
            out.append(Rule(full, 3, 0.95, key, numbered + close + tail))
            out.append(Rule(full, 4, 1.0, key, lead + numbered + close + tail))
            out.append(Rule(full, 4, 1.0, "spdx", " spdx  license  identifier " + phrase(label, *version.split())))
    for parts in CC_PARTS:
        label = "cc-" + "-".join(parts)
        named = phrase("creative", "commons", *[w for p in parts for w in CC_NAMES[p]])
        rank = 1 + len(parts)
        out.append(Rule(label, rank, 0.8, "cc", phrase("cc", *parts)))
        out.append(Rule(label, rank, 0.9, "commons", named))
        for version in CC_VERSIONS:
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", rank + 3, 1.0, "cc", phrase("cc", *parts, *version.split())))
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", rank + 3, 1.0, "commons", named + "(?: international | license ){0,3}+" + phrase(*version.split())))
    out += [Rule(label, 5, 1.0 if label != "reserved" else 0.5, key, phrase(*text.split())) for label, key, text in SENTENCES]
    return out


def _words_in(form: Column) -> Column:
    """How many words a stretch of the scanned form has: each has its own two blanks."""
    return ((F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))) / 2).cast("long")


def _detections(form: Column, rule_list: list[Rule]) -> Column:
    """array of struct(first, minus_end, minus_priority, weight, label), sorted: what starts first, then what is longer, then what ranks higher."""
    table = F.array(*[r.literal() for r in rule_list])
    live = F.filter(table, lambda r: F.contains(form, F.concat(F.lit(" "), r["keyword"], F.lit(" "))))

    def of_rule(r: Column) -> Column:
        def places(found: Column) -> Column:
            return let(
                F.split(form, r["pattern"], -1),
                lambda between: F.aggregate(
                    F.transform(found, lambda m, i: F.struct(_words_in(F.get(between, i)).alias("skip"), _words_in(m).alias("n"))),
                    F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,minus_end:bigint,minus_priority:int,weight:double,label:string>>").alias("all")),
                    lambda s, x: F.struct(
                        (s["at"] + x["skip"] + x["n"]).alias("at"),
                        F.concat(s["all"], F.array(F.struct(
                            (s["at"] + x["skip"]).alias("first"), (-(s["at"] + x["skip"] + x["n"])).alias("minus_end"), (-r["priority"]).alias("minus_priority"),
                            r["weight"].alias("weight"), r["label"].alias("label"),
                        ))).alias("all"),
                    ),
                )["all"],
            )

        return let(F.regexp_extract_all(form, r["pattern"], F.lit(0)), places)

    return F.array_sort(F.flatten(F.transform(live, of_rule)))


def _kept(detections: Column, top: int) -> Column:
    """struct(reach, labels, weight, n) in one pass over sorted detections; reach[p] is the furthest end of a priority of p or more."""
    start = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), top + 1).alias("reach"), F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("n"),
    )

    def step(s: Column, x: Column) -> Column:
        priority, end = -x["minus_priority"], -x["minus_end"]
        free = F.get(s["reach"], priority) < end
        return F.struct(
            F.transform(s["reach"], lambda v, p: F.when(p <= priority, F.greatest(v, end)).otherwise(v)).alias("reach"),
            F.when(free, F.array_union(s["labels"], F.array(x["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(free, F.greatest(s["weight"], x["weight"])).otherwise(s["weight"]).alias("weight"),
            (s["n"] + F.when(free, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(detections, start, step)


def scan_licenses(docs: DataFrame, rule_list: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections: one row per row of docs(doc_id, text).

    A detection inside a higher one is suppressed only where the higher one starts no later, which containment implies.
    """
    rule_list = rules() if rule_list is None else rule_list
    spaced = F.regexp_replace(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), WORD_GAPS, "  ")
    rows = docs.select("doc_id", F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")).alias("form"))
    form, none = F.col("form"), F.lit(None).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for words, label in BASE.items():
        key, n = phrase(*words.split()), len(words.split())
        has = F.contains(form, F.lit(key))
        counts.append(F.when(has, ((F.length(form) - F.length(F.replace(form, F.lit(key), F.lit("")))) / len(key)).cast("long")).otherwise(0))
        firsts.append(F.when(has, _words_in(F.substring_index(form, key, 1))).otherwise(none))
        lasts.append(F.when(has, _words_in(form) - _words_in(F.substring_index(form, key, -1)) - n).otherwise(none))
        labels.append(F.when(has, F.lit(label)))
    keywords = sorted({r.keyword for r in rule_list})
    gate = F.rlike(form, F.lit(" (?:" + "|".join(keywords) + ") "))
    top = max((r.priority for r in rule_list), default=0)
    kept = F.when(gate, _kept(_detections(form, rule_list), top)) if rule_list else F.lit(None).cast("struct<labels:array<string>,weight:double,n:bigint>")
    return rows.select(
        "doc_id",
        F.when(F.length(form) > 2, _words_in(form)).otherwise(F.lit(0).cast("long")).alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        kept.alias("kept"),
    ).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))))).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.col("kept.weight"), F.lit(0.0))).alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0).cast("long")).alias("n_detections"),
    )
