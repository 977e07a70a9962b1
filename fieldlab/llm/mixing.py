"""Mixing sources to target weights, in column functions only.

A classifier learned from the labelled rows (naive Bayes over hashed words, counts over all of them) gives each document soft
memberships: posteriors over the domains, tempered to `evidence` words so that they stay soft. Every document gets a rate of at least 0
(its expected number of copies) such that the expected tokens per domain, sum(rate * tokens * posterior), match the targets in least
squares. The fit is a projected gradient: each step needs one sum per domain over all documents, and a rate follows from its document's
posteriors and the steps so far. Residuals are scaled by the tokens of their domain, which bounds the curvature by 1, so the step is 1.

Null and empty texts have no token, the prior as posterior and the rate that follows from it. Rows without a domain label are not
learned from but get a rate. Without any labelled row every rate is 1. Repeated rows count each time and get equal rates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.arrays import let
from fieldlab.functions.reuse import materialize

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")


def _constant(values: list[float]) -> Column:
    """A constant array from one literal, folded by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def train(docs: DataFrame, domain: str, buckets: int, max_domains: int) -> tuple[list[str], list[float], list[list[float]]]:
    """Domain names, log priors and log shares of the word buckets; `buckets` numbers per domain come to the driver."""
    labelled = docs.select(F.col(domain).cast("string").alias("domain"), "text").where("domain is not null")
    sizes = labelled.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(max_domains + 1).collect()
    if len(sizes) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    counted = labelled.select("domain", F.explode(_words(F.col("text"))).alias("w")).groupBy("domain", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    names = [r.domain for r in sizes]
    counts = {name: [0.5] * buckets for name in names}
    for r in counted.collect():
        counts[r.domain][r.bucket] += r.n
    rows = sum(r.n for r in sizes)
    shares = [[math.log(v / total) for v in counts[name]] for name in names for total in [sum(counts[name])]]
    return names, [math.log(r.n / rows) for r in sizes], shares


def memberships(docs: DataFrame, domain: str = "lang", buckets: int = 2048, evidence: float = 4.0, max_domains: int = 64) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, posterior), and the domains in the order of the posterior."""
    names, priors, shares = train(docs, domain, buckets, max_domains)
    rows = docs.select("doc_id", "text")
    if not names:
        return rows.select("doc_id", F.size(_words(F.col("text"))).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior")), names
    tables = [_constant(s) for s in shares]

    def posterior(places: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(f"d{i}") for i in range(len(names))])
        total = F.aggregate(places, zero, lambda s, b: F.struct(*[(s[f"d{i}"] + F.get(t, b)).alias(f"d{i}") for i, t in enumerate(tables)]))
        scale = F.lit(evidence) / F.greatest(F.lit(evidence), F.size(places).cast("double"))
        logs = let(total, lambda s: F.array(*[s[f"d{i}"] * scale + F.lit(p) for i, p in enumerate(priors)]))
        shifted = let(logs, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top))))
        share = let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total)))
        return F.struct(F.size(places).cast("long").alias("n_tokens"), share.alias("posterior"))

    places = F.transform(_words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return rows.select("doc_id", let(places, posterior).alias("m")).select("doc_id", "m.n_tokens", "m.posterior"), names


def _rate(steps: list[list[float]]) -> Column:
    """The rate after these steps, from the document's posterior; it starts at 1."""
    if not steps:
        return F.lit(1.0)
    way = F.array(*[_constant(s) for s in steps])
    move = lambda g: F.aggregate(F.zip_with(F.col("posterior"), g, lambda p, v: p * v), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(way, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - move(g)))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", steps: int = 60, tolerance: float = 1e-7, evidence: float = 4.0) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate: one row per row of docs(doc_id, text, `domain`).

    targets: weight per domain, of the tokens there are now; equal weights if not given. A domain without target has weight 0.
    """
    member, names = memberships(docs, domain, evidence=evidence)
    if not names:
        return member.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), "posterior", F.lit(1.0).alias("rate"))
    member = materialize(member)
    goal = {n: 1.0 for n in names} if targets is None else {n: float(targets.get(n, 0.0)) for n in names}
    if min(goal.values()) < 0 or sum(goal.values()) <= 0:
        raise ValueError("target weights must be at least 0, and one of them above")

    def totals(rate: Column) -> list[float]:
        sums = [F.sum(rate * F.col("n_tokens") * F.col("posterior")[i]).alias(f"d{i}") for i in range(len(names))]
        return [float(v or 0.0) for v in member.agg(*sums).first()]

    size = totals(F.lit(1.0))
    wanted = [sum(size) * goal[n] / sum(goal.values()) for n in names]
    way, now = [], size
    for _ in range(steps):
        miss = [(have - want) / max(n, 1e-9) for have, want, n in zip(now, wanted, size)]
        if max((abs(have - want) for have, want in zip(now, wanted)), default=0.0) <= tolerance * max(1.0, sum(size)):
            break
        way.append([round(v, 12) for v in miss])
        now = totals(_rate(way))
    likeliest = let(F.col("posterior"), lambda p: F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(p, F.array_max(p)) - 1).cast("int")))
    return member.select("doc_id", "n_tokens", likeliest.alias("domain"), F.transform("posterior", lambda p: F.round(p, 9)).alias("posterior"), F.round(_rate(way), 6).alias("rate"))
