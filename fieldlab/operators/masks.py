"""Patch masks for masked-image training, as array expressions on one row per sample.

A grid has `rows` x `cols` patches, numbered row-major. Samples of one batch share a block size. Rejection sampling is a fixed list
of keyed attempts from which the first valid one is taken, so a mask is a pure function of (seed, batch, sample).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlab.functions.arrays import indices, let
from fieldlab.functions.keyed import digest, uniform

# Attempts before a constraint is relaxed; patches a block must exceed.
ATTEMPTS = 20
MIN_KEEP = 4


def block_size(u: Column, rows: int, cols: int, scale: Sequence[float], aspect: Sequence[float]) -> Column:
    """struct(h, w) of a block: one draw sets both the covered share and the aspect ratio."""
    keep = F.greatest(F.lit(1), F.floor(rows * cols * (scale[0] + u * (scale[1] - scale[0]))))
    ratio = aspect[0] + u * (aspect[1] - aspect[0])
    h = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.rint(F.sqrt(keep * ratio)).cast("int")), F.lit(rows - 1)))
    w = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.rint(F.sqrt(keep / ratio)).cast("int")), F.lit(cols - 1)))
    return F.struct(h.alias("h"), w.alias("w"))


def batch_block_sizes(samples: DataFrame, rows: int, cols: int, scale, aspect, seed: int = 0, purpose: str = "target") -> DataFrame:
    size = block_size(uniform(seed, purpose, F.col("batch")), rows, cols, scale, aspect)
    return samples.select("batch").distinct().select("batch", size["h"].alias("block_h"), size["w"].alias("block_w"))


def _rectangle(key: Sequence, attempt: Column, size: Column, rows: int, cols: int) -> Column:
    h, w = size["h"], size["w"]
    top = F.floor(uniform(*key, "top", attempt) * (rows - h + 1)).cast("int")
    left = F.floor(uniform(*key, "left", attempt) * (cols - w + 1)).cast("int")
    return let(top * cols + left, lambda c: F.transform(indices(h * w), lambda k: (c + F.floor(k / w) * cols + k % w).cast("int")))


def _first_valid(key, size: Column, rows: int, cols: int, blocked: Column | None, first: int) -> Column:
    """struct(rect, kept) of the first attempt that keeps more than MIN_KEEP patches, else null."""

    def attempt(a: Column, size: Column, blocked: Column | None) -> Column:
        return let(
            _rectangle(key, a, size, rows, cols),
            lambda r: F.struct(r.alias("rect"), (r if blocked is None else F.array_except(r, blocked)).alias("kept")),
        )

    def valid(t: Column) -> Column:
        return F.size(t["kept"]) > MIN_KEEP

    if blocked is None:
        return let(size, lambda s: let(attempt(F.lit(first), s, None), lambda t: F.when(valid(t), t)))
    tries = F.sequence(F.lit(first), F.lit(first + ATTEMPTS - 1))
    none = F.lit(None).cast("struct<rect: array<int>, kept: array<int>>")

    def search(s: Column, b: Column) -> Column:
        """Attempts after the first valid one are not computed."""
        return F.aggregate(
            tries, none, lambda found, a: F.when(found.isNotNull(), found).otherwise(let(attempt(a, s, b), lambda t: F.when(valid(t), t)))
        )

    return let(size, lambda s: let(blocked, lambda b: search(s, b)))


def target_masks(
    samples: DataFrame, rows: int, cols: int, n_targets: int = 4, scale=(0.15, 0.2), aspect=(0.75, 1.5),
    disjoint: bool = False, seed: int = 0,
) -> DataFrame:
    """Add `targets`: n_targets patch lists per sample, from rows (batch, sample_id).

    Disjoint blocks avoid the earlier ones for 20 attempts, then place freely. Lists are cut to the shortest of the batch. A block
    too small to ever be valid is an error.
    """
    size = block_size(uniform(seed, "target", F.col("batch")), rows, cols, scale, aspect)
    df = samples
    too_small = F.raise_error(F.lit(f"block of at most {MIN_KEEP} patches can never be valid"))
    for t in range(n_targets):
        key = (seed, "target", F.col("batch"), F.col("sample_id"), t)
        free = _first_valid(key, size, rows, cols, None, ATTEMPTS + 1 if disjoint and t else 1)
        if disjoint and t:
            free = F.coalesce(_first_valid(key, size, rows, cols, F.col("_blocked"), 1), free)
        df = df.withColumn(f"_t{t}", free)
        if disjoint:
            rect = F.col(f"_t{t}.rect")
            df = df.withColumn("_blocked", rect if t == 0 else F.array_union("_blocked", rect))
    lists = [F.coalesce(F.col(f"_t{t}.kept"), too_small.cast("array<int>")) for t in range(n_targets)]
    df = df.select(*samples.columns, F.array(*lists).alias("targets"))
    if disjoint:
        shortest = F.min(F.array_min(F.transform("targets", F.size))).over(W.partitionBy("batch"))
        df = df.withColumn("_len", shortest)
        df = df.withColumn("targets", F.transform("targets", lambda t: F.slice(t, F.lit(1), F.col("_len"))))
    return df.select(*samples.columns, "targets")


def context_masks(
    masked: DataFrame, rows: int, cols: int, n_targets: int = 4, scale=(0.85, 1.0), allow_overlap: bool = False, seed: int = 0
) -> DataFrame:
    """Add `context`: one large block without the target patches.

    The constraint loosens by one target after every 20 failed attempts. Lists are cut to the shortest of the batch.
    """
    size = block_size(uniform(seed, "context", F.col("batch")), rows, cols, scale, (1.0, 1.0))
    block = _context_block((seed, "context", F.col("batch"), F.col("sample_id")), size, rows, cols, 0 if allow_overlap else n_targets)
    return _cut_to_shortest(masked.withColumn("context", block), "context")


def _context_block(key: tuple, size: Column, rows: int, cols: int, n_targets: int) -> Column:
    levels = []
    for level in range(n_targets):
        blocked = F.flatten(F.slice("targets", F.lit(1), F.lit(n_targets - level)))
        levels.append(_first_valid(key, size, rows, cols, blocked, 1 + level * ATTEMPTS)["kept"])
    free = _first_valid(key, size, rows, cols, None, 1 + n_targets * ATTEMPTS)["kept"]
    bad = F.raise_error(F.lit(f"block of at most {MIN_KEEP} patches can never be valid")).cast("array<int>")
    return F.coalesce(*levels, free, bad)


def context_blocks(
    masked: DataFrame, rows: int, cols: int, n_contexts: int, n_targets: int = 4, scale=(0.85, 1.0), allow_overlap: bool = False, seed: int = 0
) -> DataFrame:
    """Add `contexts`: several large blocks of one size, each drawn like the one of `context_masks`. All lists of a batch are cut to the
    shortest of them.
    """
    size = block_size(uniform(seed, "contexts", F.col("batch")), rows, cols, scale, (1.0, 1.0))
    drawn = masked
    for k in range(n_contexts):  # a column each, so that a block is drawn once
        key = (seed, "contexts", F.col("batch"), F.col("sample_id"), F.lit(k))
        drawn = drawn.withColumn(f"_c{k}", _context_block(key, size, rows, cols, 0 if allow_overlap else n_targets))
    drawn = drawn.select(*masked.columns, F.array(*[F.col(f"_c{k}") for k in range(n_contexts)]).alias("contexts"))
    shortest = F.min(F.array_min(F.transform("contexts", F.size))).over(W.partitionBy("batch"))
    cut = drawn.withColumn("_len", shortest)
    return cut.withColumn("contexts", F.transform("contexts", lambda c: F.slice(c, F.lit(1), F.col("_len")))).drop("_len")


def world_band_masks(
    masked: DataFrame, rows: int, cols: int, scale=(0.85, 1.0), allow_overlap: bool = False, seed: int = 0
) -> DataFrame:
    """Add `context`: a band of columns that wraps around, without the target patches; an error when too few stay."""
    share = scale[0] + uniform(seed, "band", F.col("batch")) * (scale[1] - scale[0])
    band = F.greatest(F.lit(1), F.least(F.lit(cols), F.rint(share * cols).cast("int")))
    start = F.floor(uniform(seed, "start", F.col("batch"), F.col("sample_id")) * cols).cast("int")
    everything = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    inside = let(
        F.struct(start.alias("start"), band.alias("band")),
        lambda b: F.filter(everything, lambda p: F.pmod(p % cols - b["start"], F.lit(cols)) < b["band"]),
    )
    kept = inside if allow_overlap else F.array_except(inside, F.flatten("targets"))
    few = F.raise_error(F.lit("world-band context has too few visible patches")).cast("array<int>")
    enough = let(kept, lambda c: F.when(F.size(c) > MIN_KEEP, c).otherwise(few))
    return _cut_to_shortest(masked.withColumn("context", enough), "context")


def _cut_to_shortest(df: DataFrame, column: str) -> DataFrame:
    """Cut lists to the shortest of the batch; a window holds the samples of one batch."""
    cut = df.withColumn("_len", F.min(F.size(column)).over(W.partitionBy("batch")))
    return cut.withColumn(column, F.slice(column, F.lit(1), F.col("_len"))).drop("_len")


def visible_masks(masked: DataFrame, n_patches: int, strict: bool = True) -> DataFrame:
    """Add `visible` (patches in no target) and `masked`; strict raises when the counts differ inside a batch."""
    everything = F.sequence(F.lit(0), F.lit(n_patches - 1))
    hidden = F.array_distinct(F.flatten("targets"))
    df = masked.withColumn("masked", F.sort_array(hidden)).withColumn("visible", F.array_except(everything, "masked"))
    if not strict:
        return df
    batch = W.partitionBy("batch")
    even = F.min(F.size("visible")).over(batch) == F.max(F.size("visible")).over(batch)
    uneven = F.raise_error(F.lit("visible patch counts differ inside a batch")).cast("array<int>")
    checked = df.withColumn("_even", even)
    return checked.withColumn("visible", F.when(F.col("_even"), F.col("visible")).otherwise(uneven)).drop("_even")


def random_mask(samples: DataFrame, n_patches: int, ratio: float, seed: int = 0) -> DataFrame:
    """Add `keep` (ids kept, in random order), `mask` (1 = removed, in patch order) and `restore` (rank of each patch)."""
    order = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_patches - 1)),
            lambda p: F.struct(digest(seed, "mask", F.col("sample_id"), p).alias("d"), p.alias("p")),
        )
    )
    n_keep = int(n_patches * (1 - ratio))
    everything = F.sequence(F.lit(0), F.lit(n_patches - 1))

    def laid_out(o: Column) -> Column:
        restore = F.transform(everything, lambda p: (F.array_position(o, p) - 1).cast("int"))
        keep = F.slice(o, 1, n_keep) if n_keep else F.array().cast("array<int>")
        return F.struct(keep.alias("keep"), restore.alias("restore"))

    df = samples.withColumn("_m", let(F.transform(order, lambda t: t["p"]), laid_out)).select(*samples.columns, "_m.keep", "_m.restore")
    return df.withColumn("mask", F.transform("restore", lambda r: F.when(r < n_keep, 0).otherwise(1)))


def gather(tokens: DataFrame, masks: DataFrame) -> DataFrame:
    """Tokens (sample_id, patch, ...) at the patches of mask rows (sample_id, block, patch)."""
    return masks.join(tokens, ["sample_id", "patch"])
