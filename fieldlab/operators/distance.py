"""Distances between sets of latent vectors: moments, Frechet, kernel MMD, PCA, linear probe.

Vectors come as rows (id, group columns, `vec` array). Groups may be of any size: moments are partial sums merged as a tree,
and kernel sums run over tiles of a pair grid that send back sums only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.arrays import indices, let
from fieldlab.functions.reuse import stored

STRIP_DOUBLES = 1 << 20  # about the size of a strip of vectors (8 MB)
SIDE, SMALL_STRIP = 8, 128  # a set has this many strips, for SIDE x SIDE tiles, unless they would have fewer vectors than this
TILES = 192  # with many sets, a set has fewer strips, for about as many tiles in all
EDGE = 512  # a task holds EDGE x EDGE distances at a time (2 MB, which stay in its cache)
BULKY = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "none"}  # rows of many MB
SAMPLE = 1 << 16  # random pairs of a kind and group, for the first bracket of a median
SHARE = 4  # a survey of large tiles takes one of so many parts
FEW = 1 << 23  # distances of a bracket that are listed rather than counted in bins (one group's list is 64 MB)
PART = 256, 512  # a pass over the pairs holds so many single-precision distances at a time (half a MB, which stays in the cache)
LEAF, PLANES = 32, 8  # up to PLANES components, vectors lie in leaves of a k-d tree, and pairs of leaves are decided by their boxes
GRID_BINS = 1 << 20  # bins of a survey, cut out of the bits of single-precision numbers
MOMENTS = 150_000  # numbers in which the kernel sums of a set are held
ORDERS, TINY = 32, 1e-16  # orders of the kernel's series at most; what a pair may add beyond them unseen
NEAR, FAR = 1.0, 1e6  # pairs with 2 gamma |x| |y| up to NEAR need few terms; vectors from 2 gamma |x|^2 = FAR on have no moments
HELD = 1 << 20  # double-precision distances a task holds at a time
TALLY_DOUBLES = 4_000_000  # counts a task holds before it hands over (32 MB)
PIECE_DOUBLES = 8_192  # matrix rows travel in pieces of about 64 KB
STATE_DOUBLES = 32_000_000  # scatter a task holds before it hands over (256 MB)
FAN_IN = 32  # pieces that one group merges


# --- moments ------------------------------------------------------------------------------------------------------------------


def mean_vector(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, i, mean, n), one row per component."""
    parts = df.select(*by, F.posexplode("vec").alias("i", "_x"))
    return parts.groupBy(*by, "i").agg(F.avg(F.col("_x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def merge_as_tree(partial: DataFrame, keys: Sequence[str], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row per key of stored partial(keys, ..., task, turn), the states that tasks have handed over.

    `merge` makes one row with the columns of `schema` of several. Every step merges up to FAN_IN neighbours, and there are as many steps
    as the number of tasks needs, so no group ever holds more.
    """
    tasks, turns = partial.agg(F.coalesce(F.max("task"), F.lit(0)) + 1, F.coalesce(F.max("turn"), F.lit(0)) + 1).first()
    merged, slots = partial.withColumn("slot", F.col("task") * turns + F.col("turn")).drop("task", "turn"), tasks * turns
    while slots > 1:
        merged = merged.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy(*keys, "slot").applyInPandas(
            lambda rows: merge(rows).assign(slot=rows["slot"].iloc[0]), f"{schema}, slot long"
        )
        slots = -(-slots // FAN_IN)
    return merged.drop("slot")


def covariance_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, i, n, mean, row): row i of the sample covariance matrix (ddof 1; null for a single vector).

    One pass. A task keeps count, mean and scatter per group, each batch merged by the pairwise update, and hands them over in
    pieces, which are merged as a tree. Groups may be any number.
    """
    by = list(by)
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*by).schema)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        task, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False) if by else [((), batch)]:
                x = np.stack(part["vec"].to_numpy()).astype(float)
                mean = x.mean(axis=0)
                fresh = (len(x), mean, (x - mean).T @ (x - mean))
                state[key] = _merge_moments([state[key], fresh]) if key in state else fresh
            if sum(m[2].size for m in state.values()) > STATE_DOUBLES:
                yield from (_pieces(by, key, *m).assign(task=task, turn=turn) for key, m in state.items())
                state, turn = {}, turn + 1
        yield from (_pieces(by, key, *m).assign(task=task, turn=turn) for key, m in state.items())

    schema = f"{fields}start int, n long, mean array<double>, part array<double>"
    partial = stored(df.select(*by, "vec").mapInPandas(partial_sums, f"{schema}, task long, turn long"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[:1].copy()
        d = len(head["mean"].iloc[0])
        start = int(head["start"].iloc[0])
        width = len(head["part"].iloc[0]) // d
        n, mean, part = _merge_moments(
            [(k, np.asarray(m), np.asarray(p).reshape(width, d)) for k, m, p in zip(rows["n"], rows["mean"], rows["part"])],
            slice(start, start + width),
        )
        head["n"], head["mean"], head["part"] = n, [mean], [part.ravel()]
        return head[[*by, "start", "n", "mean", "part"]]

    merged = merge_as_tree(partial, [*by, "start"], merge, schema)
    rows = let(
        F.struct("part", "mean"),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s["part"]) / F.size(s["mean"])).cast("int") - 1),
            lambda k: F.slice(s["part"], k * F.size(s["mean"]) + 1, F.size(s["mean"])),
        ),
    )
    out = merged.select(*by, "start", "n", "mean", F.posexplode(rows).alias("_k", "_row"))
    i = F.col("start") + F.col("_k")
    scaled = F.transform("_row", lambda v: F.when(F.col("n") > 1, v / (F.col("n") - 1)))
    return out.select(*by, i.alias("i"), "n", F.get("mean", i).alias("mean"), scaled.alias("row"))


def _merge_moments(parts: list, rows: slice = slice(None)):
    """(n, mean, scatter) of a union of sets from those of the sets; `rows` selects the scatter rows at hand."""
    n = int(sum(p[0] for p in parts))
    mean = sum(p[0] * p[1] for p in parts) / n
    scatter = sum(p[2] + p[0] * np.outer((p[1] - mean)[rows], p[1] - mean) for p in parts)
    return n, mean, scatter


def _pieces(by: list[str], key, n: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    step = max(1, PIECE_DOUBLES // len(mean))
    starts = np.arange(0, len(mean), step, dtype=np.int32)
    out = pd.DataFrame({"start": starts, "n": n, "mean": [mean] * len(starts), "part": [scatter[a : a + step].ravel() for a in starts]})
    for name, k in zip(by, key):
        out[name] = k
    return out[[*by, "start", "n", "mean", "part"]]


# --- Frechet ------------------------------------------------------------------------------------------------------------------


def psd_root(cov: np.ndarray) -> np.ndarray:
    """The symmetric root; negative eigenvalues of a rank-deficient matrix count as 0."""
    w, q = np.linalg.eigh(cov)
    return (q * np.sqrt(np.clip(w, 0, None))) @ q.T


def frechet(reference: DataFrame, candidates: DataFrame, by: Sequence[str], clamp: bool = False) -> DataFrame:
    """Frechet distance of each candidate group to the reference set, with its terms.

    |mu1 - mu2|^2 + tr C1 + tr C2 - 2 tr (C1^(1/2) C2 C1^(1/2))^(1/2), which is real. The root of the reference is taken once; then the
    D x D step runs in one task per group on D rows. `clamp` keeps the distance from going below 0.
    """

    def root(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        cov = np.stack(part["row"].to_numpy()).astype(float)
        rows = psd_root(cov) if np.isfinite(cov).all() else np.full_like(cov, np.nan)
        return pd.DataFrame({"i": part["i"], "_rm": part["mean"], "_rr": list(rows), "_rn": part["n"], "_rt": np.trace(cov)})

    ref = covariance_rows(reference, []).groupBy().applyInPandas(root, "i int, _rm double, _rr array<double>, _rn long, _rt double")
    cand = covariance_rows(candidates, by).join(stored(ref), "i")
    by = list(by)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*by).schema)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        gap = part["_rm"].to_numpy(float) - part["mean"].to_numpy(float)
        half, cov = (np.stack(part[c].to_numpy()).astype(float) for c in ("_rr", "row"))
        value, trace_ref, trace = float("nan"), part["_rt"].iloc[0], np.trace(cov)
        if np.isfinite(half).all() and np.isfinite(cov).all():
            inner = half @ cov @ half
            cross = np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.T) / 2), 0, None)).sum()
            value = float(gap @ gap + trace_ref + trace - 2 * cross)
        out = part[by].iloc[:1].copy()
        out["n"], out["n_ref"] = part["n"].iloc[0], part["_rn"].iloc[0]
        out["mean_sq"], out["trace_ref"], out["trace"] = gap @ gap, trace_ref, trace
        out["fid"] = max(value, 0.0) if clamp else value
        return out

    schema = f"{keys}, n long, n_ref long, mean_sq double, trace_ref double, trace double, fid double"
    return cand.groupBy(*by).applyInPandas(solve, schema)


def plane_moments(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, mx, my, a, b, c) of vectors of two components: means, and the sample covariance [[a, b], [b, c]]."""
    x, y = F.get("vec", F.lit(0)).cast("double"), F.get("vec", F.lit(1)).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c")
    )


def frechet_plane(reference: DataFrame, candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, n_ref, fid) for vectors of two components, in closed form: the eigenvalues p, q of C1 C2 are not negative, and
    (sqrt p + sqrt q)^2 = trace + 2 sqrt(determinant). Null where a set has one vector.
    """
    r = reference.transform(plane_moments, []).agg(F.first(F.struct("*"))).scalar()
    m = plane_moments(candidates, by).withColumn("_r", r)
    trace = F.col("_r.a") * F.col("a") + 2 * F.col("_r.b") * F.col("b") + F.col("_r.c") * F.col("c")
    determinant = (F.col("_r.a") * F.col("_r.c") - F.col("_r.b") * F.col("_r.b")) * (F.col("a") * F.col("c") - F.col("b") * F.col("b"))
    cross = F.sqrt(F.greatest(trace + 2 * F.sqrt(F.greatest(determinant, F.lit(0.0))), F.lit(0.0)))
    gap = F.pow(F.col("_r.mx") - F.col("mx"), 2) + F.pow(F.col("_r.my") - F.col("my"), 2)
    fid = gap + F.col("_r.a") + F.col("_r.c") + F.col("a") + F.col("c") - 2 * cross
    return m.select(*by, "n", F.col("_r.n").alias("n_ref"), fid.alias("fid"))


def frechet_terms(reference: DataFrame, candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The terms that need no matrix root: |mu1 - mu2|^2 and the two traces."""

    def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        parts = df.select(*keys, F.posexplode("vec").alias("i", "_x"))
        x = F.col("_x").cast("double")
        return parts.groupBy(*keys, "i").agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"))

    ref = spread(reference, []).select("i", F.col("m").alias("rm"), F.col("v").alias("rv"))
    gap = F.col("m") - F.col("rm")
    return spread(candidates, by).join(ref, "i").groupBy(*by).agg(
        F.sum(gap * gap).alias("mean_sq"), F.sum("rv").alias("trace_ref"), F.sum("v").alias("trace")
    )


# --- kernel MMD ---------------------------------------------------------------------------------------------------------------


def tiles(reference: DataFrame, candidates: DataFrame, by: str, key: str, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pair grid of all distances that are needed, reference x reference, reference x group and group x itself; and the set sizes.

    Each set is hashed into strips of about STRIP_DOUBLES numbers (or `block_rows` vectors), and every pair of strips is a tile: one row
    (kind, g, na, a, nb, b) with both sides as the bytes of a matrix of doubles, row by row, which no pass takes apart before it reaches
    NumPy. Strips travel once to each tile they are part of; the grid is written and all passes read it, so vectors are not shuffled again.
    Vector pairs never become rows. Sizes are rows (set, g, n, strips), g is null for the reference.
    """
    ref = reference.select(F.lit("ref").alias("set"), F.lit(None).cast("string").alias("g"), key, "vec")
    cand = candidates.select(F.lit("cand").alias("set"), F.col(by).cast("string").alias("g"), key, "vec")
    rows = ref.unionByName(cand)
    n = F.count(F.lit(1))
    most = F.greatest(F.lit(1), F.lit(STRIP_DOUBLES) / F.greatest(F.max(F.size("vec")), F.lit(1)))
    counted = stored(rows.groupBy("set", "g").agg(n.alias("n"), F.ceil(n / most).alias("least")))
    side = F.least(F.lit(SIDE), F.greatest(F.lit(2), F.ceil(F.sqrt(F.lit(TILES) / (2 * counted.agg(F.count("*")).scalar())))))
    strips = F.ceil(F.col("n") / block_rows) if block_rows else F.greatest("least", F.least(side, F.ceil(F.col("n") / SMALL_STRIP)))
    sizes = stored(counted.select("set", "g", "n", strips.cast("int").alias("strips")))

    sized = rows.alias("r").join(sizes.alias("s"), (F.col("r.set") == F.col("s.set")) & F.col("r.g").eqNullSafe(F.col("s.g")))
    strip = F.pmod(F.xxhash64(F.col(key)), F.col("strips")).cast("int")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", kind="stable")
        m = np.stack(rows["v"].to_numpy()).astype(float)
        m = m[_order(m)]
        return rows[["set", "g", "strips", "strip"]].iloc[:1].assign(n=len(m), m=m.tobytes())

    blocks = sized.select("r.set", "r.g", "strips", strip.alias("strip"), F.col(key).alias("k"), F.col("vec").alias("v"))
    blocks = blocks.groupBy("set", "g", "strips", "strip").applyInPandas(packed, "set string, g string, strips int, strip int, n int, m binary")
    of_ref = sizes.where("set = 'ref'").agg(F.coalesce(F.max("strips"), F.lit(0))).scalar()
    of_groups = sizes.where("set = 'cand'").agg(F.collect_list(F.struct("g", "strips"))).scalar()  # one entry per group
    blocks = blocks.withColumn("_of_ref", of_ref).withColumn("_of_groups", of_groups)

    def place(kind, g, i, j, side):
        return F.struct(kind.alias("kind"), g.alias("g"), i.alias("i"), j.alias("j"), side.alias("side"))

    mine = F.col("strip")
    own = F.transform(
        F.sequence(F.lit(0), F.col("strips") - 1), lambda o: place(F.col("set"), F.col("g"), F.least(mine, o), F.greatest(mine, o), F.when(o < mine, 1).otherwise(0))
    )
    to_groups = F.flatten(
        F.transform("_of_groups", lambda t: F.transform(F.sequence(F.lit(0), t["strips"] - 1), lambda o: place(F.lit("cross"), t["g"], mine, o, F.lit(0))))
    )
    to_ref = F.transform(indices(F.col("_of_ref")), lambda o: place(F.lit("cross"), F.col("g"), o, mine, F.lit(1)))
    sent = blocks.select(F.struct("n", "m").alias("_b"), F.explode(F.concat(own, F.when(F.col("set") == "ref", to_groups).otherwise(to_ref))).alias("_p"))
    sides = F.sort_array(F.collect_list(F.struct(F.col("_p.side").alias("s"), F.col("_b").alias("b"))))
    grid = sent.groupBy("_p.kind", "_p.g", "_p.i", "_p.j").agg(sides.alias("_s"))
    first, second = F.get("_s", F.lit(0))["b"], F.get("_s", F.lit(1))["b"]  # a strip with itself has no second side
    grid = grid.select("kind", "g", first["n"].alias("na"), first["m"].alias("a"), second["n"].alias("nb"), second["m"].alias("b"))
    return stored(grid, options=BULKY), sizes


def _order(m: np.ndarray) -> np.ndarray:
    """The order of vectors in a strip: leaves of a k-d tree, LEAF vectors each, or with many components a random one."""
    if m.shape[1] > PLANES or not np.isfinite(m).all():
        return np.random.default_rng(len(m)).permutation(len(m))
    order, spans = np.arange(len(m)), [(0, len(m))]
    while spans:
        lo, hi = spans.pop()
        if hi - lo > LEAF:
            some = order[lo:hi]
            v = m[some]
            half = -(-(hi - lo) // (2 * LEAF)) * LEAF
            order[lo:hi] = some[np.argpartition(v[:, np.ptp(v, axis=0).argmax()], half)]
            spans += [(lo, lo + half), (lo + half, hi)]
    return order


def _sides(na, a, nb, b) -> tuple[np.ndarray, np.ndarray]:
    """Both strips of a tile as matrices."""
    x = np.frombuffer(a).reshape(int(na), -1)
    return x, x if b is None else np.frombuffer(b).reshape(int(nb), -1)


def _sqdist(na, a, nb, b) -> Iterator[np.ndarray]:
    """Squared distances of a tile, EDGE x EDGE at a time; of a strip with itself, those of i < j."""
    x, y = _sides(na, a, nb, b)
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[:, None]
    left = np.hstack((-2.0 * x, xx, np.ones_like(xx)))  # |x|^2 + |y|^2 - 2 x y as one product
    right = np.hstack((y, np.ones_like(yy), yy)).T
    for i in range(0, len(x), EDGE):
        for j in range(i if b is None else 0, len(y), EDGE):
            part = left[i : i + EDGE] @ right[:, j : j + EDGE]
            np.maximum(part, 0.0, out=part)
            yield part[np.triu_indices(len(part), 1)] if b is None and i == j else part.ravel()


def _per_tile(grid: DataFrame, add: Callable, schema: str, rows: Callable = None, held: int = 16) -> DataFrame:
    """Merge the squared distances of all tiles of a task, part by part: `add(state, kind, g, squared distances, weight, targets)` changes
    the dict `state`, whose entries are key -> value, each of at most `held` numbers. `targets` is what `_aimed` has joined. A task hands its
    state over at its end, and before where it is large, as one row per entry (key and value joined), or as the frame `rows(key, value)`.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    aimed = "targets" in grid.columns

    def handed(state: dict) -> Iterator[pd.DataFrame]:
        if rows is not None:
            yield from (rows(key, value) for key, value in state.items())
        elif state:
            yield pd.DataFrame([(*key, *value) for key, value in state.items()], columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            for kind, g, na, a, nb, b, *targets in batch.itertuples(index=False, name=None):
                weight = 1 if kind == "cross" else 2  # inside a set, ordered pairs count
                for d2 in _sqdist(na, a, nb, b):
                    if d2.size:
                        add(state, kind, g, d2, weight, *targets)
                if len(state) * held > TALLY_DOUBLES:
                    yield from handed(state)
                    state = {}
        yield from handed(state)

    return grid.select("kind", "g", "na", "a", "nb", "b", *["targets"] * aimed).mapInPandas(run, schema)


def _aimed(grid: DataFrame, targets: DataFrame) -> DataFrame:
    """The tiles with what they count for, from a small table targets(g, ...) of one row per group: those of a group for its own target,
    those of the reference for all. The table is read as a scalar subquery, so no tile moves.
    """
    listed = grid.withColumn("_t", targets.agg(F.collect_list(F.struct(*targets.columns))).scalar())
    return listed.withColumn("targets", F.when(F.col("kind") == "ref", F.col("_t")).otherwise(F.filter("_t", lambda t: t["g"].eqNullSafe(F.col("g"))))).drop("_t")


def sqdist_summary(reference: DataFrame, candidates: DataFrame, by: str, key: str, block_rows: int | None = None) -> DataFrame:
    """Squared distances per (kind, group) over ordered pairs, the diagonal left out: n, mean, min, max."""
    grid, _ = tiles(reference, candidates, by, key, block_rows)

    def stats(state, kind, g, d2, weight):
        n, total, lo, hi = state.get((kind, g), (0, 0.0, np.inf, -np.inf))
        state[kind, g] = n + weight * d2.size, total + weight * float(d2.sum()), min(lo, float(d2.min())), max(hi, float(d2.max()))

    part = _per_tile(grid, stats, "kind string, g string, n long, s double, lo double, hi double")
    return part.groupBy("kind", "g").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )


def _guessed(grid: DataFrame, ranked: DataFrame) -> DataFrame:
    """(g, k, lo, hi): brackets that hold the median almost surely, from about SAMPLE random pairs of each kind and group.

    Only a first guess, by which the exact count saves passes; a bracket that misses the rank is left for its neighbour there.
    """

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, g, na, a, nb, b, targets in batch.itertuples(index=False, name=None):
                (x, y), weight = _sides(na, a, nb, b), 1 if kind == "cross" else 2
                n = len(x) * (len(x) - 1) // 2 if b is None else len(x) * len(y)
                if not n or not len(targets):
                    continue
                m, rng = -(-SAMPLE * n // targets[0][f"n_{kind}"]), np.random.default_rng([len(x), len(y)])
                i = rng.integers(len(x), size=m)
                j = (i + 1 + rng.integers(len(x) - 1, size=m)) % len(x) if b is None else rng.integers(len(y), size=m)
                step = max(1, EDGE * EDGE // max(1, x.shape[1]))
                for at in range(0, m, step):
                    d = ((x[i[at : at + step]] - y[j[at : at + step]]) ** 2).sum(1)
                    yield pd.DataFrame({"kind": kind, "g": g, "d": d, "w": weight * n / m})

    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        d, w = rows["d"].to_numpy(), rows["w"].to_numpy()
        share, reach = w.cumsum() / w.sum(), 3 * np.sqrt((w * w).sum()) / w.sum()  # six standard deviations of the sample's median
        lo, hi = np.searchsorted(share, [0.5 - reach, 0.5 + reach])
        return pd.DataFrame({"g": rows["g"].iloc[:1], "k": rows["k"].iloc[:1], "lo": d[lo], "hi": d[min(hi, len(d) - 1)]})

    sample = stored(_aimed(grid, ranked).select("kind", "g", "na", "a", "nb", "b", "targets").mapInPandas(drawn, "kind string, g string, d double, w double"))
    shared = ranked.select("g", "k").join(F.broadcast(sample.where("kind = 'ref'").select("d", "w")))  # about SAMPLE rows
    own = ranked.select("g", "k").join(sample.where("kind != 'ref'").select("g", "d", "w"), "g")
    return own.unionByName(shared).groupBy("g").applyInPandas(middle, "g string, k long, lo double, hi double")


class _Pairs:
    """The squared distances of a tile in single precision, part by part; those far from a bracket are counted by whole leaves.

    A part is (rows, columns, distances): row and column numbers, and a matrix that is infinite where a strip with itself has i >= j. No
    distance is wrong by more than `slip`.
    """

    def __init__(self, na, a, nb, b):
        x, y = _sides(na, a, nb, b)
        self.own, shift = b is None, x.mean(0)
        self.x, self.y = x - shift, y - shift
        xx, yy = (self.x**2).sum(1), (self.y**2).sum(1)
        self.leaves = x.shape[1] <= PLANES and bool(np.isfinite(xx.max() + yy.max()))
        even = SHARE * -(-len(y) // (SHARE * PART[1]))  # chunks, a multiple of SHARE so that every row meets as many in a survey
        self.step, self.chunk = (LEAF, LEAF) if self.leaves else (PART[0], -(-len(y) // even))
        reach_x, reach_y = (np.sqrt(np.maximum.reduceat(v, np.arange(0, len(v), step))) for v, step in ((xx, self.step), (yy, self.chunk)))
        usual_x, usual_y = 1.5 * np.quantile(reach_x, 0.9), 1.5 * np.quantile(reach_y, 0.9)
        self.far_x, self.far_y = reach_x > usual_x, reach_y > usual_y  # where a few vectors far off would spoil single precision
        kind, self.most = np.float32, 1.01 * (reach_x.max() + reach_y.max()) ** 2
        self.slip = float(1.1 * (x.shape[1] + 6) * np.finfo(kind).eps / 2 * (usual_x + usual_y) ** 2)
        self.size = len(x) * (len(x) - 1) // 2 if self.own else len(x) * len(y)
        with np.errstate(over="ignore"):
            self.left = np.hstack((-2.0 * self.x, xx[:, None], np.ones((len(x), 1)))).astype(kind)  # |x|^2 + |y|^2 - 2 x y as one product
            self.right = np.vstack((self.y.T, np.ones(len(y)), yy)).astype(kind)
        if self.leaves:
            at_x, at_y = np.arange(0, len(x), LEAF), np.arange(0, len(y), LEAF)
            self.box_x = np.minimum.reduceat(self.x, at_x).T, np.maximum.reduceat(self.x, at_x).T
            self.box_y = np.minimum.reduceat(self.y, at_y).T, np.maximum.reduceat(self.y, at_y).T
            self.full = np.full((len(self.right), len(at_y), LEAF), np.inf, kind)  # the last leaf is filled up with vectors at no distance
            self.full[:-1] = 0
            self.full.reshape(len(self.right), -1)[:, : len(y)] = self.right

    def parts(self, lo: float, hi: float, share: int = 1) -> Iterator[tuple]:
        """(distances known to be below `lo`, rows, columns, part): one of `share` parts, evenly for every row and column, and of open leaves one
        of `share` columns. A part is None where only whole leaves are counted."""
        step, self.open = self.step, 0 if self.leaves else self.size
        room = np.empty(PART[0] * PART[1], np.float32)
        for k, i in enumerate(range(0, len(self.x), step)):
            rows, begin = slice(i, min(i + step, len(self.x))), i if self.own else 0
            n = rows.stop - i
            if not self.leaves:
                for c, j in enumerate(range(begin, len(self.y), self.chunk)):
                    if (c + k) % share == 0:
                        columns = np.arange(j, min(j + self.chunk, len(self.y)))
                        if self.far_x[k] or self.far_y[j // self.chunk : columns[-1] // self.chunk + 1].any():
                            part = self._direct(rows, columns)
                        else:
                            part = np.matmul(self.left[rows], self.right[:, columns[0] : columns[-1] + 1], out=room[: n * len(columns)].reshape(n, -1))
                        if self.own and j < rows.stop:
                            part[np.arange(i, rows.stop)[:, None] >= columns] = np.inf
                        yield 0, i, columns, part
                continue
            first = begin // LEAF
            low, high = (b[:, k, None] for b in self.box_x)
            gap = np.maximum(self.box_y[0][:, first:] - high, low - self.box_y[1][:, first:])
            span = np.maximum(self.box_y[1][:, first:] - low, high - self.box_y[0][:, first:])
            near = (np.maximum(gap, 0.0) ** 2).sum(0) * (1 - 1e-9) <= hi
            below = (span**2).sum(0) * (1 + 1e-9) < lo
            if self.own:
                near[0], below[0] = True, False  # the leaf with itself
            known = first + np.flatnonzero(below)
            if len(known):
                yield n * self._vectors(known), i, None, None
            open_leaves = first + np.flatnonzero(near & ~below)
            self.open += n * self._vectors(open_leaves) - (n * (n + 1) // 2 if self.own else 0)
            some_of = np.arange(k % share, LEAF, share)  # of every leaf
            far = self.far_y[open_leaves] | self.far_x[k]
            for direct, leaves in ((False, open_leaves[~far]), (True, open_leaves[far])):
                at_once = PART[0] * PART[1] // (LEAF * len(some_of))
                for c in range(0, len(leaves), at_once):
                    some = leaves[c : c + at_once]
                    columns = (some[:, None] * LEAF + some_of).ravel()
                    if direct:
                        part = self._direct(rows, columns)
                    else:
                        drawn = self.full[:, some] if share == 1 else self.full[:, some[:, None], some_of]
                        part = np.matmul(self.left[rows], drawn.reshape(len(self.full), -1), out=room[: n * len(columns)].reshape(n, -1))
                    if self.own and c == 0 and some[0] == first:
                        part[:, : len(some_of)][np.arange(n)[:, None] >= some_of] = np.inf
                    yield 0, i, columns, part

    def _vectors(self, leaves: np.ndarray) -> int:
        """How many vectors the sorted leaves hold; the last of all may be short."""
        whole = -(-len(self.y) // LEAF)
        return len(leaves) * LEAF - (whole * LEAF - len(self.y) if len(leaves) and leaves[-1] == whole - 1 else 0)

    def _direct(self, rows: slice, columns: np.ndarray) -> np.ndarray:
        """Distances from double precision, component by component."""
        x, y = self.x[rows], self.y[np.minimum(columns, len(self.y) - 1)]
        d = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            d += (x[:, c, None] - y[:, c]) ** 2
        d[:, columns >= len(self.y)] = np.inf
        with np.errstate(over="ignore"):
            return d.astype(np.float32)

    def exact(self, row: int, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances in double precision, at flat positions of a part."""
        i, j = row + at // len(columns), columns[at % len(columns)]
        step = max(1, (1 << 16) // max(1, self.x.shape[1]))
        return np.concatenate([((self.x[i[k : k + step]] - self.y[j[k : k + step]]) ** 2).sum(1) for k in range(0, len(i), step)] or [np.empty(0)])


def _per_pairs(grid: DataFrame, brackets: DataFrame, add: Callable, rows: Callable, schema: str, held: int) -> DataFrame:
    """`add(state, pairs, weight, targets)` for every tile that some bracket asks for; state and hand-over as in `_per_tile`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            for kind, _, na, a, nb, b, targets in batch.itertuples(index=False, name=None):
                if len(targets):
                    pairs = _Pairs(na, a, nb, b)
                    if pairs.size:
                        add(state, pairs, 1 if kind == "cross" else 2, targets)  # inside a set, ordered pairs count
                if len(state) * held > TALLY_DOUBLES:
                    yield from (rows(*entry) for entry in state.items())
                    state = {}
        yield from (rows(*entry) for entry in state.items())

    return _aimed(grid, brackets).select("kind", "g", "na", "a", "nb", "b", "targets").mapInPandas(run, schema)


def _bits(value: float) -> int:
    """A number >= 0 as the integer that has the bits of its single-precision form: larger numbers have larger integers."""
    with np.errstate(over="ignore"):
        return int(np.float32(max(value, 0.0)).view(np.int32))


class _Grid:
    """Bins of the numbers from `lo` to `hi`, alike for all that share the leading bits: `shift` is the number of bits they don't share."""

    def __init__(self, lo: float, hi: float, shift: int):
        self.shift, self.first = shift, _bits(lo) >> shift
        self.n = (_bits(hi) >> shift) - self.first + 1
        self.low = self.first << shift
        self.floor = np.array(self.low, np.int32).view(np.float32)[()]
        self.room = np.empty(PART[0] * PART[1], np.uint32), np.empty(PART[0] * PART[1], bool)

    def at(self, value: float) -> int:
        return (_bits(value) >> self.shift) - self.first

    def inside(self, part: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """How many numbers of a flat part lie below the grid, the positions of those inside, and their bins."""
        above, there = (r[: part.size] for r in self.room)
        if self.low == 0:
            np.maximum(part, np.float32(0), out=part)
        below = np.count_nonzero(np.less(part, self.floor, out=there))
        np.subtract(part.view(np.uint32), np.uint32(self.low), out=above)  # negative or infinite ones are beyond any bin
        np.less(above, np.uint32(min(self.n << self.shift, 0x7F800000 - self.low)), out=there)
        words = np.flatnonzero(there[: len(there) // 8 * 8].view(np.uint64))
        if len(words) * 32 > len(there):
            at = np.flatnonzero(there)
        else:  # few: eight at a time
            at = np.r_[(words[:, None] * 8 + np.arange(8)).ravel(), len(there) // 8 * 8 : len(there)]
            at = at[there[at]]
        return below, at, above[at] >> self.shift


def _surveyed(grid: DataFrame, brackets: DataFrame, most_share: int) -> DataFrame:
    """(g, k, lo, hi, sure, few): narrower brackets from single-precision distances, those of large tiles from one of `most_share` parts.

    The bins are numbers with the same leading bits, alike for all groups. A guess as well, which the exact count corrects where it misses.
    """
    ends = brackets.agg(F.min("lo"), F.max("hi")).first()
    shift = next(s for s in range(4, 32) if (_bits(ends[1]) >> s) - (_bits(ends[0]) >> s) < GRID_BINS)

    def add(state, pairs, weight, targets):
        lo, hi = min(t["lo"] for t in targets), max(t["hi"] for t in targets)
        bins = _Grid(lo, hi, shift)
        share = most_share if len(pairs.x) >= 8 * PART[0] and len(pairs.y) >= SHARE * PART[1] else 1
        known, below, n, tally = 0, 0, 0, np.zeros(bins.n, np.int64)
        for whole, _, _, part in pairs.parts(float(bins.floor), hi, share):
            known += whole
            if part is None:
                continue
            part = part.ravel()
            under, _, at = bins.inside(part)
            below += under
            n += np.count_nonzero(part < np.float32(np.inf)) if share > 1 else 0
            if at.size:
                tally += np.bincount(at, minlength=bins.n)
        times = weight * (pairs.open / n if n else 1.0)
        before = np.r_[0, tally.cumsum()]
        for t in targets:
            begin, end = bins.at(t["lo"]), bins.at(t["hi"]) + 1
            if t["g"] not in state:
                state[t["g"]] = [0.0, 0.0, _bits(t["lo"]) >> shift, np.zeros(end - begin), 0.0]
            entry = state[t["g"]]
            entry[0] += weight * known + times * (below + before[begin])
            entry[1] += times * times * n
            entry[3] += times * tally[begin:end]
            entry[4] = max(entry[4], pairs.slip)

    def rows(g, entry):
        below, square, first, tally, slip = entry
        at = np.flatnonzero(tally)
        return pd.DataFrame({"g": g, "bin": np.r_[-1, first + at], "n": np.r_[below, tally[at]], "square": np.r_[square, np.zeros(len(at))], "slip": slip})

    def narrowed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        (g, k, least, most), bins, upto = rows[["g", "k", "least", "most"]].iloc[0], rows["bin"].to_numpy(), rows["n"].cumsum().to_numpy()
        margin = 6 * np.sqrt(rows["square"].sum())  # twelve standard deviations, as of a sample's median, since parts are drawn whole
        at, to = np.searchsorted(upto, [k - margin, k + margin], "right")
        edge = lambda b: float(np.array(min(max(b << shift, 0), 0x7F7FFFFF), np.int32).view(np.float32))
        lo = 0.0 if at == 0 else edge(int(bins[at]) - 1) if at < len(bins) else edge((_bits(most) >> shift) - 1)
        hi = float(np.finfo(np.float32).max) if to == len(bins) else edge(int(bins[to]) + 2) if to else edge((_bits(least) >> shift) + 1)
        slip = rows["slip"].max() / (1 if most_share == 1 else 16)  # all parts: the rank is inside for certain, else commonly
        lo, hi = max(lo - slip, 0.0), hi + slip
        begin, end = _bits(lo) >> shift, _bits(hi) >> shift
        known = _bits(least) >> shift <= begin and end <= _bits(most) >> shift
        n = rows["n"].to_numpy()[(bins >= begin) & (bins <= end)].sum() if known else np.inf
        n = min(n, 2 * k + 2)  # about all there are
        return pd.DataFrame({"g": [g], "k": [k], "lo": [lo], "hi": [hi], "sure": [True], "few": [bool(n <= FEW)]})

    parts = _per_pairs(grid, brackets, add, rows, "g string, bin long, n double, square double, slip double", GRID_BINS)
    counts = parts.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.sum("square").alias("square"), F.max("slip").alias("slip")).join(F.broadcast(brackets.withColumnsRenamed({"lo": "least", "hi": "most"})), "g")
    return counts.groupBy("g").applyInPandas(narrowed, "g string, k long, lo double, hi double, sure boolean, few boolean")


def mmd_gammas(grid: DataFrame, bins: int = 8192) -> DataFrame:
    """(g, gamma): kernel widths 1 / (2 * median + 1e-6) per group, with the exact lower median over all ordered pairs of the two sets.

    The first bracket of a group is guessed from a sample and narrowed by a survey. Then each pass counts all distances: those below the
    bracket, those above it, and those inside in even bins, and where the median lies is the next bracket; of one that holds up to FEW,
    every value is listed. Single precision tells what is inside, but for a small margin; there double precision decides. Brackets are a
    stored table that is joined with the tiles.
    """
    size = F.when(F.col("nb").isNull(), F.expr("cast(na as long) * (na - 1) div 2")).otherwise(F.expr("cast(na as long) * nb"))
    spans = stored(grid.groupBy("kind", "g").agg(F.sum(size).alias("n")).where("n > 0"))
    of_ref = spans.where("kind = 'ref'").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    both = spans.where("kind != 'ref'").groupBy("g").agg(of("cand").alias("n_cand"), of("cross").alias("n_cross")).withColumn("n_ref", of_ref)
    ranked = stored(both.withColumn("k", F.expr("(2 * n_ref + 2 * n_cand + n_cross - 1) div 2")))
    guessed = stored(_guessed(grid, ranked))
    if guessed.isEmpty():
        return guessed.select("g", F.lit(None).cast("double").alias("gamma"))
    brackets = stored(_surveyed(grid, guessed, SHARE))

    def count(state, pairs, weight, targets):
        for t in targets:
            if t["g"] not in state:  # the first bin is what lies below, the last one what lies above
                n, low, high = np.zeros(bins + 2, np.int64), np.full(bins + 2, np.inf), np.full(bins + 2, -np.inf)
                low[0], high[0], low[-1] = 0.0, t["lo"], t["hi"]
                state[t["g"]] = n, low, high, t["few"], []
            state[t["g"]][2][-1] = max(state[t["g"]][2][-1], pairs.most)
        lo, hi = min(t["lo"] for t in targets), max(t["hi"] for t in targets)
        slip = lambda value: pairs.slip + 2e-7 * value  # noqa: E731  single precision, and its rounding
        shift = next(k for k in range(32) if (_bits(hi + slip(hi)) >> k) - (_bits(lo - slip(lo)) >> k) < GRID_BINS)
        cells = _Grid(lo - slip(lo), hi + slip(hi), shift)
        spans = [(cells.at(t["lo"] - slip(t["lo"])), cells.at(t["hi"] + slip(t["hi"]))) for t in targets]
        hot = np.zeros(cells.n, bool)  # bins in which double precision decides
        for begin, end in spans:
            hot[begin : end + 1] = True
        below, bin_counts, found = 0, np.zeros(len(hot), np.int64), []
        lower, inside = np.zeros(len(targets), np.int64), np.zeros(len(targets), np.int64)

        def settle():
            at, d = (np.concatenate(c) for c in zip(*found))
            for k, (t, (begin, end)) in enumerate(zip(targets, spans)):
                own = d[(at >= begin) & (at <= end)]
                lower[k] += np.count_nonzero(own < t["lo"])
                own = np.sort(own[(own >= t["lo"]) & (own <= t["hi"])])
                inside[k] += own.size
                n, low, high, few, listed = state[t["g"]]
                if few:
                    listed.append((own, weight))
                elif own.size:
                    index = 1 + np.minimum((own - t["lo"]) * (bins / (t["hi"] - t["lo"])), bins - 1).astype(np.int64) if t["hi"] > t["lo"] else np.ones(own.size, np.int64)
                    starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
                    stops, place = np.r_[starts[1:], len(own)], index[starts]
                    n[place] += weight * (stops - starts)
                    low[place], high[place] = np.minimum(low[place], own[starts]), np.maximum(high[place], own[stops - 1])
            found.clear()

        for known, row, columns, part in pairs.parts(lo, hi):
            below += known
            if part is None:
                continue
            part = part.ravel()
            under, near, at = cells.inside(part)
            below += under
            if near.size:
                bin_counts += np.bincount(at, minlength=cells.n)
                if len(targets) > 1:
                    near, at = near[hot[at]], at[hot[at]]
                if near.size:
                    found.append((at, pairs.exact(row, columns, near)))
            if sum(len(f[0]) for f in found) > HELD:
                settle()
        if found:
            settle()
        before = np.r_[0, bin_counts.cumsum()]
        for k, (t, (begin, _)) in enumerate(zip(targets, spans)):
            n, under = state[t["g"]][0], below + int(before[begin] + lower[k])
            n[0] += weight * under
            n[-1] += weight * (pairs.size - under - int(inside[k]))

    def tally(g, value):
        n, low, high, few, listed = value
        at = np.flatnonzero(n)
        names = np.where(at == 0, -np.inf, np.where(at == len(n) - 1, np.inf, at))
        out = pd.DataFrame({"g": g, "bin": names, "n": n[at], "lo": low[at], "hi": high[at], "listed": None})
        if not few or not listed:
            return out
        values, where = np.unique(np.concatenate([d for d, _ in listed]), return_inverse=True)
        times = np.bincount(where, np.concatenate([np.full(d.size, w) for d, w in listed]), len(values)).astype(np.int64)
        if not len(values):
            return out
        row = {"g": g, "bin": 0.0, "n": times.sum(), "lo": values[0], "hi": values[-1], "listed": np.stack((values.view(np.int64), times)).tobytes()}
        return pd.concat([out, pd.DataFrame([row])], ignore_index=True)

    def held(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        k, upto = rows["k"].iloc[0], rows["n"].cumsum().to_numpy()
        if k >= upto[-1]:
            raise ValueError(f"rank beyond the data for group {rows['g'].iloc[0]}")
        row = rows.iloc[np.searchsorted(upto, k, "right")]
        lo, hi = row["lo"], row["hi"]
        if len(row["listed"]):
            values, times = np.hstack([np.frombuffer(m, np.int64).reshape(2, -1) for m in row["listed"]])
            order = np.argsort(values.view(float), kind="stable")
            at = np.searchsorted(times[order].cumsum(), k - (upto[np.searchsorted(upto, k, "right")] - row["n"]), "right")
            lo = hi = values.view(float)[order[at]]
        return pd.DataFrame({"g": rows["g"].iloc[:1], "k": k, "lo": lo, "hi": hi, "sure": bool(np.isfinite(row["bin"])), "few": row["n"] <= FEW})

    is_open = ~F.col("sure") | (F.col("hi") - F.col("lo") > 1e-13 * F.greatest(F.abs("lo"), F.abs("hi")))
    groups = None
    while True:
        n, n_open = brackets.agg(F.count("*"), F.count_if(is_open)).first()
        if groups is not None and n != groups:
            raise ValueError(f"rank beyond the data for {groups - n} groups")
        if not n_open:
            break
        groups, missed = n, brackets.where(~F.col("sure"))
        if not missed.isEmpty():  # the rank is beyond the bracket
            brackets = stored(brackets.where("sure").unionByName(_surveyed(grid, missed.select("g", "k", "lo", "hi"), 1)))
        narrow = brackets.where(is_open)
        parts = _per_pairs(grid, narrow, count, tally, "g string, bin double, n long, lo double, hi double, listed binary", 3 * bins)
        counts = parts.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("listed").alias("listed"))
        closer = counts.join(F.broadcast(narrow.select("g", "k")), "g").groupBy("g").applyInPandas(held, "g string, k long, lo double, hi double, sure boolean, few boolean")
        brackets = stored(closer if n_open == n else brackets.where(~is_open).unionByName(closer))
    return brackets.select("g", (1.0 / (2.0 * F.col("lo") + 1e-6)).alias("gamma"))


def _series(d: int) -> int:
    """The order K up to which the kernel's series over vectors of `d` components is summed by moments."""
    order = ORDERS
    while order > 1 and math.comb(d + order - 1, order - 1) * (d + 1) > MOMENTS:
        order -= 1
    return order


def _products(x: np.ndarray, order: int) -> np.ndarray:
    """All products of up to `order` components of each row, degree by degree, as columns."""
    levels, starts = [np.ones((1, len(x)))], [0] * x.shape[1]
    for _ in range(order):
        parts = [levels[-1][start:] * x[:, c] for c, start in enumerate(starts)]  # a component times the products of it and later ones
        levels.append(np.concatenate(parts))
        starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].tolist()
    return np.concatenate(levels)


def _times(d: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every product of `_products`: in how many orders its factors can be taken, and its degree."""
    levels, counts = [np.zeros((1, d), np.int64)], []
    starts = [0] * d
    for _ in range(order):
        parts = [levels[-1][start:] + np.eye(d, dtype=np.int64)[c] for c, start in enumerate(starts)]
        levels.append(np.concatenate(parts))
        starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].tolist()
    factorial = np.array([float(math.factorial(k)) for k in range(order + 1)])
    for k, powers in enumerate(levels):
        counts.append(factorial[k] / factorial[powers].prod(1))
    return np.concatenate(counts), np.repeat(np.arange(order + 1), [len(level) for level in levels])


def _beyond(spread: np.ndarray, order: int) -> np.ndarray:
    """Root of the share of a vector's series beyond `order`, at most: a Poisson tail. `spread` is 2 gamma |x|^2."""
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.exp((order + 1) * np.log(spread) - spread - math.lgamma(order + 2)) / (1 - spread / (order + 2))
    return np.sqrt(np.where(spread < order + 1, np.nan_to_num(first.clip(0, 1)), 1.0))


def _kernel_sums(grid: DataFrame, gammas: DataFrame) -> DataFrame:
    """(g, _ref, _cand, _cross): sums of the kernel over all ordered pairs, without those of a vector with itself.

    With x and y taken from the mean of the reference, exp(-gamma |x - y|^2) = exp(-gamma |x|^2) exp(-gamma |y|^2) exp(2 gamma x y). The
    terms of the last series up to an order K are sums of products of moments, one pass over the vectors. What lies beyond is summed over
    pairs, but for those where both vectors are so near to the mean that it is below TINY: with few components that is most of them.
    Of the others, pairs with 2 gamma |x| |y| <= 1 need few more terms, which are small and taken in single precision.
    """
    strips = grid.where("nb is null")  # every strip once
    top = gammas.agg(F.max("gamma")).first()[0] or 0.0
    scale = math.sqrt(2 * top)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for na, a in zip(batch["na"], batch["a"]):
                yield pd.DataFrame({"n": [na], "s": [_sides(na, a, None, None)[0].sum(0).tolist()]})

    sums = strips.where("kind = 'ref'").select("na", "a").mapInPandas(total, "n long, s array<double>").collect()  # a row per strip
    center = np.sum([r["s"] for r in sums], axis=0) / sum(r["n"] for r in sums) if sums else 0.0

    def sides(na, a, nb, b):
        return tuple(m - center for m in _sides(na, a, nb, b))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, na, a, targets in batch.itertuples(index=False, name=None):
                if not len(targets):
                    continue
                x, _ = sides(na, a, None, None)
                gamma = np.array([t["gamma"] for t in targets])
                order, spread = _series(x.shape[1]), scale**2 * (x * x).sum(1)
                x, spread = scale * x[spread < FAR], spread[spread < FAR]
                weights = np.exp(-np.multiply.outer(spread, gamma / scale**2))
                n = math.comb(x.shape[1] + order - 1, order - 1)
                step, out = max(1, (1 << 20) // n), np.zeros((n, len(gamma) * (x.shape[1] + 1)))
                for i in range(0, len(x), step):
                    some = x[i : i + step]
                    wide = np.hstack((np.ones((len(some), 1)), some))
                    out += _products(some, order - 1) @ (weights[i : i + step, :, None] * wide[:, None]).reshape(len(some), -1)
                out = out.reshape(len(out), len(targets), -1)
                for k, t in enumerate(targets):
                    yield pd.DataFrame({"kind": [kind], "g": [t["g"]], "n": [int(na)], "d": [x.shape[1]], "gamma": [t["gamma"]], "m": [out[:, k].tobytes()]})

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        d, gamma = int(rows["d"].iloc[0]), rows["gamma"].iloc[0]
        order, found, n = _series(d), {}, {}
        times, degree = _times(d, order - 1)
        for kind, m, count in rows[["kind", "m", "n"]].itertuples(index=False, name=None):
            m = np.frombuffer(m).reshape(-1, d + 1) * (math.sqrt(2 * gamma) / scale) ** (degree[:, None] + (np.arange(d + 1) > 0))
            found[kind], n[kind] = found.get(kind, 0.0) + m, n.get(kind, 0) + count
        factorial = np.array([float(math.factorial(k)) for k in range(order + 1)])

        def product(a, b):
            a, b = found.get(a), found.get(b)
            if a is None or b is None:
                return 0.0
            last = degree == order - 1
            return float((times / factorial[degree] * a[:, 0] * b[:, 0]).sum() + (times[last, None] * a[last, 1:] * b[last, 1:]).sum() / factorial[order])

        row = {"_ref": product("ref", "ref") - n.get("ref", 0), "_cand": product("cand", "cand") - n.get("cand", 0), "_cross": product("ref", "cand")}
        return pd.DataFrame({"g": rows["g"].iloc[:1], **row})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, na, a, nb, b, targets in batch.itertuples(index=False, name=None):
                if len(targets):
                    gamma = np.array([t["gamma"] for t in targets])
                    found = _rest(*sides(na, a, nb, b), b is None, gamma, scale)
                    weight = 2 if kind != "cross" and b is not None else 1
                    yield pd.DataFrame({"kind": kind, "g": [t["g"] for t in targets], "s": weight * found})

    aimed = _aimed(grid, gammas).select("kind", "na", "a", "nb", "b", "targets")
    low = aimed.where("nb is null").select("kind", "na", "a", "targets")
    low = low.mapInPandas(moments, "kind string, g string, n long, d int, gamma double, m binary")
    low = low.groupBy("g").applyInPandas(joined, "g string, _ref double, _cand double, _cross double")
    high = aimed.mapInPandas(rest, "kind string, g string, s double")
    high = high.groupBy("g").agg(*[F.sum(F.when(F.col("kind") == k, F.col("s")).otherwise(0.0)).alias(f"_{k}") for k in ("ref", "cand", "cross")])
    return low.unionByName(high).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("_ref", "_cand", "_cross")])


def _rest(x: np.ndarray, y: np.ndarray, own: bool, gamma: np.ndarray, scale: float) -> np.ndarray:
    """For each of the kernel widths, the sum over all pairs of a tile of what `_kernel_sums` leaves to the pairs."""
    order, most, ratio = _series(x.shape[1]), gamma.max(), gamma / gamma.max()
    total, room = np.zeros(len(gamma)), np.empty((2, PART[0] * PART[1]), np.float32)

    def prepared(v, other):
        far = scale**2 * (v * v).sum(1) >= FAR
        spread = 2 * most * (v * v).sum(1)
        open_ = np.where(far, 1.0, _beyond(spread, order))
        at = np.argsort(spread, kind="stable")
        at = at[open_[at] * other > TINY]
        v, spread, open_, far = math.sqrt(2 * most) * v[at], spread[at], open_[at], far[at]
        weights = np.exp(-np.multiply.outer(spread / 2, ratio))
        near = v * ~far[:, None], weights * ~far[:, None]  # those far off have no moments
        return v, spread, open_, weights, *near, v.astype(np.float32), weights.astype(np.float32)

    def largest(v):
        far = scale**2 * (v * v).sum(1) >= FAR
        return np.where(far, 1.0, _beyond(2 * most * (v * v).sum(1), order)).max()

    left = prepared(x, largest(y))
    right = left if own else prepared(y, largest(x))

    def block(rows: slice, columns: slice) -> np.ndarray:
        (v, spread, open_, weights, v_low, low, v32, _), (w, spread2, open2, _, w_low, low2, w32, weights32) = ([c[s] for c in side] for side, s in ((left, rows), (right, columns)))
        if open_.max() * open2.max() <= TINY:
            return np.zeros(len(gamma))
        bound = math.sqrt(spread.max() * spread2.max())
        if bound <= NEAR:
            z, power = (r[: len(v32) * len(w32)].reshape(len(v32), -1) for r in room)
            np.matmul(v32, w32.T, out=z)
            power[:], k = z, 1
            for bit in bin(order + 1)[3:]:  # square and multiply
                np.multiply(power, power, out=power)
                k *= 2
                if bit == "1":
                    np.multiply(power, z, out=power)
                    k += 1
            out = 0.0
            while True:
                term = (weights * (power @ weights32)).sum(0) * ratio**k / math.factorial(k)
                out = out + term
                if k % 2 == 0 and np.abs(term).max() * math.exp(bound) * bound <= 1e-13 * z.size * (k + 1):  # bounds all that follow
                    return out
                np.multiply(power, z, out=power)
                k += 1
        z_low = v_low @ w_low.T
        if bound > 1000.0:  # too far off for sums of squares, which would cancel
            halves = -sum((v[:, c, None] - w[:, c]) ** 2 for c in range(v.shape[1])) / 2
        else:
            halves = np.minimum(v @ w.T - spread[:, None] / 2 - spread2 / 2, 0.0)
        out = np.empty(len(gamma))
        for t, r in enumerate(ratio):
            terms = np.ones_like(z_low)
            for k in range(order, 0, -1):
                terms *= z_low * (r / k)
                terms += 1.0
            terms *= low[:, t, None] * low2[:, t]
            out[t] = (np.exp(r * halves) - terms).sum()
        return out

    for i in range(0, len(left[0]), PART[0]):
        rows, first = slice(i, i + PART[0]), 0
        if own:
            total += block(rows, rows)
            first = i + PART[0]
        for j in range(first, len(right[0]), PART[1]):
            total += (2 if own else 1) * block(rows, slice(j, j + PART[1]))
    return total


def mmd_rbf(
    reference: DataFrame, candidates: DataFrame, by: str, key: str, gamma: float | None = None, block_rows: int | None = None
) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel of each candidate group against the reference: (by, n_ref, n, gamma, mmd).

    Exact over all pairs; `key` identifies a vector. Without `gamma` the median rule sets it per group. Sizes may differ; the value may
    be negative, and is null where a set has one vector.
    """
    grid, sizes = tiles(reference, candidates, by, key, block_rows)
    groups = sizes.where("set = 'cand'").select("g", "n")
    gammas = groups.select("g", F.lit(gamma).cast("double").alias("gamma")) if gamma is not None else mmd_gammas(grid)
    sums = _kernel_sums(grid, gammas)
    n_ref = sizes.where("set = 'ref'").agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    info = groups.join(gammas, "g").withColumn("n_ref", n_ref)
    n, m = F.col("n_ref"), F.col("n")
    inside = F.try_divide(F.col("_ref"), n * (n - 1)) + F.try_divide(F.col("_cand"), m * (m - 1))  # null for a single vector
    value = inside - 2 * F.try_divide(F.col("_cross"), n * m)
    return info.join(sums, "g").select(F.col("g").alias(by), "n_ref", "n", "gamma", value.alias("mmd"))


def distances(reference: DataFrame, candidates: DataFrame, by: str, key: str) -> DataFrame:
    """Frechet distance and MMD of each candidate group to the reference."""
    fid = frechet(reference, candidates, [by]).select(F.col(by).cast("string").alias(by), "n_ref", "n", "fid")
    return fid.join(mmd_rbf(reference, candidates, by, key).select(by, "gamma", "mmd"), by)


# --- PCA and probe ------------------------------------------------------------------------------------------------------------


def pca_2d(df: DataFrame) -> DataFrame:
    """Joint PCA of all sets onto two axes, centred on the joint mean: adds pc1 and pc2. Signs follow the largest loading."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = df.withColumn("_x", array_to_vector(F.col("vec").cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(points).transform(points)
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    scores = vector_to_array("_p")
    out = model.transform(centred)
    return out.select(*df.columns, (scores[0] * signs[0]).alias("pc1"), (scores[1] * signs[1]).alias("pc2"))


def pca_plane(df: DataFrame) -> DataFrame:
    """`pca_2d` of vectors of two components in closed form: the axes are turned by half the angle of (a - c, 2b)."""
    m = df.transform(plane_moments, []).agg(F.first(F.struct("*"))).scalar()
    turned = df.withColumn("_m", m).withColumn("_t", F.atan2(2 * F.col("_m.b"), F.col("_m.a") - F.col("_m.c")) / 2)
    x, y = F.get("vec", F.lit(0)) - F.col("_m.mx"), F.get("vec", F.lit(1)) - F.col("_m.my")
    cos, sin = F.cos("_t"), F.sin("_t")  # of the first axis, (cos, sin); the second one is (-sin, cos)

    def sign(larger: Column, smaller: Column) -> Column:
        return F.when(F.when(F.abs(larger) >= F.abs(smaller), larger).otherwise(smaller) >= 0, 1.0).otherwise(-1.0)

    pc1, pc2 = (cos * x + sin * y) * sign(cos, sin), (cos * y - sin * x) * sign(-sin, cos)
    return turned.select(*df.columns, pc1.alias("pc1"), pc2.alias("pc2"))


def fit_probe(train: DataFrame, target: str = "severity", feature: str = "vec"):
    """Least-squares probe target ~ vec, by the normal equations (one pass, D x D)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = train.select(F.col(target).cast("double").alias(target), array_to_vector(F.col(feature).cast("array<double>")).alias("_x"))
    return LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(data)


def predict_probe(model, df: DataFrame, feature: str = "vec") -> DataFrame:
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
    dot = F.aggregate(F.zip_with(F.col(feature), weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("prediction", dot + float(model.intercept))


def probe_metrics(scored: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """MSE, R2 = 1 - mse / var (ddof 1; 0 when var is 0), slope and intercept of predicted on true."""
    err = F.col(predicted) - F.col(truth)
    parts = scored.groupBy(*by).agg(
        F.avg(err * err).alias("mse"),
        F.var_samp(truth).alias("_var"),
        F.regr_slope(predicted, truth).alias("slope"),
        F.regr_intercept(predicted, truth).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).otherwise(0.0)
    return parts.withColumn("r2", r2).drop("_var")


def probe_delta(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """R2 per corruption for two models and their difference, from rows (model, corruption, r2)."""
    wide = metrics.groupBy("corruption").pivot("model", [first, second]).agg(F.first("r2"))
    return wide.select(
        "corruption", F.col(first).alias("r2_first"), F.col(second).alias("r2_second"), (F.col(second) - F.col(first)).alias("delta")
    )
