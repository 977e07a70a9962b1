"""Quality classification by nearest-neighbour voting.

A text's terms are triples of character shapes (lower, upper, digit, blank, line end, each ASCII mark), weighted by log-count and
inverse document frequency among the labelled rows. A truncated singular value decomposition of the labelled rows gives the latent
space. The labelled vectors are broadcast; each text is compared with all of them in blocks by exact cosine products, and its `k`
nearest vote with their similarity as weight. The score is the weighted share of label 1.

Labels come from at most about `train_rows` rows outside the held-out fold, taken by hash of the id; that bounds the broadcast.
Null and empty texts, and texts of fewer than three characters, get the labelled share of label 1. No labelled row: score 0.5.
Repeated labels of a document are averaged. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import carried, carried_type, held_out, per_row, uncarried

_SHAPE = np.zeros(256, np.int64)
for _b in range(256):
    _SHAPE[_b] = 0 if _b >= 128 or 97 <= _b <= 122 else 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b == 10 else 4
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_SHAPE[_MARKS] = np.arange(5, 5 + len(_MARKS))
SHAPES = 5 + len(_MARKS)
TERMS = SHAPES**3
_PIECE = 1 << 22


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Which terms a text has, and log(1 + count) of each relative to its length."""
    data = (text or "").encode()
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    count = np.zeros(TERMS)
    for start in range(0, len(data) - 2, _PIECE):
        s = _SHAPE[np.frombuffer(data[start : start + _PIECE + 2], np.uint8)]
        count += np.bincount((s[:-2] * SHAPES + s[1:-1]) * SHAPES + s[2:], minlength=TERMS)
    which = np.flatnonzero(count)
    return which, np.log1p(1000 * count[which] / (len(data) - 2))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 2000, dims: int = 32) -> dict:
    """The latent space and the labelled vectors."""
    labelled = (
        labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg("quality").alias("label"))
    )
    n = labelled.count()
    rate = F.lit(int(1_000_003 * min(1.0, train_rows / max(n, 1))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        found = [terms(t) for t in frame["text"]]
        return pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "term": [t.tolist() for t, _ in found], "weight": [w.tolist() for _, w in found]})

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about train_rows rows
    rows = per_row(joined, "doc_id long, label double, term array<int>, weight array<double>", ["doc_id", "label", "text"], work).toPandas()
    if rows.empty:
        return {"prior": 0.5, "vectors": None}
    rows = rows.sort_values(["doc_id"], kind="stable").reset_index(drop=True)
    used, inverse = np.unique(np.concatenate([np.asarray(t, np.int64) for t in rows["term"]]), return_inverse=True)
    if not len(used):
        return {"prior": float(rows["label"].mean()), "vectors": None}
    matrix = np.zeros((len(rows), len(used)), np.float32)
    matrix[np.repeat(np.arange(len(rows)), rows["term"].map(len)), inverse] = np.concatenate(rows["weight"].to_numpy())
    idf = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))) + 1
    matrix *= idf
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(float))
    kept = np.argsort(values)[::-1][: min(dims, len(rows))]
    kept = kept[values[kept] > 1e-8]
    basis = (matrix.T @ vectors[:, kept]) / np.sqrt(values[kept])
    full = np.zeros((TERMS, len(kept)), np.float32)
    full[used] = basis * idf[:, None]
    latent = matrix @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return {"prior": float(rows["label"].mean()), "vectors": latent.astype(np.float32), "labels": rows["label"].to_numpy(float), "basis": full}


def vote(latent: np.ndarray, model: dict, k: int) -> np.ndarray:
    """Weighted share of label 1 among the k nearest; exact products, 256 texts against all labelled vectors at a time."""
    out = np.empty(len(latent))
    k = min(k, len(model["labels"]))
    for start in range(0, len(latent), 256):
        similarity = latent[start : start + 256] @ model["vectors"].T
        near = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(similarity, near, axis=1), 1e-6).astype(float) ** 4
        out[start : start + 256] = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, k: int = 15, threshold: float = 0.7, train_rows: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the `carry` columns: one row per row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if labelled_docs is None else labelled_docs, labels, train_rows))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), carried(carry))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        m = model.value
        result = np.full(len(frame), m["prior"])
        if m["vectors"] is not None:
            latent = np.zeros((len(frame), m["vectors"].shape[1]), np.float32)
            for i, text in enumerate(frame["text"]):
                which, weight = terms(text)
                latent[i] = weight.astype(np.float32) @ m["basis"][which]
            norm = np.linalg.norm(latent, axis=1)
            some = norm > 1e-9
            result[some] = vote(latent[some] / norm[some, None], m, k) if some.any() else 0
        out = pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": result, "predicted": (result >= threshold).astype(int)})
        return out.assign(carried=frame["carried"])

    return uncarried(per_row(rows, f"doc_id long, held_out boolean, score double, predicted int, {carried_type(rows)}", rows.columns, work), carry)
