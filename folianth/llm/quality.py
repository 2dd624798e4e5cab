"""Quality classifier: support vectors over naive Bayes ratios (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianth.llm.blocks import bounded, ids_and_texts, text_buffers

#: Hashed space of the indicators.
FEATURES = 1 << 16
#: So many labelled rows at most fit the linear model, those with the least hash of doc_id; ratios count all of them.
FIT_ROWS = 6000
BROADCAST_IDS = 1 << 20
_COUNT_BLOCK = 1 << 12


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Indicators:
    """Distinct hashed byte n-grams of 2 to 4 bytes in a text."""

    def __init__(self) -> None:
        self.seen = np.zeros(FEATURES, bool)

    def of(self, data: np.ndarray) -> np.ndarray:
        x = data.astype(np.uint32)
        for n in (2, 3, 4):
            if len(x) >= n:
                h = np.full(len(x) - n + 1, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) ^ x[j : len(x) - n + 1 + j]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                self.seen[h >> np.uint32(16)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def _labelled(docs: DataFrame, labels: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    rows = F.broadcast(rows) if n <= BROADCAST_IDS else rows
    return docs.join(rows, "doc_id").select("label", "text")


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class and, for each class and feature, how many have it: from all rows, in bounded arrays."""

    def count(batches):
        have, n, ind = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64), Indicators()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for y, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                have[y, ind.of(data[a:b])] += 1
                n[y] += 1
        if n.any():
            blocks = range(0, FEATURES, _COUNT_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([b // _COUNT_BLOCK for b in blocks], pa.int32()), pa.array([have[:, b : b + _COUNT_BLOCK].tobytes() for b in blocks]), pa.array([n.tobytes()] * len(blocks))], ["block", "have", "n"])

    def add(table: pa.Table) -> pa.Table:
        have = sum(np.frombuffer(x, np.int64) for x in table["have"].to_pylist())
        n = sum(np.frombuffer(x, np.int64) for x in table["n"].to_pylist())
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "have": [have.tobytes()], "n": [n.tobytes()]})

    out = rows.mapInArrow(count, "block int, have binary, n binary").groupBy("block").applyInArrow(add, "block int, have binary, n binary").collect()
    have, n = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for r in out:
        have[:, r.block * _COUNT_BLOCK : (r.block + 1) * _COUNT_BLOCK] = np.frombuffer(r.have, np.int64).reshape(2, -1)
        n = np.frombuffer(r.n, np.int64)
    return n, have


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 0.1, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Weights on indicators of a linear hinge-loss model whose inputs are ratio times indicator, and its bias."""
    w, bias = np.zeros(len(ratio)), 0.0
    scale = np.array([1 / max(1e-12, np.sqrt(np.square(ratio[x]).sum() + 1)) for x in rows])  # unit length
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    limit = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, s = rows[i], scale[i]
            gradient = y[i] * s * (np.dot(w[x], ratio[x]) + bias) - 1
            new = min(max(alpha[i] - gradient, 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] * s
                w[x] += step * ratio[x]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w * ratio, bias


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cost: float = 1.0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Indicators of byte n-grams are scaled by the classes' log-count ratios over all labelled rows that aren't held out,
    and a linear hinge-loss model is fitted by dual coordinate descent on at most fit_rows of those. score is the
    logistic of the margin. Null and empty texts get the bias alone. Without labels of both classes every score is 0.5.
    Rows without a doc_id are not held out and scored like others; repeated rows are scored each; other columns,
    also those named as labels' columns, are ignored.
    """
    docs = ids_and_texts(docs)
    rows = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    weights, bias = np.zeros(FEATURES), 0.0
    n, have = _class_counts(_labelled(docs, labels, rows, rows.count()))
    if n.all():
        p, q = (have[1] + 1.0) / (n[1] + 2.0), (have[0] + 1.0) / (n[0] + 2.0)
        ratio = np.log(p / q)

        def indicators(batches):
            ind = Indicators()
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ind.of(data[a:b]).astype(np.uint16).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], ["label", "x"])

        chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        fit = _labelled(docs, labels, chosen, fit_rows).mapInArrow(indicators, "label int, x binary").orderBy("label", F.xxhash64("x")).toArrow()
        x = [np.frombuffer(b, np.uint16).astype(np.int64) for b in fit["x"].to_pylist()]
        y = np.where(fit["label"].to_numpy() == 1, 1.0, -1.0)
        if len(x):
            weights, bias = dual_coordinate_descent(x, y, ratio, cost)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias, np.log((have[1] + 1.0) / (n[1] + 2.0)) - np.log((have[0] + 1.0) / (n[0] + 2.0))))

    def score(batches):
        weights, bias, ratio = model.value
        ind = Indicators()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in bounded(offsets):
                out = []
                for i in range(a, b):
                    x = ind.of(data[offsets[i] : offsets[i + 1]])
                    out.append((weights[x].sum() + bias) / np.sqrt(np.square(ratio[x]).sum() + 1))
                s = 1 / (1 + np.exp(-4 * np.array(out)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
