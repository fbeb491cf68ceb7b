"""Document quality: logistic regression over hashed word n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts
from .ragged import token_hashes

BITS = 18
#: Features are shares of a text's n-grams, times this.
SCALE = 20.0
#: A word that one of the last REACH words already was gives the n-gram REPEAT besides
#: (a skip-gram of a word with itself, whatever the word).
REACH, REPEAT = 4, np.uint64(0xA0761D6478BD642F)
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, word pairs and repeats of some texts, and each one's text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in batch]
    ends = np.cumsum([len(p) + 1 for p in parts])
    h, start, _ = token_hashes(b"\n".join(parts))
    of = np.searchsorted(ends, start, "right")
    again = np.zeros(len(h), bool)
    for k in range(1, REACH + 1):
        again[k:] |= (h[k:] == h[:-k]) & (of[k:] == of[:-k])
    pairs = (h[:-1] * np.uint64(3) + h[1:]) * MIX
    inside = of[1:] == of[:-1]
    found = np.concatenate([h * MIX, pairs[inside], np.full(int(again.sum()), REPEAT)])
    found ^= found >> np.uint64(29)
    return (found * MIX) >> np.uint64(64 - BITS), np.concatenate([of, of[1:][inside], of[again]])


class Ftrl:
    """Follow-the-regularised-leader, one weight for each hashed feature and a bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sparse(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values, the bias last."""
    at, count = np.unique(g.astype(np.int64), return_counts=True)
    return np.append(at, 1 << BITS), np.append(count * (SCALE / max(len(g), 1)), 1.0)


def scores(batch: list[str], w: np.ndarray) -> np.ndarray:
    """Probabilities of a batch: one sparse dot product for each text."""
    g, of = grams(batch)
    total = np.bincount(of, w[g.astype(np.int64)], len(batch))
    size = np.bincount(of, minlength=len(batch))
    return 1 / (1 + np.exp(-np.clip(total * SCALE / np.maximum(size, 1) + w[-1], -35, 35)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's digits leaves no rest by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = 4_000, passes: int = 3) -> np.ndarray:
    """Weights learned from labelled documents that aren't held out.

    ``most_rows`` bounds the labelled sample: the ids of smallest xxhash64. That
    sample, ids and labels alone, is broadcast, so only its texts are shuffled.
    One task trains one model on them, in the order of these hashes, ``passes``
    times over; its weights, 2 MB, come to the driver. Rows with a null id or
    label are no examples; of contradicting labels of an id the largest counts.
    Without examples all weights are zero.
    """
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).dropna()
    lab = lab.filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.join(F.broadcast(lab), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for b in pieces(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen.append((*sparse(grams([t])[0]), y))
        for _ in range(passes):
            for at, x, y in seen:
                model.learn(at, x, y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], ["w"])

    got = rows.select("text", "y").mapInArrow(run, "w binary").first()
    return np.frombuffer(got.w, np.float32).astype(float) if got else np.zeros((1 << BITS) + 1)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row.

    A null text counts as empty and an empty text gets the bias alone. Null ids
    stay (held out), repeated rows are each scored, an empty table gives an
    empty one, other columns are no inputs, and texts are scored whole. A worker
    holds one batch and one 2 MB weight vector.
    """
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    weights = spark.sparkContext.broadcast(fit(t, labels, most_rows=most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in pieces(batches):
            ts = b.column("text").to_pylist()
            got = np.concatenate([*(scores(ts[i : i + 100], w) for i in range(0, len(ts), 100)), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got)], ["doc_id", "held_out", "score"])

    scored = t.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
