"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its bytes that occur in it at all
(not how often).  Each is worth the log ratio of its rates in toxic and clean
training texts; a logistic regression on the features so scaled is fitted on a
bounded, balanced sample of labelled rows and applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean
from .hashing import _LOWER, constants
from .tokens import in_slices

#: n-grams of bytes, of these lengths; white space counts as one space, and one stands at either end.
LENGTHS = (4, 5)
BITS = 20
#: Labelled rows of each class that the fit uses at most: those whose hashed doc_id is smallest.
TRAIN_ROWS = 1500
SMOOTHING = 0.5
L2 = 0.02
EPOCHS = 10
SEED = 7


class Grams:
    """Distinct n-gram ids of texts."""

    def __init__(self, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS):
        self.lengths, self.bits = lengths, bits
        self.byte = constants(256, 31)
        self.byte[[9, 10, 11, 12, 13]] = self.byte[32]
        self.place = constants(max(lengths), 37)
        self.seen = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = f" {text or ''} ".encode("utf-8", "surrogatepass").translate(_LOWER)
        v = self.byte[np.frombuffer(raw, np.uint8)]
        parts, total, done = [], np.zeros(len(v), np.uint64), 0
        for n in self.lengths:
            if len(v) < n:
                break
            while done < n:  # the hash of n places extends that of fewer
                m = len(v) - done
                total = total[:m] + v[done : done + m] * self.place[done]
                done += 1
            x = total ^ (total >> np.uint64(29))
            parts.append(((x * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - self.bits)).astype(np.int32))
        if not parts:
            return np.zeros(0, np.int32)
        ids = np.concatenate(parts)
        order = np.arange(len(ids), dtype=np.int32)
        self.seen[ids] = order  # the last place of each id stays
        return ids[self.seen[ids] == order]


class Model:
    """Weights of n-grams (already times their log-count ratios) and a bias; a score is a probability of label 1."""

    def __init__(self, weights: np.ndarray, bias: float, lengths: tuple[int, ...], bits: int):
        self.weights, self.bias, self.lengths, self.bits = weights, bias, lengths, bits

    def score(self, text: str | None, grams: Grams) -> float:
        z = float(self.weights[grams(text)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def fit(texts: list[str | None], labels: list[int], lengths: tuple[int, ...] = LENGTHS, bits: int = BITS, seed: int = SEED) -> Model:
    """A model from texts and their labels (1: toxic).

    With labels of one class only, or none, every text gets the smoothed share
    of label 1.
    """
    y = np.asarray(labels, np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    size = 1 << bits
    if not n1 or not n0:
        rate = (n1 + SMOOTHING) / (n1 + n0 + 2 * SMOOTHING)
        return Model(np.zeros(size, np.float32), float(np.log(rate / (1 - rate))), lengths, bits)
    grams = Grams(lengths, bits)
    rows = [grams(t) for t in texts]
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ends))
    with_1 = np.bincount(flat[y[of] == 1], minlength=size)
    with_0 = np.bincount(flat[y[of] == 0], minlength=size)
    # rates among each class's texts
    ratio = np.log((with_1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((with_0 + SMOOTHING) / (n0 + 2 * SMOOTHING))
    ratio[with_1 + with_0 < 2] = 0
    scaled = ratio[flat].astype(np.float32)
    # a text's features are divided by their norm's mean, so that step sizes suit any lengths of texts
    norm = float(np.sqrt(np.mean(np.bincount(of, scaled.astype(np.float64) ** 2, len(rows))))) or 1.0
    scaled /= norm
    w, bias = np.zeros(size), 0.0
    m, s = np.zeros(size), np.zeros(size)
    mb = sb = 0.0
    rng, t = np.random.default_rng(seed), 0
    batch = 128
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            chosen = order[a : a + batch]
            at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in chosen])
            local = np.repeat(np.arange(len(chosen)), np.diff(ends)[chosen])
            f, x = flat[at], scaled[at]
            z = np.bincount(local, w[f] * x, len(chosen)) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[chosen]
            grad = np.bincount(f, g[local] * x, size) / len(chosen) + L2 / len(rows) * w
            t += 1
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            gb = float(g.mean())
            mb += 0.1 * (gb - mb)
            sb += 0.001 * (gb * gb - sb)
            bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return Model((w * ratio / norm).astype(np.float32), bias, lengths, bits)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold: int = 5, held_out: int = 0, seed: int = SEED) -> Model:
    """Fit on at most ``rows`` labelled documents of each class, none of the held-out fold.

    Rows with a null label or doc_id, or without a document, are not used.  A
    document labelled both ways counts as toxic.  Of rows that repeat a doc_id
    one is used, that of the least text.  Null and empty texts are used as
    texts without features, long ones whole.  Sampled rows are those with the
    smallest hash of doc_id, so the sample is the same however the tables are
    partitioned; at most 2 * rows texts reach the driver.  Without labelled
    rows every text scores 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(crc_mod("doc_id", fold) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    # at most 2 * rows pairs of numbers: a proven bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    texts.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in texts], [r["toxic"] for r in texts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score double and predicted int (which replace columns of those names).

    Every row is scored from its whole text alone, however long; null and
    empty texts have the score of a text without features; equal texts have
    equal scores, and repeated rows are each returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats: a fixed size
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        grams = Grams(m.lengths, m.bits)
        for batch in batches:
            scores = [m.score(t, grams) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInArrow(lean(run), schema)
