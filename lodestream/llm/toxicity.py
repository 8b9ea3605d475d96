"""Toxicity from subword bags: averaged embeddings under a linear softmax, trained jointly in numpy.

A text is lower-cased, white space becomes one blank, and every run of three to five characters inside a word
(a blank at either end may be part of it) is hashed to one of ``BUCKETS`` rows. The mean of
these rows' embeddings goes into a softmax over two classes; embeddings and softmax are trained
together by minibatch gradient descent. A misspelt word shares most of its subwords with the word. Since
the model is linear after averaging, a trained text costs one number a subword.

The classifier is fit on a bounded sample: of either class the ``SAMPLE`` documents with the smallest hash of their
id; only these cross to the driver, as distinct subwords with counts. The bound is a parameter. Every text is scored
whole. The sample's share of toxic documents isn't the corpus's: a last step shifts the score so
that 0.5 separates best when the sample is weighted back to the labelled shares.

Defined cases: null and empty texts have no subwords and get the model's score without any; long texts are hashed whole, ``BLOCK`` characters at a
time; of rows that repeat a sampled id the largest text trains; documents without label or
with a null label don't train, of repeated labels of one id the larger counts; no labelled documents or only
one class give the label's share as every score (0 without any); repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
SAMPLE = (4500, 2000)  # of label 0 and label 1
DIM, EPOCHS, BATCH, RATE, GAIN = 8, 12, 32, 2.0, 100.0
CLIP = 0.25  # largest step of an embedding, before the rate
STEPS = 600  # at least so many batches, however few the documents
LEAST = 2  # documents of the sample that a subword must occur in to be trained
BLOCK = 1 << 18
_WHITE = re.compile(r"\s+")


def blocks(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The hashed subwords of a text, block by block."""
    if not text:
        return
    c = np.frombuffer(f" {_WHITE.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32)
    bits = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(c), BLOCK):
        b = c[at : at + BLOCK + 4]
        blank = b == 32
        h = b * np.uint32(0x9E3779B1)
        inner = np.zeros(len(b), bool)  # a blank strictly inside the run that begins here
        for n in (1, 2, 3, 4):
            k = len(b) - n
            if k <= 0:
                break
            h = (h[:k] ^ (h[:k] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b[n:] * np.uint32(0xC2B2AE35)
            if n > 1:
                inner = inner[:k] | blank[n - 1 : n - 1 + k]
                own = min(k, BLOCK)
                x = h[:own][~inner[:own]]
                yield (x ^ (x >> np.uint32(13))) * np.uint32(0x9E3779B1) >> bits


@dataclass
class Model:
    """Logit = mean of ``weights`` over the subwords + ``bias``."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for x in blocks(text, len(self.weights)):
            total += float(self.weights[x].sum(dtype=np.float64))
            n += len(x)
        z = (total / n if n else 0.0) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def gradient(e: np.ndarray, w: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, val: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Gradients of the weighted cross entropy by embeddings ``e``, softmax weights ``w`` and biases ``b``: document doc[i] has val[i] of embedding row[i], and label y."""
    m = len(y)
    h = np.stack([np.bincount(doc, val * e[row, d], m) for d in range(e.shape[1])], 1)
    z = h @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g = (p - np.eye(2)[y]) * weight[y][:, None] / m
    gh = (g @ w.T).astype(e.dtype)
    return np.stack([np.bincount(row, val * gh[doc, d], len(e)) for d in range(e.shape[1])], 1), h.T @ g, g.sum(0)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, buckets: int = BUCKETS, least: int = LEAST, seed: int = 7) -> Model:
    """Train on ``bags`` (distinct subwords, counts) with 0/1 ``labels``; ``share``: share of label 1 that the threshold counts with."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([b[0] for b in bags]), minlength=buckets) if bags else np.zeros(buckets, int)
    used = np.flatnonzero(seen >= least)
    # every fifth document of either class sets the threshold and isn't trained on
    turn = np.where(labels == 1, np.cumsum(labels), np.cumsum(1 - labels))
    check = turn % 5 == 0
    whole, labels_all, bags_all = [max(1, int(b[1].sum())) for b in bags], labels, bags
    bags = [(b[0][k], b[1][k]) for b in bags for k in [seen[b[0]] >= least]]
    e = (rng.standard_normal((len(used), DIM)) * 0.01).astype(np.float32)
    w, b = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    order = rng.permutation(np.flatnonzero(~check))
    batches = []
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        ids = np.concatenate([bags[i][0] for i in own])
        val = np.concatenate([bags[i][1] / whole[i] for i in own]).astype(np.float32) * GAIN
        size = np.array([len(bags[i][0]) for i in own])
        rows, inv = np.unique(ids, return_inverse=True)
        batches.append((np.searchsorted(used, rows), inv.astype(np.int32), val, np.repeat(np.arange(len(own)), size).astype(np.int32), labels[own]))
    weight = np.array([1.0, len(labels) / max(1, labels.sum()) - 1.0])
    weight /= (weight[0] * (labels == 0).sum() + weight[1] * labels.sum()) / len(labels)
    epochs = max(EPOCHS, -(-STEPS // max(1, len(batches))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            rows, inv, val, doc, y = batches[k]
            own = e[rows]
            ge, gw, gb = gradient(own, w, b, doc, inv, val, y, weight)
            ge *= np.minimum(1, CLIP / np.maximum(np.linalg.norm(ge, axis=1, keepdims=True), 1e-30))  # few subwords, great steps
            e[rows] = own - rate * ge.astype(np.float32)
            w -= (0.02 * rate * gw).astype(np.float32)
            b -= (0.02 * rate * gb).astype(np.float32)
    weights = np.zeros(buckets, np.float32)
    weights[used] = GAIN * (e @ (w[:, 1] - w[:, 0]))
    bias = float(b[1] - b[0])
    z = np.array([float((weights[i].astype(float) * n).sum() / k) for (i, n), k in zip(bags_all, whole)]) + bias
    if not (0 < labels_all[check].sum() < check.sum()):
        check[:] = True
    return Model(weights, bias - _threshold(z[check], labels_all[check], share))


def _threshold(z: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The logit at which errors, weighted to ``share``, are fewest; the middle of the widest such gap."""
    order = np.argsort(z)
    z, y = z[order], labels[order]
    pos, neg = share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())
    wrong = np.r_[0, np.cumsum(np.where(y == 1, pos, 0))] + np.r_[np.cumsum(np.where(y == 0, neg, 0)[::-1])[::-1], 0]
    edge = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
    gap = np.r_[0, np.diff(z), 0]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edge[best[np.argmax(gap[best])]])


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and how often each occurs."""
    got = list(blocks(text, buckets))
    return np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE, buckets: int = BUCKETS, least: int = LEAST) -> Model:
    """Train on ``docs`` (doc_id, text) by ``labels`` (doc_id, label 0/1), at most ``sample`` documents of either class."""
    import zstandard

    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).filter("__id is not null and y in (0, 1)").groupBy("__id").agg(F.max("y").alias("y"))
    total = known.agg(F.count("*"), F.sum("y")).first()
    share = (total[1] or 0) / total[0] if total[0] else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(1, np.float32), 500.0 if share else -500.0)
    own = [known.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample[y]) for y in (0, 1)]
    chosen = F.broadcast(own[0].unionByName(own[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            bags = [bag(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "ids": [z.compress(np.diff(i, prepend=0).astype("<u4").tobytes()) for i, _ in bags], "n": [z.compress(n.astype("<u4").tobytes()) for _, n in bags]})

    got = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(chosen, "__id").groupBy("__id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    rows = got.select(F.col("__id").cast("string").alias("id"), "y", "text").mapInPandas(run, "id string, y int, ids binary, n binary").toLocalIterator()
    u = zstandard.ZstdDecompressor()
    read = [(r.id, r.y, np.cumsum(np.frombuffer(u.decompress(r.ids), "<u4"), dtype=np.uint32), np.frombuffer(u.decompress(r.n), "<u4")) for r in rows]
    read.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in read])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1, np.float32), 500.0 if len(y) and y[0] else -500.0)
    return fit([r[2:] for r in read], y, share, buckets, least)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 where score >= 0.5) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.array([held.value.score(t) for t in b["text"]], float)
            yield pd.DataFrame({"id": b["id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    kind = docs.schema[doc_id].dataType.simpleString()
    got = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, score double, predicted int")
    return got.select(F.col("id").cast(kind).alias(doc_id), "score", "predicted")
