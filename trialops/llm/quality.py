"""Quality by attention-based multiple-instance learning.

A document is a bag of passages; only documents carry labels.  Each passage is encoded by the
frequencies of its characters and character pairs, its length and how little it repeats, and a
tanh layer.  Gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages of a
document; a logistic layer scores their weighted sum.  Encoder, attention and score are learned
together from document labels (Adam, fixed seed) on a bounded sample; scoring is one pass over
whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.llm.labelled import sample

#: Bound of the training sample, in documents of each label.
DOCUMENTS = 3_000
PASSAGE = 512
PAIRS = 128
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 24, 256, 0.01, 1e-4
THRESHOLD = 0.3
#: Passages encoded at once.
CHUNK = 4_096


def passages(text: str) -> list[bytes]:
    data = text.encode()
    return [data[a : a + PASSAGE] for a in range(0, len(data), PASSAGE)] or [b""]


def encode(parts: list[bytes]) -> np.ndarray:
    """Features of passages: characters, hashed character pairs, length, variety of 4-grams."""
    n = len(parts)
    block = np.zeros((n, PASSAGE), np.uint8)
    lengths = np.array([len(p) for p in parts])
    block[np.arange(PASSAGE) < lengths[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    rows = np.arange(n)[:, None]
    kinds = np.minimum(block, 128).astype(np.int64)
    there = np.arange(PASSAGE) < lengths[:, None]

    def shares(codes: np.ndarray, seen: np.ndarray, bins: int) -> np.ndarray:
        counts = np.bincount((rows * bins + codes)[seen], minlength=n * bins).reshape(n, bins)
        return counts / np.maximum(1, counts.sum(axis=1, keepdims=True)), counts

    singles, _ = shares(kinds, there, 129)
    pair = ((block[:, :-1].astype(np.int64) * 31 + block[:, 1:]) * 0x9E3779B1 >> 8) % PAIRS
    pairs, _ = shares(pair, there[:, 1:], PAIRS)
    four = block.astype(np.int64)
    four = ((four[:, :-3] * 31 + four[:, 1:-2]) * 31 + four[:, 2:-1]) * 31 + four[:, 3:]
    _, counts = shares((four * 0x9E3779B1 >> 7) % 1024, there[:, 3:], 1024)
    variety = (counts > 0).sum(axis=1) / np.maximum(1, lengths - 3)
    return np.column_stack([np.sqrt(singles), np.sqrt(pairs), np.log1p(lengths) / 6, np.clip(variety, 0, 1)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray):
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (t * g) @ w["a"]
    s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a = s / np.add.reduceat(s, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return bag, h, t, g, a, z, p


def _gradients(w, x, starts, y, importance):
    bag, h, t, g, a, z, p = _forward(w, x, starts)
    dout = (p - y) * importance / len(y)
    dz = dout[:, None] * w["c"]
    da = (dz[bag] * h).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, starts)[bag])
    dtg = ds[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    dpre = dh * (1 - h**2)
    return {"E": x.T @ dpre, "e": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dout, "d": np.array(dout.sum())}


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Learn from whole texts and their labels; with one label only, its share is every score."""
    bags = [passages(t) for t in texts]
    sizes = np.array([len(b) for b in bags], np.int64)
    parts = [p for b in bags for p in b] or [b""]
    x = np.concatenate([encode(parts[a : a + CHUNK]) for a in range(0, len(parts), CHUNK)])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(11)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"E": draw(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.array(0.0)}
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
        return Model(mean, spread, {**w, "c": np.zeros(HIDDEN), "d": np.array(np.log(share / (1 - share)))})
    x = (x - mean) / spread
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Both labels weigh as much as each other would at equal counts, softened towards their shares.
    importance = np.where(y == 1, 1.0, np.sqrt((y == 1).sum() / (y == 0).sum()))
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes[pick])[:-1]])
            step += 1
            for k, grad in _gradients(w, x[rows], starts, y[pick], importance[pick]).items():
                grad = grad + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, w)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> Model:
    return fit(*sample(documents, labels, label, {1: DOCUMENTS, 0: DOCUMENTS}, held_out))


def predict(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of whole texts; long documents are encoded passage block by passage block."""
    out, waiting, sizes = [], [], []

    def flush():
        x = np.concatenate([encode(waiting[a : a + CHUNK]) for a in range(0, len(waiting), CHUNK)])
        out.extend(_forward(model.weights, (x - model.mean) / model.spread, np.concatenate([[0], np.cumsum(sizes)[:-1]]))[-1])

    for text in texts:
        bag = passages(text)
        waiting += bag
        sizes.append(len(bag))
        if len(waiting) >= CHUNK:
            flush()
            waiting, sizes = [], []
    if waiting:
        flush()
    return np.array(out)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` and ``score`` (0 to 1) of the whole text.

    Null and empty texts are one empty passage.  A column named ``score`` is replaced.
    """

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(model, [t or "" for t in texts]))

    return documents.withColumn("score", F.pandas_udf(of, "double", F.PandasUDFType.SCALAR_ITER)("text"))
