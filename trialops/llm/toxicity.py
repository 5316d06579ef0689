"""Toxicity by compression distance: windows are compressed under two zstandard dictionaries.

The ordinary dictionary is ordinary training text, windows taken evenly from all of it.  The toxic
one is trained on toxic text: the segments that recur in toxic documents and stand in a far larger
share of them than of ordinary ones, most frequent last, then the same ordinary text, so that the two lengths of a window differ by what toxic text explains.  Every
text is cut into windows at spaces; a document's evidence is how often each difference of lengths
occurs among all its windows.  A logistic calibration, fitted on labelled documents that neither
dictionary has seen, turns it into a score; the caller compares that with a threshold.

Training uses a bounded sample on the driver; scoring is one pass over whole texts, without a
shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.llm.labelled import logistic, sample

#: Bounds of the training sample, in documents.
TOXIC_DOCUMENTS, ORDINARY_DOCUMENTS = 3_000, 6_000
WINDOW = 256
GRAM = 5
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
#: Times the share of ordinary documents that a toxic gram has among toxic ones, half a document added to each.
RATIO = 10
LOW, HIGH = -3, 10
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in lower case, cut at the last space before ``size`` bytes if there is one."""
    data, out, at = text.lower().encode(), [], 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            space = data.rfind(b" ", at, end)
            end = space if space > at else end
        out.append(data[at:end])
        at = end
    return out or [b""]


def _grams(data: bytes) -> set[bytes]:
    return {data[i : i + GRAM] for i in range(len(data) - GRAM + 1)}


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Segments of toxic text that recur in it at ``RATIO`` times their rate in ordinary text."""
    found: Counter[bytes] = Counter()
    for data in toxic:
        found.update(_grams(data))
    least = max(2, len(toxic) // 300)
    found = Counter({g: n for g, n in found.items() if n >= least})
    also: Counter[bytes] = Counter()
    for data in ordinary:
        also.update(found.keys() & _grams(data))
    few, many = RATIO * (len(toxic) + 1), len(ordinary) + 1
    found = Counter({g: n for g, n in found.items() if (n + 0.5) * many >= (also[g] + 0.5) * few})
    segments: Counter[bytes] = Counter()
    for data in toxic:
        counts = [found.get(data[i : i + GRAM], 0) for i in range(len(data) - GRAM + 1)] + [0]
        run: list[int] = []
        for i, n in enumerate(counts):
            if n:
                run.append(i)
            elif run:
                strong = 0.3 * max(counts[j] for j in run)
                start = None
                for j in [*run, run[-1] + 1]:
                    if counts[j] >= strong and counts[j] > 0:
                        start = j if start is None else start
                    elif start is not None:
                        segments[data[start : j - 1 + GRAM]] += 1
                        start = None
                run = []
    kept, size = [], 0
    for segment, n in segments.most_common():
        if n < 2:
            break
        # a shorter one may still fit
        if size + len(segment) > TOXIC_BYTES:
            continue
        kept.append(segment)
        size += len(segment)
    return b"".join(reversed(kept))


def spread(texts: list[str], size: int) -> bytes:
    """Windows of all texts at even distances, ``size`` bytes at most."""
    parts = [w for t in texts for w in windows(t)]
    n = min(len(parts), size // WINDOW)
    return b"".join(parts[k * len(parts) // n] for k in range(n))


def _compressor(dictionary: bytes):
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=GRAM, target_length=64,
        strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=settings).compress
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress


def evidence(texts: list[str], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Per text: counts and shares of the differences of lengths, their largest, and the size."""
    plain, other = _compressor(ordinary), _compressor(toxic)
    rows = np.zeros((len(texts), HIGH - LOW + 1))
    for row, text in zip(rows, texts, strict=True):
        for window in windows(text):
            row[min(max(len(plain(window)) - len(other(window)), LOW), HIGH) - LOW] += 1
    n = rows.sum(axis=1)
    largest = (rows > 0).shape[1] - 1 - np.argmax(rows[:, ::-1] > 0, axis=1)
    return np.column_stack([np.log1p(rows), rows / n[:, None], np.log(n), largest])


def train(documents: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> Model:
    """Fit dictionaries on three fifths of the sample and the calibration on the rest.

    Without labelled documents of both kinds, all scores are the share of toxic ones (0 if none).
    """
    texts, y = sample(documents, labels, label, {1: TOXIC_DOCUMENTS, 0: ORDINARY_DOCUMENTS}, held_out)
    part = np.zeros(len(y), np.int64)
    for kind in (0, 1):
        part[y == kind] = np.arange((y == kind).sum()) % 5
    data = [t.lower().encode() for t in texts]
    teach, rest = part < 3, part >= 3
    ordinary = [d for d, t, k in zip(data, teach, y, strict=True) if t and not k]
    base = spread([x for x, t, k in zip(texts, teach, y, strict=True) if t and not k], ORDINARY_BYTES)
    toxic = toxic_segments([d for d, t, k in zip(data, teach, y, strict=True) if t and k], ordinary) + base
    features = evidence([t for t, r in zip(texts, rest, strict=True) if r], base, toxic)
    if len(np.unique(y[rest])) < 2:
        share = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
        columns = evidence([""], base, toxic).shape[1]
        return Model(base, toxic, np.zeros(columns), np.ones(columns), np.append(np.zeros(columns), np.log(share / (1 - share))))
    mean, deviation = features.mean(axis=0), features.std(axis=0) + 1e-9
    weights = logistic(np.column_stack([(features - mean) / deviation, np.ones(len(features))]), y[rest], ridge=2.0)
    return Model(base, toxic, mean, deviation, weights)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` and ``score`` (0 to 1) of the whole text.

    Null and empty texts are one empty window.  A column named ``score`` is replaced.
    """

    def of(texts: pd.Series) -> pd.Series:
        features = evidence([t or "" for t in texts], model.ordinary, model.toxic)
        z = np.column_stack([(features - model.mean) / model.spread, np.ones(len(features))]) @ model.weights
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return documents.withColumn("score", F.pandas_udf(of, "double")("text"))
