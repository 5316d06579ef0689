"""Importance resampling towards a target set, features hashed by an Aho-Corasick automaton.

Words are runs of digits, lower-cased letters and bytes outside ASCII.  A piece of a batch of
texts has a dictionary of its distinct words, each with a delimiter on both sides; an entry
carries the word's CRC-32 and its length.  One scan of the piece by the automaton of the dictionary
emits these payloads in the order of the words.  The CRC of a run of words follows from the
payloads of its neighbours alone (a CRC moves over n further bytes by a linear map), and modulo
the number of buckets it is the bucket of the feature.

A dictionary of all words grows with the corpus; those of pieces are bounded and need neither a
broadcast nor a pass of their own.  Each text is scanned once: its buckets, two bytes a word, are
stored and serve the counts and the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialops.llm.common import stored

#: Bytes of text that share one dictionary; a longer text is cut between words.
PIECE_BYTES = 4_000_000
#: The polynomial of CRC-32, bits reflected.
POLYNOMIAL = 0xEDB88320
#: Lower-cases A-Z and turns every other byte that is no part of a word into a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class CrcShift:
    """CRC-32 values moved over further bytes: ``crc(a + b) = over(crc(a), len(b)) ^ crc(b)``."""

    def __init__(self):
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = columns >> np.uint32(1) ^ np.where(columns & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        self.doublings = [self._table(columns)]

    @staticmethod
    def _table(columns: np.ndarray) -> np.ndarray:
        """What each value of each of the four bytes of a CRC becomes."""
        table = np.zeros((4, 256), np.uint32)
        values = np.arange(256)
        for byte in range(4):
            for bit in range(8):
                table[byte] ^= np.where(values >> bit & 1, columns[8 * byte + bit], np.uint32(0))
        return table

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def over(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        crc, digit = crc.copy(), 0
        while (left := size >> digit).any():
            if digit == len(self.doublings):
                last = self.doublings[-1]
                columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
                self.doublings.append(self._table(self._apply(last, self._apply(last, columns))))
            moved = (left & 1).astype(bool)
            crc[moved] = self._apply(self.doublings[digit], crc[moved])
            digit += 1
        return crc


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """The texts as pieces of bounded size: (number of the text, some of its words) in order."""
    piece, size = [], 0
    for number, text in enumerate(texts):
        text, at = text.translate(WORD_BYTES), 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE_BYTES:
                to = max(text.rfind(b" ", at, at + PIECE_BYTES), at)
                to = to if to > at else text.find(b" ", at + PIECE_BYTES)
                to = to if to > at else len(text)
            piece.append((number, text[at:to]))
            size, at = size + to - at, to
            if size >= PIECE_BYTES:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


def _scan(piece: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, CRC and length of every word of a piece."""
    import ahocorasick

    lines = [(number, words) for number, text in piece if (words := text.split())]
    distinct = list({w for _, words in lines for w in words})
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(distinct):
        # one letter per byte; the delimiters make a match a whole word
        automaton.add_word(f" {word.decode('latin-1')} ", i)
    automaton.make_automaton()
    crc = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    length = np.array([len(w) for w in distinct], np.int64)
    joined = [b" ".join(words) for _, words in lines]
    found = np.fromiter(automaton.iter(f" {b' '.join(joined).decode('latin-1')} "), np.dtype([("end", "i8"), ("word", "i8")]))
    # a line and the blank behind it end at these places, the leading blank counted
    ends = np.cumsum([len(line) + 1 for line in joined])
    number = np.array([n for n, _ in lines])[np.searchsorted(ends, found["end"])]
    return number, crc[found["word"]], length[found["word"]]


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text and the buckets of its runs of 1 to ``longest`` words."""
    shift, parts = CrcShift(), [_scan(piece) for piece in _segments(texts)]
    number, crc, length = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.uint32, np.int64)))
    spaced = shift.over(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc if longest > 1 else crc
    runs, owners, run = [crc], [number], crc
    for more in range(1, longest):
        # the run one word shorter, and the blank and word behind it
        run = shift.over(run[:-1], length[more:] + 1) ^ spaced[more:] if len(run) else run
        whole = number[more:] == number[: len(number) - more]
        runs.append(run[whole])
        owners.append(number[more:][whole])
    owner, bucket = np.concatenate(owners), np.concatenate(runs) % np.uint32(buckets)
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return np.bincount(number, minlength=len(texts)), np.split(bucket[order], edges) if texts else []


def _small_runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def hashed(rows: DataFrame, keys: list[str], text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``keys``, n_words, n_features and the buckets of all features (little-endian integers) of each row.

    A null text has no words.
    """
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    ready = rows.select(*keys, F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")).alias("_bytes"))
    schema = ready.drop("_bytes").schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")

    def scan(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _small_runs(texts):
                words, found = features(texts[a:b], longest, buckets)
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keys))]
                columns = [*kept, pa.array(words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(kind).tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_words", "n_features", "buckets"])

    return ready.mapInArrow(scan, schema)


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """Features in each bucket over all rows: bucket, n; added up per task before the shuffle."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths; one number a bucket."""
    spark = corpus.sparkSession
    table = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, found in (("here", corpus), ("there", target)):
        table = table.join(F.broadcast(bucket_counts(found, buckets)).withColumnRenamed("n", name), "bucket", "left")
    counts = table.select("bucket", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("here", "there")])
    everything = Window.partitionBy()  # a row per bucket, whatever the input
    all_here, all_there = (F.sum(c).over(everything) for c in ("here", "there"))
    whole = counts.withColumns({"all_here": all_here, "all_there": all_there})
    ratio = ((F.col("there") + 1) * (F.col("all_here") + buckets)) / ((F.col("here") + 1) * (F.col("all_there") + buckets))
    rows = whole.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["gain"]
    return out


def weighed(found: DataFrame, keys: list[str], gain: np.ndarray) -> DataFrame:
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    names = [*keys, "n_words", "n_features"]
    schema = found.select(*names).schema.add("weight", "long")

    def weigh(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(cell.as_buffer(), kind)].sum()) for cell in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*names, "weight"])

    return found.select(*names, "buckets").mapInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise from the hash of ``seed:key``, in thousandths; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in ``order``, from 1; equal rows take neighbouring places.

    Rows are cut into ranges of the order, sorted within them and numbered there; the counts of the
    ranges give the places before each.  A column that tells equal rows apart is part of the order,
    so that no value is too frequent for a range.
    """
    told = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "told")
    order = [*order, F.col("_row").asc()]
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ranges = stored(told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    split = ranges.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range, as many as shuffle partitions
    sizes = split.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = split.join(F.broadcast(offsets), "_range")
    return placed.select(*rows.columns, (F.col("_offset") + F.col("_place") + 1).alias(name))


def resampled(
    documents: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Every document with its weight, its score and, where it is drawn, its rank.

    Columns: key, n_features, weight, score, rank.  A feature's gain is the log ratio of its
    bucket's share in ``target`` and in the documents, one added to each bucket; the weight is the
    sum over a document's features, the score adds noise that depends on the key.  Of the documents
    of at least ``min_words`` words, ``percent`` hundredths, rounded down, are drawn by highest
    score, ties to the smaller key, null keys last; all others have no rank.  A null or empty text
    has no features and weight 0.  Rows that repeat a key are scored each by its own text; equal
    rows take neighbouring ranks.  Other columns are not read.  Without documents there are no
    rows, without a target all features count as missing there.
    """
    corpus = stored(hashed(documents, [key], text, longest, buckets), "features")
    wanted = hashed(target.select(F.lit(0).alias("_one"), F.col(target_text).alias("_text")), ["_one"], "_text", longest, buckets)
    scored = weighed(corpus, [key], gains(corpus, wanted, buckets)).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    able = F.col("n_words") >= min_words
    drawn = percent * corpus.where(able).count() // 100
    places = numbered(scored, [able.desc(), F.col("score").desc(), F.col(key).asc_nulls_last()], "_rank")
    return places.select(key, "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
