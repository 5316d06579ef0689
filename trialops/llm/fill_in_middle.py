"""Fill-in-the-middle samples, cut between tokens by a wavelet matrix over character classes.

Tokens are ``[A-Za-z]+|[^A-Za-z]``.  Every code point gets a class: a letter that goes on with a
run of letters, a letter that begins one, any other character.  A token starts at each code point
of the last two classes, so the number of tokens before a place is the sum of two rank queries of
a wavelet matrix over the classes, and the place of a given token is found by bisection on that sum.
The matrix is built per bounded piece of a batch of texts; all cuts of a piece are located together.

Only the places of the cuts come from Python; the sample is put together by SQL expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of code points.
GOES_ON, BEGINS, OTHER = 0, 1, 2
#: Code points that share one wavelet matrix; a longer text has its own.
PIECE_CHARS = 2_000_000


class BitPlane:
    """Bits with the number of set ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank queries over small symbols, one bit plane per binary digit, the highest first."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits, self.planes, self.zeros = digits, [], []
        for digit in range(digits - 1, -1, -1):
            bits = (symbols >> digit & 1).astype(bool)
            self.planes.append(BitPlane(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place of ``at``."""
        low, high = np.zeros_like(at), at
        for plane, zeros, digit in zip(self.planes, self.zeros, range(self.digits - 1, -1, -1), strict=True):
            if symbol >> digit & 1:
                low, high = zeros + plane.rank(low), zeros + plane.rank(high)
            else:
                low, high = low - plane.rank(low), high - plane.rank(high)
        return high - low


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each code point; a text that begins at one of ``starts`` has no predecessor."""
    lower = points | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    follows = np.concatenate([[False], letter[:-1]])
    follows[starts[starts < len(points)]] = False
    return np.where(letter, np.where(follows, GOES_ON, BEGINS), OTHER).astype(np.uint8)


class Tokens:
    """The token starts of several texts that stand one after the other."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.end = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.start = self.end - [len(t) for t in texts]
        self.matrix = WaveletMatrix(classes(points, self.start), 2)
        self.first = self.before(self.start)
        self.count = self.before(self.end) - self.first

    def before(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(BEGINS, at) + self.matrix.rank(OTHER, at)

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Code points of each text before its token number ``tokens``; its length at the number of its tokens."""
        low, high, wanted = self.start.copy(), self.end.copy(), self.first + tokens
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            # more tokens start up to here than stand before the wanted one
            past = self.before(np.minimum(middle + 1, self.end)) > wanted
            high = np.where(open_ & past, middle, high)
            low = np.where(open_ & ~past, middle + 1, low)
        return low - self.start


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


CUTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix_chars", "middle_chars")])


@F.pandas_udf(CUTS)
def cuts(text: pd.Series, one: pd.Series, other: pd.Series) -> pd.DataFrame:
    """Tokens of a text and the code points of its prefix and middle, cut after the smaller and the
    larger of two numbers modulo the number of tokens plus one."""
    parts = [np.zeros((3, 0), np.int64)]
    texts, draws = text.tolist(), np.stack([one.to_numpy(np.int64), other.to_numpy(np.int64)])
    for a, b in _pieces(texts):
        tokens = Tokens(texts[a:b])
        picked = np.sort(draws[:, a:b] % (tokens.count + 1), axis=0)
        left, right = tokens.place(picked[0]), tokens.place(picked[1])
        parts.append(np.stack([tokens.count, left, right - left]))
    n, left, middle = np.concatenate(parts, axis=1)
    return pd.DataFrame({"n": n, "prefix_chars": left, "middle_chars": middle})


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed:key``; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Every document as a fill-in-the-middle sample: key, text, n, form, prefix_chars, middle_chars, output.

    A null text counts as empty.  A text that is empty, holds one of the three marks, or is drawn
    for it (``plain_percent``) stays plain: its output is the text and its two lengths are null.  Of
    the others ``spm_percent`` have the suffix first.  Draws depend on the key alone: rows of one
    key share them, each with its own text.  Columns other than the two named are not read; an
    empty table gives no rows.
    """
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(draws(F.col(key), seed))])
    h = [F.col(f"h{i}") for i in range(4)]
    plain = (F.length("text") == 0) | marked | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select("key", "text", form.alias("form"), cuts("text", "h0", "h1").alias("cut"))
    left, middle = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, inner = F.substr("text", F.lit(1), left), F.substr("text", left + 1, middle)
    rest = F.substr("text", left + middle + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), rest, F.lit(MIDDLE), inner))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), prefix, F.lit(MIDDLE), inner))
        .otherwise(F.col("text"))
    )
    known = F.col("form") != "plain"
    return cut.select(
        F.col("key").alias(key),
        "text",
        "cut.n",
        "form",
        F.when(known, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(known, F.col("cut.middle_chars")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of a sample, from its output and form alone.

    The marks cannot stand in the text of a sample that is not plain, and no mark ends as another
    begins, so the first one of each is the one that was set.
    """

    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        at = F.instr(body, second)
        rest = F.substr(body, at + len(second))
        inner = F.instr(rest, MIDDLE)
        return F.substr(body, F.lit(1), at - 1), F.substr(rest, F.lit(1), inner - 1), F.substr(rest, inner + len(MIDDLE))

    p, s, m = split(PREFIX, SUFFIX)
    s2, p2, m2 = split(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
