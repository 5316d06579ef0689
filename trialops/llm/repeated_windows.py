"""Removal of repeated byte strings: a radix sort of suffixes, only as deep as the threshold.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Suffixes are
told apart digit by digit, the first digit deciding most; whoever is alone in a group drops out.
Digits are fingerprints of parts of a suffix's first ``length`` bytes, so equal strings have equal
digits and groups that are left after the last digit are exactly the repeated windows:

1. *Anchor.*  Among the strings of three quarters of ``length`` inside a window, the one with the
   lowest hash is its first digit.  Neighbouring windows share it, so a run of windows is one row,
   and about one position in fifty is shuffled at all.
2. *Run.*  Runs of one anchor that agree in all their bytes are repeated as a whole.
3. *Window.*  Only where runs of one anchor differ, and once per distinct run, single windows are
   compared by the hash of all their bytes.

A group is identified by two 64-bit hashes (anchor and run, or anchor and window).  Groups are
counted first, never collected; only occurrences of groups that have several are then sent (and a
few others) and meet their group in a join whose large sides Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.llm.bytehash import PIECE, Ranges, lowest
from trialops.llm.common import among, free_name, kept_bits, release, stored
from trialops.session import discard

LENGTH = 400
_NO_ID = -(1 << 63)


def anchor_length(length: int) -> int:
    return max(1, 3 * length // 4)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Short texts joined, long texts cut with an overlap: bytes, row, place and end per segment."""
    parts, rows, bases, size = [], [], [], 0

    def joined():
        lengths = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(bases), np.cumsum(lengths)

    for row, text in enumerate(texts):
        step = PIECE - length + 1
        for base in range(0, max(1, len(text) - length + 1), step):
            part = text[base : base + PIECE]
            if len(part) < length:
                continue
            if size + len(part) > PIECE:
                yield joined()
                parts, rows, bases, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            bases.append(base)
            size += len(part)
    if parts:
        yield joined()


def _runs(texts: list[bytes], length: int):
    """Runs of windows with one anchor: row, start, windows, anchor hash, run hash."""
    k = anchor_length(length)
    for data, rows, bases, ends in _pieces(texts, length):
        hashes = Ranges(data).all(k)
        anchor = lowest(hashes, length - k + 1)
        segment = np.searchsorted(ends, np.arange(len(anchor)), side="right")
        inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[segment])
        new = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(anchor[inside]) != 0)])
        first = inside[new]
        last = inside[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(inside) - 1]])]
        own = segment[first]
        begins = ends[own] - np.diff(ends, prepend=0)[own]
        run = Ranges(data, 1).of(first, last + length) ^ (last - first).astype(np.uint64)
        yield rows[own], bases[own] + first - begins, last - first + 1, hashes[anchor[first]].view(np.int64), run.view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows by (id, hash of id and text); rows that repeat both share key and result."""
    return documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64("text", "doc_id").alias("k"))


def _bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in column.to_pylist()]


def runs(keyed: DataFrame, length: int, bits: np.ndarray | None = None) -> DataFrame:
    """All runs, or those whose anchor has its bit."""

    def scan(batches):
        for batch in batches:
            d, k = batch["d"].to_numpy(), batch["k"].to_numpy()
            for row, start, n, anchor, run in _runs(_bytes(batch["text"]), length):
                if bits is not None:
                    row, start, n, anchor, run = (x[kept] for kept in [among(anchor, bits)] for x in (row, start, n, anchor, run))
                yield pa.RecordBatch.from_pydict({"d": d[row], "k": k[row], "s": start.astype(np.int64), "n": n.astype(np.int32), "anchor": anchor, "run": run})

    return keyed.select("d", "k", "text").mapInArrow(scan, "d long, k long, s long, n int, anchor long, run long")


def texts_with_runs(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """d, k, text and the list of the chosen runs of the texts that have some."""
    lists = chosen.groupBy("d", "k").agg(F.collect_list(F.struct("s", "n", "anchor")).alias("runs"))
    bits = kept_bits(chosen.select("k").distinct(), "k")

    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(batch["k"].to_numpy(), bits)))

    # Rows that repeat id and text are one occurrence each in the runs, and one text here.
    return keyed.select("d", "k", "text").mapInArrow(scan, "d long, k long, text string").join(lists, ["d", "k"])


def windows(texts: DataFrame, length: int, bits: np.ndarray | None = None) -> DataFrame:
    """All windows of the listed runs, or those whose hash has its bit: anchor, hash of the window, d, k, start."""

    def expand(batches):
        for batch in batches:
            for d, k, text, wanted in zip(batch["d"].to_pylist(), batch["k"].to_pylist(), _bytes(batch["text"]), batch["runs"].to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                s, n = (np.array([r[c] for r in wanted], np.int64) for c in ("s", "n"))
                anchor = np.array([r["anchor"] for r in wanted], np.int64)
                groups = [np.arange(len(s))] if len(data) <= PIECE else np.arange(len(s))[:, None]
                for g in groups:
                    low, high = s[g].min(), (s[g] + n[g]).max() + length - 1
                    places = np.repeat(s[g] - np.concatenate([[0], np.cumsum(n[g])[:-1]]), n[g]) + np.arange(n[g].sum())
                    hashes = Ranges(data[low:high], 2).of(places - low, places - low + length).view(np.int64)
                    size = len(places)
                    found = pa.RecordBatch.from_pydict({"anchor": np.repeat(anchor[g], n[g]), "w": hashes, "d": np.full(size, d), "k": np.full(size, k), "s": places})
                    yield found if bits is None else found.filter(pa.array(among(hashes, bits)))

    return texts.mapInArrow(expand, "anchor long, w long, d long, k long, s long")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges that go, per key of ``_keyed``: d, k, spans (unsorted, may overlap)."""
    spark = documents.sparkSession
    keyed = _keyed(documents)
    found = runs(keyed, length).groupBy("anchor").agg(F.count("*").alias("c"), F.min("run").alias("low"), F.max("run").alias("high"))
    anchors = stored(found.where("c > 1").select("anchor", (F.col("low") == F.col("high")).alias("same")), "anchors")
    del found
    release(spark)
    shared = runs(keyed, length, kept_bits(anchors, "anchor")).join(anchors, "anchor")
    shared = stored(shared.select("anchor", "run", "d", "k", "s", "n", "same"), "runs")
    discard(anchors)
    del anchors
    release(spark)
    mixed = shared.where(~F.col("same"))
    place = F.xxhash64("d", "k", "s")
    groups = mixed.groupBy("anchor", "run").agg(F.count("*").alias("c"), F.min(place).alias("chosen"))
    mixed = mixed.join(groups, ["anchor", "run"])
    cover = lambda s, e: F.struct(F.col(s).alias("s"), e.alias("e")).alias("span")
    # One run of each group stands for it.  Runs of rows that repeat id and text share a place.
    chosen = mixed.where(F.col("chosen") == place).select("d", "k", "s", "n", "anchor").dropDuplicates(["d", "k", "s"])
    chosen = stored(chosen, "chosen")
    whole = shared.where("same").select("d", "k", "s", "n").unionByName(mixed.where("c > 1").select("d", "k", "s", "n"))
    whole = stored(whole.select("d", "k", cover("s", F.col("s") + F.col("n") + (length - 1))), "covered")
    discard(shared)
    del shared, mixed, groups
    release(spark)
    texts = stored(texts_with_runs(keyed, chosen), "texts")
    discard(chosen)
    release(spark)
    counted = windows(texts, length).groupBy("anchor", "w").count().where("count > 1").select("anchor", "w")
    repeated = stored(counted, "repeated")
    del counted
    release(spark)
    single = windows(texts, length, kept_bits(repeated, "w")).join(repeated, ["anchor", "w"]).select("d", "k", cover("s", F.col("s") + length))
    spans = whole.unionByName(single).groupBy("d", "k").agg(F.collect_set("span").alias("spans"))
    merged = stored(spans.mapInArrow(_merge, "d long, k long, spans array<struct<s: long, e: long>>"), "spans")
    discard(texts, repeated, whole)
    del single, spans
    release(spark)
    return merged


def _merge(batches):
    for batch in batches:
        out = []
        for spans in batch["spans"].to_pylist():
            at = np.array(sorted((x["s"], x["e"]) for x in spans), np.int64)
            reach = np.maximum.accumulate(at[:, 1])
            new = np.concatenate([[True], at[1:, 0] > reach[:-1]])
            ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
            out.append([{"s": int(s), "e": int(e)} for s, e in zip(at[new, 0], ends, strict=True)])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch["d"], batch["k"], pa.array(out, kind)], ["d", "k", "spans"])


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``documents`` and ``_spans`` (removed byte ranges, ascending, apart) and
    ``_kept`` (the remaining bytes).

    Null and empty texts, and texts shorter than ``length``, lose nothing unless ``length`` fits.
    Rows that repeat are copies of each other and lose whatever is long enough.  A null id is
    allowed.  Columns named like the two added are replaced; all others pass through.
    """
    spans = repeated_spans(documents.select("doc_id", "text"), length)
    rows = documents.drop("_spans", "_kept")
    d, k = free_name("_d", rows), free_name("_k", rows)
    spans = spans.select(F.col("d").alias(d), F.col("k").alias(k), F.col("spans").alias("_spans"))
    rows = rows.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), k: F.xxhash64("text", "doc_id")})
    none = F.array().cast("array<struct<s: bigint, e: bigint>>")
    rows = rows.join(spans, [d, k], "left").drop(d, k).withColumn("_spans", F.coalesce("_spans", none))
    kept = F.aggregate(_gaps(), F.lit(b""), lambda out, g: F.concat(out, _between(g["s"], g["e"])))
    return rows.withColumn("_kept", F.when(F.size("_spans") == 0, _data()).otherwise(kept))


def _data() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


def _between(start: Column, end: Column) -> Column:
    return F.substring(_data(), (start + 1).cast("int"), (end - start).cast("int"))


def _gaps() -> Column:
    """Byte ranges between the removed ones, and before the first and behind the last."""
    return F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda x: x["e"])),
        F.concat(F.transform("_spans", lambda x: x["s"]), F.array(F.octet_length(_data()).cast("long"))),
        lambda s, e: F.struct(s.alias("s"), e.alias("e")),
    )


#: Hexadecimal digits of bytes at a border: further bytes of a character that began before it, and the
#: beginning of one that ends behind it.
_CUT_FIRST = "^(?:[89AB][0-9A-F])*"
_CUT_LAST = "(?:[C-F][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){2})$"


def kept_text() -> Column:
    """The kept bytes as text; characters that a removed range cuts in two go, all others stay.

    Take it in a step that makes no column called ``text`` beside it: Spark lets the lambdas in it read that one.
    """

    def whole(g: Column) -> Column:
        first = F.when(g["s"] > 0, F.length(F.regexp_extract(F.hex(_between(g["s"], F.least(g["e"], g["s"] + 3))), _CUT_FIRST, 0)) / 2).otherwise(0)
        start = g["s"] + first.cast("long")
        last = F.regexp_extract(F.hex(_between(F.greatest(start, g["e"] - 3), g["e"])), f"^(?:..)*?({_CUT_LAST})", 1)
        return _between(start, F.greatest(start, g["e"] - (F.length(last) / 2).cast("long")))

    kept = F.aggregate(_gaps(), F.lit(b""), lambda out, g: F.concat(out, whole(g)))
    return F.when(F.size("_spans") == 0, F.col("text")).otherwise(kept.cast("string"))
