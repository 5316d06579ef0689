"""Nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns unit vectors by two pseudo-rotations, three rounds of random signs and a fast Hadamard
transform each, and takes the nearest signed axis of each turned vector: two codes.  The first
code is the unit of work, the second one is looked up inside it.  A query probes the pairs of codes
that are likeliest for its neighbours: those with the largest sum of its own coordinates along the
two axes.  All vectors in the probed pairs are measured exactly, in double precision.

Vectors and queries of one (table, first code, block) travel to one task, sorted so that vectors
come first; a block is bounded in rows, and queries pass by in batches.  Of equal vectors only the
k + 1 smallest ids can be among k neighbours, so only those are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialops.llm.common import stored
from trialops.llm.impact_topk import usable

#: Vectors of one block, and vectors that are turned at once.
BLOCK_ROWS = 8_192
PIECE_ROWS = 2_048
#: Queries measured at once against a block.
STRIPE = 64
#: Axes that the second code tells apart at most.
SECOND_AXES = 64


@dataclass(frozen=True)
class Hashing:
    """Tables, rounds of a pseudo-rotation, and the share of all pairs of codes that a query probes."""

    tables: int = 4
    rounds: int = 3
    probed: float = 5 / 32
    seed: int = 1


class Rotations:
    def __init__(self, width: int, options: Hashing):
        self.width = 1 << max(0, width - 1).bit_length()
        self.second = min(self.width, SECOND_AXES)
        rng = np.random.default_rng(options.seed)
        self.signs = rng.choice([-1.0, 1.0], (options.tables, 2, options.rounds, self.width))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        step = 1
        while step < self.width:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            step *= 2
        return x.reshape(len(x), self.width) / np.sqrt(self.width)

    def turned(self, units: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the signed axes of both rotations: axis 0, its opposite, axis 1, ..."""
        out = []
        for part, axes in ((0, self.width), (1, self.second)):
            x = units
            for signs in self.signs[table, part]:
                x = self._hadamard(x * signs)
            x = x[:, :axes]
            out.append(np.stack([x, -x], axis=2).reshape(len(x), 2 * axes))
        return out[0], out[1]


def _matrix(cells: list[bytes], kind: np.dtype, width: int) -> np.ndarray:
    """Vectors as doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(cells), width))
    for i, cell in enumerate(cells):
        x = np.frombuffer(cell, kind)
        out[i, : len(x)] = x
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ready(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector")) & F.coalesce(some, F.lit(False)))


def _few_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """Distinct rows, and of those of one vector the k + 1 smallest ids."""
    by_id = Window.partitionBy("vector").orderBy("id")
    distinct = rows.distinct()
    return distinct.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= k + 1).drop("_place")


def _binaries(vectors: pa.ChunkedArray | pa.Array, kind: np.dtype) -> list[bytes]:
    return [np.asarray(v.values, dtype=kind).tobytes() for v in vectors]


def _indexed(rows: DataFrame, kind: np.dtype, width: int, options: Hashing) -> DataFrame:
    """A row per vector and table: table, first, second, id, data."""

    def run(batches):
        turn = Rotations(width, options)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                data = _binaries(piece.column("vector"), kind)
                units = _units(_matrix(data, kind, turn.width))
                for table in range(options.tables):
                    first, second = (x.argmax(axis=1).astype(np.int32) for x in turn.turned(units, table))
                    columns = [pa.array(np.full(len(data), table, np.int32)), pa.array(first), pa.array(second), piece.column("id"), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["table", "first", "second", "id", "data"])

    return rows.select("id", "vector").mapInArrow(run, "table int, first int, second int, id long, data binary")


def _probing(rows: DataFrame, kind: np.dtype, width: int, options: Hashing) -> DataFrame:
    """A row per query, table and first code with a probed pair: ``seconds`` are the bits of its second codes."""

    def run(batches):
        turn = Rotations(width, options)
        firsts, seconds = 2 * turn.width, 2 * turn.second
        probes = max(1, min(firsts * seconds, round(options.probed * firsts * seconds)))
        for batch in batches:
            for at in range(0, batch.num_rows, STRIPE):
                piece = batch.slice(at, STRIPE)
                data = _binaries(piece.column("vector"), kind)
                units = _units(_matrix(data, kind, turn.width))
                ids, hashes = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
                for table in range(options.tables):
                    one, two = turn.turned(units, table)
                    hit = np.zeros((len(data), firsts * seconds), bool)
                    for i in range(len(data)):
                        likely = (one[i][:, None] + two[i][None, :]).ravel()
                        hit[i, np.argsort(-likely, kind="stable")[:probes]] = True
                    hit = hit.reshape(len(data), firsts, seconds)
                    query, first = np.nonzero(hit.any(axis=2))
                    bits = np.packbits(hit[query, first], axis=1, bitorder="little")
                    columns = [
                        pa.array(np.full(len(query), table, np.int32)),
                        pa.array(first.astype(np.int32)),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                        pa.array(ids[query]),
                        pa.array(hashes[query]),
                        pa.array([data[q] for q in query], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["table", "first", "seconds", "id", "hash", "data"])

    return rows.select("id", "hash", "vector").mapInArrow(run, "table int, first int, seconds binary, id long, hash long, data binary")


class Block:
    """Vectors of one unit of work."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, second: np.ndarray, vectors: np.ndarray):
        self.ids, self.hashes, self.second, self.vectors = ids, hashes, second, vectors

    def nearest(self, ids: np.ndarray, bits: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Number of the query, id and hash of the vector and distance of the k nearest vectors in probed codes."""
        # a power of two keeps squares finite and changes no digit
        largest = max(np.abs(self.vectors).max(initial=0), np.abs(queries).max(initial=0))
        scale = 2.0 ** (np.frexp(largest)[1] - 1) if not 1e-100 < largest < 1e100 else 1.0
        have, want = self.vectors / scale, queries / scale
        allowed = bits[:, self.second].astype(bool) & (ids[:, None] != self.ids)
        size, own = (have * have).sum(axis=1), (want * want).sum(axis=1)
        near = np.where(allowed, own[:, None] + size - 2 * (want @ have.T), np.inf)
        if near.shape[1] > k:
            # rounding moves a square by less than this, so no neighbour is left out
            slack = 1e-12 * (own[:, None] + size.max())
            allowed &= near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack
        query, at = np.nonzero(allowed)
        distance = np.empty(len(at))
        for a in range(0, len(at), 65_536):
            apart = have[at[a : a + 65_536]] - want[query[a : a + 65_536]]
            distance[a : a + 65_536] = np.sqrt((apart * apart).sum(axis=1)) * scale
        order = np.lexsort((self.hashes[at], self.ids[at], distance, query))
        query, at, distance = query[order], at[order], distance[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = place < k
        return query[first], self.ids[at[first]], self.hashes[at[first]], distance[first]


def _searching(kind: np.dtype, width: int, k: int):
    """Over rows sorted by (table, first, block, asks): vectors are held until their block ends."""
    names = ["query_id", "query_hash", "vec_id", "vec_hash", "score"]

    def run(batches: Iterator[pa.RecordBatch]):
        key, held, block = None, [], None
        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "first", "block", "asks")], axis=1)
            edges = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), len(unit)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key != tuple(unit[a, :3]):
                    key, held, block = tuple(unit[a, :3]), [], None
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
                vectors = _matrix(part.column("data").to_pylist(), kind, width)
                if not unit[a, 3]:
                    held.append((ids, hashes, part.column("second").to_numpy(zero_copy_only=False).astype(np.int64), vectors))
                elif held:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    rows = np.frombuffer(b"".join(part.column("seconds").to_pylist()), np.uint8).reshape(len(ids), -1)
                    for c in range(0, len(ids), STRIPE):
                        bits = np.unpackbits(rows[c : c + STRIPE], axis=1, bitorder="little")
                        query, *found = block.nearest(ids[c : c + STRIPE], bits, vectors[c : c + STRIPE], k)
                        out.append((ids[c + query], hashes[c + query], *found))
            columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((*[np.int64] * 4, np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _search(have: DataFrame, asked: DataFrame, kind: np.dtype, width: int, k: int, options: Hashing) -> DataFrame:
    """query_id, query_hash, rank, vec_id, score of the best k among the vectors in probed codes."""
    index = _indexed(have, kind, width, options)
    # a row per table and first code, however many vectors there are
    counts = _indexed(have, kind, width, options).groupBy("table", "first").count()
    blocks = stored(counts.select("table", "first", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "blocks")
    unit = ["table", "first"]
    placed = index.join(F.broadcast(blocks), unit).select(*unit, F.pmod(F.xxhash64("id", "data"), "blocks").alias("block"), F.lit(False).alias("asks"), "second", F.lit(None).cast("binary").alias("seconds"), "id", F.xxhash64("data").alias("hash"), "data")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    wanted = _probing(asked, kind, width, options).join(F.broadcast(blocks), unit).select(*unit, each.alias("block"), F.lit(True).alias("asks"), F.lit(0).alias("second"), "seconds", "id", "hash", "data")
    unit = [*unit, "block"]
    together = placed.unionByName(wanted).repartition(*unit).sortWithinPartitions(*unit, "asks")
    found = together.mapInArrow(_searching(kind, width, k), "query_id long, query_hash long, vec_id long, vec_hash long, score double")
    order = Window.partitionBy("query_id", "query_hash").orderBy("score", "vec_id", "vec_hash")
    # tables find the same neighbour again: equal rows share a rank
    best = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.distinct().select("query_id", "query_hash", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", options: Hashing = Hashing()) -> DataFrame:
    """The k vectors found nearest to each query: query_id, rank, vec_id, score (Euclidean distance).

    Candidates are the vectors in probed pairs of codes, measured exactly; a query that finds fewer
    than k this way is searched again in all pairs, so it gets all candidates if there are fewer.
    Hashing looks at directions: recall is meant for unit vectors.  A vector that is null, zero or
    empty or holds null or non-finite components takes no part, nor does a row without an id; a
    shorter vector is filled up with zeros.  Vectors of the query's own id are no candidates.  Ties
    go to the smaller id.  Rows that repeat an id and a vector count once, as candidates and as
    queries; rows of one id and different vectors count each.  Other columns are not read.
    """
    few = stored(_few_of_equal(_ready(vectors, vec_id, vector), k), "vectors")
    asked = stored(_ready(queries, vec_id, vector).distinct().withColumn("hash", F.xxhash64("vector")), "queries")
    sizes = few.select(F.size("vector").alias("n")).unionByName(asked.select(F.size("vector").alias("n")))
    width = sizes.agg(F.max("n")).first()[0] or 1
    single = all(df.schema["vector"].dataType.elementType.typeName() == "float" for df in (few, asked))
    kind = np.dtype("<f4" if single else "<f8")
    found = stored(_search(few, asked, kind, width, k, options), "neighbours")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_hash").alias("hash"))
    short = stored(asked.join(full, ["id", "hash"], "left_anti"), "short")
    if not short.isEmpty():
        again = _search(few, short, kind, width, k, Hashing(tables=1, rounds=options.rounds, probed=1.0, seed=options.seed))
        twice = short.select(F.col("id").alias("query_id"), F.col("hash").alias("query_hash"))
        found = found.join(twice, ["query_id", "query_hash"], "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
