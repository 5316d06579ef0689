"""Exact top-k inner products from an impact-ordered index, read score-at-a-time.

Candidates are cut into shards of bounded size, queries into blocks.  A shard's index holds posting
segments (dimension, quantised impact) -> vectors, ordered by descending impact; level 0, the
smallest impacts, has no postings.  A block of queries adds segment after segment to its
accumulators.  After a level, the part of a vector that is not yet counted has a known norm, so the
true score lies within ``|query| * |rest|`` of the accumulator (Cauchy-Schwarz).  The scan stops
only if these bounds prove that few vectors can be among the best k, or when all segments are
read; all possible members are then rescored exactly.  Each shard gives its best k per query, and
the best of those are the result.

Every (shard, block) pair is one bounded unit of work; shards and blocks travel as single binaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialops.llm.common import stored

SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
LEVELS = 8
#: Queries that share one array of accumulators.
STRIPE = 128
#: A proof is good enough to stop when at most this share of a shard is left to rescore.
LEFT = 0.02
#: Quantised components are cut here; scores are exact integers, cut to the range of a long.
LARGEST = 1 << 62


def quantised(vector: Column, scale: int) -> Column:
    cut = lambda x: F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(cut(F.lit(float(scale)) * x.cast("double"))).cast("long"))


def usable(vector: Column) -> Column:
    """Vectors whose components are all there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _packed(df: DataFrame, group: str) -> DataFrame:
    """One row per group: ids and components as binaries, rows in the order of their id."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vectors = table["vector"].combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        matrix = np.zeros((len(ids), width), np.int64)
        matrix[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        largest = int(np.abs(matrix).max(initial=0))
        size = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
        matrix = matrix[order].astype(f"<i{size}")
        return pa.table({group: table[group][:1], "ids": [ids[order].astype("<i8").tobytes()], "matrix": [matrix.tobytes()], "width": [width], "bytes": [size]})

    return df.groupBy(group).applyInArrow(pack, f"{group} long, ids binary, matrix binary, width long, bytes long")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    row = table.to_pylist()[0]
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["matrix"], f"<i{row['bytes']}").reshape(len(ids), row["width"])


class ImpactIndex:
    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        size = np.abs(vectors)
        step = max(1, -(-(int(size.max(initial=0)) + 1) // levels))
        level = size // step
        impact = np.where(level > 0, np.sign(vectors) * (level * step + step // 2), 0)
        self.whole, self.largest = vectors, int(size.max(initial=0))
        self.vectors, self.segments, self.rest = vectors.astype(np.float64), {}, {}
        found = np.zeros_like(self.vectors)
        self.order = [v for v in range(int(level.max(initial=0)), 0, -1) if (level == v).any()]
        for v in self.order:
            at = level == v
            self.segments[v] = [(j, value, np.flatnonzero(at[:, j] & (impact[:, j] == value))) for j in range(vectors.shape[1]) for value in np.unique(impact[at[:, j], j])]
            found[at] = impact[at]
            self.rest[v] = np.linalg.norm(self.vectors - found, axis=1)
        self.norms = np.linalg.norm(self.vectors, axis=1)

    def best(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: positions and exact scores of all vectors that may be among its best k.

        ``own`` lists the positions that do not count for a query.
        """
        n, q = len(self.vectors), queries.astype(np.float64)
        sums, norms = np.zeros((n, len(q))), np.linalg.norm(q, axis=1)
        left, possible = self.norms, None
        for v in self.order:
            for j, value, at in self.segments[v]:
                sums[at] += value * q[:, j]
            left = self.rest[v]
            if left.mean() <= 0.4 * self.norms.mean() or v == self.order[-1]:
                possible = self._possible(sums, left, norms, k, own)
                if sum(map(len, possible)) <= LEFT * n * len(q):
                    break
        if possible is None:
            possible = self._possible(sums, left, norms, k, own)
        return [(at, self._exact(at, queries[b])) for b, at in enumerate(possible)]

    def _exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores as whole numbers, in the narrowest arithmetic that is exact for them."""
        bound = self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query))
        if bound < 1 << 53:
            return np.rint(self.vectors[at] @ query.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.whole[at] @ query
        scores = self.whole[at].astype(object) @ query.astype(object)
        return np.array([min(max(s, 1 - (1 << 63)), (1 << 63) - 1) for s in scores], np.int64)

    def _possible(self, sums, left, norms, k, own) -> list[np.ndarray]:
        out = []
        for b, norm in enumerate(norms):
            # the second part is more than rounding can move a sum
            slack = norm * left * (1 + 1e-9) + 1e-12 * norm * self.norms + 1e-6
            # scores beyond a long are cut and therefore equal
            low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (sums[:, b] - slack, sums[:, b] + slack))
            low[own[b]] = high[own[b]] = -np.inf
            proven = np.partition(low, len(low) - k)[len(low) - k] if k < len(low) else -np.inf
            at = np.flatnonzero(high >= proven)
            out.append(at[np.isfinite(high[at])])
        return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the largest inner product per query: query_id, rank, vec_id, score.

    Components are ``floor(scale * x)``.  A vector that is null or holds null or non-finite
    components takes no part, nor does a row without an id; a shorter vector is filled up with
    zeros.  A query's own id is no candidate.  Ties go to the smaller id.  Repeated candidate rows
    each count; queries that repeat in id and vector are one.  Columns other than the two named
    are not read.  Scores are exact for components of any size up to ``LARGEST``.
    """

    def ready(df):
        return df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantised(F.col("v"), scale).alias("vector"))

    # of rows equal in id and vector no more than k can be among the best k
    counted = ready(vectors).groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    candidates = stored(counted.select("id", "vector", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")), "candidates")
    asked = ready(queries).dropDuplicates(["id", "vector"])
    shards = max(1, -(-candidates.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    place = lambda n, *more: F.pmod(F.xxhash64("id", "vector", *more), F.lit(n)).cast("long")
    index = _packed(candidates.withColumn("shard", place(shards, "copy")), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    wanted = _packed(asked.withColumn("block", place(blocks)), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        parts = []
        if shard.num_rows and block.num_rows:
            (ids, have), (keys, want) = _unpacked(shard), _unpacked(block)
            width = max(have.shape[1], want.shape[1])
            have, want = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (have, want))
            index = ImpactIndex(have.astype(np.int64))
            for a in range(0, len(keys), STRIPE):
                stripe = keys[a : a + STRIPE]
                own = [np.arange(*np.searchsorted(ids, [q, q + 1])) for q in stripe]
                for b, (at, scores) in enumerate(index.best(want[a : a + STRIPE], k, own)):
                    first = np.lexsort((ids[at], -scores))[:k]
                    parts.append((np.full(len(first), stripe[b]), np.full(len(first), a + b), ids[at][first], scores[first]))
        columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4)]
        unit = np.full(len(columns[0]), block["block"][0].as_py() if block.num_rows else 0)
        return pa.table({"query_id": columns[0], "block": unit, "place": columns[1], "vec_id": columns[2], "score": columns[3]})

    found = index.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(search, "query_id long, block long, place long, vec_id long, score long")
    order = Window.partitionBy("query_id", "block", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
