"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards holds a weight per shard; a node weighs what its shards weigh.
A key descends from the root: at each node every child draws ``ln(u) / weight`` with ``u`` in
(0, 1] from the hash of the key and the child's path, and the largest draw wins.  A child's draw
depends on the key, its own path and its own weight alone, so that changing weights in one subtree
moves keys only into or out of that subtree, and below it only where weights changed.  A new shard
in a region of its own therefore takes rows only into itself.

Only SQL expressions: the draws are computed per row, without a shuffle.  The numbering of rows in
a shard shuffles (shard, bucket, key) without texts; buckets are bounded in rows, and the offsets
of the buckets come from one small table of counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, the unit that a single task numbers.
BUCKET_ROWS = 4096
DIGITS = 13  # hex digits of a draw: 52 bits, exact in a double


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Shard]:
    """A tree of equal weights; shards are numbered in the order of regions and racks."""
    return [
        Shard(f"region{r}", f"rack{k}", (r * racks + k) * shards + s)
        for r in range(regions)
        for k in range(racks)
        for s in range(shards)
    ]


def _hash(key: Column, path: str) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double")


def _draw(key: Column, path: str, weight: float) -> Column:
    return F.log((_hash(key, path) + 1) / F.lit(float(16**DIGITS))) / F.lit(float(weight))


def _descend(key: Column, shards: list[Shard], level: int, path: str) -> Column:
    if level == 3:
        return F.lit(shards[0].number)
    groups: dict[str, list[Shard]] = {}
    for shard in shards:
        name = (shard.region, shard.rack, f"shard{shard.number}")[level]
        groups.setdefault(name, []).append(shard)
    below = {n: _descend(key, g, level + 1, f"{path}/{n}") for n, g in groups.items()}
    if len(groups) == 1:
        return next(iter(below.values()))
    draws = F.array(*(F.struct(_draw(key, f"{path}/{n}", sum(s.weight for s in g)).alias("draw"), F.lit(n).alias("child")) for n, g in groups.items()))
    winner = F.array_max(draws)["child"]
    return F.element_at(F.transform(F.array(winner), lambda w: _branch(w, below)), 1)


def _branch(winner: Column, below: dict[str, Column]) -> Column:
    chosen = None
    for name, value in below.items():
        chosen = F.when(winner == name, value) if chosen is None else chosen.when(winner == name, value)
    return chosen


def assign(key: Column, tree: list[Shard]) -> Column:
    """The shard number of a text key; a null key counts as the empty text.

    Shards of weight 0 or less get nothing.
    """
    alive = [s for s in tree if s.weight > 0]
    if not alive:
        raise ValueError("the tree holds no shard with a weight")
    if len({s.number for s in alive}) < len(alive):
        raise ValueError("shard numbers repeat")
    return _descend(F.coalesce(key, F.lit("")), alive, 0, "").cast("int")


def numbered(rows: DataFrame, shard: str, key: str, order: list[str], slot: str = "slot", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add a gapless number from 0 per shard.

    Equal rows are counted first and numbered in chunks of at most ``bucket_rows``.  Chunks are
    spread over buckets by the hash of ``key``, all ``order`` columns and the chunk's number, so
    that neither a large shard nor a repeated row meets in one task; the number of buckets follows
    the row count.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    per_shard = counted.groupBy(shard).agg(F.sum("_copies").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-per_shard // bucket_rows))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / bucket_rows))))
    size = F.least(F.col("_copies") - F.col("_chunk") * bucket_rows, F.lit(bucket_rows))
    spread = chunks.withColumns({"_size": size, "_bucket": F.pmod(F.xxhash64(key, *order, "_chunk"), F.lit(buckets))})
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(shard, "_bucket").agg(F.sum("_size").alias("_rows"))
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    others = [c for c in rows.columns if c not in (shard, key, *order)]
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *order, *others, "_chunk").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("_last", F.sum("_size").over(inside)).join(offsets, [shard, "_bucket"])
    first = F.col("_offset") + F.col("_last") - F.col("_size")
    return placed.withColumn(slot, F.explode(F.sequence(first, first + F.col("_size") - 1))).select(*rows.columns, slot)


def shard_documents(documents: DataFrame, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """Shard and slot of each document, and its shard in the ``grown`` tree.

    Reads ``doc_id`` and ``text`` only; other columns, whatever their names, are left out.  A null
    text has no bytes (size 1); a null id is a key of its own; rows that repeat an id share its
    shard and each get a slot.  Empty input gives no rows.
    """
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    key = F.col("doc_id").cast("string")
    rows = documents.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(key, tree).alias("shard"),
        assign(key, grown).alias("grown_shard"),
    )
    return numbered(rows, "shard", "doc_id", ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
