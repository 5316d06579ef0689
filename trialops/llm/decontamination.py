"""Benchmark decontamination by SimHash of item-sized windows, in SQL expressions only.

Words are runs of letters and digits in lower case; shingles are five words (all words of an item
with fewer), weighted by how often they stand in a window.  A window is contaminated by an item of
as many words if their weighted Jaccard similarity is at least 0.8.

1. A window that similar shares a shingle with the item.  Documents are scanned once for shingles
   of the benchmark; around each, all windows of the sizes in question are taken.
2. Every window gets a 64-bit weighted SimHash.  Fingerprints are cut into eight blocks of eight
   bits; two fingerprints within ``radius`` agree in some block up to radius // 8 bits.  Items are
   indexed under all such block values, so the join finds every pair within the radius.
3. Pairs within the radius are verified exactly.  At similarity 0.8 the distance has mean 9.7 and
   standard deviation 2.9; the default radius of 23 leaves out less than one pair in a million.

The scan, the fingerprints and the verification need no shuffle; only counts per (document, item)
do.  The benchmark is worked off in parts of bounded size, one scan each, whose shingles are part
of the plan and whose index is broadcast.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Shingles, window sizes and items of one part of the benchmark.
PART_SHINGLES, PART_SIZES, PART_ITEMS = 100_000, 64, 4_000
#: Similarity as a fraction: 4/5.
NUMERATOR, DENOMINATOR = 4, 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _upto(last: Column) -> Column:
    """0 .. last, empty for a negative ``last``."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(text: Column, k: int | None = None) -> Column:
    """Hashes of all runs of k words; by default of five, or of all if there are fewer."""

    def runs(h: Column, k: int) -> Column:
        return F.transform(_upto(F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))

    def pick(h: Column) -> Column:
        return runs(h, k) if k else reduce(lambda a, j: F.when(F.size(h) == j, runs(h, j)).otherwise(a), range(1, SHINGLE), runs(h, SHINGLE))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), pick(h).alias("grams")))


#: Shingles that sixteen-bit counters hold.
COUNTED = (1 << 15) - 1


def simhash(shingles: Column, together: int = 4) -> Column:
    """64 bits: bit b is set if it is set in more than half of the shingles (with repeats).

    Counters of ``64 // together`` bits, ``together`` to a long: four hold up to ``COUNTED``
    shingles, two any number.  Some bits of a shingle are spread over the counters of a long at once.
    """
    width, step = 64 // together, together.bit_length() - 1
    spread = F.array(*(F.lit(sum(1 << (width * b) for b in range(together) if n >> b & 1)).cast("long") for n in range(1 << together)))
    places = F.array(*(F.lit(i) for i in range(0, 64, together)))
    lanes = F.aggregate(
        shingles,
        F.array_repeat(F.lit(0).cast("long"), 64 // together),
        lambda sums, g: F.zip_with(sums, F.transform(places, lambda p: F.get(spread, F.call_function("shiftright", g, p).bitwiseAND((1 << together) - 1).cast("int"))), lambda a, b: a + b),
    )

    def bits(sums: Column) -> Column:
        count = lambda b: F.call_function("shiftright", F.get(sums, F.shiftright(b, step)), b.bitwiseAND(together - 1) * width).bitwiseAND((1 << width) - 1)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda out, b: out.bitwiseOR(F.when(count(b) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        )

    return _let(lanes, bits)


def _block(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftright", fingerprint, block * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")


def _near_values(distance: int) -> list[int]:
    """Masks of at most ``distance`` bits of a block."""
    return [sum(1 << b for b in c) for n in range(min(distance, BLOCK_BITS) + 1) for c in combinations(range(BLOCK_BITS), n)]


def _items(benchmark: DataFrame) -> DataFrame:
    found = benchmark.select("item_id", grams(F.col("text")).alias("b")).select("item_id", F.col("b.n").alias("m"), F.col("b.grams").alias("item_grams"))
    return found.where("m > 0").dropDuplicates()


def _parts(items: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of one shingle length and bounded size."""
    sizes = sorted((r["m"], r["n"], r["g"]) for r in items.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.size("item_grams")).alias("g")).collect())
    parts, group, n, g = [], [], 0, 0
    for m, count, shingles in sizes:
        cuts = max(-(-count // PART_ITEMS), -(-shingles // PART_SHINGLES))
        if cuts > 1:
            cut = F.pmod(F.xxhash64("item_id", "item_grams"), F.lit(2 * cuts))
            parts += [items.where((F.col("m") == m) & (cut == c)) for c in range(2 * cuts)]
            continue
        if group and (len(group) >= PART_SIZES or n + count > PART_ITEMS or g + shingles > PART_SHINGLES or group[-1] < SHINGLE):
            parts.append(items.where(F.col("m").isin(group)))
            group, n, g = [], 0, 0
        group, n, g = [*group, m], n + count, g + shingles
    return [*parts, items.where(F.col("m").isin(group))] if group else parts


def _windows(documents: DataFrame, wanted: dict[int, list[int]]) -> DataFrame:
    """All windows of the sizes in ``wanted`` that hold a shingle listed for their size."""
    k = min(SHINGLE, min(wanted))
    listed = sorted({g for gs in wanted.values() for g in gs})

    def starts(bag: Column, seeds: Column, m: int, own: list[int]) -> Column:
        last = F.greatest(bag["n"] - m, F.lit(0))
        around = lambda p: F.sequence(F.least(F.greatest(p - (m - k), F.lit(0)), last), F.least(p, last))
        mine = F.filter(seeds, lambda i: F.get(bag["grams"], i).isin(own))
        return F.struct(F.lit(m).alias("m"), F.array_distinct(F.flatten(F.transform(mine, around))).alias("starts"))

    def sized(bag: Column) -> Column:
        """Sizes with the starts of their windows; no size where there is no listed shingle."""
        seeds = F.filter(_upto(F.size(bag["grams"]) - 1), lambda i: F.get(bag["grams"], i).isin(listed))
        every = lambda at: F.filter(F.array(*(starts(bag, at, m, own) for m, own in sorted(wanted.items()))), lambda s: F.size(s["starts"]) > 0)
        found = _let(seeds, lambda at: F.when(F.size(at) > 0, every(at)))
        return F.transform(found, lambda s: F.struct(s["m"].alias("m"), s["starts"].alias("starts"), bag["grams"].alias("grams")))

    rows = documents.select("doc_id", F.xxhash64("text").alias("row"), F.explode(_let(grams(F.col("text"), k), sized)).alias("s"))
    rows = rows.select("doc_id", "row", "s.m", "s.grams", F.explode("s.starts").alias("start"))
    return rows.select("doc_id", "row", "m", "start", F.slice("grams", F.col("start") + 1, F.col("m") - k + 1).alias("window_grams"))


def _shared(a: Column, b: Column) -> Column:
    """Weight that two bags of shingles have in common."""
    times = lambda bag, g: F.size(F.filter(bag, lambda x: x == g))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda n, g: n + F.least(times(a, g), times(b, g)))


def _matches(documents: DataFrame, part: DataFrame, radius: int) -> DataFrame:
    wanted: dict[int, list[int]] = {}
    for row in part.select("m", F.explode("item_grams").alias("g")).distinct().collect():
        wanted.setdefault(row["m"], []).append(row["g"])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    masks = F.explode(F.array(*(F.lit(v) for v in _near_values(radius // BLOCKS))))
    together = 4 if max(wanted) <= COUNTED else 2
    index = part.withColumn("item_print", simhash(F.col("item_grams"), together)).withColumn("block", blocks)
    index = index.withColumn("mask", masks).withColumn("value", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("mask"))).drop("mask")
    windows = _windows(documents, wanted).withColumn("print", simhash(F.col("window_grams"), together)).withColumn("block", blocks)
    windows = windows.withColumn("value", _block(F.col("print"), F.col("block")))
    near = windows.join(F.broadcast(index), ["m", "block", "value"])
    unlike = F.col("print").bitwiseXOR(F.col("item_print"))
    # A pair is taken in the first block where it is near enough, and only there.
    apart = lambda b: F.bit_count(_block(unlike, b).cast("long"))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: (b < F.col("block")) & (apart(b) <= radius // BLOCKS))
    near = near.where((F.bit_count(unlike) <= radius) & ~earlier)
    both = F.size("window_grams") + F.size("item_grams")
    weights = _let(_shared(F.col("window_grams"), F.col("item_grams")), lambda n: F.struct(n.alias("shared"), (both - n).alias("total")))
    alike = F.filter(F.array(weights), lambda s: s["shared"] * DENOMINATOR >= s["total"] * NUMERATOR)
    return near.select("doc_id", "row", "item_id", "start", F.explode(alike).alias("s")).select("doc_id", "row", "item_id", "start", "s.shared", "s.total")


def _found(documents: DataFrame, benchmark: DataFrame, radius: int) -> DataFrame:
    """``contaminated`` with ``row``, the hash of the text."""
    spark = documents.sparkSession
    parts = [_matches(documents, part, radius) for part in _parts(_items(benchmark.select("item_id", "text")))]
    if not parts:
        kinds = documents.select("doc_id").join(benchmark.select("item_id"), F.lit(False))
        return spark.createDataFrame([], kinds.schema).selectExpr("doc_id", "0L AS row", "item_id", "0L AS n_windows", "0L AS start", "0D AS similarity")
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("start")).alias("at"))).alias("best")
    counted = found.groupBy("doc_id", "row", "item_id").agg(F.count("*").alias("n_windows"), best)
    return counted.select("doc_id", "row", "item_id", "n_windows", (-F.col("best.at")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated(documents: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_windows, start, similarity.

    ``start`` is the first word of the most similar window (the earliest of equals), counted from
    0.  A document with fewer words than an item is one window.  Null and empty texts and items
    without words match nothing.  Rows that repeat id and text give one result; other columns are
    not read.  An empty benchmark or no documents give no rows.
    """
    return _found(documents, benchmark, radius).drop("row")


def clean(documents: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents that hold no item of the benchmark, with all their columns.

    Decided by id and text together: a clean text stays whatever else its id, or a missing id, stands for.
    """
    bad = _found(documents, benchmark, radius).select(F.col("doc_id").alias("_bad"), F.col("row").alias("_bad_row")).distinct()
    same = documents["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(documents["text"]) == bad["_bad_row"])
    return documents.join(bad, same, "left_anti")
