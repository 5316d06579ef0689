"""The operators on the given tables, with the same result in DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialops.llm import sql
from trialops.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bind(name: str, oracle: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@bind("op1_warc_derivatives", sql.WARC)
def warc_derivatives(spark, sf_dir):
    from trialops.llm import warc

    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), "page_id")


@bind("op2_reply_trees", sql.REPLY_TREES)
def chat_reply_trees(spark, sf_dir):
    from trialops.llm import reply_trees as rt

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], given.schema)
    back = rt.read_back(rt.formatted(rt.chains(given.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    hexdigest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        hexdigest(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        hexdigest(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@bind("op10_hash_tree")
def hash_tree_shards(spark, sf_dir):
    from trialops.llm import hash_tree as ht

    tree = ht.even_tree()
    return ht.shard_documents(table(spark, sf_dir, "documents"), tree, [*tree, ht.Shard("region2", "rack0", 16)])


@bind("op3_impact_topk", sql.TOP_K)
def impact_top_k(spark, sf_dir):
    from trialops.llm import impact_topk

    vectors = table(spark, sf_dir, "embeddings")
    return impact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


@bind("op5_retrieval_packing")
def retrieval_packing(spark, sf_dir):
    import public_tokenizers

    from trialops.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@bind("op6_decontamination", sql.DECONTAMINATION)
def benchmark_decontamination(spark, sf_dir):
    from trialops.llm import decontamination

    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@bind("op4_repeated_windows")
def repeated_byte_windows(spark, sf_dir):
    from trialops.llm import repeated_windows as rw

    rows = rw.deduplicated(table(spark, sf_dir, "documents")).withColumn("_left", rw.kept_text())
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"]).alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
        F.col("_left").alias("text"),
    )


def _classified(documents: DataFrame, held_out, threshold: float) -> DataFrame:
    return documents.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@bind("op7_toxicity")
def toxicity_scores(spark, sf_dir):
    from trialops.llm import toxicity
    from trialops.llm.labelled import held_out

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, held_out(3, 1))
    return _classified(toxicity.scored(documents, model), held_out(3, 1), toxicity.THRESHOLD)


@bind("op9_quality")
def quality_scores(spark, sf_dir):
    from trialops.llm import quality
    from trialops.llm.labelled import held_out

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, held_out(5, 0))
    return _classified(quality.scored(documents, model), held_out(5, 0), quality.THRESHOLD)


@bind("op8_jaccard_join", sql.JACCARD)
def ngram_jaccard_join(spark, sf_dir):
    from trialops.llm import jaccard_join

    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@bind("op11_cross_polytope")
def cross_polytope_neighbours(spark, sf_dir):
    from trialops.llm import cross_polytope

    vectors = table(spark, sf_dir, "embeddings")
    return cross_polytope.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)


@bind("op12_importance_resampling", sql.IMPORTANCE)
def importance_resampling(spark, sf_dir):
    from trialops.llm import importance

    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@bind("op13_fill_in_middle", sql.FILL_IN_MIDDLE)
def fill_in_the_middle(spark, sf_dir):
    from trialops.llm import fill_in_middle as fim

    hexdigest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = fim.transformed(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        hexdigest(F.col("output")).alias("output_sha256"),
        hexdigest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
