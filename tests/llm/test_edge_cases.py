"""Repeated and missing keys, clashing columns, extreme values and cut characters."""

import html
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F


def said(spark, pages):
    from trialops.llm import warc

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string")
    return [r.t for r in rows.orderBy("i").select(warc.plain_text(F.col("p")).alias("t")).collect()]


def test_closing_tags_belong_to_their_opening_tags(spark):
    pages = ["<script>a</style>b</script>c", "x<STYLE type=a>p{}</style >y", "a<!-- <script> -->b<script>c</script>d", "a<template>b<script>c</script>d</template>e", "<script>never closed"]
    assert said(spark, pages) == ["c", "xy", "abd", "ae", "never closed"]


def test_character_references(spark):
    names = ["&eacute;", "&trade;", "&amp;", "&lt;", "&quot;", "&apos;", "&nbsp;x", "&Alpha;", "&hearts;", "&copy;"]
    numbers = ["&#233;", "&#00000233;", "&#xE9;", "&#Xe9;", "&#x1F600;", "&#128512;", "&#x00000041;"]
    twice = ["&amp;lt;", "&amp;amp;amp;", "&#38;eacute;", "a&amp;b&c"]
    for page, text in zip(names + numbers + twice, said(spark, names + numbers + twice), strict=True):
        assert text == html.unescape(page).strip(" \n"), page
    kept = ["&nosuch;", "&#xD800;", "&#1114112;", "&#0;", "& ;", "&;", "&#;", "&#x;", "&eacute", "&" * 5, "&" + "a" * 60 + ";"]
    assert said(spark, kept) == kept


def test_blanks_and_lines(spark):
    assert said(spark, [" a \t b\r\n\n c<br>d <p> e</p>\n", None, "", "<p></p>", "one two", "&amp;"]) == ["a b\nc\nd\ne", "", "", "", "one two", "&"]


def test_a_page_is_searched_once_per_pattern(spark):
    from trialops.llm import warc

    pages = spark.createDataFrame([(0, "<p>a &amp; b")], "i int, p string")
    plan = pages.select(warc.plain_text(F.col("p")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == len(warc.MARKUP) + len(warc.SPACES)


def test_derivatives_of_repeated_long_and_no_pages(spark):
    from trialops.llm import warc

    long = "<p>word</p>" * 30_000
    pages = spark.createDataFrame([(1, "u", long, "r"), (2, None, None, "s"), (2, None, None, "s"), (None, "u", "x", "t")], "page_id long, url string, html string, block string")
    records = warc.derivatives(warc.responses(pages), "page_id")
    assert records.count() == 8 and records.distinct().count() == 6
    (block,) = [r.block for r in records.where("page_id = 1 AND record_type = 'conversion'").collect()]
    assert block == "\n".join(["word"] * 30_000)
    assert warc.derivatives(warc.responses(pages.where("false")), "page_id").count() == 0


@pytest.mark.parametrize("size", [50.0, 4000.0, 260_000.0, 1e9, 1e13, 1e300])
def test_top_k_is_exact_for_components_of_any_size(spark, size):
    from trialops.llm import impact_topk as tk

    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in size * (1 + 1e-6 * rng.normal(size=16)) * rng.choice([-1, 1], 16)]) for i in range(60)]
    data += [(3, data[3][1])] * 30 + [(7, data[8][1]), (100, data[3][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, id int, copies int")
    got = tk.top_k(table, table.where("vec_id % 20 = 0"), 12)
    whole = [(i, [max(min(int(np.floor(min(max(64 * x, -(2.0**62)), 2.0**62))), 1 << 62), -(1 << 62)) for x in v]) for i, v in data]
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    cut = lambda s: min(max(s, 1 - (1 << 63)), (1 << 63) - 1)
    for q in (0, 20, 40, 100):
        v = dict(whole)[q]
        scores = sorted(((-cut(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in whole if i != q))[:12]
        assert found[q] == [(-s, i) for s, i in scores]


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_clean_decides_by_row(spark):
    from trialops.llm import decontamination as dc

    dirty, other = f"so it is said that {ITEM} and no more", "nothing of the benchmark stands in this text at all, whatever its id"
    rows = [(None, dirty), (None, other), (1, dirty), (1, other), (2, other), (2, None), (None, None), (3, "")]
    documents = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, row int, _bad string")
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = dc.clean(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [r for r in rows if r[1] != dirty]))
    assert dc.clean(documents, benchmark.where("false")).count() == len(rows)


def test_fingerprints_of_many_shingles(spark):
    from trialops.llm.decontamination import COUNTED, simhash

    for n in (10, 32_767, 32_768, 70_000):
        values = np.random.default_rng(n).integers(-(1 << 63), 1 << 63, n)
        values[: n // 2 + 1] |= 5
        bits = (values.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0) * 2 > n
        want = int((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum().astype(np.uint64).view(np.int64))
        given = spark.createDataFrame([(values.tolist(),)], "g array<long>")
        for together in (4, 2) if n <= COUNTED else (2,):
            assert given.select(simhash(F.col("g"), together).alias("s")).first().s == want


def test_kept_text_keeps_genuine_characters_and_columns(spark):
    from trialops.llm import repeated_windows as rw

    passage = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(1, f"a�{passage}�b", 1, 2), (2, f"{passage}é", 3, 4), (3, "�", 5, 6), (None, None, 7, 8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, _d int, _k int")
    got = rw.deduplicated(documents, 90)
    assert set(got.columns) == {*documents.columns, "_spans", "_kept"}
    kept = {r.doc_id: (r.t, r["_d"], r["_k"]) for r in got.select("doc_id", rw.kept_text().alias("t"), "_d", "_k").collect()}
    assert kept == {1: ("a��b", 1, 2), 2: ("é", 3, 4), 3: ("�", 5, 6), None: (None, 7, 8)}
    # spans that begin and end within characters: their other bytes go
    texts = spark.createDataFrame([("aé日😀z", 2, 4), ("aé日😀z", 0, 2), ("aé日😀z", 5, 8), ("aé日😀z", 7, 8), ("日", 0, 3), ("日本", 2, 4)], "text string, s long, e long")
    cut = texts.withColumn("_spans", F.array(F.struct("s", "e"))).select("text", "s", "e", rw.kept_text().alias("t")).collect()
    for r in cut:
        data, out = r.text.encode(), ""
        at = 0
        for char in r.text:
            size = len(char.encode())
            out += char if at + size <= r.s or at >= r.e else ""
            at += size
        assert r.t == out and data


def test_one_per_group_keeps_columns_of_any_name(spark):
    from trialops.llm import jaccard_join as jj

    text = " ".join(f"w{i}" for i in range(40))
    documents = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "other words stand here today", "c")], "doc_id long, text string, _row string")
    assert {tuple(r) for r in jj.one_per_group(documents, 5, 80).collect()} == {(1, text, "a"), (3, "other words stand here today", "c")}


def test_slots_of_rows_that_repeat(spark):
    from trialops.llm import hash_tree as ht

    rows = [(7, "same")] * 900 + [(i % 40, f"text {i % 13}") for i in range(400)] + [(None, None)] * 70 + [(None, "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tree = ht.even_tree()
    got = ht.shard_documents(documents, tree, tree)
    assert got.count() == len(rows) and got.exceptAll(ht.shard_documents(documents, tree, tree)).count() == 0
    keyed = got.select("doc_id", "size", "text_crc32", F.col("shard"))
    small = ht.numbered(keyed, "shard", "doc_id", ["text_crc32", "size"], bucket_rows=16).collect()
    for shard in {r.shard for r in small}:
        slots = sorted(r.slot for r in small if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sum(r.doc_id == 7 and r.size == 5 for r in small) == 900 and sum(r.doc_id is None for r in small) == 71


def test_near_copies_hold_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    from trialops.llm import bytehash
    from trialops.llm import jaccard_join as jj

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(3000)] + [None, "", "x " * 1_500_000]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": texts})
    parts = list(jj._slices([batch, batch.slice(0, 0)], "text"))
    assert [r for p in parts for r in p["row"].to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in p["text"].to_pylist()[:-1]) <= jj.SLICE_BYTES for p in parts)
    bytehash._powers.clear()
    tracemalloc.start()
    sets = jj.bags(texts[:3000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48e6
    tokens, counts = np.unique(np.concatenate(sets + sets[:50] * 7), return_counts=True)
    found = jj._often(sets + sets[:50] * 7, 8)
    assert len(found[0]) and (found[0] == tokens[counts >= 8]).all() and (found[1] == counts[counts >= 8]).all()
    assert all(len(x) == 0 for x in jj._often([], 8))


def test_encoders_keep_few_words(monkeypatch):
    import public_tokenizers

    from trialops.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "CACHED_WORDS", 1000)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 20_000)
    texts = [" ".join(f"{chr(97 + i % 26)}w{i * 1000 + j}x" for j in range(1000)) for i in range(40)]
    words = tokens.WordEncoder(path)
    got = words.texts(texts, 1)
    assert len(words.known) <= 1000 + 4000 and len(words.words) <= 500 + 4000
    whole = words.tokenizer
    assert all(ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1] for t, ids in zip(texts, got, strict=True))


def test_known_words_are_small():
    """A worker keeps them while the next stages run, so each takes few bytes."""
    import tracemalloc

    import public_tokenizers

    from trialops.llm import tokens

    words = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = ["".join(np.insert(x, 6, " ", axis=1).ravel()) for x in np.random.default_rng(5).choice(letters, (60, 2000, 6))]
    words.texts(texts[:1], 1)
    tracemalloc.start()
    words.texts(texts, 1)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 150 * 120_000  # as Python objects they took 32 MB
    assert words.texts(texts[:1], 1)[0].tolist() == [*words.tokenizer.encode(texts[0], add_special_tokens=False).ids, 1]


def test_near_duplicates_hold_few_rows_at_once(spark, monkeypatch):
    from trialops.llm import jaccard_join as jj
    from trialops.llm.common import BATCH_ROWS

    before, seen, stored = spark.conf.get(BATCH_ROWS), [], jj.stored

    def watched(df, name, *by):
        seen.append(int(spark.conf.get(BATCH_ROWS)))
        return stored(df, name, *by)

    monkeypatch.setattr(jj, "stored", watched)
    often = "these words stand often " + "x" * 3000
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 300 == 0, often).otherwise(F.concat(F.lit("y" * 2990), "id")).alias("text"))
    groups = {r["doc_id"]: r["component_id"] for r in jj.similar_groups(docs).collect()}
    assert groups == {i: i if i % 300 else 0 for i in range(3000)}
    assert seen and max(seen) <= 1000 and spark.conf.get(BATCH_ROWS) == before
    # rows are counted across batches: no 1,000 of them hold the shingles eight times
    spark.conf.set(BATCH_ROWS, 500)
    try:
        heavy = jj._scan(docs, 4).select(F.explode("heavy.n")).collect()
    finally:
        spark.conf.set(BATCH_ROWS, before)
    assert [r[0] for r in heavy] == [10, 10]


def test_search_rows_hold_distinct_terms(spark):
    import public_tokenizers

    from trialops.llm import packing
    from trialops.llm.tokens import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(1, "the end " * 400 + "of it"), (2, ""), (3, None)]
    for row in packing.tokenized(spark.createDataFrame(texts, "doc_id long, text string"), path).collect():
        dtype = encoder(path).dtype
        ids, times = np.unique(np.frombuffer(row["ids"], dtype), return_counts=True)
        kind = "u1" if len(row["counts"]) == len(ids) else "<u4"
        assert np.frombuffer(row["terms"], dtype).tolist() == ids.tolist() and np.frombuffer(row["counts"], kind).tolist() == times.tolist()


def test_near_duplicates_store_texts_of_near_pairs_only(spark, monkeypatch):
    from pathlib import Path

    from trialops.llm import jaccard_join as jj
    from trialops.session import scratch_paths

    stored, texts = jj.stored, []

    def watched(df, name, *by):
        out = stored(df, name, *by)
        texts.extend(r["c"] for r in out.collect()) if name == "texts" else None
        return out

    monkeypatch.setattr(jj, "stored", watched)
    own = lambda i: " ".join(f"d{i}w{j}" for j in range(60))
    # all share a passage with others, only the last two are near
    rows = [(i, f"{own(i)} shared passage of group {i % 5} stands here") for i in range(40)]
    rows += [(40, own(40)), (41, own(40) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with scratch_paths() as made:
        groups = {r["doc_id"]: r["component_id"] for r in jj.similar_groups(docs).collect()}
    assert groups == {i: min(i, 40) for i in range(42)}
    assert len(texts) == 2
    left = {Path(p.removeprefix("file:")).name.rsplit("-", 1)[0] for p in made if Path(p.removeprefix("file:")).exists()}
    assert left <= {"scanned", "labels"}


def test_pairs_are_told_apart_by_signatures_of_unlike_length(spark):
    from trialops.llm import jaccard_join as jj

    rng = np.random.default_rng(8)
    bags = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (500, 520, 500, 3)]
    bags[1] = np.union1d(bags[0], bags[1][:20])
    rows = [(i, j, len(x), len(y), jj._signature(x), jj._signature(y)) for i, x in enumerate(bags) for j, y in enumerate(bags)]
    pairs = spark.createDataFrame(rows, "a long, b long, n_a long, n_b long, signature_a binary, signature_b binary")
    assert len({len(r[4]) for r in rows}) == 2
    assert {tuple(r) for r in jj._near(pairs, 85).collect()} == {(i, i) for i in range(4)} | {(0, 1), (1, 0)}


def test_search_for_windows_takes_strips(spark, monkeypatch):
    import public_tokenizers

    from trialops.llm import packing
    from trialops.session import scratch_paths

    rng = np.random.default_rng(12)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 25))) for i in range(250)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    seen, stored = [], packing.stored

    def watched(df, name, *by):
        seen.append(name)
        return stored(df, name, *by)

    def run():
        with scratch_paths() as made:
            rows = [tuple(r) for r in packing.pack(docs, path, 128, shard_docs=200).select("doc_id", "start", "length").collect()]
        left = {Path(p.removeprefix("file:")).name.rsplit("-", 1)[0] for p in made if Path(p.removeprefix("file:")).exists()}
        return sorted(rows), left

    monkeypatch.setattr(packing, "stored", watched)
    monkeypatch.setattr(packing, "release", lambda _: None)
    monkeypatch.setattr(packing, "STRIP_SHARDS", 12)
    whole, left = run()
    assert left == {"tokens", "windows"}
    rounds = seen.count("claims")
    assert rounds and seen.count("nearest") == rounds
    seen.clear()
    monkeypatch.setattr(packing, "STRIP_SHARDS", 5)
    monkeypatch.setattr(packing, "STRIP_BLOCKS", 1)
    assert run()[0] == whole
    assert seen.count("claims") == rounds and seen.count("nearest") == 3 * rounds


def test_repeated_windows_send_occurrences_of_repeated_groups_only(spark, monkeypatch):
    from trialops.llm import repeated_windows as rw
    from trialops.session import scratch_paths

    runs, seen, stored = rw.runs, [], rw.stored

    def watched(df, name, *by):
        out = stored(df, name, *by)
        seen.append((name, out.count()))
        return out

    def counted(keyed, length, *bits):
        found = runs(keyed, length, *bits)
        if bits:
            seen.append(("sent", found.count()))
        return found

    monkeypatch.setattr(rw, "stored", watched)
    monkeypatch.setattr(rw, "runs", counted)
    line = lambda i: " ".join(f"t{i}w{j}" for j in range(150))
    shared = "a passage that stands in two texts and is longer than sixty bytes in both of them"
    rows = [(i, line(i)) for i in range(50)] + [(100 + i, line(100 + i) + shared + line(200 + i)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with scratch_paths() as made:
        spans = {r["d"]: r["spans"] for r in rw.repeated_spans(docs, 60).collect()}
    assert spans.keys() == {100, 101}
    left = [p for p in made if Path(p.removeprefix("file:")).exists()]
    assert [Path(p).name.rsplit("-", 1)[0] for p in left] == ["spans"]
    sizes = dict(seen)
    assert sizes["sent"] == sizes["runs"] and sizes["texts"] <= 2


def test_pipeline_keeps_the_last_step_only(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from trialops.llm.common import stored
    from trialops.session import scratch_paths

    def step(name):
        return name, lambda spark, docs, sf_dir: stored(docs.withColumn(name, F.lit(1)), f"work_{name}")

    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [step("one"), step("two"), ("last", lambda spark, docs, sf_dir: docs)])
    with scratch_paths() as around:
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert sorted((r["doc_id"], r["one"], r["two"]) for r in out.collect()) == [(1, 1, 1), (2, 1, 1)]
    assert around == []
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).parent
    assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name.startswith(("work_", "one-", "two-"))] == ["two"]
