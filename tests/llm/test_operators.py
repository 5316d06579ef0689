"""Operators against brute force on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}x" for i in range(4000)]


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def documents(spark):
    a, b = words(1, 300), words(2, 120)
    near = a.split()
    near[150] = "changed"
    rows = [(1, a), (2, a), (3, " ".join(near)), (4, b), (5, b + " " + words(3, 10)), (6, None), (7, ""), (8, "One two"), (9, "one TWO"),
            (10, "ab" * 700), (11, words(4, 9000)), (12, words(5, 60) + " " + a + " " + words(6, 60)), (None, "no id"), (4, b), (13, "é" * 450 + "x"), (14, "ü" + "é" * 450)]
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, shard int")


@pytest.fixture
def empty(documents):
    return documents.where(F.lit(False))


def test_repeated_windows(documents, empty):
    from trialops.llm import repeated_windows as rw

    for length in (400, 50):
        got = rw.deduplicated(documents, length).select("doc_id", "text", "_spans", "_kept").collect()
        data = [(r["text"] or "").encode() for r in got]
        count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
        for row, d in zip(got, data, strict=True):
            gone = bytearray(len(d))
            for i in range(len(d) - length + 1):
                if count[d[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            assert bytes(row["_kept"]) == bytes(x for x, g in zip(d, gone, strict=True) if not g)
            assert len(row["_spans"]) == sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
    assert rw.deduplicated(empty).count() == 0


def sets(rows, size):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for key, text in rows:
        w = (text or "").translate(table).split()
        yield key, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    bags, group = list(sets(rows, size)), list(range(len(rows)))
    for i, (_, x) in enumerate(bags):
        for j, (_, y) in enumerate(bags[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (key, _) in zip(group, bags, strict=True):
        least[g].append(key)
    return sorted(((k, len(s), min((x for x in least[g] if x is not None), default=None)) for g, (k, s) in zip(group, bags, strict=True)), key=str)


def test_jaccard_join(spark, documents, empty):
    from trialops.llm import jaccard_join as jj

    rng, base = np.random.default_rng(5), words(9, 150).split()
    copies = []
    for i in range(60):
        copy = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            copy[at] = f"edit{i}_{at}"
        copies.append((100 + i, " ".join(copy)))
    some = documents.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    got = sorted(map(tuple, jj.similar_groups(some).collect()), key=str)
    assert got == brute_components([tuple(r) for r in some.collect()], 4, 85)
    assert jj.similar_groups(empty).count() == 0
    assert sorted(r["doc_id"] for r in jj.one_per_group(documents.where("doc_id < 5"), 5, 80).collect()) == [1, 4]


def test_one_per_group_decides_by_row(spark):
    from trialops.llm import jaccard_join as jj

    def near(text, at):
        copy = text.split()
        copy[at] = f"edit{at}"
        return " ".join(copy)

    a, b, c, d = (words(60 + i, 200) for i in range(4))
    rows = [(1, a), (None, near(a, 20)), (None, b), (None, near(b, 50)), (None, b), (2, c), (3, near(c, 9)), (3, d), (3, d), (None, ""), (5, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    found = jj.one_per_group(docs, 5, 80)
    kept = Counter((r["doc_id"], r["text"]) for r in found.collect())
    assert found.columns == docs.columns and max(kept.values()) == 1
    assert len(kept.keys() & {(None, b), (None, near(b, 50))}) == 1
    assert kept.keys() - {(None, b), (None, near(b, 50))} == {(1, a), (2, c), (3, d), (None, ""), (5, None)}


def test_signatures_never_part_similar_sets():
    from trialops.llm import jaccard_join as jj

    rng = np.random.default_rng(3)
    for n in (1, 5, 900, 2040, 4090, 9000):
        bag = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for lost in {0, 1, n // 20}:
            other = np.union1d(bag[lost:], rng.integers(0, 2**64, n // 20, dtype=np.uint64))
            first, second = jj._folds(jj._signature(bag)), jj._folds(jj._signature(other))
            differ = len(np.setxor1d(bag, other))
            for width in first.keys() & second.keys():
                assert np.bitwise_count(first[width] ^ second[width]).sum() <= differ


def test_packing(documents, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from trialops.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rows = Tokenizer.from_file(path), documents.select("doc_id", "text").distinct()
    pieces = packing.pack(rows, path).toPandas()
    for row in rows.collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        own = pieces[pieces.doc_id.isna() if row["doc_id"] is None else pieces.doc_id == row["doc_id"]].sort_values("start")
        assert [i for raw in own.ids for i in np.frombuffer(raw, "<u4")] == ids and set(own.doc_tokens) == {len(ids)}
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(sequence.offset) == [0, *sequence.length.cumsum()[:-1]]
        assert sequence.length.sum() & (sequence.length.sum() - 1) == 0 and sequence.length.sum() <= 2048
    assert packing.pack(empty, path).count() == 0


def test_packing_searches_all_documents(spark):
    import public_tokenizers

    from trialops.llm import packing
    from trialops.llm.tokens import encoder

    rng, path = np.random.default_rng(8), public_tokenizers.path("word_bpe_49k.json")
    encode = encoder(path)
    single = sorted(w for w in encode.tokenizer.get_vocab() if w.isascii() and w.isalpha() and w.islower() and len(encode.word(w)) == encode.dtype.itemsize)
    single = list(rng.permutation(single))
    common, rows = single[3000:3040], []
    for pair in range(300):  # two documents share rare words only, and fill a window together
        own = single[10 * pair : 10 * pair + 10]
        for side in (0, 1):
            rows.append((2 * pair + side, " ".join([*own, *rng.choice(common, 600)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokens = packing.tokenized(docs, path).toPandas()
    window = int(tokens["n_tokens"].max()) + 200
    for shard_docs, least in ((packing.SHARD_DOCS, 0.95), (60, 0.6)):
        pieces = packing.pack(docs, path, window, shard_docs=shard_docs).toPandas()
        assert pieces.groupby("doc_id")["length"].sum().to_dict() == tokens.set_index("doc_id")["n_tokens"].to_dict()
        together = {(a // 2) for _, own in pieces.groupby("sequence_id") for a in set(own.doc_id) if a ^ 1 in set(own.doc_id)}
        assert len(together) >= least * 300, (shard_docs, len(together))


def test_packing_search_is_exact():
    from trialops.llm import packing

    rng, vocabulary = np.random.default_rng(4), 500
    docs = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 80))), vocabulary) - 1 for _ in range(120)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=vocabulary)
    idf = np.log1p((120 - df + 0.5) / (df + 0.5))
    want = packing.Index(docs[30:], idf, 40.0)
    a, b, s = packing.best(docs[:30], docs[30:], idf, df, 120, 40.0, np.arange(90) * 7919, 5)
    for q in range(30):
        weights = {int(t): w for t, w in zip(range(vocabulary), idf, strict=True)}
        scores = []
        for d in docs[30:]:
            tf = Counter(d.tolist())
            scores.append(sum(weights[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / 40.0)) for t in set(docs[q].tolist()) & tf.keys()))
        assert want.size == 90 and np.allclose(sorted(s[a == q]), sorted(scores)[-5:], rtol=1e-4)
        assert np.allclose(np.array(scores)[b[a == q]], s[a == q], rtol=1e-4)


@pytest.mark.parametrize("text", ["Σίσυφος ΣΣ", "<|endoftext|> a<|startoftext|>b", "don't... 12 ½ ",  "x" * 5000, "a b\x1cc", "é İstanbul ﬁ", ""])
def test_tokens_of_odd_texts(text):
    import public_tokenizers

    from trialops.llm.tokens import encoder

    words = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert words.texts([text, text], 1)[1].tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_hash_tree(documents, empty):
    from trialops.llm import hash_tree as ht

    tree = ht.even_tree()
    rows = ht.shard_documents(documents, tree, [*tree, ht.Shard("region2", "rack0", 16)]).collect()
    assert len(rows) == documents.count() and all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    sizes = Counter((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert sizes == Counter((r["size"], r["text_crc32"]) for r in rows)
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert ht.shard_documents(empty, tree, tree).count() == 0


def test_hash_tree_weights_move_only_the_changed_subtree(spark):
    from trialops.llm import hash_tree as ht

    keys, tree = spark.range(4000).select(F.col("id").cast("string").alias("k")), ht.even_tree()
    heavier = [ht.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else 1.0) for s in tree]
    moved = keys.select(ht.assign(F.col("k"), tree).alias("a"), ht.assign(F.col("k"), heavier).alias("b"), ht.assign(F.col("k"), [*tree, ht.Shard("region2", "rack0", 16)]).alias("c")).collect()
    assert all(b < 8 for a, b, _ in moved if a < 8) and all(c in (a, 16) for a, _, c in moved)
    assert all(a == b for a, b, _ in moved if a >= 8 and b >= 8)


def test_top_k(spark):
    from trialops.llm import impact_topk

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [float("nan")] * 8), (304, [None] * 8), (305, [0.0] * 8), (None, rows[1][1]), (306, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, impact_topk.top_k(table, table.where("vec_id % 20 = 0"), 5).collect()))
    known = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in known:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in known if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert impact_topk.top_k(table.where("false"), table.where("false"), 5).count() == 0


def test_reply_trees(spark):
    from trialops.llm import reply_trees as rt

    rows = [(1, 1, None, "user", "a & <turn x>", 1.0), (1, 2, 1, "assistant", "low", 0.5), (1, 3, 1, "assistant", "</turn>\nhigh", 2.0), (1, 4, 3, "user", None, None),
            (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, None, "", 0.0)]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r for r in rt.read_back(rt.formatted(table)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    assert [tuple(t) for t in got[1, 1]["turns"]] == [("user", "a & <turn x>"), ("assistant", "</turn>\nhigh"), ("user", "")]
    assert got[1, 1]["learned"] == "</turn>\nhigh" and got[1, 2]["learned"] == "low" and got[None, 1]["learned"] == ""
    assert rt.formatted(table, keep=1).count() == 3 and rt.formatted(table.where("false")).count() == 0


def test_warc(spark, tmp_path):
    import gzip

    from trialops.llm import warc

    pages = spark.createDataFrame([(1, "u", "<p>a &amp;lt; b&#233;</p><script>x</script>c"), (2, None, None)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages), "page_id")
    text = {r["page_id"]: r for r in records.where("record_type = 'conversion'").collect()}
    assert text[1]["block"] == "a &lt; bé\nc" and text[2]["block"] == ""
    assert text[1]["source_digest"] == "sha256:" + hashlib.sha256(b"<p>a &amp;lt; b&#233;</p><script>x</script>c").hexdigest()
    warc.write_warc(records.coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 4
    while data:  # every record has the length it says, and two line ends
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]


def test_decontamination(spark, documents, empty):
    from trialops.llm import decontamination as dc

    item, other = words(70, 30), words(71, 40)
    bench = spark.createDataFrame([(1, item), (2, other), (3, ""), (4, None), (5, "two words")], "item_id long, text string")
    swapped = item.split()
    swapped[0] = "edited"
    docs = spark.createDataFrame([(1, words(1, 50) + " " + item.upper() + "! " + words(2, 50)), (2, " ".join(swapped)), (3, words(3, 200)), (4, " ".join(item.split()[:14])), (5, None), (6, "Two, words?")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 5)} and got[1, 1]["start"] == 50 and got[1, 1]["similarity"] == 1.0
    assert sorted(r["doc_id"] for r in dc.clean(docs, bench).collect()) == [3, 4, 5]
    assert dc.contaminated(docs, bench.where("false")).count() == 0 and dc.contaminated(docs.where("false"), bench).count() == 0


def test_classifiers_without_labels(spark, documents, empty):
    from trialops.llm import quality, toxicity

    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for op in (toxicity, quality):
        model = op.train(documents, none, F.lit(False))
        scores = [r["score"] for r in op.scored(documents, model).collect()]
        assert len(scores) == documents.count() and all(0 <= s <= 1 for s in scores)
        assert op.scored(empty, model).count() == 0


def test_toxic_words_survive_a_quote_each(spark):
    from trialops.llm import toxicity

    insults = ["grobblefink", "snortwhacker", "mudgullion", "blatherskite"]
    toxic = [f"{words(1000 + i, 60)} {insults[i % 4]} {words(2000 + i, 60)}" for i in range(200)]
    ordinary = [words(3000 + i, 120) + (f" {insults[i]}" if i < 4 else "") for i in range(400)]
    segments = toxicity.toxic_segments([t.encode() for t in toxic], [t.encode() for t in ordinary])
    assert all(word.encode() in segments for word in insults)
    docs = spark.createDataFrame(list(enumerate(toxic + ordinary)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(False))
    rows = toxicity.scored(docs, model).collect()
    assert np.mean([(r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] < 200) for r in rows]) >= 0.9


def test_training_sample_has_one_text_of_an_id(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from trialops.llm.labelled import sample

    rows, labels = [(i, f"text {i} {j}") for i in range(6) for j in range(50)], spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    collected, given = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: collected.append(given(self)) or collected[-1])
    ways = [sample(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), labels, "toxic", {1: 2, 0: 2}, F.lit(False)) for some in (rows, rows[::-1])]
    assert ways[0][0] == ways[1][0] and ways[0][1].tolist() == ways[1][1].tolist()
    assert [len(frame) for frame in collected] == [4, 4]


@pytest.mark.parametrize(("name", "label", "divisor", "remainder", "least"), [("op7_toxicity", "toxic", 3, 1, 0.9), ("op9_quality", "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, name, label, divisor, remainder, least):
    from trialops.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % divisor == remainder for i in rows.doc_id]).all()
    own = rows[rows.held_out]
    assert (own.predicted == own[label]).mean() >= least


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in docs.select("doc_id").collect()} and len(ids) > 0
        docs = spark.createDataFrame(after.collect(), after.schema)
    pieces = cp.STAGES[-1][1](spark, docs, path)
    assert pieces.select("doc_id").distinct().count() == docs.count()
