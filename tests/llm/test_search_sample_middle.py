"""Neighbour search, importance resampling and fill-in-the-middle against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, id string, hash int, block int, data string"


def vector_rows(pairs):
    return [(i, v, 1, "x", 2, 3, "y") for i, v in pairs]


def distances(rows, i, v):
    """Distance and id of every candidate of a query, the nearest first."""
    usable = {(j, tuple(w)) for j, w in rows if j is not None and w and all(x is not None and math.isfinite(x) for x in w) and any(w)}
    width = max(len(w) for _, w in usable)
    pad = lambda w: np.pad(np.array(w, np.float32).astype(float), (0, width - len(w)))
    return sorted((math.sqrt(((pad(w) - pad(v)) ** 2).sum()), j) for j, w in usable if j != i)


@pytest.fixture(scope="module")
def unit_vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    x[900:1300] = x[900] + 0.02 * rng.normal(size=(400, 24))
    x[1300:] = x[1300]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_neighbours_recall_and_exact_distances(spark, unit_vectors):
    from trialops.llm import cross_polytope as cp

    rows = [(i, v.tolist()) for i, v in enumerate(unit_vectors)]
    table = spark.createDataFrame(vector_rows(rows), VECTORS).repartition(7)
    got = cp.neighbours(table, table.where("vec_id % 50 = 0"), 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(found) == set(range(0, 1500, 50)) and all(len(f) == 10 for f in found.values())
    hits = 0
    for q, pairs in found.items():
        best = distances(rows, q, rows[q][1])
        known = {j: d for d, j in best}
        assert pairs == sorted(pairs) and all(abs(known[j] - d) < 1e-12 for d, j in pairs)
        hits += len({j for _, j in pairs} & {j for _, j in best[:10]})
    assert hits >= 0.9 * 10 * len(found)


def test_neighbours_edge_cases(spark):
    from trialops.llm import cross_polytope as cp

    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]),
            (9, [None, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.6, 0.8]), (10, []), (11, [1.0]), (12, [1.0, 0.0, 0.0]), (13, [3e38, 3e38])]
    table = spark.createDataFrame(vector_rows(rows), VECTORS)
    got = cp.neighbours(table, table.where("vec_id in (1, 2, 5, 6, 13)"), 10).collect()
    for q in (1, 2, 13):
        for v in {tuple(w) for i, w in rows if i == q}:
            want = [(k + 1, j, d) for k, (d, j) in enumerate(distances(rows, q, v)[:10])]
            have = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert all(any(w[:2] == h[:2] and math.isclose(w[2], h[2], rel_tol=1e-12) for h in have) for w in want), (q, want, have)
    assert {r["query_id"] for r in got} == {1, 2, 13}
    assert cp.neighbours(table.where("vec_id = 2"), table.where("vec_id = 2"), 3).count() == 0
    assert cp.neighbours(table.where("false"), table.where("false"), 3).count() == 0


def test_neighbours_block_by_block(spark, unit_vectors, monkeypatch):
    from trialops.llm import cross_polytope as cp

    rows = [(i, v.tolist()) for i, v in enumerate(unit_vectors)]
    table = spark.createDataFrame(vector_rows(rows), VECTORS)
    asked = table.where("vec_id % 300 = 0")
    whole = sorted(map(tuple, cp.neighbours(table, asked, 5).collect()))
    monkeypatch.setattr(cp, "BLOCK_ROWS", 16)
    assert sorted(map(tuple, cp.neighbours(table, asked, 5).collect())) == whole


def test_crc_moves_over_bytes():
    from trialops.llm.importance import CrcShift

    rng = np.random.default_rng(3)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 300, (50, 2))]
    one, two, both = (np.array([zlib.crc32(f(p)) for p in parts], np.uint32) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
    assert (CrcShift().over(one, np.array([len(p[1]) for p in parts])) ^ two == both).all()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bags(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) for r in runs)


def brute_resample(documents, target, longest, buckets, min_words, percent):
    docs = [(i, *bags(t, longest)) for i, t in documents]
    here, there = Counter(), Counter()
    for _, _, bag in docs:
        for c, n in bag.items():
            here[c % buckets] += n
    for t in target:
        for c, n in bags(t, longest)[1].items():
            there[c % buckets] += n
    S, T = sum(here.values()), sum(there.values())
    rows = []
    for i, words, bag in docs:
        weight = sum(n * math.floor(1000 * math.log(((there[c % buckets] + 1) * (S + buckets)) / ((here[c % buckets] + 1) * (T + buckets)))) for c, n in bag.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(bag.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able):
        r.append(place + 1 if place < percent * len(able) // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"Wort{i}" for i in range(300)] + ["Ünïx", "éa9", "日本語", "a-b", "x_y"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .,;\n\t"), (None, "no id " * 30), (203, "MiXed\x00CASE\x7fend " * 12), (204, "z" * 5000 + " tail " + "q" * 3000)]
    rows += [(300, "same words here again " * 8)] * 40 + [(301 + i, "same words here again " * 8) for i in range(30)] + [(5, "another text of this id " * 6)]
    table = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], "doc_id long, text string, buckets string, weight int, _rank int")
    return table.repartition(5), rows


@pytest.mark.parametrize(("longest", "buckets", "piece"), [(1, 10_000, None), (3, 500, None), (2, 100_000, 64)])
def test_importance_resampling(spark, texts, longest, buckets, piece, monkeypatch):
    from trialops.llm import importance

    if piece:
        monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    table, rows = texts
    target = ["wort1 wort2 wort3 again", None, "", "Ünïx same words"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resampled(table, benchmark, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, longest, buckets, 20, 10)


def test_importance_without_rows(spark, texts):
    from trialops.llm import importance

    table, rows = texts
    assert importance.resampled(table.where("false"), table).count() == 0
    none = importance.resampled(table, table.where("false")).collect()
    assert sorted(map(tuple, none), key=str) == brute_resample(rows, [], 1, 10_000, 20, 10)


def test_wavelet_matrix_ranks():
    from trialops.llm.fill_in_middle import WaveletMatrix

    symbols = np.random.default_rng(2).integers(0, 5, 1000).astype(np.uint8)
    matrix, at = WaveletMatrix(symbols, 3), np.arange(1001)
    for symbol in range(8):
        assert (matrix.rank(symbol, at) == np.concatenate([[0], np.cumsum(symbols == symbol)])).all()
    assert WaveletMatrix(symbols[:0], 2).rank(1, np.array([0])).tolist() == [0]


def brute_middle(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, text, len(tokens), "plain", None, None, text
    output = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return i, text, len(tokens), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), output


@pytest.mark.parametrize("piece", [None, 40])
def test_fill_in_middle(spark, piece, monkeypatch):
    from trialops.llm import fill_in_middle as fim

    if piece:
        monkeypatch.setattr(fim, "PIECE_CHARS", piece)
    rng = np.random.default_rng(4)
    letters = list("abcXYZ  \n\t.,<>PSM019éß日😀́")
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 120)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a"), (303, "has <P> inside"), (304, "a<S"), (305, "<" * 30), (306, "word " * 50_000), (307, "x" * 100_000), (None, "no id"), (1, "twice"), (1, "twice"), (308, "\r\n")]
    rows += [(400 + i, "<P" + "S>M<" * 5) for i in range(20)]
    table = spark.createDataFrame([(i, t, "a", 1, 2, "f") for i, t in rows], "doc_id long, text string, key string, n int, cut int, form string")
    got = fim.transformed(table.repartition(3))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_middle(*r) for r in rows), key=key)
    assert got.where(fim.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r[0] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.transformed(table.where("false")).count() == 0
