"""Stored vectors, searches that skip folders, cells with measured recall, and answers against a plain walk."""

import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import knowledge as K
from tidewater.operators import vectors as V
from tidewater.plans.catalog import QUERIES

DATA = os.environ.get("TIDEWATER_TESTDATA", "/root/testdata/sf0.001")
ROWS = "vec_id long, kind string, embedding array<float>"


def made(n, dims=16, clusters=None, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters or 1, dims)) * (3 if clusters else 0)
    return [(i, "abc"[i % 3], [float(v) for v in middle[i % len(middle)] + rng.normal(size=dims)]) for i in range(n)]


def brute(rows, asked, k, least=-1.0, kinds=None):
    out = []
    for n, q in asked:
        hits = []
        for i, kind, v in rows:
            if kinds and kind not in kinds:
                continue
            a, b = [x or 0.0 for x in v or []], [x or 0.0 for x in q or []]
            size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            s = sum(x * y for x, y in zip(a, b, strict=False)) / size if size else 0.0
            s = math.copysign(math.floor(abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0 if not math.isnan(s) else s
            if s >= least:
                hits.append((-s, i is None, i or 0))
        out += [(n, r, None if none else i, -s + 0.0) for r, (s, none, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.similarity, 6) + 0.0) for r in frame.collect()), key=repr)


def test_search_is_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    rows = made(300, 6) + [(900, "a", None), (901, "b", [0.0] * 6), (902, None, [1.0, None]), (903, "c", [1.0] * 9), (903, "c", [1.0] * 9), (None, "a", [1.0] * 6), (904, "a", [float("nan")] * 6), (905, "a", [])]
    asked = [(i, v) for i, _, v in rows[:300:20]] + [(1, rows[5][2]), (1, rows[6][2]), (2, None), (3, [2.0] * 12), (None, rows[7][2]), (4, [0.0])]
    queries = spark.createDataFrame(asked, "query_id long, query array<float>")
    vectors = spark.createDataFrame(rows, ROWS)
    f32 = lambda v: v and [x if x is None else float(np.float32(x)) for x in v]
    rows, asked = [(i, kind, f32(v)) for i, kind, v in rows], [(n, f32(q)) for n, q in asked]
    assert got(V.top_k(vectors, queries, 4, order=[F.col("vec_id")])) == brute(rows, asked, 4)
    assert got(V.top_k(vectors, queries, 400, 0.1, F.col("kind") == "a", [F.col("vec_id")])) == brute(rows, asked, 400, 0.1, {"a"})
    assert got(V.top_k(vectors.limit(0), queries, 4, order=[F.col("vec_id")])) == [] == got(V.top_k(vectors, queries.limit(0), 4))


def test_copies_tie_by_order(spark):
    vectors = spark.createDataFrame([(i, "a", [1.0, 2.0]) for i in range(5000)], ROWS).repartition(7)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<float>")
    assert [(r["rank"], r.vec_id) for r in V.top_k(vectors, queries, 5, order=[F.col("vec_id")]).orderBy("rank").collect()] == [(k + 1, k) for k in range(5)]


def test_filters_on_kinds_read_their_folders_only(spark, capsys):
    held = V.store(spark.createDataFrame(made(60), ROWS), "kind")
    plan = held.where("kind = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*kind.*b", plan)
    files = held.where("kind = 'b'").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("kind=b" in r.f for r in files)


@pytest.mark.parametrize("clusters", [None, 40])
def test_cells_find_nine_tenths(spark, clusters):
    rows = made(3000, 16, clusters)
    vectors = spark.createDataFrame(rows, ROWS)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    cells = V.train(vectors, 40)
    held = V.store(vectors, cells=cells)
    near = {(r.query_id, r.vec_id) for r in V.top_k(held, queries, 10, order=[F.col("vec_id")], cells=cells).collect()}
    true = {(r.query_id, r.vec_id) for r in V.top_k(vectors, queries, 10, order=[F.col("vec_id")]).collect()}
    assert len(near & true) / len(true) >= 0.9
    assert cells.probes < len(cells.centres) * (0.25 if clusters else 0.9)
    # what is found is ranked exactly, and all cells together are the exact search
    cells.probes = len(cells.centres)
    assert {(r.query_id, r.vec_id) for r in V.top_k(held, queries, 10, order=[F.col("vec_id")], cells=cells).collect()} == true


def test_cells_of_odd_vectors(spark):
    rows = [(0, "a", None), (1, "a", []), (2, "a", [0.0] * 4), (3, "b", [float("nan")] * 4), (4, "b", [1.0, None, 2.0, 3.0]), *[(10 + i, "c", [1.0, 2.0, 3.0, 4.0]) for i in range(200)]]
    vectors = spark.createDataFrame(rows, ROWS)
    cells = V.train(vectors, 8)
    assert V.store(vectors, cells=cells).count() == len(rows)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "query_id long, query array<float>")
    assert {r.vec_id for r in V.top_k(V.store(vectors, cells=cells), queries, 3, 0.5, order=[F.col("vec_id")], cells=cells).collect()} == {10, 11, 12}
    assert len(V.train(vectors.limit(0)).centres) == 1


def plain_terms(spark, texts):
    from tidewater.functions import text as T

    return [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.terms(F.col("t")).alias("t")).collect()]


def plain_embedding(terms, dims=64):
    """FNV-1a over UTF-16 units, words by 1, pairs by 0.6, 1 + ln of the weight in two signed buckets."""
    weight = {}
    for k, t in enumerate(terms):
        weight[t] = weight.get(t, 0) + 1
        if k:
            pair = terms[k - 1] + "_" + t
            weight[pair] = weight.get(pair, 0) + 0.6
    v = [0.0] * dims
    for f, w in weight.items():
        units = f.encode("utf-16-le")
        for h in (2166136261, 2654435761):
            for i in range(0, len(units), 2):
                h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) % 2**32
            v[h % dims] += (1 if (h // 65536) % 2 == 0 else -1) * (1 + math.log(w))
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_hashed_embedding_is_what_a_plain_walk_gives(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    terms = dict(zip(texts, plain_terms(spark, [t or "" for t in texts.values()]), strict=True))
    rows = QUERIES["hashed_embedding"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.allclose(r.embedding, plain_embedding(terms[r.doc_id]), atol=1e-9)


def test_embeddings_of_arrays_of_terms(spark, monkeypatch):
    """Odd words and cuts between rows against a plain walk; and hashing all features together takes less than half of its time."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh\u00e9\u6f22\U00020000") for _ in range(rng.choice((2, 3, 7, 12))))
    some = [word() for _ in range(40)]
    rows = [[rng.choice(some) for _ in range(rng.choice((0, 1, 2, 30, 300)))] for _ in range(60)] + [["x" * 5_000, "y" * 4_000, "x" * 5_000], ["same"] * 50, []]
    got = K._embedded(pa.array(rows, pa.list_(pa.string())), 64)
    for v, terms in zip(got, rows, strict=True):
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        assert np.allclose(v / size, plain_embedding([T.stem_of(w) for w in terms]), atol=1e-12)
    assert np.array_equal(got[3:9], K._embedded(pa.array(rows, pa.list_(pa.string()))[3:9], 64))
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.embedding for r in K.hashed_embedding(docs).collect()}
    monkeypatch.setattr(K, "WORDS_AT_ONCE", 40)
    assert {r.doc_id: r.embedding for r in K.hashed_embedding(docs).collect()} == whole and len(whole) == len(rows)
    many, began = [[word() for _ in range(3_000)] for _ in range(5)], time.process_time()
    for terms in many:
        plain_embedding(terms)
    plain, began = time.process_time() - began, time.process_time()
    K._embedded(pa.array(many, pa.list_(pa.string())), 64)
    assert time.process_time() - began < plain / 2


def answers(spark, items, docs, kinds=None):
    """The five nearest chunks of each item, by a plain walk: (item, terms asked, [(similarity, doc, chunk, text)])."""
    chunks = [(d, k, lang, t) for d, lang, text in docs for k, (_, t, _) in enumerate(K.chunks(text or ""))]
    vectors = [plain_embedding(t) for t in plain_terms(spark, [c[3] for c in chunks])]
    asked = plain_terms(spark, [t for _, t in items])
    for (n, _), terms in zip(items, asked, strict=True):
        q = plain_embedding(terms)
        hits = sorted((-round(sum(a * b for a, b in zip(q, v, strict=True)), 6), d, k, t) for (d, k, lang, t), v in zip(chunks, vectors, strict=True) if not kinds or lang in kinds)
        yield n, terms, [(-s, d, k, t) for s, d, k, t in hits[:5] if -s >= 0.08]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_extractive_answer_is_what_a_plain_walk_gives(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").where("item_id % 20 = 0").collect()]
    docs = [(r.doc_id, None, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = []
    for n, terms, hits in answers(spark, items, docs):
        best = {}
        pieces = [(s, x) for s, _, _, t in hits for x in K.split_sentences(t)]
        for (s, x), own in zip(pieces, plain_terms(spark, [x for _, x in pieces]), strict=True):
            score = round(len(set(own) & set(terms)) * (0.5 + s), 6)
            if score > 0:
                best[x] = max(score, best.get(x, 0))
        want += [(n, r, x, s) for r, (x, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:3], 1)]
    rows = QUERIES["extractive_answer"](spark, DATA).collect()
    assert sorted((r.query_id, r["rank"], r.sentence, round(r.score, 4)) for r in rows) == sorted((n, r, x, round(s, 4)) for n, r, x, s in want)
    assert len(rows) >= 3


def confident(hits, terms, spark):
    if not hits:
        return 0.0
    rest = [s for s, *_ in hits[1:3]]
    own = plain_terms(spark, [hits[0][3]])[0]
    coverage = len(set(own) & set(terms)) / max(1, len(set(terms)))
    return round(min(1, max(0, 0.55 * hits[0][0] + 0.15 * (sum(rest) / len(rest) if rest else 0) + 0.30 * coverage)), 3)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_grounded_retrieval_is_what_a_plain_walk_gives(spark):
    from tidewater.functions import text as T

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").where("item_id % 20 = 0").collect()]
    docs = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", T.clean(F.coalesce("text", F.lit(""))).alias("text")).collect()]
    narrow = {n: (confident(h, t, spark), h) for n, t, h in answers(spark, items, docs, {"en"})}
    wide = {n: (confident(h, t, spark), h) for n, t, h in answers(spark, items, docs)}
    rows = QUERIES["grounded_retrieval"](spark, DATA).collect()
    assert len(rows) == len(items)
    for r in rows:
        (cn, hn), (cw, hw) = narrow[r.query_id], wide[r.query_id]
        hits = hw if cw > cn else hn or hw
        assert (r.confidence, r.widened, r.status) == (max(cn, cw), cw > cn, "grounded" if max(cn, cw) >= 0.22 else "refused")
        assert (r.doc_id, r.chunk_index) == (hits[0][1:3] if hits else (None, None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_grounded_retrieval_reads_no_chunks_after_its_searches(spark):
    """What the searches found is kept; the result doesn't go through all chunks' texts again for each of its uses."""
    files = QUERIES["grounded_retrieval"](spark, DATA).inputFiles()
    assert files and not any("/chunks-" in f for f in files)
