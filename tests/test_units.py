"""Words of many texts as arrays, held against the columns; chunks that leave their task with their embeddings."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions import units as U
from tidewater.operators import knowledge as K
from tidewater.operators import vectors as V
from tidewater.plans import corpus

ODD = [
    "", " ", "a", "The cat and the hat, SHOULDN'T pleases Please please\tshould shoulds", "Ünïted Straße ÑANDÚ niño 12 3 x9 ١٢", "İstanbul İ İİ",
    "ΟΔΟΣ ΣΣ Σa aΣ", "\U00010400\U00010401x \U00020000\U00020001 \U0001f600ab\U0001f600 \U00020000", "nul\0nul ￿￿ ab￿cd", "漢字 かな ไทย",
    "ꟋxꟋ ǅab ẞab Ωhm Kelvin Ⓐⓐ Ⅰii", "été naïve", "rationally nationally operationally creation creations buses foxes quizzes churches dishes glasses passing hopping runned studies studied",
    "sss ssss tttt ttttt ates elevate rotate ation ments ement ness", "x" * 3_000 + " " + "é" * 2_000 + "ing",
]


def test_words_of_arrays_are_those_of_columns(spark):
    """Cutting and stemming, over odd characters and endings, of all texts together and of each alone."""
    rng = random.Random(4)
    ends = [s for s, _ in T.SUFFIXES] + [c + s for c in ("t", "tt", "s", "x", "ch", "sh", "ss", "ate") for s in ("", "s", "es", "ed", "ing", "ation")]
    texts = ODD + [" ".join(rng.choice(("b", "bo", "bor", "ñor", "\U00020000o", "borrow")) + rng.choice(ends) for _ in range(200)) for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.words(F.col("text")).alias("w"), T.terms(F.col("text")).alias("t")).orderBy("i").collect()
    known = U.alphabet(spark)

    def said(w, n):
        out = [[] for _ in range(n)]
        for at, size, row in zip(w.start.tolist(), w.size.tolist(), w.row.tolist(), strict=True):
            out[row].append(w.units[at : at + size].astype("<u2").tobytes().decode("utf-16-le"))
        return out

    words = U.cut(texts, known)
    assert said(words, len(texts)) == [r.w for r in rows]
    assert said(U.stemmed(words), len(texts)) == [r.t for r in rows]
    assert [said(U.cut([t], known), 1)[0] for t in texts] == [r.w for r in rows]
    numbers, distinct = U.distinct(U.stemmed(words))
    flat = [t for r in rows for t in r.t]
    assert len(distinct.start) == len(set(flat)) and [sorted(flat).count(flat[i]) for i in range(9)] == np.bincount(numbers)[numbers[:9]].tolist()


def test_every_character_is_what_columns_make_of_it(spark):
    known = U.alphabet(spark)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + "ab " for c in points[lo : lo + 4_000]) for lo in range(0, len(points), 4_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.words(F.col("text")).alias("w")).collect()
    for r in rows:
        w = U.cut([texts[r.i]], known)
        assert [w.units[a : a + n].astype("<u2").tobytes().decode("utf-16-le") for a, n in zip(w.start, w.size, strict=True)] == r.w


def test_endings_of_texts_are_those_of_all_their_sentences():
    """Looking at the end only gives what cutting the whole text gives."""
    rng = random.Random(8)
    parts = ("Ab cd.", "No. 5", "xNo. A", "Rs. 9!", "e.g. B", "i.e. C", "Approx. D", "long " * 30, "x?", "Y" * 200 + ".", ". .", "\0A.", "1.2 A", "été. E", "")
    for _ in range(3_000):
        text = "".join(rng.choice(parts) + rng.choice((" ", " ", "\n", "\n\n", "   ", "", " " * 400)) for _ in range(rng.choice((1, 3, 10, 40))))
        room = rng.choice((0, 1, 10, 60, 150))
        s = K.Lengths(K.split_sentences(text), " ")
        want = s.join(s.last(len(s.pieces), room), len(s.pieces)) if s.pieces and room else ""
        assert K._ending(text, room) == want


def test_chunks_are_embedded_in_their_task(spark):
    """What two steps give, in one; also where a document is longer than what is hashed together."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "# Head\nSome body of the section goes here. And more.\n" * 40, "Word after word goes on. " * 4_000])], "doc_id long, text string")
    both = K.chunk_documents(docs, dims=16).drop("section", "char_start", "token_estimate")
    two = K.hashed_embedding(K.chunk_documents(docs).drop("section", "char_start", "token_estimate"), 16, "chunk_text")
    assert sorted(both.collect()) == sorted(two.select(*both.columns).collect()) and both.count() > 100


def test_answers_take_texts_through_python_once(spark, tmp_path, monkeypatch):
    """Chunks leave Python with their embeddings, and no array of them is gone through element by element before it is stored."""
    docs = [(1, "Plain text about widgets and gears. " * 9, "en", "a", 320)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "widgets and gears")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plans, stash = {}, V.stash

    def seen(df, name, by=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stash(df, name, by)

    monkeypatch.setattr(V, "stash", seen)
    assert [r.sentence for r in corpus.extractive_answer(spark, str(tmp_path)).collect()]
    assert plans["vectors"].count("MapInArrow") == 1 and "transform" not in plans["vectors"] and "regexp_replace" not in plans["vectors"]


def test_lists_of_words_may_be_null_or_empty():
    rows = pa.array([["ab", "cd", "ab"], None, [], ["", "ab"]], pa.list_(pa.string()))
    got = K._embedded(rows, 8)
    assert got.shape == (4, 8) and not got[1:3].any() and got[0].any()
