"""The corpus pipeline against a brute-force version, and its stages on odd tables."""

import random

import pytest
from test_mixing_sharding import WORD, brute_mix
from test_texts import BASE, base, brute_components, codec, corpus, family  # noqa: F401

from tidewater.llm import toxicity

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = corpus(200)
    texts = [t for _, t in rows] + list(family(rng, 40, 60, 5)) + [f"write to user{i}@mail.org or call +1 555 010 {2000 + i}" for i in range(5)]
    texts += [texts[1], texts[2], "", "one"]
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at), docs, labels


def test_pipeline_is_what_brute_force_gives(spark, codec, small_corpus):  # noqa: F811
    at, docs, labels = small_corpus
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    clean = [r for r in docs if model.severity(r[1]) < model.cut]
    kept = {i for i, _, c in brute_components([r[:2] for r in clean], 5, 80) if i == c}
    rest = []
    for i, t, _, s, _ in clean:
        if i in kept:
            for a, k, b in reversed(base(t)):
                t = f"{t[:a]}<{list(BASE)[k]}>{t[b:]}"
            rest.append((i, t, s))
    mixed = brute_mix(rest)
    want = []
    for i, t, _ in rest:
        ends = [m.end() for m in WORD.finditer(t)]
        taken = mixed[i, len(ends)][3]
        if ends:
            want += [(i, codec.sp.encode(t))] * (taken // len(ends))
            if taken % len(ends):  # the document in which its source's budget ends
                want.append((i, codec.sp.encode(t[: ends[taken % len(ends) - 1]])))
    got = [(r.doc_id, r.ids) for r in pipeline.run(spark, at).collect() if r.ids]
    assert sorted(got) == sorted(want)


ODD = [(1, None, None, None, None), (None, "text without an id", "en", "a", 18), (2, "", "en", "a", 0), (3, "same", "en", None, 4), (3, "same", "en", None, 4), (4, "word " * 20_000, "xx", "b", 100_000)]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_tables(spark, small_corpus, name):
    stage = dict(pipeline.STAGES)[name]
    odd = spark.createDataFrame([(*r, True, 1.0, "x") for r in ODD], SCHEMA + ", toxic boolean, _size double, _spans string")
    got = stage(spark, odd, small_corpus[0])
    assert got.columns == (["doc_id", "ids", "n_pieces"] if name == "encode" else list(pipeline.COLUMNS))
    ids = [r.doc_id for r in got.collect()]
    # copies of one class leave their smallest id, which here is the same
    assert set(ids) == {1, 2, 3, 4, None} or name == "mix"
    assert stage(spark, odd.limit(0), small_corpus[0]).count() == 0


def test_near_dedup_judges_rows_not_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (4, c), (1, b + " else"), (None, a), (5, ""), (5, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, table, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (1, b + " else"), (3, c), (None, a), (5, ""), (5, "")], key=repr)
