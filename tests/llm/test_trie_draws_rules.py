"""Prefix trie, importance resampling and quality rules against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quality as Q
from tidewater.llm import resampling as R
from tidewater.llm import trie as T

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    """Lists of turns, and a walk from each node to its ancestors."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, cs in members.items()), key=repr)


def trie_rows(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return sorted((tuple(r[c] for c in NODE) for r in T.trie(spark.createDataFrame(rows, schema)).collect()), key=repr)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 30), *range(96, 131), 205, 399, 400, 401, 455, -7, -250]:
        for t in range(rng.choice([0, 1, 2, 3, 6, 8])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "é 你好", "well", ""])))
    rows += [(400, t, "user", f"long {t}") for t in range(300)] + [(455, t, "user", f"long {t}") for t in range(280)]
    rows += [(7, None, "user", "first"), (7, None, None, "first, too"), (8, 1, None, None), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (None, 0, "user", "nobody's"), (9, 0, "user", "x" * 200_000)]
    return rows


def test_trie_is_what_brute_force_gives(spark):
    rows = conversations()
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_parents_by_join(spark, monkeypatch):
    monkeypatch.setattr(T, "HUB_SHARE", 3)  # hubs and others
    rows = conversations()
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(4)]
    got = trie_rows(spark, rows)
    assert got == brute_trie(rows)
    # repeated rows are turns of their own
    assert trie_rows(spark, rows * 2) == brute_trie(rows * 2)
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_trie_takes_no_notice_of_other_columns(spark):
    rows = conversations()[:60]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.select("*", *[F.lit("z").alias(c) for c in ("digest", "depth", "parent", "_skip", "_head", "n_convs")])
    assert sorted(map(tuple, T.trie(more).collect()), key=repr) == sorted(map(tuple, T.trie(plain).collect()), key=repr)


def test_trie_linear_in_long_conversations(spark):
    """What nodes tell their ancestors is summed up by conversation first: 300 turns don't make 45,000 rows."""
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(1000, 1006) for t in range(300)]
    found = T.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.count() <= len(rows) + 6 + 6 * 5


def test_members_are_hashed_over_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    rows = [(b"a", i) for i in range(10)] + [(b"b", 5)] + [(b"c", i) for i in range(-2, 5)]
    cut = [rows[:4], [], rows[4:11], rows[11:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64())], ["digest", "conv_id"]) for part in cut]
    blocks = list(T._pack(iter(batches)))
    assert [b.num_rows for b in blocks] == [1] * 8
    got = {d: s for b in T._hash(iter(blocks)) for d, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {k: hashlib.sha256(",".join(str(i) for d, i in rows if d == k).encode()).hexdigest() for k in (b"a", b"b", b"c")}


def words_of(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = ch.lower() if ch.isascii() else ch
        if ord(ch) >= 0x80 or ch.isascii() and ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def brute_draw(docs, target):
    feats = lambda t: [" ".join(w[i : i + n]) for w in [words_of(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in feats(x)), Counter(bucket(f) for x in target for f in feats(x))
    S, N = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (N + 10000))))
    rows = []
    for i, x in docs:
        w = sum(gain(bucket(f)) for f in feats(x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(feats(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    took = able[: len(able) * 5 // 100]
    ranked = [(*r[:4], k) for k, r in enumerate(took, 1)]
    rest = list((Counter(rows) - Counter(took)).elements())
    return sorted([*ranked, *((*r[:4], None) for r in rest)], key=repr)


def drawn_rows(spark, docs, target):
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted(map(tuple, got.collect()), key=repr)


def some_docs():
    rng = random.Random(8)
    vocabulary = "the of und Ärger naïve 你好 x2 3d a b c d e f g h".split()
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(300)]
    return docs + [(None, "the of " * 30), (7, docs[7][1]), (301, None), (302, ""), (303, "É_é ß|ss\x7fA\x00b " * 2000)] + [(999, "und the of " * 9)] * 40


def test_draw_is_what_brute_force_gives(spark):
    docs, target = some_docs(), ["Ärger und the", None, "x2 3d 你好 the"]
    assert drawn_rows(spark, docs, target) == brute_draw(docs, target)


def test_draw_of_nothing(spark):
    assert drawn_rows(spark, [], ["a b"]) == []
    docs = [(i, f"w{i} " * 25) for i in range(45)]
    assert drawn_rows(spark, docs, []) == brute_draw(docs, [])
    assert drawn_rows(spark, [(1, None), (2, "few words")], [None]) == brute_draw([(1, None), (2, "few words")], [])


def test_ranks_over_many_parts(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("_words"), (F.col("id") % 7).alias("_score")).union(spark.range(2000).select(F.lit(1).cast("long"), F.lit(25).cast("long"), F.lit(3).cast("long")))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = [r for r in R.drawn(rows, 50).collect() if r["_rank"]]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["_rank"] for r in sorted(got, key=lambda r: r["_rank"])] == list(range(1, 3501))
    assert [(-r["_score"], r.doc_id) for r in sorted(got, key=lambda r: r["_rank"])] == sorted((-r["_score"], r.doc_id) for r in got)


@pytest.mark.parametrize("block", [3, 5, 65_536])
def test_ring_goes_on_over_blocks(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    words = [random.Random(1).choice([b"a", b"bc", "é".encode()]) for _ in range(17)] + [b"z", b"y"]
    got = Counter(int(x) for r in R.runs(words) for x in r)
    assert got == Counter(zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert [sum(map(len, R.runs(words[:k]))) for k in (0, 1, 2, 3)] == [0, 1, 3, 6]


def brute_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    at = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at)


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a", "a b c d e f g h a b c d e f g h", "x " * 500, "é b # <c>\n\n\nq\r\nq\r\n", "  z\x1cy\x85"]
    return texts + [rng.choice([" ", "\n"]).join(rng.choices("ab", k=rng.choice([5, 9, 30, 200]))) for _ in range(200)] + [" ".join(rng.choices("abcdefgh", k=300)) for _ in range(40)] + [" ".join(map(str, range(50_000))) + " 3 4 5 6 7 8 9 10 11"]


def test_counts_are_what_brute_force_gives(spark):
    texts = odd_texts()
    got = Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Q.DecisionList()).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        n = brute_counts(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert (*(r[c] for c in Q.COUNTS), r.base_failed, r.kept) == (*n, failed, not failed), t


def labelled(spark, n, seed=1):
    """Texts with many symbols, shouting short ones and echoing ones are low; long shouting ones are not."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}x" for _ in range(rng.randint(25, 90))]
        kind = rng.choice(["symbols", "shout", "echo", *["plain"] * 5, "long shout"])
        if kind == "symbols":
            words = [w + "##" for w in words]
        elif kind == "echo":
            words = [w for w in words[:12] for _ in range(4)]
        elif "shout" in kind:
            words = [w.upper() for w in words * (1 + 3 * (kind == "long shout"))]
            words = [f"{w}{k}" for k, w in enumerate(words)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind in ("plain", "long shout"))))
    return docs, labels


def test_rules_hold_for_texts_they_have_not_seen(spark):
    docs, labels = labelled(spark, 1500)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = Q.fit(d, lab.where("doc_id < 900"))
    assert len(rules.rules) >= 2 and any(len(r.asks) > 1 for r in rules.rules)  # what tells shouting from long shouting are two thresholds
    kept = {r.doc_id: r.kept for r in Q.judge(d, rules).collect()}
    held = [(kept[i], bool(q)) for i, q in labels if i >= 900]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert sum(not a for a, b in held if b) <= 0.02 * sum(b for _, b in held)


def test_expression_is_the_list(spark):
    docs, labels = labelled(spark, 600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rules = Q.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"), max_labelled=400)
    x = np.array([[dict(zip(Q.COUNTS + Q.SHARES, Q.measure(t.encode()), strict=True))[c] for c in Q.ASKED] for _, t in docs])
    covered = np.zeros(len(docs), bool)
    for r in rules.rules:
        covered |= r.covers(x)
    got = {r.doc_id: r.kept for r in Q.judge(d, rules).where("not base_failed").collect()}
    assert got == {i: not covered[i] for i in got} and covered.any() and not covered.all()
    assert rules.sql().startswith("CASE WHEN") and rules.sql().endswith("ELSE true END")


def test_rules_of_odd_labels(spark):
    docs, labels = labelled(spark, 300)
    d = spark.createDataFrame([*docs, *docs[:20], (None, docs[0][1]), (5000, None)], "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("quality", "_quality", "n_words", "kept", "_x")])
    lab = spark.createDataFrame([*labels, *labels, (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    got = Q.judge(d, Q.fit(d, lab))
    assert got.count() == len(docs) + 22 and dict(got.dtypes)["n_words"] == "bigint" and got.where("quality = 'z'").count() == got.count()
    assert Q.fit(d, lab.where("quality = 1")).rules == [] and Q.fit(d, lab.limit(0)).rules == [] and Q.fit(d.limit(0), lab).rules == []
    assert Q.DecisionList().sql() == "true" and Q.judge(d.limit(0), Q.DecisionList()).count() == 0
