"""Personal data, toxicity, pieces, fingerprints, near duplicates on fixtures and odd tables."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, fingerprints, neardup, pieces, pii, toxicity

#: Names that operators use for columns of their own.
CLASH = "toxic severity start end kind pattern token may score best k p up b a v n h1 h2 fam m c regs bands key _row _id _of _new _base _spans _group _part _own _to ids n_pieces table".split()
DOCS = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *(f"own {c}" for c in CLASH)) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (None, "some text here"), (None, None), (3, " \t\n"), (4, "word " * 30_000), (5, "a"), (5, "a"), (6, "é😀 ü \u00a0x"), (7, "x" * 50_000)]


# personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base(t):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in rx.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    texts = [
        "mail a.b@x.org, c@d.e.f-g and a@b.com_x@y.org @no x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3.99999999999999999999", "card 4111 1111 1111 1111 or 4111-1111-1111-1111 or 4111111111111112",
        "+1 (743) 555-3824 +49-30-1234567 +1 +1234567890123456", "é😀 a@b.co 10.0.0.1", "9" * 20_000, "a" * 50_000 + "@b.co", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1 555 123 4567@x.y 4111111111111111@z.co",
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choice("0123456789 .-+@ab()") for _ in range(300)) for _ in range(200)]
    got = pii.extract(docs(spark, list(enumerate(texts)))).select("doc_id", "_base").collect()
    assert all([tuple(s) for s in r._base] == base(texts[r.doc_id]) for r in got)


def test_contexts_find_more(spark):
    """A pattern that always meets phones discovers a number that the base pattern can't tell."""
    rows = [(i, f"Please call +1 555 010 {1000 + i} today") for i in range(30)] + [(100, "Please call 0171-5550199 today"), (101, "In version 2024-10-11 today nothing"), (102, "he paid 123456789 yesterday")]
    got = {r.doc_id: [tuple(s) for s in r._spans] for r in pii.extract(docs(spark, rows)).collect()}
    assert got[100] == [(12, 3, 24)] and got[101] == [] and got[102] == []


def test_contexts_find_what_base_patterns_miss(spark):
    rows = [(i, f"Please call +1 555 010 {1000 + i} today") for i in range(30)] + [(100 + i, f"kindly write to user{i}@h{i}.example.org soon") for i in range(30)]
    rows += [(200 + i, f"Tel:+49 30 5550{100 + i}") for i in range(8)] + [(300 + i, f"+49 40 6660{100 + i} anrufen") for i in range(8)]
    rows += [(400 + i, f"seen on +49 50 7770{100 + i}.") for i in range(6)] + [(450 + i, f"seen on 2024-10-{10 + i}.") for i in range(6)]
    # many unlabelled numbers are no reason to distrust "call"
    rows += [(500 + i, f"Please call 0171 555 {1000 + i} today") for i in range(20)]
    hidden = {600: ("kindly write to ", "root@localhost", "email"), 601: ("kindly write to ", "jane(at)host.com", "email"), 602: ("Please call ", "(555) 123-4567", "phone"), 603: ("Tel:", "5550102000", "phone"), 604: ("", "0171 555 0199", "phone"), 605: ("Please call ", "0171 555 0199", "phone")}
    rows += [(i, before + what + (" anrufen" if i == 604 else " today" if i in (602, 605) else " soon" if i < 602 else "")) for i, (before, what, _) in hidden.items()]
    rows += [(700, "seen on 0171 555 0199."), (701, "Please call root@localhost today"), (702, "in 2019 2020 2021 all was well")]
    got = {r.doc_id: r for r in pii.extract(docs(spark, rows)).collect()}
    for i, (before, what, kind) in hidden.items():
        assert [tuple(s) for s in got[i]._spans] == [(len(before), pii.KINDS.index(kind), len(before) + len(what))], (i, got[i])
    assert all(len(got[500 + i]._spans) == 1 for i in range(20))
    assert [list(got[i]._spans) for i in (700, 701, 702)] == [[], [], []]


def test_discovery_is_precise(spark):
    """Identifiers planted in 1,500 texts, some out of the base patterns' reach, among decoys."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha ke".split() for b in "lan mer nis tor vun".split()]
    number = lambda: f"0{rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    mail = lambda: f"{rng.choice(words)}{rng.randint(1, 99)}"
    known = {"phone": lambda: f"+49 30 {rng.randint(1000000, 9999999)}", "email": lambda: f"{mail()}@{rng.choice(words)}.org"}
    unseen = {"phone": number, "email": lambda: f"{mail()}(at){rng.choice(words)}.org"}
    around = {"phone": ["call {} today", "phone {} please", "reach me on {}"], "email": ["write to {} soon", "mail {} please", "contact {} or"]}
    rows, planted, decoys = [], set(), 0
    for i in range(1_500):
        text = " ".join(rng.choice(words) for _ in range(20))
        kind, how = rng.choice(["phone", "email"]), rng.random()
        if how < 0.5:
            what = (known if how < 0.35 else unseen)[kind]()
            text += " " + rng.choice(around[kind]).format(what)
            if how >= 0.35:
                planted.add((i, pii.KINDS.index(kind), text.index(what), text.index(what) + len(what)))
        elif how < 0.7:
            decoys += 1
            text += f" {rng.choice(words)} " + rng.choice(["2023-04-17", f"{rng.randint(10**8, 10**9)}", number(), f"rev{rng.randint(10000, 99999)}"]) + f" {rng.choice(words)}"
        rows.append((i, text + " " + " ".join(rng.choice(words) for _ in range(10))))
    new = {(r.doc_id, s["kind"], s["start"], s["end"]) for r in pii.extract(docs(spark, rows)).collect() for s in r._spans if s not in r._base}
    assert len(planted) > 150 and decoys > 200
    assert len(new & planted) >= 0.9 * len(planted) and len(new & planted) >= 0.95 * len(new)


def test_spans_are_the_same_by_plan_and_by_join(spark, monkeypatch):
    rows = [(i, f"Please call +1 555 010 {1000 + i} today") for i in range(30)] + [(100 + i, f"kindly write to user{i}@h{i}.example.org soon") for i in range(30)]
    rows += [(200 + i, f"Please call 0171 555 {1000 + i} today, or write to a{i}(at)b.org soon") for i in range(20)] + [(200, "Please call 0171 555 1000 today, or write to a0(at)b.org soon"), (None, "Please call 0171 555 9999 today")]
    got = sorted(map(repr, pii.extract(docs(spark, rows)).select("doc_id", "_spans").collect()))
    monkeypatch.setattr(pii, "TRUSTED", 0)
    assert got == sorted(map(repr, pii.extract(docs(spark, rows)).select("doc_id", "_spans").collect()))
    assert sum("kind=3" in r for r in got) >= 50


def test_identifiers_of_any_length(spark):
    """What is found has no greatest length."""
    rows = [(i, f"kindly write to user{i}@h{i}.example.org soon") for i in range(30)] + [(100 + i, f"Please call +1 555 010 {1000 + i} today") for i in range(30)]
    long_ones = {500: ("kindly write to ", "j" * 65 + "(at)" + "h" * 70 + "(dot)" + "d" * 90, "email"), 501: ("Please call ", "id" * 60 + "1234", "phone"), 502: ("Please call ", "5-5-5-0-1-0-2-0-0-0-1", "phone")}
    rows += [(i, b + what + (" soon" if i == 500 else " today")) for i, (b, what, _) in long_ones.items()]
    got = {r.doc_id: [tuple(s) for s in r._spans] for r in pii.extract(docs(spark, rows)).collect()}
    assert {i: got[i] for i in long_ones} == {i: [(len(b), pii.KINDS.index(kind), len(b) + len(what))] for i, (b, what, kind) in long_ones.items()}


def test_long_runs_take_linear_time(spark):
    texts = ["1 " * 200_000, "1" * 300_000, "a" * 300_000 + " 12", "(1)" * 100_000, "a" * 200_000 + "(at)b1 2", "1-" * 150_000 + "x", "a" * 100_000 + "1111@"]
    began = time.time()
    assert pii.extract(docs(spark, list(enumerate(texts)))).where("size(_spans) >= 0").count() == len(texts)
    assert time.time() - began < 60


def test_redaction_and_odd_tables(spark):
    rows = docs(spark, [(1, "é mail a@b.co, ip 10.0.0.1."), (2, "none"), *ODD])
    got = {r.doc_id: r.t for r in pii.extract(rows).select("doc_id", pii.redact(F.col("text"), F.col("_spans")).alias("t")).where("doc_id < 3").collect()}
    assert got[1] in ("é mail <email>, ip <ip>.", "")
    assert pii.extract(docs(spark, ODD)).count() == len(ODD)
    assert pii.extract(docs(spark, [])).count() == 0
    assert pii.extract(docs(spark, [(1, None)])).drop("doc_id", "text", "_base", "_spans").first().asDict() == {c: f"own {c}" for c in CLASH if c not in pii.MADE}
    one = pii.extract(docs(spark, [(1, "é mail a@b.co, ip 10.0.0.1.")])).select(pii.redact(F.col("text"), F.col("_spans")).alias("t"))
    assert one.first().t == "é mail <email>, ip <ip>."


# toxicity


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    bad = ["zork", "blarg", "fnord"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic:
            text += [rng.choice(bad) for _ in range(rng.randint(1, 4))]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = range(300, 400)
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= got[i].severity <= 2 for i in held)
    assert model.severity("ZORK! zork blarg fnord") > model.severity("wab")


def brute_fit(rows, labels, prefix=4, ridge=1.0, steps=300):
    """The same model, written with dense matrices and plain Python: (weights, thresholds, cut)."""
    import math

    label = {i: t for i, _, t in labels}
    used = sorted((i, t, label[i]) for i, t in rows if i in label)

    def found(t):
        words = set(re.findall(r"[^\W\d_]+", t.lower()))
        return words | {w[:k] + "*" for w in words for k in range(prefix, len(w)) if k < prefix + 3}

    sets = [found(t) for _, t, _ in used]
    y = np.array([t for _, _, t in used])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    names = []
    for f in sorted(set().union(*sets)):
        pos, n = sum(t for s, t in zip(sets, y, strict=True) if f in s), sum(f in s for s in sets)
        odds = math.log((pos + 0.5) / (n1 + 1)) - math.log((n - pos + 0.5) / (n0 + 1))
        share = n1 / (n1 + n0)
        ratio = 2 * ((pos * math.log(pos / (n * share)) if pos else 0) + ((n - pos) * math.log((n - pos) / (n * (1 - share))) if n > pos else 0))
        if n >= 3 and odds >= 1.5 and ratio >= 16:
            names.append(f)
    x = np.array([[float(f in s) for f in names] for s in sets])
    density = x.sum(1) / np.array([max(1, len(s)) for s in sets])
    grade = y + (y * (density >= np.median(density[y == 1])))
    out = np.arange(len(y)) % 5 == 4
    xs, gs = x[~out], grade[~out]
    each = np.where(gs > 0, 0.5 / (gs > 0).sum(), 0.5 / (gs == 0).sum())
    w, t, vw, vt = np.zeros(len(names)), np.array([0.0, 1.0]), 0, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        aw, at = w + 0.9 * vw, t + 0.9 * vt
        gap = [(sigmoid(xs @ aw - at[j]) - (gs > j)) * each for j in (0, 1)]
        vw = 0.9 * vw - 0.5 * (xs.T @ (gap[0] + gap[1]) + ridge / len(xs) * aw)
        vt = 0.9 * vt + 0.5 * np.array([g.sum() for g in gap])
        w, t = w + vw, np.maximum.accumulate(t + vt)
    expected = lambda z: sum(sigmoid(z - t[j]) for j in (0, 1))
    grid = np.linspace(0.1, 1.2, 45)
    right = [float(((expected(x[out] @ w) >= c) == y[out]).mean()) for c in grid]
    cut = max(float(np.median([c for c, g in zip(grid, right, strict=True) if g == max(right)])), 1.01 * expected(np.zeros(1))[0])
    return dict(zip(names, w, strict=True)), t, cut, lambda text: float(expected(sum(wt for f, wt in zip(names, w, strict=True) if f in found(text))))


def test_toxicity_is_what_brute_force_gives(spark):
    rows, labels = corpus(300)
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int"))
    weights, thresholds, cut, severity = brute_fit(rows, labels[:250])
    assert model.cut == pytest.approx(cut) and model.thresholds == pytest.approx(list(thresholds))
    assert model.weights == pytest.approx({f: w for f, w in weights.items() if abs(w) > 1e-4})
    for r in toxicity.score(docs(spark, rows), model).collect():
        assert r.severity == pytest.approx(severity(rows[r.doc_id][1])) and r.toxic == (r.severity >= cut) and r.kind == "own kind"


def test_toxicity_odd_tables(spark):
    rows, labels = corpus(80)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    assert toxicity.score(docs(spark, ODD), model).count() == len(ODD)
    nothing = toxicity.fit(docs(spark, []), labels)
    assert [r.toxic for r in toxicity.score(docs(spark, [(1, "zork")]), nothing).collect()] == [False]
    assert not toxicity.fit(docs(spark, rows), labels.limit(0)).thresholds


# pieces


@pytest.fixture(scope="module")
def codec():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Codec(f.read())


TEXTS = ["Hello world", "", " a  b\n c", "naïve café 😀 日本語\n\t漢字", "x" * 300, "   spaces    everywhere  ", "Ünïcode\u00a0text", "a" * 7 + " " * 9 + "b", "1234567890 +-*/ <s> </s>"]


def test_pieces_are_the_librarys(codec):
    rng = random.Random(2)
    more = ["".join(rng.choice("abcdefgh THEing  .,\né") for _ in range(200)) for _ in range(50)]
    # runs of spaces and words of any length
    more += [" " * n + w for n in (2, 3, 16, 17, 31, 150, 199, 200, 201, 202, 1_000, 5_000) for w in ("", "b", "the ends")]
    more += ["ab" * 3_000, "the" * 500 + "  " * 300 + "x"]
    for t in TEXTS + more:
        assert codec.encode(t) == codec.sp.encode(t), t
        assert codec.decode(codec.encode(t)) == t


def test_unigram_is_viterbi(codec):
    """Highest sum of scores, against all ways to cut a short text."""

    class Small(pieces.Codec):
        def __init__(self):
            import ahocorasick

            self.kind, self.unk, self.byte = pieces.UNIGRAM, 0, {}
            self.piece = ["<unk>", "a", "b", "ab", "ba", "aba", "bab", "c"]
            self.id = {p: i for i, p in enumerate(self.piece) if i}
            self.score = dict(enumerate([0, -1.5, -1.7, -2.0, -2.6, -3.3, -3.2, -0.5]))
            self.low, self.pairs, self.lone, self.words = -20.0, {}, {}, {}
            self.automaton = ahocorasick.Automaton()
            for p, i in self.id.items():
                self.automaton.add_word(p, (len(p), i))
            self.automaton.make_automaton()

    small = Small()

    def ways(s):
        if not s:
            yield 0.0, []
        for k in range(1, min(3, len(s)) + 1):
            if s[:k] in small.id or (k == 1):
                for score, rest in ways(s[k:]):
                    yield score + (small.score[small.id[s[:k]]] if s[:k] in small.id else small.low), [small.id.get(s[:k], 0), *rest]

    rng = random.Random(4)
    for _ in range(100):
        s = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 9)))
        best = max(w for w, _ in ways(s))
        ids = small.stretch(s)
        assert sum(small.score[i] if i else small.low for i in ids) == pytest.approx(best)


def test_pieces_tables(spark):
    table = docs(spark, [*ODD, *enumerate(TEXTS, 100)])
    coded = pieces.encode(table, check=True)
    assert coded.count() == len(ODD) + len(TEXTS) and coded.where("not restored").count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(coded.where("doc_id >= 100")).collect()}
    assert back == dict(enumerate(TEXTS, 100))
    assert pieces.encode(docs(spark, [])).count() == 0


# fingerprints


def brute_print(t):
    """SimHash, a bit at a time."""
    import math
    from collections import Counter

    count = Counter(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    bits = {w: bin(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") + (1 << 64))[3:] for w in count}
    votes = [sum((1 if bits[w][k] == "1" else -1) * round((1 + math.log(n)) * 1024) for w, n in count.items()) for k in range(64)]
    return int("".join("1" if v > 0 else "0" for v in votes), 2)


def brute_fingerprints(rows):
    """rows (doc_id, text) with different ids: what the query returns, but for the neighbours."""
    order = sorted(rows, key=lambda r: -r[0])
    prints = {i: brute_print(t) for i, t in rows}
    out = {}
    for k, (i, t) in enumerate(order):
        t, (j, n) = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 3
        e = t[: len(t) - cut] + (n or "")[:cut]
        same = lambda x, y: sum(a == b for a, b in zip(f"{x:064b}", f"{y:064b}", strict=True)) / 64
        f = brute_print(e)
        out[i] = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{prints[i]:016x}", f"{f:016x}", same(prints[i], f), same(prints[i], prints[j]))
    return out


def test_fingerprints(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None), (20_001, "")]
    got = {r.doc_id: tuple(r) for r in fingerprints.compare_edited(docs(spark, rows), parts=7).collect()}
    assert got == brute_fingerprints(rows)
    assert {r.doc_id: tuple(r) for r in fingerprints.compare_edited(docs(spark, rows)).collect()} == got


def test_fingerprint_query(spark, tmp_path):
    """The whole query, neighbours included, against brute force."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(12)]
    rows = []
    for i in range(240):
        t = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(1_000, None), (1_020, ""), (1_040, rows[40][1])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_fingerprints(rows)
    prints = {int(r[3], 16) for r in want.values()}
    got = fingerprints.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and max(r.n_near or 0 for r in got) > 1
    for r in got:
        assert tuple(r)[:7] == want[r.doc_id]
        mine = int(r.fingerprint, 16)
        near = sorted(((mine ^ p).bit_count(), p) for p in prints if 0 < (mine ^ p).bit_count() <= 3)
        assert (r.n_near, r.nearest) == ((len(near), f"{near[0][1]:016x}" if near else None) if r.doc_id % 20 == 0 else (None, None))


def test_fingerprints_odd_tables(spark):
    assert fingerprints.compare_edited(docs(spark, [])).count() == 0
    assert [r.near_next for r in fingerprints.compare_edited(docs(spark, [(1, "one text")])).collect()] == [1.0]
    assert fingerprints.compare_edited(docs(spark, ODD), parts=3).count() == len(ODD)
    assert fingerprints.fingerprint(docs(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("block", [4_096, 8])
def test_search_within_radius(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 4)]
    near += [base[0] ^ sum(1 << k for k in rng.sample(range(12), 2)) for _ in range(60)]  # a large bucket
    stored = {*near, *base[:30]}
    prints = spark.createDataFrame([(f"{x:016x}",) for x in [*stored, *base[:5]]] + [(None,)], "fingerprint string")
    asked = spark.createDataFrame([(f"{x:016x}",) for x in base], "fingerprint string")
    want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in base for b in stored if 0 < (a ^ b).bit_count() <= 3}
    got = [(r.asked, r.found, r.distance) for r in fingerprints.search(prints, asked, pairs=True).collect()]
    assert len(got) == len(want) and set(got) == want
    best = {}
    for a, b, d in sorted(want, key=lambda x: (x[0], x[2], int(x[1], 16))):
        n, *first = best.get(a, (0, b, d))
        best[a] = (n + 1, *first)
    assert {r.fingerprint: (r.n_near, r.nearest, r.distance) for r in fingerprints.search(prints, asked).collect()} == best
    assert fingerprints.search(prints.limit(0), asked.limit(0)).count() == 0


# near duplicates


def brute_components(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for j, (i, _) in enumerate(sets):
        if i is not None:
            least[root(j)] = min(least.get(root(j), i), i)
    return sorted((i, len(s), least[root(j)] if i is not None else None) for j, (i, s) in enumerate(sets) if i is not None)


def family(rng, n, length, edits):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(length)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(length)] = rng.choice(words)
        yield " ".join(t)


def test_near_duplicates_are_all_found(spark):
    rng = random.Random(11)
    texts = [*family(rng, 150, 120, 8), *family(rng, 40, 60, 6), *(t for _ in range(30) for t in family(rng, 3, rng.randint(5, 200), 3)), "One Two three FOUR five", "one two THREE four five", "few words", "FEW words", "lone"]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (9_000, None), (9_001, ""), (9_002, "  "), *((10_000 + i, texts[0]) for i in range(20))]
    for k in (4, 5):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), k=k).collect())
        assert got == brute_components(rows, k, 80)


def test_large_buckets_and_families(spark, monkeypatch):
    """Small limits make every path run."""
    for name in ("PAIR_BUCKET", "BUCKET_BLOCK", "BLOCK"):
        monkeypatch.setattr(neardup, name, {"PAIR_BUCKET": 2, "BUCKET_BLOCK": 8, "BLOCK": 8}[name])
    rng = random.Random(12)
    rows = list(enumerate([*family(rng, 120, 80, 8), *family(rng, 30, 300, 20)]))
    # a chain of texts, each near its neighbours only: what hangs together is found over many blocks
    words = [f"c{i}" for i in range(300)]
    rows += [(1_000 + i, " ".join(words[i : i + 60])) for i in range(0, 240, 3)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), k=4).collect())
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_odd_tables(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    got = neardup.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_estimates():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        both = int(2_000 * j)
        x = rng.integers(0, 1 << 63, 4_000 - both, dtype=np.uint64)
        a, b = np.unique(x[:2_000]), np.unique(x[2_000 - both :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (neardup.registers(a) == neardup.registers(b)).sum()
        assert abs(neardup.estimate(np.array([same]), np.array([len(a)]), np.array([len(b)]))[0] - true) < 5 * (0.25 / neardup.REGISTERS) ** 0.5


@pytest.mark.parametrize("hub", [100_000, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "SALT", 4)
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, 200), (200, 300), (5, 5)] + [(1_000, i) for i in range(1_001, 1_020)] + [(1_020, 1_010)], "a long, b long")
    got = {r.v: r.c for r in common.components(edges).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {100: 100, 200: 100, 300: 100} | {i: 1_000 for i in range(1_000, 1_021)}
    assert common.components(edges.limit(0)).count() == 0
