"""Mixtures and shards against brute force, and on odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from tidewater.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INTERNAL = "_key _size _source _source_size _target _at _cut _left _alike _copies _part _taken _row _fine _s _budget _epochs _has _before _n target".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int" + "".join(f", {c} string" for c in INTERNAL)


def docs(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, *(f"own {c}" for c in INTERNAL)) for i, t, s in rows], DOCS)


def brute_quality(t):
    if t is None:
        return 0.05
    lines = t.split("\n")
    plain = 1.0 - 4.0 * sum(c in "#$%&*!|<>{}[]=+_~^@\\/" for c in t) / max(len(t), 1)
    return max(0.1, plain) * max(0.5, len(set(lines)) / len(lines))


def brute_mix(rows):
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * total[s] if s in capped else level * weight[s] for s in names}
    out = {}
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, done = target[s] - epochs * total[s], 0
        mine = Counter()
        for i, t, x in rows:
            if x == s:
                u = (int(md5(f"0:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine[-math.log(u) / brute_quality(t), -1 if i is None else i, size(t)] += 1
        for (_, i, n), same in sorted(mine.items()):
            here = min(n * same, max(0, round(budget - done + 1e-9)))
            done += n * same
            out[i, n] = (n, total[s], target[s], n * epochs + (n if done <= budget else here // same if done - n * same <= budget else 0))
    return out


@pytest.mark.parametrize("few, buckets", [(2_000, 1 << 10), (1, 4)])
def test_mix_is_what_brute_force_gives(spark, monkeypatch, few, buckets):
    """With small limits the steps are narrowed many times."""
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = [(i, " \n"[i % 2].join("w#$"[: 1 + (i * k) % 3] for k in range(i * 7 % 23)), f"s{i % 5}" if i % 11 else None) for i in range(300 if few > 1 else 60)]
    rows += [(1_300, None, "s1"), (1_301, "", "tiny"), (1_302, "one", "tiny"), (1_303, "word " * 5_000, "s3"), (None, "a b c", "s2"), (1_304, "twice it is", "s4"), (1_304, "twice it is", "s4")]
    got = mixing.mix(docs(spark, rows)).collect()
    want = brute_mix(rows)
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        n, s, t, k = want[-1 if r.doc_id is None else r.doc_id, r._size]
        assert (r._size, r._source_size, r._taken) == (n, s, k) and r._target == pytest.approx(t)
        assert r._taken == r._size * r._copies + r._part <= 3 * r._size and r._key == "own _key"
        by[r.source] = [by[r.source][0] + r._taken, r._target, 0]
    # the document in which the budget ends is cut, so every source comes within a word of its target
    assert all(abs(a - t) <= 1 for a, t, _ in by.values())


def test_mix_prefers_prose(spark):
    """Keys are scaled by quality: of equally many, prose is taken more often than symbols."""
    rows = [(i, ("the quick fox jumps over a lazy dog" if i % 2 else "## $$ %% && ** !! || <<"), "big") for i in range(2_000)] + [(5_000, "x " * 4_000, "cap")]
    got = mixing.mix(docs(spark, rows), weights=(1, 1)).collect()
    taken = [sum(r._taken for r in got if r.source == "big" and r.doc_id % 2 == k) for k in (0, 1)]
    assert sum(taken) < 16_000 and taken[1] > 2 * taken[0]


def test_first_words(spark):
    from pyspark.sql import functions as F

    texts = ["one two  three", " lead\tand trail \n", "é\u00a0x y", "one", ""]
    for n in (1, 2, 9):
        got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.first_words(F.col("text"), F.lit(n)).alias("t")).collect()]
        for t, g in zip(texts, got, strict=True):
            assert t.startswith(g) and WORD.findall(g) == WORD.findall(t)[:n]


def test_mix_odd_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    same = mixing.mix(docs(spark, [(1, "a b", "x")] * 5 + [(None, None, None)])).collect()
    assert len(same) == 6 and len({(r._copies, r._part) for r in same if r.doc_id == 1}) == 1
    blank = mixing.mix(docs(spark, [(1, "", "x"), (2, None, "x")])).collect()
    assert [r._target for r in blank] == [0.0, 0.0]


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "x" * (i % 50), "s") for i in range(3_000)] + [(None, None, None)]
    got = sharding.shard(docs(spark, rows)).collect()
    per = Counter(r._shard for r in got)
    assert len(got) == len(rows) and len(per) == 16 and max(per.values()) - min(per.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r._shard].append(r._slot)
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())
    assert all((r._size, r._crc) == (1 + r.doc_id % 50, zlib.crc32(b"x" * (r.doc_id % 50))) for r in got if r.doc_id is not None)
    assert [(r._size, r._crc) for r in got if r.doc_id is None] == [(1, 0)]
    assert sum(r._shard == r._home for r in got) > 0.8 * len(got)


def test_shards_move_little_with_slack(spark):
    table = docs(spark, [(i, "x", "s") for i in range(4_000)])
    few, more = ({r.doc_id: r for r in sharding.shard(table, shards=n, slack=0.25).collect()} for n in (8, 9))
    moved = [i for i in few if few[i]._shard != more[i]._shard]
    assert len(moved) < 0.25 * len(few)
    # where the ring alone decides, keys move only to the new shard
    assert all(more[i]._home in (few[i]._home, 8) for i in few)
    per = Counter(r._shard for r in few.values())
    assert max(per.values()) <= 1.25 * 500 + 1


def test_shards_follow_the_ring(spark):
    """Brute force: arcs clockwise, each row to the first shard it meets that has room."""
    table = docs(spark, [(i, "x", "s") for i in range(200)])
    got = {r.doc_id: r for r in sharding.shard(table, shards=3, virtual=4).collect()}
    nodes = [(n["at"], n["shard"]) for n in sharding.ring(spark, 3, 4).first().nodes]
    at = {r.doc_id: r.p for r in table.select("doc_id", sharding.place("doc_id").alias("p")).collect()}
    arc = lambda p: sum(n < p for n, _ in nodes) % len(nodes)
    room = [200 // 3 + (s < 200 % 3) for s in range(3)]
    order = sorted(at, key=lambda i: (arc(at[i]), not (arc(at[i]) == 0 and at[i] > nodes[-1][0]), at[i], i))
    for i in order:
        k = arc(at[i])
        s = next(s for _, s in nodes[k:] + nodes[:k] if room[s])
        room[s] -= 1
        assert got[i]._shard == s and got[i]._home == nodes[k][1]


def test_shards_of_repeated_rows_and_long_texts(spark):
    """Copies of a row, rows that share an id or a text, and very long texts have places of their own."""
    rows = [(5, "same", "s")] * 400 + [(6, f"text {i}", "s") for i in range(300)] + [(1000 + i, "one text", None) for i in range(200)] + [(7, "é" * 400_000, "s"), (7, None, "s"), (None, "x", "s"), (None, "x", "s")]
    table = docs(spark, rows)
    got = sharding.shard(table).collect()
    assert Counter((r.doc_id, r._size, r._crc) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r._shard].append(r._slot)
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())
    # rows of one id have one home, though its shard can't hold them all
    assert len({r._home for r in got if r.doc_id == 5}) == 1 == len({r._home for r in got if r.doc_id == 6}) and len({r._shard for r in got if r.doc_id == 5}) > 3
    again = sharding.shard(table).collect()
    assert Counter((r.doc_id, r._size, r._shard) for r in got) == Counter((r.doc_id, r._size, r._shard) for r in again)


def test_shards_of_nothing(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    assert sharding.shard(docs(spark, [(1, "a", "s")] * 40)).count() == 40
