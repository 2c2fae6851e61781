"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. A pass over the texts gives each document its number of shingles, a digest of the set
   and HyperMinHash registers: for each of 96 hash functions the leading-zero count of the
   smallest hash and 10 mantissa bits after it, 16 bits together.
2. Equal sets (by a digest of 128 bits) are one class; only its representative goes on, so
   copies cost one row each.
3. Bands of four compressed registers are keys. Within a bucket, pairs whose Jaccard
   estimate (corrected for chance collisions of registers) may reach the threshold are
   candidates. Buckets above PAIR_BUCKET members are compared in pairs of blocks inside
   tasks, which return what joins components instead of all pairs.
4. Candidates make families (connected components). A family's texts meet once, in blocks,
   and every pair of a block is intersected on full sets; tasks return the edges by which
   confirmed links join components, so that no group is expanded into all its pairs. A block
   of a large family also meets as many others as its number has bits, and what then hangs
   together with the most of the family is known; only the rest meets all of it.
5. Components of the confirmed links, carried back to the members of the classes.

The chance that a pair at the threshold shares no band is (1 - 0.8^4)^24 = 3e-6; the
estimate's margin is five standard errors. A family of m texts of which r don't hang
together with the most of it costs m * log2(m / BLOCK) + 2 * m * r / BLOCK texts sent, in tasks
of at most two blocks; confirmed components are exact whatever r is.

Nulls and edge cases: a null or empty text, or one without words, has no shingles and is
linked with nothing; a null doc_id takes part in nothing, has a null component and is kept;
rows with equal doc_id are separate texts with a common id; repeated rows are one class;
a very long text is read whole, its registers in slices; of equal smallest ids either row
may stand for the class, with the same result; an empty table gives an empty result; the
result has the named columns only, whatever others the table has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, small, stash

SHINGLE, THRESHOLD = 5, 80  # words, percent
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Expected chance collisions of two registers, times 2^MANTISSA (from the HyperMinHash paper).
COLLISION = 0.169919487159739093975315012348
#: Below the threshold by five standard errors of an estimate from 96 registers.
MARGIN = 5 * (0.8 * 0.2 / REGISTERS) ** 0.5
PAIR_BUCKET, BUCKET_BLOCK, BLOCK = 8, 256, 128
KEPT_WORDS = 400_000

_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Word -> 64-bit hash; remembers the last words met."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, words: dict, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of the lower-cased (A-Z) text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both are ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - k + 1)
    s = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        s = s * _U(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(s))


def registers(sets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set of hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 4096):
        low = np.minimum(low, (sets[i : i + 4096, None] * _A + _B).min(0))
    zeros = np.minimum(63, 64 - np.frexp(low.astype(float))[1]).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA)
    return ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = (packed << (np.arange(ROWS, dtype=np.uint64) * _U(16))).sum(1, dtype=np.uint64)
    return _mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.int64)


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers of sets of n and m, corrected for collisions."""
    by_chance = COLLISION * 4.0 * n * m / np.maximum(1, n + m) ** 2 / (1 << MANTISSA)
    return (same / REGISTERS - by_chance) / (1 - by_chance)


def _class(sets: np.ndarray) -> tuple[int, int]:
    """A digest of 128 bits, as two numbers."""
    h = hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def signatures(docs: DataFrame, k: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, n, h1, h2, regs, bands): number of shingles, digest of the set, registers and band keys.

    The column that row names (long) is carried along as _row.
    """
    more = ["_row"] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n, h, regs, bands = [], [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t, words, k)
                    r = registers(s)
                    n.append(len(s))
                    h.append(_class(s))
                    regs.append(r.tobytes())
                    bands.append(band_keys(r) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([x[i] for x in h], pa.int64()) for i in (0, 1)), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(part.column(c) for c in more)], ["doc_id", "n", "h1", "h2", "regs", "bands", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(row).cast("long").alias("_row")] if row else []))
    return rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, regs binary, bands array<long>" + "".join(f", {c} long" for c in more))


class _Forest:
    """Links that join what wasn't joined."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal keys."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(r)
    if held:
        yield now, held


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


def _joined(vs: list[int], near: np.ndarray, mine: np.ndarray, two: bool) -> list[tuple[int, int]]:
    """The fewest edges that say which of the sorted vs hang together.

    near: upper triangle, who is linked. Of one block, each goes to its component's
    smallest. Of two, what hangs together within a block is known from the block itself,
    and only smallest ones of either side that links between the blocks join are returned.
    """
    forest = _Forest(len(vs))
    within = near & (mine[:, None] == mine[None, :]) if two else near
    for x, y in zip(*np.nonzero(within), strict=True):
        forest.join(int(x), int(y))
    if not two:
        return [(vs[x], vs[r]) for x in range(len(vs)) if (r := forest.root(x)) != x]
    out = []
    for x, y in zip(*np.nonzero(near & ~within), strict=True):
        a, b = forest.root(int(x)), forest.root(int(y))
        if forest.join(a, b):
            out.append((vs[a], vs[b]))
    return out


def _block_pairs(rows: DataFrame, size: F.Column, block: int, key: str) -> DataFrame:
    """Each row once for each pair of blocks of its group that its block is in: _i <= _j, _mine."""
    count = F.ceil(size / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("v"), count)
    to = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda j: F.struct(F.least(own, j).alias("_i"), F.greatest(own, j).alias("_j")))
    return rows.withColumn("_mine", own).withColumn("_to", F.explode(to)).select(*[c for c in rows.columns], "_mine", F.col("_to._i").alias("_i"), F.col("_to._j").alias("_j"))


def candidates(reps: DataFrame, low: float) -> DataFrame:
    """(a, b): pairs of classes that share a band and whose estimate is at least low.

    reps: (v, n, regs, bands). Of large buckets, edges that join what hangs together are returned.
    """
    keyed = reps.select("v", F.explode("bands").alias("key"))
    # counted with partial sums: the members of a large bucket never meet in one task
    counts = stash(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "nd_keys")
    sized = stash(keyed.join(small(counts), "key"), "nd_buckets")
    groups = sized.where(F.col("m") <= PAIR_BUCKET).groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("vs")).select("vs").distinct()
    pairs = groups.select(F.explode(F.flatten(F.transform("vs", lambda x, i: F.transform(F.slice("vs", i + 2, F.size("vs")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*").distinct()
    side = reps.select("v", "n", "regs")
    both = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            ok = estimate((ra == rb).sum(1), b.column("na").to_numpy(), b.column("nb").to_numpy()) >= low
            yield b.select(["a", "b"]).filter(pa.array(ok))

    few = both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(near, "a long, b long")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, ("key", "_i", "_j")):
            rows = sorted({r["v"]: r for r in rows}.values(), key=lambda r: r["v"])
            regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
            n = np.array([r["n"] for r in rows], float)
            near = np.zeros((len(rows), len(rows)), bool)
            for x in range(len(rows) - 1):
                near[x, x + 1 :] = estimate((regs[x + 1 :] == regs[x]).sum(1), n[x + 1 :], n[x]) >= low
            if out := _joined([r["v"] for r in rows], near, np.array([r["_mine"] for r in rows]), i != j):
                yield _edges(out)

    large = sized.where(F.col("m") > PAIR_BUCKET).join(side, "v")
    large = _block_pairs(large, F.col("m"), BUCKET_BLOCK, "key").select("key", "_i", "_j", "_mine", "v", "n", "regs")
    many = large.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(forests, "a long, b long")
    return few.union(many).distinct()


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Upper triangle: which two sets are linked, by their full intersections."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), bool)
    if len(sets) <= 12:
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                if 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    out[x, y] = 100 * both >= percent * (size[x] + size[y] - both)
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    col, row = number[at[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(sets), len(sets)))
    width = 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    return np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets in the place of texts, a few rows at a time; a row whose text isn't its class's (another with the same doc_id) goes."""
    words = _Words()
    for b in batches:
        names = [c for c in b.schema.names if c not in ("text", "h1", "h2")]
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            sets = [shingles(t, words, k) for t in part.column("text").to_pylist()]
            same = pa.array([_class(s) == h for s, h in zip(sets, zip(part.column("h1").to_pylist(), part.column("h2").to_pylist(), strict=True), strict=True)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "s"]).filter(same)


def _held(rows: list[dict]) -> tuple[list[int], list[np.ndarray]]:
    """The rows' classes and sets, by class, each once."""
    sets = {r["v"]: np.frombuffer(r["s"], np.uint64) for r in rows}
    return sorted(sets), [sets[v] for v in sorted(sets)]


def links(docs: DataFrame, families: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between classes, confirmed on full sets, that tell which of them hang together.

    families: (doc_id, v, h1, h2, fam, m), stashed. A family's classes are dealt into blocks.
    First each block is compared within itself and with log2(blocks) others (those whose
    number differs in one bit), which joins what is alike throughout. Pairs that hang
    together already need no link of their own; what doesn't hang together with the most
    of its family is then compared with all of it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    own = F.pmod(F.xxhash64("v"), count)
    bits = F.transform(F.sequence(F.lit(0), F.floor(F.log2(count)).cast("int")), lambda i: own.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    others = F.transform(F.filter(bits, lambda j: j < count), lambda j: F.struct(F.least(own, j).alias("_i"), F.greatest(own, j).alias("_j")))
    to = F.concat(F.array(F.struct(own.alias("_i"), own.alias("_j"))), others)
    rows = texts.join(small(families), "doc_id").withColumn("_mine", own).withColumn("_to", F.explode(to))
    rows = rows.select("fam", "_to._i", "_to._j", "_mine", "v", "h1", "h2", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _groups(_sets(batches, k), ("fam", "_i", "_j")):
            vs, sets = _held(group)
            block = {r["v"]: r["_mine"] for r in group}
            if len(vs) > 1 and (out := _joined(vs, _linked(sets, percent), np.array([block[v] for v in vs]), i != j)):
                yield _edges(out)

    first = rows.repartition("fam", "_i", "_j").sortWithinPartitions("fam", "_i", "_j").mapInArrow(compare, "a long, b long")
    first = stash(first, "nd_links")
    large = stash(families.where(F.col("m") > BLOCK), "nd_large")
    if not large.limit(1).count():
        return first
    found = components(first.join(large.select(F.col("v").alias("a")), "a", "left_semi"), "nd_parts")
    state = stash(large.join(found, "v", "left").withColumn("c", F.coalesce("c", "v")), "nd_state")
    most = state.groupBy("fam", "c").agg(F.count("*").alias("n")).groupBy("fam").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("n"))
    most = small(stash(most.where(F.col("all") > F.col("n")).select("fam", "most", (F.col("all") - F.col("n")).alias("rest")), "nd_most"))
    state = state.join(most, "fam")
    if not state.limit(1).count():
        return first
    apart = F.ceil(F.col("rest") / F.lit(BLOCK)).cast("long")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # as one of all, a class meets every block of the rest; as one of the rest, every block of all
    place = F.transform(numbers(apart), lambda x: F.struct(x.alias("_i"), own.alias("_j"), F.lit(0).alias("_asks")))
    asks = F.transform(numbers(count), lambda x: F.struct(F.pmod(F.xxhash64("v"), apart).alias("_i"), x.alias("_j"), F.lit(1).alias("_asks")))
    to = F.when(F.col("c") == F.col("most"), place).otherwise(F.concat(place, asks))
    rows = texts.join(small(stash(state, "nd_rest")), "doc_id").withColumn("_to", F.explode(to)).select("fam", "_to.*", "v", "c", "h1", "h2", "text")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(_sets(batches, k), ("fam", "_i", "_j")):
            vs, sets = _held(group)
            part, asks = {r["v"]: r["c"] for r in group}, {r["v"] for r in group if r["_asks"]}
            label = {c: i for i, c in enumerate(sorted(set(part.values())))}
            forest, out = _Forest(len(label)), []
            if len(label) > 1:
                for x, y in zip(*np.nonzero(_linked(sets, percent)), strict=True):
                    a, b = vs[x], vs[y]
                    if (a in asks or b in asks) and forest.join(label[part[a]], label[part[b]]):
                        out.append((a, b))
            if out:
                yield _edges(out)

    second = rows.repartition("fam", "_i", "_j").sortWithinPartitions("fam", "_i", "_j").mapInArrow(rest, "a long, b long")
    return stash(first.union(second), "nd_links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = THRESHOLD, row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    If row names a column of docs (long), also that one, as _row, and _group, which tells
    components apart even if they share their smallest doc_id; it is null where a row is alone.
    """
    signed = stash(signatures(docs, k, row), "nd_signatures")
    real = signed.where("n > 0 and doc_id is not null")
    # equal sets are told by 128 bits and numbered: from here on a class is a number
    classes = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("v", F.monotonically_increasing_id()), "nd_classes")
    reps = stash(signed.join(classes.select("doc_id", "h1", "h2", "v"), ["doc_id", "h1", "h2"]).select("v", "n", "regs", "bands"), "nd_reps")
    pairs = stash(candidates(reps, percent / 100 - MARGIN), "nd_candidates")
    named = classes.select("v", "doc_id", "h1", "h2")
    family = components(pairs, "nd_families").select("v", F.col("c").alias("fam"))
    sizes = small(stash(family.groupBy("fam").agg(F.count("*").alias("m")), "nd_sizes"))
    families = stash(family.join(sizes, "fam").join(named, "v").select("doc_id", "v", "h1", "h2", "fam", "m"), "nd_members")
    found = components(links(docs, families, k, percent), "nd_components")
    least = stash(found.join(named, "v").groupBy("c").agg(F.min("doc_id").alias("component_id")), "nd_least")
    of = found.join(small(least), "c").select("v", "component_id", "c")
    many = classes.where("copies > 1").select("v", F.col("doc_id").alias("own"))
    of = of.join(many, "v", "full").select("v", F.least("component_id", "own").alias("component_id"), F.coalesce("c", "v").alias("c"))
    of = small(stash(of.join(classes.select("v", "h1", "h2"), "v").drop("v"), "nd_of"))
    # a class without an entry is one document that is linked with none
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), *[F.when(F.col("n") > 0, F.col(h)).alias(h) for h in ("h1", "h2")], *(["_row"] if row else [])).join(of, ["h1", "h2"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    more = ["_row", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("_group")] if row else []
    return rows.select("doc_id", "n_shingles", "component_id", *more, F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's shingles have four words."""
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
