"""Document fingerprints: 64-bit SimHash, with permuted block tables for search.

Every word votes with its hash's bits, weighted by 1 + ln(count); the sign of a bit's sum
is the fingerprint's bit. Equal texts have equal fingerprints. search() finds all
fingerprints that differ in at most `radius` bits from those asked for: the bits are cut
into radius + spare blocks, so that two near fingerprints agree in `spare` of them at least,
and each choice of so many blocks is a table of buckets. Copies of a fingerprint are one
entry. Buckets that hold one entry, or none that is asked for, end there; the others are
compared in blocks inside tasks, which return a row an asked entry and no pairs, each pair
counted in the first table that it meets in. A bucket of m entries of which a are asked for
costs a * m comparisons, in tasks of BLOCK entries.

Nulls and edge cases: a null text is an empty text, whose fingerprint is 0; a null doc_id
comes after all others in descending order; rows with equal doc_id follow each other by
text, and those that are alike in any order (rows of one id, or without one, are read one
after the other in one task); very long texts are read whole, their words in slices; an
empty table gives an empty result; of a single row the next document is itself; the result
has the named columns only, whatever others the table has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_below, listed, load, small, stash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BITS = 64
#: Words whose votes a task keeps at a time.
KEPT_WORDS = 200_000
#: Bytes of text that a task reads, about; with very many bytes, parts grow (they are streamed).
PART_BYTES, MOST_PARTS = 64 << 20, 10_000
RADIUS, SPARE, BLOCK = 3, 3, 4_096


class Voter:
    """Fingerprints of texts; remembers the votes of the last words met."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.votes = np.zeros((1024, BITS), np.int8)

    def rows(self, words: list[str]) -> np.ndarray:
        """The votes (+1 or -1 a bit) of the words."""
        if len(self.at) + len(words) > KEPT_WORDS and self.at:
            self.at, self.votes = {}, np.zeros((1024, BITS), np.int8)
        new = [w for w in words if w not in self.at]
        if new:
            raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in new)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
            n = len(self.at)
            while n + len(new) > len(self.votes):
                self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
            self.votes[n : n + len(new)] = bits
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return self.votes[[self.at[w] for w in words]]

    def fingerprint(self, text: str) -> int:
        count: dict[str, int] = {}
        for w in WORDS.findall(text):
            count[w] = count.get(w, 0) + 1
        if not count:
            return 0
        words = list(count)
        total = np.zeros(BITS)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            weight = np.round((1 + np.log([count[w] for w in some])) * 1024)  # whole numbers: sums don't depend on the order
            total += weight @ self.rows(some)
        return int.from_bytes(np.packbits(total > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): 16 hex digits for every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voter()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f"{v.fingerprint(t or ''):016x}" for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, _part, _own): rows dealt by ranges of doc_id, in descending order.

    Each part also holds the row that follows its last one (_own false), so that a task
    that reads a part in order meets every row's next document. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, some, size = rows.agg(F.count("*"), F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = parts or max(1, min(MOST_PARTS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES), n // 50 + 1))
    # boundaries are ids; a few of them (parts) come to the driver
    bounds = sorted({int(b) for b in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 and some else []
    ends = listed(bounds or [0], "bigint")
    # part 0 holds rows without an id, and is last in descending order
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(count_below(len(bounds), lambda i: F.element_at(ends, i + 1) < F.col("doc_id")) + 1)
    rows = rows.withColumn("_part", part)
    firsts = rows.groupBy("_part").agg(F.max("doc_id").alias("first")).collect()  # parts + 1 rows at most
    first = {r["_part"]: r["first"] for r in firsts}
    order = sorted(first, reverse=True)
    # the part that needs p's first row after its own; the last needs the very first
    needs = {p: order[i - 1] for i, p in enumerate(order)}
    heads = F.element_at(listed([first.get(p) for p in range(len(bounds) + 2)], "bigint"), F.col("_part") + 1)
    to = F.element_at(listed([needs.get(p) for p in range(len(bounds) + 2)], "int"), F.col("_part") + 1)
    one = lambda p, own: F.struct(p.alias("_part"), F.lit(own).alias("_own"))
    own = one(F.col("_part"), True)
    both = rows.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(heads), F.array(own, one(to, False))).otherwise(F.array(own))).alias("_to")).select("doc_id", "text", "_to.*")
    return both.repartitionById(len(bounds) + 2, F.col("_part")).sortWithinPartitions("_part", F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Voter()
        held: tuple[int, int | None, str, int] | None = None  # part, doc_id, text, fingerprint
        done = -2  # the part whose foreign row has been met; rows that repeat it are left out

        def row(text: str, fp: int, following: str, next_fp: int) -> tuple:
            other = edited(text, following)
            fp2 = v.fingerprint(other)
            return len(text), hashlib.sha256(other.encode()).hexdigest(), f"{fp:016x}", f"{fp2:016x}", likeness(fp, fp2), likeness(fp, next_fp)

        for b in batches:
            out: list[tuple] = []
            for i, text, part, own in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "_part", "_own")), strict=True):
                if not own and part == done:
                    continue
                fp = v.fingerprint(text)
                if held and held[0] == part:
                    out.append((held[1], *row(held[2], held[3], text, fp)))
                held = (part, i, text, fp) if own else None
                done = done if own else part
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def value(fingerprint: Column) -> Column:
    """The 16 hex digits as a number of 64 bits."""
    half = lambda i: F.conv(F.substring(fingerprint, i, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _tables(radius: int, spare: int) -> list[tuple[int, list[int]]]:
    """Of each table: a mask of its blocks, and those of the blocks that a pair which meets here first doesn't agree in."""
    blocks = radius + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(edges, edges[1:], strict=False)]
    return [(sum(mask[i] for i in chosen), [mask[i] for i in range(chosen[-1]) if i not in chosen]) for chosen in combinations(range(blocks), spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, spare: int = SPARE, pairs: bool = False) -> DataFrame:
    """(fingerprint, n_near, nearest, distance) for the fingerprints (16 hex digits) of asked that have others within the radius.

    n_near counts the different fingerprints of prints within the radius, nearest is the
    nearest of them (ties: the smaller). With pairs: (asked, found, distance), a row each.
    """
    spark = prints.sparkSession
    tables = _tables(radius, spare)
    mine = asked.select(value(F.col("fingerprint")).alias("v"), F.lit(1).alias("asked"), F.lit(0).alias("there"))
    all_ = prints.select(value(F.col("fingerprint")).alias("v"), F.lit(0).alias("asked"), F.lit(1).alias("there"))
    entries = stash(all_.union(mine).where("v is not null").groupBy("v").agg(F.max("asked").alias("asked"), F.max("there").alias("there")), "fp_entries")
    masks = listed([_signed(m) for m, _ in tables], "bigint")
    each = entries.select("v", "asked", "there", F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))).alias("t"))
    each = each.withColumn("key", F.col("v").bitwiseAND(F.element_at(masks, F.col("t") + 1)))
    buckets = each.groupBy("t", "key").agg(F.sum("there").alias("m"), F.sum("asked").alias("a"), F.count("*").alias("n")).where("a > 0 and m > 0 and n > 1").select("t", "key", "m")
    met = each.join(small(stash(buckets, "fp_buckets")), ["t", "key"])
    # an entry lies in one block of its bucket; one that is asked for passes by all of them
    count = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    held = F.when(F.col("there") == 1, F.array(F.struct(F.pmod(F.xxhash64("v"), count).alias("block"), F.lit(0).alias("asks")))).otherwise(F.array())
    asks = F.when(F.col("asked") == 1, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("asks")))).otherwise(F.array())
    dealt = met.select("t", "key", "v", F.explode(F.concat(held, asks)).alias("to")).select("t", "key", "to.block", "to.asks", "v")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "t", "key", "block").sortWithinPartitions("t", "key", "block", "asks", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, others = None, [], np.zeros(0, np.uint64)

        def compare(t: int, some: np.ndarray) -> pa.RecordBatch | None:
            x = some[:, None] ^ others[None, :]
            d = np.bitwise_count(x).astype(np.int64)
            near = (d > 0) & (d <= radius)
            for m in tables[t][1]:
                near &= (x & np.uint64(m)) != 0
            if pairs:
                i, j = np.nonzero(near)
                return pa.RecordBatch.from_arrays([pa.array(some[i].view(np.int64)), pa.array(others[j].view(np.int64)), pa.array(d[i, j])], ["v", "found", "distance"]) if len(i) else None
            n = near.sum(1)
            has = np.flatnonzero(n)
            if not len(has):
                return None
            least = np.where(near, d, BITS + 1)[has].min(1)
            first = np.argmax(near[has] & (d[has] == least[:, None]), axis=1)  # others are in ascending order
            return pa.RecordBatch.from_arrays([pa.array(some[has].view(np.int64)), pa.array(n[has].astype(np.int64)), pa.array(least), pa.array(others[first].view(np.int64))], ["v", "n", "distance", "found"])

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("t", "key", "block", "asks", "v")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if b.num_rows else []
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                key, v = tuple(int(c[lo]) for c in cols[:3]), cols[4][lo:hi].view(np.uint64)
                if key != now:
                    now, mine, others = key, [], np.zeros(0, np.uint64)
                if not cols[3][lo]:
                    mine.append(v.copy())
                    others = np.sort(np.concatenate(mine))
                elif len(others):
                    for i in range(0, len(v), 256):
                        if (out := compare(key[0], v[i : i + 256])) is not None:
                            yield out

    hex_ = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    if pairs:
        got = dealt.mapInArrow(run, "v long, found long, distance long")
        return got.select(hex_("v").alias("asked"), hex_("found").alias("found"), F.col("distance").cast("int").alias("distance"))
    got = dealt.mapInArrow(run, "v long, n long, distance long, found long")
    best = got.groupBy("v").agg(F.sum("n").alias("n_near"), F.min(F.struct("distance", hex_("found").alias("found"))).alias("best"))
    return best.select(hex_("v").alias("fingerprint"), "n_near", F.col("best.found").alias("nearest"), F.col("best.distance").cast("int").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints; of each whose doc_id 20 divides, also its neighbours among all."""
    prints = stash(compare_edited(load(spark, sf_dir, "documents").select("doc_id", "text")), "fp_prints")
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = small(stash(search(prints, prints.where(asks)).drop("distance"), "fp_found"))
    return prints.join(found, "fingerprint", "left").select(*prints.columns, F.when(asks, F.coalesce("n_near", F.lit(0))).alias("n_near"), F.when(asks, F.col("nearest")).alias("nearest"))


def edits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of compare_edited(): sizes and edited texts."""
    return query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS following FROM d)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(following, length(text) // 3)) AS edited_sha256 FROM n
"""
