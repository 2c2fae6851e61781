"""Importance resampling: documents that look like a target are drawn with the odds of their features.

Features are runs of 1 to 3 words, hashed into buckets by CRC-32. One scan of a document keeps
running CRC states: of the runs that started at the last words, each is extended by a space and
the next word, so that no run is ever joined or hashed from its start. A bucket's gain is the
logarithm of its share in the target over its share in the documents; a document's weight is
the sum of its features' gains. Documents are drawn without replacement by Gumbel noise: the
highest of weight plus noise, the noise fixed by a hash of the id.

The scan writes each document's buckets with their counts (10,000 at most, however long the
text), so texts are read once; counts of all documents and weights come from that table. Sums
by bucket are made in each task before they are shuffled. Ranks are positions in a table that
is sorted over all parts: parts hold ranges of (score, doc_id, place), so that neither equal
scores nor repeated rows gather in one. The driver holds a number a bucket and one a part.

Nulls and edge cases: a null text has no words; a text without words has no features and
weight 0; a null doc_id is an empty one in the hash, and comes after all others with an equal
score; repeated rows, and rows with equal doc_id, are documents each, with ranks of their own;
empty tables give an empty result, and an empty target gains that only tell common buckets from
rare ones. Very long texts are read whole, in blocks of words. The result has the named columns
only, whatever others the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, load, stash

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
#: Words whose states are extended at once.
BLOCK = 65_536
#: Documents whose buckets are held at once.
ROWS = 512
#: Rows that a part of the ranking has, about.
PART_ROWS = 1_000_000
#: Letters, digits and all that isn't ASCII make words; A-Z are lowered. Other bytes become spaces.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def runs(words: list[bytes], longest: int = LONGEST) -> Iterator[np.ndarray]:
    """CRC-32 of all runs of 1 to `longest` words, in arrays.

    The ring holds the states of the runs that started at the last longest - 1 words; it goes
    on from one block of words to the next.
    """
    ring: list[list[int]] = [[] for _ in range(longest)]  # by the number of words: states at the end of the block before
    for lo in range(0, len(words), BLOCK):
        block = words[lo : lo + BLOCK]
        spaced = [b" " + w for w in block]
        states = list(map(crc32, block))
        ended = [states]
        for n in range(1, longest):
            # a run of n words that ended at the word before goes on with this one
            before = ring[n - 1][-1:] + ended[n - 1][:-1] if lo else ended[n - 1][:-1]
            ended.append(list(map(crc32, islice(spaced, len(block) - len(before), None), before)))
        ring = ended
        yield from (np.array(e, np.uint32) for e in ended)


def histogram(text: bytes | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """The number of words of a text, and how many of its features fall into each bucket."""
    words = (text or b"").translate(WORDS).split()
    counts = np.zeros(buckets, np.int64)
    for r in runs(words, longest):
        counts += np.bincount(r % np.uint32(buckets), minlength=buckets)
    return len(words), counts


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets that have features, two bytes each, and how many, one byte each if that is enough for all."""
    some = np.flatnonzero(counts)
    many = counts[some]
    return some.astype(np.uint16).tobytes(), (many.astype(np.uint8) if many.max(initial=0) < 256 else many).tobytes()


def unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(buckets, np.uint16)
    return at, np.frombuffer(counts, np.uint8 if len(counts) == len(at) else np.int64)


def featured(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """docs(text, ...) without its text, but with _words, _features, and packed() _buckets and _counts."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                made = []
                for text in b.column("text"):
                    n, counts = histogram(text.as_py(), buckets, longest)
                    made.append((n, int(counts.sum()), *packed(counts)))
                cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, "_words", "_features", "_buckets", "_counts"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "_words long, _features long, _buckets binary, _counts binary"])
    return docs.select(*kept, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of featured() fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, many in zip(b.column("_buckets"), b.column("_counts"), strict=True):
                ids, n = unpacked(at.as_py(), many.as_py())
                total[ids] += n  # each bucket once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    sums = found.select("_buckets", "_counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row a bucket
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the source's), both smoothed by one a bucket."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """featured() with _weight in place of the buckets: the sum of the features' gains."""
    kept = [c for c in found.columns if c not in ("_buckets", "_counts")]
    sent = found.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = (unpacked(at.as_py(), many.as_py()) for at, many in zip(b.column("_buckets"), b.column("_counts"), strict=True))
            weight = [int((sent.value[ids] * n).sum()) for ids, n in each]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(weight, pa.int64())], [*kept, "_weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in kept), "_weight long"])
    return found.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows(doc_id, _words, _score, ...) with _rank: 1, 2, 3... in order of score for the drawn ones, else null."""
    many = rows.agg(F.count("*").alias("all"), F.count_if(F.col("_words") >= least_words).alias("n")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many["all"] // PART_ROWS))
    order = [F.col("_words") < least_words, F.col("_score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_place")]
    ranged = rows.withColumn("_place", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id of a row is its part, shifted left by 33, and its place there
    placed = stash(ranged.withColumn("_at", F.monotonically_increasing_id()), "draw_sorted")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.max("_at").alias("last"))
    before, starts = 0, []
    for r in sorted(sizes.collect(), key=lambda r: r["_part"]):  # a row a part
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    took = (F.col("_words") >= least_words) & (rank <= many["n"] * share // 100)
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.when(took, rank)).drop("_at", "_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for docs(doc_id, text) towards target(text): rank is null for rows that aren't drawn."""
    found = stash(featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "draw_features")
    gain = gains(totals(found), totals(featured(target.select("text"))))
    scored = stash(weighed(found, gain).withColumn("_score", F.col("_weight") + noise(F.col("doc_id"), seed)), "draw_scored")
    discard(found)
    got = drawn(scored, share)
    return got.select("doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("text"))


#: CRC-32 by half bytes of the hexadecimal text, of each different feature once.
SQL = r"""
WITH k AS (SELECT list(t) AS ks FROM (SELECT list_reduce([i, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)) AS t FROM range(16) r(i) ORDER BY i)),
d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
w AS (SELECT n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT n, text FROM d UNION ALL SELECT -row_number() OVER (), text FROM benchmark)),
p AS (SELECT n, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
r AS (SELECT n, ws[i] AS f FROM p UNION ALL SELECT n, ws[i] || ' ' || ws[i + 1] FROM p WHERE i + 1 <= len(ws) UNION ALL SELECT n, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM p WHERE i + 2 <= len(ws)),
g AS (SELECT f, string_split(hex(encode(f)), '') AS x FROM (SELECT DISTINCT f FROM r)),
b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1), lambda i: CAST(instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS BIGINT))),
    lambda s, h: xor(s >> 4, ks[xor(s & 15, h) + 1]))) % 10000 AS b FROM g, k),
c AS (SELECT n, b, count(*) AS m FROM r JOIN b USING (f) GROUP BY n, b),
s AS (SELECT range AS b, coalesce(sum(m) FILTER (WHERE n > 0), 0)::DOUBLE AS s, coalesce(sum(m) FILTER (WHERE n < 0), 0)::DOUBLE AS t FROM range(10000) LEFT JOIN c ON c.b = range GROUP BY range),
a AS (SELECT b, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM s),
x AS (SELECT n, sum(m)::BIGINT AS n_features, sum(m * gain)::BIGINT AS weight FROM c JOIN a USING (b) WHERE n > 0 GROUP BY n),
y AS (SELECT n, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d JOIN w USING (n) LEFT JOIN x USING (n)),
z AS (SELECT *, row_number() OVER (ORDER BY words < 20, score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (WHERE words >= 20) OVER () AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= many * 5 // 100 THEN k END AS rank FROM z
"""
