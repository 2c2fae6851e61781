"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards own virtual nodes at hashed places of a ring; a key belongs to the next virtual
node clockwise. Keys of a full shard continue clockwise to the next shard with room. A
shard's capacity is its even share of the rows (times 1 + slack), so with slack 0 counts
are at most one apart; keys that find room at home don't move.

The ring has SHARDS * VIRTUAL arcs, whatever the number of rows: per arc the rows are
counted, and one fold over that bounded array fills the shards. Within an arc, rows are
numbered in ring order: the ring is cut into fine buckets that grow with the table, their
counts are prefix-summed within each arc, and only a bucket's own rows are sorted. All of it
is DataFrame work on narrow rows.

Nulls and edge cases: a null text has 0 bytes (size 1, checksum 0); a null doc_id takes
its place from the checksum and size; a very long text counts by its size alone; rows with
equal doc_id share a place on the ring and are told apart by checksum and size, equal rows
in any order (one id that many rows have is sorted in one task, without its texts); an
empty table gives an empty result with no shard; the result has the named columns only,
whatever others the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_below, listed, load, stash

SHARDS, VIRTUAL = 16, 64
#: Rows in a fine bucket, on average.
BUCKET_ROWS = 2_000
#: The ring's places are 0 to 2^62 - 1.
RING_BITS = 62


def place(*cols: object) -> F.Column:
    """A hashed place on the ring."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - RING_BITS)


def ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """One row: nodes, the virtual nodes (at, shard) in ring order. shards * virtual entries."""
    nodes = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return nodes.select(place(F.lit("node"), "shard", "v").alias("at"), "shard").agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("nodes"))


def fill(counts: DataFrame, spark: SparkSession, shards: int, virtual: int, slack: float) -> DataFrame:
    """Pieces (arc, lo, hi, shard, slot): rows lo to hi - 1 of an arc go to a shard, from that slot on.

    counts: (arc, n), one row for each arc that has rows. Arcs are visited clockwise; each
    gives its rows to its own shard, and what finds no room to the next shards clockwise.
    """
    arcs = shards * virtual
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.map_from_entries(F.collect_list(F.struct("arc", "n"))).alias("of"))
    both = total.crossJoin(ring(spark, shards, virtual))  # one row each
    twice = F.transform(F.concat("nodes", "nodes"), lambda x: x["shard"])
    both = both.select("t", "of", twice.alias("twice"))
    # the shards in the order in which a key of the arc meets them
    met = F.transform(F.sequence(F.lit(0), F.lit(arcs - 1)), lambda i: F.struct(i.alias("arc"), F.coalesce(F.col("of")[i], F.lit(0)).cast("long").alias("n"), F.array_distinct(F.slice("twice", i + 1, arcs)).alias("met")))
    even = F.floor(F.col("t") / shards)
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (even + F.when(s < F.col("t") % shards, 1).otherwise(0) + F.ceil(even * F.lit(float(slack)))).cast("long"))
    both = both.select(met.alias("arcs"), caps.alias("caps"))
    piece = "struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>"

    def step(state, arc):
        def give(inner, s):
            took = F.least(inner["left"], F.element_at("caps", s + 1) - F.element_at(inner["load"], s + 1))
            lo = arc["n"] - inner["left"]
            one = F.struct(arc["arc"].alias("arc"), lo.alias("lo"), (lo + took).alias("hi"), s.alias("shard"), F.element_at(inner["load"], s + 1).alias("slot"))
            more = F.struct((inner["left"] - took).alias("left"), F.transform(inner["load"], lambda x, i: F.when(i == s, x + took).otherwise(x)).alias("load"), F.concat(inner["out"], F.array(one)).alias("out"))
            return F.when((inner["left"] > 0) & (took > 0), more).otherwise(inner)

        first = F.struct(arc["n"].alias("left"), state["load"].alias("load"), F.array().cast(f"array<{piece}>").alias("out"))
        got = F.aggregate(arc["met"], first, give)
        return F.struct(got["load"].alias("load"), F.concat(state["out"], got["out"]).alias("out"))

    start = F.struct(F.transform("caps", lambda x: F.lit(0).cast("long")).alias("load"), F.array().cast(f"array<{piece}>").alias("out"))
    return both.select(F.inline(F.aggregate("arcs", start, step)["out"]))


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """(doc_id, _size, _crc, _home, _shard, _slot): each row's place; slots are gapless from 0.

    _home is the shard that the row would have without bounds.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    rows = rows.withColumn("_at", F.when(F.col("doc_id").isNull(), place("_crc", "_size")).otherwise(place("doc_id")))
    owner = ring(spark, shards, virtual).select(F.transform("nodes", lambda x: x["at"]).alias("ats"), F.transform("nodes", lambda x: x["shard"]).alias("owners"))
    table = owner.first()  # shards * virtual entries
    ats = listed([int(x) for x in table.ats], "bigint")
    rows = rows.withColumn("_arc", F.pmod(count_below(len(table.ats), lambda i: F.element_at(ats, i + 1) < F.col("_at")), F.lit(shards * virtual)))
    rows = stash(rows, "ring_rows")
    fine = max(64, rows.count() // BUCKET_ROWS)
    width = (1 << RING_BITS) // fine + 1
    rows = rows.withColumn("_fine", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    cells = stash(rows.groupBy("_arc", "_fine").agg(F.count("*").alias("n")), "ring_cells")
    # the last arc reaches over the ring's start: its cells after the last node come first
    wrapped = (F.col("_arc") == 0) & (F.col("_fine") >= F.lit(int(table.ats[-1]) // width))
    order = Window.partitionBy("_arc").orderBy((~wrapped).cast("int"), "_fine")
    cells = cells.withColumn("_before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    pieces = stash(fill(cells.groupBy(F.col("_arc").cast("int").alias("arc")).agg(F.sum("n").alias("n")), spark, shards, virtual, slack), "ring_pieces")
    within = Window.partitionBy("_arc", "_fine").orderBy("_at", "doc_id", "_crc", "_size")
    ranked = rows.join(cells.select("_arc", "_fine", "_before"), ["_arc", "_fine"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    # at most two pieces an arc more than there are shards * virtual arcs
    p = F.broadcast(pieces)
    got = ranked.join(p, (F.col("_arc") == p.arc) & (F.col("_rank") >= p.lo) & (F.col("_rank") < p.hi))
    home = F.element_at(listed([int(x) for x in table.owners], "int"), (F.col("_arc") + 1).cast("int"))
    return got.select("doc_id", "_size", "_crc", home.alias("_home"), F.col("shard").alias("_shard"), (p.slot + F.col("_rank") - p.lo).alias("_slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_home").alias("home_shard"),
    )


def counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of shard(): how many rows and bytes there are, and that slots are gapless."""
    got = query(spark, sf_dir)
    each = got.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.max("slot") - F.min("slot") + 1).alias("span"), F.countDistinct("slot").alias("slots"))
    all_ = each.groupBy().agg(F.sum("size").alias("size"))
    return each.select("shard", "n", "span", "slots").join(F.broadcast(all_))  # one row


COUNTS_SQL = """
WITH t AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size FROM documents),
s AS (SELECT CAST(range AS INTEGER) AS shard, n // 16 + CAST(range < n % 16 AS BIGINT) AS n, size FROM range(16), t)
SELECT shard, n, n AS span, n AS slots, size FROM s WHERE n > 0
"""
