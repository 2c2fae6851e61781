"""Helpers that the training-data operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Lookup tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: Vertices with more edges are hubs, whose edges are joined in so many parts.
HUB, SALT = 100_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (as in tests) is a folder of its
    own set; on a cluster that is an error, as executors couldn't see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    It cuts the lineage, and a lost executor costs no more than the stage that runs.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back.stashed_at = at
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def apart(docs: DataFrame, made: tuple[str, ...], *read: str) -> tuple[DataFrame, list[Column]]:
    """docs as one struct column beside the columns that an operator reads, and what selects the struct's fields again.

    An operator's own columns can't clash with fields of the struct. Columns that the
    operator makes take the place of the table's columns of the same name.
    """
    names = [c for c in docs.columns if c not in made]
    packed = docs.select(*[F.col(f"`{c}`").alias(c) for c in read], F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return packed, [F.col("_row").getField(c).alias(c) for c in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stashed lookup table, marked for broadcast only if it is proven small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    """Number of words of the text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def listed(values: list, kind: str) -> Column:
    """A literal array, folded into the plan, of however many values."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def count_below(n: int, below: Callable[[Column], Column]) -> Column:
    """Binary search over places 0 to n - 1: how many come before the first for which below(place) is false."""
    middle = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))),
        F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(below(middle(s)), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
    )["lo"]


def salted(edges: DataFrame, key: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
    """edges, stashed, with a salt _s, and the hubs: keys with more than HUB edges, whose edges are dealt over SALT salts by the other column; _s is -1 for the rest."""
    hubs = edges.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select(F.col(key).alias("_hub"))
    hubs = stash(hubs, name)
    salt = F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALT))).otherwise(-1)
    return stash(edges.join(small(hubs), F.col(key) == F.col("_hub"), "left").select(*edges.columns, salt.cast("long").alias("_s")), name), hubs


def offered(rows: DataFrame, key: str, hubs: DataFrame) -> DataFrame:
    """rows with _s -1, and those of hubs once a salt besides, to be joined with salted() edges on key and _s."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    plain = rows.withColumn("_s", F.lit(-1).cast("long"))
    return plain.union(rows.join(hubs, F.col(key) == F.col("_hub"), "left_semi").select(*rows.columns, salts.alias("_s")))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges(a, b): (v, c), c the smallest vertex reachable.

    Minimum labels travel over edges, then each label jumps to its label's label, until
    nothing changes. All of it is grouped by vertex with partial sums; edges that end in a
    hub are joined in parts, and of the labels only those that have a smaller one themselves
    are looked up, so that neither a hub nor the label of a giant component is a hot key.
    Vertices without an edge don't appear. Tables of earlier rounds are deleted.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), name)
    parted, hubs = salted(both, "b", "a", name)
    discard(both)
    held = stash(parted.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), name)
    while True:
        lab = held.select("v", "c")
        ends = offered(lab.select(F.col("v").alias("b"), "c"), "b", hubs)
        seen = parted.join(ends, ["b", "_s"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        near = stash(lab.join(seen, "v").select("v", "c", F.least("c", "m").alias("n")), name)
        on = near.where("n <> v").select(F.col("v").alias("n"), F.col("n").alias("up")).join(near.select("n").distinct(), "n", "left_semi")
        on = stash(on, name)
        new = stash(near.join(small(on), "n", "left").select("v", F.least("n", F.coalesce("up", "n")).alias("c"), F.col("c").alias("was")), name)
        discard(held, near, on)
        if not new.where("c <> was").limit(1).count():
            discard(parted, hubs)
            return new.select("v", "c")
        held = new
