"""A kept inverted index: postings by term, in segments that are added and merged.

A posting says how often a term occurs in a row. Postings lie in folders by a hash of their
term, sorted by term, so that a search reads the folders of its terms and, by the statistics of
their files, the stretches that have them. A term's postings are dealt over files by a hash of
the row's id: common terms are no hot spots.

Rows that come, or come again, make a segment of their own; older segments aren't touched.
Which ids a segment takes from older ones is kept with it, and older postings of those don't
count. When there are too many segments they are merged into one.

Nulls and edge cases: a null id is an id like others; null terms don't count; a row without
terms has no posting, and takes away those that it had; of rows with equal ids in one add() the
terms are put together; an empty index finds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..sources.shared import shared_dir

BUCKETS, SALTS, MOST_SEGMENTS, FEW = 32, 8, 8, 200_000


class Index:
    """An index of ids of one type, in a folder."""

    def __init__(self, spark: SparkSession, id_type: DataType, path: str | None = None, buckets: int = BUCKETS, most: int = MOST_SEGMENTS) -> None:
        self.spark, self.buckets, self.most = spark, buckets, most
        self.path = (path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.postings_of = StructType().add("term", "string").add("id", id_type).add("n", "long").add("_bucket", "integer")
        self.ids_of = StructType().add("id", id_type)

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def segments(self) -> list[str]:
        """What is whole: the last merged segment, and those added since."""
        system, at = self._fs("ready")
        names = sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []
        full = max((n for n in names if n.endswith("full")), default="")
        return [n for n in names if n >= full]

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, postings: DataFrame, ids: DataFrame, gone: DataFrame) -> None:
        dealt = postings.withColumn("_bucket", self._bucket(F.col("term"))).repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        dealt.sortWithinPartitions("_bucket", "term", "id").write.partitionBy("_bucket").parquet(f"{self.path}/{name}/postings")
        ids.write.parquet(f"{self.path}/{name}/ids")
        gone.write.parquet(f"{self.path}/{name}/gone")
        system, at = self._fs(f"ready/{name}")
        system.mkdirs(at)  # now it counts

    def _next(self, kind: str) -> str:
        return f"{int(max(self.segments(), default='000000')[:6]) + 1:06d}-{kind}"

    def _all(self, table: str, schema: StructType) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}/{table}").withColumn("_segment", F.lit(n)) for n in self.segments()]
        out = parts[0] if parts else self.spark.createDataFrame([], schema).withColumn("_segment", F.lit(""))
        for p in parts[1:]:
            out = out.union(p)
        return out

    def add(self, rows: DataFrame) -> str:
        """Takes in rows(id, terms array<string>), new ones and changed ones; the name of their segment."""
        each = rows.select("id", F.explode("terms").alias("term")).where("term is not null")
        ids = rows.select("id").distinct()
        old = self._all("ids", self.ids_of).select("id").distinct()
        gone = ids.alias("a").join(old.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi")
        name = self._next("part")
        self._write(name, each.groupBy("term", "id").agg(F.count("*").alias("n")), ids, gone)
        if len(self.segments()) > self.most:
            self.merge()
        return name

    def live(self, buckets: list[int] | None = None) -> DataFrame:
        """(term, id, n), of some buckets or of all."""
        found = self._all("postings", self.postings_of)
        if buckets is not None:
            found = found.where(F.col("_bucket").isin(buckets))
        if len(self.segments()) < 2:
            return found.select("term", "id", "n")
        taken = self._all("gone", self.ids_of).groupBy("id").agg(F.max("_segment").alias("_from"))
        taken = F.broadcast(taken) if taken.limit(FEW + 1).count() <= FEW else taken
        both = found.alias("p").join(taken.alias("t"), F.col("p.id").eqNullSafe(F.col("t.id")), "left")
        return both.where("_from is null or _segment >= _from").select("term", "p.id", "n")

    def merge(self) -> str:
        """One segment of what is live. Older folders can go once no search reads them."""
        name = self._next("full")
        gone = self._all("ids", self.ids_of).select("id").distinct()
        self._write(name, self.live(), gone, gone.limit(0))
        return name

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df): how many rows have a term; of terms(term), or of all."""
        found = self.live() if terms is None else self._matched(terms.select("term").distinct())
        return found.groupBy("term").agg(F.count("*").alias("df"))

    def _matched(self, asked: DataFrame) -> DataFrame:
        """asked(term, ...) with the postings of its terms; the other terms' folders aren't read."""
        buckets = [r["_b"] for r in asked.select(self._bucket(F.col("term")).alias("_b")).distinct().collect()]  # as many as there are, at most
        asked = F.broadcast(asked) if asked.limit(FEW + 1).count() <= FEW else asked
        return self.live(buckets).join(asked, "term")

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, n_terms, counts) for queries(query_id, terms): rows with a term at least, and how often they have each; n_terms is the number of different terms asked for."""
        distinct = F.array_distinct(F.filter("terms", lambda t: t.isNotNull()))
        asked = queries.select("query_id", F.size(distinct).alias("n_terms"), F.explode(distinct).alias("term"))
        return self._matched(asked).groupBy("query_id", "n_terms", "id").agg(F.sort_array(F.collect_list("n")).alias("counts"))
