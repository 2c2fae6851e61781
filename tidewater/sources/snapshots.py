"""Tables that change together: snapshots behind one manifest.

A store is a folder. Its tables are dealt into buckets by a hash of their keys, and a bucket's
rows lie in a folder of their own. A commit writes new folders for the buckets that it changes,
of all its tables, and then a manifest that names the folders of every bucket. The manifest
becomes current by one rename that must not meet an existing file: readers see all of a commit
or nothing of it, a writer that dies before leaves the last version as it was, and of two
writers that started from one version the second fails.

Cost follows the change: buckets that no arrival falls into are not read or written.

Nulls and edge cases: null keys share a bucket and are keys like others; of arrivals with equal
keys the latest counts, of equally late ones the one with the greatest hash; a null text is an
empty one; an empty store has version 0 and no tables; a commit without changes makes none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.knowledge import chunk_documents

BUCKETS = 64


class Conflict(Exception):
    """Another writer has committed since the version that a commit is based on."""


class Store:
    """A folder of tables; all buckets are by hash of `keys`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The current version; 0 if nothing has been committed."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None if the store has no such table."""
        held = self.manifest(version)["tables"].get(table)
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{p}" for b, p in held["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes frames into a new folder, a folder a bucket; nobody sees them before commit()."""
        to = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{to}/{name}")
        return {name: f"{to}/{name}" for name in tables}

    def commit(self, tables: dict[str, DataFrame], touched: list[int], based_on: int) -> int:
        """Makes frames, the whole new content of the touched buckets, current; returns the version."""
        return self.publish(self.write(tables), {n: df.schema for n, df in tables.items()}, touched, based_on)

    def publish(self, written: dict[str, str], schemas: dict[str, StructType], touched: list[int], based_on: int) -> int:
        """The manifest of what has been written, on top of the version `based_on`."""
        new = self.manifest(based_on)
        new["version"] = based_on + 1
        for name, folder in written.items():
            table = new["tables"].setdefault(name, {"buckets": {}})
            table["schema"] = json.loads(schemas[name].json())
            there = {f.getPath().getName().removeprefix("_bucket=") for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()}
            for b in map(str, touched):
                if b in there:
                    table["buckets"][b] = f"{folder}/_bucket={b}"
                else:
                    table["buckets"].pop(b, None)
        draft, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{based_on + 1:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        # a rename that fails if the version is there already
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kind = self.spark.sparkContext._gateway.new_array(rename, 1)
        kind[0] = rename.NONE
        try:
            context.rename(draft, final, kind)
        except Exception as e:
            self._fs.delete(draft, False)
            for folder in written.values():
                self._fs.delete(self._at(folder), True)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {based_on + 1} is there already") from None
            raise
        return based_on + 1

    def sweep(self, keep: int = 2) -> int:
        """Deletes data folders that none of the last `keep` versions names; how many. No writer may be at work."""
        last = self.version()
        named = {p.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        gone = 0
        for v in range(1, max(0, last - keep) + 1):
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        for f in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone


#: Documents are known by where they come from.
KEYS = ["source", "source_ref"]
ARRIVAL = "source string, source_ref string, text string, arrived long"


def replace_documents(store: Store, arrivals: DataFrame) -> DataFrame:
    """Takes in arrivals (ARRIVAL); (source, source_ref, action, version) of each, action created, updated or skipped.

    The result is read from a folder that stays until sweep().

    An arrival whose content is that of the active version is skipped. Otherwise the active
    version becomes superseded, its chunks go, and the new one and its chunks come, all in one
    commit. Tables: documents(source, source_ref, hash, n_chars, arrived, version, status) and
    chunks(source, source_ref, version, chunk_index, section, chunk_text).
    """
    base = store.version()
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    newest = arrivals.withColumn("hash", digest).groupBy(*KEYS).agg(F.max(F.struct("arrived", "hash", "text")).alias("_a")).select(*KEYS, "_a.*").withColumn("_b", store.bucket())
    touched = [r["_b"] for r in newest.select("_b").distinct().collect()]  # as many as there are buckets, at most
    made = store.spark.createDataFrame([], f"{', '.join(f'{k} string' for k in KEYS)}, hash string, n_chars long, arrived long, version long, status string")
    docs = store.read("documents", touched, base)
    docs = made if docs is None else docs
    chunks = store.read("chunks", touched, base)
    same = lambda a, b: F.col(f"{a}.{KEYS[0]}").eqNullSafe(F.col(f"{b}.{KEYS[0]}")) & F.col(f"{a}.{KEYS[1]}").eqNullSafe(F.col(f"{b}.{KEYS[1]}"))
    active = docs.where("status = 'active'").select(*KEYS, F.col("hash").alias("_was"), F.col("version").alias("_version"))
    judged = newest.alias("n").join(active.alias("a"), same("n", "a"), "left").select("n.*", "_was", "_version")
    action = F.when(F.col("_version").isNull(), "created").when(F.col("_was") != F.col("hash"), "updated").otherwise("skipped")
    judged = judged.withColumn("action", action).withColumn("version", F.when(F.col("action") == "skipped", F.col("_version")).otherwise(F.coalesce("_version", F.lit(0)) + 1).cast("long"))
    # written once: what is decided is read by both tables and by the caller
    judged = judged.select(*KEYS, "text", "hash", "arrived", "action", "version")
    decided = store.write({"decided": judged})["decided"]
    judged = store.spark.read.schema(judged.schema).parquet(f"{store.path}/{decided}")
    new = judged.where("action <> 'skipped'")
    result = judged.select(*KEYS, "action", "version")
    if new.limit(1).count():
        old = docs.alias("d").join(new.select(*KEYS, F.lit(True).alias("_gone")).alias("g"), same("d", "g"), "left")
        status = F.when(F.col("_gone") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
        kept = old.select(*[f"d.{c}" for c in docs.columns if c != "status"], status.alias("status"))
        added = new.select(*KEYS, "hash", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "arrived", "version", F.lit("active").alias("status"))
        pieces = chunk_documents(new.select(F.monotonically_increasing_id().alias("doc_id"), "text", *KEYS, "version"), keep=[*KEYS, "version"])
        pieces = pieces.select(*KEYS, "version", "chunk_index", "section", "chunk_text")
        if chunks is not None:
            pieces = chunks.alias("c").join(new.select(*KEYS).alias("n"), same("c", "n"), "left_anti").unionByName(pieces)
        store.commit({"documents": kept.unionByName(added), "chunks": pieces}, touched, base)
    return result
