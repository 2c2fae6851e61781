"""Grouped forms: ordered lists, running numbers, last-k, folds over a key's history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def ordered(df: DataFrame, keys: list[str], sort: list[str], value: Column, name: str, *more: Column) -> DataFrame:
    """keys, more, and an array of the values in the given order: a key's whole list is one row, as the result demands."""
    held = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(sort)], value.alias("_v"))
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(held)).alias(name), *more)
    return got.withColumn(name, F.transform(name, lambda x: x["_v"]))


def running_number(df: DataFrame, keys: list[str], coarse: str, order: list[str]) -> DataFrame:
    """df and number: 1, 2, ... within keys, by coarse and then order.

    Rows are counted by (keys, coarse) and the counts prefix-summed, so that only rows with
    equal coarse are sorted in one task.
    """
    counts = df.groupBy(*keys, coarse).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select(*keys, coarse, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, coarse).orderBy(*order))
    return df.join(counts, [*keys, coarse]).withColumn("number", F.col("_before") + inside).drop("_before")


def last_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The last k rows of each key; rank 1 is the latest."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def window_limits(df: DataFrame, key: str, time: Column, width_micros: int, limit: int) -> DataFrame:
    """(key, accepted, rejected) of each key's rows: a window opens with the first time at or
    after the width since the last one opened, and its first rows up to the limit are accepted.

    Rows of equal key and time are counted first; then they stream by in order, and a task
    holds one key's window and counts, however many rows the key has. Rows without a time
    count nowhere.
    """
    counts = df.groupBy(F.col(key), F.unix_micros(time).alias("_t")).agg(F.count("*").alias("_n"))
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("accepted", LongType()), StructField("rejected", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, at, held, accepted, rejected = None, False, None, 0, 0, 0
        for b in batches:
            done = []
            for k, t, n in zip(*(b.column(c).to_pylist() for c in (key, "_t", "_n")), strict=True):
                if not seen or k != now:
                    if seen:
                        done.append((now, accepted, rejected))
                    now, seen, at, held, accepted, rejected = k, True, None, 0, 0, 0
                if t is None:
                    continue
                if at is None or t - at >= width_micros:
                    at, held = t, 0
                good = max(0, min(n, limit - held))
                held, accepted, rejected = held + n, accepted + good, rejected + n - good
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.schema.field(key).type), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], [key, "accepted", "rejected"])
            kind = b.schema.field(key).type
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([accepted], pa.int64()), pa.array([rejected], pa.int64())], [key, "accepted", "rejected"])

    return counts.repartition(key).sortWithinPartitions(key, "_t").mapInArrow(run, schema)
