"""Where queries and the SQL they are held against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The moments as of which the tables are judged; now() never enters a query.
AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    """Exact money: sums of it don't depend on their order."""
    return c.cast("decimal(18,2)")


def moment(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def as_of(at: str = AS_OF) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from one moment to the other."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
