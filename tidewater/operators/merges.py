"""Upserts, merges, searches over products, and data-quality queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fill_blank: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: a value that isn't null wins over the old one; of fill_blank, '' counts as null.

    The new frame may hold a key once.
    """
    rest = [c for c in old.columns if c not in keys]
    put = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest])
    newer = {c: F.nullif(F.col(f"_{c}"), F.lit("")) if c in fill_blank else F.col(f"_{c}") for c in rest}
    return old.join(put, keys, "full").select(*keys, *[F.coalesce(newer[c], F.col(c)).alias(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def last_known(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key and column the last value that isn't null: the fold of many upserts in one aggregate."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def merge_maps(maps: Column) -> Column:
    """Shallow merge of maps in order; later keys win."""
    names = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    value = lambda k: F.element_at(F.filter(F.transform(maps, lambda m: m[k]), lambda v: v.isNotNull()), -1)
    return F.map_from_arrays(names, F.transform(names, value))


def staged(*stages: DataFrame) -> DataFrame:
    """Rows of the first stage in which a query finds something; stages have query_id and stage."""
    all_ = stages[0]
    for s in stages[1:]:
        all_ = all_.unionByName(s)
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return all_.withColumn("_first", first).where("stage = _first").drop("_first")


def violations(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(rule, violations): rows that break each rule; frames used more than once are read once a rule."""
    out = None
    for name, frame, broken in checks:
        one = frame.agg(F.count_if(F.coalesce(broken, F.lit(False))).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.union(one)
    return out


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def contained(parts: DataFrame, part: str, texts: DataFrame, text: str, group: int = 1_000_000) -> DataFrame:
    """The distinct values of the column part that are a substring of some text.

    Parts are dealt into groups of about `group` characters. An automaton over a group goes
    through each text once, whatever the number of parts, and holds no more of it than its
    place; texts are neither copied nor shuffled. Groups take their turns, so work is the
    texts' length for each group.
    """
    wanted = stash(parts.select(F.col(part).cast("string").alias("p")).where("p <> ''").distinct(), "parts")
    said = texts.select(F.col(text).cast("string").alias("t")).where("t <> ''")
    groups = -(-(wanted.agg(F.sum(F.length("p"))).first()[0] or 0) // group)
    found = [wanted.limit(0)]
    for g in range(groups):
        names = [r.p for r in wanted.where(F.pmod(F.xxhash64("p"), F.lit(groups)) == g).select("p").collect()]  # about `group` characters
        if names:
            sent = parts.sparkSession.sparkContext.broadcast(names)
            # few are found often, so each task tells each once
            found.append(stash(said.mapInArrow(_finder(sent), "p string").distinct(), "contained"))
            sent.destroy()
    return reduce(DataFrame.union, found).withColumnRenamed("p", part)


def _finder(sent):
    """What a task does with a group of parts: all of them that its texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        told: set[str] = set()
        for b in batches:
            for t in b.column("t"):
                new = {name for _, name in automaton.iter(t.as_py())} - told
                if new:
                    told |= new
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["p"])

    return run
