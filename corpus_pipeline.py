"""From raw documents to token ids: toxicity, near duplicates, personal data, mixture, pieces.

Each stage works on what the one before it kept. Stages but the last return the columns of
documents (doc_id, text, lang, source, n_chars); other columns are dropped at a stage's start,
so their names can't clash.

Nulls and edge cases: a null text is read as an empty one by every stage, and becomes one in
the stage pii; a row with a null doc_id is never a near copy and stays; a null source is a
source of its own; repeated rows are near copies of each other; rows that share a doc_id but
not their text are judged apart by near_dedup, and, with equal size, alike by mix; very long
texts are read whole by every stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, neardup, pieces, pii, toxicity
from tidewater.llm.common import discard, small, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the model's cut go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("not toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row of the smallest doc_id stays."""
    # numbered before it is read twice, so that the numbers hold
    docs = stash(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    judged = stash(neardup.near_duplicates(docs.select("doc_id", "text", "_row"), row="_row").where("_group is not null").select("doc_id", "_row", "_group"), "judged")
    first = judged.groupBy("_group").agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("_group", "first._row")
    gone = judged.join(small(stash(first.withColumnRenamed("_row", "_first"), "first")), "_group").where("_row <> _first").select("_row")
    return docs.join(small(stash(gone, "gone")), "_row", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars follows the text."""
    found = pii.extract(docs.select(*COLUMNS))
    return found.withColumn("text", pii.redact(F.col("text"), F.col("_spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; of one document a source, its first words besides."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    times = F.col("_copies") + (F.col("_part") > 0).cast("long")
    each = mixed.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    cut = F.col("_copy") > F.col("_copies")
    each = each.withColumn("text", F.when(cut, mixing.first_words(F.col("text"), F.col("_part"))).otherwise(F.col("text")))
    return each.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces)."""
    return pieces.encode(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
    ("encode", encode_pieces),
]

#: SQL can't express the learned and the tokenizing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline_{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
