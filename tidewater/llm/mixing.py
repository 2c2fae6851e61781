"""Mixing sources to target weights by weighted sampling (Efraimidis-Spirakis).

Each document gets an exponential key -ln(u) / quality, u from a hash of the seed and
doc_id. Within its source, documents come in the order of their keys; running sums of
their words fill the source's budget. Complete epochs take every document; what is left
of the budget takes the first documents of the order, and of the one in which it ends the
first words. All of it is DataFrame work.

Only narrow rows (no text) are shuffled. The cut, a point (key, doc_id, size) per source, is
found by narrowing: words are summed by source and BUCKETS equal steps of ln(key), prefix
sums find the step in which the budget ends, and its rows are summed by finer steps, until
few rows are left to sort. So no task gets more than BUCKETS sums or FEW rows of a source,
and a hot source is no hot task. A document is then judged by comparing its key with its
source's cut.

Nulls and edge cases: a null or empty text has size 0 and is taken as often as its key
says; a very long text is one document like others, and may be the one that is cut; a null
source is a source of its own and the last in order; a null doc_id has the key of an empty
id; rows with equal doc_id, size and key are alike and share the words that are left for
them evenly; keys that tie otherwise follow doc_id; an empty table gives an empty result;
other columns stay, but for those that bear the name of a column that is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, apart, discard, load, n_words, small, stash

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source's target exceeds so many times its own words.
MOST_EPOCHS = 3
#: Steps that a stretch of keys is cut into at a time (a power of two), and rows that are sorted in the end.
BUCKETS, FEW = 1 << 10, 2_000
#: ln(key) lies in (-SHIFT, SHIFT), and steps are of 2^-SCALE at the finest.
SHIFT, SCALE = 64, 50
#: Characters that prose seldom has.
SYMBOLS = "#$%&*!|<>{}[]=+_~^@\\/"
MADE = ("_size", "_source_size", "_target", "_copies", "_part", "_taken")


def quality(text: Column) -> Column:
    """Weight in [0.05, 1]: texts of symbols, and of repeated lines, get less than prose.

    A text with a symbol for every fourth character or more gets the least of the first
    factor; the second is the share of its different lines, half at least.
    """
    plain = 1.0 - 4.0 * (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n", -1)
    new = F.size(F.array_distinct(lines)).cast("double") / F.size(lines)
    return F.when(text.isNull(), 0.05).otherwise(F.greatest(F.lit(0.1), plain) * F.greatest(F.lit(0.5), new))


def keyed(docs: DataFrame, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """docs(doc_id, text, ...) and _size, _key: exponential keys scaled by the weight."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    scaled = -F.log(u) / (weight if weight is not None else quality(F.col("text")))
    return docs.withColumns({"_size": n_words(F.col("text")), "_key": scaled})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size): and its target, double.

    The shares follow the weights; sources whose share is above most times their words are
    held at that, and the excess goes to the rest by weight until none is above. Capped
    sources are those with the smallest size for their weight, so one running sum finds
    them. It orders the sources, one small row each.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    # coalesce(1) of one row a source: the order of sources is global by the contract
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ratio = F.col("source_size") * F.lit(float(most)) / F.col("_w")
    fill = Window.partitionBy(F.lit(0)).orderBy(ratio, F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    marked = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= most * F.col("source_size"))
    # the first source that isn't above its cap sets the level of all from there on
    got = marked.withColumn("_level", F.min(F.when(F.col("_free"), F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("_level").alias("l")))).over(all_rows))
    free = F.coalesce(F.col("_level.l") * F.col("_w") <= most * F.col("source_size"), F.lit(False))
    return got.select("source", "source_size", F.when(free, F.col("_level.l") * F.col("_w")).otherwise((most * F.col("source_size")).cast("double")).alias("target"))


def cuts(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Where each source's budget ends: (source, _cut, _left, _alike).

    rows(source, doc_id, _size, _key), stats(source, _budget), stashed. Rows before the
    struct _cut(key, has, doc_id, size) are taken whole; of the _alike rows at it, _left
    words. A source that is taken whole, or not at all, has no cut.
    """
    fine = F.floor((F.log("_key") + SHIFT) * F.lit(float(1 << SCALE))).cast("long")
    now = rows.select(F.col("source").alias("_s"), "doc_id", "_size", "_key", fine.alias("_fine"))
    # steps are numbers of _fine shifted right; of each source one is open, the first step holds all
    level = SCALE + SHIFT.bit_length()
    open_ = stats.where("_budget > 0").select("source", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_before"), "_budget")
    held = None
    while True:
        inside = now.join(small(open_), F.col("_s").eqNullSafe(F.col("source")) & (F.shiftright("_fine", level) == F.col("_at")))
        if level == 0 or (held is not None and (held.agg(F.max("_n")).first()[0] or 0) <= FEW):
            break
        level = max(0, level - (BUCKETS.bit_length() - 1))
        sums = inside.groupBy("source", "_before", "_budget", F.shiftright("_fine", level).alias("_at")).agg(F.sum("_size").alias("_words"), F.count("*").alias("_n"))
        upto = F.col("_before") + F.sum("_words").over(Window.partitionBy("source").orderBy("_at"))  # BUCKETS rows a source at most
        ends = sums.withColumn("_upto", upto).where("_upto - _words <= _budget and _upto > _budget")
        new = stash(ends.select("source", "_at", (F.col("_upto") - F.col("_words")).alias("_before"), "_budget", "_n"), "mix_open")
        if held is not None:
            discard(held)
        held, open_ = new, new.drop("_n")
    # rows that are alike are one row here
    alike = inside.groupBy("source", "_before", "_budget", "_key", F.col("doc_id").isNotNull().alias("_has"), "doc_id", "_size").agg(F.count("*").alias("_alike"))
    in_order = Window.partitionBy("source").orderBy("_key", "_has", "doc_id", "_size")
    words = F.col("_size") * F.col("_alike")
    upto = F.col("_before") + F.sum(words).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    at = alike.withColumn("_upto", upto).where((F.col("_upto") - words <= F.col("_budget")) & (F.col("_upto") > F.col("_budget")))
    left = F.round(F.col("_budget") - (F.col("_upto") - words)).cast("long")
    return stash(at.select("source", F.struct("_key", "_has", "doc_id", "_size").alias("_cut"), left.alias("_left"), "_alike"), "mix_cuts")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source of rows(doc_id, source, _size, _key), stashed: size, target, epochs and the cut."""
    # hot sources are summed before they are shuffled
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    stats = stash(targets(sizes, weights, most), "mix_targets")
    stats = stats.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    stats = stash(stats.withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix_stats")
    found = cuts(rows, stats).withColumnRenamed("source", "_s")
    all_ = small(stats).join(small(found), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return stash(all_, "mix_plan")


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """docs with _size, _source_size, _target, _copies, _part and _taken.

    The mix takes the document _copies times whole, and once its first _part words;
    _taken is their number together. weight is a column of (doc_id, text, source).
    """
    packed, fields = apart(docs, MADE, "doc_id", "text", "source")
    rows = stash(keyed(packed.drop("_row"), weight, seed).select("doc_id", "source", "_size", "_key"), "mix_rows")
    how = small(plan(rows, weights, most).withColumnsRenamed({"source": "_source", "source_size": "_source_size", "target": "_target"}))
    both = keyed(packed, weight, seed).join(how, F.col("source").eqNullSafe(F.col("_source")))
    point = F.struct("_key", F.col("doc_id").isNotNull().alias("_has"), "doc_id", "_size")
    before = F.coalesce(point < F.col("_cut"), F.lit(False))
    at = F.coalesce(point == F.col("_cut"), F.lit(False))
    copies = (F.col("_epochs") + before.cast("long")).alias("_copies")
    part = F.when(at, F.floor(F.col("_left") / F.col("_alike"))).otherwise(F.lit(0)).cast("long").alias("_part")
    got = both.select("_row", "_size", "_source_size", "_target", copies, part)
    return got.select(*fields, "_size", "_source_size", "_target", "_copies", "_part", (F.col("_size") * F.col("_copies") + F.col("_part")).alias("_taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, f"(?<={WORD[:-1]})(?=[\\x20\\x09-\\x0D])"), F.lit(1), n.cast("int")), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


SQL = r"""
WITH s AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    len(list_distinct(string_split(text, chr(10)))) AS new, len(string_split(text, chr(10))) AS lines FROM documents),
k AS (SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / CASE WHEN text IS NULL THEN 0.05::DOUBLE ELSE greatest(0.1::DOUBLE, plain) * greatest(0.5::DOUBLE, new::DOUBLE / lines) END AS key
  FROM (SELECT *, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '#$%&*!|<>{}[]=+_~^@\/', ''))) / greatest(length(text), 1) AS plain FROM s)),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM z),
l AS (SELECT *, source_size * 3.0::DOUBLE / w AS ratio,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
f AS (SELECT level FROM l WHERE level * w <= 3 * source_size ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM f) * w <= 3 * source_size THEN (SELECT level FROM f) * w ELSE (3 * source_size)::DOUBLE END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  size * epochs + CASE WHEN upto <= budget THEN size WHEN upto - size <= budget THEN CAST(round(budget - (upto - size)) AS BIGINT) ELSE 0 END AS taken FROM r
"""
