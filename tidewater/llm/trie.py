"""Prefix trie of conversations: what conversations share from their beginning on.

Each turn is digested where it lies, and each conversation's prefixes by a chain:
digest(d) = SHA-256(digest(d - 1), digest of turn d), so equal digests are equal sequences of
(role, text). A node is a (depth, digest); its row is the group of all prefixes that have it.

Sums over subtrees: a node is told to all its ancestors, which are the shorter prefixes of the
smallest conversation through it. That conversation is smallest of a run of nodes at the end
of its chain, so the run is summed up first and told as one row to each of the prefixes above
it: never more rows than there are prefixes, however long conversations are.

Only digests, lengths and ids are shuffled, no texts. Groups are summed partially before they
are shuffled, so common prefixes and the root are no hot spots. A parent with more than a
thousandth of all nodes below it is looked up by broadcast, of which there are at most 1,000.
The members that end in a node are packed into blocks of bounded size, which one task then
streams through SHA-256 (a hash is sequential by nature, and holds 32 bytes of state). So is a
chain: one task streams over a conversation, some 60 bytes a turn.

Nulls and edge cases: null turns come first; turns with equal number are taken in the order of
their digests; a null role or text is an empty one; repeated rows are turns each; rows with a
null conv_id belong to no conversation; a conversation without turns is a member of the root
alone; very long texts are digested whole; an empty table has no node, not even the root. The
result has the named columns only, whatever others the table has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, load, small, stash

#: Conversations of a hundred begin with turns of their first; how many, the id's CRC tells.
FAMILY, MOST_SHARED = 100, 5
#: Ids that a block of members has at most.
BLOCK = 4_096
#: A parent of more than one in so many nodes is a hub.
HUB_SHARE = 1_000
ROOT = bytes(32)
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """binary: SHA-256 of a turn, by the lengths of role and text, so that no two turns look the same."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, _digest, _chars), a row for each turn of a conversation; texts are left behind here."""
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(F.col("role"), F.col("text")).alias("_digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"))


def family(rows: DataFrame) -> DataFrame:
    """(conv_id, _skip, _head): how many of its own turns each conversation leaves out, and what it begins with instead.

    _head is an array of (_digest, _chars), of up to MOST_SHARED turns of conversation conv_id - conv_id % 100.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_digest")
    # the limit is applied before the shuffle, too
    first = rows.where(F.col("conv_id") % FAMILY == 0).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= MOST_SHARED)
    heads = first.groupBy(F.col("conv_id").alias("_base")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_digest", "_chars"))), lambda x: F.struct(x["_digest"].alias("_digest"), x["_chars"].alias("_chars"))).alias("_all"))
    convs = rows.select("conv_id").distinct().select("conv_id", base.alias("_base"), skip.cast("int").alias("_skip"))
    held = F.slice(F.coalesce("_all", F.array().cast("array<struct<_digest:binary,_chars:bigint>>")), F.lit(1), F.col("_skip"))
    return convs.join(heads, "_base", "left").select("conv_id", "_skip", held.alias("_head"))


PREFIXES = "conv_id long, depth long, digest binary, parent binary, chars long, ends boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefixes of each conversation, from rows in its order; the first row of each has _skip and _head."""
    names = [f.split()[0] for f in PREFIXES.split(", ")]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    held: list | None = None  # the last prefix, of which it isn't known yet if it is the whole
    skip, out = 0, []

    def grow(digest: bytes, chars: int) -> None:
        nonlocal held
        out.append(held)
        held = [held[0], held[1] + 1, hashlib.sha256(held[2] + digest).digest(), held[2], chars, False]

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for b in batches:
        for conv, leave, head, digest, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "_skip", "_head", "_digest", "_chars")), strict=True):
            if leave is not None:
                if held:
                    out.append([*held[:-1], True])
                held, skip = [conv, 0, ROOT, None, 0, False], leave
                for x in head:
                    grow(x["_digest"], x["_chars"])
            elif skip:
                skip -= 1
            else:
                grow(digest, chars)
        yield flushed()
    if held:
        out.append([*held[:-1], True])
        yield flushed()


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, ends): every prefix of every rebuilt conversation; ends marks the whole ones."""
    rows = turns(conversations)
    none = lambda kind: F.lit(None).cast(kind)
    first = family(rows).select("conv_id", "_skip", "_head", none("bigint").alias("turn"), none("binary").alias("_digest"), none("bigint").alias("_chars"))
    rest = rows.select("conv_id", none("int").alias("_skip"), none("array<struct<_digest:binary,_chars:bigint>>").alias("_head"), "turn", "_digest", "_chars")
    dealt = first.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", F.col("_skip").isNull(), F.col("turn").asc_nulls_first(), "_digest")
    return dealt.mapInArrow(_chain, PREFIXES)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (digest, first, ids) of up to BLOCK ids, joined by commas, from rows ordered by digest and conv_id."""
    digest, ids = None, []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["digest", "first", "ids"])

    for b in batches:
        for d, i in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (d != digest or len(ids) == BLOCK):
                yield block()
                ids = []
            digest = d
            ids.append(i)
    if ids:
        yield block()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, sha256) from blocks ordered by digest and first; one block is held at a time."""
    digest, state = None, None
    for b in batches:
        out = []
        for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if d == digest:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((digest, state.hexdigest()))
            digest, state = d, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["digest", "sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([state.hexdigest()])], ["digest", "sha256"])


def ends(found: DataFrame) -> DataFrame:
    """(digest, sha256) of the ids, in order, of the conversations that end in a node; found: prefixes(), stashed."""
    whole = found.where("ends").select("digest", "conv_id")
    blocks = whole.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pack, "digest binary, first long, ids string")
    return blocks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hash, "digest binary, sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = stash(prefixes(conversations), "trie_prefixes")
    key = ["depth", "digest"]
    nodes = found.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"))
    nodes = stash(nodes, "trie_groups")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    value = ((F.col("n_convs") - 1) * F.col("chars")).alias("_value")
    counted = nodes.join(children, key, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), value)
    # sums of each run from its end up; the run's last node is a leaf or has other conversations below it
    upward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    leaf = (F.col("n_children") == 0).cast("long")
    counted = counted.withColumns({"_saved": F.sum("_value").over(upward), "_leaves": F.sum(leaf).over(upward)})
    counted = stash(counted, "trie_nodes")
    discard(nodes)
    runs = counted.groupBy("conv_id").agg(F.min("depth").alias("_top"), F.max("_saved").alias("_saved"), F.max("_leaves").alias("_leaves"))
    # each run is told to all ancestors of its top, which are shorter prefixes of its conversation
    told = found.select("conv_id", *key).join(runs.where("_top > 0"), "conv_id").where(F.col("depth") < F.col("_top"))
    told = told.groupBy(*key).agg(F.sum("_saved").alias("_more_saved"), F.sum("_leaves").alias("_more_leaves"))
    # parents of many are few, and are looked up apart
    n = counted.count()
    hub = F.col("n_children") * HUB_SHARE > n
    up = counted.where("n_children > 0").select(F.col("digest").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), hub.alias("_hub"))
    hubs = stash(up.where("_hub").drop("_hub"), "trie_hubs")
    below = small(hubs)
    root = counted.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    of_hubs = counted.join(below, ["parent", "depth"])
    rest = counted.where("parent is not null").join(F.broadcast(hubs.select("parent", "depth")), ["parent", "depth"], "left_anti").join(up.where("not _hub").drop("_hub"), ["parent", "depth"])
    whole = root.unionByName(of_hubs).unionByName(rest)
    got = whole.join(told, key, "left").join(ends(found), "digest", "left")
    return got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("_leaves") + F.coalesce("_more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("_saved") + F.coalesce("_more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Sequences are compared as lists here, and every node is paired with its ancestors.
SQL = """
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY k) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda s, d: list_reduce([xor(s, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM l),
w AS (SELECT h.c, list_concat(coalesce(b.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
p AS (SELECT c, d, xs[1:d] AS path, d = len(xs) AS whole FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM w)),
n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE whole) AS ends FROM p GROUP BY d, path),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(n.path[d].t) END AS saved FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT a.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT path[1:unnest(range(d + 1))] AS path, n_children, saved FROM v) a GROUP BY a.path)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN n q ON v.d > 0 AND q.path = v.path[1:v.d - 1]
"""
