"""Validation, routing, merges and whole flows: what a form, a chat turn or an ingestion run goes through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import values as V
from ..operators import knowledge as K
from ..operators import merges as M
from ..sources import snapshots as S
from ..sources.shared import shared_dir
from .corpus import _FLAGS, _SAID, _any, _said
from .registry import AS_OF, as_of, query, table


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'name is required' END, CASE WHEN c_custkey % 7 = 0 THEN 'email is not valid' END, CASE WHEN c_custkey % 5 = 0 THEN 'phone is required' END], lambda e: e IS NOT NULL), '; ') AS errors,
      CASE WHEN c_custkey % 7 <> 0 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@shop.example' END AS email FROM customer"""
)
def validate_leads(spark: SparkSession, d: str) -> DataFrame:
    """All errors of a row at once; e-mails are trimmed and lower-cased."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 11 != 0, F.col("c_name")).alias("name"), F.when(k % 7 == 0, F.lit("no address")).otherwise(F.concat(F.lit(" C"), k.cast("string"), F.lit("@Shop.example "))).alias("email"), F.when(k % 5 != 0, F.lit("0300 1234567")).alias("phone"))
    mail = F.lower(F.trim("email"))
    good = mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    errors = F.filter(F.array(F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name is required"), F.when(~good, "email is not valid"), F.when(F.col("phone").isNull(), "phone is required")), lambda e: e.isNotNull())
    return rows.select("c_custkey", F.array_join(errors, "; ").alias("errors"), F.when(good, mail).alias("email"))


@query(
    """SELECT event_id, path FROM (SELECT event_id, unnest(list_filter([CASE WHEN value >= 20 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda p: p IS NOT NULL)) AS path FROM events)"""
)
def matching_paths(spark: SparkSession, d: str) -> DataFrame:
    """A row goes down every path that it matches."""
    paths = F.array(F.when(F.col("value") >= 20, "large"), F.when(F.col("event_type") == "error", "failed"), F.when(F.col("user_id") % 2 == 0, "even"))
    return table(spark, d, "events").select("event_id", F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("path"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'not_found' WHEN o_orderkey % 6 IN (1, 2, 4) THEN 'verified' ELSE 'verification_required' END AS outcome FROM orders"""
)
def identity_verification(spark: SparkSession, d: str) -> DataFrame:
    """An order is shown to who gives its customer's id, phone or full name; else a check is asked for."""
    k = F.col("o_orderkey")
    number = lambda key: F.lpad(key.cast("string"), 9, "0")
    asked = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 6 == 0, -1 - k).otherwise(k).alias("number"), F.when(k % 6 == 1, F.col("o_custkey")).alias("id"),
        F.when(k % 6 == 2, F.concat(F.lit("CUSTOMER#"), number(F.col("o_custkey")))).when(k % 6 == 3, F.lit("someone else")).alias("name"),
        # the right number in a local spelling, and a wrong one
        V.phone(F.when(k % 6 == 4, F.concat(F.lit("03"), number(F.col("o_custkey")))).when(k % 6 == 5, F.concat(F.lit("+923"), number(F.col("o_custkey") + 1)))).alias("phone"),
    )
    customers = table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("+923"), number(F.col("c_custkey"))).alias("c_phone"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    both = asked.join(known, "number", "left")
    same = (F.col("id") == F.col("c_custkey"), F.col("phone") == F.col("c_phone"), F.lower("name") == F.lower("c_name"))
    fits = F.coalesce(F.greatest(*[F.coalesce(x, F.lit(False)) for x in same]), F.lit(False))
    return both.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "not_found").when(fits, "verified").otherwise("verification_required").alias("outcome"))


@query(
    """WITH o AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT o_orderkey, n > 1 AS known, least(100, CASE WHEN o_totalprice >= 300000 THEN 45 WHEN o_totalprice >= 150000 THEN 38 WHEN o_totalprice >= 50000 THEN 22 ELSE 10 END + 18 + CASE WHEN n > 1 THEN 10 ELSE 0 END) AS score,
      CASE WHEN o_totalprice >= 150000 OR least(100, CASE WHEN o_totalprice >= 300000 THEN 45 WHEN o_totalprice >= 150000 THEN 38 WHEN o_totalprice >= 50000 THEN 22 ELSE 10 END + 18 + CASE WHEN n > 1 THEN 10 ELSE 0 END) >= 70 THEN 'pending' ELSE 'skipped' END AS outbox
    FROM o WHERE prev IS NULL OR o_orderdate > prev"""
)
def lead_capture(spark: SparkSession, d: str) -> DataFrame:
    """Enquiries of a day are one lead; each is scored with its history, and large ones are announced."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    leads = table(spark, d, "orders").withColumn("prev", F.lag("o_orderdate").over(w)).withColumn("n", F.row_number().over(w)).where("prev is null or o_orderdate > prev")
    yes = F.lit(True)
    score = R.lead_score(F.col("o_totalprice"), F.lit("considering"), F.lit(False), F.lit(False), F.col("n") > 1, yes)
    return leads.select("o_orderkey", (F.col("n") > 1).alias("known"), score.alias("score"), F.when(R.high_value(F.col("o_totalprice"), score, yes), "pending").otherwise("skipped").alias("outbox"))


@query(
    "SELECT conv_id, turn, CASE WHEN length(raw) > 4000 THEN 'too_long' WHEN human OR damaged OR angry OR refund THEN 'escalate' WHEN num THEN CASE WHEN contains(raw, 'UC-10452') OR contains(raw, 'uc 10457') THEN 'order' ELSE 'order_unknown' END "
    f"WHEN {_any('t', R.GREETING)} AND length(raw) < 40 THEN 'greeting' ELSE 'search' END AS route FROM {_FLAGS}"
)
def chat_turn_routing(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a message: a person, an order, a greeting, or a search in the documents."""
    orders = F.broadcast(spark.createDataFrame([("UC-10452",), ("UC-10457",)], "number string").withColumn("known", F.lit(True)))
    said = _said(spark, d).withColumn("number", R.order_number(F.col("said"))).join(orders, "number", "left")
    t, raw = F.lower(F.trim("said")), F.trim("said")
    route = (
        F.when(F.length(raw) > 4000, "too_long").when(R.escalation(F.col("said")).isNotNull(), "escalate").when(F.col("known"), "order").when(F.col("number").isNotNull(), "order_unknown")
        .when(T.contains_any(t, R.GREETING) & (F.length(raw) < 40), "greeting").otherwise("search")
    )
    return said.select("conv_id", "turn", route.alias("route"))


STAGES = (("signup", "send_welcome", "customer"), ("view", "assign_task", "manager"), ("click", "assign_task", "manager"), ("purchase", "send_invoice", "customer"), ("error", "alert", "support"))


@query("SELECT event_id, action, recipient FROM events JOIN (VALUES " + ", ".join(str(s) for s in STAGES) + ") AS r(stage, action, recipient) ON stage = event_type WHERE value > 0")
def stage_actions(spark: SparkSession, d: str) -> DataFrame:
    """What follows from a stage: a fixed table of rules, joined."""
    rules = F.broadcast(spark.createDataFrame(list(STAGES), "event_type string, action string, recipient string"))
    return table(spark, d, "events").where("value > 0").join(rules, "event_type").select("event_id", "action", "recipient")


@query("SELECT max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS next_number, greatest(coalesce(max(c_custkey), 0), 1000) AS resync FROM customer")
def next_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg((F.max(F.regexp_extract("c_name", r"([0-9]+)$", 1).try_cast("long")) + 1).alias("next_number"), F.greatest(F.coalesce(F.max("c_custkey"), F.lit(0)), F.lit(1000)).alias("resync"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Deleted' ELSE 'Active' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 'renamed' ELSE p_name END AS name FROM part WHERE p_partkey % 13 <> 0
    UNION ALL SELECT -p_partkey, 'New', p_name FROM part WHERE p_partkey BETWEEN 1 AND 20"""
)
def record_changes(spark: SparkSession, d: str) -> DataFrame:
    """Append, update by key (an empty value keeps the old one), soft and hard deletion in one statement each."""
    parts = table(spark, d, "part").select("p_partkey", F.lit("Active").alias("status"), F.col("p_name").alias("name"))
    k = F.col("p_partkey")
    changes = parts.select("p_partkey", F.when(k % 9 == 0, "Deleted").alias("status"), F.when(k % 4 == 0, "renamed").otherwise("").alias("name"))
    gone = parts.where(k % 13 == 0).select("p_partkey")
    new = parts.where(k.between(1, 20)).select((-k).alias("p_partkey"), F.lit("New").alias("status"), "name")
    return M.insert_missing(M.upsert(parts, changes, ["p_partkey"], ("name", "status")).join(gone, "p_partkey", "left_anti"), new, ["p_partkey"])


@query(
    """SELECT d.doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'failed' WHEN d.doc_id % 5 = 0 THEN 'created' WHEN d.doc_id % 3 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM documents d"""
)
def ingestion_run(spark: SparkSession, d: str) -> DataFrame:
    """One log row a document: too short, new, changed or skipped. Only what changed would be chunked."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    now = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), (F.length(F.trim("text")) < 20).alias("short"))
    store = now.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("older")).otherwise(F.col("hash")).alias("known"))
    both = now.join(store, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("short"), "failed").when(F.col("known").isNull(), "created").when(F.col("known") != F.col("hash"), "updated").otherwise("skipped").alias("action"))


_HALVES = "(SELECT (max(doc_id) + 1) // 2 AS half FROM documents)"


@query(
    f"""WITH a AS (SELECT source, left(text, 24) AS source_ref, doc_id AS arrived, sha256(text) AS hash, doc_id < half AS old FROM documents, {_HALVES} WHERE length(trim(coalesce(text, ''))) >= 20),
    n AS (SELECT source, source_ref, old, arg_max(hash, (arrived, hash)) AS hash FROM a GROUP BY 1, 2, 3)
    SELECT n.source, n.source_ref, CASE WHEN o.hash IS NULL THEN 'created' WHEN o.hash <> n.hash THEN 'updated' ELSE 'skipped' END AS action, CASE WHEN o.hash <> n.hash THEN 2 ELSE 1 END AS version
    FROM n LEFT JOIN n o ON o.old AND o.source IS NOT DISTINCT FROM n.source AND o.source_ref = n.source_ref WHERE NOT n.old"""
)
def ingestion_versions(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the documents comes to a store that has taken in the first: by source and opening words they are new, new versions, or known.

    Documents and their chunks change together, in two commits of a store of its own.
    """
    docs = table(spark, d, "documents").where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 20)
    rows = docs.select("source", F.left("text", F.lit(24)).alias("source_ref"), "text", F.col("doc_id").alias("arrived"))
    half = table(spark, d, "documents").agg(F.floor((F.max("doc_id") + 1) / 2)).first()[0] or 0
    store = S.Store(spark, f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}", S.KEYS, 16)
    S.replace_documents(store, rows.where(F.col("arrived") < half))
    return S.replace_documents(store, rows.where(F.col("arrived") >= half))


@query()
def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and embeddings of the documents that a run created or updated."""
    changed = ingestion_run(spark, d).where("action in ('created', 'updated')").select("doc_id")
    docs = table(spark, d, "documents").join(changed, "doc_id", "left_semi").withColumn("text", T.clean(F.col("text")))
    return K.chunk_documents(docs, dims=K.DIMS).select("doc_id", "chunk_index", "section", "token_estimate", "embedding")


@query(
    f"""SELECT c_custkey, o_orderkey, CASE WHEN idle > 90 THEN 'cold' WHEN idle > 30 THEN 'warm' ELSE 'hot' END AS heat FROM (
      SELECT o_custkey AS c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(o_orderdate))) / 86400000000.0) AS BIGINT) AS idle FROM orders GROUP BY 1)"""
)
def customer_heat(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer, and how long ago it was."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("at"))
    idle = V.days_since(F.col("at"), as_of())
    return last.select("c_custkey", "o_orderkey", F.when(idle > 90, "cold").when(idle > 30, "warm").otherwise("hot").alias("heat"))


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations), k AS (SELECT conv_id, count(DISTINCT role) AS roles FROM m GROUP BY 1)
    SELECT m.conv_id, m.turn, m.rn, k.roles, max(length(text)) OVER (PARTITION BY m.conv_id ORDER BY m.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS longest_so_far FROM m JOIN k ON k.conv_id = m.conv_id"""
)
def turn_positions(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the usual list: positions and running maxima of a conversation's turns."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("k"))
    roles = rows.groupBy("conv_id").agg(F.countDistinct("role").alias("roles"))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("longest_so_far", F.max("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(roles, "conv_id").select("conv_id", "turn", "rn", "roles", "longest_so_far")
