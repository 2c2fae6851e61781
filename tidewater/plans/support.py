"""Tickets, conversations, outbox and the daily operations sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import AS_OF, EVENTS_AS_OF, as_of, cents, days_between, moment, query, table


def _priority() -> Column:
    return F.when(F.col("value") >= 40, "urgent").when(F.col("value") >= 25, "high").when(F.col("value") >= 10, "medium").otherwise("low")


@query(
    """SELECT event_id, c_name, last_order, CASE WHEN value >= 40 THEN 'urgent' WHEN value >= 25 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS priority
    FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON o_custkey = user_id
    WHERE event_type = 'error' ORDER BY CASE WHEN value >= 40 THEN 0 WHEN value >= 25 THEN 1 WHEN value >= 10 THEN 2 ELSE 3 END, ts DESC, event_id LIMIT 300"""
)
def support_queue(spark: SparkSession, d: str) -> DataFrame:
    """Open tickets by rank of priority, newest first, with optional customer and order."""
    tickets = table(spark, d, "events").where("event_type = 'error'").withColumn("priority", _priority())
    rank = F.when(F.col("priority") == "urgent", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    # the first 300 are found before anything is joined to them
    first = tickets.orderBy(rank, F.desc("ts"), "event_id").limit(300)
    return _with_customer(spark, d, first)


def _with_customer(spark: SparkSession, d: str, tickets: DataFrame) -> DataFrame:
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    both = tickets.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey"), "left").join(last, F.col("user_id") == F.col("o_custkey"), "left")
    return both.select("event_id", "c_name", "last_order", "priority")


@query(
    """SELECT event_id, c_name, last_order, CASE WHEN value >= 40 THEN 'urgent' WHEN value >= 25 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS priority
    FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON o_custkey = user_id
    WHERE event_type = 'error'"""
)
def support_queue_view(spark: SparkSession, d: str) -> DataFrame:
    """Every ticket with optional customer and order; support_queue is its ranked head."""
    return _with_customer(spark, d, table(spark, d, "events").where("event_type = 'error'").withColumn("priority", _priority()))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn, role, text) AS turns FROM conversations GROUP BY 1")
def conversation_transcript(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return A.ordered(rows, ["conv_id"], ["turn", "role", "text"], F.concat("role", F.lit(":"), F.length("text").cast("string")), "turns", F.count("*").alias("n_turns")).select("conv_id", "n_turns", F.array_join("turns", "|").alias("turns"))


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each conversation."""
    rows = table(spark, d, "conversations")
    return A.last_k(rows, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 3).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(
    """SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles, count(*) AS n FROM (
      SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 6) GROUP BY 1"""
)
def history_context(spark: SparkSession, d: str) -> DataFrame:
    """The last six turns of user and assistant; other roles go before the ranks are given."""
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    last = A.last_k(rows, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 6)
    return A.ordered(last, ["conv_id"], ["turn", "role", "text"], F.col("role"), "roles", F.count("*").alias("n")).select("conv_id", F.array_join("roles", ",").alias("roles"), "n")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def turns_by_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type AS destination, CASE WHEN value >= 40 THEN 'failed' WHEN value >= 20 THEN 'pending' ELSE 'delivered' END AS status, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1, 2")
def deliveries_by_destination_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("value") >= 40, "failed").when(F.col("value") >= 20, "pending").otherwise("delivered")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("destination"), status.alias("status")).agg(F.count("*").alias("n")).orderBy("destination", "status")


@query(
    """SELECT 'orders' AS metric, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'turns', role, count(*) FROM conversations GROUP BY 2
    UNION ALL SELECT 'customers', c_mktsegment, count(*) FROM customer GROUP BY 2
    UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2
    UNION ALL SELECT 'tickets_of_last_100', CASE WHEN value >= 25 THEN 'high' ELSE 'low' END, count(*) FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100) GROUP BY 2
    UNION ALL SELECT 'corpus', 'documents', (SELECT count(*) FROM documents)"""
)
def admin_overview(spark: SparkSession, d: str) -> DataFrame:
    """Seven rollups as rows (metric, key, value); tickets are those of the newest hundred."""

    def rollup(metric: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")

    newest = table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(100).withColumn("level", F.when(F.col("value") >= 25, "high").otherwise("low"))
    parts = [
        rollup("orders", table(spark, d, "orders"), "o_orderstatus"), rollup("events", table(spark, d, "events"), "event_type"), rollup("turns", table(spark, d, "conversations"), "role"),
        rollup("customers", table(spark, d, "customer"), "c_mktsegment"), rollup("documents", table(spark, d, "documents"), "lang"), rollup("tickets_of_last_100", newest, "level"),
        table(spark, d, "documents").agg(F.count("*").alias("value")).select(F.lit("corpus").alias("metric"), F.lit("documents").alias("key"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'click') AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 < 5 ORDER BY ts, event_id LIMIT 250")
def outbox_due(spark: SparkSession, d: str) -> DataFrame:
    """Undelivered rows with fewer than five attempts, first in first out."""
    attempts = F.get_json_object("props", "$.k").try_cast("int") % 7
    return table(spark, d, "events").where(F.col("event_type").isin("error", "click") & (attempts < 5)).orderBy("ts", "event_id").limit(250).select("event_id", "event_type", "user_id")


@query(
    """SELECT event_id, a + 1 AS attempts, s AS status, CASE WHEN s IN ('delivered', 'dry_run') THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS delivered_at,
      CASE WHEN event_type = 'signup' THEN 'not a notifiable event' END AS skipped_because
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS a, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'dry_run' WHEN event_type = 'signup' THEN 'skipped' ELSE 'delivered' END AS s FROM events)"""
)
def outbox_mark(spark: SparkSession, d: str) -> DataFrame:
    """Attempts count up; a time only for what was delivered; what isn't sent says why."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "dry_run").when(F.col("event_type") == "signup", "skipped").otherwise("delivered")
    rows = table(spark, d, "events").withColumn("status", status)
    return rows.select("event_id", (F.get_json_object("props", "$.k").try_cast("int") % 7 + 1).alias("attempts"), "status", F.when(F.col("status").isin("delivered", "dry_run"), moment(F.col("ts"))).alias("delivered_at"), F.when(F.col("status") == "skipped", "not a notifiable event").alias("skipped_because"))


@query(
    f"""SELECT o_orderkey, c_name, o_totalprice, idle AS days_idle, o_totalprice >= 250000 AS high_value FROM (
      SELECT *, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS idle FROM orders WHERE o_orderstatus <> 'F')
    JOIN customer ON o_custkey = c_custkey WHERE idle >= 5"""
)
def stale_deals(spark: SparkSession, d: str) -> DataFrame:
    """Open deals without activity for five days or more; the large ones are marked."""
    open_ = table(spark, d, "orders").where("o_orderstatus <> 'F'").withColumn("days_idle", days_between(F.col("o_orderdate"), as_of()))
    return open_.where("days_idle >= 5").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice", "days_idle", (F.col("o_totalprice") >= 250000).alias("high_value"))


@query(f"SELECT count(*) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS at_risk FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 250000 AND o_orderdate <= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY")
def high_value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus <> 'F' and o_totalprice >= 250000").where(F.col("o_orderdate") <= as_of() - F.expr("INTERVAL 5 DAYS"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(cents(F.col("o_totalprice"))), F.lit(0)).cast("double").alias("at_risk"))


@query("SELECT c_mktsegment AS owner, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS pipeline FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pipeline_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("owner")).agg(F.sum(F.when(F.col("o_orderstatus") != "F", cents(F.col("o_totalprice"))).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("pipeline"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks per owner: open and overdue (a whole day past the deadline)."""
    late = -F.ceil((F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(as_of().cast("timestamp"))) / F.lit(86_400_000_000))
    rows = table(spark, d, "lineitem").where("l_linestatus = 'O'").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.groupBy(F.coalesce(F.nullif(F.trim("s_name"), F.lit("")), F.lit("unassigned")).alias("owner")).agg(F.count("*").alias("open_tasks"), F.count_if(late >= 1).alias("overdue"))


_TASKS = f"""SELECT coalesce(nullif(trim(s_name), ''), 'unassigned') AS owner, count(*) AS open_tasks,
    count(*) FILTER (-ceil((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000.0) >= 1) AS overdue
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O' GROUP BY 1"""


@query(_TASKS)
def overdue_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d)


@query(f"SELECT owner, open_tasks, overdue FROM ({_TASKS}) WHERE open_tasks >= 5 ORDER BY overdue DESC, owner")
def overloaded_owners(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).where("open_tasks >= 5").orderBy(F.desc("overdue"), "owner")


@query(f"SELECT arg_min(owner, (open_tasks, owner)) AS owner, min(open_tasks) AS open_tasks FROM ({_TASKS})")
def lightest_owner(spark: SparkSession, d: str) -> DataFrame:
    """The owner with the fewest open tasks among those with one."""
    return _tasks(spark, d).agg(F.min_by("owner", F.struct("open_tasks", "owner")).alias("owner"), F.min("open_tasks").alias("open_tasks"))


@query(
    f"""SELECT event_id, user_id, days * 24 AS floor_days_hours, days * 24 > 24 AS breach FROM (
      SELECT *, CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events WHERE event_type = 'error' AND value >= 20)"""
)
def critical_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Hours are whole days, so a breach of 24 hours shows from the second day on."""
    rows = table(spark, d, "events").where("event_type = 'error' and value >= 20").withColumn("days", days_between(F.col("ts"), as_of(EVENTS_AS_OF)))
    return rows.select("event_id", "user_id", (F.col("days") * 24).alias("floor_days_hours"), (F.col("days") * 24 > 24).alias("breach"))


@query(
    f"""SELECT o_custkey, o_orderkey, o_totalprice, t.event_id AS ticket FROM orders JOIN (
      SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1) t ON user_id = o_custkey
    WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY"""
)
def compound_risk(spark: SparkSession, d: str) -> DataFrame:
    """A stale deal and an open ticket of one customer; of several tickets the last counts."""
    tickets = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("ticket"))
    deals = table(spark, d, "orders").where("o_orderstatus <> 'F'").where(F.col("o_orderdate") <= as_of() - F.expr("INTERVAL 5 DAYS"))
    return deals.join(tickets, F.col("o_custkey") == F.col("user_id")).select("o_custkey", "o_orderkey", "o_totalprice", "ticket")


@query(f"SELECT event_id, days FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events WHERE event_type IN ('view', 'click') AND ts IS NOT NULL) WHERE days > 3")
def stalled_cards(spark: SparkSession, d: str) -> DataFrame:
    """More than three days in a stage."""
    rows = table(spark, d, "events").where("event_type in ('view', 'click') and ts is not null")
    return rows.select("event_id", days_between(F.col("ts"), as_of(EVENTS_AS_OF)).alias("days")).where("days > 3")


@query(f"SELECT user_id, days FROM (SELECT user_id, CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 86400000000.0) AS BIGINT) AS days FROM events WHERE event_type <> 'purchase' GROUP BY 1) WHERE days >= 1 ORDER BY days DESC, user_id")
def stale_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Days since the last update, the threshold included."""
    rows = table(spark, d, "events").where("event_type <> 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return rows.select("user_id", days_between(F.col("ts"), as_of(EVENTS_AS_OF)).alias("days")).where("days >= 1").orderBy(F.desc("days"), "user_id")


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    n AS (SELECT user_id, event_type, count(*) AS n FROM r WHERE rn <= 5 GROUP BY 1, 2),
    h AS (SELECT user_id, min(event_type) AS t FROM r WHERE rn <= 3 GROUP BY 1 HAVING count(DISTINCT event_type) = 1 AND count(*) = 3)
    SELECT n.user_id, n.event_type, n.n, h.t IS NOT NULL AS in_a_row FROM n LEFT JOIN h ON h.user_id = n.user_id AND h.t = n.event_type WHERE n.n >= 3 OR h.t IS NOT NULL"""
)
def content_gap_overuse(spark: SparkSession, d: str) -> DataFrame:
    """Types that fill three of the last five, or the last three in a row."""
    last = A.last_k(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    n = last.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("rank") <= 3) == 3).alias("in_a_row"))
    return n.where("n >= 3 or in_a_row").select("user_id", "event_type", "n", "in_a_row")


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    o AS (SELECT user_id, event_type FROM r WHERE rn <= 5 GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT u.user_id, string_agg(t.event_type, ',' ORDER BY t.event_type) AS allowed FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type) t
    ANTI JOIN o ON o.user_id = u.user_id AND o.event_type = t.event_type GROUP BY 1"""
)
def allowed_types(spark: SparkSession, d: str) -> DataFrame:
    """All types but those a user has had too often, in the order in which types are declared."""
    last = A.last_k(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    n = last.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    used = n.groupBy("user_id").agg(F.collect_set(F.when(F.col("n") >= 3, F.col("event_type"))).alias("used"))
    return used.select("user_id", F.array_join(F.array_except(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), "used"), ",").alias("allowed"))


@query("SELECT DISTINCT p_name AS topic FROM part ANTI JOIN (SELECT DISTINCT lower(p_name) AS covered FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_discount = 0 AND l_shipdate < TIMESTAMP '1996-01-01') ON lower(p_name) = covered")
def uncovered_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics that nothing covers, without regard to case."""
    covered = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50 and l_discount = 0 and l_shipdate < timestamp_ntz'1996-01-01'").select("l_partkey").distinct().join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.lower("p_name").alias("covered")).distinct()
    return table(spark, d, "part").select(F.col("p_name").alias("topic")).distinct().join(covered, F.lower("topic") == F.col("covered"), "left_anti")


@query(
    """SELECT e.event_id, CASE WHEN f.first_id IS NOT NULL AND f.first_id < e.event_id THEN 'append' ELSE 'create' END AS decision, CASE WHEN f.first_id < e.event_id THEN f.first_id END AS ticket
    FROM events e LEFT JOIN (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS category, min(event_id) AS first_id FROM events WHERE event_type = 'error' AND value >= 20 GROUP BY 1, 2) f
      ON f.user_id = e.user_id AND f.category = CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 3 WHERE e.event_type = 'error'"""
)
def duplicate_ticket_decision(spark: SparkSession, d: str) -> DataFrame:
    """A new ticket, or a note on the customer's first open one of the same category."""
    tickets = table(spark, d, "events").where("event_type = 'error'").withColumn("category", F.get_json_object("props", "$.k").try_cast("int") % 3)
    first = tickets.where("value >= 20").groupBy("user_id", "category").agg(F.min("event_id").alias("first_id"))
    both = tickets.join(first, ["user_id", "category"], "left")
    dup = F.coalesce(F.col("first_id") < F.col("event_id"), F.lit(False))
    return both.select("event_id", F.when(dup, "append").otherwise("create").alias("decision"), F.when(dup, F.col("first_id")).alias("ticket"))


@query(
    """SELECT e.event_id, CASE WHEN hour(e.ts) NOT BETWEEN 9 AND 18 OR isodow(e.ts) = 7 THEN 'invalid' WHEN t.slot IS NOT NULL THEN 'taken' ELSE 'free' END AS availability
    FROM events e LEFT JOIN (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') || '#' || CAST(user_id % 5 AS VARCHAR) AS slot FROM events WHERE event_type = 'purchase') t
      ON t.slot = strftime(e.ts, '%Y-%m-%d %H') || '#' || CAST(e.user_id % 5 AS VARCHAR) WHERE e.event_type = 'signup'"""
)
def booking_availability(spark: SparkSession, d: str) -> DataFrame:
    """A slot is doctor, date and hour; Monday to Saturday, nine to seven."""
    slot = F.concat(F.date_format("ts", "yyyy-MM-dd HH"), F.lit("#"), (F.col("user_id") % 5).cast("string"))
    events = table(spark, d, "events").withColumn("slot", slot)
    taken = events.where("event_type = 'purchase'").select("slot").distinct().withColumn("taken", F.lit(True))
    asked = events.where("event_type = 'signup'").join(taken, "slot", "left")
    valid = F.hour("ts").between(9, 18) & (F.dayofweek("ts") != 1)
    return asked.select("event_id", F.when(~valid, "invalid").when(F.col("taken"), "taken").otherwise("free").alias("availability"))


@query(
    f"""SELECT CASE WHEN breaches > 0 THEN CAST(breaches AS VARCHAR) || ' critical tickets past their time' WHEN stale > 0 THEN CAST(stale AS VARCHAR) || ' stale deals' ELSE 'All clear' END AS headline, breaches, stale, overdue FROM
      (SELECT count(*) FILTER (CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 86400000000.0) AS BIGINT) * 24 > 24) AS breaches FROM events WHERE event_type = 'error' AND value >= 20),
      (SELECT count(*) AS stale FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY),
      (SELECT CAST(sum(overdue) AS BIGINT) AS overdue FROM ({_TASKS}))"""
)
def daily_ops_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: the first problem there is makes the headline."""
    breaches = critical_breaches(spark, d).agg(F.count_if("breach").alias("breaches"))
    stale = table(spark, d, "orders").where("o_orderstatus <> 'F'").where(F.col("o_orderdate") <= as_of() - F.expr("INTERVAL 5 DAYS")).agg(F.count("*").alias("stale"))
    late = _tasks(spark, d).agg(F.sum("overdue").alias("overdue"))
    # three rows of one row each
    one = breaches.crossJoin(stale).crossJoin(late)
    head = F.when(F.col("breaches") > 0, F.concat(F.col("breaches").cast("string"), F.lit(" critical tickets past their time"))).when(F.col("stale") > 0, F.concat(F.col("stale").cast("string"), F.lit(" stale deals"))).otherwise("All clear")
    return one.select(head.alias("headline"), "breaches", "stale", "overdue")


@query(
    """SELECT user_id, event_id, prev_type AS from_stage, event_type AS to_stage FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events) WHERE prev_type IS DISTINCT FROM event_type"""
)
def stage_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stage isn't that of the row before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("from_stage", before)
    return rows.where(~F.col("from_stage").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "from_stage", F.col("event_type").alias("to_stage"))
