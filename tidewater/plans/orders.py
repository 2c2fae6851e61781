"""Orders and customers: summaries, ranked lists, rollups, scores.

Dimension tables (region, nation, customer, part, supplier) are left to the planner, which
broadcasts them while they are small and shuffles them when they aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import aggregates as A
from .registry import AS_OF, as_of, cents, days_between, moment, query, table


@query(
    """SELECT o.o_orderkey, c.c_name, o.o_orderstatus, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered_at,
       coalesce(i.n_items, 0) AS n_items, i.amount, i.items
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
        string_agg(p_name || ' x' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '; ' ORDER BY l_linenumber, p_partkey, l_quantity) AS items
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) i ON i.l_orderkey = o.o_orderkey"""
)
def order_summary(spark: SparkSession, d: str) -> DataFrame:
    """Order, customer and its items in line order; null items where there are none."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    label = F.concat("p_name", F.lit(" x"), F.col("l_quantity").cast("int").cast("string"))
    items = A.ordered(lines.join(parts, lines.l_partkey == parts.p_partkey), ["l_orderkey"], ["l_linenumber", "p_partkey", "l_quantity"], label, "items", F.count("*").alias("n"), F.sum(cents(F.col("l_extendedprice"))).cast("double").alias("amount"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    both = orders.join(customers, orders.o_custkey == customers.c_custkey).join(items, orders.o_orderkey == items.l_orderkey, "left")
    return both.select("o_orderkey", "c_name", "o_orderstatus", moment(F.col("o_orderdate")).alias("ordered_at"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), "amount", F.array_join("items", "; ").alias("items"))


@query(
    """SELECT o_orderkey, c_name, c_mktsegment, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200"""
)
def lead_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The newest leads that have a customer; the limit comes before the customers' columns are joined."""
    newest = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    both = newest.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice", "o_orderpriority", moment(F.col("o_orderdate")).alias("created_at"))


@query(
    """SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0) AS lifetime_value, last_order, last_status,
      coalesce(n_errors, 0) AS n_tickets, coalesce(n_open, 0) AS n_open
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
        CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS spent,
        arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status,
        count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1) e ON user_id = c_custkey"""
)
def customer_history(spark: SparkSession, d: str) -> DataFrame:
    """Six figures for every customer, zeroes included: one aggregate a table, then joins."""
    last = F.struct("o_orderdate", "o_orderkey")
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.sum(F.when(F.col("o_orderstatus") != "F", cents(F.col("o_totalprice")))).cast("double").alias("spent"),
        F.max_by("o_orderkey", last).alias("last_order"),
        F.max_by("o_orderstatus", last).alias("last_status"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
    )
    errors = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n_errors"))
    both = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(errors, F.col("c_custkey") == F.col("user_id"), "left")
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    return both.select("c_custkey", zero("n_orders").alias("n_orders"), zero("spent", "double").alias("lifetime_value"), "last_order", "last_status", zero("n_errors").alias("n_tickets"), zero("n_open").alias("n_open"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def orders_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F'), 0) AS DOUBLE) AS lifetime_value FROM orders GROUP BY 1")
def lifetime_value_excl(spark: SparkSession, d: str) -> DataFrame:
    """Sums of what isn't cancelled; zero where all is."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "F", cents(F.col("o_totalprice")))), F.lit(0)).cast("double").alias("lifetime_value"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT p_type AS category, p_name, p_partkey, p_retailprice FROM part WHERE p_size >= 25 ORDER BY p_type, p_name, p_partkey LIMIT 500")
def products_by_category(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size >= 25")
    return parts.orderBy("p_type", "p_name", "p_partkey").limit(500).select(F.col("p_type").alias("category"), "p_name", "p_partkey", "p_retailprice")


@query(
    """SELECT n_name AS city, p_type AS category, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
)
def sales_by_city_category(spark: SparkSession, d: str) -> DataFrame:
    """A star join grouped by two keys."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("n_name").alias("city"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.sum(cents(F.col("l_extendedprice"))).cast("double").alias("amount"))


@query(
    """SELECT o_orderkey, 'ORD-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CASE WHEN length(CAST(n AS VARCHAR)) >= 4 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS reference
    FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"""
)
def sequential_reference(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that start anew each year; past 9999 they keep all digits.

    A year is no task: days are counted first, and rows are numbered within their day.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    n = A.running_number(orders, ["y"], "o_orderdate", ["o_orderkey"])
    return n.select("o_orderkey", F.concat(F.lit("ORD-"), F.col("y").cast("string"), F.lit("-"), V.reference("", F.col("number"), 4)).alias("reference"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN NULL WHEN d > 0 THEN d END AS days_overdue,
      o_orderpriority = '1-URGENT' OR (o_orderstatus <> 'F' AND d > 0) AS needs_attention
    FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(o_orderdate + INTERVAL 30 DAY)) / 86400000000.0) AS BIGINT) AS d FROM orders)"""
)
def order_attention(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days past the expected delivery of open orders, and who needs attention."""
    late = days_between(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), as_of())
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit(None)).when(late > 0, late).alias("days_overdue"), ((F.col("o_orderpriority") == "1-URGENT") | ((F.col("o_orderstatus") != "F") & (late > 0))).alias("needs_attention"))


@query(
    """SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || CASE o_orderstatus WHEN 'F' THEN ' was delivered.' WHEN 'P' THEN ' is on its way.' ELSE ' is being prepared.' END || CASE WHEN o_totalprice >= 250000 THEN ' It is a large order.' ELSE '' END AS sentence,
      upper(substr(replace(lower(c_mktsegment), '_', ' '), 1, 1)) || substr(lower(c_mktsegment), 2) AS segment,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' ELSE 'Normal' END AS priority
    FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def order_mirror(spark: SparkSession, d: str) -> DataFrame:
    """Display columns of orders: a sentence by status, a capitalised segment, two priorities."""
    both = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", " was delivered.").when(F.col("o_orderstatus") == "P", " is on its way.").otherwise(" is being prepared.")
    said = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), status, F.when(F.col("o_totalprice") >= 250000, " It is a large order.").otherwise(""))
    return both.select("o_orderkey", said.alias("sentence"), T.display(F.lower("c_mktsegment")).alias("segment"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "High").otherwise("Normal").alias("priority"))


@query(
    """SELECT o_orderkey, score, score >= 70 OR o_totalprice >= 150000 AS is_high_value FROM (
      SELECT o_orderkey, o_totalprice, least(100, CASE WHEN o_totalprice >= 300000 THEN 45 WHEN o_totalprice >= 150000 THEN 38 WHEN o_totalprice >= 50000 THEN 22 ELSE 10 END
        + CASE WHEN o_orderpriority = '1-URGENT' THEN 30 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 18 ELSE 5 END
        + CASE WHEN l.l_orderkey IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN c_nationkey IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN earlier > 0 THEN 10 ELSE 0 END) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS earlier FROM orders) o
      JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o_orderkey)"""
)
def lead_score_pkr(spark: SparkSession, d: str) -> DataFrame:
    """Budget, intent, product, place and history add up to at most 100."""
    from ..functions import rules as R

    before = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    orders = table(spark, d, "orders").withColumn("earlier", before)
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    rows = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "ready_to_buy").when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "considering").otherwise("browsing")
    score = R.lead_score(F.col("o_totalprice"), stage, F.col("l_orderkey").isNotNull(), F.col("c_nationkey").isNotNull(), F.col("earlier") > 0, F.lit(True))
    return rows.select("o_orderkey", score.alias("score"), R.high_value(F.col("o_totalprice"), score, F.lit(True)).alias("is_high_value"))


@query(
    """SELECT o_orderkey, score, CASE WHEN score >= 70 THEN 'Hot' WHEN score >= 40 THEN 'Warm' ELSE 'Cold' END AS band FROM (
      SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 30 WHEN o_orderpriority = '3-MEDIUM' THEN 20 ELSE 10 END
        + CASE WHEN o_totalprice >= 300000 THEN 30 WHEN o_totalprice >= 100000 THEN 20 WHEN o_totalprice > 0 THEN 10 ELSE 0 END
        + CASE WHEN c_mktsegment = 'BUILDING' THEN 20 WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 15 ELSE 0 END AS score
      FROM orders JOIN customer ON o_custkey = c_custkey)"""
)
def lead_score_bands(spark: SparkSession, d: str) -> DataFrame:
    """Urgency, budget and source points, in three bands; thresholds fit the table's prices."""
    from ..functions import rules as R

    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    urgency = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    source = F.when(F.col("c_mktsegment") == "BUILDING", "referral").when(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE"), "network").otherwise("other")
    score = R.simple_lead_score(urgency, F.col("o_totalprice"), source, (300_000, 100_000))
    return rows.select("o_orderkey", score.alias("score"), R.band(score, ((70, "Hot"), (40, "Warm")), "Cold").alias("band"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 10000 THEN 'Low' WHEN l_extendedprice <= 50000 THEN 'Medium' ELSE 'High' END AS risk,
      CASE WHEN l_returnflag = 'R' THEN 'Receipt Required' WHEN l_extendedprice < 10000 THEN 'Auto Approved' ELSE 'Pending' END AS status FROM lineitem"""
)
def expense_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk by amount; a missing receipt changes the status, not the risk."""
    from ..functions import rules as R

    risk, status = R.expense(F.col("l_extendedprice"), F.col("l_returnflag") != "R", (10_000, 50_000))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", risk.alias("risk"), status.alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'HIGH' WHEN o_totalprice >= 200000 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM orders")
def budget_priority(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import rules as R

    return table(spark, d, "orders").select("o_orderkey", R.band(F.col("o_totalprice"), ((400_000, "HIGH"), (200_000, "MEDIUM")), "LOW").alias("priority"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'Enterprise' WHEN c_acctbal >= 3000 THEN 'Mid-Market' ELSE 'Standard' END AS tier,
      CASE WHEN c_mktsegment LIKE '%AUTO%' THEN ['M1', 'M2'][c_custkey % 2 + 1] WHEN c_mktsegment LIKE '%MACH%' THEN 'M3' ELSE 'M2' END AS manager,
      strftime(DATE '2001-08-02' + CAST(c_custkey % 30 + 7 AS INTEGER), '%Y-%m-%d') AS due FROM customer"""
)
def tier_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Tier by budget, a manager from the service's pool in turn, due a week after the start."""
    from ..functions import rules as R

    pool = F.when(F.col("c_mktsegment").contains("AUTO"), F.array(F.lit("M1"), F.lit("M2"))).when(F.col("c_mktsegment").contains("MACH"), F.array(F.lit("M3"))).otherwise(F.array(F.lit("M2")))
    start = F.date_add(F.lit(AS_OF[:10]).cast("date"), (F.col("c_custkey") % 30).cast("int"))
    return table(spark, d, "customer").select("c_custkey", R.band(F.col("c_acctbal"), ((8_000, "Enterprise"), (3_000, "Mid-Market")), "Standard").alias("tier"), R.in_turn(pool, F.col("c_custkey")).alias("manager"), F.date_format(F.date_add(start, 7), "yyyy-MM-dd").alias("due"))


@query(
    """SELECT p_partkey, CASE WHEN years >= 40 THEN 'High' WHEN years >= 20 THEN 'Medium' ELSE 'Low' END AS priority
    FROM (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE p_size END AS years FROM part)"""
)
def candidate_priority(spark: SparkSession, d: str) -> DataFrame:
    """Years from a free text such as '11 units' or 'fresh'; bands fit the table's sizes."""
    from ..functions import rules as R

    said = F.when(F.col("p_type") == "ECONOMY", F.lit("fresh")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" units")))
    return table(spark, d, "part").select("p_partkey", R.band(R.years(said), ((40, "High"), (20, "Medium")), "Low").alias("priority"))


@query(
    """SELECT c_custkey, repeat('*', length(c_name) - 4) AS masked_middle, substr(c_name, 1, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS masked, n_name || ', ' || r_name AS address
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def mask_pii(spark: SparkSession, d: str) -> DataFrame:
    """Names starred but for their ends; of an address the last two parts."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    address = F.concat_ws(", ", F.col("c_custkey").cast("string"), F.lit("Main Street"), "n_name", "r_name")
    return rows.select("c_custkey", F.repeat(F.lit("*"), F.length("c_name") - 4).alias("masked_middle"), T.mask(F.col("c_name")).alias("masked"), T.redact_address(address).alias("address"))


@query(
    """SELECT c_custkey, '+923' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS e164, '+92 3' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 2) || ' ' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 3) AS shown FROM customer WHERE c_custkey % 6 < 4
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 6 >= 4"""
)
def phone_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Six spellings of a customer's number; two of them can't be told."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    k = F.col("c_custkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("+92 3"), digits)).when(k == 1, F.concat(F.lit("00923"), digits)).when(k == 2, F.concat(F.lit("03"), digits))
        .when(k == 3, F.concat(F.lit("(3"), digits, F.lit(")"))).when(k == 4, F.lit("123")).otherwise(F.concat(F.lit("+0"), digits))
    )
    return table(spark, d, "customer").select("c_custkey", V.phone(raw).alias("e164"), V.phone_display(V.phone(raw)).alias("shown"))


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50 + 1) * 100000 WHEN 1 THEN (o_orderkey % 500 + 1) * 1000 WHEN 2 THEN o_orderkey % 900 * 1000 + 1000 ELSE NULL END AS BIGINT) AS budget,
      CAST(o_orderkey % 900 * 1000 + 1000 AS DOUBLE) AS money FROM orders"""
)
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    """Budgets as people write them, and cells with currency signs."""
    k = F.col("o_orderkey")
    comma = F.format_number(k % 900 * 1000 + 1000, 0)
    raw = F.when(k % 4 == 0, F.concat((k % 50 + 1).cast("string"), F.lit(" lakh"))).when(k % 4 == 1, F.concat((k % 500 + 1).cast("string"), F.lit("k"))).when(k % 4 == 2, F.concat(F.lit("Rs. "), comma)).otherwise(F.lit("n/a"))
    return table(spark, d, "orders").select("o_orderkey", V.budget(raw).alias("budget"), V.money(F.concat(F.lit("-$"), comma)).alias("money"))


@query(
    """SELECT CASE WHEN grouping(r_name) = 1 THEN 'all' ELSE r_name END AS region, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderstatus)"""
)
def status_cube(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the usual rollups: all margins of region and status in one pass."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = rows.cube("r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping("r_name").alias("gr"), F.grouping("o_orderstatus").alias("gs"))
    return both.select(F.when(F.col("gr") == 1, "all").otherwise(F.col("r_name")).alias("region"), F.when(F.col("gs") == 1, "all").otherwise(F.col("o_orderstatus")).alias("status"), "n")
