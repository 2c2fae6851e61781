"""What people write and send: bookings, products, names, requests, lists, and answers from documents.

Where the tables hold no such texts, rows get one of a list of literals in turn, and the SQL
holds what a person reads out of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bookings as B
from ..functions import records as J
from ..functions import rules as R
from ..functions import text as T
from ..operators import knowledge as K
from ..operators import merges as M
from ..operators import vectors as V
from ..sources.shared import stash
from .registry import moment, query, table


def _values(rows: tuple[tuple, ...]) -> str:
    """SQL: (VALUES (0, ...), (1, ...), ...)."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, (i, *r))) + ")" for i, r in enumerate(rows)) + ")"


def _in_turn(texts: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(number, F.lit(len(texts))) + 1).cast("int"))


#: (doctor, day and time asked for), and: doctor, specialty, days from today or date, time, problem, alternatives.
BOOKINGS = (
    (("Dr Ahmed", "today", "4 PM"), ("Dr. Ahmed", "General Physician", 0, None, "16:00", None, "3:00 PM, 5:00 PM")),
    (("SARAH please", "Tomorrow", "10:30am"), ("Dr. Sara", "Dermatologist", 1, None, "10:30", None, "9:00 AM, 11:00 AM")),
    (("the heart doctor", "day after tomorrow", "16:00"), ("Dr. Ali", "Cardiologist", 2, None, "16:00", None, "3:00 PM, 5:00 PM")),
    (("a checkup", "2030-03-04", "9"), ("Dr. Ahmed", "General Physician", None, "2030-03-04", "09:00", None, "10:00 AM")),
    (("skin", "March 5, 2030", "18.15"), ("Dr. Sara", "Dermatologist", None, "2030-03-05", "18:15", None, "5:00 PM")),
    (("Ali", "5 march 2030", "7pm"), ("Dr. Ali", "Cardiologist", None, "2030-03-05", "19:00", "hours", "6:00 PM")),
    (("a dentist", "today", "10"), ("", "", 0, None, "10:00", "doctor", "9:00 AM, 11:00 AM")),
    (("gp", "someday", "12 am"), ("Dr. Ahmed", "General Physician", None, "", "00:00", "date", "1:00 AM")),
    (("ahmad", "2020-01-06", "noon"), ("Dr. Ahmed", "General Physician", None, "2020-01-06", "", "time", "")),
    (("Cardiology", "1/6/2020", "12:05 pm"), ("Dr. Ali", "Cardiologist", None, "2020-01-06", "12:05", "past", "11:00 AM, 1:00 PM")),
    (("dermatologist", "2030-03-03", "11 AM"), ("Dr. Sara", "Dermatologist", None, "2030-03-03", "11:00", "sunday", "10:00 AM, 12:00 PM")),
    (("physician", "", "3 pm"), ("Dr. Ahmed", "General Physician", None, "", "15:00", "date", "2:00 PM, 4:00 PM")),
)


_BOOKED = f"""SELECT event_id, ts, doctor, specialty, day, time, doctor || '|' || day || '|' || time AS slot, CASE WHEN problem IS NULL AND shift IS NOT NULL AND isodow(CAST(ts AS DATE) + shift) = 7 THEN 'sunday' ELSE problem END AS problem, alternatives FROM (
      SELECT event_id, ts, doctor, specialty, shift, coalesce(strftime(CAST(ts AS DATE) + shift, '%Y-%m-%d'), fixed) AS day, time, problem, alternatives FROM events
      JOIN {_values(tuple(want for _, want in BOOKINGS))} AS b(i, doctor, specialty, shift, fixed, time, problem, alternatives) ON i = event_id % {len(BOOKINGS)} WHERE event_type = 'signup')"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    who, when, at = (_in_turn([said[i] for said, _ in BOOKINGS], F.col("event_id")) for i in range(3))
    rows = table(spark, d, "events").where("event_type = 'signup'")
    return rows.select("event_id", "ts", B.request(who, when, at, F.to_date("ts")).alias("r")).select("event_id", "ts", "r.*")


@query(f"SELECT * EXCLUDE (ts) FROM ({_BOOKED})")
def booking_requests(spark: SparkSession, d: str) -> DataFrame:
    """Doctor, day and time of a request, its slot, what is wrong with it, and hours near it."""
    return _requests(spark, d).drop("ts")


@query(f"SELECT event_id, slot, CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY problem IS NULL, slot ORDER BY ts, event_id) > 1 THEN 'taken' ELSE 'booked' END AS outcome FROM ({_BOOKED})")
def booking_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Who gets a slot: the first valid request for it; later ones find it taken."""
    rows = _requests(spark, d).select("event_id", "ts", "slot", "problem")
    # the first of each slot is found by partial aggregates, however many ask for it
    first = rows.where("problem is null").groupBy("slot").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    both = rows.join(first, "slot", "left")
    outcome = F.when(F.col("problem").isNotNull(), "invalid").when(F.col("_first.event_id") == F.col("event_id"), "booked").otherwise("taken")
    return both.select("event_id", "slot", outcome.alias("outcome"))


#: Messages, and the product and the name in them.
MESSAGES = (
    ("I want to buy the iPhone 15 please", "iPhone 15", None), ("Do you have wireless headphones in stock?", "wireless headphones", None),
    ("hi, my name is Ahmed Raza and I want a laptop", "laptop", "Ahmed Raza"), ("price of Samsung Galaxy S24", "Samsung Galaxy S24", None),
    ("is UC-AUD-001 available", "UC-AUD-001", None), ("I want to return my order", None, None), ("interested in a red ceramic mug for my desk", "red ceramic mug", None),
    ("Sara Khan here, looking for a yoga mat", "yoga mat", "Sara Khan"), ("well, this is The one", None, None), ("hello there", None, None),
    ("I'm Bilal, want one two three four five six", None, None), ("i am Bilal, want one two three four five six", None, "Bilal"), ("tell me about order UC-10452", None, None), ("", None, None),
)


@query(f"SELECT conv_id, turn, product, name FROM conversations JOIN {_values(tuple(m[1:] for m in MESSAGES))} AS m(i, product, name) ON i = (conv_id * 7 + turn * 3) % {len(MESSAGES)} WHERE role = 'user'")
def product_query(spark: SparkSession, d: str) -> DataFrame:
    """The product that a message asks for, and the name that its writer gives."""
    said = _in_turn([m[0] for m in MESSAGES], F.col("conv_id") * 7 + F.col("turn") * 3)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", R.product_query(said).alias("product"), R.person_name(said).alias("name"))


#: Chat requests, and what is wrong with them.
REQUESTS = (
    ('{"message":"hi","sessionId":"s1"}', ""), ('{"message":"","sessionId":"s1"}', "message is not valid"), ('{"sessionId":"s1","extra":1}', "unknown field extra; message is required"),
    ('{"message":"hi","sessionId":"s","channel":"fax"}', "channel is not valid"), ('{"message":"hi","sessionId":"s","channel":"web_chat","phone":"0300 1234567"}', ""),
    ('{"message":"hi","sessionId":"s","phone":"12"}', "phone is not valid"), ("[1]", "not an object"), ("nonsense", "not an object"),
    ('{"message":"  ","sessionId":"","name":""}', "message is not valid; sessionId is not valid; name is not valid"), ('{"message":"hi","sessionId":"s","metadata":{"a":1}}', ""),
    ('{"z":1,"y":2,"message":"hi","sessionId":null}', "unknown field y; unknown field z; sessionId is required"),
)


@query(f"SELECT event_id, problems FROM events JOIN {_values(tuple(r[1:] for r in REQUESTS))} AS r(i, problems) ON i = event_id % {len(REQUESTS)}")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a strict shape: unknown fields, missing ones, and values out of range."""
    sent = _in_turn([r[0] for r in REQUESTS], F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.array_join(J.problems(sent, J.CHAT), "; ").alias("problems"))


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def metadata_contains(spark: SparkSession, d: str) -> DataFrame:
    """Events whose properties hold a fragment."""
    return table(spark, d, "events").where(J.contains(F.col("props"), {"k": 3})).select("event_id", "user_id")


#: Lists as typed into a cell.
LISTS = (("a, b ,c", "a|b|c"), (" , ,", ""), ("", ""), ("one", "one"), ("x,,y", "x|y"), (" Quick Tip , Myth Buster", "Quick Tip|Myth Buster"))


@query(f"SELECT event_id, parts FROM events JOIN {_values(tuple(x[1:] for x in LISTS))} AS x(i, parts) ON i = event_id % {len(LISTS)}")
def listed_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.array_join(T.listed(_in_turn([x[0] for x in LISTS], F.col("event_id"))), "|").alias("parts"))


#: Errors as services word them, and their codes.
ERRORS = (
    ("Request timed out", "TIMEOUT"), ("connect ETIMEDOUT 10.0.0.1", "TIMEOUT"), ("Gateway timeout while saving", "TIMEOUT"), ("401 from the server", "AUTH"), ("user is Forbidden here", "AUTH"),
    ("Unauthorized", "AUTH"), ("HTTP 429", "RATE_LIMIT"), ("Too many requests, slow down", "RATE_LIMIT"), ("Validation failed: name", "VALIDATION"), ("INVALID payload", "VALIDATION"),
    ("disk full", "UNKNOWN"), ("timeout after 401", "TIMEOUT"), ("403: invalid key", "AUTH"), ("", "UNKNOWN"),
)


@query(f"SELECT event_id, code FROM events JOIN {_values(tuple(e[1:] for e in ERRORS))} AS e(i, code) ON i = event_id % {len(ERRORS)} WHERE event_type = 'error'")
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes from the words of error messages; of several that fit, the first of the list."""
    said = F.lower(_in_turn([e[0] for e in ERRORS], F.col("event_id")))
    words = (("TIMEOUT", "timed out|timeout|etimedout"), ("AUTH", "401|403|unauthorized|forbidden"), ("RATE_LIMIT", "429|too many"), ("VALIDATION", "validation|invalid"))
    code = F.coalesce(*[F.when(said.rlike(w), name) for name, w in words], F.lit("UNKNOWN"))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", code.alias("code"))


#: Proposed actions, and whether they may be taken.
ACTIONS = (
    ("Create Task | call back", "approved"), ("send_email | offer", "blocked"), ("Flag  Record", "approved"), ("issue refund | 20", "blocked"), ("add_note", "approved"), ("reboot", "blocked"),
    ("ADD NOTE | delete later", "approved"), ("update task owner", "approved"), ("delete_add_note", "blocked"), ("", "blocked"), ("create_task_and_invoice", "blocked"), (" update_task_owner |x", "approved"),
    ("add_note_2", "blocked"),
)


@query(f"SELECT event_id, verdict FROM events JOIN {_values(tuple(a[1:] for a in ACTIONS))} AS a(i, verdict) ON i = event_id % {len(ACTIONS)}")
def action_guard(spark: SparkSession, d: str) -> DataFrame:
    """Proposed actions: forbidden ones first, then the safe list, else blocked."""
    return table(spark, d, "events").select("event_id", R.guard(_in_turn([a[0] for a in ACTIONS], F.col("event_id"))).alias("verdict"))


@query(
    """WITH t AS (SELECT string_agg(CASE WHEN s_suppkey % 2 = 0 THEN 'call ' || lower(s_name) || ' about the invoice' ELSE 'follow up — ' || lower(s_name) || ' (rs. 5)' END, '; ' ORDER BY s_suppkey) AS titles FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT s_suppkey, coalesce(contains(titles, lower(s_name)), FALSE) AS follow_up_exists FROM supplier CROSS JOIN t"""
)
def followup_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Whether the customer of a follow-up is named in the title of any open task, wherever it stands there."""
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    call = F.concat(F.lit("Call "), "s_name", F.lit(" about the invoice"))
    titles = suppliers.where("s_suppkey % 3 = 0").select(F.lower(F.when(F.col("s_suppkey") % 2 == 0, call).otherwise(F.concat(F.lit("Follow up — "), "s_name", F.lit(" (Rs. 5)")))).alias("title"))
    ours = suppliers.select("s_suppkey", F.concat(F.lit("Follow up — "), "s_name", F.lit(" (Rs. 9,000)")).alias("title"))
    # the amount changes as a deal moves, so only the name is looked for
    ours = ours.select("s_suppkey", F.lower(F.trim(F.split(F.regexp_replace("title", "^Follow up — ", ""), r"\(")[0])).alias("who"))
    found = M.contained(ours, "who", titles, "title").withColumn("hit", F.lit(True))
    return ours.join(found, "who", "left").select("s_suppkey", F.coalesce("hit", F.lit(False)).alias("follow_up_exists"))


@query(
    """SELECT c_custkey, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_order FROM (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)
    ORDER BY last DESC NULLS LAST, c_custkey LIMIT 500"""
)
def customers_by_last_order(spark: SparkSession, d: str) -> DataFrame:
    """The 500 customers with the latest order in progress; those without one come last."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    both = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return both.orderBy(F.desc_nulls_last("last"), "c_custkey").limit(500).select("c_custkey", moment(F.col("last")).alias("last_order"))


@query()
def grounded_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """From texts to answers: documents are chunked and embedded, every 20th benchmark item asks, first those of one language, then once all.

    Confidence counts the best hit, the agreement of the next two, and the share of the
    question's terms that the best chunk holds.
    """
    items = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text", F.array_distinct(T.terms(F.col("text"))).alias("asked"))
    asked = K.hashed_embedding(items.select("query_id", "text")).withColumnRenamed("embedding", "query")
    docs = table(spark, d, "documents").select("doc_id", "lang", T.clean(F.coalesce("text", F.lit(""))).alias("text"))
    # chunked and embedded once, into folders by language: both searches read what is stored
    pieces = V.store(K.chunk_documents(docs, keep=["lang"], dims=K.DIMS).select("doc_id", "lang", "chunk_index", "chunk_text", "embedding"), "lang", "chunks")

    def asked_of(where: Column | None) -> DataFrame:
        # five rows a query, kept because they are read twice and come from all chunks' texts
        got = stash(K.top_k(pieces, asked, 5, 0.08, where, [F.col("doc_id"), F.col("chunk_index")]).join(items.select("query_id", "asked"), "query_id"), "near")
        held = F.size(F.array_intersect(T.terms(F.col("chunk_text")), "asked")) / F.greatest(F.size("asked"), F.lit(1))
        best = got.where("rank = 1").select("query_id", "doc_id", "chunk_index")
        return K.confidence(got, F.when(F.col("rank") == 1, held)).select("query_id", "confidence").join(best, "query_id")

    narrow, wide = asked_of(F.col("lang") == "en"), asked_of(None)
    both = items.select("query_id").join(wide.alias("w"), "query_id", "left").join(narrow.alias("n"), "query_id", "left")
    w, n = F.coalesce("w.confidence", F.lit(0.0)), F.coalesce("n.confidence", F.lit(0.0))
    pick = lambda c: F.when(w > n, F.col(f"w.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"w.{c}")))
    return both.select("query_id", F.greatest(w, n).alias("confidence"), (w > n).alias("widened"), F.when(F.greatest(w, n) >= 0.22, "grounded").otherwise("refused").alias("status"), pick("doc_id").alias("doc_id"), pick("chunk_index").alias("chunk_index"))
