"""Queries of quote requests: creation, statuses from events, quotes in batches, threads by party."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import requests as rq
from quarry.plans.registry import query

ASKED_SQL = """asked AS (SELECT DISTINCT o_custkey || '/' || o_orderpriority AS request_id, l_suppkey AS supplier_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
made AS (SELECT DISTINCT o_custkey, o_custkey || '/' || o_orderpriority AS request_id FROM orders),
judged AS (SELECT made.request_id, o_custkey % 40 AS organization_id, o_custkey AS seq, count(supplier_id) AS suppliers, CASE WHEN o_custkey % 17 = 0 THEN 'TITLE_MISSING' WHEN o_custkey % 19 = 0 THEN 'DESCRIPTION_MISSING'
  WHEN count(supplier_id) = 0 THEN 'NO_SUPPLIER' WHEN count(supplier_id) > 20 THEN 'TOO_MANY_SUPPLIERS' END AS fault FROM made LEFT JOIN asked USING (request_id) GROUP BY made.request_id, o_custkey),
outcome AS (SELECT request_id, suppliers, coalesce(fault, CASE WHEN row_number() OVER (PARTITION BY organization_id, fault ORDER BY seq, request_id) <= 10 THEN 'CREATED' ELSE 'RATE_LIMIT' END) AS outcome FROM judged)"""


def _requests(t):
    """A request for each customer and priority of orders, and the suppliers of their lines."""
    rid = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")
    made = t.orders.select("o_custkey", rid.alias("request_id")).distinct()
    title, description = F.when(F.col("o_custkey") % 17 == 0, "  ").otherwise(F.concat(F.lit(" Parts for "), "request_id")), F.when(F.col("o_custkey") % 19 == 0, "").otherwise("as drawn")
    requests = made.select("request_id", (F.col("o_custkey") % 40).alias("organization_id"), F.col("o_custkey").alias("seq"), title.alias("title"), description.alias("description"), F.lit(None).cast("string").alias("province"), F.lit("100.005").alias("budget"))
    wanted = t.orders.select("o_orderkey", rid.alias("request_id")).join(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("supplier_id")), F.col("o_orderkey") == F.col("l_orderkey"))
    return requests, wanted.select("request_id", "supplier_id")


def _contacts(t):
    """Three contacts for each supplier, some without an address."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("contact_type")) for i, k in enumerate(["GENERAL", "SALES", "OTHER"])])).alias("k")
    rows = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), kinds).select("supplier_id", "k.*")
    email = F.when((F.col("supplier_id") % (F.col("i") + 2)) == 0, F.lit(" ")).otherwise(F.concat(F.lit("c"), F.col("i").cast("string"), F.lit("@s"), F.col("supplier_id").cast("string"), F.lit(".example")))
    return rows.select("supplier_id", (F.col("supplier_id") * 10 + F.col("i")).alias("contact_id"), "contact_type", email.alias("email"), F.lit(0.5).alias("confidence"))


@query("q1_created", f"WITH {ASKED_SQL} SELECT request_id, suppliers, outcome FROM outcome")
def q1_created(t):
    """Requests under the limits of 20 suppliers for each and 10 requests for an organization."""
    return rq.create_requests(*_requests(t), _contacts(t))[0].select("request_id", "suppliers", "outcome")


@query(
    "q1_recipients",
    f"""WITH {ASKED_SQL} SELECT request_id, supplier_id, CASE WHEN supplier_id % 3 <> 0 THEN supplier_id * 10 + 1 WHEN supplier_id % 2 <> 0 THEN supplier_id * 10 WHEN supplier_id % 4 <> 0 THEN supplier_id * 10 + 2 END AS contact_id,
    CASE WHEN supplier_id % 3 = 0 AND supplier_id % 2 = 0 AND supplier_id % 4 = 0 THEN 'NO_CONTACT' ELSE 'PENDING' END AS delivery_status FROM asked JOIN outcome USING (request_id) WHERE outcome = 'CREATED'""",
)
def q1_recipients(t):
    """Recipients of created requests with the contact of each."""
    return rq.create_requests(*_requests(t), _contacts(t))[1].select("request_id", "supplier_id", "contact_id", "delivery_status")


ACTIONS = {"signup": "SEND", "view": "VIEW", "click": "INTEREST", "purchase": "QUOTE", "error": "DECLINE"}
_ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"
_MACHINE_SQL = ", ".join(f"('{s}', '{a}', '{z}')" for (s, a), z in rq.RECIPIENT_MACHINE.items())


@query(
    "q2_statuses",
    f"""WITH RECURSIVE machine(state, action, target) AS (VALUES {_MACHINE_SQL}), e AS (SELECT user_id, event_id, {_ACTION_SQL} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    fold AS (SELECT user_id, event_id, rn, 'DRAFT' AS before, coalesce(target, 'DRAFT') AS after, target IS NOT NULL AS legal FROM e LEFT JOIN machine m ON m.state = 'DRAFT' AND m.action = e.action WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, f.after, coalesce(target, f.after), target IS NOT NULL FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1 LEFT JOIN machine m ON m.state = f.after AND m.action = e.action)
    SELECT user_id, event_id, before, after, legal FROM fold""",
)
def q2_statuses(t):
    """Statuses of all users' requests, event by event."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    events = t.events.select("user_id", "ts", "event_id", action.alias("action"))
    return rq.fold_statuses(events, ["user_id"], ["ts", "event_id"], "action", rq.RECIPIENT_MACHINE, "DRAFT").select("user_id", "event_id", "before", "after", "legal")


@query(
    "q3_quote_merge",
    """WITH q AS (SELECT l_orderkey || '-' || l_suppkey AS recipient_id, l_linenumber * 10000000 + l_partkey AS version, CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE round(l_extendedprice, 2) END AS quote, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END AS lead_time,
      CASE WHEN l_partkey % 4 = 0 THEN l_linestatus END AS message FROM lineitem)
    SELECT recipient_id, 'QUOTE_SUBMITTED' AS status, arg_max(quote, (version, quote))::DOUBLE AS quote, 'CAD' AS currency, arg_max(lead_time, (version, lead_time)) FILTER (lead_time IS NOT NULL) AS lead_time, arg_max(message, (version, message)) FILTER (message IS NOT NULL) AS message FROM q WHERE quote > 0 GROUP BY recipient_id""",
)
def q3_quote_merge(t):
    """Quotes of all lines in two batches, of which the first comes again at the end."""
    quote = F.when(F.col("l_partkey") % 11 == 0, F.lit(-1.0)).otherwise(F.col("l_extendedprice"))
    batch = t.lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("recipient_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).cast("long").alias("version"), quote.alias("quote"), F.lit(None).cast("string").alias("currency"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).alias("lead_time"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_linestatus")).alias("message"), "l_linenumber",
    )
    late, early = batch.where("l_linenumber >= 3"), batch.where("l_linenumber < 4")
    state = t.spark.createDataFrame([], rq.QUOTE_STATE)
    for part in (late, early, late):
        state, _ = rq.merge_quotes(state, part)
    return state.select("recipient_id", "status", F.col("quote").cast("double").alias("quote"), "currency", "lead_time", "message")


@query(
    "q4_party_threads",
    """WITH m AS (SELECT conv_id, turn, conv_id % 7 AS organization_id, turn % 3 AS supplier_id FROM conversations) SELECT 'buyer' AS party, conv_id, turn FROM m WHERE organization_id = 2 UNION ALL SELECT 'supplier', conv_id, turn FROM m WHERE supplier_id = 1""",
)
def q4_party_threads(t):
    """What one buyer and one supplier may read of all threads."""
    rid = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") % 3).cast("string"))
    messages = t.conversations.select(F.col("conv_id").alias("request_id"), rid.alias("recipient_id"), "turn")
    recipients = t.conversations.select(rid.alias("recipient_id"), (F.col("turn") % 3).alias("supplier_id")).distinct()
    requests = t.conversations.select(F.col("conv_id").alias("request_id"), (F.col("conv_id") % 7).alias("organization_id")).distinct()
    told = lambda party, **who: rq.thread_of(messages, recipients, requests, **who).select(F.lit(party).alias("party"), F.col("request_id").alias("conv_id"), "turn")
    return told("buyer", organization=F.lit(2)).unionByName(told("supplier", supplier=F.lit(1)))
