"""Quote requests from draft to quote: creation under limits, sending, statuses folded from events, quotes merged by version, threads by party."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions import text as tx
from quarry.model import RFQ_CONTACT_TYPES, rank_in
from quarry.operators.relational import rank_within

# Suppliers that a request may address, and requests that an organization may make within an hour.
MOST_RECIPIENTS, MOST_REQUESTS = 20, 10


def best_contacts(contacts: DataFrame) -> DataFrame:
    """contacts (supplier_id, contact_id, contact_type, email, confidence) -> the contact of each supplier that a request goes to: of those with an address the most wanted type, then the surest, then the least id."""
    usable = contacts.where(tx.strip(tx.or_empty(F.col("email"))) != "")
    order = F.struct(rank_in(F.col("contact_type"), RFQ_CONTACT_TYPES), -F.coalesce("confidence", F.lit(0.0)), "contact_id")
    return usable.groupBy("supplier_id").agg(F.min_by(F.struct("contact_id", "email"), order).alias("c")).select("supplier_id", "c.*")


def create_requests(requests: DataFrame, wanted: DataFrame, contacts: DataFrame, made: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, recipients) of requests (request_id, organization_id, seq, title, description, province, budget) that want suppliers (request_id, supplier_id).

    Outcomes, the first that fits: TITLE_MISSING, DESCRIPTION_MISSING, NO_SUPPLIER, TOO_MANY_SUPPLIERS, RATE_LIMIT, else CREATED, with status DRAFT.
    Requests of an organization count in the order of seq, those that `made` (organization_id, n) tells of before them. Recipients of created
    requests carry the supplier's best contact; without one their delivery is NO_CONTACT. A supplier wanted twice is asked once. Suppliers
    of a request are counted before the shuffle, and only the first MOST_REQUESTS of an organization are kept by each task.
    """
    asked = wanted.where("supplier_id is not null").select("request_id", "supplier_id").distinct()
    counted = asked.groupBy("request_id").agg(F.count("*").alias("n"))
    rows = requests.join(counted, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blank = lambda c: tx.strip(tx.or_empty(F.col(c))) == ""
    fault = F.when(blank("title"), "TITLE_MISSING").when(blank("description"), "DESCRIPTION_MISSING").when(F.col("n") == 0, "NO_SUPPLIER").when(F.col("n") > MOST_RECIPIENTS, "TOO_MANY_SUPPLIERS")
    rows = rows.withColumn("fault", fault)
    first = rank_within(rows.where("fault is null").select("request_id", "organization_id", "seq"), ["organization_id"], [F.asc("seq"), F.asc("request_id")], MOST_REQUESTS)
    if made is not None:
        first = first.join(made.select("organization_id", F.col("n").alias("before")), "organization_id", "left").where(F.col("rn") + F.coalesce("before", F.lit(0)) <= MOST_REQUESTS)
    judged = rows.join(first.select("request_id", F.lit(True).alias("within")), "request_id", "left")
    outcome = F.coalesce("fault", F.when(F.col("within"), "CREATED").otherwise("RATE_LIMIT"))
    outcomes = judged.select(
        "request_id", "organization_id", tx.strip(F.col("title")).alias("title"), tx.strip(F.col("description")).alias("description"), tx.if_blank(F.col("province"), F.lit("NB")).alias("province"),
        F.round(F.col("budget").try_cast("decimal(18,4)"), 2).alias("budget"), F.col("n").alias("suppliers"), outcome.alias("outcome"), F.when(outcome == "CREATED", "DRAFT").alias("status"),
    )
    sent_to = asked.join(outcomes.where("outcome = 'CREATED'").select("request_id"), "request_id", "left_semi").join(best_contacts(contacts), "supplier_id", "left")
    delivery = F.when(F.col("contact_id").isNull(), "NO_CONTACT").otherwise("PENDING")
    return outcomes, sent_to.select("request_id", "supplier_id", "contact_id", "email", delivery.alias("delivery_status"), F.lit("PENDING").alias("response_status"))


def send_requests(requests: DataFrame, recipients: DataFrame, delivered: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, recipients) after sending: drafts become SENT, others are REFUSED; recipients of drafts become SENT or FAILED as delivered tells, or NO_CONTACT."""
    draft = F.coalesce(F.col("status") == "DRAFT", F.lit(False))
    out = requests.withColumns({"outcome": F.when(draft, "SENT").otherwise("REFUSED"), "status": F.when(draft, "SENT").otherwise(F.col("status"))})
    mine = recipients.join(requests.where(draft).select("request_id", F.lit(True).alias("_draft")), "request_id", "left")
    new = F.when(tx.strip(tx.or_empty(F.col("email"))) == "", "NO_CONTACT").when(F.coalesce(delivered, F.lit(False)), "SENT").otherwise("FAILED")
    return out, mine.withColumn("delivery_status", F.when(F.col("_draft"), new).otherwise(F.col("delivery_status"))).drop("_draft")


def buyer_requests(requests: DataFrame, recipients: DataFrame) -> DataFrame:
    """Each request with its recipients, those who answered, and those who quoted."""
    n = recipients.groupBy("request_id").agg(F.count("*").alias("recipients"), F.count_if(F.col("response_status") != "PENDING").alias("responses"), F.count_if(F.col("response_status") == "QUOTE_SUBMITTED").alias("quotes"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("recipients", "responses", "quotes")}
    return requests.join(n, "request_id", "left").withColumns(counts)


#: What becomes of a recipient's status: (status, action) -> status. What isn't listed is refused.
RECIPIENT_MACHINE = {
    ("DRAFT", "SEND"): "SENT", ("SENT", "VIEW"): "VIEWED", ("VIEWED", "VIEW"): "VIEWED", ("SENT", "INTEREST"): "INTERESTED", ("VIEWED", "INTEREST"): "INTERESTED",
    ("SENT", "ASK"): "NEED_INFORMATION", ("VIEWED", "ASK"): "NEED_INFORMATION", ("INTERESTED", "ASK"): "NEED_INFORMATION", ("NEED_INFORMATION", "INTEREST"): "INTERESTED",
    ("INTERESTED", "QUOTE"): "QUOTE_SUBMITTED", ("NEED_INFORMATION", "QUOTE"): "QUOTE_SUBMITTED", ("QUOTE_SUBMITTED", "QUOTE"): "QUOTE_SUBMITTED",
    ("SENT", "DECLINE"): "DECLINED", ("VIEWED", "DECLINE"): "DECLINED", ("INTERESTED", "DECLINE"): "DECLINED", ("NEED_INFORMATION", "DECLINE"): "DECLINED", ("QUOTE_SUBMITTED", "DECLINE"): "DECLINED",
    ("DECLINED", "SEND"): "SENT",
}


def fold_statuses(events: DataFrame, keys: list[str], order: list[str], action: str, machine: dict[tuple[str, str], str], start: str) -> DataFrame:
    """events -> (keys, order, action, before, after, legal): the status of each key before and after each of its events, in order; illegal moves leave it as it is.

    A key may hold any share of the events: events are range-partitioned by key and order, so a large key lies over several partitions. A move
    maps every status to one, so a run of moves is again such a map. Each partition tells the map of its first and last key's run, which is all
    the driver needs to find the status that a partition's first key comes with: a row for each partition, however many events. Then each
    partition is read through once more. Actions that the machine doesn't know, and null ones, are illegal.
    """
    states = sorted({start, *(s for s, _ in machine), *machine.values()})
    at = {s: i for i, s in enumerate(states)}
    stay = list(range(len(states)))
    moves = {a: [at[machine.get((s, a), s)] for s in states] for a in {a for _, a in machine}}
    allowed = {(at[s], a) for s, a in machine}
    placed = events.select(*keys, *order, action).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).persist(StorageLevel.DISK_ONLY)
    key_type = T.StructType([placed.schema[k] for k in keys])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield tuple(row[k] for k in keys), row

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        first_map = run = stay
        for key, row in rows_of(batches):
            if key != last:
                first, run = (key, stay) if first is None else (first, stay)
                last = key
            step = moves.get(row[action], stay)
            run = [step[s] for s in run]
            if key == first:
                first_map = run
        if first is not None:
            columns = [TaskContext.get().partitionId(), dict(zip(keys, first, strict=True)), dict(zip(keys, last, strict=True)), first_map, run]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(columns, to_arrow_schema(summary), strict=True)], schema=to_arrow_schema(summary))

    summary = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", key_type), T.StructField("last", key_type), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("first_map", "last_map")]])
    comes_with: dict[int, int] = {}
    open_key, status = None, at[start]
    for r in sorted(placed.mapInArrow(summed, summary).collect(), key=lambda r: r["part"]):
        begins = status if r["first"] == open_key else at[start]
        comes_with[r["part"]] = begins
        status = r["last_map"][begins if r["first"] == r["last"] else at[start]]
        open_key = r["last"]
    out = T.StructType([*placed.schema.fields, T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("legal", T.BooleanType())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, comes_with.get(TaskContext.get().partitionId(), at[start])
        for batch in batches:
            before, after, legal = [], [], []
            for key, row in rows_of([batch]):
                if last is not None and key != last:
                    now = at[start]
                last = key
                legal.append((now, row[action]) in allowed)
                before.append(states[now])
                now = moves.get(row[action], stay)[now]
                after.append(states[now])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(after), pa.array(legal, pa.bool_())], schema=to_arrow_schema(out))

    return placed.mapInArrow(told, out)


QUOTE_STATE = "recipient_id string, status string, quote decimal(18,2), currency string, version long, lead_time string, lead_time_version long, message string, message_version long"


def merge_quotes(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, rejected) after a batch of quotes (recipient_id, version, quote, currency, lead_time, message) is put over current (see QUOTE_STATE).

    The result is that of all quotes ever seen in the order of their versions, whatever order and however often batches come: amount, currency
    (CAD where none is given) and status are those of the highest version; lead time and message those of the highest version that gives one.
    A quote that is no positive amount is rejected, as is one without recipient or version. One shuffle by recipient.
    """
    amount = F.round(F.col("quote").try_cast("decimal(38,10)"), 2).cast("decimal(18,2)")
    valid = F.coalesce((amount > 0) & F.col("recipient_id").isNotNull() & F.col("version").isNotNull(), F.lit(False))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    new = batch.where(valid).select(
        "recipient_id", F.lit("QUOTE_SUBMITTED").alias("status"), amount.alias("quote"), tx.if_blank(F.col("currency"), F.lit("CAD")).alias("currency"), "version",
        given("lead_time").alias("lead_time"), F.when(given("lead_time").isNotNull(), F.col("version")).alias("lead_time_version"), F.col("message"), F.when(F.col("message").isNotNull(), F.col("version")).alias("message_version"),
    )
    both = current.select(*new.columns).unionByName(new)
    latest = F.max_by(F.struct("status", "quote", "currency"), F.struct("version", "quote", "currency"))
    state = both.groupBy("recipient_id").agg(
        latest.alias("q"), F.max("version").alias("version"), F.max_by("lead_time", F.struct("lead_time_version", "lead_time")).alias("lead_time"), F.max("lead_time_version").alias("lead_time_version"),
        F.max_by("message", F.struct("message_version", "message")).alias("message"), F.max("message_version").alias("message_version"),
    )
    shape = T._parse_datatype_string(QUOTE_STATE)
    state = state.select("recipient_id", "q.*", "version", "lead_time", "lead_time_version", "message", "message_version").select(*[F.col(f.name).cast(f.dataType) for f in shape.fields])
    return state, batch.where(~valid)


def thread_of(messages: DataFrame, recipients: DataFrame, requests: DataFrame, organization: Column | None = None, supplier: Column | None = None) -> DataFrame:
    """Messages (recipient_id, request_id ...) that a party may read: the organization that made the request all of it, a supplier only those of its own recipient. Without a party none."""
    at = recipients.select("recipient_id", "supplier_id").join(messages, "recipient_id").join(requests.select("request_id", "organization_id"), "request_id")
    mine = F.lit(False)
    if organization is not None:
        mine = mine | (F.col("organization_id") == organization)
    if supplier is not None:
        mine = mine | (F.col("supplier_id") == supplier)
    return at.where(F.coalesce(mine, F.lit(False)))
