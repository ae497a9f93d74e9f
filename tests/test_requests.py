"""Requests under limits, statuses folded over split keys, quotes in any order of batches, threads by party."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import requests as rq


def created(spark, requests, wanted, contacts=(), made=None):
    r = spark.createDataFrame(requests, "request_id string, organization_id string, seq long, title string, description string, province string, budget string")
    w = spark.createDataFrame(wanted, "request_id string, supplier_id string")
    c = spark.createDataFrame(list(contacts), "supplier_id string, contact_id string, contact_type string, email string, confidence double")
    m = None if made is None else spark.createDataFrame(made, "organization_id string, n int")
    outcomes, recipients = rq.create_requests(r, w, c, m)
    return {x["request_id"]: x for x in outcomes.collect()}, sorted((x["request_id"], x["supplier_id"], x["contact_id"], x["delivery_status"]) for x in recipients.collect())


def test_creation_outcomes(spark):
    rows = [("r1", "o", 1, "  A pump ", " big ", None, "12.345"), ("r2", "o", 2, " ", "x", None, None), ("r3", "o", 3, "t", None, None, None), ("r4", "o", 4, "t", "d", "NS", "x"), ("r5", "o", 5, "t", "d", "", None)]
    wanted = [("r1", "s1"), ("r1", "s1"), ("r1", "s2"), ("r2", "s1"), ("r3", "s1"), ("r4", None)] + [("r5", f"s{i}") for i in range(21)]
    contacts = [("s1", "c9", "GENERAL", "g@x", 0.9), ("s1", "c8", "PROCUREMENT", "  ", 0.9), ("s1", "c7", "SALES", "s@x", 0.1), ("s2", "c1", "SALES", None, 1.0)]
    outcomes, recipients = created(spark, rows, wanted, contacts)
    assert {k: v["outcome"] for k, v in outcomes.items()} == {"r1": "CREATED", "r2": "TITLE_MISSING", "r3": "DESCRIPTION_MISSING", "r4": "NO_SUPPLIER", "r5": "TOO_MANY_SUPPLIERS"}
    assert (outcomes["r1"]["title"], outcomes["r1"]["description"], outcomes["r1"]["province"], str(outcomes["r1"]["budget"]), outcomes["r1"]["status"]) == ("A pump", "big", "NB", "12.35", "DRAFT")
    assert recipients == [("r1", "s1", "c7", "PENDING"), ("r1", "s2", None, "NO_CONTACT")]


def test_rate_limit(spark):
    rows = [(f"r{i:02}", "o", i, "t", "d", None, None) for i in range(13)] + [("q", "p", 1, "t", "d", None, None)]
    wanted = [(r[0], "s") for r in rows]
    outcomes, _ = created(spark, rows, wanted)
    assert [k for k, v in sorted(outcomes.items()) if v["outcome"] == "RATE_LIMIT"] == ["r10", "r11", "r12"]
    outcomes, _ = created(spark, rows, wanted, made=[("o", 8)])
    assert [k for k, v in sorted(outcomes.items()) if v["outcome"] == "CREATED"] == ["q", "r00", "r01"]


def test_sending(spark):
    requests = spark.createDataFrame([("r1", "DRAFT"), ("r2", "SENT")], "request_id string, status string")
    recipients = spark.createDataFrame([("r1", "a", "a@x", "PENDING"), ("r1", "b", " ", "PENDING"), ("r1", "c", "c@bad", "PENDING"), ("r2", "a", "a@x", "PENDING")], "request_id string, supplier_id string, email string, delivery_status string")
    sent, out = rq.send_requests(requests, recipients, F.col("email") != "c@bad")
    assert {tuple(r) for r in sent.select("request_id", "outcome", "status").collect()} == {("r1", "SENT", "SENT"), ("r2", "REFUSED", "SENT")}
    assert sorted(tuple(r) for r in out.select("request_id", "supplier_id", "delivery_status").collect()) == [("r1", "a", "SENT"), ("r1", "b", "NO_CONTACT"), ("r1", "c", "FAILED"), ("r2", "a", "PENDING")]


def test_statuses_over_split_keys(spark):
    """One key holds most events, so it lies over several partitions; statuses are those of a plain loop."""
    rng = random.Random(4)
    actions = ["SEND", "VIEW", "INTEREST", "QUOTE", "DECLINE", "ASK", "NONSENSE", None]
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice(actions)) for i in range(3000)] + [(None, 1, "SEND")]
    events = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, a string").repartition(7)
    got = {(r["k"], r["i"]): (r["before"], r["after"], r["legal"]) for r in rq.fold_statuses(events, ["k"], ["i"], "a", rq.RECIPIENT_MACHINE, "DRAFT").collect()}
    now, want = {}, {}
    for k, i, a in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        before = now.get(k, "DRAFT")
        now[k] = rq.RECIPIENT_MACHINE.get((before, a), before)
        want[k, i] = (before, now[k], (before, a) in rq.RECIPIENT_MACHINE)
    assert got == want
    assert rq.fold_statuses(events.limit(0), ["k"], ["i"], "a", rq.RECIPIENT_MACHINE, "DRAFT").count() == 0


QUOTES = [("r", 1, "10", "USD", "2 weeks", "first"), ("r", 2, "20.005", None, None, None), ("r", 3, "30", "", "", "third"), ("s", 5, "7.5", None, "soon", ""), ("r", 4, "-1", None, "never", "no"), ("s", 6, "abc", None, None, None), (None, 1, "5", None, None, None), ("t", None, "5", None, None, None)]
QUOTE = "recipient_id string, version long, quote string, currency string, lead_time string, message string"


def test_quotes_in_any_order(spark):
    results = set()
    for order in itertools.permutations([QUOTES[:1], QUOTES[1:3], QUOTES[3:]]):
        state = spark.createDataFrame([], rq.QUOTE_STATE)
        for part in (*order, order[0]):
            state, rejected = rq.merge_quotes(state, spark.createDataFrame(part, QUOTE))
        results.add(tuple(sorted(str(tuple(r)) for r in state.collect())))
    assert len(results) == 1
    rows = {r["recipient_id"]: r for r in state.collect()}
    assert set(rows) == {"r", "s"} and (str(rows["r"]["quote"]), rows["r"]["currency"], rows["r"]["lead_time"], rows["r"]["message"]) == ("30.00", "CAD", "2 weeks", "third")
    assert (str(rows["s"]["quote"]), rows["s"]["message"], rows["s"]["status"]) == ("7.50", "", "QUOTE_SUBMITTED")
    assert rq.merge_quotes(state, spark.createDataFrame(QUOTES, QUOTE))[1].count() == 4


def test_threads(spark):
    messages = spark.createDataFrame([("a", "q", 1), ("b", "q", 2), ("c", "p", 3)], "recipient_id string, request_id string, n int")
    recipients = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1")], "recipient_id string, supplier_id string")
    requests = spark.createDataFrame([("q", "o1"), ("p", "o2")], "request_id string, organization_id string")
    see = lambda **who: sorted(r["n"] for r in rq.thread_of(messages, recipients, requests, **who).collect())
    assert see(organization=F.lit("o1")) == [1, 2] and see(supplier=F.lit("s1")) == [1, 3] and see() == [] and see(supplier=F.lit(None)) == []
