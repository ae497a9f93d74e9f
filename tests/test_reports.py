"""Rankings, name matches, profile checks and batch reports against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import admin as ad
from quarry.operators import claims as cl
from quarry.operators import profile as pr
from quarry.operators import relational as rel
from quarry.operators import reports as rp

MOST = 3


def test_first_with_one(spark):
    """Keys without a wanted row, with fewer rows than places, with the wanted one inside and outside; a null key and null wishes."""
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 2, 3, 4, 5]), i, draw.randrange(5), draw.choice([False, False, False, None, True])) for i in range(60)] + [(9, 100, 1, True), (8, 101, 1, False)]
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        top = mine[:MOST]
        if not any(r[3] for r in top) and (best := next((r for r in mine if r[3]), None)):
            top = [*top[: MOST - 1], best]
        want |= {(key, r[1], place + 1) for place, r in enumerate(top)}
    df = spark.createDataFrame(rows, "k int, i int, v int, yes boolean")
    got = rel.first_with_one(df, ["k"], [F.desc("v"), F.asc("i")], F.col("yes"), MOST)
    assert {(r["k"], r["i"], r["rn"]) for r in got.collect()} == want
    assert rel.first_with_one(df.limit(0), ["k"], [F.desc("v"), F.asc("i")], F.col("yes")).count() == 0


def test_select_contacts_of_a_large_supplier(spark):
    """Each place, the limit of extras and the demotions, among thousands of claims of one supplier and of none."""
    rows = [(s, 10 * i + d, v) for s in (1, None) for i in range(300) for d, v in enumerate((f"506-555-{i:04d}", f"212-555-{i:04d}", "n/a"))]
    rows += [(1, 90_000, "joe@shop.example"), (1, 90_001, "JOE@shop.example"), (2, 1, "info@shop.example")]
    claims = spark.createDataFrame(rows, "supplier_id int, seq long, raw_value string").withColumns(
        {"normalized_value": F.lit(None).cast("string"), "evidence_text": F.lit("contact"), "supplier_domain": F.lit("shop.example"), "page_type": F.lit("CONTACT")}
    )
    out = {(r["supplier_id"], r["seq"]): (r["outcome"], r["score"]) for r in cl.select_contacts(claims).collect()}
    assert len(out) == len(rows)
    assert out[1, 90_000] == ("PRIMARY", 500) and out[1, 90_001][0] == "REJECTED" and out[2, 1] == ("PRIMARY", 600)
    count = lambda s, o: sum(k[0] == s and v[0] == o for k, v in out.items())
    assert (count(1, "BACKUP"), count(1, "EXTRA")) == (2, 17) and (count(None, "PRIMARY"), count(None, "BACKUP"), count(None, "EXTRA")) == (1, 2, 17)
    assert count(1, "REJECTED") == 301 and count(None, "REJECTED") == 300
    assert all(v[0] == "DEMOTED" for k, v in out.items() if k[0] != 2 and k[1] % 10 == 1 and k[1] < 90_000)


@pytest.mark.parametrize("gram", [2, 3])
def test_names_within(spark, gram):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abc ") for _ in range(draw.randrange(9)))
    names = [(i, draw.choice([word(), None, "supplier " + word()])) for i in range(120)]
    seeds = sorted({word() for _ in range(60)} | {"supplier", "zzz", "a", "ab", "supplier zzz", "", " "})
    found = ad.names_within(spark.createDataFrame([(s,) for s in [*seeds, *seeds, None]], "seed_name string"), spark.createDataFrame(names, "supplier_id int, name string"), gram)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted((s, i) for s in seeds for i, n in names if s.strip() and n and s in n)


def test_profile_qa(spark):
    places = spark.createDataFrame([(1, "HEADQUARTERS"), (1, "HEADQUARTERS"), (1, None), (2, "HEADQUARTERS"), (2, "HEADQUARTERS"), (3, "HEADQUARTERS"), (3, "PLANT"), (3, "PLANT")], "supplier_id int, location_type string")
    people = spark.createDataFrame([(1, "a@x.ca", "other@x.ca"), (1, None, "A@X.ca"), (1, "", "a@x.CA"), (1, None, None), (1, "", ""), (2, None, "a@x.ca")], "supplier_id int, normalized_email string, email string")
    claims = spark.createDataFrame(
        [(1, "c1", "CAPABILITY", "REJECTED", "a third-party shop"), (1, "c2", "CAPABILITY", "AUTO_REJECTED", None), (1, "c3", "CONTACT", "REJECTED", None), (2, "c4", None, None, "was subcontracted, third-party")],
        "supplier_id int, claim_id string, claim_type string, review_state string, validation_reason string",
    )
    flags = {(r["supplier_id"], r["code"], r["severity"], r["n"], r["detail"]) for r in pr.profile_qa(places, people, claims).collect()}
    assert flags == {
        (1, "CONTRADICTORY_PRIMARY_LOCATIONS", "WARNING", 2, None), (1, "DUPLICATE_CONTACT_EMAIL", "WARNING", 2, "a@x.ca"), (1, "UNSUPPORTED_CAPABILITY_CLAIMS", "WARNING", 2, None),
        (1, "THIRD_PARTY_EVIDENCE_MENTION", "CRITICAL", 1, None), (2, "THIRD_PARTY_EVIDENCE_MENTION", "CRITICAL", 1, None),
    }
    assert {tuple(r) for r in pr.flagged_claims(claims).collect()} == {(1, "c1", "UNSUPPORTED_CAPABILITY_CLAIMS"), (1, "c2", "UNSUPPORTED_CAPABILITY_CLAIMS"), (1, "c1", "THIRD_PARTY_EVIDENCE_MENTION"), (2, "c4", "THIRD_PARTY_EVIDENCE_MENTION")}
    assert pr.profile_qa(places.limit(0), people.limit(0), claims.limit(0)).count() == 0


def test_batch_report(spark):
    """Gates at their bounds, a supplier without runs or facts, contacts that no request can go to."""
    batches = spark.createDataFrame([(i, "a") for i in range(20)] + [(99, "b")], "supplier_id int, batch string")
    runs = spark.createDataFrame([(i, 1, 1, 0) for i in range(20)] + [(i, 2, 2, 2 if i < 17 else 1) for i in range(18)], "supplier_id int, run_id int, started_at int, pages int")
    rows = [(i, "CAPABILITY", "AUTO_APPROVED", 3, None) for i in range(16)] + [(i, "CONTACT_PHONE", "VERIFIED", 1, "506 555 0100") for i in range(8)] + [(i, "CONTACT", "HUMAN_REVIEW", 1, "sales@shop.example") for i in range(8, 15)]
    rows += [(15, "CONTACT", "REJECTED", 1, "hr@shop.example"), (16, "CONTACT", None, 1, None), (17, None, "UNREVIEWED", 1, None), (18, "LOCATION", "AUTO_REJECTED", 1, None), (18, "CERTIFICATION", "APPROVED", 1, None)]
    facts = spark.createDataFrame(rows, "supplier_id int, claim_type string, review_state string, n_claims long, value string")
    out = {r["batch"]: r.asDict() for r in rp.batch_report(batches, runs, facts).collect()}
    a, b = out["a"], out["b"]
    assert [a[x] for x in ("suppliers", "full", "partial", "failed", "pages", "claims", "facts")] == [20, 17, 1, 2, 35, 68, 36]
    assert [a[x] for x in ("auto_approved", "auto_rejected", "human_review", "human_approved", "human_rejected", "published", "certifications")] == [17, 1, 8, 8, 1, 25, 1]
    assert [a[x] for x in ("with_contact", "with_usable", "with_email", "with_phone", "with_capability", "with_location")] == [17, 15, 8, 9, 16, 1]
    assert (a["full_pct"], a["with_usable_pct"], a["average_pages"], a["average_review"]) == ("85.0%", "75.0%", "1.75", "0.40")
    assert (a["crawl_gate"], a["contact_gate"], a["capability_gate"], a["review_gate"]) == (True, False, True, True)
    assert (b["suppliers"], b["failed"], b["facts"], b["with_contact"], b["crawl_gate"]) == (1, 1, 0, 0, False)
    assert {tuple(r) for r in rp.review_by_type(batches, facts).collect()} == {("a", "CONTACT", 7), ("a", None, 1)}
    half = rp.batch_report(batches.where("batch = 'a'"), runs, facts.where("supplier_id < 10"))
    changes = {tuple(r) for r in rp.report_changes(half, rp.batch_report(batches, runs, facts), "batch", ["suppliers", "facts"]).collect()}
    assert changes == {("a", "suppliers", 20, 20, 0), ("a", "facts", 20, 36, 16), ("b", "suppliers", 0, 1, 1), ("b", "facts", 0, 0, 0)}
    assert rp.batch_report(batches.limit(0), runs, facts).count() == 0
