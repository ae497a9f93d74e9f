"""Approved claims to links, and places of numbers."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import publishing as pb
from quarry.operators import site

DICTIONARY = [("CAPABILITY", "pipe-work", "Pipe Work"), ("CAPABILITY", "steel-pipe-work", "Steel Pipe Work"), ("INDUSTRY", "mining", "Mining & Metals"), ("SERVICE_REGION", "north", "North Shore")]


def test_resolve_levels(spark):
    dictionary = spark.createDataFrame(DICTIONARY, "claim_type string, slug string, name string")
    aliases = spark.createDataFrame([("CAPABILITY", "Tubing", "pipe-work"), ("INDUSTRY", "Ores", "mining")], "claim_type string, alias string, slug string")
    values = [("CAPABILITY", v) for v in ["pipe-work", "Pipe Work", "PIPE WORK", "tubing", "Pipe", "Ores", "nothing", ""]] + [("INDUSTRY", "metals"), ("INDUSTRY", "Pipe"), ("INDUSTRY", "ores"), ("CAPABILITY", "Pipe")]
    got = {(r[0], r[1]): (r[2], r[3]) for r in pb.resolve_entries(spark.createDataFrame(values, "claim_type string, value string"), dictionary, aliases).collect()}
    assert got == {
        ("CAPABILITY", "pipe-work"): ("pipe-work", "slug"), ("CAPABILITY", "Pipe Work"): ("pipe-work", "slug"), ("CAPABILITY", "PIPE WORK"): ("pipe-work", "slug"), ("CAPABILITY", "tubing"): ("pipe-work", "alias"),
        ("CAPABILITY", "Pipe"): ("pipe-work", "contains"), ("CAPABILITY", "Ores"): (None, None), ("CAPABILITY", "nothing"): (None, None), ("CAPABILITY", ""): (None, None),
        ("INDUSTRY", "metals"): ("mining", "contains"), ("INDUSTRY", "Pipe"): (None, None), ("INDUSTRY", "ores"): ("mining", "alias"),
    }


def test_effects_by_type(spark):
    dictionary = spark.createDataFrame(DICTIONARY, "claim_type string, slug string, name string")
    aliases = spark.createDataFrame([], "claim_type string, alias string, slug string")
    claims = [(1, "s", "CAPABILITY", "x", "pipe-work"), (2, "s", "CAPABILITY", "pipe work", None), (3, "s", "INDUSTRY", "mining", None), (4, "s", "SERVICE_REGION", "north", ""), (5, "t", "INDUSTRY", "mining", None), (6, "s", "CONTACT", "a@b", None), (7, "s", "CONTACT_PHONE", "1", None), (8, "s", "LOCATION", "1 Main", None)]
    approved = spark.createDataFrame(claims, "claim_id long, supplier_id string, claim_type string, raw_value string, normalized_value string")
    current = [("CAPABILITY", "s", "pipe-work", False, "OLD", 0), ("INDUSTRY", "s", "mining", True, "OLD", 0), ("SERVICE_REGION", "s", "north", False, "OLD", 0), ("CAPABILITY", "u", "pipe-work", True, "OLD", 0)]
    now = spark.createDataFrame(current, "claim_type string, supplier_id string, slug string, published boolean, state string, claim_id long")
    got = {(r[0], r[1]): tuple(r)[3:] for r in pb.publish_links(approved, now, dictionary, aliases, by_person=False).collect()}
    assert got == {
        ("CAPABILITY", "s"): (True, "AUTO_APPROVED", 2, "updated"), ("CAPABILITY", "u"): (True, "OLD", 0, "kept"), ("INDUSTRY", "s"): (True, "OLD", 0, "kept"),
        ("INDUSTRY", "t"): (True, "AUTO_APPROVED", 5, "created"), ("SERVICE_REGION", "s"): (False, "AUTO_APPROVED", 0, "updated"),
    }
    assert sorted(tuple(r) for r in pb.publish_targets(approved).collect()) == [("s", "CHOOSE_CONTACTS", 2), ("s", "PUT_LOCATIONS", 1)]


def test_reviewed_by(spark):
    rows = [(1, "s", "A", "x"), (2, "s", "A", "x"), (3, "s", "A", None), (4, "t", "A", "x"), (5, "s", "B", "x")]
    claims = spark.createDataFrame([(*r, "UNREVIEWED") for r in rows], "claim_id long, supplier_id string, claim_type string, normalized_value string, review_state string")
    told = lambda actor, person: {r["claim_id"]: (r["review_state"], r["reviewed_by"]) for r in pb.reviewed(claims, claims.where("claim_id in (1, 3)"), actor, person).collect()}
    assert {k: v for k, v in told("usr_7", True).items() if v[1]} == {1: ("APPROVED", "usr_7"), 2: ("APPROVED", "usr_7"), 3: ("APPROVED", "usr_7")}
    assert told("SYSTEM_VALIDATOR", False)[2] == ("AUTO_APPROVED", None) and told("SYSTEM_VALIDATOR", False)[4] == ("UNREVIEWED", None)


@pytest.mark.parametrize(
    "url,place",
    [("https://a.ca/new-brunswick", "New Brunswick"), ("https://a.ca/locations/saint-john-nb", "Saint John NB"), ("https://a.ca/branches/bay_town.html", "Bay Town"), ("https://a.ca/pei/", "Prince Edward Island"), ("https://a.ca/contact", None), ("https://a.ca/locations", None), (None, None)],
)
def test_office_from_url(spark, url, place):
    assert spark.createDataFrame([(url,)], "u string").select(site.office_from_url(F.col("u")).alias("p")).first()["p"] == place


@pytest.mark.parametrize(
    "page,town",
    [("Upper Kent, NB 506-555-0101", "Upper Kent"), ("Far Cove, NS 902-777-1234 Upper Kent NB: (506) 555-0101", "Upper Kent"), ("Far Cove, NS 902-777-1234 call 506 555 0101", None), ("upper kent, NB 506-555-0101", None), ("Upper Kent, NB " + "x " * 90 + "506-555-0101", None), (None, None)],
)
def test_town_before_phone(spark, page, town):
    assert spark.createDataFrame([(page,)], "p string").select(site.town_before_phone(F.col("p"), F.lit("5065550101")).alias("t")).first()["t"] == town
