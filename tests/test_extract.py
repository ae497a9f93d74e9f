import pytest
from pyspark.sql import functions as F

from quarry.functions.html import read_page
from quarry.operators import extract as ex

PAGE = """<html><head><title>Acme Steel</title><meta property="og:type" content=" site "><link rel=canonical href="https://acme.example/"></head><body>
<header><nav><ul><li><a href="/products">Products</a><ul><li><a href="/doors">Doors</a><li><a href="/gates">Gates</a></ul></li></ul></nav></header>
<main><h1>Steel fabrication</h1><p>We weld stainless pipe and repair hydraulic cylinders. Fabrication of structural steel since 1980, for plants and mills across the coast.
<p>Call 506-555-0101 or fax: 506-555-0199. Write to <b>sales@acme.example</b>. Monday - Friday: 8:00am to 5:00pm<br>Open 24/7</p><img alt="CWB certified shop"><img alt="logo">
<script type="application/ld+json">{"a": 1}</script><div>Our welding shop is large and our machines are many, so ask us about pipe work.</div></main>
<footer><a href="mailto:Info@Acme.example?subject=x">mail</a><a href="tel:1-902-555-0102">call</a><a href="https://www.facebook.com/acme/">fb</a><a href="https://facebook.com/sharer?u=1">s</a></footer></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([(1, "https://acme.example/a", PAGE), (2, "https://acme.example/b", None), (3, "x", "<p>broken <b>tags<li>one<li>two")], "page_id int, url string, html string")
    return ex.parse_pages(pages).cache()


def test_read_page():
    p = read_page(PAGE, "https://acme.example/a")
    assert p["title"] == "Acme Steel" and p["open_graph"] == {"type": "site"} and p["canonical_url"] == "https://acme.example/"
    assert p["mailto"] == ["Info@Acme.example"] and p["tel"] == ["1-902-555-0102"] and p["json_ld"] == ['{"a": 1}']
    assert "Products" not in p["content_text"] and "Doors" in p["full_text"] and p["image_alts"] == ["CWB certified shop"]
    assert {"trail": ["Products"], "links": [{"href": "https://acme.example/doors", "text": "Doors"}, {"href": "https://acme.example/gates", "text": "Gates"}]} in p["menu_groups"]
    assert p["headings"] == [{"level": "h1", "text": "Steel fabrication"}]


def test_all_links_and_menus_of_a_page():
    links = "".join(f'<a href="/p{i}">p{i}</a>' for i in range(1_000))
    menus = "".join(f'<ul><li><a href="/m{i}">m</a><li><a href="/n{i}">n</a></ul>' for i in range(150))
    p = read_page(f"<body><nav>{menus}</nav><main>{links}</main></body>", "https://acme.example/")
    assert len(p["links"]) == 1_300 and p["links"][-1] == {"href": "https://acme.example/p999", "text": "p999"}
    assert len(p["menu_groups"]) == 150 and p["menu_groups"][-1]["links"][1]["href"] == "https://acme.example/n149"


def test_links_without_end_tags():
    """A link ends where the next one starts, so that the texts of many do not hold each other."""
    p = read_page("<body>" + "".join(f'<a href="/p{i}">p{i} ' for i in range(1_000)), "https://acme.example/")
    assert [x["text"] for x in p["links"]] == [f"p{i}" for i in range(1_000)]


def test_parse_pages(parsed):
    got = {r["page_id"]: r for r in parsed.collect()}
    assert got[2]["page"]["title"] == "Untitled Page" and got[2]["page"]["full_text"] == ""
    assert got[3]["page"]["full_text"].split("\n") == ["broken tags", "one", "two"]


def test_contacts(parsed):
    got = {(r["normalized_value"], r["evidence_locator"]) for r in ex.contact_claims(parsed, ["page_id"]).collect()}
    assert got == {("info@acme.example", "MAILTO_HREF"), ("9025550102", "TEL_HREF"), ("sales@acme.example", "VISIBLE_TEXT"), ("5065550101", "VISIBLE_TEXT")}


def test_social_and_hours(parsed):
    assert [(r["platform"], r["raw_value"]) for r in ex.social_claims(parsed, ["page_id"]).collect()] == [("FACEBOOK", "https://www.facebook.com/acme")]
    assert [r["raw_value"] for r in ex.hours_claims(parsed, ["page_id"]).orderBy("seq").collect()] == ["Monday – Friday: 8:00 AM – 5:00 PM", "Available 24/7"]


@pytest.mark.parametrize(
    "unit,phrase,found",
    [
        ("We do pipe welding here", "Pipe Welding", (True, "pipe welding")),
        ("structural and ornamental steel", "structural steel", (False, "structural and ornamental steel")),
        ("fabrication of structural steel", "structural steel fabrication", (False, "fabrication of structural steel")),
        ("Pipe & Fittings", "pipe fitting", None),
        ("pipes that are welded", "pipe welding", None),
        ("pressure vessels", "pressure vessel", (False, "pressure vessels")),
    ],
)
def test_find_phrase(spark, unit, phrase, found):
    m = spark.range(1).select(ex.find_phrase(F.lit(unit), phrase).alias("m")).first()["m"]
    assert (m and (m["exact"], m["found"])) == found


@pytest.mark.parametrize("unit,found,context", [("welding manager wanted", "welding", "JOB_TITLE"), ("We sell welding gear", "welding", "RESALE"), ("How welding helps", "welding", "EXPLANATION"), ("welding machines", "welding", "PRODUCT_MENTION"), ("We do welding daily", "welding", "DIRECT"), ("a degree in welding", "welding", "EDUCATION")])
def test_context(spark, unit, found, context):
    assert spark.range(1).select(ex.match_context(F.lit(unit), F.lit(found))["context"].alias("c")).first()["c"] == context


def test_capabilities(parsed):
    terms = [("welding", "welding", False), ("steel", "structural steel fabrication", False), ("pumps", "pump repair", True)]
    got = {r["normalized_value"]: r for r in ex.capability_claims(parsed, ["page_id"], terms).collect()}
    assert set(got) == {"welding", "steel"} and got["steel"]["context"] == "DIRECT" and got["steel"]["extraction_method"] == "TAXONOMY_EXACT"
    assert ex.once_per_page(ex.contact_claims(parsed, ["page_id"]), ["page_id"]).count() == 4
