"""Listed services, structured contacts, the run of all extractors and the dictionary scanner."""

import re

import pytest
from pyspark.sql import functions as F

from quarry import taxonomy
from quarry.operators import engine as en
from quarry.operators import extract as ex
from quarry.operators import listed as ls
from quarry.operators.terms import Dictionary

NAMES = [
    ("Tank Lining & Relining", "Tank Lining & Relining", "Tank Lining & Relining"),
    ("DREDGE REPAIR AND HULL CARE", "Dredge Repair and Hull Care", "Dredge Repair and Hull Care"),
    ("  » Belt Splicing | ", "Belt Splicing", "Belt Splicing"),
    ("Belt Splicing in Port Elgin", "Belt Splicing", "Belt Splicing"),
    ("Marine", None, "Marine"),
    ("Marine Repairs", "Marine Repairs", "Marine Repairs"),
    *[(x, None, None) for x in ["Our Services", "Learn how", "belt splicing", "Why belts?", "We splice belts", "May 2019", "Best Belts", "Soudage à l'arc", "Head Office Crew", "The art of the belt", "4 belts", "ab", "Belts {x}", "A" * 61, "One two three four five six seven Eight", "'Belts'"]],
]


@pytest.mark.parametrize("raw,name,filed", NAMES)
def test_service_names(spark, raw, name, filed):
    row = spark.createDataFrame([(raw,)], "r string").select(ls.service_name(F.col("r")).alias("n"), ls.service_name(F.col("r"), True).alias("f")).first()
    assert (row["n"], row["f"]) == (name, filed)


def listed(spark, url, body, kind=None):
    page = spark.createDataFrame([(1, url, f"<html><head><title>T | x</title></head><body>{body}</body></html>", kind)], "page_id int, url string, html string, kind string")
    got = ls.listed_claims(ex.parse_pages(page), ["page_id"], F.col("kind")).orderBy("seq").collect()
    return [(r["claim_type"][:1], r["raw_value"], r["normalized_value"], r["confidence"]) for r in got]


def test_listed_links(spark):
    body = "<a href='/our-services/hull'>Hull Cleaning</a><a href='https://else.example/services/x'>Other Works</a><a href='/products/pump-line'>Slurry Pumps</a><a href='/products/p'>Pump 15a</a><a href='/x'>Plain Link</a>"
    assert listed(spark, "https://a.example/", body) == [("S", "Hull Cleaning", "hull-cleaning", 0.9), ("P", "Slurry Pumps", "slurry-pump", 0.9)]


def menu(label, items):
    links = "".join(f"<li><a href='{h}'>{t}</a></li>" for h, t in items)
    return f"<nav><ul><li><span>{label}</span><ul>{links}</ul></li></ul></nav>"


def test_listed_menus(spark):
    items = [("/a", "Belt Splicing"), ("/b", "Crane Hire"), ("/c", "Contact")]
    assert [x[1] for x in listed(spark, "https://a.example/", menu("What we offer", items))] == ["Belt Splicing", "Crane Hire"]
    assert listed(spark, "https://a.example/", menu("About us", items)) == []
    assert listed(spark, "https://a.example/", menu("Offers", [("/a", "Belt Splicing"), ("/b", "News"), ("/c", "Careers")])) == []
    assert [x[0] for x in listed(spark, "https://a.example/", menu("Product lines", items))] == ["P", "P"]


def test_listed_headings_collections_and_lists(spark):
    assert listed(spark, "https://a.example/services/hull", "<h1>HULL CARE</h1>") == [("S", "Hull Care", "hull-care", 0.9)]
    hub = listed(spark, "https://a.example/services", "<h2>Hull Cleaning</h2><h3>Recognized Know-How</h3><h4>Deep Things</h4>")
    assert hub == [("S", "Hull Cleaning", "hull-cleaning", 0.85), ("S", "Recognized Know-How", "recognized-know-how", 0.6)]
    assert listed(spark, "https://a.example/x", "<h1>Hull Cleaning | Yard</h1>", "PRODUCT") == [("P", "Hull Cleaning", "hull-cleaning", 0.85)]
    lines = "".join(f"<p>{x}</p>" for x in ["Dredging", "Estimating", "Budgeting", "Permitting"])
    assert [x[1] for x in listed(spark, "https://a.example/services", lines)] == ["Dredging", "Estimating", "Budgeting", "Permitting"]
    assert listed(spark, "https://a.example/services", lines.replace("Budgeting", "This line is a sentence.")) == [] and listed(spark, "https://a.example/other", lines) == []


def test_strings_at_any_depth():
    text = '{"a":"1","b":{"c":["x",{"D":"2"},{"e":{"f":"3"}}]},"g":[{"h":"4"}]}'
    assert [(k, v) for _, k, v in en.strings_of([text, "{broken", "[]", "7", None])] == [("a", "1"), ("h", "4"), ("f", "3"), ("d", "2")]
    assert list(en.strings_of(None)) == [] and list(en.strings_of(["[" * 100_000])) == []


def test_engine_keeps_errors_apart(spark):
    rows = [(1, "a", "ok"), (2, "a", "bad"), (3, "a", "OK "), (4, "b", "ok"), (5, "b", None)]
    pages = spark.createDataFrame(rows, "page_id int, crawl string, text string")

    def fragile(text):
        if text == "bad":
            raise KeyError("no text")
        return [("SERVICE_LISTED", text, text.strip(), None, None, None, 0.5), ("OTHER", "same", None, None, None, None, None)] if text else []

    declared = {
        "WHOLE": lambda p, keys: p.select(*keys, F.lit("OTHER").alias("claim_type"), F.lit(" Same").alias("raw_value")),
        "BROKEN": lambda p, keys: p.select("no_such_column"),
    }
    claims, errors = en.run_extractors(pages, ["page_id"], "crawl", declared, {"FRAGILE": (["text"], fragile)})
    got = sorted((r["page_id"], r["claim_type"], r["raw_value"], r["extractor"]) for r in claims.collect())
    assert got == [*[(i, "OTHER", " Same", "WHOLE") for i in (1,)], (1, "SERVICE_LISTED", "ok", "FRAGILE"), (2, "OTHER", " Same", "WHOLE"), (3, "OTHER", " Same", "WHOLE"), (4, "OTHER", " Same", "WHOLE"), (4, "SERVICE_LISTED", "ok", "FRAGILE"), (5, "OTHER", " Same", "WHOLE")]
    told = {(r["page_id"], r["extractor"]): r["error"] for r in errors.collect()}
    assert set(told) == {(2, "FRAGILE"), (None, "BROKEN")} and told[2, "FRAGILE"] == "KeyError: 'no text'" and "no_such_column" in told[None, "BROKEN"]
    none, no_errors = en.run_extractors(pages.limit(0), ["page_id"], "crawl", declared, {"FRAGILE": (["text"], fragile)})
    assert none.count() == 0 and [r["extractor"] for r in no_errors.collect()] == ["BROKEN"]


UNITS = [
    ("We do pipe welding and Pipe  Welding", "Pipe Welding", [("pipe welding", True), ("Pipe  Welding", True)]),
    ("structural and ornamental steel", "structural steel", [("structural and ornamental steel", False)]),
    ("fabrication of structural steel", "structural steel fabrication", [("fabrication of structural steel", False)]),
    ("Pipe & Fittings", "pipe fitting", []),
    ("pipe, fitting", "pipe fitting", []),
    ("(pipe fittings).", "pipe fitting", [("pipe fittings", False)]),
    ("steel is fabricated", "steel fabrication", []),
    ("fabricating steel", "steel fabrication", [("fabricating steel", False)]),
    ("subpipe welding", "pipe welding", []),
    ("weldable", "welding", []),
    ("welders, weld", "welding", [("welders", False), ("weld", False)]),
    ("", "welding", []),
]


@pytest.mark.parametrize("unit,phrase,found", UNITS)
def test_dictionary(unit, phrase, found):
    assert [(m["found"], m["exact"]) for m in Dictionary([phrase]).scan(unit)] == found
    assert all(unit[m["at"] - 1 :].startswith(m["found"]) for m in Dictionary([phrase]).scan(unit))


def test_one_scan_is_as_many(spark):
    """Scanning with the whole dictionary finds what each phrase finds by itself."""
    phrases = [p for _, p, _ in taxonomy.phrases()]
    text = " ".join(f"{p.lower()} of {q}, {q} and {p}." for p, q in zip(phrases, reversed(phrases), strict=True))
    whole = Dictionary(phrases, most_words=50).scan(text)
    alone = [m | {"i": i} for i, p in enumerate(phrases) for m in Dictionary([p]).scan(text)]
    assert whole == alone and len(whole) > 100


CONTEXTS = [
    ("we handle welding for the welding industry", "AUDIENCE"), ("Serving local welding shops", "AUDIENCE"), ("welding shops", "DIRECT"), ("We supply and install welding lines", "DIRECT"),
    ("We are suppliers of welding goods", "RESALE"), ("Suppliers of many goods and of things that matter to everyone here, also welding", "DIRECT"), ("parts and accessories for it and welding", "RESALE"),
    ("the harbour project included welding", "PROJECT_REFERENCE"), ("welding is a method", "EXPLANATION"), ("kits for welding", "PRODUCT_MENTION"), ("If you operate a welding shop", "AUDIENCE"),
]


@pytest.mark.parametrize("unit,context", CONTEXTS)
def test_contexts(spark, unit, context):
    at = unit.rindex("welding") + 1
    assert spark.range(1).select(ex.match_context(F.lit(unit), F.lit("welding"), F.lit(at))["context"].alias("c")).first()["c"] == context


def capability(spark, url, text, retail=None, title="", headings=()):
    page = spark.createDataFrame([(1, url, (title, [("h2", h) for h in headings], text))], "page_id int, url string, page struct<title:string,headings:array<struct<level:string,text:string>>,content_text:string>")
    got = ex.capability_claims(page, ["page_id"], taxonomy.phrases(), None if retail is None else F.lit(retail)).collect()
    return {r["normalized_value"]: (r["confidence"], r["evidence_locator"]) for r in got}


def test_capability_factors(spark):
    base = "https://a.example/x"
    assert capability(spark, base, "We do welding.") == {"welding": (0.85, "body_text")}
    assert capability(spark, base, "We do welding.\nMore welding.")["welding"] == (0.88, "body_text")
    assert capability(spark, base, "Welding, then welding")["welding"] == (0.88, "body_text")
    assert capability(spark, "https://a.example/services", "We do welding.")["welding"] == (0.95, "services_page_body")
    assert capability(spark, "https://a.example/news/x", "We do welding.")["welding"] == (0.68, "body_text")
    assert capability(spark, base, "We do welding.", retail=True)["welding"] == (0.638, "body_text")
    assert capability(spark, base, "We do ventilation.")["mechanical-hvac"] == (0.646, "body_text")
    assert capability(spark, base, "", headings=["Ventilation"])["mechanical-hvac"] == (0.855, "heading_h2")
    assert capability(spark, base, "We do not offer welding.") == {}


def test_no_pattern_is_lost():
    assert all(re.compile(p) for p in (ls.HOUSEKEEPING, ls.KIND_OF_WORK, ls.PRAISE_OR_PAPER))
