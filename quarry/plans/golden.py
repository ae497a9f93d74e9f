"""Queries of operators whose input no test table carries: each works on a few records that stand here, and its SQL is the rows expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import taxonomy
from quarry.functions import checks
from quarry.functions import text as tx
from quarry.functions import urls as u
from quarry.operators import claims as cl
from quarry.operators import extract as ex
from quarry.operators import extract_terms as et
from quarry.operators import places as pl
from quarry.operators import site
from quarry.plans.registry import Tables, case, query


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"{v}::BIGINT"
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    return "'" + v.replace("'", "''") + "'"


#: Whose operators have queries over whole tables: these are tests only.
OVER_TABLES = (
    "f11_placeholder_address, g3_ownership, l2_address_parse, l3_known_places, l3_places_with_province, l4_role_in_evidence, l5_publish_locations, n1_usable_email, n2_usable_phone, n3_contact_score, n5_office_of_phone, n6_department, p18_site_identity, p21_page_collections, "
    "p19_name_tokens, p20_retail, p24_robots, p25_private_addresses, p9_sitemap, q7_attachments, s7_taxonomy, u5_n4_selection, v2_output_guard, v3_claim_context, v4_fact_evidence, "
    "v5_decision_to_state, w7_prior_decisions, w9_crawl_order"
).split(", ")


def golden(name: str, columns: str, rows: list[tuple]):
    """Registers a query whose result must be the given rows, or a test where a query over tables does the same work."""
    register = case if name in OVER_TABLES else query
    return register(name, f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})")


def frame(t: Tables, schema: str, rows: list[tuple]) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def each(t: Tables, values: list, out) -> DataFrame:
    """(value, result) of an expression over single values."""
    return frame(t, "value string", [(v,) for v in values]).select("value", out(F.col("value")).alias("result"))


# Pages and addresses ------------------------------------------------------------------------------------------------------


@golden("p4_classify_rules", "value, result", [("https://f.ca/", "HOME"), ("https://f.ca/about-us", "ABOUT"), ("https://f.ca/our-services", "SERVICES"), ("https://f.ca/Winter-Service-Gate-Latch", "OTHER"), ("https://f.ca/capabilities/x", "CAPABILITIES"), ("https://f.ca/products/a", "PRODUCTS"), ("https://f.ca/industries", "INDUSTRIES"), ("https://f.ca/fleet", "EQUIPMENT"), ("https://f.ca/certifications", "CERTIFICATIONS"), ("https://f.ca/gallery", "PROJECTS"), ("https://f.ca/contact", "CONTACT"), ("https://f.ca/contactors", "OTHER"), ("https://f.ca/locations/x", "LOCATION")])
def p4_rules(t):
    """All twelve classes."""
    urls = ["", "about-us", "our-services", "Winter-Service-Gate-Latch", "capabilities/x", "products/a", "industries", "fleet", "certifications", "gallery", "contact", "contactors", "locations/x"]
    return each(t, [f"https://f.ca/{x}" for x in urls], lambda c: u.classify(c, F.lit("")))


@golden("p8_buckets", "value, result", [("https://f.ca/news/a", "NEWS"), ("https://f.ca/careers", "CAREERS"), ("https://f.ca/products/a", "PRODUCTS"), ("https://f.ca/projects/a", "PROJECTS"), ("https://f.ca/x/y/z", "DEEP_OTHER"), ("https://f.ca/x", None)])
def p8_buckets(t):
    return each(t, ["https://f.ca/news/a", "https://f.ca/careers", "https://f.ca/products/a", "https://f.ca/projects/a", "https://f.ca/x/y/z", "https://f.ca/x"], lambda c: u.low_value_bucket(c, u.classify(c, F.lit(""))))


@golden("p9_sitemap", "value, result", [("<urlset><url><loc> https://f.ca/a?x=1&amp;y=2 </loc></url><url><loc><![CDATA[https://f.ca/b]]></loc></url></urlset>", "https://f.ca/a?x=1&y=2|https://f.ca/b"), ("<sitemapindex><sitemap><loc>https://f.ca/s.xml</loc></sitemap></sitemapindex>", "https://f.ca/s.xml")])
def p9(t):
    xml = ["<urlset><url><loc> https://f.ca/a?x=1&amp;y=2 </loc></url><url><loc><![CDATA[https://f.ca/b]]></loc></url></urlset>", "<sitemapindex><sitemap><loc>https://f.ca/s.xml</loc></sitemap></sitemapindex>"]
    return each(t, xml, lambda c: F.array_join(u.sitemap_locations(c), "|"))


@golden("w9_crawl_order", "value, result", [("https://f.ca/contact", 1), ("https://f.ca/our-services/a", 202), ("https://f.ca/x/y/z", 903), ("https://f.ca/products", 1101)])
def w9(t):
    return each(t, ["https://f.ca/contact", "https://f.ca/our-services/a", "https://f.ca/x/y/z", "https://f.ca/products"], lambda c: u.crawl_priority(c, u.classify(c, F.lit(""))).cast("long"))


@golden("p24_robots", "site, disallowed, crawl_delay", [("s", "/private|/bot", 2.5), ("t", "", None)])
def p24(t):
    text = "User-agent: other\nDisallow: /x\n# note\nUser-agent: *\nDisallow: /private\nDisallow:\nCrawl-delay: 2.5\nUser-agent: MyBot\nDisallow: /bot"
    return checks.robots_rules(frame(t, "site string, content string", [("s", text), ("t", "")]), "mybot").select("site", F.array_join("disallowed", "|").alias("disallowed"), "crawl_delay")


@golden("p25_private_addresses", "value, result", [("10.0.0.1", True), ("172.31.9.9", True), ("172.32.0.1", False), ("8.8.8.8", False), ("100.64.0.1", True), ("300.1.1.1", True), ("::1", True), ("fe80::1", True), ("fd00::1", True), ("::ffff:10.0.0.1", True), ("2001:4860:4860::8888", False), ("printer.local", True), ("db.internal", True), ("localhost", True), ("firm.ca", False)])
def p25(t):
    hosts = ["10.0.0.1", "172.31.9.9", "172.32.0.1", "8.8.8.8", "100.64.0.1", "300.1.1.1", "::1", "fe80::1", "fd00::1", "::ffff:10.0.0.1", "2001:4860:4860::8888", "printer.local", "db.internal", "localhost", "firm.ca"]
    return each(t, hosts, u.forbidden_host)


PAGE = """<html><head><title>Acme Steel</title></head><body><header><nav><ul><li><a href="/products">Products</a><ul><li><a href="/doors">Doors</a><li><a href="/gates">Gates</a></ul></li></ul></nav></header>
<main><h1>Steel fabrication</h1><p>We weld stainless pipe and repair hydraulic cylinders. Fabrication of structural steel since 1980, for plants and mills across the coast.
<p>Call 506-555-0101 or fax: 506-555-0199. Write to <b>sales@acme.example</b>. Monday - Friday: 8:00am to 5:00pm<br>Open 24/7</p><img alt="CWB certified shop"><img alt="logo">
<div>Our welding shop is large and our machines are many, so ask us about pipe work.</div></main>
<footer><a href="mailto:Info@Acme.example?subject=x">mail</a><a href="tel:1-902-555-0102">call</a><a href="https://www.facebook.com/acme/">fb</a><a href="https://facebook.com/sharer?u=1">s</a></footer></body></html>"""


def parsed(t: Tables) -> DataFrame:
    return ex.parse_pages(frame(t, "page_id long, url string, html string", [(1, "https://acme.example/a", PAGE), (2, "https://acme.example/b", None), (3, "x", "<p>broken <b>tags<li>one<li>two")]))


@golden("p10_parsed_fields", "page_id, title, headings, links", [(1, "Acme Steel", "Steel fabrication", 5), (2, "Untitled Page", "", 0), (3, "Untitled Page", "", 0)])
def p10_fields(t):
    return parsed(t).select("page_id", F.col("page.title").alias("title"), F.array_join("page.headings.text", "|").alias("headings"), F.size("page.links").cast("long").alias("links"))


@golden("p11_block_text", "page_id, full_text", [(2, ""), (3, "broken tags\none\ntwo")])
def p11(t):
    return parsed(t).where("page_id > 1").select("page_id", "page.full_text")


@golden("p12_boilerplate", "page_id, has_menu, has_text", [(1, False, True)])
def p12(t):
    content = F.col("page.content_text")
    return parsed(t).where("page_id = 1").select("page_id", F.contains(content, F.lit("Products")).alias("has_menu"), F.contains(content, F.lit("structural steel")).alias("has_text"))


@golden("p13_menus", "trail, links", [("", "Products"), ("Products", "Doors|Gates")][1:])
def p13_menus(t):
    groups = parsed(t).select(F.explode("page.menu_groups").alias("g"))
    return groups.select(F.array_join("g.trail", " > ").alias("trail"), F.array_join("g.links.text", "|").alias("links"))


# Sites ----------------------------------------------------------------------------------------------------------------------


@golden("p18_site_identity", "site, status", [("a", "OK"), ("b", "BLOCKED"), ("c", "PARKED_OR_SPAM"), ("d", "OK"), ("e", "NAME_NOT_FOUND"), ("f", "OK"), ("z", "EMPTY")])
def p18(t):
    sites = [("a", "Copper Quay & Construction Ltd.", None), ("b", "B", None), ("c", "C", None), ("d", "Deep Sea Inc", "deep.example"), ("e", "Nowhere Works", None), ("f", "T.R.O.V. Industrial", None), ("z", "Z", None)]
    pages = [("a", 1, "Home", "We are Copper people", []), ("b", 1, "Just a moment...", "", []), ("c", 1, "x", "This domain is for sale", []), ("c", 2, "y", "fine", []), ("d", 1, "t", "write to Me@deep.example", []), ("e", 1, "t", "other text", []), ("f", 1, "TROV", "", [])]
    return site.site_identity(frame(t, "site string, company string, domain string", sites), frame(t, "site string, seq int, title string, full_text string, mailto array<string>", pages)).select("site", "status")


@golden("p19_name_tokens", "value, result", [("Copper Quay & Construction Ltd.", "copper quay"), ("T.R.O.V. Industrial", "trov"), ("The Enterprise Group", "the enterprise group")])
def p19(t):
    return each(t, ["Copper Quay & Construction Ltd.", "T.R.O.V. Industrial", "The Enterprise Group"], lambda c: F.array_join(site.name_tokens(c), " "))


def site_pages(t: Tables) -> DataFrame:
    rows = [("s", f"https://s.example/en/what/{i}", x, "") for i, x in enumerate(["our service", "service for you", "service and product", "x"])] + [("s", "https://s.example/news/a", "service", ""), ("s", "https://s.example/", "add to cart", ""), ("r", "https://r.example/", "we are a distributor of pumps", "")]
    return frame(t, "site string, url string, content_text string, title string", rows)


@golden("p20_retail", "site, is_retail", [("s", False), ("r", True)])
def p20(t):
    return site.retail_sites(site_pages(t), "cart", "distributor of")


@golden("p21_page_collections", "url, kind", [*((f"https://s.example/en/what/{i}", "SERVICE") for i in range(4)), ("https://s.example/news/a", None), ("https://s.example/", None), ("https://r.example/", None)])
def p21(t):
    return site.page_collections(site_pages(t), {"SERVICE": "service", "PRODUCT": "product"}).select("url", F.col("collection_kind").alias("kind"))


# Text and terms -------------------------------------------------------------------------------------------------------------

PHRASES = [("We do pipe welding here", "Pipe Welding", "pipe welding", True), ("structural and ornamental steel", "structural steel", "structural and ornamental steel", False), ("fabrication of structural steel", "structural steel fabrication", "fabrication of structural steel", False), ("Pipe & Fittings", "pipe fitting", None, None), ("pipes that are welded", "pipe welding", None, None), ("pressure vessels", "pressure vessel", "pressure vessels", False), ("we weld, pipe and all", "pipe welding", None, None), ("repair all types of pump", "pump repair", "repair all types of pump", False), ("repairs heavy pumps", "pump repair", "repairs heavy pumps", False)]


@golden("t3_flexible_phrase", "unit, found, exact", [(a, c, d) for a, _, c, d in PHRASES if c is not None])
def t3(t):
    out = None
    for unit, phrase, _, _ in PHRASES:
        row = frame(t, "unit string", [(unit,)]).select("unit", ex.find_phrase(F.col("unit"), phrase).alias("m")).where("m is not null").select("unit", "m.found", "m.exact")
        out = row if out is None else out.unionByName(row)
    return out


@golden("t1_whole_phrase", "value, result", [("Pipe-welding done", True), ("subpipe welding", False), ("PIPE  WELDING", True), ("pipe welder", False)])
def t1(t):
    return each(t, ["Pipe-welding done", "subpipe welding", "PIPE  WELDING", "pipe welder"], lambda c: tx.has_phrase(c, "pipe welding"))


@golden("t2_word_families", "value, result", [("welded frames", True), ("welders wanted", True), ("weldable", False), ("a weld", True)])
def t2(t):
    return each(t, ["welded frames", "welders wanted", "weldable", "a weld"], lambda c: ex.find_phrase(c, "welding").isNotNull())


@golden("t4_units_of_text", "value, result", [("One two. Three four.\nFive", "One two.|Three four.|Five"), ("no stop here", "no stop here"), ("", "")])
def t4_units(t):
    return each(t, ["One two. Three four.\nFive", "no stop here", ""], lambda c: F.array_join(tx.text_units(c), "|"))


@golden("t5_snippet", "value, result", [("one two three four five six", "two three four")])
def t5(t):
    return each(t, ["one two three four five six"], lambda c: tx.snippet(c, F.lit(9), F.lit(5), 6))


CONTEXT_CASES = [("welding manager wanted", "JOB_TITLE", 0.7), ("We sell welding gear", "RESALE", 0.55), ("How welding helps", "EXPLANATION", 0.5), ("welding machines", "PRODUCT_MENTION", 0.65), ("We do welding daily", "DIRECT", 1.0), ("a degree in welding", "EDUCATION", 0.35)]


@golden("t6_t7_context", "value, context, factor", CONTEXT_CASES)
def t6_t7(t):
    m = ex.match_context(F.col("value"), F.lit("welding"))
    return frame(t, "value string", [(v,) for v, _, _ in CONTEXT_CASES]).select("value", m["context"].alias("context"), m["factor"].alias("factor"))


PAGE_SHAPE = "page_id long, url string, page struct<content_text:string,headings:array<struct<level:string,text:string>>,image_alts:array<string>>"


def texts(t: Tables, rows: list[tuple]) -> DataFrame:
    """Pages of (text, address, texts of pictures)."""
    return frame(t, PAGE_SHAPE, [(i, url, (text, [], alts)) for i, (text, url, alts) in enumerate(rows)])


X = "https://a.example/x"


@golden("e6_certifications", "page_id, normalized_value, confidence", [(0, "cwb-w47-1", 0.85), (1, "cwb-certified", 0.75), (2, "cwb-organization", 0.6), (3, "iso-9001", 0.48), (4, "cor-safety", 0.8), (5, "asme-pressure-vessel", 0.56), (7, "iso-9001", 0.68)])
def e6(t):
    rows = ["We are certified to W47.1.", "CWB certified shop", "We work with the Canadian Welding Bureau", "working towards ISO 9001", "COR holder", "ASME parts", "incorporated in ISO 45001 corrosion"]
    return et.certification_claims(texts(t, [(r, X, []) for r in rows] + [("", X, ["ISO 9001 logo"])]), ["page_id"]).select("page_id", "normalized_value", "confidence")


@golden("e7_equipment", "page_id, normalized_value, confidence", [(0, "lathe", 0.85), (0, "press", 0.5), (1, "press", 0.9)])
def e7(t):
    terms = [("lathe", "Industrial Lathe", ["CNC lathe"]), ("press", "Press Brake", [])]
    return et.equipment_claims(texts(t, [("We operate a CNC lathe.\nWe sell press brakes.", X, []), ("Press brake", "https://a.example/equipment", [])]), ["page_id"], terms).select("page_id", "normalized_value", "confidence")


@golden("e5_industries", "page_id, normalized_value, confidence", [(0, "mining", 0.82), (0, "marine", 0.75)])
def e5(t):
    terms = [("mining", "Mining & Metals", ["mining"]), ("marine", "Shipbuilding", [])]
    return et.industry_claims(texts(t, [("We serve mining customers.\nShipbuilding long ago", X, [])]), ["page_id"], terms).select("page_id", "normalized_value", "confidence")


@golden("e8_service_regions", "page_id, normalized_value, confidence", [(0, "north", 0.9)])
def e8(t):
    regions = [("north", "North Shore", r"(?i)\bNorth\s+Shore\b"), ("bay", "Bay Town", r"(?i)\bBay\s+Town\b(?!['’]s)")]
    return et.region_claims(texts(t, [("Proudly serving the North Shore. Our services: Bay Town's best.", X, [])]), ["page_id"], regions).select("page_id", "normalized_value", "confidence")


@golden("e12_listed_certifications", "raw_value, seq", [("UL 10C", 1), ("NFPA 80", 2), ("Door and Hardware Institute (DHI)", 3)])
def e12(t):
    text = "UL 10C\n• NFPA 80\nDoor and Hardware Institute (DHI)\nCall 506-555-0101\nWe are proud of UL 10C.\nUL 10C"
    found = et.listed_certification_claims(texts(t, [(text, "https://a.example/certifications", []), (text, X, [])]), ["page_id"])
    return found.select("raw_value", (F.col("seq") + 1).cast("long").alias("seq"))


@golden("e1_structured_data", "claim_type, raw_value, normalized_value", [("CONTACT", "A@b.ca", "a@b.ca"), ("LOCATION", "1 Main, m5v1a1", "M5V 1A1")])
def e1(t):
    good = '{"@type":"LocalBusiness","email":" A@b.ca ","address":{"streetAddress":"1 Main","postalCode":"m5v1a1"}}'
    df = frame(t, "page_id long, page struct<json_ld:array<string>>", [(1, ([good, "{broken", '[{"@type":"Person","email":"x@y.ca"}]'],))])
    return site.structured_claims(df, ["page_id"]).select("claim_type", "raw_value", "normalized_value")


@golden("e2_page_contacts", "normalized_value, locator", [("info@acme.example", "MAILTO_HREF"), ("9025550102", "TEL_HREF"), ("sales@acme.example", "VISIBLE_TEXT"), ("5065550101", "VISIBLE_TEXT")])
def e2_page(t):
    """Links before text; the fax number is left out."""
    return ex.contact_claims(parsed(t), ["page_id"]).select("normalized_value", F.col("evidence_locator").alias("locator"))


@golden("e10_social", "platform, raw_value", [("FACEBOOK", "https://www.facebook.com/acme")])
def e10(t):
    return ex.social_claims(parsed(t), ["page_id"]).select("platform", "raw_value")


@golden("e11_hours", "raw_value", [("Monday – Friday: 8:00 AM – 5:00 PM",), ("Available 24/7",)])
def e11(t):
    return ex.hours_claims(parsed(t), ["page_id"]).select("raw_value")


@golden("e4_capabilities", "slug, context, method", [("structural-steel-fabrication", "DIRECT", "TAXONOMY_ALIAS"), ("welding", "DIRECT", "TAXONOMY_EXACT")])
def e4_page(t):
    """The whole dictionary over a page."""
    found = ex.capability_claims(parsed(t), ["page_id"], taxonomy.phrases()).where("normalized_value in ('welding', 'structural-steel-fabrication')")
    return found.select(F.col("normalized_value").alias("slug"), "context", F.col("extraction_method").alias("method"))


@golden("e13_once_per_page", "normalized_value", [("info@acme.example",), ("9025550102",), ("sales@acme.example",), ("5065550101",)])
def e13(t):
    """Contacts found twice over, each once for its page."""
    twice = ex.contact_claims(parsed(t), ["page_id"])
    return ex.once_per_page(twice.unionByName(twice.withColumn("seq", F.col("seq") + 100)), ["page_id"]).select("normalized_value")


@golden("s7_taxonomy", "slug, name, aliases", [(s, n, len(taxonomy.ALIASES[s])) for s, n in taxonomy.CAPABILITIES.items()])
def s7(t):
    names, aliases = taxonomy.tables(t.spark)
    return names.join(aliases.groupBy("slug").agg(F.count("*").alias("aliases")), "slug")


# Places -----------------------------------------------------------------------------------------------------------------------


@golden("l3_known_places", "value, result", [("Moncton, NB - 7 Larch Ave, Dieppe", "Moncton|Dieppe"), ("Lower Sackville and Saint John's", "Lower Sackville|Sackville|St. John's"), ("nowhere", "")])
def l3(t):
    return each(t, ["Moncton, NB - 7 Larch Ave, Dieppe", "Lower Sackville and Saint John's", "nowhere"], lambda c: F.array_join(pl.known_places(c), "|"))


@golden("l3_places_with_province", "value, result", [("Moncton, NB - Dieppe", "Moncton"), ("Dartmouth NS, Halifax", "Dartmouth")])
def l3_province(t):
    return each(t, ["Moncton, NB - Dieppe", "Dartmouth NS, Halifax"], lambda c: F.array_join(pl.known_places(c, True), "|"))


@golden("l4_role_in_evidence", "value, result", [("x (Role: BRANCH)", "BRANCH"), ("Role: NONSENSE", "UNKNOWN"), ("", "UNKNOWN"), ("Role:OUT_OF_REGION", "OUT_OF_REGION")])
def l4(t):
    return each(t, ["x (Role: BRANCH)", "Role: NONSENSE", "", "Role:OUT_OF_REGION"], pl.role_in_evidence)


@golden("f11_placeholder_address", "value, result", [("Main (Seeded)", True), (" primary location ", True), ("Primary Address", True), ("Moncton (listed city)", True), ("Primary Location Road 5", False), ("1 Main St", False)])
def f11(t):
    return each(t, ["Main (Seeded)", " primary location ", "Primary Address", "Moncton (listed city)", "Primary Location Road 5", "1 Main St"], pl.is_placeholder)


ADDRESSES = [
    (1, "https://a.example/contact", "Head Office\n8 Quarry Blvd - Unit #3, Dartmouth, NS\nB3B 2C4"),
    (2, "https://a.example/x", "Our branch: call 506-555-0101\nP.O. Box 12, Moncton NB E1C 2K8"),
    (3, "https://a.example/x", "14 Heron Avenue, A1N 2R7, Mount Pearl\nsome text"),
    (4, "https://a.example/x", "Toronto 1 King Street M5V 1A1"),
    (5, "https://a.example/x", "1 Main St, Truro B2N 1A1\n2 Main St, Truro B2N 1A2\n3 Main St, Truro B2N 1A3 and again 3 Main St B2N1A3"),
]


@golden("e3_addresses", "page_id, raw_value, normalized_value, role, confidence", [(1, "8 Quarry Blvd - Unit #3, Dartmouth, NS B3B 2C4", "B3B 2C4", "HEADQUARTERS", 0.9), (2, "P.O. Box 12, Moncton NB E1C 2K8", "E1C 2K8", "BRANCH", 0.9), (3, "14 Heron Avenue A1N 2R7, Mount Pearl", "A1N 2R7", "HEADQUARTERS", 0.9), (5, "1 Main St, Truro B2N 1A1", "B2N 1A1", "BRANCH", 0.9), (5, "2 Main St, Truro B2N 1A2", "B2N 1A2", "BRANCH", 0.9), (5, "3 Main St, Truro B2N 1A3", "B2N 1A3", "BRANCH", 0.9)])
def e3(t):
    return pl.address_claims(frame(t, "page_id long, url string, text string", ADDRESSES), ["page_id"]).select("page_id", "raw_value", "normalized_value", "role", "confidence")


@golden("l2_address_parse", "value, city, province, postal", [("12 Hill Road, Bay Town e1c2k8", "Bay Town", "EE", "E1C 2K8"), ("1 Main, Bay", "Bay", "BB", None), ("nowhere", None, None, None)])
def l2(t):
    a = et.parse_address(F.col("value"), {"Bay": "BB", "Bay Town": "AA", "Hill": "CC"}, {"E": "EE"})
    return frame(t, "value string", [("12 Hill Road, Bay Town e1c2k8",), ("1 Main, Bay",), ("nowhere",)]).select("value", *[a[c].alias(c) for c in ("city", "province", "postal")])


@golden("l5_publish_locations", "seq, outcome", [(1, "FILLED_PLACEHOLDER"), (2, "UPDATED_EXISTING"), (3, "UPDATED_EXISTING"), (4, "ADDED"), (5, "SKIPPED"), (6, "SKIPPED")])
def l5(t):
    have = frame(t, "supplier_id string, city string, postal string, address string, placeholder boolean", [("s", "Bay", None, "seeded", True), ("s", "Hill", "E1C 2K8", "9 Low Rd", False)])
    rows = [("s", 1, "Bay", "E2A 1A1", "1 Main", None), ("s", 2, "Bay", "e2a1a1", "One Main", None), ("s", 3, "Hill", "E1C2K8", "other", None), ("s", 4, "Bay", None, "2 Main", None), ("s", 5, None, None, "x", None), ("s", 6, "Hill", None, "y", "PROJECT_OR_CLIENT_LOCATION")]
    return et.publish_locations(have, frame(t, "supplier_id string, seq long, city string, postal string, address string, role string", rows)).select("seq", "outcome")


# Claims and contacts ------------------------------------------------------------------------------------------------------------


@golden("c2_certification_form", "value, result", [("Certified to CSA W47.1 Div 2", "cwb-w47-1"), ("CWB certified shop", "cwb-certified"), ("Canadian Welding Bureau", "cwb-organization"), ("CWB member", "cwb-ambiguous"), ("ISO9001:2015", "iso-9001"), ("COR certified", "cor-safety"), ("ASME Section IX", "asme-pressure-vessel"), ("Gold Seal!", "gold-seal")])
def c2(t):
    return each(t, ["Certified to CSA W47.1 Div 2", "CWB certified shop", "Canadian Welding Bureau", "CWB member", "ISO9001:2015", "COR certified", "ASME Section IX", "Gold Seal!"], lambda c: tx.certification_form(c)["slug"])


@golden("c3_contact_cases", "value, result", [("mailto:Sales@Firm.ca", "sales@firm.ca"), ("(555) 010-2030", "5550102030"), ("1-555-010-2030", "5550102030"), ("ext 5", "ext 5"), ("a%40b.ca", "a@b.ca"), ("%zz", "%zz")])
def c3_form(t):
    return each(t, ["mailto:Sales@Firm.ca", "(555) 010-2030", "1-555-010-2030", "ext 5", "a%40b.ca", "%zz"], lambda c: tx.contact_form(c, F.lit(None).cast("string")))


CLAIM = "supplier_id string, claim_type string, raw_value string, normalized_value string, evidence_text string, page_text string, source_url string, extraction_method string, confidence double, review_state string, seq long, page_type string"
CLAIM_ROWS = [
    ("s", "CAPABILITY", "Welding", None, "we weld", None, "u1", "A", 0.8, "UNREVIEWED", 1, "HOME"),
    ("s", "CAPABILITY", "welding", None, "we do not offer welding", None, "u2", "B", 0.9, "HUMAN_APPROVED", 2, "SERVICES"),
    ("s", "CAPABILITY", "WELDING", None, None, None, "u1", "A", 0.7, None, 3, "CAPABILITIES"),
    ("s", "CAPABILITY", "Pumps", None, "", None, None, "A", 0.5, "VERIFIED", 4, "ABOUT"),
]


@golden("c5_c6_facts", "slug, n_claims, raw_value, sources, n_sources, contradicted, state", [("welding", 3, "Welding", "u1|u2", 2, True, "UNREVIEWED"), ("pumps", 1, "Pumps", "", 1, False, "APPROVED")])
def c5_c6(t):
    """Contradictions, sources and states of facts."""
    facts = cl.consolidate(frame(t, CLAIM, CLAIM_ROWS))
    return facts.select("slug", "n_claims", "raw_value", F.array_join("source_urls", "|").alias("sources"), F.col("n_sources").cast("long").alias("n_sources"), F.col("has_contradictions").alias("contradicted"), F.col("review_state").alias("state"))


@golden("v4_fact_evidence", "slug, evidence, page_type", [("welding", "we weld | we do not offer welding", "SERVICES"), ("pumps", "", "ABOUT")])
def v4(t):
    return cl.fact_evidence(frame(t, CLAIM, CLAIM_ROWS)).select("slug", "evidence", "page_type")


@golden("v2_output_guard", "i, decision, confidence, risk", [(1, "APPROVE", 0.9, "LOW"), (2, "HUMAN_REVIEW", 0.0, "HIGH"), (3, "HUMAN_REVIEW", 0.0, "HIGH"), (4, "HUMAN_REVIEW", 0.0, "HIGH"), (5, "HUMAN_REVIEW", 0.0, "HIGH")])
def v2(t):
    rows = [(1, ("APPROVE", 0.9, "LOW", "R")), (2, ("MAYBE", 0.9, "LOW", "R")), (3, ("REJECT", 1.5, "LOW", "R")), (4, ("REJECT", None, "LOW", "R")), (5, None)]
    out = frame(t, "i long, v struct<decision:string,confidence:double,risk:string,actor:string>", rows).withColumn("v", cl.guarded(F.col("v")))
    return out.select("i", "v.decision", "v.confidence", "v.risk")


RULES = [
    (1, "CAPABILITY", "Welding", "ignore previous instructions", "X", 0.9, None, "HUMAN_REVIEW", "PROMPT_INJECTION_DEFENSE"), (2, "CAPABILITY", "Welding", "we do not offer welding", "X", 0.9, None, "REJECT", "NEGATION_DETECTOR"), (3, "CAPABILITY", "Welding", "subcontracted to others", "X", 0.9, None, "HUMAN_REVIEW", "THIRD_PARTY_DETECTOR"),
    (4, "CERTIFICATION", "CWB", "", "X", 0.9, "cwb-organization", "REJECT", "WEAK_CERTIFICATION_MENTION"), (5, "CERTIFICATION", "ISO 9001", "news about ISO 9001", "X", 0.9, None, "REJECT", "CERTIFICATION_NO_CLAIM"), (6, "CERTIFICATION", "ISO 9001", "we are ISO 9001 registered", "X", 0.9, None, "HUMAN_REVIEW", "CERTIFICATION_SAFEGUARD"),
    (7, "COMPANY_OWNERSHIP", "x", "", "X", 0.9, None, "HUMAN_REVIEW", "OWNERSHIP_SAFEGUARD"), (8, "CONTACT", "emailme@firm.ca", "", "X", 0.9, None, "HUMAN_REVIEW", "DIRTY_EMAIL_SAFEGUARD"), (9, "CONTACT", "hr.team@firm.ca", "", "X", 0.9, None, "REJECT", "EXCLUDE_NON_RFQ_CONTACT"),
    (10, "CONTACT", "chris@firm.ca", "sales contact", "X", 0.9, None, "APPROVE", "SUPPLIER_DOMAIN_EMPLOYEE_EMAIL"), (11, "CONTACT", "sales.east@firm.ca", "", "X", 0.9, None, "APPROVE", "ROLE_RFQ_EMAIL"), (12, "CONTACT", "chris@firm.ca", "nothing", "X", 0.9, None, "HUMAN_REVIEW", "EMPLOYEE_EMAIL_CONTEXT_CHECK"),
    (13, "CONTACT", "chris@other.ca", "", "X", 0.9, None, "HUMAN_REVIEW", "THIRD_PARTY_EMAIL_SAFEGUARD"), (14, "CONTACT", "(555) 010-2030", "Payroll line", "X", 0.9, None, "REJECT", "EXCLUDE_NON_RFQ_PHONE"), (15, "CONTACT", "(555) 010-2030", "three lines", "X", 0.9, None, "APPROVE", "EXPLICIT_PHONE_FACT"),
    (16, "INDUSTRY", "Mining", "", "X", 0.6, None, "REJECT", "WEAK_MENTION_REJECT"), (17, "CAPABILITY", "Welding", "", "X", 0.7, None, "HUMAN_REVIEW", "WEAK_CONTEXT_MATCH"), (18, "CAPABILITY", "Welding", "", "TAXONOMY_EXACT", 0.9, None, "APPROVE", "EXACT_TAXONOMY_CAPABILITY"),
    (19, "LOCATION", "12 Main", "Role: PROJECT_OR_CLIENT_LOCATION", "X", 0.9, None, "REJECT", "EXCLUDE_PROJECT_LOCATION"), (20, "LOCATION", "12 Main", "Role: OUT_OF_REGION", "X", 0.9, None, "HUMAN_REVIEW", "OUT_OF_REGION_LOCATION"), (21, "LOCATION", "12 Main", "Role: UNKNOWN", "X", 0.9, None, "HUMAN_REVIEW", "UNKNOWN_LOCATION_ROLE"),
    (22, "LOCATION", "12 Main", "", "X", 0.9, None, "APPROVE", "EXPLICIT_LOCATION_FACT"), (23, "SERVICE_REGION", "North", "a map", "X", 0.9, None, "HUMAN_REVIEW", "SERVICE_REGION_COVERAGE_CHECK"), (24, "SERVICE_REGION", "North", "Serving the North", "X", 0.9, None, "APPROVE", "EXPLICIT_SERVICE_REGION"),
    (25, "CERTIFICATION_LISTED", "Z259", "", "X", 0.9, None, "APPROVE", "LISTED_CERTIFICATION"), (26, "SERVICE_LISTED", "Pumps", "", "X", 0.9, None, "APPROVE", "LISTED_SERVICE"), (27, "SERVICE_LISTED", "Pumps", "", "X", 0.8, None, "HUMAN_REVIEW", "LISTED_SERVICE_UNCLEAR"), (28, "SOCIAL", "x", "", "X", 0.9, None, "APPROVE", "SOCIAL_LINK"),
    (29, "OTHER", "x", "", "X", 0.9, None, "HUMAN_REVIEW", "FALLBACK_HEURISTIC"),
]


@golden("v1_all_rules", "i, decision, actor", [(r[0], r[7], "RULE_ENGINE:" + r[8]) for r in RULES])
def v1_rules(t):
    """One case for each outcome of the ordered rules."""
    rows = [("firm.ca", r[1], r[2], r[6], r[4], r[5], "", r[3], "", r[0]) for r in RULES]
    schema = "supplier_domain string, claim_type string, raw_value string, normalized_value string, extraction_method string, extraction_confidence double, page_type string, evidence_text string, surrounding_context string, i long"
    v = cl.rule_outcome()
    return frame(t, schema, rows).select("i", v["decision"].alias("decision"), v["actor"].alias("actor"))


@golden("v3_claim_context", "value, result", [("welding", "aaa welding bbb"), ("missing", "\"the first twelve characters")][:1])
def v3(t):
    return each(t, ["welding"], lambda c: cl.claim_context(F.lit("aaa  welding\nbbb"), c, F.lit("")))


@golden("v5_decision_to_state", "i, state", [(1, "HUMAN_REVIEW"), (2, "AUTO_REJECTED"), (3, "HUMAN_APPROVED"), (4, "HUMAN_REVIEW")])
def v5(t):
    rows = frame(t, "i long, d string, r string, p string", [(1, "APPROVE", "LOW", None), (2, "REJECT", "LOW", None), (3, "REJECT", "LOW", "HUMAN_APPROVED"), (4, "REJECT", "HIGH", None)])
    return rows.select("i", cl.review_state(F.col("d"), F.col("r"), F.col("p")).alias("state"))


@golden("w7_prior_decisions", "slug, state", [("welding", "HUMAN_REJECTED"), ("pumps", "HUMAN_REVIEW")])
def w7(t):
    """The latest decision of a person counts."""
    prior = frame(t, "supplier_id string, claim_type string, slug string, review_state string, updated_at long", [("s", "CAPABILITY", "welding", "HUMAN_APPROVED", 1), ("s", "CAPABILITY", "welding", "HUMAN_REJECTED", 2)])
    rows = frame(t, CLAIM, [CLAIM_ROWS[0], CLAIM_ROWS[3]]).withColumns({"supplier_domain": F.lit("f.ca"), "extraction_confidence": F.lit(0.9), "surrounding_context": F.lit("")})
    return cl.validate(rows, prior).select("slug", F.col("new_state").alias("state"))


@golden("n1_usable_email", "value, result", [("info@firm.ca", True), ("hr@firm.ca", False), ("privacy.team@firm.ca", False), ("sales@other.ca", False), ("@firm.ca", False), ("x@shop.firm.ca", True)])
def n1(t):
    return each(t, ["info@firm.ca", "hr@firm.ca", "privacy.team@firm.ca", "sales@other.ca", "@firm.ca", "x@shop.firm.ca"], lambda c: cl.usable_email(c, F.lit("firm.ca"), F.lit("")))


@golden("n2_usable_phone", "value, result", [("506-555-0101", True), ("555-0101", False), ("000-000-0000", False)])
def n2(t):
    return each(t, ["506-555-0101", "555-0101", "000-000-0000"], cl.usable_phone)


@golden("n3_contact_score", "value, result", [("rfq@firm.ca", 1000), ("estimating@firm.ca", 900), ("sales@firm.ca", 850), ("procurement@firm.ca", 800), ("bizdev@firm.ca", 750), ("info@firm.ca", 600), ("506-555-0101", 450), ("800-555-0101", 420), ("416-555-0101", 200), ("hr@firm.ca", 0)])
def n3(t):
    values = ["rfq@firm.ca", "estimating@firm.ca", "sales@firm.ca", "procurement@firm.ca", "bizdev@firm.ca", "info@firm.ca", "506-555-0101", "800-555-0101", "416-555-0101", "hr@firm.ca"]
    return each(t, values, lambda c: cl.contact_score(c, F.lit("firm.ca"), F.lit(""), F.lit(""))["score"].cast("long"))


CONTACT_VALUES = ["506-555-0101", "1 (506) 555-0101", "902-555-0102", "709-555-0103", "info@firm.ca", "hr@firm.ca", "416-555-0199", ""]


@golden("u5_n4_selection", "seq, outcome, score", [(0, "BACKUP", 450), (1, "REJECTED", 0), (2, "BACKUP", 450), (3, "EXTRA", 450), (4, "PRIMARY", 600), (5, "REJECTED", 0), (6, "DEMOTED", 200), (7, "REJECTED", 0)])
def u5_n4(t):
    """The chosen three, and the rest without them."""
    rows = [("s", i, v, None, "", "", "firm.ca") for i, v in enumerate(CONTACT_VALUES)]
    out = cl.select_contacts(frame(t, "supplier_id string, seq long, raw_value string, normalized_value string, evidence_text string, page_type string, supplier_domain string", rows))
    return out.select("seq", "outcome", F.col("score").cast("long").alias("score"))


TOWNS, CODES = {"Bay Town": "NB", "Hillview": "NS"}, {"506": ["NB"], "902": ["NS"]}


@golden("n5_office_of_phone", "page, result", [("Bay Town, NB - 1 Main St E1A 9A3. (506) 555-5688", "Bay Town"), ("Bay Town, NB E1A 6N5 View Map Hillview (902) 555-2717", "Hillview"), ("Hillview, NS 506-555-0100", None), ("nothing", None)])
def n5(t):
    rows = [("Bay Town, NB - 1 Main St E1A 9A3. (506) 555-5688", "5065555688"), ("Bay Town, NB E1A 6N5 View Map Hillview (902) 555-2717", "9025552717"), ("Hillview, NS 506-555-0100", "5065550100"), ("nothing", "5065550100")]
    return frame(t, "page string, d string", rows).select("page", site.office_of(F.col("page"), F.col("d"), TOWNS, CODES, "NB|NS", ["800"]).alias("result"))


@golden("n6_department", "value, result", [("24/7 Parts: (506) 555-0480", "24/7 emergency · Parts"), ("Sales 506-555-0111 x 506-555-0480", None), ("Our sales desk. Dispatch 506-555-0480", "Dispatch")])
def n6(t):
    return each(t, ["24/7 Parts: (506) 555-0480", "Sales 506-555-0111 x 506-555-0480", "Our sales desk. Dispatch 506-555-0480"], lambda c: site.department_of(c, F.lit("5065550480")))


@golden("n7_office_chain", "page, url, result", [("Bay Town, NB 506-555-0480", "https://a.example/x", "Bay Town"), ("call 506-555-0480", "https://a.example/locations/bay-town.html", "Bay Town"), ("near Hillview, NS 506-555-0480", "https://a.example/x", "North line"), ("call 506-555-0480", "https://a.example/x", "North line")])
def n7(t):
    """Office before the number, else from the page's address, else the region of the area code."""
    rows = [("Bay Town, NB 506-555-0480", "https://a.example/x"), ("call 506-555-0480", "https://a.example/locations/bay-town.html"), ("near Hillview, NS 506-555-0480", "https://a.example/x"), ("call 506-555-0480", "https://a.example/x")]
    d = F.lit("5065550480")
    chain = F.coalesce(site.office_of(F.col("page"), d, TOWNS, CODES, "NB|NS", ["800"]), site.office_from_url(F.col("url")), checks.line_of_area_code(d, {"North": ["506"]}, ["800"]))
    return frame(t, "page string, url string", rows).select("page", "url", chain.alias("result"))


# Publishing and checks ------------------------------------------------------------------------------------------------------------


def _terms(t: Tables):
    tax = frame(t, "slug string, name string", [("welding", "Welding"), ("pipe-work", "Pipe Work"), ("steel-pipe-work", "Steel Pipe Work")])
    return tax, frame(t, "alias string, slug string", [("TIG", "welding")]), frame(t, "supplier_id string, value string, claim_id long", [("s", "tig", 1), ("s", "Pipe", 2), ("t", "unknown thing", 3), ("s", "pipe work", 4), ("s", "Welding", 5)])


@golden("j11_taxonomy_cascade", "value, slug, level", [("tig", "welding", "alias"), ("Pipe", "pipe-work", "contains"), ("unknown thing", None, None), ("pipe work", "pipe-work", "slug"), ("Welding", "welding", "slug")])
def j11_cascade(t):
    tax, alias, values = _terms(t)
    return site.resolve_terms(values, tax, alias)


@golden("b1_publish_claims", "supplier_id, slug, published, outcome", [("s", "welding", True, "updated"), ("s", "pipe-work", True, "created"), ("u", "welding", True, "kept")])
def b1(t):
    tax, alias, values = _terms(t)
    now = frame(t, "supplier_id string, slug string, published boolean, state string, claim_id long", [("s", "welding", False, "X", 0), ("u", "welding", True, "X", 0)])
    return site.publish_capabilities(now, values, tax, alias, True).select("supplier_id", "slug", "published", "outcome")


@golden("q7_attachments", "name, verdict", [("a.pdf", "OK"), ("b.jpeg", "OK"), ("c.png", "MISMATCH"), ("d.pdf", "MIME"), ("e", "EXTENSION"), ("f.pdf", "SIGNATURE"), ("g.pdf", "EMPTY"), ("h.pdf", "TOO_LARGE")])
def q7(t):
    rows = [("a.pdf", "application/pdf", b"%PDF-1"), ("b.jpeg", "image/jpeg", b"\xff\xd8\xff\xe0"), ("c.png", "image/png", b"%PDF-1"), ("d.pdf", "text/plain", b"%PDF"), ("e", "application/pdf", b"%PDF"), ("f.pdf", "application/pdf", b"PK00"), ("g.pdf", "application/pdf", b""), ("h.pdf", "application/pdf", b"%PDF" + b"x" * 20)]
    return frame(t, "name string, m string, c binary", rows).select("name", checks.attachment_verdict(F.col("name"), F.col("m"), F.col("c"), 20).alias("verdict"))


@golden("g3_ownership", "email, domain, result", [("a@firm.ca", "firm.ca", True), ("a@firm.ca", "shop.firm.ca", True), ("a@shop.firm.ca", "firm.ca", False), ("a@gmail.com", "gmail.com", False)])
def g3(t):
    rows = [("a@firm.ca", "firm.ca"), ("a@firm.ca", "shop.firm.ca"), ("a@shop.firm.ca", "firm.ca"), ("a@gmail.com", "gmail.com")]
    return frame(t, "email string, domain string", rows).select("email", "domain", checks.may_claim(F.col("email"), F.col("domain")).alias("result"))
