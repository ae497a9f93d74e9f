"""Queries of the whole chain over pages: listed services, structured contacts, and all extractors in one run. Pages are built by Spark from the links of the given ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import taxonomy
from quarry.functions import urls as u
from quarry.operators import engine as en
from quarry.operators import extract as ex
from quarry.operators import extract_terms as et
from quarry.operators import listed as ls
from quarry.operators import places as pl
from quarry.operators import site
from quarry.plans.registry import query

REGIONS = [("north-shore", "North Shore", r"(?i)north shore"), ("valley", "Valley", r"(?i)valley")]
MACHINES = [("cnc-lathe", "CNC lathe", ["turning centre"]), ("press-brake", "Press brake", [])]
FIELDS = [("mining", "Mining", []), ("shipbuilding", "Shipbuilding", ["shipyards"])]


def links_of(t) -> DataFrame:
    """(page_id, url, host, words): the texts of the links of each page, as they stand in its source."""
    return t.pages.select("page_id", "url", u.host(F.col("url")).alias("host"), F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1)).alias("words"))


def _joined(words: Column | str, each) -> Column:
    return F.array_join(F.transform(words, each), "")


def offer_pages(t) -> DataFrame:
    """(page_id, url, html): the links of each given page put where companies list what they offer, by page_id in four ways: links into a folder of services, a labelled menu, headings of a services page, and short lines on one."""
    kind = F.pmod("page_id", F.lit(4))
    inside = (
        F.when(kind == 0, _joined("words", lambda w, i: F.concat(F.lit('<a href="/services/n'), i.cast("string"), F.lit('">'), w, F.lit("</a> "))))
        .when(kind == 1, F.concat(F.lit("<nav><ul><li><span>Range of goods and shop</span><ul>"), _joined("words", lambda w, i: F.concat(F.lit('<li><a href="/w/n'), i.cast("string"), F.lit('">Unit '), w, F.lit("</a></li>"))), F.lit("</ul></li></ul></nav>")))
        .when(kind == 2, _joined("words", lambda w: F.concat(F.lit("<h2>"), w, F.lit(" repairs</h2><p>text</p>"))))
        .otherwise(_joined("words", lambda w: F.concat(F.lit("<p>Line "), w, F.lit("</p>"))))
    )
    own = F.concat(F.lit("https://"), F.col("host"), F.when(kind >= 2, "/services").otherwise("/p"))
    return links_of(t).select("page_id", own.alias("url"), F.concat(F.lit("<html><head><title>x</title></head><body>"), inside, F.lit("</body></html>")).alias("html"))


def name_sql(name: str, filed: bool) -> str:
    """Whether a text reads like a service's name; the same wordings as the library's, as SQL."""
    words = lambda p: rf"(?i)\b(?:{p})\b".replace("'", "''")
    titles = ", ".join("'" + x.replace("'", "''") + "'" for x in ls.SECTION_TITLES)
    industry = "" if filed else rf" AND NOT (regexp_matches({name}, '(?i)^(?:{ls.INDUSTRY_NAME})\b') AND NOT regexp_matches({name}, '{words(ls.KIND_OF_WORK)}'))"
    return rf"""length({name}) BETWEEN 3 AND 60 AND len(string_split({name}, ' ')) <= 7 AND NOT regexp_matches({name}, '[?!.:;,]$|^\d|%%|[{{}}<>]|^[a-z]|^["''‘’“”]|@|_') AND regexp_matches({name}, '[A-Za-z]')
    AND NOT regexp_matches({name}, '(?i)^(?:{ls.CALL_TO_ACTION})\b') AND NOT regexp_matches({name}, '{words(ls.PRAISE_OR_PAPER)}') AND NOT regexp_matches({name}, '(?i){ls.FRENCH_LETTERS}')
    AND NOT regexp_matches({name}, '(?i)^(?:{ls.REGION})$') AND NOT regexp_matches({name}, '(?i)^{ls.MONTH_OR_YEAR}$') AND NOT regexp_matches({name}, '{words(ls.PRONOUN)}') AND NOT regexp_matches({name}, '{words(ls.PLACE_OR_OFFICE)}')
    AND len(regexp_extract_all({name}, '{words(ls.FUNCTION_WORD)}')) < 2 AND lower({name}) NOT IN ({titles}) AND regexp_replace(lower({name}), '^our\s+', '') NOT IN ({titles}){industry}"""


TITLE_SQL = "CASE WHEN name = upper(name) THEN name[1] || lower(name[2:]) ELSE name END"
KEY_SQL = r"regexp_replace(trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), 's\b', '', 'g')"
WORDS_SQL = rf"""links AS (SELECT page_id, url, w, i, n FROM (SELECT page_id, url, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS ws FROM pages))),
plain AS (SELECT page_id, i, n, trim(replace(replace(replace(w, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS w FROM links)"""
#: Marks around a name are taken off before it is judged.
BARE = r"regexp_replace({0}, '^[\s\-–—•·>»›|]+|[\s\-–—•·>»›|+]+$', '', 'g')"


@query(
    "e9_listed",
    rf"""WITH {WORDS_SQL}, named AS (SELECT page_id, i, n, w, {BARE.format("CASE page_id % 4 WHEN 0 THEN w WHEN 1 THEN 'Unit ' || w WHEN 2 THEN w || ' repairs' ELSE 'Line ' || w END")} AS raw FROM plain),
    judged AS (SELECT page_id, i, n, w, raw AS name, CASE WHEN page_id % 4 = 0 THEN {name_sql("raw", True)} ELSE {name_sql("raw", False)} END AS good FROM named),
    runs AS (SELECT * EXCLUDE n, CASE WHEN page_id % 4 = 3 THEN count(*) OVER (PARTITION BY page_id, run) ELSE n END AS n FROM (SELECT *, CASE WHEN page_id % 4 = 3 THEN breaks ELSE 0 END AS run
      FROM (SELECT *, page_id % 4 = 3 AND (regexp_matches(w, '[.!?]$') OR length(w) > 55 OR len(string_split(w, ' ')) > 5) AS breaks_here, sum(CASE WHEN regexp_matches(w, '[.!?]$') OR length(w) > 55 OR len(string_split(w, ' ')) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS breaks FROM judged) WHERE NOT breaks_here)),
    house AS (SELECT *, page_id % 4 = 1 AND regexp_matches(name, '(?i)\b(?:{ls.HOUSEKEEPING})\b') AND NOT regexp_matches(name, '(?i)\b(?:{ls.KIND_OF_WORK})\b') AS kept_out FROM runs),
    whole AS (SELECT page_id, run, any_value(n) AS n, count(*) FILTER (good AND NOT kept_out) AS names, count(*) FILTER (kept_out) AS outs FROM house GROUP BY page_id, run),
    found AS (SELECT page_id, {TITLE_SQL} AS name, i, page_id % 4 AS kind FROM house JOIN whole USING (page_id, run, n) WHERE good AND NOT kept_out
      AND (page_id % 4 IN (0, 2) OR (page_id % 4 = 1 AND n >= 2 AND names >= 2 AND names >= 0.6 * n AND outs <= 0.4 * n AND NOT regexp_matches(name, '\d')) OR (page_id % 4 = 3 AND n >= 4 AND names >= 0.7 * n))),
    keyed AS (SELECT page_id, kind, name, {KEY_SQL} AS key, i, CASE kind WHEN 0 THEN 0.9 WHEN 3 THEN 0.8 ELSE 0.85 END AS confidence FROM found)
    SELECT page_id, CASE WHEN kind = 1 THEN 'PRODUCT_LISTED' ELSE 'SERVICE_LISTED' END AS claim_type, arg_min(name, i) AS raw_value, replace(key, ' ', '-') AS normalized_value, max(confidence)::DOUBLE AS confidence FROM keyed GROUP BY page_id, kind, key""",
)
def e9(t):
    """Services and products that pages list, in links, menus, headings and lists."""
    found = ls.listed_claims(ex.parse_pages(offer_pages(t)), ["page_id"])
    return found.select("page_id", "claim_type", "raw_value", "normalized_value", "confidence")


@query(
    "e2_structured",
    """SELECT c_custkey, lower('Sales' || c_custkey || '@Shop' || (c_custkey % 100) || '.ca') AS normalized_value, 'JSON_LD' AS evidence_locator FROM customer
    UNION ALL SELECT c_custkey, '506' || (2000000 + c_custkey), 'JSON_LD' FROM customer WHERE c_custkey % 3 > 0
    UNION ALL SELECT c_custkey, '5065550100', 'TEL_HREF' FROM customer""",
)
def e2_structured(t):
    """Contacts from structured data at any depth, beside the links of the page."""
    number = F.format_string("(506) %s-%s", F.substring((F.col("c_custkey") + 2000000).cast("string"), 1, 3), F.substring((F.col("c_custkey") + 2000000).cast("string"), 4, 4))
    mail = F.format_string("Sales%d@Shop%d.ca", F.col("c_custkey"), F.col("c_custkey") % 100)
    deep = F.format_string('{"@type":"Shop","faxTelephone":"(506) 999-0000","at":[[{"desk":{"telephone":"%s"}},{"name":"x"}],{"k":{"k":{"k":{"Email":"%s"}}}}]}', F.when(F.col("c_custkey") % 3 > 0, number).otherwise("none"), mail)
    again = F.format_string('{"email":"mailto:%s","phone":"506.555.0100"}', mail)
    none = F.array().cast("array<string>")
    page = F.struct(none.alias("mailto"), F.array(F.lit("+1 506 555 0100")).alias("tel"), F.lit("").alias("full_text"), F.array(deep, F.lit("{not json"), again).alias("json_ld"))
    return ex.contact_claims(t.customer.select("c_custkey", page.alias("page")), ["c_custkey"]).select("c_custkey", "normalized_value", "evidence_locator")


#: The extractors in their order.
EXTRACTORS = {
    "JSON_LD": site.structured_claims,
    "CONTACT": ex.contact_claims,
    "ADDRESS": lambda p, keys: pl.address_claims(p.select(*keys, "url", F.col("page.full_text").alias("text")), keys),
    "CAPABILITY": lambda p, keys: ex.capability_claims(p, keys, taxonomy.phrases()),
    "INDUSTRY": lambda p, keys: et.industry_claims(p, keys, FIELDS),
    "CERTIFICATION": et.certification_claims,
    "EQUIPMENT": lambda p, keys: et.equipment_claims(p, keys, MACHINES),
    "SERVICE_REGION": lambda p, keys: et.region_claims(p, keys, REGIONS),
    "LISTED_SERVICE": ls.listed_claims,
    "SOCIAL_LINK": ex.social_claims,
    "BUSINESS_HOURS": ex.hours_claims,
    "LISTED_CERTIFICATION": et.listed_certification_claims,
}


def first_link(page: dict) -> list[tuple]:
    """A planted extractor: the text of a page's first link, which must not hold a hash sign."""
    text = page["links"][0]["text"] if page["links"] else ""
    if "#" in text:
        raise ValueError("unreadable link")
    return [("FIRST_LINK", text, text.lower(), None, None, "PAGE_STRUCTURE", 0.5)] if text else []


@query(
    "e13_engine",
    rf"""WITH {WORDS_SQL}, p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages),
    named AS (SELECT page_id, i, {BARE.format("w")} AS name FROM plain), good AS (SELECT page_id, i, {TITLE_SQL} AS name, {KEY_SQL} AS key FROM named WHERE {name_sql("name", True)}),
    once AS (SELECT page_id, key, arg_min(name, i) AS name, min(i) AS i FROM good GROUP BY 1, 2),
    ranked AS (SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM once),
    crawl AS (SELECT min(page_id) AS page_id, arg_min(name, page_id) AS name FROM ranked JOIN p USING (page_id) WHERE place <= 40 GROUP BY host, lower(name)),
    first AS (SELECT page_id, w FROM plain WHERE i = 1)
    SELECT page_id, 'SERVICE_LISTED' AS claim_type, lower(name) AS value FROM crawl
    UNION ALL SELECT page_id, 'CONTACT', 'info' || (page_id % 50) || '@shop.example.org' FROM p UNION ALL SELECT page_id, 'CONTACT', 'desk' || page_id || '@shop.example.org' FROM p
    UNION ALL SELECT page_id, 'SOCIAL', 'https://www.linkedin.com/company/c' || page_id FROM p
    UNION ALL SELECT page_id, 'BUSINESS_HOURS', 'mon – fri: 8 am – 5 pm' FROM p
    UNION ALL SELECT page_id, 'FIRST_LINK', lower(w) FROM first WHERE w <> '' AND NOT contains(w, '#') UNION ALL SELECT page_id, 'ERROR', 'valueerror: unreadable link' FROM first WHERE contains(w, '#')""",
)
def e13(t):
    """All twelve extractors and one that fails on some pages, in one run over all pages; a host is a crawl."""
    head = F.concat(F.lit('<html><head><title>x</title><script type="application/ld+json">{"@graph":[{"a":{"email":"desk'), F.col("page_id").cast("string"), F.lit('@shop.example.org"}}]}</script></head><body>'))
    links = _joined("words", lambda w, i: F.concat(F.lit('<a href="/services/n'), i.cast("string"), F.lit('">'), w, F.lit("</a> ")))
    tail = F.concat(F.lit('<a href="mailto:info'), (F.col("page_id") % 50).cast("string"), F.lit('@shop.example.org"></a><a href="https://www.linkedin.com/company/c'), F.col("page_id").cast("string"), F.lit('"></a><p>Mon to Fri 8 am to 5 pm</p></body></html>'))
    own = F.concat(F.lit("https://"), F.col("host"), F.lit("/p"))
    pages = ex.parse_pages(links_of(t).select("page_id", "host", own.alias("url"), F.concat(head, links, tail).alias("html")))
    pages = pages.select("page_id", "host", "url", "page").persist(StorageLevel.DISK_ONLY)
    claims, errors = en.run_extractors(pages, ["page_id"], "host", EXTRACTORS, {"FIRST_LINK": (["page"], first_link)})
    value = F.lower(F.when(F.col("claim_type") == "CONTACT", F.col("normalized_value")).otherwise(F.col("raw_value")))
    return claims.select("page_id", "claim_type", value.alias("value")).unionByName(errors.select("page_id", F.lit("ERROR").alias("claim_type"), F.lower("error").alias("value")))


@query(
    "n7_offices",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Bay Town' WHEN 1 THEN 'Saint John NB' WHEN 2 THEN 'Nova Scotia' WHEN 3 THEN 'Upper Kent' WHEN 4 THEN 'Hillview' END AS office,
    CASE c_custkey % 6 WHEN 0 THEN 'PAGE_TEXT' WHEN 1 THEN 'PAGE_URL' WHEN 2 THEN 'PAGE_URL' WHEN 3 THEN 'TOWN_BEFORE' WHEN 4 THEN 'EVIDENCE' END AS source FROM customer""",
)
def n7_offices(t):
    """Whose office the number of each customer is: by the page, the evidence, the page's address, or a town that no list knows."""
    towns, codes = {"Bay Town": "NB", "Hillview": "NS"}, {"506": ["NB"], "902": ["NS"]}
    kind = F.col("c_custkey") % 6
    code = F.when(kind == 4, "902").otherwise("506")
    local = F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0")
    number = F.concat(F.lit("("), code, F.lit(") 555-"), local)
    before = F.when(kind == 0, "Old Mill, NB 506 555 99990. Bay Town, NB - 1 Main St E1A 9A3. ").when(kind == 3, "Far Cove, NS 902-777-1234 fax; Upper Kent, NB, route 105 ").when(kind == 5, "Bay Town of old ").otherwise("call ")
    url = F.concat(F.lit("https://c.example"), F.when(kind == 1, "/locations/saint-john-nb").when(kind == 2, "/nova-scotia").otherwise("/contact"))
    evidence = F.when(kind == 4, F.concat(F.lit("Hillview, NS: "), number)).otherwise("")
    told = site.office_chain(F.concat(before, number), evidence, url, F.concat(code, F.lit("555"), local), towns, codes, "NB|NS", ["800"])
    return t.customer.select("c_custkey", told.alias("o")).select("c_custkey", "o.office", "o.source")


@query(
    "p18_identity",
    """SELECT c_custkey AS site, CASE WHEN c_custkey % 6 = 0 THEN 'EMPTY' WHEN c_custkey % 6 = 5 THEN 'PARKED_OR_SPAM' WHEN c_custkey % 6 = 4 THEN 'NAME_NOT_FOUND' ELSE 'OK' END AS status FROM customer""",
)
def p18_identity(t):
    """Whether each customer's pages name it: in the text, the open graph's site name or the structured data; some sites are empty, parked or of others."""
    kind = F.col("c_custkey") % 6
    name = F.concat(F.lit("Mill"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    sites = t.customer.select(F.col("c_custkey").alias("site"), F.concat(name, F.lit(" Industries Ltd.")).alias("company"), F.lit("www.mill.example").alias("domain"))
    said = lambda where: F.when(kind == where, F.concat(F.lit("welcome to "), F.upper(name), F.lit(" industries"))).otherwise("welcome to our industries")
    pages = t.customer.where(kind != 0).select(
        F.col("c_custkey").alias("site"), F.explode(F.lit([0, 1])).alias("seq"), F.when(kind == 5, "This domain is for sale").otherwise("Home").alias("title"), said(1).alias("full_text"), F.array().cast("array<string>").alias("mailto"),
        F.create_map(F.lit("site_name"), said(2)).alias("open_graph"), F.array(F.lit("{}"), F.concat(F.lit('{"name":"'), said(3), F.lit('"}'))).alias("json_ld"),
    )
    return site.site_identity(sites, pages)
