"""Queries of checks, normal forms, places and contacts over whole tables: the texts that they judge are made of the tables' own columns, or are the documents themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import taxonomy
from quarry.functions import checks
from quarry.functions import text as tx
from quarry.functions import urls as u
from quarry.operators import claims as cl
from quarry.operators import extract_terms as et
from quarry.operators import places as pl
from quarry.operators import site
from quarry.plans.administration import CLAIMS_SQL, facts_input
from quarry.plans.directory import HOST_SQL, PATH_SQL
from quarry.plans.registry import query


def pick(k: Column, values: list) -> Column:
    """The value in turn by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def pick_sql(k: str, values: list) -> str:
    """The same in SQL."""
    items = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({k}) % {len(values)} + 1]"


def key() -> Column:
    return F.col("c_custkey")


def nation() -> Column:
    return F.col("c_nationkey")


# Text -------------------------------------------------------------------------------------------------------------------------


@query("c5_negated_documents", "SELECT doc_id, coalesce(regexp_matches(text, '" + tx.NEGATION.replace("'", "''") + "'), false) AS negated FROM documents")
def c5(t):
    return t.documents.select("doc_id", tx.negated(F.col("text")).alias("negated"))


@query(
    "v3_document_context",
    r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g') AS flat, regexp_extract(text, '[a-z]{7,}') AS raw FROM documents), p AS (SELECT *, instr(lower(flat), raw) AS pos FROM d)
    SELECT doc_id, CASE WHEN raw <> '' AND pos > 0 THEN substr(flat, greatest(pos - 200, 1), pos + len(raw) + 200 - greatest(pos - 200, 1)) END AS context FROM p""",
)
def v3(t):
    """The words around the first long word of each document."""
    return t.documents.select("doc_id", cl.claim_context(F.col("text"), F.regexp_extract("text", "[a-z]{7,}", 0), F.lit(None).cast("string")).alias("context"))


CERTIFICATES = ["CSA W47.1 shop", "CWB certified", "Canadian Welding Bureau", "CWB", "ISO 9001:2015", "COR Certified", "ASME VIII", "Made for "]
CERTIFICATE_SLUGS = ["cwb-w47-1", "cwb-certified", "cwb-organization", "cwb-ambiguous", "iso-9001", "cor-safety", "asme-pressure-vessel", None]


@query("c2_certifications", f"SELECT p_partkey, coalesce({pick_sql('p_partkey', CERTIFICATE_SLUGS)}, 'made-for-' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g')) AS slug FROM part")
def c2(t):
    made = pick(F.col("p_partkey"), CERTIFICATES)
    return t.part.select("p_partkey", tx.certification_form(F.when(made == CERTIFICATES[-1], F.concat(made, "p_brand")).otherwise(made))["slug"].alias("slug"))


@query("p19_name_tokens", "SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' works' ELSE '' END AS tokens FROM customer")
def p19(t):
    """Names of segments with stop words, dotted initials and endings around them."""
    name = F.concat(F.lit("The "), F.initcap("c_mktsegment"), F.when(key() % 2 == 0, "'s Works & Co.").otherwise(" Group of A.B. Ltd."))
    told = F.regexp_replace(name, "'s", "")
    return t.customer.select("c_custkey", F.array_join(site.name_tokens(told), " ").alias("tokens"))


# Addresses of pages and hosts -------------------------------------------------------------------------------------------------


@query(
    "w9_crawl_order",
    rf"""WITH p AS (SELECT page_id, len(list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '')) AS depth, {HOST_SQL} AS host FROM pages)
    SELECT page_id, CASE WHEN host = '' OR depth > 0 THEN 900 ELSE 800 END + CASE WHEN host = '' THEN 9 ELSE depth END AS place FROM p""",
)
def w9(t):
    """Places of all pages in the order of a crawl; their addresses tell of home pages and others only."""
    return t.pages.select("page_id", u.crawl_priority(F.col("url"), u.classify(F.col("url"), F.lit(""))).cast("long").alias("place"))


@query(
    "p25_forbidden_hosts",
    """WITH a AS (SELECT o_orderkey, o_orderkey * 7 % 260 AS a, o_custkey % 256 AS b, o_orderkey % 256 AS c FROM orders)
    SELECT o_orderkey, a > 255 OR a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19))
      OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 AS forbidden FROM a""",
)
def p25(t):
    """Addresses of all kinds from orders' numbers."""
    part = lambda c: c.cast("string")
    ip = F.concat_ws(".", part(F.col("o_orderkey") * 7 % 260), part(F.col("o_custkey") % 256), part(F.col("o_orderkey") % 256), F.lit("1"))
    return t.orders.select("o_orderkey", u.forbidden_host(ip).alias("forbidden"))


@query("p25_page_hosts", f"SELECT page_id, {HOST_SQL} = '' AS forbidden FROM pages")
def p25_pages(t):
    return t.pages.select("page_id", u.forbidden_host(u.host(F.col("url"))).alias("forbidden"))


@query(
    "p24_robots",
    """SELECT c_custkey AS site, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/n' || c_nationkey || CASE WHEN c_custkey % 3 = 1 THEN '|/bot' ELSE '' END END AS disallowed, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey / 2 END AS crawl_delay FROM customer""",
)
def p24(t):
    """Files with comments, rules of other agents, empty rules and delays that can't be read."""
    n = nation().cast("string")
    every = F.concat(F.lit("# all\r\nUser-agent: other\nDisallow: /x\nUSER-AGENT: *\nDisallow: /n"), n, F.lit("\nDisallow:\n"))
    bot, slow = F.lit("User-agent: SomeBot/1\nDisallow: /bot\nCrawl-delay: soon"), F.concat(F.lit("Crawl-delay: "), (nation() / 2).cast("string"))
    content = F.when(key() % 3 == 0, "nothing here").when(key() % 3 == 1, F.concat(every, bot)).otherwise(F.concat(every, slow))
    return checks.robots_rules(t.customer.select(key().alias("site"), content.alias("content")), "somebot").select("site", F.array_join("disallowed", "|").alias("disallowed"), "crawl_delay")


@query(
    "p20_retail_sites",
    rf"""WITH p AS (SELECT {HOST_SQL} AS site, regexp_matches(html, '(?i)cart|shop') AS r, regexp_matches(html, '(?i)wholesale|distribut') AND {PATH_SQL} IN ('', '/') AS d FROM pages WHERE {HOST_SQL} <> '' AND html IS NOT NULL)
    SELECT site, bool_or(d) OR count(*) FILTER (r) >= 2 OR count(*) FILTER (r) / count(*) >= 0.4 AS is_retail FROM p GROUP BY 1""",
)
def p20(t):
    """Hosts of which two pages or 40 % speak of shops."""
    rows = t.pages.where(F.col("html").isNotNull()).select(F.regexp_replace(u.host(F.col("url")), r"^www\.", "").alias("site"), "url", F.col("html").alias("content_text"), F.lit("").alias("title")).where("site <> ''")
    return site.retail_sites(rows, "(?i)cart|shop", "(?i)wholesale|distribut")


# Places -----------------------------------------------------------------------------------------------------------------------

TOWNS = ["Moncton", "Dieppe", "Lower Sackville", "Saint John's", "Grand Falls-Windsor", "Halifax", "Port Hawkesbury"]
TOWNS_FOUND = ["Moncton", "Dieppe", "Lower Sackville|Sackville", "St. John's", "Grand Falls-Windsor|Windsor", "Halifax", "Port Hawkesbury"]
LAST_FOUND = [x.split("|")[0] for x in TOWNS_FOUND]
ADDRESSES = ["Main (Seeded)", " primary location ", "Primary Address", "Moncton (listed city)", "Primary Location Road", "Main St"]
ROLES = ["Role: BRANCH", "Role:OUT_OF_REGION", "Role: NONSENSE", "no role", None]
ROLES_FOUND = ["BRANCH", "OUT_OF_REGION", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


@query("l3_known_places", f"SELECT c_custkey, {pick_sql('c_custkey', TOWNS_FOUND)} || '|' || {pick_sql('c_nationkey', TOWNS_FOUND)} AS places FROM customer")
def l3(t):
    """Two towns in each text, some with towns inside their names."""
    text = F.concat(F.col("c_name"), F.lit(" of "), pick(key(), TOWNS), F.lit(", NB and Mainville, near "), F.upper(pick(nation(), TOWNS)))
    return t.customer.select("c_custkey", F.array_join(pl.known_places(text), "|").alias("places"))


@query("l3_with_province", f"SELECT c_custkey, {pick_sql('c_custkey', LAST_FOUND)} AS places FROM customer")
def l3_province(t):
    text = F.concat(pick(nation(), TOWNS), F.lit(" and "), pick(key(), TOWNS), F.lit(" N.B."))
    return t.customer.select("c_custkey", F.array_join(F.slice(pl.known_places(text, True), 1, 1), "|").alias("places"))


@query("l4_role_in_evidence", f"SELECT c_custkey, {pick_sql('c_custkey', ROLES_FOUND)} AS role FROM customer")
def l4(t):
    return t.customer.select("c_custkey", pl.role_in_evidence(F.concat(F.lit("12 Main ("), pick(key(), ROLES), F.lit(")"))).alias("role"))


@query("f11_placeholders", f"SELECT c_custkey, c_custkey % 6 < 4 AND (c_custkey % 6 IN (0, 3) OR c_nationkey % 2 = 0) AS placeholder FROM customer")
def f11(t):
    address = F.concat(pick(key(), ADDRESSES), F.when((nation() % 2 == 0) | (key() % 6).isin(0, 3), "").otherwise(" 5"))
    return t.customer.select("c_custkey", pl.is_placeholder(address).alias("placeholder"))


@query(
    "l2_address_parts",
    f"""SELECT c_custkey, {pick_sql('c_custkey', ['Bay Town', 'Bay', 'Hill', None])} AS city, CASE WHEN c_nationkey % 2 = 0 THEN 'EE' ELSE {pick_sql('c_custkey', ['AA', 'BB', 'CC', None])} END AS province,
    CASE WHEN c_nationkey % 2 = 0 THEN 'E1C ' || c_nationkey % 10 || 'K8' END AS postal FROM customer""",
)
def l2(t):
    """Towns that hold other towns' names, with and without postal codes."""
    text = F.concat(key().cast("string"), F.lit(" Hill's Road, "), pick(key(), ["Bay Town", "bay", "HILL", "Nowhere"]), F.when(nation() % 2 == 0, F.concat(F.lit(" e1c"), (nation() % 10).cast("string"), F.lit("k8"))).otherwise(""))
    a = et.parse_address(text, {"Bay": "BB", "Bay Town": "AA", "Hill": "CC"}, {"E": "EE"})
    return t.customer.select("c_custkey", *[a[c].alias(c) for c in ("city", "province", "postal")])


# Claims -------------------------------------------------------------------------------------------------------------------------


@query(
    "v2_output_guard",
    """WITH v AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'O' THEN 'REJECT' ELSE 'MAYBE' END AS decision, o_totalprice / 400000 AS confidence, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'MEDIUM' WHEN '3-MEDIUM' THEN 'LOW' WHEN '5-LOW' THEN 'NONE' END AS risk FROM orders),
    g AS (SELECT *, decision <> 'MAYBE' AND coalesce(risk, 'NONE') <> 'NONE' AND confidence BETWEEN 0 AND 1 AS sound FROM v)
    SELECT o_orderkey, CASE WHEN sound THEN decision ELSE 'HUMAN_REVIEW' END AS decision, CASE WHEN sound THEN confidence ELSE 0 END AS confidence, CASE WHEN sound THEN risk ELSE 'HIGH' END AS risk FROM g""",
)
def v2(t):
    """Verdicts of which some say what no verdict may."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    decision = F.when(status == "F", "APPROVE").when(status == "O", "REJECT").otherwise("MAYBE")
    risk = F.when(priority == "1-URGENT", "HIGH").when(priority == "2-HIGH", "MEDIUM").when(priority == "3-MEDIUM", "LOW").when(priority == "5-LOW", "NONE")
    verdict = F.struct(decision.alias("decision"), (F.col("o_totalprice") / 400_000).alias("confidence"), risk.alias("risk"), F.lit("MODEL").alias("actor"))
    return t.orders.withColumn("v", cl.guarded(verdict)).select("o_orderkey", "v.decision", "v.confidence", "v.risk")


@query(
    "v5_states",
    """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'HUMAN_APPROVED' WHEN o_orderpriority <> '5-LOW' OR o_orderstatus = 'P' THEN 'HUMAN_REVIEW' WHEN o_orderstatus = 'F' THEN 'HUMAN_REVIEW' ELSE 'AUTO_REJECTED' END AS state,
    CASE WHEN o_custkey % 4 = 0 THEN 'HUMAN_APPROVED' WHEN o_orderpriority <> '5-LOW' OR o_orderstatus = 'P' THEN 'HUMAN_REVIEW' WHEN o_orderstatus = 'F' THEN 'AUTO_APPROVED' ELSE 'AUTO_REJECTED' END AS open_state FROM orders""",
)
def v5(t):
    """States that verdicts lead to, with people's decisions kept; open_state where low risks are published."""
    decision = F.when(F.col("o_orderstatus") == "F", "APPROVE").when(F.col("o_orderstatus") == "O", "REJECT").otherwise("HUMAN_REVIEW")
    args = (decision, F.when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("HIGH"), F.when(F.col("o_custkey") % 4 == 0, "HUMAN_APPROVED"))
    return t.orders.select("o_orderkey", cl.review_state(*args).alias("state"), cl.review_state(*args, True).alias("open_state"))


def cited(t):
    """The capability claims, on pages of three types."""
    return facts_input(t).withColumn("page_type", pick(F.col("seq"), ["ABOUT", "SERVICES", "CAPABILITIES"]))


@query(
    "v4_fact_evidence",
    rf"""WITH {CLAIMS_SQL}, c AS (SELECT *, trim(regexp_replace(lower(raw_value), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {pick_sql('seq', ['ABOUT', 'SERVICES', 'CAPABILITIES'])} AS page_type, CASE WHEN seq % 9 = 0 THEN 'we do not offer this' ELSE 'offered' END AS said FROM claims WHERE claim_type = 'CAPABILITY')
    SELECT supplier_id, slug, string_agg(said, ' | ' ORDER BY seq) AS evidence, coalesce(arg_min(page_type, seq) FILTER (page_type <> 'ABOUT'), arg_min(page_type, seq)) AS page_type FROM c GROUP BY 1, 2""",
)
def v4(t):
    return cl.fact_evidence(cited(t)).select("supplier_id", "slug", "evidence", "page_type")


@query(
    "w7_prior_decisions",
    rf"""WITH {CLAIMS_SQL}, c AS (SELECT *, trim(regexp_replace(lower(raw_value), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM claims WHERE claim_type = 'CAPABILITY'),
    prior AS (SELECT supplier_id, slug, arg_max(CASE WHEN seq % 2 = 0 THEN 'HUMAN_APPROVED' ELSE 'HUMAN_REJECTED' END, seq) AS state FROM c WHERE review_state = 'UNREVIEWED' GROUP BY 1, 2)
    SELECT claim_id, coalesce(state, CASE WHEN seq % 9 = 0 THEN 'AUTO_REJECTED' ELSE 'HUMAN_REVIEW' END) AS state FROM c LEFT JOIN prior USING (supplier_id, slug)""",
)
def w7(t):
    """Claims under the latest decision on claims of the same fact; returned lines are the decisions."""
    rows = facts_input(t)
    decided = F.when(F.col("seq") % 2 == 0, "HUMAN_APPROVED").otherwise("HUMAN_REJECTED")
    slug = tx.fact_key(F.col("claim_type"), F.col("raw_value"), F.col("normalized_value"))
    prior = rows.where("review_state = 'UNREVIEWED'").select("supplier_id", "claim_type", slug.alias("slug"), decided.alias("review_state"), F.col("seq").alias("updated_at"))
    asked = rows.withColumns({"supplier_domain": F.lit("firm.ca"), "extraction_confidence": F.lit(0.9), "surrounding_context": F.lit(""), "page_type": F.lit("SERVICES")})
    return cl.validate(asked, prior).select("claim_id", F.col("new_state").alias("state"))


# Contacts -----------------------------------------------------------------------------------------------------------------------

LOCALS = ["rfq", "estimating", "sales", "procurement", "bizdev", "info", "hr", "privacy.team", ""]
SCORES = [1000, 900, 850, 800, 750, 600, 0, 0, 0]
HOSTS_SQL = "CASE c_nationkey % 3 WHEN 0 THEN 'firm.ca' WHEN 1 THEN 'shop.firm.ca' ELSE 'other.ca' END"


def mails(t):
    where = pick(nation(), ["firm.ca", "shop.firm.ca", "other.ca"])
    return t.customer.select(key().alias("seq"), (nation() % 5).alias("supplier_id"), F.concat(pick(key(), LOCALS), F.lit("@"), where).alias("mail"), F.col("c_acctbal").alias("balance"))


@query("n1_usable_emails", "SELECT c_custkey AS seq, c_custkey % 9 < 6 AND c_nationkey % 3 < 2 AS usable FROM customer")
def n1(t):
    return mails(t).select("seq", cl.usable_email(F.col("mail"), F.lit("www.firm.ca"), F.lit("")).alias("usable"))


@query(
    "n2_usable_phones",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN repeat((o_custkey % 10)::VARCHAR, 10) WHEN 1 THEN '1234567890' WHEN 2 THEN (o_custkey % 10000000)::VARCHAR ELSE '506555' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS d FROM orders)
    SELECT o_orderkey, len(d) = 10 AND d <> '1234567890' AND replace(d, d[1], '') <> '' AS usable FROM p""",
)
def n2(t):
    """Numbers of one digit, dummies, local ones, and ones with a country code."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    good = F.concat(F.lit("(506) 555-"), F.lpad((c % 10_000).cast("string"), 4, "0"))
    phone = F.when(k == 0, F.repeat((c % 10).cast("string"), F.lit(10))).when(k == 1, "+1 123-456-7890").when(k == 2, (c % 10_000_000).cast("string")).when(k == 3, good).otherwise(F.concat(F.lit("1-"), good))
    return t.orders.select("o_orderkey", cl.usable_phone(phone).alias("usable"))


@query("n3_contact_scores", f"SELECT c_custkey AS seq, CASE WHEN c_nationkey % 3 = 2 THEN 0 ELSE {pick_sql('c_custkey', SCORES)} END AS score FROM customer")
def n3(t):
    return mails(t).select("seq", cl.contact_score(F.col("mail"), F.lit("firm.ca"), F.lit(""), F.lit(""))["score"].cast("long").alias("score"))


@query(
    "u5_contact_selection",
    f"""WITH c AS (SELECT c_custkey AS seq, c_nationkey % 5 AS supplier_id, c_acctbal > 0 AS mail, CASE WHEN c_acctbal > 0 THEN {pick_sql('c_custkey', LOCALS)} || '@' || {HOSTS_SQL} ELSE {pick_sql('c_custkey', ['506', '800', '416'])} || '555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS v,
      CASE WHEN c_acctbal <= 0 THEN {pick_sql('c_custkey', [450, 420, 200])} WHEN c_nationkey % 3 = 2 THEN 0 ELSE {pick_sql('c_custkey', SCORES)} END AS s FROM customer),
    f AS (SELECT *, s > 0 AND row_number() OVER (PARTITION BY supplier_id, v ORDER BY s > 0 DESC, seq) = 1 AS ok FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY ok DESC, CASE WHEN ok THEN s ELSE 0 END DESC, seq) AS rn FROM f), b AS (SELECT *, min(rn) FILTER (ok AND mail) OVER (PARTITION BY supplier_id) AS best FROM r),
    i AS (SELECT *, ok AND CASE WHEN best > 3 THEN rn < 3 OR rn = best ELSE rn <= 3 END AS three FROM b), e AS (SELECT *, ok AND NOT three AND (mail OR s >= 400) AS more FROM i),
    x AS (SELECT *, sum(more::INT) OVER (PARTITION BY supplier_id ORDER BY rn) AS n FROM e)
    SELECT supplier_id, seq, CASE WHEN NOT ok THEN 'REJECTED' WHEN three AND rn = 1 THEN 'PRIMARY' WHEN three THEN 'BACKUP' WHEN more AND n <= 17 THEN 'EXTRA' ELSE 'DEMOTED' END AS outcome, CASE WHEN ok THEN s ELSE 0 END AS score FROM x""",
)
def u5(t):
    """Addresses and numbers of five suppliers, chosen from all customers."""
    number = F.concat(pick(F.col("seq"), ["506-555-", "(800) 555 ", "416.555."]), F.lpad((F.col("seq") % 10_000).cast("string"), 4, "0"))
    rows = mails(t).select("supplier_id", "seq", F.when(F.col("balance") > 0, F.col("mail")).otherwise(number).alias("raw_value"))
    none = {"normalized_value": F.lit(None).cast("string"), "evidence_text": F.lit(""), "page_type": F.lit(""), "supplier_domain": F.lit("firm.ca")}
    return cl.select_contacts(rows.withColumns(none)).select("supplier_id", "seq", "outcome", F.col("score").cast("long").alias("score"))


@query("g3_ownership", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN c_nationkey % 2 = 1 ELSE false END AS may FROM customer")
def g3(t):
    """Addresses of the company's domain, of one below or above it, of a free host and of none."""
    n = nation().cast("string")
    own = F.concat(F.when(nation() % 2 == 0, "").otherwise("sub."), F.lit("n"), n, F.lit(".example"))
    host = F.when(key() % 4 == 0, own).when(key() % 4 == 1, F.when(nation() % 2 == 0, F.concat(F.lit("sub."), own)).otherwise(F.concat(F.lit("N"), n, F.lit(".example")))).when(key() % 4 == 2, "gmail.com").otherwise("")
    return t.customer.select("c_custkey", checks.may_claim(F.concat(F.lit("me@"), host), own).alias("may"))


FILES = ["a.pdf", "b.JPEG", "c.png", "d.txt", None]


@query(
    "q7_attachments",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'EMPTY' WHEN o_totalprice > 450000 THEN 'TOO_LARGE' WHEN o_orderkey % 5 > 2 THEN 'EXTENSION' WHEN o_orderpriority = '5-LOW' THEN 'MIME' WHEN o_custkey % 4 = 3 THEN 'SIGNATURE'
    WHEN o_custkey % 4 <> o_orderkey % 5 THEN 'MISMATCH' ELSE 'OK' END AS verdict FROM orders""",
)
def q7(t):
    """Files of three kinds under names of three kinds and others; some are empty, large or of another type."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.unhex(pick(c, ["255044462D", "FFD8FFE000", "89504E470D", "504B0304"]))
    content = F.when((F.col("o_orderstatus") == "P") & (c % 2 == 0), F.unhex(F.lit(""))).when(F.col("o_totalprice") > 450_000, F.concat(start, F.encode(F.repeat(F.lit("x"), F.lit(40)), "utf-8"))).otherwise(start)
    mime = F.when(F.col("o_orderpriority") == "5-LOW", "text/plain").otherwise("Image/png")
    return t.orders.select("o_orderkey", checks.attachment_verdict(pick(k, FILES), mime, content, 40).alias("verdict"))


@query("s7_taxonomy_use", "SELECT slug, name, count(p_partkey) AS parts FROM (VALUES " + ", ".join(f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(taxonomy.CAPABILITIES.items())) + f") c(i, slug, name) LEFT JOIN part ON p_partkey % {len(taxonomy.CAPABILITIES)} = i GROUP BY 1, 2")
def s7(t):
    """The dictionary's terms with the parts that stand for them."""
    names, _ = taxonomy.tables(t.spark)
    parts = t.part.groupBy(pick(F.col("p_partkey"), list(taxonomy.CAPABILITIES)).alias("slug")).agg(F.count(F.lit(1)).alias("parts"))
    return names.join(parts, "slug", "left").select("slug", "name", F.coalesce("parts", F.lit(0)).alias("parts"))


# Sites and locations --------------------------------------------------------------------------------------------------------------

SEGMENTS = ["MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"]


@query(
    "p18_site_identity",
    f"""WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT s_suppkey AS site, {pick_sql('s_suppkey', SEGMENTS)} AS seg FROM supplier),
    p AS (SELECT s.site, c_custkey AS seq, c_nationkey % 5 = 3 AS b, c_mktsegment IN ('BUILDING', 'FURNITURE') AS k, c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AND c_mktsegment = seg AS f FROM customer, n JOIN s ON s.site = c_custkey % n WHERE c_acctbal >= 6000),
    g AS (SELECT site, arg_min(b, seq) AS b, count(*) FILTER (k) AS k, count(*) AS n, bool_or(f) AS f FROM p GROUP BY 1)
    SELECT s.site, CASE WHEN n IS NULL THEN 'EMPTY' WHEN b THEN 'BLOCKED' WHEN k > 0 AND 2 * k >= n THEN 'PARKED_OR_SPAM' WHEN f THEN 'OK' ELSE 'NAME_NOT_FOUND' END AS status FROM s LEFT JOIN g ON g.site = s.site""",
)
def p18(t):
    """Suppliers' sites with customers' pages, some empty, guarded, or for sale."""
    n = t.supplier.count()
    sites = t.supplier.select(F.col("s_suppkey").alias("site"), F.concat(F.lit("The "), pick(F.col("s_suppkey"), SEGMENTS), F.lit(" Co. Ltd.")).alias("company"), F.lit(None).cast("string").alias("domain"))
    text = F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "This domain is for sale").otherwise(F.concat(F.lit("We are "), F.lower("c_mktsegment"), F.lit(" people")))
    shown = F.col("c_acctbal") >= 6000
    title = F.when(nation() % 5 == 3, "Just a moment...").otherwise("Welcome")
    pages = t.customer.select((key() % n).alias("site"), key().alias("seq"), F.when(shown, title).otherwise("").alias("title"), F.when(shown, text).alias("full_text"), F.array().cast("array<string>").alias("mailto"))
    return site.site_identity(sites, pages)


@query(
    "p21_page_collections",
    """WITH p AS (SELECT c_custkey, c_nationkey AS site, c_custkey % 4 AS folder, c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') AS s, c_mktsegment IN ('HOUSEHOLD', 'BUILDING', 'FURNITURE') AS g FROM customer),
    f AS (SELECT site, folder, count(*) AS n, count(*) FILTER (s) AS s, count(*) FILTER (g) AS g FROM p GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT c_custkey, CASE WHEN f.s > f.g AND 2 * f.s >= n THEN 'SERVICE' WHEN f.g > f.s AND 2 * f.g >= n THEN 'PRODUCT' END AS kind FROM p LEFT JOIN f ON f.site = p.site AND f.folder = p.folder""",
)
def p21(t):
    """Folders of pages that speak of services, products or both."""
    words = F.when(F.col("c_mktsegment") == "BUILDING", "services and products").when(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE"), "our services").otherwise("our products")
    url = F.concat_ws("/", F.concat(F.lit("https://n"), nation().cast("string"), F.lit(".example")), F.concat(F.lit("what"), (key() % 4).cast("string")), F.concat(F.lit("p"), key().cast("string")))
    pages = t.customer.select("c_custkey", nation().alias("site"), url.alias("url"), words.alias("content_text"))
    return site.page_collections(pages, {"SERVICE": "service", "PRODUCT": "product"}).select("c_custkey", F.col("collection_kind").alias("kind"))


@query(
    "l5_publish_locations",
    """WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT c_custkey % n AS supplier_id, c_custkey AS seq, c_nationkey AS city, 'No. ' || c_custkey % 7 AS a, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 9 END AS p, c_custkey % 11 > 0 AND c_custkey % 13 > 0 AS ok FROM customer, n),
    e AS (SELECT *, min(seq) OVER (PARTITION BY supplier_id, a) < seq OR (p IS NOT NULL AND min(seq) OVER (PARTITION BY supplier_id, p) < seq) AS same FROM c WHERE ok),
    x AS (SELECT e.*, row_number() OVER (PARTITION BY supplier_id, city, same ORDER BY seq) = 1 AND city = s_nationkey AS fills FROM e JOIN supplier ON s_suppkey = supplier_id)
    SELECT c.supplier_id, c.seq, CASE WHEN same THEN 'UPDATED_EXISTING' WHEN fills THEN 'FILLED_PLACEHOLDER' WHEN same IS NOT NULL THEN 'ADDED' ELSE 'SKIPPED' END AS outcome FROM c LEFT JOIN x ON x.seq = c.seq""",
)
def l5(t):
    """Customers' addresses put into suppliers' locations, each of which begins as a placeholder."""
    n = t.supplier.count()
    have = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").cast("string").alias("city"), F.lit(None).cast("string").alias("postal"), F.lit("seeded").alias("address"), F.lit(True).alias("placeholder"))
    postal = F.when(key() % 3 == 0, F.concat(F.when(key() % 2 == 0, "E1A ").otherwise("e1a"), (nation() % 9).cast("string"), F.lit("B2")))
    rows = t.customer.select(
        (key() % n).alias("supplier_id"), key().alias("seq"), F.when(key() % 11 > 0, nation().cast("string")).alias("city"), postal.alias("postal"),
        F.concat(F.when(key() % 2 == 0, "No. ").otherwise(" no. "), (key() % 7).cast("string")).alias("address"), F.when(key() % 13 == 0, "PROJECT_OR_CLIENT_LOCATION").alias("role"),
    )
    return et.publish_locations(have, rows).select("supplier_id", "seq", "outcome")


DEPARTMENTS = ["24/7 Parts: ", "Sales 506-555-0111 x ", "Our sales desk. Dispatch "]
OFFICES = ["Bay Town, NB - 1 Main St E1A 9A3. ", "Hillview NS E1A 6N5 View Map Bay Town ", "Hillview, NS ", "nothing "]


def numbers(t):
    """Ten digits of each customer, and the same as written."""
    four = F.lpad((key() % 10_000).cast("string"), 4, "0")
    return t.customer.select("c_custkey", F.concat(F.lit("506777"), four).alias("digits"), F.concat(F.lit("(506) 777-"), four).alias("written"))


@query("n6_departments", f"SELECT c_custkey, {pick_sql('c_custkey', ['24/7 emergency · Parts', None, 'Dispatch'])} AS department FROM customer")
def n6(t):
    return numbers(t).select("c_custkey", site.department_of(F.concat(pick(key(), DEPARTMENTS), "written"), F.col("digits")).alias("department"))


@query("n5_offices", f"SELECT c_custkey, {pick_sql('c_custkey', ['Bay Town', 'Bay Town', None, None])} AS office FROM customer")
def n5(t):
    """Towns before numbers; one of another province than the number's is none."""
    page = F.concat(pick(key(), OFFICES), "written")
    return numbers(t).select("c_custkey", site.office_of(page, F.col("digits"), {"Bay Town": "NB", "Hillview": "NS"}, {"506": ["NB"], "902": ["NS"]}, "NB|NS", ["800"]).alias("office"))
