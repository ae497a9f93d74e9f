"""Queries of the directory's own operators: search, match scores, claims, contacts, requests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as u
from quarry.operators import claims as cl
from quarry.operators import links as lk
from quarry.operators import pages as pg
from quarry.operators import reports as rp
from quarry.operators import search as se
from quarry.plans.registry import Tables, query
from quarry.plans.relational import EDGES_SQL, LINES_SQL, RECIPIENTS_SQL, edges, recipients

# The directory over the driver's tables ------------------------------------------------------------------------------


def companies(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    rating = F.when(F.col("s_suppkey") % 3 == 0, "HIGH").when(F.col("s_suppkey") % 3 == 1, "MEDIUM").otherwise("LOW")
    return s.select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("s_acctbal") > -500, "PUBLISHED").otherwise("DRAFT").alias("profile_status"),
        F.when(F.col("s_suppkey") % 4 == 0, "CLAIMED").otherwise("UNCLAIMED").alias("claim_status"),
        F.when(F.col("s_suppkey") % 5 == 0, "VERIFIED").otherwise("UNVERIFIED").alias("verification_status"),
        rating.alias("contact_rating"),
        F.lower("n_name").alias("city"),
        F.lower("r_name").alias("province"),
    )


def capabilities(t: Tables) -> DataFrame:
    return edges(t).select(F.col("l_suppkey").alias("supplier_id"), F.col("p_brand").alias("slug"), F.col("p_brand").alias("name"), "published")


def certifications(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_linestatus").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    got = lines.groupBy("l_suppkey", "p_type").agg(F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("share"))
    return got.select(F.col("l_suppkey").alias("supplier_id"), F.col("p_type").alias("slug"), (F.col("share") > 0.5).alias("verified"))


COMPANY_SQL = """company AS (
  SELECT s_suppkey AS supplier_id, s_name AS name, s_acctbal > -500 AS live, s_suppkey % 4 = 0 AS claimed, s_suppkey % 5 = 0 AS verified,
         CASE s_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS rating, lower(n_name) AS city, lower(r_name) AS province
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TWO_BRANDS_SQL = "two AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_brand FROM part) ORDER BY p_brand LIMIT 3)"


def some_brands(t: Tables, n: int = 3) -> tuple[str, ...]:
    """The first brands by name: a fixed handful that the request names."""
    return tuple(r[0] for r in t.part.select("p_brand").distinct().orderBy("p_brand").limit(n).collect())


@query(
    "m1_directory_search",
    f"""WITH {EDGES_SQL}, {COMPANY_SQL}, {TWO_BRANDS_SQL},
    hit AS (SELECT supplier_id, name, rating FROM company WHERE live AND (contains(lower(name), '1') OR supplier_id IN (SELECT l_suppkey FROM edges WHERE published AND contains(lower(p_brand), '1')))
      AND supplier_id IN (SELECT l_suppkey FROM edges JOIN two USING (p_brand) WHERE published)),
    pub AS (SELECT l_suppkey AS supplier_id, count(*) FILTER (i = 1) AS b1, count(*) FILTER (i = 2) AS b2, count(*) FILTER (i = 3) AS b3 FROM edges JOIN two USING (p_brand) WHERE published GROUP BY 1)
    SELECT supplier_id, name, (SELECT count(*) FROM hit) AS total_count, b1 = 1 AND b2 = 1 AS eligible,
      round((35.0 / 2 * (b1 + b2) + 10.0 * b3 + CASE rating WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 0 END) / 50.0 * 100)::INT AS match_score
    FROM hit JOIN pub USING (supplier_id) ORDER BY name, supplier_id LIMIT 20""",
)
def m1(t):
    """Text, facet, paging and match score in one plan: children are reduced to keys before each join, and only the page is scored."""
    one, two, three = some_brands(t)
    caps = capabilities(t)
    f = se.Filters(q="1", capabilities=(one, two, three), page=1, page_size=20)
    page = se.page_of(se.search(companies(t), caps, f), f)
    nested = caps.join(F.broadcast(page.select("supplier_id")), "supplier_id").groupBy("supplier_id").agg(F.collect_list(F.struct("slug", "published")).alias("capabilities"))
    scored = se.match_score(page.join(nested, "supplier_id"), se.Criteria(required_capabilities=(one, two), preferred_capabilities=(three,)))
    return scored.select("supplier_id", "name", "total_count", "eligible", "match_score")


@query(
    "m2_match_score",
    f"""WITH {EDGES_SQL}, {COMPANY_SQL}, {TWO_BRANDS_SQL},
    cert AS (SELECT l_suppkey, p_type, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) > 0.5 AS ok FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    ct AS (SELECT min(p_type) AS p_type FROM part),
    pts AS (SELECT supplier_id, rating, city, province,
        (SELECT count(*) FROM edges JOIN two USING (p_brand) WHERE l_suppkey = supplier_id AND published AND i = 1) AS b1,
        (SELECT max(CASE WHEN ok THEN 1.0 ELSE 0.5 END) FROM cert JOIN ct USING (p_type) WHERE l_suppkey = supplier_id) AS c1 FROM company)
    SELECT supplier_id, b1 = 1 AND c1 IS NOT NULL AS eligible,
      round((35.0 * b1 + 25.0 * coalesce(c1, 0) + CASE WHEN city = 'nation_3' THEN 20.0 WHEN province = (SELECT lower(min(r_name)) FROM region) THEN 14.0 ELSE 0 END
        + CASE rating WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 0 END) / 85.0 * 100)::INT AS match_score FROM pts""",
)
def m2(t):
    """The relaxed score of every company: one capability, one certification, a place."""
    brand, = some_brands(t, 1)
    kind, region = t.part.agg(F.min("p_type")).first()[0], t.region.agg(F.min("r_name")).first()[0]
    caps = capabilities(t).where(F.col("slug") == brand).groupBy("supplier_id").agg(F.collect_list(F.struct("slug", "published")).alias("capabilities"))
    certs = certifications(t).where(F.col("slug") == kind).groupBy("supplier_id").agg(F.collect_list(F.struct("slug", "verified")).alias("certifications"))
    none = lambda c, fields: F.coalesce(c, F.array().cast(f"array<struct<{fields}>>"))
    rows = companies(t).join(caps, "supplier_id", "left").join(certs, "supplier_id", "left")
    rows = rows.withColumns({"capabilities": none(F.col("capabilities"), "slug:string,published:boolean"), "certifications": none(F.col("certifications"), "slug:string,verified:boolean"), "places": F.array(F.struct("city", "province"))})
    criteria = se.Criteria(required_capabilities=(brand,), required_certifications=(kind,), strict_certifications=False, city="nation_3", province=region)
    return se.match_score(rows, criteria).select("supplier_id", "eligible", "match_score")


@query(
    "n8_contact_confidence",
    """WITH c AS (SELECT c_nationkey AS supplier_id, CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE
        least(100, 20 + CASE WHEN c_custkey % 3 = 0 THEN 20 WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 65 ELSE 30 END ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN c_acctbal > 9000 THEN 20 ELSE 0 END) END AS p FROM customer),
    b AS (SELECT supplier_id, max(p) AS p FROM c GROUP BY 1)
    SELECT n_nationkey::BIGINT AS supplier_id, coalesce(p, 15)::BIGINT AS contact_score, CASE WHEN coalesce(p, 15) >= 80 THEN 'HIGH' WHEN coalesce(p, 15) >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS contact_rating
    FROM nation LEFT JOIN b ON supplier_id = n_nationkey""",
)
def n8(t):
    """Nations stand for companies and customers for their contacts."""
    k = F.col("c_custkey")
    contacts = t.customer.select(
        F.col("c_nationkey").cast("long").alias("supplier_id"),
        F.when(k % 3 == 0, "a@gmail.com").when(k % 3 == 1, "b@even.example").alias("email"),
        F.when(k % 5 == 0, "5065551234").alias("phone"),
        (F.col("c_acctbal") > 9000).alias("verified"),
        F.when(k % 4 == 0, F.lit("2024-01-01")).alias("bounced_at"),
    )
    firms = t.nation.select(F.col("n_nationkey").cast("long").alias("supplier_id"), F.when(F.col("n_nationkey") % 2 == 0, "www.even.example").otherwise("odd.example").alias("domain"))
    return se.contact_confidence(firms, contacts).select("supplier_id", F.col("contact_score").cast("long").alias("contact_score"), "contact_rating")


@query(
    "d9_duplicate_signals",
    """WITH c AS (SELECT c_custkey AS row_id, 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') AS n, c_nationkey AS k FROM customer),
    e AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier),
    s AS (SELECT row_id, 'name' AS signal, s_suppkey FROM c JOIN e ON lower(n) = lower(s_name)
      UNION ALL SELECT row_id, 'name_city', s_suppkey FROM c JOIN e ON k = s_nationkey AND contains(lower(s_name), lower(left(n, 5)))
      UNION ALL SELECT row_id, 'domain', s_suppkey FROM c JOIN e ON row_id = s_suppkey AND row_id % 3 = 0),
    g AS (SELECT row_id, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, min(s_suppkey) FILTER (signal <> 'name_city') AS matching_supplier FROM s GROUP BY 1)
    SELECT row_id, CASE WHEN contains(signals, 'domain') THEN 'UPDATE_CANDIDATE' WHEN signals IS NOT NULL THEN 'POSSIBLE_DUPLICATE' ELSE 'CREATE' END AS status, coalesce(signals, '') AS signals, matching_supplier
    FROM c LEFT JOIN g USING (row_id)""",
)
def d9(t):
    site = lambda k: F.when(k % 3 == 0, F.concat(F.lit("https://WWW.firm"), k.cast("string"), F.lit(".example/about")))
    rows = t.customer.select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"), site(F.col("c_custkey")).alias("website"),
        F.col("c_nationkey").cast("string").alias("city"), F.lit(None).cast("string").alias("phone"),
    )
    existing = t.supplier.select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), tx.domain_of(site(F.col("s_suppkey"))).alias("domain"), F.col("s_nationkey").cast("string").alias("city"), F.lit("").alias("phone")
    )
    out = se.duplicate_signals(rows, existing)
    return out.select("row_id", "status", F.array_join("signals", ",").alias("signals"), "matching_supplier")


# Claims -----------------------------------------------------------------------------------------------------------------

MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[a-z]+"


def mail_claims(t: Tables) -> DataFrame:
    """Addresses in the documents as contact claims of their source."""
    # An address stands in one word, so only words with the sign are searched.
    words = F.array_join(F.filter(F.split("text", " "), lambda w: F.contains(w, F.lit("@"))), " ")
    found = t.documents.where(F.contains("text", F.lit("@"))).select("doc_id", "source", F.posexplode(F.regexp_extract_all(words, F.lit(MAIL), F.lit(0))).alias("i", "raw_value"))
    return found.select(
        F.col("source").alias("supplier_id"), F.lit("CONTACT").alias("claim_type"), "raw_value", F.lit(None).cast("string").alias("normalized_value"), F.lit("").alias("evidence_text"), F.lit("").alias("page_text"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_url"), F.when(F.col("doc_id") % 2 == 0, "MAILTO").otherwise("TEXT").alias("extraction_method"),
        F.when(F.col("doc_id") % 2 == 0, 0.95).otherwise(0.9).alias("confidence"), F.when(F.col("doc_id") % 5 == 0, "AUTO_APPROVED").when(F.col("doc_id") % 3 == 0, "HUMAN_REVIEW").otherwise("UNREVIEWED").alias("review_state"),
        (F.col("doc_id") * 1000 + F.col("i")).alias("seq"), F.lit("").alias("page_type"), F.lit("mail.example.com").alias("supplier_domain"),
    )


MAIL_CLAIMS_SQL = rf"""raw AS (SELECT doc_id, source, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS i FROM (SELECT doc_id, source, regexp_extract_all(text, '{MAIL}') AS m FROM documents)),
mails AS (SELECT source AS supplier_id, v AS raw_value, lower(v) AS slug, 'doc:' || doc_id AS url, doc_id * 1000 + i AS seq, CASE WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN doc_id % 2 = 0 THEN 'MAILTO' ELSE 'TEXT' END AS method, CASE WHEN doc_id % 5 = 0 THEN 'AUTO_APPROVED' WHEN doc_id % 3 = 0 THEN 'HUMAN_REVIEW' ELSE 'UNREVIEWED' END AS state FROM raw)"""


@query(
    "c4_consolidate",
    f"""WITH {MAIL_CLAIMS_SQL} SELECT supplier_id, slug, count(*) AS n_claims, arg_min(raw_value, seq) AS raw_value, count(DISTINCT url) AS n_sources, max(confidence) AS strongest_confidence,
    CASE WHEN bool_or(state = 'AUTO_APPROVED') THEN 'AUTO_APPROVED' WHEN bool_or(state = 'HUMAN_REVIEW') THEN 'HUMAN_REVIEW' ELSE 'UNREVIEWED' END AS review_state, false AS has_contradictions FROM mails GROUP BY 1, 2""",
)
def c4(t):
    facts = cl.consolidate(mail_claims(t))
    return facts.select("supplier_id", "slug", "n_claims", "raw_value", F.col("n_sources").cast("long").alias("n_sources"), "strongest_confidence", "review_state", "has_contradictions")


@query(
    "v1_rules_engine",
    rf"""WITH {MAIL_CLAIMS_SQL} SELECT raw_value, seq, CASE WHEN split_part(low, '@', 1) LIKE 'email%' OR regexp_matches(low, '(phone|fax|tel)$') OR len(string_split(split_part(low, '@', 2), '.')) > 3
      OR NOT regexp_matches(low, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.(com|ca|org|net|edu|gov|io|co|biz|info)$') THEN 'RULE_ENGINE:DIRTY_EMAIL_SAFEGUARD' ELSE 'RULE_ENGINE:THIRD_PARTY_EMAIL_SAFEGUARD' END AS actor
      FROM (SELECT *, lower(raw_value) AS low FROM mails)""",
)
def v1(t):
    rows = mail_claims(t).withColumns({"surrounding_context": F.lit(""), "extraction_confidence": F.col("confidence"), "supplier_domain": F.lit("other.example")})
    return rows.select("raw_value", "seq", cl.rule_outcome()["actor"].alias("actor"))


@query(
    "v6_batch_stats",
    f"WITH {MAIL_CLAIMS_SQL} SELECT count(*) AS claims, count(DISTINCT supplier_id || ':' || slug) AS facts, count(*) - count(DISTINCT supplier_id || ':' || slug) AS collapsed FROM mails",
)
def v6(t):
    facts = cl.consolidate(mail_claims(t))
    return facts.agg(F.sum("n_claims").alias("claims"), F.count("*").alias("facts"), (F.sum("n_claims") - F.count("*")).alias("collapsed"))


@query(
    "v6_counters",
    f"""WITH {MAIL_CLAIMS_SQL}, f AS (SELECT supplier_id, slug, count(*) AS n, CASE length(slug) % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' ELSE 'HUMAN_REVIEW' END AS d, CASE WHEN length(slug) % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS r,
      CASE length(slug) % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'HUMAN_REJECTED' END AS p FROM mails GROUP BY 1, 2)
    SELECT supplier_id, sum(n)::BIGINT AS processed, count(*) AS facts, count(*) FILTER (p IS NULL AND d = 'APPROVE' AND r = 'LOW') AS auto_approved, count(*) FILTER (p IS NULL AND d = 'REJECT' AND r = 'LOW') AS auto_rejected,
      count(*) FILTER (p IS NULL AND (d = 'HUMAN_REVIEW' OR r = 'HIGH')) AS needs_review, count(*) FILTER (p = 'VERIFIED' OR (p IS NULL AND d = 'APPROVE' AND r = 'LOW')) AS published, (sum(n) - count(*))::BIGINT AS collapsed FROM f GROUP BY 1""",
)
def v6_counters(t):
    """The seven counters of each source's run, with verdicts and earlier decisions by the length of the address."""
    n = F.length("slug")
    facts = cl.consolidate(mail_claims(t)).select(
        "supplier_id", "n_claims", F.when(n % 3 == 0, "APPROVE").when(n % 3 == 1, "REJECT").otherwise("HUMAN_REVIEW").alias("decision"), F.when(n % 5 == 0, "HIGH").otherwise("LOW").alias("risk"),
        F.when(n % 7 == 0, "VERIFIED").when(n % 7 == 1, "HUMAN_REJECTED").alias("prior"),
    )
    return cl.batch_stats(facts, ["supplier_id"], publish_low_risk=True)


@query("n4_contact_selection")
def n4(t):
    """Contacts of each source, ranked and chosen."""
    claims = mail_claims(t).withColumn("supplier_domain", F.lit(None).cast("string")).withColumn("evidence_text", F.lit("contact"))
    return cl.select_contacts(claims).select("supplier_id", "seq", "value", "score", "kind", "outcome")


# Pages ------------------------------------------------------------------------------------------------------------------

HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"
PATH_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+([^?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '^[^?#]*(\?[^#]+)', 1)"


@query("p1_normalize_url", r"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '(\?utm_source=[^&#]*$)|([&]ref=[^&#]*$)', '') AS normalized FROM pages")
def p1(t):
    return t.pages.select("page_id", u.normalize_url(F.col("url")).alias("normalized"))


@query("p2_page_key", rf"SELECT page_id, {HOST_SQL} || CASE WHEN regexp_replace({PATH_SQL}, '/+$', '') = '' THEN '/' ELSE lower(regexp_replace(regexp_replace({PATH_SQL}, '/+$', ''), '/index\.(html?|php|aspx?)$', '')) END || {QUERY_SQL} AS page_key FROM pages")
def p2(t):
    return t.pages.select("page_id", u.page_key(F.col("url")).alias("page_key"))


@query("p3_same_site", rf"SELECT page_id, (h = 'example.com' OR h LIKE '%.example.com' OR 'example.com' LIKE '%.' || h) AS same FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)")
def p3(t):
    return t.pages.select("page_id", u.same_site(F.col("url"), F.lit("https://www.example.com/")).alias("same"))


@query("p4_classify", rf"SELECT page_id, CASE WHEN {PATH_SQL} IN ('/', '') THEN 'HOME' ELSE 'OTHER' END AS class FROM pages")
def p4(t):
    return t.pages.select("page_id", u.classify(F.col("url"), F.lit("")).alias("class"))


@query(
    "p5_crawlable",
    rf"""SELECT page_id, regexp_matches(url, '^https?:', 'i') AND (h = 'example.org' OR h LIKE '%.example.org') AND NOT regexp_matches(q, '[?&](sort|order|orderby|filter|view|lang|print|share|s|q|p|page_id|category|type|tag)=', 'i')
    AND len(list_filter(string_split(ltrim(q, '?'), '&'), lambda x: x <> '')) < 2 AND NOT regexp_matches(p, '/(fr|fr-ca|fr_ca|es)(/|$)', 'i') AS ok FROM (SELECT page_id, url, {HOST_SQL} AS h, {PATH_SQL} AS p, {QUERY_SQL} AS q FROM pages)""",
)
def p5(t):
    return t.pages.select("page_id", u.crawlable(F.col("url"), F.lit("https://example.org")).alias("ok"))


LINKS_SQL = rf"""link AS (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS seq, url FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)),
full_link AS (SELECT page_id, seq, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || href AS link, {HOST_SQL} || lower(regexp_replace(href, '/+$', '')) AS key, {HOST_SQL} || lower(regexp_replace({PATH_SQL}, '/+$', '')) AS own, href FROM link),
good AS (SELECT * FROM full_link WHERE NOT regexp_matches(href, '(?i){"|".join(u.NOT_A_PAGE)}'))"""


@query("p6_link_discovery", f"WITH {LINKS_SQL} SELECT page_id, key, arg_min(link, seq) AS link FROM good GROUP BY 1, 2")
def p6(t):
    """All pages of the same site that a page links to, once by page key."""
    return lk.site_links(t.pages, ["page_id"]).select("page_id", "key", "link")


CLASS_SQL = """CASE WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(about|company|who|history)') THEN 5 WHEN regexp_matches(lower(href), '(^|/)(our-)?([a-z]+-)?services?(-|$|/)') THEN 3 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(capabilit|expertise|specialt|what)') THEN 4
  WHEN regexp_matches(lower(href), '(^|[^a-z0-9])product') THEN 9 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(industr|markets|sectors)') THEN 8 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(equip|machin|facilit|fleet)') THEN 6 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(certif|quality|accreditation)') THEN 7
  WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(project|portfolio|gallery|work)') THEN 10 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(contact|contacts|contactus)([^a-z0-9]|$)') THEN 1 WHEN regexp_matches(lower(href), '(^|[^a-z0-9])(location|branch|office)|(^|[^a-z0-9])plants?([^a-z0-9]|$)') THEN 2 ELSE 12 END"""


@query(
    "p7_wanted_links",
    f"WITH {LINKS_SQL}, one AS (SELECT page_id, key, arg_min(link, seq) AS link, arg_min(href, seq) AS href, min(seq) AS seq FROM good WHERE key <> own GROUP BY 1, 2) SELECT page_id, link, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {CLASS_SQL}, len(list_filter(string_split(href, '/'), lambda x: x <> '')), seq) AS place FROM one) WHERE place <= 4",
)
def p7(t):
    """The four links of each page that are worth most."""
    return lk.wanted_links(t.pages, ["page_id"], most=4).select("page_id", "link", "place")


@query("p8_low_value_bucket", rf"SELECT page_id, CASE WHEN len(list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '')) >= 3 THEN 'DEEP_OTHER' END AS bucket FROM pages")
def p8(t):
    url = F.col("url")
    return t.pages.select("page_id", u.low_value_bucket(url, u.classify(url, F.lit(""))).alias("bucket"))


@query("p14_fingerprint", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS print FROM documents")
def p14(t):
    return t.documents.select("doc_id", pg.fingerprint(F.col("text")).alias("print"))


@query(
    "p15_duplicate_pages",
    r"SELECT source, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY source, sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')))",
)
def p15(t):
    rows = t.documents.select("source", "doc_id", "text", F.concat(F.lit("https://d.example/"), F.col("doc_id")).alias("url"))
    return pg.reject_duplicate_pages(rows, "source", "url", "text", "doc_id").select("source", "doc_id")


@query(
    "p17_repeated_line_removal",
    f"""WITH {LINES_SQL}, rep AS (SELECT lines.source, line FROM lines JOIN n ON lines.source = n.source WHERE n.docs >= 3 GROUP BY 1, 2, n.docs HAVING count(*) >= greatest(3, ceil(0.02 * n.docs))),
    cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    kept AS (SELECT doc_id, sum(length(l)) + count(*) - 1 AS chars FROM cut WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.source = cut.source AND rep.line = lower(trim(l))) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(chars, 0) END::BIGINT AS chars FROM documents d LEFT JOIN kept USING (doc_id)""",
)
def p17(t):
    """Documents of a source without the lines that stand on many of its pages."""
    out = pg.remove_repeated_lines(t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", share=0.02)
    return out.select("doc_id", F.length("text").cast("long").alias("chars"))


@query("t4_text_units")
def t4(t):
    return t.documents.select("doc_id", F.size(tx.text_units(F.col("text"))).alias("units"))


# Normal forms ---------------------------------------------------------------------------------------------------------


@query("c1_fact_key", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def c1(t):
    return t.part.select("p_partkey", tx.fact_key(F.lit("CAPABILITY"), F.col("p_name"), F.lit(None).cast("string")).alias("slug"))


@query("c3_contact_form", r"SELECT c_custkey, lpad((5060000000 + c_custkey)::VARCHAR, 10, '0') AS form FROM customer")
def c3(t):
    number = (F.lit(5060000000) + F.col("c_custkey")).cast("string")
    shown = F.concat(F.lit("+1 ("), F.substring(number, 1, 3), F.lit(") "), F.substring(number, 4, 3), F.lit("-"), F.substring(number, 7, 4))
    return t.customer.select("c_custkey", tx.contact_form(shown, F.lit(None).cast("string")).alias("form"))


@query("d1_normalizers", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages")
def d1(t):
    return t.pages.select("page_id", tx.domain_of(F.col("url")).alias("domain"))


@query("d8_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' & ' || p_brand)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM part")
def d8(t):
    return t.part.select("p_partkey", tx.name_slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query("g2_redaction", "SELECT event_id, props FROM (SELECT event_id, '{\"k\":\"' || (props->>'k') || '\",\"api_token\":\"[REDACTED]\"}' AS props FROM events)")
def g2(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", tx.redacted(F.to_json(F.struct(k.alias("k"), F.lit("x1").alias("api_token")))).alias("props"))


# Requests, threads and events ---------------------------------------------------------------------------------------------


@query(
    "q1_request_create",
    f"WITH {RECIPIENTS_SQL} SELECT o_orderkey, count(l_suppkey) AS suppliers, CASE WHEN o_totalprice <= 0 THEN 'MISSING_FIELD' WHEN count(l_suppkey) = 0 THEN 'NO_SUPPLIER' WHEN count(l_suppkey) > 5 THEN 'TOO_MANY' ELSE 'OK' END AS verdict FROM orders LEFT JOIN recipients ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice",
)
def q1(t):
    n = recipients(t).groupBy("l_orderkey").agg(F.count("*").alias("suppliers"))
    rows = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("suppliers", F.coalesce("suppliers", F.lit(0)))
    verdict = F.when(F.col("o_totalprice") <= 0, "MISSING_FIELD").when(F.col("suppliers") == 0, "NO_SUPPLIER").when(F.col("suppliers") > 5, "TOO_MANY").otherwise("OK")
    return rows.select("o_orderkey", "suppliers", verdict.alias("verdict"))


@query("q1a_cart", "SELECT o_custkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seq, l_suppkey) AS rn FROM (SELECT o_custkey, l_suppkey, min(l_orderkey) AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)) WHERE rn <= 20")
def q1a(t):
    first = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.min("l_orderkey").alias("seq"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("seq", "l_suppkey"))).where("rn <= 20").select("o_custkey", "l_suppkey")


@query("q2_buyer_requests", f"WITH {RECIPIENTS_SQL} SELECT o_custkey, o_orderkey, count(*) AS recipients, count(*) FILTER (status <> 'PENDING') AS responded FROM orders JOIN recipients ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def q2(t):
    n = recipients(t).groupBy("l_orderkey").agg(F.count("*").alias("recipients"), F.count_if(F.col("status") != "PENDING").alias("responded"))
    return t.orders.where("o_orderstatus <> 'P'").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "recipients", "responded")


@query("q3_quotes", "SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2))), 2)::DOUBLE AS quote FROM lineitem GROUP BY 1, 2")
def q3(t):
    amount = F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))), 2).cast("double")
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(amount.alias("quote"))


@query("q4_thread", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' ORDER BY conv_id, turn")
def q4(t):
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("q5_delivery_fold", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'error') AS bounced FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1")
def q5(t):
    seen = t.events.where(F.col("event_type").isin("signup", "purchase", "error"))
    return seen.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("bounced"))


@query("g1_access", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def g1(t):
    """Requests a user may see: those of the user's organization, or those addressed to the user's company."""
    mine = t.orders.join(F.broadcast(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi").select("o_orderkey")
    addressed = t.lineitem.where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return mine.unionByName(addressed.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")).distinct()


@query("x3_stale_jobs", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE THEN 'PENDING' ELSE upper(event_type) END AS status FROM events")
def x3(t):
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES")
    return t.events.select("event_id", F.when((F.col("event_type") == "view") & (F.col("ts") < cutoff), "PENDING").otherwise(F.upper("event_type")).alias("status"))


# Reports --------------------------------------------------------------------------------------------------------------------


@query(
    "r9_funnel",
    "SELECT count(*) FILTER (event_type = 'view') AS viewed, count(*) FILTER (event_type = 'click') AS clicked, count(*) FILTER (event_type = 'purchase') AS quoted, count(*) FILTER ((props->>'k')::INT > 50) AS flagged, round(100.0 * count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 1)::DOUBLE AS click_rate FROM events",
)
def r9(t):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    out = t.events.agg(kind("view").alias("viewed"), kind("click").alias("clicked"), kind("purchase").alias("quoted"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("flagged"))
    return out.withColumn("click_rate", F.round(100.0 * F.col("clicked") / F.nullif(F.col("viewed"), F.lit(0)), 1))


_FUNNEL_SQL = """SELECT user_id, CASE event_type WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'supplier_search' ELSE 'profile_view' END WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'add_to_rfq' ELSE 'rfq_create' END
  WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'rfq_send' ELSE 'email_delivery' END WHEN 'signup' THEN 'supplier_response' ELSE 'profile_claim' END AS e, k % 3 = 0 AS interested FROM (SELECT user_id, event_type, (props->>'k')::INT AS k FROM events)"""


@query(
    "r9_market_funnels",
    f"""WITH e AS ({_FUNNEL_SQL}), n AS (SELECT user_id, {", ".join(f"count(*) FILTER (e = '{event}') AS {step}" for step, event in rp.FUNNEL_EVENTS.items())}, count(*) FILTER (e = 'supplier_response' AND interested) AS interested_responses FROM e GROUP BY 1)
    SELECT *, CASE WHEN searches > 0 THEN printf('%.1f%%', 100.0 * requests_sent / searches) ELSE '0.0%' END AS conversion_rate, CASE WHEN emails_delivered > 0 THEN printf('%.1f%%', 100.0 * responses_received / emails_delivered) ELSE '0.0%' END AS response_rate FROM n""",
)
def r9_market_funnels(t):
    """The nine counts and two rates of each user's events."""
    k = F.get_json_object("props", "$.k").cast("int")
    two = lambda even, odd: F.when(k % 2 == 0, even).otherwise(odd)
    kind = F.col("event_type")
    name = F.when(kind == "view", two("supplier_search", "profile_view")).when(kind == "click", two("add_to_rfq", "rfq_create")).when(kind == "purchase", two("rfq_send", "email_delivery")).when(kind == "signup", "supplier_response").otherwise("profile_claim")
    metadata = F.when(k % 3 == 0, '{"status":"INTERESTED"}').when(k % 3 == 1, '{"status":"DECLINED"}').otherwise("not json")
    return rp.market_funnels(t.events.select("user_id", name.alias("event_type"), metadata.alias("metadata")), ["user_id"])


@query("r10_draft_count", "SELECT count(*) FILTER (s_acctbal <= 0) AS drafts FROM supplier")
def r10(t):
    return t.supplier.agg(F.count_if(F.col("s_acctbal") <= 0).alias("drafts"))
