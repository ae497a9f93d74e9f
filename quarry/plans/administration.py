"""Queries of profiles, administration and reports over the driver's tables, with SQL twins.

Stand-ins: a supplier is a company and its nation the listed city; a line of an order is a claim of its supplier, whose part tells type and value; orders are crawl runs of a supplier; customers are contacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import admin as ad
from quarry.operators import profile as pr
from quarry.operators import reports as rp
from quarry.operators.search import duplicate_signals
from quarry.plans.registry import Tables, query
from quarry.plans.relational import EDGES_SQL, edges

# Stand-ins --------------------------------------------------------------------------------------------------------------

CLAIMS_SQL = """line AS (SELECT l_suppkey AS supplier_id, l_orderkey * 8 + l_linenumber AS seq, min(l_partkey) AS pk, min(l_returnflag) AS flag, l_orderkey % 5 AS page FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
claims AS (SELECT supplier_id, seq, supplier_id || '-' || seq AS claim_id, 'https://s' || supplier_id || '.example/p' || page AS source_url,
  CASE flag WHEN 'A' THEN 'AUTO_APPROVED' WHEN 'N' THEN 'APPROVED' ELSE 'UNREVIEWED' END AS review_state,
  CASE pk % 6 WHEN 0 THEN 'SERVICE_LISTED' WHEN 1 THEN 'PRODUCT_LISTED' WHEN 2 THEN 'CERTIFICATION_LISTED' WHEN 3 THEN 'SOCIAL' WHEN 4 THEN 'BUSINESS_HOURS' ELSE 'CAPABILITY' END AS claim_type,
  CASE WHEN pk % 6 < 3 AND seq % 2 = 0 THEN p_name || 's' WHEN pk % 6 < 3 THEN split_part(p_name, ' ', 2) || ' / ' || upper(split_part(p_name, ' ', 1))
    WHEN pk % 6 = 3 THEN CASE pk % 5 WHEN 0 THEN 'https://www.linkedin.com/company/acme' || pk % 7 WHEN 1 THEN 'http://facebook.com/acme' || pk % 7 || '/' WHEN 2 THEN 'https://m.youtube.com/@acme' || pk % 7 WHEN 3 THEN 'https://x.com/intent' ELSE 'https://example.com/acme' END
    WHEN pk % 6 = 4 THEN 'Mon -' || repeat(' ', 1 + (seq % 3)::INT) || 'Fri ' || pk % 7 || ' AM' ELSE p_brand END AS raw_value
  FROM line JOIN part ON p_partkey = pk)"""


def claims(t: Tables) -> DataFrame:
    line = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier_id"), "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_returnflag").alias("flag"))
    rows = line.join(t.part.select("p_partkey", "p_name", "p_brand"), F.col("pk") == F.col("p_partkey")).withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    kind, pk, word = F.col("pk") % 6, F.col("pk"), F.split("p_name", " ")
    text = lambda c: c.cast("string")
    seven = text(pk % 7)
    social = (
        F.when(pk % 5 == 0, F.concat(F.lit("https://www.linkedin.com/company/acme"), seven)).when(pk % 5 == 1, F.concat(F.lit("http://facebook.com/acme"), seven, F.lit("/")))
        .when(pk % 5 == 2, F.concat(F.lit("https://m.youtube.com/@acme"), seven)).when(pk % 5 == 3, "https://x.com/intent").otherwise("https://example.com/acme")
    )
    hours = F.concat(F.lit("Mon -"), F.repeat(F.lit(" "), (1 + F.col("seq") % 3).cast("int")), F.lit("Fri "), seven, F.lit(" AM"))
    return rows.select(
        "supplier_id", "seq", F.concat_ws("-", text(F.col("supplier_id")), text(F.col("seq"))).alias("claim_id"),
        F.concat(F.lit("https://s"), text(F.col("supplier_id")), F.lit(".example/p"), text(F.col("l_orderkey") % 5)).alias("source_url"),
        F.when(F.col("flag") == "A", "AUTO_APPROVED").when(F.col("flag") == "N", "APPROVED").otherwise("UNREVIEWED").alias("review_state"),
        F.element_at(F.array(*map(F.lit, ("SERVICE_LISTED", "PRODUCT_LISTED", "CERTIFICATION_LISTED", "SOCIAL", "BUSINESS_HOURS", "CAPABILITY"))), (kind + 1).cast("int")).alias("claim_type"),
        F.when((kind < 3) & (F.col("seq") % 2 == 0), F.concat("p_name", F.lit("s"))).when(kind < 3, F.concat(F.get(word, F.lit(1)), F.lit(" / "), F.upper(F.get(word, F.lit(0)))))
        .when(kind == 3, social).when(kind == 4, hours).otherwise(F.col("p_brand")).alias("raw_value"),
    )


def shown(t: Tables) -> DataFrame:
    return claims(t).where(F.col("review_state").isin(*pr.SHOWN_STATES))


SHOWN_SQL = f"{CLAIMS_SQL}, shown AS (SELECT * FROM claims WHERE review_state IN ('APPROVED', 'AUTO_APPROVED'))"
FIRST_SQL = (
    f"{SHOWN_SQL}, "
    + r"""keyed AS (SELECT *, array_to_string(list_sort(list_filter(list_transform(string_split(trim(regexp_replace(replace(lower(raw_value), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: regexp_replace(w, 's$', '')), lambda w: w <> '')), ' ') AS k
  FROM shown WHERE claim_type LIKE '%_LISTED'),
once AS (SELECT supplier_id, claim_type, k, arg_min(raw_value, seq) AS name, arg_min(source_url, seq) AS url, min(seq) AS s FROM keyed GROUP BY 1, 2, 3),
product AS (SELECT supplier_id, k FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY s) AS rn FROM once WHERE claim_type = 'PRODUCT_LISTED') WHERE rn <= 40),
kept AS (SELECT *, row_number() OVER (PARTITION BY supplier_id, claim_type ORDER BY s) AS rn FROM once WHERE claim_type <> 'SERVICE_LISTED' OR NOT EXISTS (SELECT 1 FROM product p WHERE p.supplier_id = once.supplier_id AND p.k = once.k)),
source AS (SELECT *, row_number() OVER (PARTITION BY supplier_id, claim_type ORDER BY s) AS rn FROM (SELECT supplier_id, claim_type, url, min(s) AS s FROM kept GROUP BY 1, 2, 3))"""
)


@query(
    "r2_listed_summary",
    f"""WITH {FIRST_SQL} SELECT k.supplier_id, k.claim_type, string_agg(k.name, '|' ORDER BY k.s) AS names, any_value(s.sources) AS sources FROM kept k
    JOIN (SELECT supplier_id, claim_type, string_agg(url, '|' ORDER BY s) AS sources FROM source WHERE rn <= 3 GROUP BY 1, 2) s ON s.supplier_id = k.supplier_id AND s.claim_type = k.claim_type
    WHERE rn <= CASE k.claim_type WHEN 'PRODUCT_LISTED' THEN 40 WHEN 'SERVICE_LISTED' THEN 60 ELSE 30 END GROUP BY 1, 2""",
)
def r2(t):
    return pr.listed_summary(shown(t)).select("supplier_id", "claim_type", F.array_join("names", "|").alias("names"), F.array_join("sources", "|").alias("sources"))


@query("u4_u7_except", f"WITH {FIRST_SQL} SELECT supplier_id, k, name FROM kept WHERE claim_type = 'SERVICE_LISTED'")
def u4_u7(t):
    """Services that no list of products shows already."""
    products = pr.first_names(shown(t), "PRODUCT_LISTED").where(F.col("place") <= 40)
    return pr.first_names(shown(t), "SERVICE_LISTED", products).select("supplier_id", F.col("key").alias("k"), "name")


SOCIAL_SQL = r"""link AS (SELECT *, CASE WHEN raw_value LIKE '%linkedin%' THEN 'LINKEDIN' WHEN raw_value LIKE '%facebook%' THEN 'FACEBOOK' WHEN raw_value LIKE '%youtube%' THEN 'YOUTUBE' END AS platform,
  'https://www.' || regexp_replace(regexp_replace(raw_value, '^https?://(www\.|m\.)?', ''), '/$', '') AS url FROM shown WHERE claim_type = 'SOCIAL'),
counted AS (SELECT supplier_id, platform, url, count(*) AS n, min(seq) AS first FROM link WHERE platform IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "r3_social_pages",
    f"""WITH {SHOWN_SQL}, {SOCIAL_SQL} SELECT supplier_id, platform, CASE platform WHEN 'LINKEDIN' THEN 'LinkedIn' WHEN 'FACEBOOK' THEN 'Facebook' ELSE 'YouTube' END AS label, url, CASE platform WHEN 'LINKEDIN' THEN 1 WHEN 'FACEBOOK' THEN 2 ELSE 5 END AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id, platform ORDER BY n DESC, first) AS rn FROM counted) WHERE rn = 1""",
)
def r3_social(t):
    return pr.social_pages(shown(t))


@query(
    "r3_opening_hours",
    rf"""WITH {SHOWN_SQL}, one AS (SELECT supplier_id, regexp_replace(lower(raw_value), '\s+', ' ', 'g') AS k, arg_min(raw_value, seq) AS raw_value, min(seq) AS s FROM shown WHERE claim_type = 'BUSINESS_HOURS' GROUP BY 1, 2)
    SELECT supplier_id, string_agg(raw_value, '|' ORDER BY s) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY s) AS rn FROM one) WHERE rn <= 4 GROUP BY 1""",
)
def r3_hours(t):
    return pr.opening_hours(shown(t)).select("supplier_id", F.array_join("hours", "|").alias("hours"))


CONTACTS_SQL = """contact AS (SELECT c_custkey AS contact_id, c_custkey % (SELECT count(*) FROM supplier) AS supplier_id,
  CASE c_custkey % 5 WHEN 0 THEN 'Primary RFQ Contact' WHEN 1 THEN 'Backup RFQ Contact ' || c_custkey % 3 WHEN 2 THEN 'Other Contact ' || c_custkey % 9 WHEN 3 THEN c_name END AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'SALES' WHEN 'MACHINERY' THEN 'INDIVIDUAL_BUSINESS_CONTACT' WHEN 'HOUSEHOLD' THEN 'OTHER' ELSE 'GENERAL' END AS contact_type,
  CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) || c_custkey || '@mail.example' ELSE '' END AS value FROM customer)"""


def contacts(t: Tables) -> DataFrame:
    n = t.supplier.count()
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    named = F.when(k % 5 == 0, "Primary RFQ Contact").when(k % 5 == 1, F.concat(F.lit("Backup RFQ Contact "), (k % 3).cast("string"))).when(k % 5 == 2, F.concat(F.lit("Other Contact "), (k % 9).cast("string"))).when(k % 5 == 3, F.col("c_name"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "SALES").when(F.col("c_mktsegment") == "MACHINERY", "INDIVIDUAL_BUSINESS_CONTACT").when(F.col("c_mktsegment") == "HOUSEHOLD", "OTHER").otherwise("GENERAL")
    mail = F.when(F.col("c_acctbal") > 0, F.concat(F.lower("c_mktsegment"), text, F.lit("@mail.example"))).otherwise("")
    return t.customer.select(k.alias("contact_id"), (k % n).alias("supplier_id"), named.alias("name"), kind.alias("contact_type"), mail.alias("value"))


@query(
    "o6_contact_order",
    f"WITH {CONTACTS_SQL} SELECT contact_id, CASE WHEN name IS NULL THEN 99 WHEN name LIKE 'Primary%' THEN 0 WHEN name LIKE 'Backup%' THEN split_part(name, ' ', 4)::INT WHEN name LIKE 'Other%' THEN 10 + split_part(name, ' ', 3)::INT ELSE 50 END AS place FROM contact",
)
def o6(t):
    return contacts(t).select("contact_id", pr.contact_place(F.col("name")).alias("place"))


@query("f12_public_contacts", f"WITH {CONTACTS_SQL} SELECT contact_id, contact_type FROM contact WHERE contact_type NOT IN ('OTHER', 'INDIVIDUAL_BUSINESS_CONTACT')")
def f12(t):
    return pr.public_contacts(contacts(t)).select("contact_id", "contact_type")


@query("o7_platform_order", f"WITH {SHOWN_SQL}, {SOCIAL_SQL} SELECT supplier_id, string_agg(platform, ',' ORDER BY CASE platform WHEN 'LINKEDIN' THEN 1 WHEN 'FACEBOOK' THEN 2 ELSE 5 END) AS platforms FROM (SELECT DISTINCT supplier_id, platform FROM counted) GROUP BY 1")
def o7(t):
    return pr.in_order(pr.social_pages(shown(t)), "supplier_id", "platform", "place", "platforms").select("supplier_id", F.array_join("platforms", ",").alias("platforms"))


VIEW_SQL = f"""{EDGES_SQL}, {CONTACTS_SQL},
cap AS (SELECT l_suppkey AS supplier_id, string_agg(p_brand, '|' ORDER BY p_brand) AS v FROM edges WHERE published GROUP BY 1),
kind AS (SELECT l_suppkey AS supplier_id, p_type AS name, bool_or(l_returnflag = 'A') AS a, bool_or(l_quantity > 45) AS q, min(l_orderkey) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
ind AS (SELECT supplier_id, string_agg(name, '|' ORDER BY name) AS v FROM kind WHERE a GROUP BY 1), cert AS (SELECT supplier_id, string_agg(name, '|' ORDER BY name) AS v FROM kind WHERE q GROUP BY 1),
eq AS (SELECT supplier_id, string_agg(name, '|' ORDER BY name) AS v FROM kind WHERE a AND q GROUP BY 1),
reg AS (SELECT s_suppkey AS supplier_id, r_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
loc AS (SELECT supplier_id, string_agg(name, '|' ORDER BY (CASE WHEN o % 3 = 0 THEN 1 WHEN o % 3 = 1 THEN 3 ELSE 5 END), o, name) AS v FROM kind GROUP BY 1),
con AS (SELECT supplier_id, string_agg(value, '|' ORDER BY (CASE WHEN name IS NULL THEN 99 WHEN name LIKE 'Primary%' THEN 0 WHEN name LIKE 'Backup%' THEN split_part(name, ' ', 4)::INT WHEN name LIKE 'Other%' THEN 10 + split_part(name, ' ', 3)::INT ELSE 50 END), name NULLS FIRST, value) AS v
  FROM contact WHERE contact_type NOT IN ('OTHER', 'INDIVIDUAL_BUSINESS_CONTACT') GROUP BY 1),
doc AS (SELECT supplier_id, min('https://s' || supplier_id || '.example/' || lower(name)) AS v FROM kind WHERE o % 2 = 0 GROUP BY 1)"""


@query(
    "r1_profile_view",
    f"""WITH {VIEW_SQL} SELECT s_suppkey AS supplier_id, coalesce(loc.v, '') AS locations, coalesce(cap.v, '') AS capabilities, coalesce(ind.v, '') AS industries, coalesce(cert.v, '') AS certifications, coalesce(eq.v, '') AS equipments,
    coalesce(reg.v, '') AS service_regions, coalesce(con.v, '') AS contacts, coalesce(doc.v, '') AS documents FROM supplier LEFT JOIN loc ON loc.supplier_id = s_suppkey LEFT JOIN cap ON cap.supplier_id = s_suppkey LEFT JOIN ind ON ind.supplier_id = s_suppkey
    LEFT JOIN cert ON cert.supplier_id = s_suppkey LEFT JOIN eq ON eq.supplier_id = s_suppkey LEFT JOIN reg ON reg.supplier_id = s_suppkey LEFT JOIN con ON con.supplier_id = s_suppkey LEFT JOIN doc ON doc.supplier_id = s_suppkey WHERE s_acctbal > 0""",
)
def r1(t):
    kind = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_returnflag", "l_quantity").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    kind = kind.groupBy(F.col("l_suppkey").alias("supplier_id"), F.col("p_type").alias("name")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_quantity") > 45).alias("q"), F.min("l_orderkey").alias("o"))
    place = F.when(F.col("o") % 3 == 0, "HEADQUARTERS").when(F.col("o") % 3 == 1, "PLANT").otherwise("OFFICE")
    regions = t.supplier.join(F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))
    children = {
        "locations": kind.select("supplier_id", place.alias("location_type"), F.struct("o", "name").alias("created_seq"), F.col("name").alias("city")),
        "capabilities": edges(t).select(F.col("l_suppkey").alias("supplier_id"), F.col("p_brand").alias("name"), "published"),
        "industries": kind.select("supplier_id", "name", F.col("a").alias("published")), "certifications": kind.select("supplier_id", "name", F.col("q").alias("published")),
        "equipments": kind.select("supplier_id", "name", (F.col("a") & F.col("q")).alias("published")), "service_regions": regions.select(F.col("s_suppkey").alias("supplier_id"), F.col("r_name").alias("name")),
        "contacts": contacts(t), "documents": kind.select("supplier_id", F.when(F.col("o") % 2 == 0, "CONTACT").otherwise("OTHER").alias("page_type"), F.concat(F.lit("https://s"), F.col("supplier_id").cast("string"), F.lit(".example/"), F.lower("name")).alias("source_url")),
    }
    suppliers = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.when(F.col("s_acctbal") > 0, "PUBLISHED").otherwise("DRAFT").alias("profile_status"))
    shown_as = {"locations": "city", "contacts": "value", "documents": "source_url"}
    return pr.profile_view(suppliers, children).select("supplier_id", *[F.array_join(F.col(f"{n}.{shown_as.get(n, 'name')}"), "|").alias(n) for n in children])


# States and ingestion -----------------------------------------------------------------------------------------------------


def profiles(t: Tables) -> DataFrame:
    published = F.col("s_acctbal") > 0
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.when(published, "PUBLISHED").otherwise("DRAFT").alias("profile_status"), F.when(published, at).alias("published_at"))


@query(
    "b2_publish_all",
    "SELECT s_suppkey AS supplier_id, 'PUBLISHED' AS profile_status, CASE WHEN s_acctbal > 0 THEN '2024-01-01' ELSE '2025-06-01' END AS day FROM supplier",
)
def b2_all(t):
    out = ad.set_profiles(profiles(t), None, True, F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"))
    return out.select("supplier_id", "profile_status", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("b2_unpublish", "SELECT s_suppkey AS supplier_id, CASE WHEN s_nationkey < 5 THEN 'DRAFT' WHEN s_acctbal > 0 THEN 'PUBLISHED' ELSE 'DRAFT' END AS profile_status, s_acctbal > 0 AND s_nationkey >= 5 AS dated FROM supplier")
def b2_unpublish(t):
    ids = t.supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("supplier_id"))
    return ad.set_profiles(profiles(t), ids, False, F.lit(None).cast("timestamp_ntz")).select("supplier_id", "profile_status", F.col("published_at").isNotNull().alias("dated"))


@query("b2_publish_counts", "SELECT count(*) FILTER (s_acctbal <= 0) AS published_count, count(*) FILTER (s_acctbal > 0) AS skipped_count FROM supplier")
def b2_counts(t):
    return ad.publish_counts(profiles(t))


@query(
    "b2_claim_states",
    f"""WITH {CLAIMS_SQL} SELECT claim_id, CASE WHEN supplier_id % 3 = 0 AND seq % 4 = 0 THEN 'REJECTED' WHEN supplier_id % 3 = 1 AND seq % 4 = 0 THEN 'PENDING' ELSE review_state END AS review_state,
    CASE WHEN supplier_id % 3 = 0 AND seq % 4 = 0 THEN 'u1' ELSE 'u0' END AS reviewed_by FROM claims""",
)
def b2_states(t):
    """Decisions on facts: a third of the suppliers' facts is rejected, a third marked stale, each with its supporting claims."""
    c = claims(t).withColumn("reviewed_by", F.lit("u0"))
    support = c.where("seq % 4 = 0 and supplier_id % 3 < 2").groupBy("supplier_id", "claim_type", "raw_value").agg(F.min("claim_id").alias("claim_id"), F.collect_list("claim_id").alias("supporting"))
    decisions = support.select("claim_id", F.when(F.col("supplier_id") % 3 == 0, "REJECT").otherwise("STALE").alias("action"), F.lit("u1").alias("reviewer"), "supporting")
    return ad.set_claim_states(c, decisions).select("claim_id", "review_state", "reviewed_by")


CANDIDATES_SQL = """cand AS (SELECT c_custkey AS row_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_custkey || '.example' END AS domain, c_nationkey::VARCHAR AS city, c_mktsegment AS province,
  CASE WHEN c_custkey % 4 = 0 THEN 'a' || c_custkey || '@mail.example' ELSE '' END AS email, CASE WHEN c_custkey % 6 = 0 THEN '506-555-0100' ELSE '' END AS phone,
  CASE WHEN c_acctbal < -500 THEN 'INVALID' WHEN c_acctbal < 0 THEN 'POSSIBLE_DUPLICATE' WHEN c_acctbal < 3000 THEN 'UPDATE_CANDIDATE' ELSE 'NEW' END AS status FROM customer)"""


def candidates(t: Tables) -> DataFrame:
    k, text, bal = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_acctbal")
    return t.customer.select(
        k.alias("row_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c"), text, F.lit(".example"))).alias("domain"), F.col("c_nationkey").cast("string").alias("city"), F.col("c_mktsegment").alias("province"),
        F.when(k % 4 == 0, F.concat(F.lit("a"), text, F.lit("@mail.example"))).otherwise("").alias("email"), F.when(k % 6 == 0, "506-555-0100").otherwise("").alias("phone"),
        F.when(bal < -500, "INVALID").when(bal < 0, "POSSIBLE_DUPLICATE").when(bal < 3000, "UPDATE_CANDIDATE").otherwise("NEW").alias("status"),
    )


@query(
    "d10_commit",
    rf"""WITH {CANDIDATES_SQL}, ok AS (SELECT * FROM cand WHERE status NOT IN ('INVALID', 'POSSIBLE_DUPLICATE'))
    SELECT row_id, 'company' AS kind, name AS a, regexp_replace(regexp_replace(trim(lower(name)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g') || '-' || row_id AS b, nullif(domain, '') AS c FROM ok
    UNION ALL SELECT row_id, 'location', 'Primary Address', city, province FROM ok UNION ALL SELECT row_id, 'contact', nullif(email, ''), nullif(phone, ''), NULL FROM ok WHERE email <> '' OR phone <> ''""",
)
def d10(t):
    return ad.commit_rows(candidates(t))


@query("d10_commit_counts", f"WITH {CANDIDATES_SQL} SELECT count(*) FILTER (status IN ('NEW', 'UPDATE_CANDIDATE')) AS created_count, count(*) FILTER (status IN ('INVALID', 'POSSIBLE_DUPLICATE')) AS skipped_count FROM cand")
def d10_counts(t):
    return ad.commit_counts(candidates(t))


@query(
    "d11_manual_create",
    """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 7 = 0 THEN 'UNAUTHORIZED' WHEN c_custkey % 5 = 0 THEN 'INVALID' WHEN c_custkey % 3 = 0 AND c_custkey // 3 < (SELECT count(*) FROM supplier) THEN 'DUPLICATE_DOMAIN'
    WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey) THEN 'DUPLICATE_NAME' ELSE 'CREATED' END AS outcome FROM customer""",
)
def d11(t):
    k = F.col("c_custkey")
    key = lambda c: F.lpad(c.cast("string"), 9, "0")
    site = F.when(k % 3 == 0, F.concat(F.lit("https://www.S"), F.floor(k / 3).cast("string"), F.lit(".example/home"))).otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit(".example")))
    rows = t.customer.select(k.alias("row_id"), (k % 7 != 0).alias("is_admin"), F.concat(F.lit(" supplier#"), key(k), F.lit(" ")).alias("name"), F.when(k % 5 != 0, site).alias("website"), F.col("c_nationkey").cast("string").alias("city"))
    existing = t.supplier.select(F.concat(F.lit("Supplier#"), key(F.col("s_suppkey"))).alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"), F.col("s_nationkey").cast("string").alias("city"))
    return ad.manual_outcomes(rows, existing)


SEEDS_SQL = """seed AS (SELECT c_custkey AS seed_id, CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 9, '0') ELSE 'Nobody' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'S' || c_custkey || '.example' ELSE 'other.example' END AS domain, c_nationkey::VARCHAR AS city FROM customer),
have AS (SELECT s_suppkey AS supplier_id, s_name AS name, 's' || s_suppkey || '.example' AS domain FROM supplier)"""


@query(
    "d12_seed_companies",
    f"""WITH {SEEDS_SQL}, hit AS (SELECT seed_id, min(supplier_id) AS supplier_id FROM (SELECT seed_id, supplier_id FROM seed JOIN have ON contains(lower(have.name), lower(seed.name)) UNION ALL SELECT seed_id, supplier_id FROM seed JOIN have ON lower(have.domain) = lower(seed.domain)) GROUP BY 1)
    SELECT seed_id, supplier_id, CASE WHEN supplier_id IS NULL THEN 'INSERT' ELSE 'CORRECT' END AS action, name, domain, city FROM seed LEFT JOIN hit USING (seed_id)""",
)
def d12(t):
    return ad.seed_companies(seeds(t), companies_with_domain(t))


@query(
    "j10_disjunctive_join",
    f"WITH {SEEDS_SQL} SELECT DISTINCT seed_id, supplier_id FROM (SELECT seed_id, supplier_id FROM seed JOIN have ON contains(lower(have.name), lower(seed.name)) UNION ALL SELECT seed_id, supplier_id FROM seed JOIN have ON lower(have.domain) = lower(seed.domain))",
)
def j10(t):
    """Name contains or domain equals: two joins on keys, then distinct."""
    return ad.seed_matches(seeds(t), companies_with_domain(t))


SIGNALS_SQL = f"""{CANDIDATES_SQL}, n AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'Supplier#' || lpad(row_id::VARCHAR, 9, '0') ELSE 'zz' || row_id END AS name, city, CASE WHEN row_id % 3 = 0 THEN 's' || row_id || '.example' END AS domain, CASE WHEN row_id % 6 = 0 THEN '506-555-0' || lpad((row_id % 900)::VARCHAR, 3, '0') END AS phone FROM cand),
e AS (SELECT s_suppkey AS supplier_id, CASE WHEN s_suppkey % 7 = 0 THEN 'The azz' || s_suppkey ELSE s_name END AS name, 's' || s_suppkey || '.example' AS domain, s_nationkey::VARCHAR AS city, '506-555-0' || lpad((s_suppkey % 900)::VARCHAR, 3, '0') AS phone FROM supplier)"""


@query(
    "j8_signal_join",
    f"""WITH {SIGNALS_SQL}, s AS (SELECT row_id, 'name' AS signal FROM n SEMI JOIN e ON lower(n.name) = lower(e.name) UNION ALL SELECT row_id, 'name_city' FROM n SEMI JOIN e ON n.city = e.city AND contains(lower(e.name), lower(left(n.name, 5)))
      UNION ALL SELECT row_id, 'domain' FROM n SEMI JOIN e ON n.domain = e.domain UNION ALL SELECT row_id, 'phone' FROM n SEMI JOIN e ON n.phone = e.phone)
    SELECT n.row_id, coalesce(string_agg(signal, ',' ORDER BY signal), '') AS signals FROM n LEFT JOIN s USING (row_id) GROUP BY 1""",
)
def j8(t):
    """Four signals of candidates against companies, each a join on keys."""
    k, text = F.col("row_id"), F.col("row_id").cast("string")
    phone = lambda c: F.concat(F.lit("506-555-0"), F.lpad((c % 900).cast("string"), 3, "0"))
    rows = candidates(t).select(
        "row_id", F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(text, 9, "0"))).otherwise(F.concat(F.lit("zz"), text)).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("https://s"), text, F.lit(".example"))).alias("website"), "city", F.when(k % 6 == 0, phone(k)).alias("phone"),
    )
    s = F.col("supplier_id")
    existing = companies_with_domain(t).withColumn("name", F.when(s % 7 == 0, F.concat(F.lit("The azz"), s.cast("string"))).otherwise(F.col("name"))).withColumn("phone", phone(s))
    existing = existing.join(t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").cast("string").alias("city")), "supplier_id")
    return duplicate_signals(rows, existing).select("row_id", F.array_join("signals", ",").alias("signals"))


@query("o5_match_first", "SELECT c_custkey % (SELECT count(*) FROM supplier) AS supplier_id, string_agg(c_custkey, ',' ORDER BY c_nationkey <> 3, c_custkey) AS places FROM customer GROUP BY 1")
def o5(t):
    """A company's places with those in the searched city first, the rest in their order."""
    n = t.supplier.count()
    places = t.customer.select((F.col("c_custkey") % n).alias("supplier_id"), F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("city"))
    out = pr.nested(places, "places", [F.col("city") != 3, F.col("seq")], ["seq"])
    return out.select("supplier_id", F.array_join(F.col("places.seq").cast("array<string>"), ",").alias("places"))


def seeds(t: Tables) -> DataFrame:
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    return t.customer.select(k.alias("seed_id"), F.when(k % 2 == 0, F.lpad(text, 9, "0")).otherwise("Nobody").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("S"), text, F.lit(".example"))).otherwise("other.example").alias("domain"), F.col("c_nationkey").cast("string").alias("city"))


def companies_with_domain(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"))


@query("d13_reset", f"WITH {CLAIMS_SQL} SELECT claim_id, review_state FROM claims WHERE NOT (supplier_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND review_state NOT IN ('APPROVED', 'REJECTED', 'VERIFIED', 'HUMAN_APPROVED', 'HUMAN_REJECTED'))")
def d13(t):
    mine = t.supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("supplier_id"))
    c = claims(t)
    left = ad.reset_before_crawl({"claims": c, "documents": c.select("supplier_id"), "runs": c.select("supplier_id")}, mine)
    return left["claims"].select("claim_id", "review_state")


# Review and lists -----------------------------------------------------------------------------------------------------------


def facts_input(t: Tables) -> DataFrame:
    """The capability claims in the shape that consolidation takes."""
    c = claims(t).where("claim_type = 'CAPABILITY'")
    return c.withColumns({"normalized_value": F.lit(None).cast("string"), "evidence_text": F.when(F.col("seq") % 9 == 0, "we do not offer this").otherwise("offered"), "page_text": F.lit(""), "extraction_method": F.lit("TAXONOMY_EXACT"), "confidence": F.lit(0.9)})


FACTS_SQL = r"""fact AS (SELECT supplier_id, trim(regexp_replace(lower(raw_value), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n,
  CASE WHEN bool_or(review_state = 'APPROVED') THEN 'APPROVED' WHEN bool_or(review_state = 'AUTO_APPROVED') THEN 'AUTO_APPROVED' ELSE 'UNREVIEWED' END AS state FROM claims WHERE claim_type = 'CAPABILITY' GROUP BY 1, 2)"""


@query(
    "r4_review_counts",
    f"WITH {CLAIMS_SQL}, {FACTS_SQL} SELECT sum(n)::BIGINT AS raw_claims, count(*) AS facts, count(*) FILTER (state = 'AUTO_APPROVED') AS auto_approved, 0::BIGINT AS auto_rejected, count(*) FILTER (state = 'UNREVIEWED') AS waiting, count(*) FILTER (state = 'APPROVED') AS published, (sum(n) - count(*))::BIGINT AS collapsed FROM fact",
)
def r4_counts(t):
    return ad.review_counts(facts_input(t))


@query("r4_review_queue", f"WITH {CLAIMS_SQL}, {FACTS_SQL} SELECT supplier_id, slug, n AS n_claims FROM fact WHERE state = 'UNREVIEWED'")
def r4_queue(t):
    return ad.review_facts(facts_input(t), "HUMAN_REVIEW", "CAPABILITY").select("supplier_id", "slug", "n_claims")


@query(
    "r5_crawl_list",
    "WITH r AS (SELECT o_orderkey AS run_id, o_custkey % (SELECT count(*) FROM supplier) AS supplier_id, o_orderstatus AS status, o_orderdate AS began FROM orders) SELECT s_suppkey AS supplier_id, s_name AS name, arg_max(status, (began, run_id)) AS last_status FROM supplier LEFT JOIN r ON supplier_id = s_suppkey GROUP BY 1, 2",
)
def r5_crawl(t):
    return ad.with_latest_run(t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name")), runs(t)).select("supplier_id", "name", "last_status")


def runs(t: Tables) -> DataFrame:
    n = t.supplier.count()
    return t.orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % n).alias("supplier_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderkey") % 4).alias("pages"))


@query(
    "r5_taxonomy_list",
    f"WITH {EDGES_SQL}, a AS (SELECT p_brand AS slug, count(DISTINCT p_type) AS aliases FROM part GROUP BY 1), u AS (SELECT p_brand AS slug, count(DISTINCT l_suppkey) AS suppliers FROM edges WHERE published GROUP BY 1) SELECT a.slug, upper(a.slug) AS name, aliases, coalesce(suppliers, 0) AS suppliers FROM a LEFT JOIN u USING (slug)",
)
def r5_taxonomy(t):
    terms = t.part.select(F.col("p_brand").alias("slug")).distinct().withColumn("name", F.upper("slug"))
    return ad.term_use(terms, t.part.select(F.col("p_brand").alias("slug"), F.col("p_type").alias("alias")), edges(t).where("published").select(F.col("p_brand").alias("slug"), F.col("l_suppkey").alias("supplier_id")))


@query("r5_audit_list", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def r5_audit(t):
    return ad.newest(t.events, "ts", "event_id", 50).select("event_id", "event_type")


# Reports --------------------------------------------------------------------------------------------------------------------

FLAGS_SQL = f"""{EDGES_SQL}, {CLAIMS_SQL}, {FACTS_SQL}, {CONTACTS_SQL},
run AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS supplier_id, arg_max(o_orderkey % 4, (o_orderdate, o_orderkey)) AS pages FROM orders GROUP BY 1),
con2 AS (SELECT supplier_id, bool_or(value <> '') AS has_email, bool_or(contact_id % 6 = 0) AS has_phone FROM contact GROUP BY 1), cap2 AS (SELECT l_suppkey AS supplier_id, bool_or(published) AS has_capability FROM edges GROUP BY 1),
place AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS supplier_id, c_nationkey AS city FROM customer),
loc2 AS (SELECT supplier_id, bool_or(city = s_nationkey) AS city_match FROM place JOIN supplier ON s_suppkey = supplier_id GROUP BY 1), wait2 AS (SELECT supplier_id, count(*) FILTER (state = 'UNREVIEWED') AS waiting FROM fact GROUP BY 1),
flags AS (SELECT s_suppkey AS supplier_id, coalesce(pages, 0) AS pages, CASE WHEN pages >= 2 THEN 'full' WHEN pages = 1 THEN 'partial' ELSE 'failed' END AS crawl, coalesce(has_email, false) AS has_email, coalesce(has_phone, false) AS has_phone,
  coalesce(has_capability, false) AS has_capability, city_match IS NOT NULL AS has_location, coalesce(city_match, false) AS city_match, NOT coalesce(city_match, true) AS city_conflict, coalesce(waiting, 0) AS waiting
  FROM supplier LEFT JOIN run ON run.supplier_id = s_suppkey LEFT JOIN con2 ON con2.supplier_id = s_suppkey LEFT JOIN cap2 ON cap2.supplier_id = s_suppkey LEFT JOIN loc2 ON loc2.supplier_id = s_suppkey LEFT JOIN wait2 ON wait2.supplier_id = s_suppkey)"""


def flags(t: Tables) -> DataFrame:
    n = t.supplier.count()
    con = contacts(t).select("supplier_id", F.col("value").alias("email"), F.when(F.col("contact_id") % 6 == 0, "506-555-0100").otherwise("").alias("phone"))
    places = t.customer.select((F.col("c_custkey") % n).alias("supplier_id"), F.col("c_nationkey").cast("string").alias("city"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").cast("string").alias("city"))
    return rp.supplier_flags(suppliers, runs(t), con, edges(t).select(F.col("l_suppkey").alias("supplier_id"), "published"), places, ad.review_facts(facts_input(t)))


@query("r6_supplier_flags", f"WITH {FLAGS_SQL} SELECT * FROM flags")
def r6_flags(t):
    return flags(t)


PCT = "CASE WHEN count(*) > 0 THEN printf('%.1f', 100.0 * {} / count(*)) || '%' ELSE '{}' END"


@query(
    "r6_coverage_report",
    f"""WITH {FLAGS_SQL} SELECT count(*) AS suppliers, count(*) FILTER (crawl <> 'failed') AS crawled, count(*) FILTER (crawl = 'full') AS full, count(*) FILTER (has_email OR has_phone) AS with_contact, count(*) FILTER (has_email) AS with_email, count(*) FILTER (has_capability) AS with_capability,
    count(*) FILTER (has_location) AS with_location, count(*) FILTER (city_match) AS city_matches, count(*) FILTER (city_conflict) AS city_conflicts, sum(waiting)::BIGINT AS waiting, {PCT.format("count(*) FILTER (crawl <> 'failed')", "100.0%")} AS crawl_pct, {PCT.format("count(*) FILTER (has_email OR has_phone)", "0.0%")} AS contact_pct,
    {PCT.format("count(*) FILTER (has_capability)", "0.0%")} AS capability_pct, 100.0 * count(*) FILTER (crawl <> 'failed') / count(*) >= 85 AS crawl_gate, 100.0 * count(*) FILTER (has_email OR has_phone) / count(*) >= 80 AS contact_gate, 100.0 * count(*) FILTER (has_capability) / count(*) >= 80 AS capability_gate,
    sum(waiting) <= 8 * count(*) AS review_gate FROM flags""",
)
def r6(t):
    return rp.coverage(flags(t))


@query("r7_batch_report", f"WITH {FLAGS_SQL}, k(crawl) AS (VALUES ('full'), ('partial'), ('failed')) SELECT k.crawl, count(supplier_id) AS n FROM k LEFT JOIN flags ON flags.crawl = k.crawl GROUP BY 1")
def r7(t):
    return rp.tally(flags(t).select("crawl"), "crawl", ["full", "partial", "failed"])


BATCH_SQL = f"""{CLAIMS_SQL}, {FACTS_SQL}, {CONTACTS_SQL}, run AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS supplier_id, arg_max(o_orderkey % 4, (o_orderdate, o_orderkey)) AS pages FROM orders GROUP BY 1),
every AS (SELECT supplier_id, 'CAPABILITY' AS claim_type, state, n, NULL AS value FROM fact UNION ALL SELECT supplier_id, 'CONTACT_EMAIL', CASE contact_id % 4 WHEN 0 THEN 'HUMAN_REVIEW' WHEN 1 THEN 'AUTO_REJECTED' WHEN 2 THEN 'VERIFIED' ELSE 'REJECTED' END, 1,
  CASE WHEN contact_type = 'OTHER' THEN 'hr@mail.example' WHEN value <> '' THEN value ELSE '506-555-0' || lpad((contact_id % 900)::VARCHAR, 3, '0') END FROM contact),
own AS (SELECT supplier_id, sum(n) AS claims, count(*) AS facts, count(*) FILTER (state IN ('AUTO_APPROVED', 'APPROVED')) AS auto_approved, count(*) FILTER (state = 'AUTO_REJECTED') AS auto_rejected, count(*) FILTER (state IN ('HUMAN_REVIEW', 'UNREVIEWED')) AS human_review,
  count(*) FILTER (state = 'VERIFIED') AS human_approved, count(*) FILTER (state = 'REJECTED') AS human_rejected, count(*) FILTER (state IN ('AUTO_APPROVED', 'APPROVED', 'VERIFIED')) AS published, bool_or(value IS NOT NULL) AS contact, bool_or(value NOT LIKE 'hr@%') AS usable,
  bool_or(value LIKE '%@%') AS email, bool_or(value NOT LIKE '%@%') AS phone, bool_or(claim_type = 'CAPABILITY') AS capability FROM every GROUP BY 1),
sup AS (SELECT s_suppkey AS supplier_id, CASE WHEN s_acctbal < 5000 THEN 'first' ELSE 'second' END AS batch FROM supplier)"""
COUNTS = ["suppliers", "full", "partial", "failed", "pages", "claims", "facts", "auto_approved", "auto_rejected", "human_review", "human_approved", "human_rejected", "published", "certifications", "with_contact", "with_usable", "with_email", "with_phone", "with_capability", "with_location"]
_SUMS = ", ".join(f"coalesce(sum({x}), 0)::BIGINT AS {x}" for x in COUNTS[4:13])
_SHARES = ", ".join(f"printf('%.1f', floor(1000.0 * {x} / suppliers + 0.5) / 10) || '%' AS {x}_pct" for x in COUNTS[1:4] + COUNTS[14:])


@query(
    "r7_batches",
    f"""WITH {BATCH_SQL}, x AS (SELECT batch, count(*) AS suppliers, count(*) FILTER (pages >= 2) AS "full", count(*) FILTER (pages = 1) AS partial, count(*) FILTER (coalesce(pages, 0) = 0) AS failed, {_SUMS}, 0::BIGINT AS certifications, count(*) FILTER (contact) AS with_contact, count(*) FILTER (usable) AS with_usable,
      count(*) FILTER (email) AS with_email, count(*) FILTER (phone) AS with_phone, count(*) FILTER (capability) AS with_capability, 0::BIGINT AS with_location FROM sup LEFT JOIN run USING (supplier_id) LEFT JOIN own USING (supplier_id) GROUP BY 1)
    SELECT *, printf('%.2f', floor(100.0 * pages / suppliers + 0.5) / 100) AS average_pages, printf('%.2f', floor(100.0 * human_review / suppliers + 0.5) / 100) AS average_review, {_SHARES.replace("* full /", '* "full" /')}, 100 * "full" >= 85 * suppliers AS crawl_gate, 100 * with_usable >= 80 * suppliers AS contact_gate,
      100 * with_capability >= 80 * suppliers AS capability_gate, human_review <= 8 * suppliers AS review_gate FROM x""",
)
def r7_batches(t):
    """Two batches of suppliers by their balance, with all counts, shares and gates."""
    return rp.batch_report(batches(t), runs(t), batch_facts(t))


@query("r7_review_by_type", f"WITH {BATCH_SQL} SELECT batch, CASE WHEN claim_type LIKE 'CONTACT%' THEN 'CONTACT' ELSE claim_type END AS category, count(*) AS n FROM every JOIN sup USING (supplier_id) WHERE state IN ('HUMAN_REVIEW', 'UNREVIEWED') GROUP BY 1, 2")
def r7_review(t):
    return rp.review_by_type(batches(t), batch_facts(t))


@query(
    "r7_before_and_after",
    f"""WITH {BATCH_SQL}, x AS (SELECT batch, count(*) AS n, coalesce(sum(published), 0) AS published, coalesce(sum(human_review), 0) AS human_review, coalesce(sum(facts), 0) AS facts FROM sup LEFT JOIN own USING (supplier_id) GROUP BY 1)
    SELECT batch, 'suppliers' AS count, n AS before, n AS after, 0::BIGINT AS change FROM x UNION ALL SELECT batch, 'published', 0, published, published FROM x UNION ALL SELECT batch, 'human_review', facts, human_review, human_review - facts FROM x""",
)
def r7_changes(t):
    """What the rules decided: the batches as if no fact had been judged, beside them as they are."""
    facts = batch_facts(t)
    report = lambda rows: rp.batch_report(batches(t), runs(t), rows)
    return rp.report_changes(report(facts.withColumn("review_state", F.lit("UNREVIEWED"))), report(facts), "batch", ["suppliers", "published", "human_review"])


def batches(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.when(F.col("s_acctbal") < 5000, "first").otherwise("second").alias("batch"))


def batch_facts(t: Tables) -> DataFrame:
    """Capabilities as facts, and contacts: personal offices, addresses, or numbers where there is no address."""
    known = ad.review_facts(facts_input(t)).select("supplier_id", "claim_type", "review_state", "n_claims", F.lit(None).cast("string").alias("value"))
    k, number = F.col("contact_id"), F.concat(F.lit("506-555-0"), F.lpad((F.col("contact_id") % 900).cast("string"), 3, "0"))
    state = F.element_at(F.array(*map(F.lit, ("HUMAN_REVIEW", "AUTO_REJECTED", "VERIFIED", "REJECTED"))), (k % 4 + 1).cast("int"))
    value = F.when(F.col("contact_type") == "OTHER", "hr@mail.example").when(F.col("value") != "", F.col("value")).otherwise(number)
    return known.unionByName(contacts(t).select("supplier_id", F.lit("CONTACT_EMAIL").alias("claim_type"), state.alias("review_state"), F.lit(1).cast("long").alias("n_claims"), value.alias("value")))


QA_SQL = f"""{CLAIMS_SQL}, said AS (SELECT supplier_id, claim_id, claim_type = 'CAPABILITY' AND review_state = 'UNREVIEWED' AS refused, seq % 7 < 2 AS elsewhere FROM claims)"""


def qa_claims(t: Tables) -> DataFrame:
    reason = F.when(F.col("seq") % 7 == 0, "names a third-party shop").when(F.col("seq") % 7 == 1, "the work was subcontracted").when(F.col("seq") % 7 == 2, "sound")
    return claims(t).withColumns({"review_state": F.when(F.col("review_state") == "UNREVIEWED", "AUTO_REJECTED").otherwise(F.col("review_state")), "validation_reason": reason})


@query(
    "v8_profile_qa",
    f"""WITH {QA_SQL}, n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT c_custkey % n AS supplier_id, c_mktsegment AS seg, c_nationkey AS nation FROM customer, n)
    SELECT supplier_id, 'CONTRADICTORY_PRIMARY_LOCATIONS' AS code, 'WARNING' AS severity, count(*) FILTER (seg = 'BUILDING') AS n, NULL AS detail FROM c GROUP BY 1 HAVING count(*) > 2 AND count(*) FILTER (seg = 'BUILDING') > 1
    UNION ALL SELECT supplier_id, 'DUPLICATE_CONTACT_EMAIL', 'WARNING', count(*) - 1, lower(seg) || '@n' || nation || '.example' FROM c WHERE seg <> 'HOUSEHOLD' GROUP BY supplier_id, seg, nation HAVING count(*) > 1
    UNION ALL SELECT supplier_id, 'UNSUPPORTED_CAPABILITY_CLAIMS', 'WARNING', count(*), NULL FROM said WHERE refused GROUP BY 1
    UNION ALL SELECT supplier_id, 'THIRD_PARTY_EVIDENCE_MENTION', 'CRITICAL', count(*), NULL FROM said WHERE elsewhere GROUP BY 1""",
)
def v8(t):
    """Customers are places and contacts of suppliers, lines their claims."""
    n, seg = t.supplier.count(), F.col("c_mktsegment")
    own = t.customer.withColumn("supplier_id", F.col("c_custkey") % n)
    places = own.select("supplier_id", F.when(seg == "BUILDING", "HEADQUARTERS").otherwise("BRANCH").alias("location_type"))
    mail = F.concat(seg, F.lit("@N"), F.col("c_nationkey").cast("string"), F.lit(".Example"))
    people = own.select("supplier_id", F.when(seg == "BUILDING", F.lower(mail)).when(seg == "HOUSEHOLD", "").alias("normalized_email"), F.when(seg != "HOUSEHOLD", mail).alias("email"))
    return pr.profile_qa(places, people, qa_claims(t))


@query("v8_flagged_claims", f"WITH {QA_SQL} SELECT supplier_id, claim_id, 'UNSUPPORTED_CAPABILITY_CLAIMS' AS code FROM said WHERE refused UNION ALL SELECT supplier_id, claim_id, 'THIRD_PARTY_EVIDENCE_MENTION' FROM said WHERE elsewhere")
def v8_claims(t):
    return pr.flagged_claims(qa_claims(t))


@query(
    "r8_operational_metrics",
    f"""WITH {EDGES_SQL}, {CONTACTS_SQL}, x AS (SELECT (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(DISTINCT supplier_id) FROM contact) AS with_contact, (SELECT count(DISTINCT l_suppkey) FROM edges WHERE published) AS with_capability)
    SELECT *, printf('%.1f', 100.0 * done / jobs) || '%' AS success_pct, printf('%.1f', 100.0 * with_contact / suppliers) || '%' AS contact_pct, printf('%.1f', 100.0 * with_capability / suppliers) || '%' AS capability_pct FROM x""",
)
def r8(t):
    jobs = t.orders.select(F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OTHER").alias("status"))
    return rp.operational_metrics(t.supplier, jobs, contacts(t), edges(t).where("published").select(F.col("l_suppkey").alias("supplier_id")))


@query("a9_percentages", "SELECT n_nationkey, CASE WHEN count(s_suppkey) > 0 THEN printf('%.1f', 100.0 * count(*) FILTER (s_acctbal > 0) / count(s_suppkey)) || '%' ELSE '100.0%' END AS success, CASE WHEN count(s_suppkey) > 0 THEN printf('%.1f', 100.0 * count(*) FILTER (s_acctbal > 0) / count(s_suppkey)) || '%' ELSE '0.0%' END AS covered FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 3000 GROUP BY 1")
def a9(t):
    """Shares as text, with nations that have nothing to share."""
    rows = t.nation.join(t.supplier.where("s_acctbal < 3000"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("k"))
    return rows.select("n_nationkey", rp.percent(F.col("k"), F.col("n"), "100.0%").alias("success"), rp.percent(F.col("k"), F.col("n")).alias("covered"))


ADDRESSES_SQL = """addr AS (SELECT l_suppkey AS supplier_id, 'No. ' || l_linenumber || ' Road ' || l_partkey % 9 AS address, (l_partkey % 5)::VARCHAR AS city, CASE WHEN l_partkey % 3 = 0 THEN 'E1A ' || l_partkey % 9 || 'B2' ELSE '' END AS postal, l_orderkey * 8 + l_linenumber AS seq, l_partkey AS pk FROM lineitem),
one AS (SELECT supplier_id, address, city, postal, min(seq) AS seq FROM addr GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, coalesce(nullif(replace(postal, ' ', ''), ''), lower(address)) AS place FROM one),
once AS (SELECT supplier_id, place, min(seq) AS seq, arg_max(address, (seq, address)) AS address, arg_min(city, (seq, city)) AS city, count(*) - 1 AS updates FROM ranked GROUP BY 1, 2),
near AS (SELECT once.*, city = s_nationkey::VARCHAR AS here FROM once JOIN supplier ON s_suppkey = supplier_id),
found AS (SELECT *, CASE WHEN here AND row_number() OVER (PARTITION BY supplier_id, here ORDER BY seq, place) = 1 THEN 'FILLED' ELSE 'ADDED' END AS outcome FROM near)"""


@query(
    "r11_location_rebuild",
    f"""WITH {ADDRESSES_SQL} SELECT supplier_id, address, city, outcome, updates FROM found
    UNION ALL SELECT s_suppkey, '(listed city)', s_nationkey::VARCHAR, 'LISTED', 0 FROM supplier WHERE s_suppkey NOT IN (SELECT supplier_id FROM found WHERE outcome = 'FILLED')
    UNION ALL SELECT s_suppkey, s_name, s_nationkey::VARCHAR, 'KEPT', 0 FROM supplier WHERE s_acctbal < 0""",
)
def r11(t):
    line, pk = t.lineitem, F.col("l_partkey")
    rows = line.select(
        F.col("l_suppkey").alias("supplier_id"), F.concat(F.lit("No. "), F.col("l_linenumber").cast("string"), F.lit(" Road "), (pk % 9).cast("string")).alias("address"), (pk % 5).cast("string").alias("city"),
        F.when(pk % 3 == 0, F.concat(F.lit("E1A "), (pk % 9).cast("string"), F.lit("B2"))).otherwise("").alias("postal"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    rows = rows.groupBy("supplier_id", "address", "city", "postal").agg(F.min("seq").alias("seq"))
    place = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("address"), F.col("s_nationkey").cast("string").alias("city"), (F.col("s_acctbal") >= 0).alias("by_crawler"))
    return rp.rebuilt_locations(place, place.select("supplier_id", "city"), rows)


@query(
    "r11_city_counts",
    f"""WITH {ADDRESSES_SQL}, after AS (SELECT supplier_id, city FROM found UNION ALL SELECT s_suppkey, s_nationkey::VARCHAR FROM supplier WHERE s_acctbal < 0 OR s_suppkey NOT IN (SELECT supplier_id FROM found WHERE outcome = 'FILLED'))
    SELECT coalesce(b.city, a.city) AS city, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM (SELECT s_nationkey::VARCHAR AS city, count(*) AS before FROM supplier GROUP BY 1) b FULL JOIN (SELECT city, count(DISTINCT supplier_id) AS after FROM after GROUP BY 1) a ON a.city = b.city""",
)
def r11_cities(t):
    """Suppliers of each city before the rebuild of r11_location_rebuild and after it."""
    return rp.city_counts(t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").cast("string").alias("city")), r11(t))


@query(
    "r12_contact_refresh",
    f"""WITH {CONTACTS_SQL}, x AS (SELECT supplier_id, bool_or(value <> '' AND contact_type <> 'OTHER') AS mail, bool_or(contact_type <> 'OTHER' AND contact_id % 8 = 0) AS office FROM contact GROUP BY 1)
    SELECT count(*) AS suppliers, count(*) FILTER (mail) AS with_email, count(*) FILTER (office) AS with_office FROM x""",
)
def r12(t):
    rows = contacts(t).select("supplier_id", (F.col("value") != "").alias("is_email"), F.when(F.col("contact_id") % 8 == 0, "Moncton").alias("office"), F.when(F.col("contact_type") == "OTHER", "DEMOTED").otherwise("EXTRA").alias("outcome"))
    return rp.contact_refresh(rows)


@query(
    "r13_recrawl_summary",
    f"""WITH {EDGES_SQL}, {CLAIMS_SQL}, {CONTACTS_SQL}, a AS (SELECT supplier_id, count(DISTINCT raw_value) FILTER (claim_type = 'SERVICE_LISTED') AS services, count(DISTINCT raw_value) FILTER (claim_type = 'SOCIAL') AS socials, count(DISTINCT raw_value) FILTER (claim_type = 'BUSINESS_HOURS') AS hours FROM claims WHERE review_state IN ('APPROVED', 'AUTO_APPROVED') GROUP BY 1),
    b AS (SELECT supplier_id, count(*) AS contacts FROM contact GROUP BY 1), c AS (SELECT l_suppkey AS supplier_id, count(*) AS capabilities FROM edges WHERE published GROUP BY 1)
    SELECT supplier_id, coalesce(services, 0) AS services, coalesce(socials, 0) AS socials, coalesce(hours, 0) AS hours, coalesce(contacts, 0) AS contacts, coalesce(capabilities, 0) AS capabilities FROM a FULL JOIN b USING (supplier_id) FULL JOIN c USING (supplier_id)""",
)
def r13(t):
    return rp.recrawl_summary(claims(t), contacts(t), edges(t).select(F.col("l_suppkey").alias("supplier_id"), "published"))


@query(
    "r14_explain",
    f"""WITH {CLAIMS_SQL}, mine AS (SELECT * FROM claims WHERE supplier_id = 7) SELECT 'count' AS part, claim_type AS key, review_state AS value, count(*) AS n FROM mine GROUP BY 2, 3
    UNION ALL SELECT 'value', claim_type, raw_value, count(*) FROM mine WHERE claim_type IN ('SERVICE_LISTED', 'SOCIAL') GROUP BY 2, 3""",
)
def r14(t):
    return rp.explain_supplier(claims(t), 7)


NAMES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages")


@query(
    "r15_table_counts",
    " UNION ALL ".join(f"SELECT 'rows' AS part, '{n}' AS key, count(*) AS n FROM {n}" for n in NAMES)
    + """ UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'flag', l_returnflag, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'probe', '#00000001', count(*) FROM supplier WHERE contains(s_name, '#00000001') UNION ALL SELECT 'probe', 'SUPPLIER', count(*) FROM supplier WHERE contains(lower(s_name), 'supplier') UNION ALL SELECT 'not smoke', 'companies', count(*) FROM supplier WHERE NOT contains(s_name, '00007')""",
)
def r15(t):
    statuses = {"order": (t.orders, "o_orderstatus"), "segment": (t.customer, "c_mktsegment"), "flag": (t.lineitem, "l_returnflag")}
    return rp.table_counts({n: getattr(t, n) for n in NAMES}, statuses, t.supplier.select(F.col("s_name").alias("name")), ["#00000001", "SUPPLIER"], "00007")


@query(
    "r16_recall_diagnosis",
    """WITH n AS (SELECT count(*) AS n FROM supplier), host AS (SELECT page_id % n AS supplier_id, page_id, url, substr(html, 1, 250) AS s FROM pages, n),
    own AS (SELECT p_partkey % n AS supplier_id, string_agg(p_brand, '|' ORDER BY p_partkey) AS v FROM part, n WHERE p_size = 50 GROUP BY 1),
    sample AS (SELECT supplier_id, string_agg(url || ': ' || s, '|' ORDER BY page_id) AS v
      FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY page_id) AS rn FROM host) WHERE rn <= 3 GROUP BY 1)
    SELECT sample.supplier_id, coalesce(own.v, '') AS capabilities, CASE WHEN own.v IS NULL THEN sample.v ELSE '' END AS samples FROM sample LEFT JOIN own ON own.supplier_id = sample.supplier_id""",
)
def r16(t):
    """Pages and parts of the largest size as the pages and capabilities of suppliers in turn."""
    n = t.supplier.count()
    pages = t.pages.select((F.col("page_id") % n).alias("supplier_id"), "page_id", F.col("url").alias("title"), F.col("html").alias("text"))
    k = F.col("p_partkey")
    facts = t.part.where("p_size = 50").select((k % n).alias("supplier_id"), F.lit("CAPABILITY").alias("claim_type"), F.col("p_brand").alias("raw_value"), k.alias("seq"))
    return rp.recall_diagnosis(pages, facts).select("supplier_id", F.array_join("capabilities", "|").alias("capabilities"), F.array_join("samples", "|").alias("samples"))


@query(
    "r17_rebuilt_audit",
    f"WITH {FLAGS_SQL} SELECT supplier_id, has_email OR has_phone AS usable_contact, has_capability, waiting, CASE WHEN crawl <> 'failed' AND (has_email OR has_phone) AND has_capability AND waiting <= 8 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM flags",
)
def r17(t):
    return rp.rebuilt_audit(flags(t))
