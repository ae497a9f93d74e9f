"""Queries of publishing over all lines as claims: the brands of parts are the entries of each dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import publishing as pb
from quarry.plans.registry import query

TYPES = ["CAPABILITY", "CERTIFICATION", "INDUSTRY", "EQUIPMENT", "SERVICE_REGION", "CONTACT", "LOCATION", "OTHER"]
_TYPE_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TYPES)) + " END"
CLAIMS_SQL = rf"""brands AS (SELECT DISTINCT p_brand AS name, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part),
line AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS claim_id, l_suppkey AS supplier_id, {_TYPE_SQL} AS claim_type, p_brand, l_linenumber % 5 AS way, l_returnflag, slug AS own FROM lineitem JOIN part ON p_partkey = l_partkey JOIN brands ON name = p_brand),
parts_of AS (SELECT b.name, min(o.slug) AS slug FROM brands b JOIN brands o ON contains(lower(o.name), lower(b.name[2:])) GROUP BY b.name)"""


def _brands(t):
    return t.part.select(F.col("p_brand").alias("name")).distinct().withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", ""))


def _claims(t):
    """A claim for each line; its value is the brand's slug, its name in capitals, an alias, a piece of its name, or nothing known."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % 8 + 1).cast("int"))
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    slug, way = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), F.col("l_linenumber") % 5
    value = F.when(way == 0, slug).when(way == 1, F.upper("p_brand")).when(way == 2, F.concat(F.lit("Make of "), "p_brand")).when(way == 3, F.substr("p_brand", F.lit(2))).otherwise("no such thing")
    number = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    return rows.select(number.alias("claim_id"), F.col("l_suppkey").alias("supplier_id"), kind.alias("claim_type"), value.alias("raw_value"), F.when(way < 3, value).alias("normalized_value"), "l_returnflag", slug.alias("own"))


@query(
    "b1_publish_links",
    rf"""WITH {CLAIMS_SQL}, said AS (SELECT claim_type, supplier_id, claim_id, CASE WHEN way < 2 THEN own WHEN way = 2 AND claim_type = 'CAPABILITY' THEN own WHEN way = 3 THEN parts_of.slug END AS slug FROM line JOIN parts_of ON parts_of.name = p_brand WHERE l_returnflag <> 'R' AND claim_type NOT IN ('CONTACT', 'LOCATION', 'OTHER')),
    new AS (SELECT claim_type, supplier_id, slug, max(claim_id) AS claim FROM said WHERE slug IS NOT NULL GROUP BY 1, 2, 3), old AS (SELECT DISTINCT claim_type, supplier_id, own AS slug FROM line WHERE l_returnflag = 'R' AND claim_type NOT IN ('CONTACT', 'LOCATION', 'OTHER'))
    SELECT claim_type, supplier_id, slug, CASE WHEN old.slug IS NULL THEN 'created' WHEN claim IS NULL OR claim_type IN ('INDUSTRY', 'EQUIPMENT') THEN 'kept' ELSE 'updated' END AS outcome,
    old.slug IS NULL OR (claim IS NOT NULL AND claim_type IN ('CAPABILITY', 'CERTIFICATION')) AS published, CASE WHEN old.slug IS NULL OR (claim IS NOT NULL AND claim_type NOT IN ('INDUSTRY', 'EQUIPMENT')) THEN 'VERIFIED' ELSE 'SEEDED' END AS state,
    CASE WHEN old.slug IS NULL OR (claim IS NOT NULL AND claim_type IN ('CAPABILITY', 'CERTIFICATION')) THEN claim ELSE 0 END AS claim_id FROM new FULL JOIN old USING (claim_type, supplier_id, slug)""",
)
def b1_links(t):
    """Five types of links published at once over those of returned lines."""
    claims, brands = _claims(t), _brands(t)
    types = F.explode(F.array(*map(F.lit, pb.DICTIONARY_TYPES))).alias("claim_type")
    dictionary = brands.select(types, "slug", "name")
    aliases = brands.select(F.lit("CAPABILITY").alias("claim_type"), F.concat(F.lit("Make of "), "name").alias("alias"), "slug")
    linked = claims.where(F.col("claim_type").isin(*pb.DICTIONARY_TYPES))
    current = linked.where("l_returnflag = 'R'").select("claim_type", "supplier_id", F.col("own").alias("slug"), F.lit(False).alias("published"), F.lit("SEEDED").alias("state"), F.lit(0).cast("long").alias("claim_id")).distinct()
    out = pb.publish_links(claims.where("l_returnflag <> 'R'"), current, dictionary, aliases, by_person=True)
    return out.select("claim_type", "supplier_id", "slug", "outcome", "published", "state", "claim_id")


@query("b1_publish_targets", f"WITH {CLAIMS_SQL} SELECT supplier_id, CASE claim_type WHEN 'CONTACT' THEN 'CHOOSE_CONTACTS' ELSE 'PUT_LOCATIONS' END AS target, count(*) AS claims FROM line WHERE claim_type IN ('CONTACT', 'LOCATION') GROUP BY 1, 2")
def b1_targets(t):
    """Suppliers whose contacts are chosen anew or whose locations are put in."""
    return pb.publish_targets(_claims(t))


@query(
    "b1_reviewed",
    f"""WITH {CLAIMS_SQL}, c AS (SELECT *, CASE way WHEN 0 THEN own WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'Make of ' || p_brand END AS form FROM line), a AS (SELECT * FROM c WHERE claim_id % 1000 = 7)
    SELECT claim_id, CASE WHEN claim_id % 1000 = 7 OR EXISTS (SELECT 1 FROM a WHERE a.supplier_id = c.supplier_id AND a.claim_type = c.claim_type AND a.form = c.form) THEN 'AUTO_APPROVED' ELSE 'UNREVIEWED' END AS review_state FROM c""",
)
def b1_reviewed(t):
    """Review states of all claims after some are approved by the validator."""
    claims = _claims(t).withColumn("review_state", F.lit("UNREVIEWED"))
    return pb.reviewed(claims, claims.where("claim_id % 1000 = 7"), "SYSTEM_VALIDATOR", by_person=False).select("claim_id", "review_state")
