"""More extractors: equipment, industries, certifications, service regions and listed standards. Each maps a parsed page's text units to claims with built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as u
from quarry.operators.extract import match_context
from quarry.operators.terms import dictionary_matches

# Wording of ownership, of customers, of plans and of others' certifications, of coverage, and shapes of standards and bodies.
OWNERSHIP = r"(?i)\b(?:we\s+(?:have|own|operate|run|use)|our\s+(?:shop|facility|fleet|equipment|machines?)|equipped\s+with|capable\s+of|in-house|\d+\s*(?:ton|tons|t|ft|foot|feet|mm|in|inch|x)\b|capacity)"
INDUSTRY_CONTEXT = r"(?i)\b(?:industr(?:y|ies)|sectors?|markets?|serv(?:e|es|ed|ing)|clients?|customers?|experience\s+in|work(?:ed)?\s+(?:in|with|for))\b"
TENTATIVE = r"(?i)\b(?:working\s+towards?|pursuing|in\s+progress|applying\s+for|expected\s+(?:to|in)|planned|seeking)\b"
OTHERS_HOLD_IT = r"(?i)\b(?:our\s+(?:suppliers?|vendors?|partners?|clients?|customers?)|require[sd]?\s+(?:by|that)|must\s+be)\b"
#: Built-in certifications: slug, name, patterns of which acronyms keep their case, base confidence, wording that supports it (fixed values).
CERTIFICATIONS = [
    ("cwb-w47-1", "CWB W47.1 Certification", r"(?i)(?<![A-Za-z0-9])(?:CSA\s*)?W\s?47\.1(?![0-9])", 0.85, None),
    ("cwb-certified", "CWB Certified (Standard Unspecified)", r"(?i)(?<![A-Za-z0-9])CWB[\s-]+(?:certified|certification|approved)|certified\s+(?:by|to|with)\s+(?:the\s+)?(?:CWB|Canadian\s+Welding\s+Bureau)", 0.75, None),
    ("cwb-organization", "Canadian Welding Bureau (Organization Mention)", r"(?i)Canadian\s+Welding\s+Bureau", 0.6, None),
    ("iso-9001", "ISO 9001 Quality Management", r"(?i)(?<![A-Za-z0-9])ISO[\s\-:]*9001(?![0-9])", 0.8, None),
    ("cor-safety", "COR Safety Certification", r"(?<![A-Za-z0-9])COR(?![A-Za-z0-9])(?!\s*-\s*\d)|(?i:certificate\s+of\s+recognition)", 0.8, None),
    ("asme-pressure-vessel", "ASME Pressure Piping / Vessel", r"(?<![A-Za-z0-9])ASME(?![A-Za-z0-9])", 0.8, r"(?i)certif|accredit|stamp|registered|code|section\s+viii|b31|procedure|qualified|standard"),
]
COVERAGE_CUE = r"(?i)\b(?:serv(?:e|es|ed|ing)|servicing|provid(?:e|es|ing)\s+(?:services?\s+)?(?:to|in|across|throughout)|operat(?:e|es|ing)\s+(?:across|throughout|in)|coverage\s+(?:across|throughout|of|in)|service\s+area|clients?\s+(?:across|throughout))"
STANDARD = r"\b[A-Z]{2,}(?:\s*/\s*[A-Z]{2,})*[\s\-/]*[A-Z]?\d[\w.\-:/()]*"
BODY = r"\b(?:Association|Institute|Council|Bureau|Society|Alliance|Federation|Chamber|Board|Agency)\b"
NOT_A_STANDARD = r"(?i)\b(?:\d{3}[-.\s]\d{3}[-.\s]\d{4}|[A-Z]\d[A-Z]\s?\d[A-Z]\d|copyright|all rights|suite|street|avenue|road)\b|©"


def units_of(parsed: DataFrame, keys: list[str], headings: bool = False, alts: bool = False) -> DataFrame:
    """(keys, url, seq, text, locator, weight): text units, and headings and image texts if asked for."""
    unit = lambda x, locator, weight: F.struct(x.alias("text"), F.lit(locator).alias("locator"), F.lit(weight).alias("weight"))
    parts = [F.transform(tx.text_units(F.col("page.content_text")), lambda x: unit(x, "body_text", 1.0))]
    if headings:
        parts.append(F.transform("page.headings", lambda h: unit(h["text"], "heading", 1.0)))
    if alts:
        parts.append(F.transform("page.image_alts", lambda x: unit(x, "image_alt", 0.85)))
    return parsed.select(*keys, "url", F.posexplode(F.concat(*parts)).alias("seq", "u")).select(*keys, "url", "seq", "u.*")


def _best(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The most confident claim of each value on a page, the first among equals. rows hold slug, name, confidence, locator, method, seq, place."""
    best = rows.groupBy(*keys, F.col("slug").alias("normalized_value")).agg(F.max_by(F.struct("name", "confidence", "locator", "method", "seq"), F.struct("confidence", (-F.col("seq")).alias("s"), (-F.col("place")).alias("p"))).alias("b"))
    return best.select(*keys, F.lit(kind).alias("claim_type"), F.col("b.name").alias("raw_value"), "normalized_value", F.col("b.locator").alias("evidence_locator"), F.col("b.method").alias("extraction_method"), F.round("b.confidence", 3).alias("confidence"), F.col("b.seq").alias("seq"))


def _terms(rows: DataFrame, terms: list[tuple[str, str, list[str]]]) -> DataFrame:
    """rows with a row for each term found: slug, name, canonical, found, at, place. terms: (slug, name, other wording), a dictionary of bounded size. Of a phrase's matches in a unit the first counts."""
    phrases = [(slug, name, phrase) for slug, name, others in terms for phrase in [name, *others]]
    term = F.element_at(F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(n).alias("name"), F.lit(p == n).alias("canonical")) for s, n, p in phrases]), F.col("m.i") + 1)
    found = rows.withColumn("all", dictionary_matches(F.col("text"), [p for _, _, p in phrases]))
    first = F.filter("all", lambda m, i: (i == 0) | (F.get("all", i - 1)["i"] != m["i"]))
    met = found.withColumn("m", F.explode(first)).withColumn("t", term)
    return met.select("*", "t.*", F.col("m.found").alias("found"), F.col("m.at").alias("at"), F.col("m.i").alias("place")).drop("all", "m", "t")


def equipment_claims(parsed: DataFrame, keys: list[str], terms: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Machines: 0.9 on equipment pages, 0.85 with wording of ownership or size, 0.72 else; 0.5 where they are sold or explained."""
    met = _terms(units_of(parsed, keys), terms).withColumn("c", match_context(F.col("text"), F.col("found"), F.col("at"))["context"])
    page = (u.classify(F.col("url"), F.lit("")) == "EQUIPMENT") | F.col("url").rlike("(?i)/(?:equip|machin|facilit)")
    confidence = F.when(F.col("c").isin("RESALE", "EXPLANATION"), 0.5).when(page, 0.9).when(F.col("text").rlike(OWNERSHIP), 0.85).otherwise(0.72)
    return _best(met.withColumns({"confidence": confidence, "method": F.when(F.col("canonical"), "TAXONOMY_EXACT").otherwise("TAXONOMY_ALIAS")}), keys, "EQUIPMENT")


def industry_claims(parsed: DataFrame, keys: list[str], terms: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Industries: the name 0.9 with wording of customers or on an industries page, 0.75 without; other wording 0.82 and 0.6."""
    met = _terms(units_of(parsed, keys, headings=True), terms)
    near = (u.classify(F.col("url"), F.lit("")) == "INDUSTRIES") | F.col("url").rlike("(?i)/industr") | F.col("text").rlike(INDUSTRY_CONTEXT)
    confidence = F.when(F.col("canonical"), F.when(near, 0.9).otherwise(0.75)).otherwise(F.when(near, 0.82).otherwise(0.6))
    return _best(met.withColumns({"confidence": confidence, "method": F.when(F.col("canonical"), "TAXONOMY_EXACT").otherwise("TAXONOMY_ALIAS")}), keys, "INDUSTRY")


def certification_claims(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Certifications by whole tokens. Welding certifications fall into three kinds of which the first that fits counts; wording that others hold one or that it is under way costs 40 %, image texts 15 %, missing support 30 %."""
    text = F.col("text")
    qualifier = F.when(text.rlike(TENTATIVE) | text.rlike(OTHERS_HOLD_IT), 0.6).otherwise(1.0)
    hits, welding = [], F.lit(False)
    for place, (slug, name, pattern, base, support) in enumerate(CERTIFICATIONS):
        fits = text.rlike(pattern)
        weight = F.lit(base) * qualifier
        if slug.startswith("cwb"):
            fits, welding = fits & ~welding, welding | fits
        else:
            weight = weight * F.col("weight") * (F.when(text.rlike(support), 1.0).otherwise(0.7) if support else F.lit(1.0))
        hits.append(F.when(fits, F.struct(F.lit(slug).alias("slug"), F.lit(name).alias("name"), weight.alias("confidence"), F.lit(place).alias("place"))))
    met = units_of(parsed, keys, headings=True, alts=True).withColumn("t", F.explode(F.array_compact(F.array(*hits)))).select("*", "t.*").drop("t")
    return _best(met.withColumn("method", F.lit("TAXONOMY_EXACT")), keys, "CERTIFICATION")


def region_claims(parsed: DataFrame, keys: list[str], regions: list[tuple[str, str, str]], window: int = 90) -> DataFrame:
    """Service regions named within a clause, and within `window` characters, after a statement of coverage. regions: (slug, name, pattern)."""
    rows = units_of(parsed, keys)
    clauses = F.regexp_extract_all("text", F.lit(rf"{COVERAGE_CUE}([^.;!?\n]{{0,{window}}})"), F.lit(1))
    in_clause = lambda pattern: F.exists(clauses, lambda c: c.rlike(pattern))
    hits = [F.when(in_clause(pattern), F.struct(F.lit(slug).alias("slug"), F.lit(name).alias("name"), F.lit(i).alias("place"))) for i, (slug, name, pattern) in enumerate(regions)]
    met = rows.where(F.col("text").rlike(COVERAGE_CUE)).withColumn("t", F.explode(F.array_compact(F.array(*hits)))).select("*", "t.*").drop("t")
    return _best(met.withColumns({"confidence": F.lit(0.9), "method": F.lit("TAXONOMY_PHRASE")}), keys, "SERVICE_REGION")


def listed_certification_claims(parsed: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """Standards and associations listed on a certifications page, the first `most` of each page."""
    page = (u.classify(F.col("url"), F.lit("")) == "CERTIFICATIONS") | u.path(F.col("url")).rlike("(?i)certif|affiliation|accreditation|approvals|quality|memberships?|standards|compliance")
    clean = lambda x: tx.collapse(F.regexp_replace(x, r"^[\s•·\-–—*]+", ""))
    lines = F.transform(F.concat(F.split("page.content_text", "\n"), F.transform("page.headings", lambda h: h["text"])), clean)
    fits = lambda x: F.length(x).between(3, 90) & (F.size(F.split(x, " ")) <= 12) & ~x.rlike("[.!?]$") & ~x.rlike(NOT_A_STANDARD) & ((x.rlike(STANDARD) & ~x.rlike(r"^\d{4}$")) | (x.rlike(BODY) & x.rlike("^[A-Z]")))
    rows = parsed.where(page).select(*keys, F.posexplode(F.filter(lines, fits)).alias("seq", "raw_value")).withColumn("normalized_value", F.regexp_replace(F.lower("raw_value"), "[^a-z0-9]+", "-"))
    first = rows.groupBy(*keys, "normalized_value").agg(F.min_by("raw_value", "seq").alias("raw_value"), F.min("seq").alias("seq"))
    from quarry.operators.relational import rank_within

    kept = rank_within(first, keys, [F.asc("seq")], most).drop("rn")
    return kept.select(*keys, F.lit("CERTIFICATION_LISTED").alias("claim_type"), "raw_value", "normalized_value", F.lit("CERTIFICATIONS_PAGE_LIST").alias("evidence_locator"), F.lit("PAGE_STRUCTURE").alias("extraction_method"), F.lit(0.8).alias("confidence"), "seq")


POSTAL = r"\b([A-Z]\d[A-Z])[ -]?(\d[A-Z]\d)\b"


def parse_address(text: Column, towns: dict[str, str], provinces_by_postal: dict[str, str]) -> Column:
    """struct(city, province, postal): the last known town named, the province of the postal code's first letter, else of the town. towns: name -> province; longest names are tried first."""
    low = F.upper(text)
    postal = F.concat_ws(" ", F.nullif(F.regexp_extract(low, POSTAL, 1), F.lit("")), F.nullif(F.regexp_extract(low, POSTAL, 2), F.lit("")))
    names = sorted(towns, key=len, reverse=True)
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, names)) + r")(?!['’]s)(?![\p{L}\p{N}])"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    place = F.lower(F.try_element_at(found, F.lit(-1)))
    entry = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    city = F.try_element_at(entry({n.lower(): n for n in names}), place)
    province = F.coalesce(F.try_element_at(entry(provinces_by_postal), F.substring(postal, 1, 1)), F.try_element_at(entry({n.lower(): p for n, p in towns.items()}), place))
    return F.struct(city.alias("city"), province.alias("province"), F.nullif(postal, F.lit("")).alias("postal"))


def publish_locations(existing: DataFrame, claims: DataFrame) -> DataFrame:
    """Address claims put into the list of locations, in claim order: the outcome of each claim.

    existing (supplier_id, city, postal, address, placeholder); claims (supplier_id, seq, city, postal, address, role). Claims that are no company's place or without a town are SKIPPED; one whose postal code or address the supplier has, or an earlier claim has, is UPDATED_EXISTING; the first
    new address in a placeholder's city is FILLED_PLACEHOLDER; others are ADDED. An address claimed twice, by code or by text, is the same place; joins find all this, no row waits for another.
    """
    norm = lambda c: F.lower(tx.strip(tx.or_empty(F.col(c))))
    code = lambda c: F.upper(F.regexp_replace(tx.or_empty(F.col(c)), r"\s", ""))
    have = existing.select("supplier_id", norm("address").alias("a"), code("postal").alias("p"), norm("city").alias("c"), "placeholder")
    rows = claims.select("supplier_id", "seq", "role", norm("address").alias("a"), code("postal").alias("p"), norm("city").alias("c"))
    usable = rows.where(~F.coalesce(F.col("role").isin("PROJECT_OR_CLIENT_LOCATION", "OUT_OF_REGION"), F.lit(False)) & (F.col("c") != ""))
    keys = lambda d: d.select("*", F.explode(F.filter(F.array(F.concat(F.lit("a:"), "a"), F.when(F.col("p") != "", F.concat(F.lit("p:"), "p"))), lambda x: x.isNotNull() & (x != "a:"))).alias("key"))
    old = keys(have).select("supplier_id", "key").distinct().withColumn("old", F.lit(True))
    first = keys(usable).groupBy("supplier_id", "key").agg(F.min("seq").alias("first"))
    state = keys(usable).join(old, ["supplier_id", "key"], "left").join(first, ["supplier_id", "key"]).groupBy("supplier_id", "seq").agg(F.bool_or(F.coalesce("old", F.lit(False)) | (F.col("first") < F.col("seq"))).alias("same"))
    fresh = usable.join(state, ["supplier_id", "seq"], "left").withColumn("same", F.coalesce("same", F.lit(False)))
    holes = have.where("placeholder").groupBy("supplier_id", "c").agg(F.count(F.lit(1)).alias("holes"))
    new = fresh.where(~F.col("same")).join(holes, ["supplier_id", "c"], "left")
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("supplier_id", "c").orderBy("seq"))
    placed = new.withColumn("outcome", F.when(turn <= F.coalesce("holes", F.lit(0)), "FILLED_PLACEHOLDER").otherwise("ADDED")).select("supplier_id", "seq", "outcome")
    known = fresh.where("same").select("supplier_id", "seq", F.lit("UPDATED_EXISTING").alias("outcome")).unionByName(placed)
    return claims.join(known, ["supplier_id", "seq"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("SKIPPED")))
