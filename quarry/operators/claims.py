"""Claims to facts: consolidation, the ordered rule set, review states, contact scoring and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_any, fact_key, if_blank, negated, or_empty, strip
from quarry.operators.relational import first_per_key, first_with_one, rank_within

ENTITY_TYPES = ("CAPABILITY", "INDUSTRY", "EQUIPMENT")


def consolidate(claims: DataFrame) -> DataFrame:
    """Claims that mean the same thing, as one fact each.

    Claims group by supplier, type and canonical key. First-seen values come from the least seq. Review states take the most advanced: APPROVED or VERIFIED, AUTO_APPROVED, AUTO_REJECTED, HUMAN_REVIEW, else UNREVIEWED (so HUMAN_APPROVED falls to the last). A fact is
    contradicted if some of its claims are negated in their evidence or page and some are not. A fact without source addresses has one source.
    """
    keyed = claims.withColumn("slug", fact_key(F.col("claim_type"), F.col("raw_value"), F.col("normalized_value"))).withColumn("neg", negated(F.concat_ws(" ", or_empty(F.col("evidence_text")), or_empty(F.col("page_text")))))
    # First one row for each source, method and state of a fact, so that a hot fact costs what it has of these and not what it has of claims.
    each = keyed.groupBy("supplier_id", "claim_type", "slug", "source_url", "extraction_method", "review_state").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("raw_value", "seq").alias("raw_value"), F.max("confidence").alias("confidence"), F.bool_or("neg").alias("neg"), F.bool_or(~F.col("neg")).alias("plain"), F.min("seq").alias("seq")
    )
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(or_empty(F.col(c)) != "", F.struct("seq", c)))), lambda x: x[c]))
    state = lambda *s: F.bool_or(F.col("review_state").isin(*s))
    facts = each.groupBy("supplier_id", "claim_type", "slug").agg(
        F.sum("n").alias("n_claims"),
        F.min_by("raw_value", "seq").alias("raw_value"),
        in_order("source_url").alias("source_urls"),
        in_order("extraction_method").alias("methods"),
        F.max("confidence").alias("strongest_confidence"),
        (F.bool_or("neg") & F.bool_or("plain")).alias("has_contradictions"),
        F.when(state("APPROVED", "VERIFIED"), "APPROVED").when(state("AUTO_APPROVED"), "AUTO_APPROVED").when(state("AUTO_REJECTED"), "AUTO_REJECTED").when(state("HUMAN_REVIEW"), "HUMAN_REVIEW").otherwise("UNREVIEWED").alias("review_state"),
        F.min_by("extraction_method", "seq").alias("extraction_method"),
        F.min("seq").alias("seq"),
    )
    return facts.withColumn("n_sources", F.greatest(F.size("source_urls"), F.lit(1))).withColumn("fact_id", F.concat_ws(":", "supplier_id", "claim_type", "slug"))


# Wording the rules look for (fixed values). ------------------------------------------------------------------------
INJECTION = r"(?i)ignore\s+(all\s+)?(previous\s+)?instructions|system\s+prompt|you\s+are\s+an?\s+ai|approve\s+(all\s+)?claims|grant\s+verified\s+status|disregard\s+(all\s+)?rules|override\s+decision"
THIRD_PARTY = r"(?i)subcontracted(\s+to)?|outsource[ds]?(\s+to)?|partnered\s+with|client\s+name|on\s+behalf\s+of|third-party|partner\s+vendor|our\s+partner\s+provides|provided\s+by(\s+our)?\s+partner|our\s+customer\s+required|we\s+sourced|project\s+included|subcontractor|vendor\s+supplied|customer\s+supplied"
CERTIFIED = r"(?i)\b(?:certified|certification|certificate|certifications|registered|registration|accredited|accreditation|compliant|compl(?:y|ies|iance)|meets?|approved|qualified|holds?|maintains?|received|achieved|earned|obtained|awarded)\b"
COVERAGE = ["serving", "serve", "service area", "coverage", "operations in", "services across", "across", "throughout", "servicing", "located in"]
COMMERCIAL = ["sales", "estimating", "commercial", "operations", "contact", "services", "engineering", "branch", "manager", "dispatch"]
NOT_FOR_QUOTES = ["hr", "careers", "recruiting", "jobs", "employment", "hiring", "workwithus", "peopleservices", "humanresources", "media", "press", "pr", "communications", "privacy", "legal", "compliance", "gdpr", "investors", "investorrelations", "ir", "payroll", "retirement", "retirementplans", "aphelpdesk", "accountspayable", "corporateresponsibility", "webmaster", "postmaster"]
FOR_QUOTES = ["sales", "info", "estimating", "quotes", "rfq", "procurement", "businessdevelopment", "bizdev", "contact", "inquiries", "inquiry", "orders", "dispatch", "general", "commercial", "projects", "office", "admin", "frontdesk", "help"]
PHONE_NOT_FOR_QUOTES = r"(?i)\b(?:payroll|retirement|helpdesk|help\s+desk|hr|human\s+resources|investors?|investor\s+relations|media\s+(?:inquiries|relations|contact))\b"


def rule_outcome() -> Column:
    """struct(decision, confidence, risk, actor) of a claim row; the rules are tried in order and the first that fits decides.

    Columns used: supplier_domain, claim_type, raw_value, normalized_value, extraction_method, extraction_confidence, page_type, evidence_text, surrounding_context. Nulls count as empty.
    """
    kind, raw, evidence = F.col("claim_type"), or_empty(F.col("raw_value")), or_empty(F.col("evidence_text"))
    context, page, method, confidence = or_empty(F.col("surrounding_context")), or_empty(F.col("page_type")), or_empty(F.col("extraction_method")), F.coalesce("extraction_confidence", F.lit(0.0))
    both = strip(F.concat_ws(" ", evidence, context))
    low = F.lower(strip(raw))
    local, host = F.substring_index(low, "@", 1), F.regexp_extract(low, "@([^@]*)", 1)
    labels = F.size(F.split(host, r"\."))
    domain = F.regexp_replace(F.lower(or_empty(F.col("supplier_domain"))), r"^www\.", "")
    bare = F.regexp_replace(host, r"^www\.", "")
    tokens = F.filter(F.split(local, "[._+-]+"), lambda x: x != "")
    not_quotes = local.isin(*NOT_FOR_QUOTES) | F.exists(tokens, lambda t: t.isin(*NOT_FOR_QUOTES) | t.rlike("^(?:" + "|".join(k for k in NOT_FOR_QUOTES if len(k) >= 5) + ")"))
    dirty = (
        local.startswith("email") | low.rlike("(?:phone|fax|tel)$") | F.contains(host, F.lit("..")) | (labels > 3)
        | ~low.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.(com|ca|org|net|edu|gov|io|co|biz|info)$")
    )
    role = local.rlike("^(?:" + "|".join(FOR_QUOTES) + r")(?:$|[._])")
    own = (domain != "") & ((bare == domain) | bare.endswith(F.concat(F.lit("."), domain)))
    commercial = contains_any(F.concat_ws(" ", evidence, context, page), [*COMMERCIAL, "fabrication", "shop"]) | page.isin("CONTACT", "SERVICES")
    contact = kind.isin("CONTACT", "CONTACT_EMAIL", "CONTACT_PHONE")
    mail = contact & F.contains(raw, F.lit("@"))
    phone = contact & ~F.contains(raw, F.lit("@")) & F.length(F.regexp_replace(raw, r"\D", "")).between(10, 11)
    certification, entity = kind == "CERTIFICATION", kind.isin(*ENTITY_TYPES)
    floor = F.when(kind.isin("CAPABILITY", "EQUIPMENT"), 0.5).when(kind == "INDUSTRY", 0.65)
    claim_words = F.regexp_replace(evidence, "(?i)Matched certification reference in sentence:", "")
    region = contains_any(both, COVERAGE)
    location = kind == "LOCATION"
    rules = [
        (both.rlike(INJECTION), "HUMAN_REVIEW", 0.0, "HIGH", "PROMPT_INJECTION_DEFENSE"),
        (negated(evidence), "REJECT", 0.95, "LOW", "NEGATION_DETECTOR"),
        (both.rlike(THIRD_PARTY), "HUMAN_REVIEW", 0.7, "HIGH", "THIRD_PARTY_DETECTOR"),
        (certification & ((or_empty(F.col("normalized_value")) == "cwb-organization") | (confidence < 0.65)), "REJECT", 0.85, "LOW", "WEAK_CERTIFICATION_MENTION"),
        (certification & (page != "CERTIFICATIONS") & ~claim_words.rlike(CERTIFIED) & ~F.concat_ws(" ", evidence, context).rlike("(?i)image_alt|logo"), "REJECT", 0.8, "LOW", "CERTIFICATION_NO_CLAIM"),
        (certification, "HUMAN_REVIEW", 0.85, "MEDIUM", "CERTIFICATION_SAFEGUARD"),
        (kind.isin("COMPANY_OWNERSHIP", "CLAIM_REQUEST"), "HUMAN_REVIEW", 0.9, "HIGH", "OWNERSHIP_SAFEGUARD"),
        (mail & dirty, "HUMAN_REVIEW", 0.5, "MEDIUM", "DIRTY_EMAIL_SAFEGUARD"),
        (mail & not_quotes, "REJECT", 0.95, "LOW", "EXCLUDE_NON_RFQ_CONTACT"),
        (mail & local.rlike(r"businessinquiry\.(anz|sea|gc|emia)"), "REJECT", 0.9, "LOW", "EXCLUDE_FOREIGN_HUB"),
        (mail & role, "APPROVE", 0.98, "LOW", "ROLE_RFQ_EMAIL"),
        (mail & own & commercial, "APPROVE", 0.92, "LOW", "SUPPLIER_DOMAIN_EMPLOYEE_EMAIL"),
        (mail & own, "HUMAN_REVIEW", 0.6, "MEDIUM", "EMPLOYEE_EMAIL_CONTEXT_CHECK"),
        (mail, "HUMAN_REVIEW", 0.5, "HIGH", "THIRD_PARTY_EMAIL_SAFEGUARD"),
        (phone & evidence.rlike(PHONE_NOT_FOR_QUOTES), "REJECT", 0.9, "LOW", "EXCLUDE_NON_RFQ_PHONE"),
        (phone, "APPROVE", 0.95, "LOW", "EXPLICIT_PHONE_FACT"),
        (entity & (confidence < floor) & (method != "TAXONOMY_PHRASE"), "REJECT", 0.85, "LOW", "WEAK_MENTION_REJECT"),
        (entity & (confidence < 0.8), "HUMAN_REVIEW", confidence, "MEDIUM", "WEAK_CONTEXT_MATCH"),
        (entity & method.isin("TAXONOMY_EXACT", "TAXONOMY_ALIAS"), "APPROVE", 0.95, "LOW", "EXACT_TAXONOMY_CAPABILITY"),
        (location & (F.contains(both, F.lit("Role: PROJECT_OR_CLIENT_LOCATION")) | F.contains(F.lower(both), F.lit("project location"))), "REJECT", 0.95, "LOW", "EXCLUDE_PROJECT_LOCATION"),
        (location & F.contains(both, F.lit("Role: OUT_OF_REGION")), "HUMAN_REVIEW", 0.6, "MEDIUM", "OUT_OF_REGION_LOCATION"),
        (location & F.contains(both, F.lit("Role: UNKNOWN")), "HUMAN_REVIEW", 0.6, "MEDIUM", "UNKNOWN_LOCATION_ROLE"),
        (location & (F.length(strip(raw)) > 2), "APPROVE", 0.92, "LOW", "EXPLICIT_LOCATION_FACT"),
        ((kind == "SERVICE_REGION") & ~region, "HUMAN_REVIEW", 0.6, "MEDIUM", "SERVICE_REGION_COVERAGE_CHECK"),
        (kind == "SERVICE_REGION", "APPROVE", 0.9, "LOW", "EXPLICIT_SERVICE_REGION"),
        (kind == "CERTIFICATION_LISTED", "APPROVE", confidence, "LOW", "LISTED_CERTIFICATION"),
        (kind.isin("SERVICE_LISTED", "PRODUCT_LISTED") & (confidence >= 0.85), "APPROVE", confidence, "LOW", "LISTED_SERVICE"),
        (kind.isin("SERVICE_LISTED", "PRODUCT_LISTED"), "HUMAN_REVIEW", confidence, "MEDIUM", "LISTED_SERVICE_UNCLEAR"),
        (kind.isin("SOCIAL", "BUSINESS_HOURS"), "APPROVE", 0.9, "LOW", "SOCIAL_LINK"),
    ]

    def outcome(decision: str, certainty, risk: str, actor: str) -> Column:
        number = certainty if isinstance(certainty, Column) else F.lit(certainty)
        return F.struct(F.lit(decision).alias("decision"), number.cast("double").alias("confidence"), F.lit(risk).alias("risk"), F.lit(f"RULE_ENGINE:{actor}").alias("actor"))

    first, *others = rules
    case = F.when(F.coalesce(first[0], F.lit(False)), outcome(*first[1:]))
    for fits, *what in others:
        case = case.when(F.coalesce(fits, F.lit(False)), outcome(*what))
    return case.otherwise(outcome("HUMAN_REVIEW", 0.6, "MEDIUM", "FALLBACK_HEURISTIC"))


def claim_context(page_text: Column, raw: Column, evidence: Column, radius: int = 200) -> Column:
    """The page text around the value, or around the first 60 characters of the quoted evidence; null where neither occurs."""
    flat = F.regexp_replace(page_text, r"\s+", " ")
    quoted = F.substring(F.regexp_extract(or_empty(evidence), r'"([^"]{12,})"', 1), 1, 60)

    def around(probe: Column) -> Column:
        at = F.instr(F.lower(flat), F.lower(F.regexp_replace(probe, r"\s+", " ")))
        begin = F.greatest(at - radius, F.lit(1))
        return F.when((strip(or_empty(probe)) != "") & (at > 0), F.substr(flat, begin, at + F.length(probe) + radius - begin))

    return F.coalesce(around(raw), around(quoted))


def review_state(decision: Column, risk: Column, prior: Column, publish_low_risk: bool = False) -> Column:
    """The state a verdict leads to; a person's earlier decision stays."""
    approve = F.lit("AUTO_APPROVED" if publish_low_risk else "HUMAN_REVIEW")
    return F.coalesce(prior, F.when((decision == "APPROVE") & (risk == "LOW"), approve).when((decision == "REJECT") & (risk == "LOW"), "AUTO_REJECTED").otherwise("HUMAN_REVIEW"))


def batch_stats(facts: DataFrame, keys: list[str], publish_low_risk: bool = False) -> DataFrame:
    """facts (keys, n_claims, decision, risk, prior) -> keys and the seven counters of a validation run, summed before the shuffle.

    prior is the state that a person gave the fact earlier, or null. Facts with a prior state count as published if it publishes them and as nothing
    else; others by the state that the verdict leads to, of which AUTO_APPROVED is published. A fact without claims counts as one of none.
    """
    state, judged = review_state(F.col("decision"), F.col("risk"), F.lit(None).cast("string"), publish_low_risk), F.col("prior").isNull()
    n = F.coalesce("n_claims", F.lit(0))
    return facts.groupBy(*keys).agg(
        F.sum(n).alias("processed"), F.count("*").alias("facts"), F.count_if(judged & (state == "AUTO_APPROVED")).alias("auto_approved"), F.count_if(judged & (state == "AUTO_REJECTED")).alias("auto_rejected"),
        F.count_if(judged & (state == "HUMAN_REVIEW")).alias("needs_review"), F.count_if(F.when(judged, state == "AUTO_APPROVED").otherwise(F.col("prior").isin("HUMAN_APPROVED", "VERIFIED"))).alias("published"),
        (F.sum(n) - F.count("*")).alias("collapsed"),
    )


def validate(claims: DataFrame, prior: DataFrame | None = None, publish_low_risk: bool = False) -> DataFrame:
    """Adds verdict (the rules' struct) and new_state. prior: (supplier_id, claim_type, slug, review_state, updated_at) of people's decisions, of which the latest counts."""
    out = claims.withColumn("verdict", rule_outcome())
    if prior is None:
        return out.withColumn("new_state", review_state(F.col("verdict.decision"), F.col("verdict.risk"), F.lit(None).cast("string"), publish_low_risk))
    latest = prior.groupBy("supplier_id", "claim_type", "slug").agg(F.max_by("review_state", "updated_at").alias("_prior"))
    keyed = out.withColumn("slug", fact_key(F.col("claim_type"), F.col("raw_value"), F.col("normalized_value"))).join(latest, ["supplier_id", "claim_type", "slug"], "left")
    return keyed.withColumn("new_state", review_state(F.col("verdict.decision"), F.col("verdict.risk"), F.col("_prior"), publish_low_risk)).drop("_prior")


# Contacts ------------------------------------------------------------------------------------------------------------
EXCLUDED_ROLES = ["webmaster", "privacy", "gdpr", "dpo", "legal", "counsel", "compliance", "ethics", "terms", "careers", "hr", "jobs", "employment", "recruiting", "recruitment", "talent", "humanresources", "peopleservices", "externalpeopleservices", "payroll", "pay", "salary", "remuneration", "retirement", "retirementplans", "pension", "benefits", "401k", "rrsp", "media", "press", "pr", "communications", "news", "postmaster", "hostmaster", "abuse", "security", "phishing", "cyber", "investor", "investors", "ir", "shareholder", "shareholders"]
FREE_HOSTS = ["gmail.com", "yahoo.com", "yahoo.ca", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com"]
LOCAL_CODES = ["506", "428", "902", "782", "709", "879"]
TOLL_FREE_CODES = ["800", "833", "844", "855", "866", "877", "888"]


def domains_match(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def usable_email(email: Column, domain: Column, evidence: Column) -> Column:
    """Whether a quote request can go to the address: no excluded role in its local part, the supplier's domain unless the evidence speaks of quotes, free hosts only with context."""
    low = F.lower(strip(or_empty(email)))
    local, host = F.substring_index(low, "@", 1), F.regexp_extract(low, "@([^@]*)", 1)
    bad_role = F.exists(F.split(local, "[^a-z0-9]+"), lambda t: t.isin(*EXCLUDED_ROLES)) | local.rlike("peopleservices|humanresources|retirementplans|externalpeople")
    own = F.regexp_replace(F.lower(strip(or_empty(domain))), r"^www\.", "")
    foreign = (or_empty(domain) != "") & ~domains_match(F.regexp_replace(host, r"^www\.", ""), own) & ~contains_any(evidence, ["rfq", "quote", "estimating", "sales contact"])
    free = host.isin(*FREE_HOSTS) & ~contains_any(evidence, ["mailto:", "contact", "sales", "phone", "email"])
    return F.contains(low, F.lit("@")) & (local != "") & (host != "") & ~bad_role & ~foreign & ~free


def usable_phone(phone: Column) -> Column:
    """Ten digits or more that aren't one digit over and over or a dummy."""
    digits = F.regexp_replace(or_empty(phone), r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (F.length(digits) >= 10) & ~ten.rlike(r"^(\d)\1{9}$") & ~ten.isin("1234567890", "0000000026")


def contact_score(value: Column, domain: Column, evidence: Column, page_type: Column) -> Column:
    """struct(score, kind) of an address or number for quote requests; score 0 where it must not be used."""
    low = F.lower(strip(or_empty(value)))
    digits = F.regexp_replace(low, r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    context = F.lower(F.concat_ws(" ", or_empty(evidence), or_empty(page_type)))
    local, host = F.substring_index(low, "@", 1), F.regexp_replace(F.regexp_extract(low, "@([^@]*)", 1), r"^www\.", "")
    own = F.regexp_replace(F.lower(strip(or_empty(domain))), r"^www\.", "")
    is_phone = ~F.contains(low, F.lit("@")) & (F.length(digits) >= 7)
    code = F.substring(ten, 1, 3)
    mine = (own != "") & domains_match(host, own)
    commercial = contains_any(context, COMMERCIAL) | page_type.isin("CONTACT", "SERVICES")
    form = lambda score, kind: F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"))
    general = "info|inquiries|inquiry|contact|general|office|admin|frontdesk|orders|commercial"
    return (
        F.when(is_phone & (~usable_phone(low) | context.rlike(r"\b(payroll|retirement|helpdesk|hr|investors?|media|careers?|recruiting)\b")), form(0, "GENERAL"))
        .when(is_phone & code.isin(*LOCAL_CODES), form(450, "GENERAL"))
        .when(is_phone & code.isin(*TOLL_FREE_CODES), form(420, "GENERAL"))
        .when(is_phone, form(200, "GENERAL"))
        .when(~F.contains(low, F.lit("@")) | ~usable_email(low, domain, evidence), form(0, "OTHER"))
        .when(local.rlike("^rfq(?:$|[._])"), form(1000, "PROCUREMENT"))
        .when(local.rlike(r"^(?:estimating(?:$|[._])|quotes$|quote(?:$|\.))"), form(900, "ESTIMATING"))
        .when(local.rlike("^sales(?:$|[._])"), form(850, "SALES"))
        .when(local.rlike("^procurement(?:$|[._])"), form(800, "PROCUREMENT"))
        .when(local.rlike(r"^(?:businessdevelopment|bizdev)(?:$|\.)"), form(750, "SALES"))
        .when(local.rlike(f"^(?:{general})(?:$|[._])"), form(600, "GENERAL"))
        .when(mine & F.coalesce(commercial, F.lit(False)), form(500, "INDIVIDUAL_BUSINESS_CONTACT"))
        .when(mine, form(300, "INDIVIDUAL_BUSINESS_CONTACT"))
        .otherwise(form(0, "OTHER"))
    )


def select_contacts(claims: DataFrame, chosen: int = 3, most: int = 20) -> DataFrame:
    """claims (supplier_id, seq, raw_value, normalized_value, evidence_text, page_type, supplier_domain, and optionally office, home_city) -> each claim with score, kind and outcome.

    Numbers are compared by their last ten digits, addresses in lower case; the first usable one of each counts and later ones are REJECTED, as are
    unusable ones. Offices in the home city gain 60 points and others lose 20. By score and then first seen: PRIMARY, two BACKUP, the rest EXTRA up to
    `most` in all, others DEMOTED; numbers under 400 points are DEMOTED too. If the first three hold no address, the best address takes the third
    place. seq tells a supplier's claims apart; a null supplier is one of its own.

    A supplier may hold any number of claims: the first of each value is an aggregate, and what is chosen comes of rankings that keep at most `most`
    rows of a supplier in each task. All claims meet the outcomes by supplier and seq, so none lie together for being of one supplier.
    """
    value = strip(if_blank(F.col("normalized_value"), or_empty(F.col("raw_value"))))
    digits, mail = F.regexp_replace(value, r"\D", ""), F.contains(value, F.lit("@"))
    key = F.when(~mail & (F.length(digits) >= 10), F.right(digits, F.lit(10))).otherwise(F.lower(value))
    page_type = F.coalesce(F.col("page_type"), F.lit("")) if "page_type" in claims.columns else F.lit("")
    bonus = F.lit(0)
    if "office" in claims.columns and "home_city" in claims.columns:
        same = F.lower(strip(F.col("office"))) == F.lower(strip(F.col("home_city")))
        bonus = F.when(mail | F.col("office").isNull() | F.col("home_city").isNull(), 0).when(same, 60).otherwise(-20)
    scored = claims.withColumns({"value": value, "_key": key, "is_email": mail, "_bonus": bonus, "_s": contact_score(value, F.col("supplier_domain"), F.col("evidence_text"), page_type)})
    usable = scored.where((F.col("value") != "") & (F.col("_s.score") > 0)).select("supplier_id", "seq", "_key", "is_email", (F.col("_s.score") + F.col("_bonus")).alias("score"))
    once = first_per_key(usable, ["supplier_id", "_key"], ["seq"]).drop("_key")
    order = [F.desc("score"), F.asc("seq")]
    three = first_with_one(once, ["supplier_id"], order, F.col("is_email"), chosen).select("supplier_id", "seq", F.when(F.col("rn") == 1, "PRIMARY").otherwise("BACKUP").alias("outcome"))
    # Among the first `most` that may be extras lie the chosen ones and all the extras there can be.
    near = rank_within(once.where("is_email or score >= 400"), ["supplier_id"], order, most).drop("rn")
    same_claim = lambda a, b: a["supplier_id"].eqNullSafe(b["supplier_id"]) & (a["seq"] == b["seq"])
    rest = near.join(three, same_claim(near, three), "left_anti")
    extra = rank_within(rest, ["supplier_id"], order, most - chosen).select("supplier_id", "seq", F.lit("EXTRA").alias("outcome"))
    none = F.lit(None)
    told = once.select("supplier_id", "seq", none.cast("string").alias("outcome"), "score").unionByName(three.unionByName(extra).withColumn("score", none.cast("int")))
    told = told.groupBy(F.col("supplier_id").alias("_supplier"), F.col("seq").alias("_seq")).agg(F.max("outcome").alias("outcome"), F.max("score").alias("_score"))
    out = scored.join(told, F.col("supplier_id").eqNullSafe(F.col("_supplier")) & (F.col("seq") == F.col("_seq")), "left")
    outcome = F.when(F.col("_score").isNull(), "REJECTED").otherwise(F.coalesce("outcome", F.lit("DEMOTED")))
    out = out.withColumns({"score": F.coalesce("_score", F.lit(0)), "kind": F.col("_s.kind"), "outcome": outcome})
    return out.drop("_key", "_bonus", "_s", "_supplier", "_seq", "_score")


# Guards and evidence -----------------------------------------------------------------------------------------------------
#: What a verdict may say.
DECISIONS, RISKS = ("APPROVE", "REJECT", "HUMAN_REVIEW"), ("LOW", "MEDIUM", "HIGH")


def guarded(verdict: Column) -> Column:
    """A verdict as it is if its decision, risk and confidence are ones that a verdict may have; else a fallback that sends the claim to a person."""
    sound = verdict["decision"].isin(*DECISIONS) & verdict["risk"].isin(*RISKS) & verdict["confidence"].between(0.0, 1.0) & verdict["actor"].isNotNull()
    fallback = F.struct(F.lit("HUMAN_REVIEW").alias("decision"), F.lit(0.0).alias("confidence"), F.lit("HIGH").alias("risk"), F.lit("SAFE_FALLBACK").alias("actor"))
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(*[verdict[c].alias(c) for c in ("decision", "confidence", "risk", "actor")])).otherwise(fallback)


def fact_evidence(claims: DataFrame) -> DataFrame:
    """(supplier_id, claim_type, slug, evidence, page_type): the evidence of a fact's claims in order of seq, joined by bars, and the page type of the first claim on a services or capabilities page, else of the first claim."""
    keyed = claims.withColumn("slug", fact_key(F.col("claim_type"), F.col("raw_value"), F.col("normalized_value")))
    said = F.when(or_empty(F.col("evidence_text")) != "", F.struct("seq", "evidence_text"))
    offers = F.col("page_type").isin("SERVICES", "CAPABILITIES")
    out = keyed.groupBy("supplier_id", "claim_type", "slug").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["evidence_text"]), " | ").alias("evidence"), F.min_by("page_type", F.when(offers, F.col("seq"))).alias("_offer"), F.min_by("page_type", "seq").alias("_first")
    )
    return out.select("supplier_id", "claim_type", "slug", "evidence", F.coalesce("_offer", "_first").alias("page_type"))
