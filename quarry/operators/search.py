"""Directory search: facets, geography, paging, nested children and buyer match scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip


@dataclass(frozen=True)
class Filters:
    """What a directory request may hold. Names are lower-cased slugs; empty lists select nothing away."""

    q: str = ""
    city: str = ""
    province: str = ""
    capabilities: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    certifications: tuple[str, ...] = ()
    claimed: bool | None = None
    verified: bool | None = None
    contact_confidence: str = ""
    page: int = 1
    page_size: int = 10


@dataclass(frozen=True)
class Criteria:
    """What a buyer asks for; empty parts take no share of the score."""

    required_capabilities: tuple[str, ...] = ()
    preferred_capabilities: tuple[str, ...] = ()
    required_certifications: tuple[str, ...] = ()
    strict_certifications: bool = True
    preferred_industries: tuple[str, ...] = ()
    city: str = ""
    province: str = ""
    pools: dict = field(default_factory=lambda: {"required": 35.0, "certifications": 25.0, "location": 20.0, "preferred": 10.0, "industries": 5.0, "trust": 5.0})


def facet(suppliers: DataFrame, children: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    """Suppliers with any published child among slugs. children: (supplier_id, slug, published)."""
    if not slugs:
        return suppliers
    hits = children.where(F.col("published") & F.col("slug").isin(*slugs)).select("supplier_id").distinct()
    return suppliers.join(hits, "supplier_id", "left_semi")


def search(suppliers: DataFrame, capabilities: DataFrame, f: Filters, industries: DataFrame | None = None, certifications: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """Published suppliers that pass all filters, before paging. Text is found in the name, the description or a published capability's name, as a substring in any case."""
    rows = suppliers.where(F.col("profile_status") == "PUBLISHED")
    q = f.q.strip().lower()
    if q:
        hit = capabilities.where(F.col("published") & F.contains(F.lower("name"), F.lit(q))).select("supplier_id").distinct().withColumn("_hit", F.lit(True))
        rows = rows.join(hit, "supplier_id", "left").where(F.contains(F.lower("name"), F.lit(q)) | F.coalesce(F.contains(F.lower("description"), F.lit(q)), F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    if f.claimed is not None:
        rows = rows.where(F.col("claim_status") == ("CLAIMED" if f.claimed else "UNCLAIMED"))
    if f.verified is not None:
        rows = rows.where((F.col("verification_status") == "VERIFIED") == f.verified)
    rows = facet(rows, capabilities, f.capabilities)
    if industries is not None:
        rows = facet(rows, industries, f.industries)
    if certifications is not None:
        rows = facet(rows, certifications, f.certifications)
    if locations is not None and (f.city or f.province):
        where = F.lit(True)
        if f.city:
            where &= F.lower("city") == f.city.lower()
        if f.province:
            where &= F.lower("province") == f.province.lower()
        rows = rows.join(locations.where(where).select("supplier_id").distinct(), "supplier_id", "left_semi")
    return rows


def page_of(rows: DataFrame, f: Filters, parity: bool = False) -> DataFrame:
    """One page by name, ties by id, with total_count. The contact filter comes before paging; with parity it comes after and leaves the total as it was."""
    wanted = F.col("contact_rating") == f.contact_confidence if f.contact_confidence else F.lit(True)
    if not parity:
        rows = rows.where(wanted)
    size = min(max(f.page_size, 1), 50)
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    page = rows.orderBy("name", "supplier_id").offset((max(f.page, 1) - 1) * size).limit(size)
    page = page.crossJoin(F.broadcast(total))
    return page.where(wanted) if parity else page


def match_score(suppliers: DataFrame, c: Criteria) -> DataFrame:
    """Adds match_score (0 to 100), eligible and breakdown to suppliers with arrays capabilities and industries (slug, published), certifications (slug, verified), places (city, province, lower-cased) and contact_rating.

    Pools of points: required capabilities, required certifications (unverified ones fail in strict mode and count half otherwise), location (province alone 70 %), preferred capabilities, preferred industries, trust; the score is the share of the pools in use.
    The first child of a slug decides.
    """
    points, most, eligible, notes = F.lit(0.0), 0.0, F.lit(True), []

    def first(children: str, slug: str) -> Column:
        return F.get(F.filter(children, lambda x: x["slug"] == slug), F.lit(0))

    def pool(name: str, slugs: tuple[str, ...], value) -> None:
        nonlocal points, most
        if slugs:
            most += c.pools[name]
            for s in slugs:
                points = points + F.lit(c.pools[name] / len(slugs)) * value(s)

    published = lambda children: lambda s: F.coalesce(first(children, s)["published"], F.lit(False)).cast("double")
    pool("required", c.required_capabilities, published("capabilities"))
    for s in c.required_capabilities:
        has = F.coalesce(first("capabilities", s)["published"], F.lit(False))
        eligible &= has
        notes.append(F.concat(F.lit(f"capability {s}: "), F.when(has, "satisfied").otherwise("missing")))
    unverified = 0.0 if c.strict_certifications else 0.5
    certified = lambda s: F.when(first("certifications", s).isNull(), 0.0).when(first("certifications", s)["verified"], 1.0).otherwise(unverified)
    pool("certifications", c.required_certifications, certified)
    for s in c.required_certifications:
        eligible &= certified(s) > 0
        notes.append(F.concat(F.lit(f"certification {s}: "), F.when(certified(s) == 1.0, "satisfied").when(certified(s) > 0, "partly").otherwise("missing")))
    city, province = c.city.strip().lower(), c.province.strip().lower()
    if city or province:
        most += c.pools["location"]
        in_city = F.exists("places", lambda p: p["city"] == city) if city else F.lit(False)
        in_province = F.exists("places", lambda p: p["province"] == province) if province else F.lit(False)
        points = points + F.when(in_city, c.pools["location"]).when(in_province, c.pools["location"] * 0.7).otherwise(0.0)
        notes.append(F.concat(F.lit("location: "), F.when(in_city, "satisfied").when(in_province, "partly").otherwise("outside")))
    pool("preferred", c.preferred_capabilities, published("capabilities"))
    pool("industries", c.preferred_industries, published("industries"))
    most += c.pools["trust"]
    points = points + F.when(F.col("contact_rating") == "HIGH", c.pools["trust"]).when(F.col("contact_rating") == "MEDIUM", c.pools["trust"] * 0.6).otherwise(0.0)
    score = F.round(points / most * 100).cast("int")
    return suppliers.withColumns({"match_score": F.least(F.greatest(score, F.lit(0)), F.lit(100)), "eligible": eligible, "breakdown": F.array(*notes) if notes else F.array().cast("array<string>")})


#: Mail hosts that anyone can have an address at (fixed values).
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "protonmail.com"]


def contact_points(email: Column, phone: Column, verified: Column, bounced: Column, domain: Column) -> Column:
    """Points of one contact: 20, bounced 10; +30 for an address, -10 at a free host or +35 at the company's domain; +15 for a phone; +20 if verified; within 0 and 100."""
    mail, target = F.lower(F.regexp_extract(email, "@(.+)$", 1)), F.lower(F.coalesce(domain, F.lit("")))
    has_mail = F.length(F.coalesce(email, F.lit(""))) > 0
    host = F.when(mail.isin(*FREE_MAIL), -10).when((target != "") & (mail != "") & F.contains(target, mail), 35).otherwise(0)
    points = 20 + F.when(has_mail, 30 + host).otherwise(0) + F.when(F.length(F.coalesce(phone, F.lit(""))) > 0, 15).otherwise(0) + F.when(verified, 20).otherwise(0)
    return F.when(bounced.isNotNull(), 10).otherwise(F.least(F.greatest(points, F.lit(0)), F.lit(100)))


def contact_confidence(suppliers: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds contact_score and contact_rating to suppliers (supplier_id, domain): the best contact's points; HIGH from 80, MEDIUM from 45; 15 and LOW without contacts.

    contacts: (supplier_id, email, phone, verified, bounced_at).
    """
    scored = contacts.join(suppliers.select("supplier_id", "domain"), "supplier_id").select("supplier_id", contact_points(F.col("email"), F.col("phone"), F.col("verified"), F.col("bounced_at"), F.col("domain")).alias("p"))
    best = scored.groupBy("supplier_id").agg(F.max("p").alias("_p"))
    score = F.coalesce("_p", F.lit(15))
    rating = F.when(score >= 80, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW")
    return suppliers.join(best, "supplier_id", "left").withColumns({"contact_score": score, "contact_rating": rating}).drop("_p")


def duplicate_signals(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (row_id, name, website, city, phone) against existing (supplier_id, name, domain, city, phone): status and matching signals of each candidate.

    INVALID without name or city; a shared domain makes UPDATE_CANDIDATE; the same name, the first five letters of the name inside a name of the same city, or the same phone make POSSIBLE_DUPLICATE; else CREATE.
    Each signal is an equi join; a beginning inside a name of the same city meets that city's runs of letters, each of which counts once however many companies have it.
    """
    from quarry.functions.text import domain_of, phone_of

    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    c = candidates.select("row_id", low(F.col("name")).alias("n"), domain_of(F.col("website")).alias("d"), low(F.col("city")).alias("c"), phone_of(F.col("phone")).alias("p"))
    e = existing.select(F.col("supplier_id"), low(F.col("name")).alias("n"), F.lower("domain").alias("d"), low(F.col("city")).alias("c"), F.col("phone").alias("p"))
    valid = c.where((F.col("n") != "") & (F.col("c") != ""))
    hit = lambda on, label: valid.join(e.select(on, "supplier_id").where(F.col(on) != ""), on).select("row_id", F.lit(label).alias("signal"), "supplier_id")
    start = F.substring("n", 1, 5)
    asked = valid.select("row_id", "c", start.alias("run")).withColumn("size", F.length("run"))
    sizes = F.array(*[F.lit(i) for i in range(1, 6)])
    runs = F.explode(F.flatten(F.transform(sizes, lambda k: F.when(F.length("n") >= k, F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substr("n", i, k))).otherwise(F.array().cast("array<string>")))))
    # Shorter runs than five letters are only wanted where a name is that short.
    short = asked.where(F.col("size") < 5).select("c", "size").distinct()
    known = e.where(F.col("n") != "").select("c", runs.alias("run")).distinct().withColumn("size", F.length("run"))
    wanted = known.where(F.col("size") == 5).unionByName(known.where(F.col("size") < 5).join(short, ["c", "size"], "left_semi"))
    similar = asked.join(wanted, ["c", "run"], "left_semi").select("row_id", F.lit("name_city").alias("signal"), F.lit(None).cast(existing.schema["supplier_id"].dataType).alias("supplier_id"))
    signals = hit("d", "domain").unionByName(hit("n", "name")).unionByName(hit("p", "phone")).unionByName(similar)
    found = signals.groupBy("row_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.min(F.when(F.col("signal").isin("domain", "name"), F.col("supplier_id"))).alias("matching_supplier"))
    status = F.when((F.col("n") == "") | (F.col("c") == ""), "INVALID").when(F.array_contains("signals", "domain"), "UPDATE_CANDIDATE").when(F.col("signals").isNotNull(), "POSSIBLE_DUPLICATE").otherwise("CREATE")
    return c.join(found, "row_id", "left").select("row_id", status.alias("status"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), "matching_supplier")
