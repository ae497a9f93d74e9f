"""What a company's public profile shows: listed names, social pages, hours, contacts and the nested view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import or_empty
from quarry.model import LOCATION_TYPES, rank_in
from quarry.operators.extract import social_link

#: The order in which platforms are shown, with their labels.
PLATFORMS = {"LINKEDIN": "LinkedIn", "FACEBOOK": "Facebook", "INSTAGRAM": "Instagram", "X": "X (Twitter)", "YOUTUBE": "YouTube", "TIKTOK": "TikTok"}
#: Contact types that are not shown to the public.
PRIVATE_CONTACTS = ("INDIVIDUAL_BUSINESS_CONTACT", "OTHER")
#: Review states whose claims a profile shows.
SHOWN_STATES = ("APPROVED", "AUTO_APPROVED")
#: How many names of each kind a profile lists.
LISTED = {"PRODUCT_LISTED": 40, "SERVICE_LISTED": 60, "CERTIFICATION_LISTED": 30}


def words_key(name: Column) -> Column:
    """The words of a name, each without one final s, in alphabetical order: spellings and word orders of one offering share it."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " ")
    bare = F.transform(words, lambda w: F.when(w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(F.array_sort(F.filter(bare, lambda w: w != "")), " ")


def first_names(claims: DataFrame, claim_type: str, exclude: DataFrame | None = None) -> DataFrame:
    """claims (supplier_id, claim_type, raw_value, source_url, seq) -> (supplier_id, key, name, source_url, seq, place): each offering once, as first written; place counts from 1 in that order.

    exclude (supplier_id, key): offerings that another list shows already.
    """
    rows = claims.where(F.col("claim_type") == claim_type).withColumn("key", words_key(F.col("raw_value")))
    first = rows.groupBy("supplier_id", "key").agg(F.min_by(F.struct("raw_value", "source_url"), "seq").alias("f"), F.min("seq").alias("seq"))
    if exclude is not None:
        first = first.join(exclude.select("supplier_id", "key"), ["supplier_id", "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("supplier_id").orderBy("seq"))
    return first.select("supplier_id", "key", F.col("f.raw_value").alias("name"), F.col("f.source_url").alias("source_url"), "seq", place.alias("place"))


def in_order(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """(key, name): the values of each key as an array in the given order. For rows whose number for each key is bounded."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))


def listed_names(claims: DataFrame, claim_type: str, limit: int, exclude: DataFrame | None = None, most_sources: int = 3) -> DataFrame:
    """(supplier_id, names, sources): the first `limit` offerings, and the first pages that any of the offerings stands on."""
    first = first_names(claims, claim_type, exclude)
    names = in_order(first.where(F.col("place") <= limit), "supplier_id", "name", "seq", "names")
    pages = first.where(or_empty(F.col("source_url")) != "").groupBy("supplier_id", "source_url").agg(F.min("seq").alias("seq"))
    pages = pages.withColumn("rn", F.row_number().over(Window.partitionBy("supplier_id").orderBy("seq"))).where(F.col("rn") <= most_sources)
    return names.join(in_order(pages, "supplier_id", "source_url", "seq", "sources"), "supplier_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def listed_summary(claims: DataFrame) -> DataFrame:
    """(supplier_id, claim_type, names, sources) of the three lists. A product that is also described like a service shows under products only."""
    shown = first_names(claims, "PRODUCT_LISTED").where(F.col("place") <= LISTED["PRODUCT_LISTED"])
    lists = [listed_names(claims, kind, most, shown if kind == "SERVICE_LISTED" else None).withColumn("claim_type", F.lit(kind)) for kind, most in LISTED.items()]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).select("supplier_id", "claim_type", "names", "sources")


def social_pages(claims: DataFrame) -> DataFrame:
    """(supplier_id, platform, label, url, place): of the pages on a platform the one that most claims name, the first seen among equals; place is the platform's place in the fixed order."""
    links = claims.where(F.col("claim_type") == "SOCIAL").withColumn("s", social_link(F.col("raw_value"))).where("s is not null")
    counted = links.groupBy("supplier_id", "s.platform", F.lower("s.url").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max_by("s.url", "seq").alias("url"))
    best = counted.groupBy("supplier_id", "platform").agg(F.max_by("url", F.struct("n", (-F.col("first")).alias("f"))).alias("url"))
    labels = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    return best.select("supplier_id", "platform", labels[F.col("platform")].alias("label"), "url", rank_in(F.col("platform"), list(PLATFORMS)).alias("place"))


def opening_hours(claims: DataFrame, limit: int = 4) -> DataFrame:
    """(supplier_id, hours): the first `limit` different lines, compared without case and runs of white space."""
    rows = claims.where(F.col("claim_type") == "BUSINESS_HOURS").withColumn("k", F.regexp_replace(F.lower("raw_value"), r"\s+", " "))
    first = rows.groupBy("supplier_id", "k").agg(F.min_by("raw_value", "seq").alias("raw_value"), F.min("seq").alias("seq"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("supplier_id").orderBy("seq"))).where(F.col("rn") <= limit)
    return in_order(ranked, "supplier_id", "raw_value", "seq", "hours")


def contact_place(name: Column) -> Column:
    """Where a contact stands on the profile: the primary one, numbered backups, numbered others from 10 on, then any other name, and last those without."""
    backup, other = (F.regexp_extract(name, rf"^{kind} (\d+)", 1) for kind in ("Backup RFQ Contact", "Other Contact"))
    return (
        F.when(or_empty(name) == "", 99).when(name.startswith("Primary"), 0).when(backup != "", backup.try_cast("int")).when(other != "", 10 + other.try_cast("int")).otherwise(50)
    )


def public_contacts(contacts: DataFrame) -> DataFrame:
    """Contacts of departments; those of persons and of unknown kind are left out."""
    return contacts.where(~or_empty(F.col("contact_type")).isin(*PRIVATE_CONTACTS))


def nested(children: DataFrame, name: str, order: list[Column], fields: list[str], where: Column | None = None) -> DataFrame:
    """children (supplier_id, ...) -> (supplier_id, name): an array of the fields' structs in the given order."""
    rows = children if where is None else children.where(where)
    keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
    item = F.struct(*keys, F.struct(*fields).alias("_v"))
    return rows.groupBy("supplier_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]).alias(name))


def profile_view(suppliers: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Published suppliers with their nested collections, empty arrays where there are none.

    children by name: locations (location_type, created_seq, city), capabilities, industries, certifications and equipments (name, published), service_regions (name), contacts (name, contact_type, value) and
    documents (page_type, source_url). Locations stand by type in declared order and then by age, contacts by contact_place and name; of the documents the first contact page alone is kept.
    """
    published = lambda n: nested(children[n], n, [F.col("name")], ["name"], F.col("published"))
    contact_page = (F.col("page_type") == "CONTACT") | F.contains(F.lower("source_url"), F.lit("contact"))
    parts = [
        nested(children["locations"], "locations", [rank_in(F.col("location_type"), LOCATION_TYPES), F.col("created_seq")], ["location_type", "city"]),
        *[published(n) for n in ("capabilities", "industries", "certifications", "equipments")],
        nested(children["service_regions"], "service_regions", [F.col("name")], ["name"]),
        nested(public_contacts(children["contacts"]), "contacts", [contact_place(F.col("name")), F.col("name")], ["name", "value"]),
        children["documents"].where(contact_page).groupBy("supplier_id").agg(F.array(F.struct(F.min("source_url").alias("source_url"))).alias("documents")),
    ]
    out = suppliers.where("profile_status = 'PUBLISHED'")
    for part in parts:
        name = next(c for c in part.columns if c != "supplier_id")
        out = out.join(part, "supplier_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


#: Flags of a profile, with how grave each is (fixed values).
QA_FLAGS = {"CONTRADICTORY_PRIMARY_LOCATIONS": "WARNING", "DUPLICATE_CONTACT_EMAIL": "WARNING", "UNSUPPORTED_CAPABILITY_CLAIMS": "WARNING", "THIRD_PARTY_EVIDENCE_MENTION": "CRITICAL"}


def flagged_claims(claims: DataFrame) -> DataFrame:
    """claims (supplier_id, claim_id, claim_type, review_state, validation_reason) -> (supplier_id, claim_id, code): rejected capabilities, and claims whose reason speaks of third parties or subcontracting. A claim may have both."""
    refused = (F.col("claim_type") == "CAPABILITY") & F.col("review_state").isin("REJECTED", "AUTO_REJECTED")
    foreign = F.contains("validation_reason", F.lit("third-party")) | F.contains("validation_reason", F.lit("subcontracted"))
    codes = F.array_compact(F.array(F.when(refused, "UNSUPPORTED_CAPABILITY_CLAIMS"), F.when(foreign, "THIRD_PARTY_EVIDENCE_MENTION")))
    return claims.select("supplier_id", "claim_id", F.explode(codes).alias("code"))


def profile_qa(locations: DataFrame, contacts: DataFrame, claims: DataFrame) -> DataFrame:
    """Flags of all profiles that need a look: (supplier_id, code, severity, n, detail).

    locations (supplier_id, location_type): more than two, of which n > 1 are head offices. contacts (supplier_id, normalized_email, email): an address
    that n contacts repeat after its first, without case, the normalized one before the other; detail is the address. claims as in flagged_claims,
    which tells the claims themselves: n of them. Null and empty addresses are none. Each of the four is counted in each task before its shuffle.
    """
    head = F.count_if(F.col("location_type") == "HEADQUARTERS")
    places = locations.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("_all"), head.alias("n")).where("_all > 2 and n > 1")
    mail = F.lower(F.coalesce(F.nullif(F.col("normalized_email"), F.lit("")), F.nullif(F.col("email"), F.lit(""))))
    twice = contacts.withColumn("detail", mail).where("detail is not null").groupBy("supplier_id", "detail").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    told = flagged_claims(claims).groupBy("supplier_id", "code").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    flags = places.select("supplier_id", F.lit("CONTRADICTORY_PRIMARY_LOCATIONS").alias("code"), "n", none.alias("detail"))
    flags = flags.unionByName(twice.select("supplier_id", F.lit("DUPLICATE_CONTACT_EMAIL").alias("code"), "n", "detail")).unionByName(told.withColumn("detail", none))
    severity = F.create_map(*[F.lit(x) for pair in QA_FLAGS.items() for x in pair])[F.col("code")]
    return flags.select("supplier_id", "code", severity.alias("severity"), "n", "detail")
