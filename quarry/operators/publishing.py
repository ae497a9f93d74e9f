"""Approved claims put into the tables that they belong to: one pass tags each claim with its target, and all targets are merged by one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Types whose claims name an entry of a dictionary, and what an approval does to a link that is there already.
DICTIONARY_TYPES = {"CAPABILITY": "PUBLISH", "CERTIFICATION": "PUBLISH", "SERVICE_REGION": "VERIFY", "INDUSTRY": "KEEP", "EQUIPMENT": "KEEP"}
CONTACT_TYPES = ["CONTACT", "CONTACT_EMAIL", "CONTACT_PHONE"]
#: How a value meets its entry, from the surest way on.
LEVELS = ["slug", "name", "alias", "contains"]


def approved_value(normalized: Column, raw: Column) -> Column:
    """What a claim says: its normal form, else its wording."""
    return tx.if_blank(normalized, tx.if_blank(raw, F.lit("approved")))


def resolve_entries(values: DataFrame, dictionary: DataFrame, aliases: DataFrame) -> DataFrame:
    """values (claim_type, value) -> (claim_type, value, slug, level), each value of a type once; slug is null where no entry is meant.

    By slug, else by name without regard to case, else by alias, else by the name, or for capabilities the slug, that contains the value; among
    several the least slug. dictionary (claim_type, slug, name) and aliases (claim_type, alias, slug) are dictionaries of bounded size. All ways
    join on the type and a key; containment is tested only for values that no other way met, against the entries of their type.
    """
    v = values.select("claim_type", "value").distinct().withColumns({"low": F.lower("value"), "plain": tx.fact_slug(F.col("value"))})
    by_key = (
        dictionary.select("claim_type", F.col("slug").alias("key"), "slug", F.lit(1).alias("rank"))
        .unionByName(dictionary.select("claim_type", F.lower("name").alias("key"), "slug", F.lit(2).alias("rank")))
        .unionByName(aliases.select("claim_type", F.lower("alias").alias("key"), "slug", F.lit(3).alias("rank")))
    )
    keys = F.array(F.struct(F.col("plain").alias("key"), F.lit(True).alias("is_slug")), F.struct(F.col("value").alias("key"), F.lit(True).alias("is_slug")), F.struct(F.col("low").alias("key"), F.lit(False).alias("is_slug")))
    asked = v.select("claim_type", "value", F.explode(keys).alias("k")).select("claim_type", "value", "k.key", "k.is_slug").distinct()
    met = asked.join(by_key, ["claim_type", "key"]).where(F.col("is_slug") == (F.col("rank") == 1)).groupBy("claim_type", "value").agg(F.min(F.struct("rank", "slug")).alias("b"))
    known = v.join(met, ["claim_type", "value"], "left")
    entries = dictionary.select("claim_type", F.col("slug").alias("inside"), F.lower("name").alias("name"))
    holds = F.contains("name", F.col("low")) | ((F.col("claim_type") == "CAPABILITY") & F.contains("inside", F.col("plain")) & (F.col("plain") != ""))
    rest = known.where(F.col("b").isNull() & (F.col("low") != "")).join(entries, "claim_type").where(holds).groupBy("claim_type", "value").agg(F.min("inside").alias("inside"))
    out = known.join(rest, ["claim_type", "value"], "left")
    level = F.when(F.col("b").isNotNull(), F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("b.rank", F.lit(1)))).when(F.col("inside").isNotNull(), LEVELS[3])
    return out.select("claim_type", "value", F.coalesce("b.slug", "inside").alias("slug"), level.alias("level"))


def publish_links(approved: DataFrame, current: DataFrame, dictionary: DataFrame, aliases: DataFrame, by_person: bool) -> DataFrame:
    """The links of suppliers to entries of all dictionaries after an approval, with the outcome of each.

    approved (claim_id, supplier_id, claim_type, raw_value, normalized_value); current and the result (claim_type, supplier_id, slug, published,
    state, claim_id). New links are created, published and of the state that the approval gives. Links that are there are published and take
    the state and the claim (capabilities, certifications), take the state (regions), or stay (industries, equipment). Of several claims of a link
    the greatest claim_id counts; claims that no entry takes change nothing. Current links and claims meet in one aggregation by link.
    """
    said = approved.where(F.col("claim_type").isin(*DICTIONARY_TYPES)).select("claim_id", "supplier_id", "claim_type", approved_value(F.col("normalized_value"), F.col("raw_value")).alias("value"))
    found = said.join(resolve_entries(said, dictionary, aliases).where("slug is not null"), ["claim_type", "value"])
    state = "VERIFIED" if by_person else "AUTO_APPROVED"
    old = current.select("claim_type", "supplier_id", "slug", F.struct("published", "state", "claim_id").alias("old"), F.lit(None).cast("long").alias("claim"))
    new = found.select("claim_type", "supplier_id", "slug", F.lit(None).cast(old.schema["old"].dataType).alias("old"), F.col("claim_id").cast("long").alias("claim"))
    both = old.unionByName(new).groupBy("claim_type", "supplier_id", "slug").agg(F.max("old").alias("old"), F.max("claim").alias("claim"))
    effect = F.element_at(F.create_map(*[F.lit(x) for kv in DICTIONARY_TYPES.items() for x in kv]), F.col("claim_type"))
    fresh, untouched = F.col("old").isNull(), F.col("claim").isNull() | (F.col("old").isNotNull() & (effect == "KEEP"))
    outcome = F.when(fresh, "created").when(untouched, "kept").otherwise("updated")
    publishes = fresh | (~untouched & (effect == "PUBLISH"))
    return both.select(
        "claim_type", "supplier_id", "slug", F.when(publishes, True).otherwise(F.col("old.published")).alias("published"), F.when(untouched & ~fresh, F.col("old.state")).otherwise(F.lit(state)).alias("state"),
        F.when(publishes, F.col("claim")).otherwise(F.col("old.claim_id")).alias("claim_id"), outcome.alias("outcome"),
    )


def publish_targets(approved: DataFrame) -> DataFrame:
    """(supplier_id, target, claims): what else an approval sets going: contacts to be chosen anew, once for a supplier, and locations to be put in."""
    target = F.when(F.col("claim_type").isin(*CONTACT_TYPES), "CHOOSE_CONTACTS").when(F.col("claim_type") == "LOCATION", "PUT_LOCATIONS")
    return approved.select("supplier_id", target.alias("target")).where("target is not null").groupBy("supplier_id", "target").agg(F.count("*").alias("claims"))


def reviewed(claims: DataFrame, approved: DataFrame, actor: str | None, by_person: bool) -> DataFrame:
    """claims with review_state and reviewer: approved ones, and all of the same supplier, type and normal form as an approved one."""
    state = "APPROVED" if by_person else "AUTO_APPROVED"
    same = ["supplier_id", "claim_type", "normalized_value"]
    ids = approved.select("claim_id").distinct().withColumn("_by_id", F.lit(True))
    alike = approved.where("normalized_value is not null").select(*same).distinct().withColumn("_alike", F.lit(True))
    hit = F.coalesce("_by_id", "_alike", F.lit(False))
    marked = claims.join(ids, "claim_id", "left").join(alike, same, "left")
    person = actor if actor and by_person and actor.startswith("usr_") else None
    return marked.withColumns({"review_state": F.when(hit, state).otherwise(F.col("review_state")), "reviewed_by": F.when(hit, F.lit(person))}).drop("_by_id", "_alike")
