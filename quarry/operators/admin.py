"""What administrators do with records: bulk states, ingestion, manual creation, seeds, resets and the lists they look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import domain_of, name_slug, or_empty, strip
from quarry.operators.claims import consolidate

#: States in which facts wait for a person, and states that a person or rule has settled.
WAITING, PUBLISHED = ("HUMAN_REVIEW", "UNREVIEWED"), ("APPROVED", "VERIFIED")
#: Claims with these states come from a person and survive a reset.
HUMAN_STATES = ("APPROVED", "REJECTED", "VERIFIED", "HUMAN_APPROVED", "HUMAN_REJECTED")


# States -----------------------------------------------------------------------------------------------------------------


def set_profiles(suppliers: DataFrame, ids: DataFrame | None, publish: bool, now: Column) -> DataFrame:
    """suppliers with the named profiles (all, where ids is null) published or taken back to draft. Those published already keep their dates; unpublishing clears the date."""
    hit = F.lit(True) if ids is None else F.col("_hit").isNotNull()
    rows = suppliers if ids is None else suppliers.join(ids.select("supplier_id", F.lit(True).alias("_hit")).distinct(), "supplier_id", "left")
    moves = hit & (F.col("profile_status") != "PUBLISHED") if publish else hit
    status, when_ = ("PUBLISHED", now) if publish else ("DRAFT", F.lit(None).cast("timestamp_ntz"))
    out = rows.withColumns({"published_at": F.when(moves, when_).otherwise(F.col("published_at")), "profile_status": F.when(moves, status).otherwise(F.col("profile_status"))})
    return out.drop("_hit")


def publish_counts(suppliers: DataFrame) -> DataFrame:
    """(published_count, skipped_count) of publishing every profile."""
    done = F.col("profile_status") == "PUBLISHED"
    return suppliers.agg(F.count_if(~done).alias("published_count"), F.count_if(done).alias("skipped_count"))


def set_claim_states(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claims with decisions (claim_id, action, reviewer, supporting) applied: REJECT and STALE set REJECTED and PENDING on the supporting claims, or on the claim itself where there are none. A stale mark leaves the reviewer."""
    ids = F.when(F.size(F.coalesce("supporting", F.array().cast("array<string>"))) > 0, F.col("supporting")).otherwise(F.array("claim_id"))
    marks = decisions.select(F.explode(ids).alias("claim_id"), "action", "reviewer").groupBy("claim_id").agg(F.max(F.struct((F.col("action") == "REJECT").alias("rejects"), "reviewer")).alias("_m"))
    rows = claims.join(marks, "claim_id", "left")
    state = F.when(F.col("_m.rejects"), "REJECTED").when(F.col("_m").isNotNull(), "PENDING").otherwise(F.col("review_state"))
    return rows.withColumns({"review_state": state, "reviewed_by": F.when(F.col("_m.rejects"), F.col("_m.reviewer")).otherwise(F.col("reviewed_by"))}).drop("_m")


# Ingestion --------------------------------------------------------------------------------------------------------------


def commit_rows(candidates: DataFrame) -> DataFrame:
    """candidates (row_id, name, domain, city, province, email, phone, status) -> rows to create, of three kinds.

    Invalid rows and possible duplicates are skipped; the rest becomes a draft company, a placeholder location and, where there is an address or a number, a contact. Rows that only update are created too.
    """
    kept = candidates.where(~F.col("status").isin("INVALID", "POSSIBLE_DUPLICATE"))
    null = F.lit(None).cast("string")
    company = kept.select("row_id", F.lit("company").alias("kind"), F.col("name").alias("a"), F.concat_ws("-", name_slug(F.col("name")), F.col("row_id").cast("string")).alias("b"), F.nullif(F.col("domain"), F.lit("")).alias("c"))
    place = kept.select("row_id", F.lit("location").alias("kind"), F.lit("Primary Address").alias("a"), F.col("city").alias("b"), F.col("province").alias("c"))
    reached = kept.where((or_empty(F.col("email")) != "") | (or_empty(F.col("phone")) != ""))
    contact = reached.select("row_id", F.lit("contact").alias("kind"), F.nullif(F.col("email"), F.lit("")).alias("a"), F.nullif(F.col("phone"), F.lit("")).alias("b"), null.alias("c"))
    return company.unionByName(place).unionByName(contact)


def commit_counts(candidates: DataFrame) -> DataFrame:
    skipped = F.col("status").isin("INVALID", "POSSIBLE_DUPLICATE")
    return candidates.agg(F.count_if(~skipped).alias("created_count"), F.count_if(skipped).alias("skipped_count"))


def manual_outcomes(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows (row_id, is_admin, name, website, city) with existing (name, domain, city) -> (row_id, outcome).

    UNAUTHORIZED, INVALID (a name under two characters, no site or no city), DUPLICATE_DOMAIN, DUPLICATE_NAME (same name in the same city, without case) or CREATED, in that order. The tests are two joins on equality.
    """
    name, city = strip(or_empty(F.col("name"))), strip(or_empty(F.col("city")))
    made = rows.withColumns({"_d": domain_of(or_empty(F.col("website"))), "_n": F.lower(name), "_c": F.lower(city)})
    domains = existing.where(or_empty(F.col("domain")) != "").select(F.col("domain").alias("_d"), F.lit(True).alias("_has_d")).distinct()
    names = existing.select(F.lower("name").alias("_n"), F.lower("city").alias("_c"), F.lit(True).alias("_has_n")).distinct()
    outcome = (
        F.when(~F.coalesce("is_admin", F.lit(False)), "UNAUTHORIZED")
        .when((F.length("_n") < 2) | (or_empty(F.col("website")) == "") | (F.col("_c") == ""), "INVALID")
        .when(F.col("_has_d"), "DUPLICATE_DOMAIN")
        .when(F.col("_has_n"), "DUPLICATE_NAME")
        .otherwise("CREATED")
    )
    return made.join(domains, "_d", "left").join(names, ["_n", "_c"], "left").select("row_id", outcome.alias("outcome"))


def _grams(text: Column, length: int) -> Column:
    """All substrings of that length, none for shorter texts."""
    n = F.length(text) - (length - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(length)))).otherwise(F.array().cast("array<string>"))


def names_within(seeds: DataFrame, existing: DataFrame, gram: int = 3) -> DataFrame:
    """seeds (seed_name) with existing (supplier_id, name), both in lower case -> (seed_name, supplier_id) where the name holds the seed's name.

    A seed meets names by one of its grams only: the one that the fewest names hold, a name's repeats counted once. Names shorter than a gram meet by
    their whole text. Seeds none of whose grams is known have no match. Blank seed names match nothing.
    """
    asked = seeds.where(strip(or_empty(F.col("seed_name"))) != "").select("seed_name").distinct()
    parts = asked.select("seed_name", F.explode(F.array_distinct(F.when(F.length("seed_name") >= gram, _grams(F.col("seed_name"), gram)).otherwise(F.array("seed_name")))).alias("_gram"))
    held = F.array_distinct(F.flatten(F.array(*[_grams(F.col("name"), n) for n in range(1, gram + 1)])))
    wanted = parts.select("_gram").distinct()
    known = existing.select("supplier_id", "name", F.explode(held).alias("_gram")).join(wanted, "_gram", "left_semi")
    spread = known.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    all_known = parts.join(spread, "_gram", "left").groupBy("seed_name").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all"))
    return known.join(all_known.where("_all").drop("_all"), "_gram").where(F.contains("name", F.col("seed_name"))).select("seed_name", "supplier_id").distinct()


def seed_matches(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """(seed_id, supplier_id): companies whose domain is the seed's, or whose name holds the seed's name, without case. Equal names and domains of seeds are sought once; blank ones match nothing."""
    asked = seeds.select("seed_id", F.lower(strip(F.col("name"))).alias("seed_name"), F.lower("domain").alias("_domain"))
    within = names_within(asked, existing.select("supplier_id", F.lower("name").alias("name")))
    by_name = asked.join(within, "seed_name").select("seed_id", "supplier_id")
    by_domain = existing.where(or_empty(F.col("domain")) != "").select("supplier_id", F.lower("domain").alias("_domain")).join(asked, "_domain").select("seed_id", "supplier_id")
    return by_name.unionByName(by_domain).distinct()


def seed_companies(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """seeds (seed_id, name, domain, city) against existing (supplier_id, name, domain) -> (seed_id, supplier_id, action, name, domain, city).

    The first of the seed's matches by supplier_id is corrected to the seed's name, domain and city (CORRECT, or KEEP where nothing differs); without a match the seed is inserted with a seeded head office (INSERT).
    """
    hit = seed_matches(seeds, existing).groupBy("seed_id").agg(F.min("supplier_id").alias("supplier_id"))
    found = seeds.join(hit, "seed_id", "left").join(existing.select("supplier_id", F.col("name").alias("_n"), F.col("domain").alias("_d")), "supplier_id", "left")
    same = F.col("name").eqNullSafe(F.col("_n")) & F.col("domain").eqNullSafe(F.col("_d"))
    return found.select("seed_id", "supplier_id", F.when(F.col("supplier_id").isNull(), "INSERT").when(same, "KEEP").otherwise("CORRECT").alias("action"), "name", "domain", "city")


def reset_before_crawl(tables: dict[str, DataFrame], suppliers: DataFrame) -> dict[str, DataFrame]:
    """What is left of claims, documents and runs when the named suppliers are crawled anew: all claims but theirs that no person decided, and no documents or runs of theirs."""
    mine = suppliers.select("supplier_id").distinct()
    claims = tables["claims"]
    gone = claims.where(~or_empty(F.col("review_state")).isin(*HUMAN_STATES)).join(mine, "supplier_id", "left_semi").select("claim_id")
    return {"claims": claims.join(gone, "claim_id", "left_anti"), **{n: tables[n].join(mine, "supplier_id", "left_anti") for n in ("documents", "runs")}}


# Lists ------------------------------------------------------------------------------------------------------------------


def review_facts(claims: DataFrame, status: str = "ALL", claim_type: str = "ALL") -> DataFrame:
    """Facts of all claims for the review page: those that wait, or those with one state; of one type or all."""
    facts = consolidate(claims)
    by_state = F.lit(True) if status not in ("HUMAN_REVIEW", "AUTO_APPROVED", "AUTO_REJECTED") else F.col("review_state").isin(*(WAITING if status == "HUMAN_REVIEW" else (status,)))
    return facts.where(by_state & (F.lit(claim_type == "ALL") | (F.col("claim_type") == claim_type)))


def review_counts(claims: DataFrame) -> DataFrame:
    """Counts over the page: raw claims, facts, collapsed duplicates, and facts by state."""
    state = F.col("review_state")
    out = consolidate(claims).agg(
        F.sum("n_claims").alias("raw_claims"), F.count(F.lit(1)).alias("facts"), F.count_if(state == "AUTO_APPROVED").alias("auto_approved"), F.count_if(state == "AUTO_REJECTED").alias("auto_rejected"),
        F.count_if(state.isin(*WAITING)).alias("waiting"), F.count_if(state.isin(*PUBLISHED)).alias("published"),
    )
    return out.withColumn("collapsed", F.col("raw_claims") - F.col("facts"))


def with_latest_run(suppliers: DataFrame, runs: DataFrame) -> DataFrame:
    """suppliers with status and start of their latest run (by start, then id), null where there is none."""
    last = runs.groupBy("supplier_id").agg(F.max_by(F.struct("status", "started_at"), F.struct("started_at", "run_id")).alias("_r"))
    return suppliers.join(last, "supplier_id", "left").withColumns({"last_status": F.col("_r.status"), "last_started": F.col("_r.started_at")}).drop("_r")


def term_use(terms: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """terms (slug, name) with the number of aliases and of suppliers that use each, by name."""
    n_aliases = aliases.groupBy("slug").agg(F.countDistinct("alias").alias("aliases"))
    n_suppliers = edges.groupBy("slug").agg(F.countDistinct("supplier_id").alias("suppliers"))
    out = terms.join(n_aliases, "slug", "left").join(n_suppliers, "slug", "left")
    return out.select("slug", "name", F.coalesce("aliases", F.lit(0)).alias("aliases"), F.coalesce("suppliers", F.lit(0)).alias("suppliers")).orderBy("name", "slug")


def newest(rows: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """The newest rows: a top-k list."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(most)


def budgeted(rows: DataFrame, key: str, bucket: str, order: list[str], budgets: dict[str, int]) -> DataFrame:
    """The first rows of each key and bucket, as many as the bucket's budget allows; buckets without a budget keep all."""
    limit = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])[F.col(bucket)]
    rank = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    return rows.withColumn("_rn", rank).where(limit.isNull() | (F.col("_rn") <= limit)).drop("_rn")
