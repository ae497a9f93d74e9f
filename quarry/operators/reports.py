"""Reports over suppliers, runs, claims and contacts: coverage, batches, metrics, rebuilds and diagnoses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import or_empty, strip
from quarry.operators.claims import usable_email, usable_phone

APPROVED = ("APPROVED", "AUTO_APPROVED", "VERIFIED")
#: The shares, in percent, that gates ask for, and the most facts a supplier may leave to review.
GATES = {"crawl": 85, "contact": 80, "capability": 80, "review": 8}


def percent(part: Column, whole: Column, empty: str = "0.0%") -> Column:
    """A share as text with one decimal; `empty` where there is nothing to share."""
    return F.when(whole > 0, F.concat(F.format_string("%.1f", 100.0 * part / whole), F.lit("%"))).otherwise(empty)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def supplier_flags(suppliers: DataFrame, runs: DataFrame, contacts: DataFrame, capabilities: DataFrame, locations: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each supplier: pages of its latest run and its class, what it has, whether a found place agrees with the listed city, and how many facts wait.

    suppliers (supplier_id, city), runs (supplier_id, run_id, started_at, pages), contacts (supplier_id, email, phone), capabilities (supplier_id, published), locations (supplier_id, city), facts (supplier_id,
    review_state). city_match: some place is in the listed city; city_conflict: there are places and none is.
    """
    pages = runs.groupBy("supplier_id").agg(F.max_by("pages", F.struct("started_at", "run_id")).alias("pages"))
    con = contacts.groupBy("supplier_id").agg(F.bool_or(or_empty(F.col("email")) != "").alias("has_email"), F.bool_or(or_empty(F.col("phone")) != "").alias("has_phone"))
    cap = capabilities.groupBy("supplier_id").agg(F.bool_or("published").alias("has_capability"))
    loc = locations.join(suppliers.select("supplier_id", F.col("city").alias("_listed")), "supplier_id").groupBy("supplier_id").agg(F.bool_or(F.lower("city") == F.lower("_listed")).alias("city_match"))
    rev = facts.groupBy("supplier_id").agg(F.count_if(F.col("review_state").isin("HUMAN_REVIEW", "UNREVIEWED")).alias("waiting"))
    out = reduce(lambda a, b: a.join(b, "supplier_id", "left"), [pages, con, cap, loc, rev], suppliers.select("supplier_id", "city"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "supplier_id", F.coalesce("pages", F.lit(0)).alias("pages"), crawl_class(F.col("pages")).alias("crawl"), yes("has_email").alias("has_email"), yes("has_phone").alias("has_phone"), yes("has_capability").alias("has_capability"),
        F.col("city_match").isNotNull().alias("has_location"), yes("city_match").alias("city_match"), (~F.coalesce("city_match", F.lit(True))).alias("city_conflict"), F.coalesce("waiting", F.lit(0)).alias("waiting"),
    )


def crawl_class(pages: Column) -> Column:
    """Two pages or more are a full crawl, one is partial, none failed."""
    n = F.coalesce(pages, F.lit(0))
    return F.when(n >= 2, "full").when(n == 1, "partial").otherwise("failed")


def coverage(flags: DataFrame) -> DataFrame:
    """One row over supplier_flags: counts, shares as text and the four gates."""
    c, n = (lambda x: F.count_if(F.col(x))), F.col("suppliers")
    out = flags.agg(
        F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("crawl") != "failed").alias("crawled"), F.count_if(F.col("crawl") == "full").alias("full"), F.count_if(F.col("has_email") | F.col("has_phone")).alias("with_contact"),
        c("has_email").alias("with_email"), c("has_capability").alias("with_capability"), c("has_location").alias("with_location"), c("city_match").alias("city_matches"), c("city_conflict").alias("city_conflicts"),
        F.coalesce(F.sum("waiting"), F.lit(0)).alias("waiting"),
    )
    gate = lambda x, name: share(F.col(x), n) >= GATES[name]
    return out.withColumns(
        {
            "crawl_pct": percent(F.col("crawled"), n, "100.0%"), "contact_pct": percent(F.col("with_contact"), n), "capability_pct": percent(F.col("with_capability"), n),
            "crawl_gate": gate("crawled", "crawl"), "contact_gate": gate("with_contact", "contact"), "capability_gate": gate("with_capability", "capability"), "review_gate": F.col("waiting") <= GATES["review"] * n,
        }
    )


#: States of facts that count as published (fixed values).
PUBLISHED = ("APPROVED", "AUTO_APPROVED", "HUMAN_APPROVED", "VERIFIED")
#: The counts of a batch report by state of facts (fixed values).
BATCH_STATES = {
    "auto_approved": ("AUTO_APPROVED", "APPROVED"), "auto_rejected": ("AUTO_REJECTED",), "human_review": ("HUMAN_REVIEW", "UNREVIEWED"),
    "human_approved": ("HUMAN_APPROVED", "VERIFIED"), "human_rejected": ("HUMAN_REJECTED", "REJECTED"), "published": PUBLISHED,
}
#: What a batch's suppliers are said to have, beside contacts, by type of fact.
BATCH_TYPES = {"with_capability": "CAPABILITY", "with_location": "LOCATION"}


def batch_report(batches: DataFrame, runs: DataFrame, facts: DataFrame) -> DataFrame:
    """batches (supplier_id, batch), runs (supplier_id, run_id, started_at, pages), facts (supplier_id, claim_type, review_state, n_claims, value) -> a row for each batch.

    Suppliers by crawl class of their latest run, its pages, claims and facts, facts by state, certifications, suppliers with each kind of fact and
    with a contact that quote requests can go to, averages and shares as text, and the four gates: full crawls, usable contacts, capabilities in
    percent, and facts that wait for a person by supplier. value is a contact's normalized value, else its raw one. Types that begin with CONTACT are contacts.
    Facts become one row for each supplier by partial sums, so a supplier of very many facts is no burden.
    """
    kind, value, c = F.col("claim_type"), or_empty(F.col("value")), lambda x: F.count_if(x)
    contact, mail = kind.startswith("CONTACT"), F.contains(F.col("value"), F.lit("@"))
    usable = F.when(mail, usable_email(value, F.lit(None), F.lit(""))).otherwise(usable_phone(value))
    own = facts.groupBy("supplier_id").agg(
        F.sum("n_claims").alias("claims"), F.count(F.lit(1)).alias("facts"), *[c(F.col("review_state").isin(*states)).alias(name) for name, states in BATCH_STATES.items()],
        c(kind == "CERTIFICATION").alias("certifications"), *[F.bool_or(kind == t).alias(name) for name, t in BATCH_TYPES.items()],
        F.bool_or(contact).alias("with_contact"), F.bool_or(contact & F.coalesce(mail, F.lit(False))).alias("with_email"),
        F.bool_or(contact & ~F.coalesce(mail, F.lit(False))).alias("with_phone"), F.bool_or(contact & usable).alias("with_usable"),
    )
    pages = runs.groupBy("supplier_id").agg(F.max_by("pages", F.struct("started_at", "run_id")).alias("pages"))
    each = batches.join(pages, "supplier_id", "left").join(own, "supplier_id", "left").withColumn("crawl", crawl_class(F.col("pages")))
    sums = ["pages", "claims", "facts", *BATCH_STATES, "certifications"]
    flags = ["with_contact", "with_usable", "with_email", "with_phone", *BATCH_TYPES]
    out = each.groupBy("batch").agg(
        F.count(F.lit(1)).alias("suppliers"), *[c(F.col("crawl") == x).alias(x) for x in ("full", "partial", "failed")],
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums], *[c(F.coalesce(x, F.lit(False))).alias(x) for x in flags],
    )
    n = F.col("suppliers")
    return out.withColumns(
        {
            "average_pages": F.format_string("%.2f", F.col("pages") / n), "average_review": F.format_string("%.2f", F.col("human_review") / n),
            **{f"{x}_pct": percent(F.col(x), n) for x in ("full", "partial", "failed", *flags)},
            "crawl_gate": share(F.col("full"), n) >= GATES["crawl"], "contact_gate": share(F.col("with_usable"), n) >= GATES["contact"],
            "capability_gate": share(F.col("with_capability"), n) >= GATES["capability"], "review_gate": F.col("human_review") <= GATES["review"] * n,
        }
    )


def review_by_type(batches: DataFrame, facts: DataFrame) -> DataFrame:
    """(batch, category, n): facts that wait for a person, by batch and type, all kinds of contacts as CONTACT."""
    category = F.when(F.col("claim_type").startswith("CONTACT"), "CONTACT").otherwise(F.col("claim_type"))
    waiting = facts.where(F.col("review_state").isin(*BATCH_STATES["human_review"])).groupBy("supplier_id", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return waiting.join(batches.select("supplier_id", "batch"), "supplier_id").groupBy("batch", "category").agg(F.sum("n").alias("n"))


def report_changes(before: DataFrame, after: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Two reports, side by side: (key, count, before, after, change). A key that one of them lacks counts as zeros there."""
    long = lambda report, name: report.unpivot(key, counts, "count", name)
    both = long(before, "before").join(long(after, "after"), [key, "count"], "full_outer")
    a, b = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return both.select(key, "count", a.alias("before"), b.alias("after"), (b - a).alias("change"))


def city_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """locations (supplier_id, city) before and after a rebuild -> (city, before, after): different suppliers of each city, without case."""
    marked = before.select("supplier_id", F.lower("city").alias("city"), F.lit("before").alias("_when")).unionByName(after.select("supplier_id", F.lower("city").alias("city"), F.lit("after").alias("_when")))
    n = lambda when: F.countDistinct(F.when(F.col("_when") == when, F.col("supplier_id"))).alias(when)
    return marked.groupBy("city").agg(n("before"), n("after"))


def operational_metrics(suppliers: DataFrame, jobs: DataFrame, contacts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """One row: suppliers, jobs and finished jobs, with the shares of finished jobs, of suppliers with a contact and of suppliers with a capability."""
    out = suppliers.agg(F.count(F.lit(1)).alias("suppliers"))
    out = out.crossJoin(jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "COMPLETED").alias("done")))
    out = out.crossJoin(contacts.agg(F.countDistinct("supplier_id").alias("with_contact"))).crossJoin(capabilities.agg(F.countDistinct("supplier_id").alias("with_capability")))
    n = F.col("suppliers")
    return out.withColumns({"success_pct": percent(F.col("done"), F.col("jobs"), "100.0%"), "contact_pct": percent(F.col("with_contact"), n), "capability_pct": percent(F.col("with_capability"), n)})


def tally(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(column, n) for every one of the keys, zero where none occurs."""
    want = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return want.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def rebuilt_locations(locations: DataFrame, suppliers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Locations after a rebuild: those a person entered stay, the listed city comes back as a placeholder, and approved addresses (supplier_id, address, city, postal, seq) are replayed from the oldest on.

    An address of a postal code that is there already updates that row, the first of the listed city fills the placeholder, the rest are added. With the key of a place its postal code, else its text, the fold
    over a supplier's addresses is a group and a rank. outcome: KEPT, LISTED (no address filled it), FILLED or ADDED; updates is how many later addresses updated the row.
    """
    kept = locations.where("not by_crawler").select("supplier_id", "address", "city", F.lit("KEPT").alias("outcome"), F.lit(0).cast("long").alias("updates"))
    place = F.coalesce(F.nullif(F.upper(F.regexp_replace(or_empty(F.col("postal")), r"[\s-]+", "")), F.lit("")), F.lower(strip(F.col("address"))))
    once = addresses.withColumn("place", place).groupBy("supplier_id", "place").agg(F.min("seq").alias("seq"), F.max_by("address", F.struct("seq", "address")).alias("address"), F.min_by("city", F.struct("seq", "city")).alias("city"), (F.count(F.lit(1)) - 1).alias("updates"))
    listed = suppliers.select("supplier_id", F.col("city").alias("_listed"))
    near = once.join(listed, "supplier_id").withColumn("here", F.lower("city").eqNullSafe(F.lower("_listed")))
    fills = F.col("here") & (F.row_number().over(Window.partitionBy("supplier_id", "here").orderBy("seq", "place")) == 1)
    found = near.withColumn("outcome", F.when(fills, "FILLED").otherwise("ADDED")).select("supplier_id", "address", "city", "outcome", "updates")
    filled = found.where("outcome = 'FILLED'").select("supplier_id")
    seeded = suppliers.join(filled, "supplier_id", "left_anti").select("supplier_id", F.lit("(listed city)").alias("address"), "city", F.lit("LISTED").alias("outcome"), F.lit(0).cast("long").alias("updates"))
    return kept.unionByName(seeded).unionByName(found)


def contact_refresh(selected: DataFrame) -> DataFrame:
    """selected contacts (supplier_id, is_email, office, outcome) -> one row: suppliers, those with a chosen address and those with an office named."""
    chosen = F.col("outcome").isin("PRIMARY", "BACKUP", "EXTRA")
    each = selected.groupBy("supplier_id").agg(F.bool_or(chosen & F.col("is_email")).alias("mail"), F.bool_or(chosen & (or_empty(F.col("office")) != "")).alias("office"))
    return each.agg(F.count(F.lit(1)).alias("suppliers"), F.count_if("mail").alias("with_email"), F.count_if("office").alias("with_office"))


def recrawl_summary(claims: DataFrame, contacts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """For each supplier: different approved services, social pages and hours lines, and numbers of contacts and published capabilities."""
    shown = claims.where(F.col("review_state").isin(*APPROVED))
    n = lambda kind, name: F.countDistinct(F.when(F.col("claim_type") == kind, F.col("raw_value"))).alias(name)
    each = shown.groupBy("supplier_id").agg(n("SERVICE_LISTED", "services"), n("SOCIAL", "socials"), n("BUSINESS_HOURS", "hours"))
    con = contacts.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("contacts"))
    cap = capabilities.where("published").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("capabilities"))
    out = each.join(con, "supplier_id", "full").join(cap, "supplier_id", "full")
    return out.select("supplier_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("services", "socials", "hours", "contacts", "capabilities")])


def explain_supplier(claims: DataFrame, supplier_id) -> DataFrame:
    """(part, key, value, n) for one supplier: claims by type and state, and the different values of services and social pages."""
    mine = claims.where(F.col("supplier_id") == supplier_id)
    counts = mine.groupBy("claim_type", "review_state").agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("part"), F.col("claim_type").alias("key"), F.col("review_state").alias("value"), "n")
    values = mine.where(F.col("claim_type").isin("SERVICE_LISTED", "SOCIAL")).groupBy("claim_type", "raw_value").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(values.select(F.lit("value").alias("part"), F.col("claim_type").alias("key"), F.col("raw_value").alias("value"), "n"))


def table_counts(tables: dict[str, DataFrame], statuses: dict[str, tuple[DataFrame, str]], names: DataFrame, probes: list[str], smoke: str) -> DataFrame:
    """(part, key, n): rows of each table, rows by status, companies whose name holds each probe, and companies that are no smoke-test rows."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("part"), F.lit(k).alias("key"), "n") for k, t in tables.items()]
    parts += [t.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), F.col(c).cast("string").alias("key"), "n") for k, (t, c) in statuses.items()]
    low = F.lower("name")
    one = names.agg(*[F.count_if(F.contains(low, F.lit(p.lower()))).alias(f"p{i}") for i, p in enumerate(probes)], F.count_if(~F.contains(low, F.lit(smoke.lower()))).alias("real"))
    pairs = [F.struct(F.lit("probe").alias("part"), F.lit(p).alias("key"), F.col(f"p{i}").alias("n")) for i, p in enumerate(probes)] + [F.struct(F.lit("not smoke").alias("part"), F.lit("companies").alias("key"), F.col("real").alias("n"))]
    parts.append(one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def recall_diagnosis(pages: DataFrame, facts: DataFrame, most_pages: int = 3, most_chars: int = 250) -> DataFrame:
    """pages (supplier_id, page_id, title, text), facts (supplier_id, claim_type, raw_value, seq) -> a row for each crawled supplier.

    capabilities: its capability facts in order of seq; where it has none, samples: titles and first characters of its first pages.
    """
    own = facts.where("claim_type = 'CAPABILITY'").groupBy("supplier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw_value"))), lambda x: x["raw_value"]).alias("capabilities"))
    ranked = pages.withColumn("_rn", F.row_number().over(Window.partitionBy("supplier_id").orderBy("page_id")))
    sample = F.concat_ws(": ", or_empty(F.col("title")), F.substring(or_empty(F.col("text")), 1, most_chars))
    first = ranked.where(F.col("_rn") <= most_pages).groupBy("supplier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", sample.alias("s")))), lambda x: x["s"]).alias("samples"))
    out = first.join(own, "supplier_id", "left")
    none = F.array().cast("array<string>")
    return out.select("supplier_id", F.coalesce("capabilities", none).alias("capabilities"), F.when(F.col("capabilities").isNull(), F.col("samples")).otherwise(none).alias("samples"))


def rebuilt_audit(flags: DataFrame) -> DataFrame:
    """supplier_flags with a verdict for each supplier: PASS if it was crawled, has a contact and a capability and leaves no more facts to review than the gate allows."""
    usable = F.col("has_email") | F.col("has_phone")
    good = (F.col("crawl") != "failed") & usable & F.col("has_capability") & (F.col("waiting") <= GATES["review"])
    return flags.select("supplier_id", usable.alias("usable_contact"), "has_capability", "waiting", F.when(good, "PASS").otherwise("REVIEW").alias("verdict"))


#: Steps of the buyers' and the suppliers' funnel, by the events that count for them (fixed values).
FUNNEL_EVENTS = {
    "searches": "supplier_search", "profile_views": "profile_view", "suppliers_selected": "add_to_rfq", "requests_created": "rfq_create", "requests_sent": "rfq_send",
    "emails_delivered": "email_delivery", "responses_received": "supplier_response", "profiles_claimed": "profile_claim",
}


def percent_text(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, rounded as SQL's printf rounds a double: to the nearer by the double's exact value, to the even digit where it lies in the middle. Java's format rounds the shortest decimal form half up."""
    tenths = F.expr("1000L") * part
    low, over = F.floor(tenths / whole), 2 * F.pmod(tenths, whole)
    low = F.when(low * whole > tenths, low - 1).when((low + 1) * whole <= tenths, low + 1).otherwise(low)
    # In the middle, the double's error tells the side: 20 times the double as an exact sum of two, less the odd number in the middle.
    x = 100.0 * part / whole
    total = x * 16 + x * 4
    side = (total - (2 * low + 1)) + (x * 4 - (total - x * 16))
    up = F.when(over != whole, over > whole).when(side != 0, side > 0).otherwise(low % 2 == 1)
    digits = low + up.cast("long")
    return F.concat(F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"))


def market_funnels(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """events (event_type, metadata JSON) -> keys, nine counts and two rates as text: one pass, summed before the shuffle.

    Responses count as interested by the status in their metadata; metadata that is no JSON has none. Rates have one decimal, 0.0% where nothing
    was searched or delivered. Without keys an empty table gives one row of zeros.
    """
    counts = [F.count_if(F.col("event_type") == event).alias(step) for step, event in FUNNEL_EVENTS.items()]
    status = F.get_json_object("metadata", "$.status")
    interested = F.count_if((F.col("event_type") == FUNNEL_EVENTS["responses_received"]) & F.coalesce(status == "INTERESTED", F.lit(False))).alias("interested_responses")
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.concat(percent_text(F.col(part), F.col(whole)), F.lit("%"))).otherwise("0.0%")
    out = events.groupBy(*(keys or [])).agg(*counts, interested)
    return out.withColumns({"conversion_rate": rate("requests_sent", "searches"), "response_rate": rate("responses_received", "emails_delivered")})
