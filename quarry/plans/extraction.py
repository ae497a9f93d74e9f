"""Queries of the page reader, extractors and streams, and extras that Spark gives beyond the reference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry import taxonomy
from quarry.operators import extract as ex
from quarry.plans.registry import query


@query("p10_html_parse")
def p10(t):
    """Pages read into title, links, headings and text."""
    p = ex.parse_pages(t.pages.select("page_id", "url", "html"))
    return p.select("page_id", F.col("page.title").alias("title"), F.size("page.links").alias("links"), F.size("page.headings").alias("headings"), F.length("page.content_text").alias("content_chars"), "content_print")


@query("p13_menu_groups")
def p13(t):
    p = ex.parse_pages(t.pages.select("page_id", "url", "html"))
    return p.select("page_id", F.posexplode("page.menu_groups").alias("place", "g")).select("page_id", "place", F.size("g.links").alias("links"))


DOC_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


@query("e2_contacts", rf"SELECT doc_id, lower(m) AS normalized_value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{DOC_MAIL}')) AS m FROM documents) GROUP BY 1, 2")
def e2(t):
    """Addresses in the text of documents, each once for each document, cleaned."""
    none = F.array().cast("array<string>")
    page = F.struct(none.alias("mailto"), none.alias("tel"), F.col("text").alias("full_text"))
    claims = ex.contact_claims(t.documents.select("doc_id", page.alias("page")), ["doc_id"])
    return claims.where(F.contains("normalized_value", F.lit("@"))).select("doc_id", "normalized_value")


@query("e4_capability_terms")
def e4(t):
    """Dictionary terms in the documents, with context and confidence."""
    heads = F.array().cast("array<struct<level:string,text:string>>")
    page = F.struct(F.lit("").alias("title"), heads.alias("headings"), F.col("text").alias("content_text"))
    terms = [("on", "on that", False), ("en", "en la", True)]
    return ex.capability_claims(t.documents.select("doc_id", page.alias("page")), ["doc_id"], terms).select("doc_id", "normalized_value", "context", "confidence")


#: How a term stands in a document, by doc_id, and what that tells of it.
STANDS = [("Our team does ", " daily", "DIRECT"), ("We sell ", " goods", "RESALE"), ("How ", " helps", "EXPLANATION"), ("A degree course in ", " here", "EDUCATION")]
_LITERAL = lambda x: "'" + x.replace("'", "''") + "'"
_STANDS_SQL = ", ".join(f"({i}, '{a}', '{z}', '{c}', {ex.CONTEXT_FACTOR[c]})" for i, (a, z, c) in enumerate(STANDS))
_TERMS_SQL = ", ".join(f"({i}, '{slug}', {_LITERAL(phrase)}, {str(alias).lower()}, {0.8 if phrase.lower() in ex.WEAK_ALIASES else 1.0})" for i, (slug, phrase, alias) in enumerate(taxonomy.phrases()))


@query(
    "e4_dictionary",
    rf"""WITH terms(i, slug, phrase, alias, weak) AS (VALUES {_TERMS_SQL}), stands(k, head, tail, context, factor) AS (VALUES {_STANDS_SQL}),
    units AS (SELECT doc_id, head || phrase || tail AS unit, context, factor FROM documents JOIN terms ON i = doc_id % {len(taxonomy.phrases())} JOIN stands ON k = doc_id % {len(STANDS)}),
    met AS (SELECT doc_id, slug, context, CASE WHEN alias THEN weak * 0.95 ELSE 1 END * 0.85 * factor AS confidence FROM units JOIN terms ON regexp_matches(unit, '(?i)(^|[^a-z0-9])' || replace(replace(replace(phrase, '/', '\/'), ' & ', ' (?:&|and) '), ' ', '(?:\s+|\s*-\s*)') || '($|[^a-z0-9])'))
    SELECT doc_id, slug AS normalized_value, context, CASE WHEN context <> 'DIRECT' THEN round(max(confidence), 3) END AS confidence FROM met GROUP BY doc_id, slug, context""",
)
def e4_dictionary(t):
    """The whole dictionary over all documents, a term of it written into the first line of each. Confidence of direct mentions depends on their number and is left out."""
    terms = taxonomy.phrases()
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int") + 1)
    line = F.concat(of([a for a, _, _ in STANDS], F.col("doc_id")), of([p for _, p, _ in terms], F.col("doc_id")), of([z for _, z, _ in STANDS], F.col("doc_id")))
    heads = F.array().cast("array<struct<level:string,text:string>>")
    page = F.struct(F.lit("").alias("title"), heads.alias("headings"), F.concat(line, F.lit("\n"), F.col("text")).alias("content_text"))
    found = ex.capability_claims(t.documents.select("doc_id", page.alias("page")), ["doc_id"], terms)
    return found.select("doc_id", "normalized_value", "context", F.when(F.col("context") != "DIRECT", F.col("confidence")).alias("confidence"))


@query("x_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def x_rollup(t):
    """Beyond the reference: totals at every level."""
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("x_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("quantity"))


@query(
    "x_sessions",
    "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY 1, 2",
)
def x_sessions(t):
    """Beyond the reference: visits split at pauses of half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    marked = t.events.withColumn("new", F.when(before.isNull() | (F.col("ts") - before > F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"))
