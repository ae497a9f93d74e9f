"""Queries of sources, sinks and queues: tables go through files and streams and come back, with the SQL of what must have come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.urls import host
from quarry.operators import admin as ad
from quarry.operators import reports as rp
from quarry.operators.relational import rank_within
from quarry.plans.administration import companies_with_domain
from quarry.plans.directory import HOST_SQL
from quarry.plans.registry import query
from quarry.sources import readers as rd
from quarry.streaming import jobs


@query(
    "s5_site_urls",
    f"""WITH p AS (SELECT page_id, 'https://' || {HOST_SQL} AS site FROM pages WHERE {HOST_SQL} <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rn FROM p),
    m AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM r WHERE rn <= 9 AND page_id % 3 <> 0), u AS (SELECT site, page_id, unnest([site || '/p' || page_id, site || '/p' || page_id || '?a=1&b=2']) AS url, unnest([1, 2]) AS i FROM m WHERE k <= 5 AND page_id % 5 <> 0)
    SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id, i) AS place, url FROM u""",
)
def s5(t):
    """Every page has a map of two addresses, some missing; a site's index lists the maps of its first nine pages, some of them of images. Its plain map is broken."""
    k, site = F.col("page_id"), F.col("site")
    pages = t.pages.select("page_id", F.concat(F.lit("https://"), F.regexp_replace(host(F.col("url")), r"^www\.", "")).alias("site")).where("site <> 'https://'")
    own = F.concat("site", F.lit("/p"), k.cast("string"))
    place = F.concat("site", F.when(k % 3 == 0, "/image-map-").otherwise("/map-"), k.cast("string"), F.lit(".xml"))
    page_map = F.concat(F.lit("<urlset><url><loc>"), own, F.lit("</loc></url><url><loc><![CDATA["), own, F.lit("?a=1&amp;b=2]]></loc></url></urlset>"))
    maps = pages.select("site", place.alias("url"), F.when(k % 5 == 0, 404).otherwise(200).alias("status"), page_map.alias("xml"))
    listed = rank_within(pages.withColumn("url", place), ["site"], [F.asc("page_id")], 9)
    locations = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.concat(F.lit("<sitemap><loc>"), x["url"], F.lit("</loc></sitemap>"))), "")
    index = listed.groupBy("site").agg(F.concat(F.lit("<sitemapindex>"), locations, F.lit("</sitemapindex>")).alias("xml")).select("site", F.concat(site, F.lit("/sitemap_index.xml")).alias("url"), F.lit(200).alias("status"), "xml")
    broken = pages.select("site", F.concat(site, F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), F.lit("<html>not here</html>").alias("xml")).distinct()
    return rd.site_urls(maps.unionByName(index).unionByName(broken))


@query(
    "s6_supplier_csv",
    r"""SELECT 'The "' || s_name || '",' || chr(10) || 'Ltd' AS company_name, 'https://s' || s_suppkey || '.example' AS website_url, s_nationkey::VARCHAR AS city, CASE WHEN s_acctbal > 0 THEN 'NB' END AS province, '506-555-0100' AS phone, NULL AS email, 'a;b' AS category FROM supplier""",
)
def s6(t):
    """Suppliers as an import file, with quotes, commas and line breaks in names."""
    key = F.col("s_suppkey").cast("string")
    rows = t.supplier.select(
        F.concat(F.lit('The "'), "s_name", F.lit('",\nLtd')).alias("company_name"), F.concat(F.lit("https://s"), key, F.lit(".example")).alias("website_url"), F.col("s_nationkey").cast("string").alias("city"),
        F.when(F.col("s_acctbal") > 0, "NB").alias("province"), F.lit("506-555-0100").alias("phone"), F.lit("").alias("email"), F.lit("a;b").alias("category"),
    )
    path = rd.scratch(t.spark, "suppliers")
    rd.write_supplier_csv(rows, path)
    return rd.read_supplier_csv(t.spark, path)


SEEDS = [("000000007", "https://s7.example", "Moncton", "NB", "s7.example"), ("Nobody", "https://nobody.example", "Dieppe", "NB", "nobody.example"), ("Elsewhere", "https://s3.example", "Halifax", "NS", "S3.example")]


@query(
    "s8_seed_list",
    """WITH seed(name, city, domain) AS (VALUES ('000000007', 'Moncton', 's7.example'), ('Nobody', 'Dieppe', 'nobody.example'), ('Elsewhere', 'Halifax', 'S3.example')),
    hit AS (SELECT seed.name, min(s_suppkey) AS supplier_id FROM seed JOIN supplier ON contains(lower(s_name), lower(seed.name)) OR lower(seed.domain) = 's' || s_suppkey || '.example' GROUP BY 1)
    SELECT name AS seed_id, supplier_id, CASE WHEN supplier_id IS NULL THEN 'INSERT' ELSE 'CORRECT' END AS action, name, domain, city FROM seed LEFT JOIN hit USING (name)""",
)
def s8(t):
    """A list of seeds against all companies."""
    return ad.seed_companies(rd.seed_list(t.spark, SEEDS).withColumn("seed_id", F.col("name")), companies_with_domain(t))


@query("k1_append", "SELECT event_id, event_type, user_id FROM events")
def k1(t):
    """Two appends to one table."""
    path, rows = rd.scratch(t.spark, "appended"), t.events.select("event_id", "event_type", "user_id")
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    rd.append(rows.where(bought), path)
    rd.append(rows.where(~bought), path)
    return t.spark.read.parquet(path)


@query("k5_json_report", "SELECT s_nationkey AS nation, count(*) AS suppliers, printf('%.1f', 100.0 * count(*) FILTER (s_acctbal > 0) / count(*)) || '%' AS in_credit FROM supplier GROUP BY 1")
def k5(t):
    """A report by nation as JSON lines."""
    report = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("_good"))
    report, path = report.select("nation", "suppliers", rp.percent(F.col("_good"), F.col("suppliers")).alias("in_credit")), rd.scratch(t.spark, "report")
    rd.write_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query("k6_replace_all", "SELECT s_suppkey AS supplier_id, s_acctbal + 1 AS balance FROM supplier WHERE s_acctbal > 0")
def k6(t):
    """A table replaced from itself."""
    path = rd.scratch(t.spark, "replaced")
    rd.replace_all(t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_acctbal").alias("balance")), path)
    rd.replace_all(rd.read_snapshot(t.spark, path).where("balance > 0").withColumn("balance", F.col("balance") + 1), path)
    return rd.read_snapshot(t.spark, path)


def one_table(t, name: str) -> str:
    """A table's path as a pattern: a stream takes a lone file only so."""
    return f"{t.dir}/{name}.parque[t]"


@query("x1_queue", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status FROM orders")
def x1(t):
    """Orders as jobs, each handed out once, and a second run that finds nothing new."""
    path, marks = rd.scratch(t.spark, "jobs"), rd.scratch(t.spark, "job-marks")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING")
    for _ in range(2):
        stream = jobs.job_stream(t.spark, one_table(t, "orders"), t.orders.schema)
        jobs.process_jobs(stream, lambda rows: rows.select(F.col("o_orderkey").alias("job_id"), status.alias("status")), path, marks).awaitTermination()
    return t.spark.read.parquet(path)


@query("x5_once_per_crawl", "SELECT DISTINCT user_id, event_type FROM events")
def x5(t):
    """The first event of each user and type of a run that reads all there is."""
    path, marks = rd.scratch(t.spark, "once"), rd.scratch(t.spark, "once-marks")
    stream = jobs.job_stream(t.spark, one_table(t, "events"), t.events.schema, 1_000_000)
    once = jobs.once_per_window(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"]).select("user_id", "event_type")
    jobs.process_jobs(once, lambda rows: rows, path, marks).awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "x6_event_log",
    """SELECT event_id, event_type, CASE WHEN event_type <> 'click' THEN '{"user":"' || user_id || '","apiToken":"[REDACTED]"}' END AS metadata FROM events""",
)
def x6(t):
    """Events with a token in their metadata, logged in two batches; clicks carry no JSON."""
    path, user = rd.scratch(t.spark, "log"), F.col("user_id").cast("string")
    metadata = F.when(F.col("event_type") != "click", F.concat(F.lit('{"user":"'), user, F.lit('","apiToken":"t'), user, F.lit('"}'))).otherwise("[no object")
    rows = t.events.select("event_id", "event_type", metadata.alias("metadata"))
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    rd.log_events(rows.where(bought), path)
    rd.log_events(rows.where(~bought), path)
    return t.spark.read.parquet(path)
