"""Sources and sinks beside Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import redacted
from quarry.functions.urls import is_sitemap_index, sitemap_locations

#: A row of the supplier import file.
SUPPLIER_ROW = "company_name string, website_url string, city string, province string, phone string, email string, category string"


def read_supplier_csv(spark: SparkSession, path: str) -> DataFrame:
    """Supplier rows with a fixed schema; quotes may span lines; broken rows keep what could be read."""
    return spark.read.csv(path, header=True, schema=SUPPLIER_ROW, multiLine=True, mode="PERMISSIVE", escape='"')


def seed_list(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A literal list of (name, url, city, province, domain)."""
    return spark.createDataFrame(rows, "name string, url string, city string, province string, domain string")


def sitemap_pages(sitemaps: DataFrame, most: int = 2_000) -> DataFrame:
    """sitemaps (site, xml) -> (site, url): pages listed by sitemaps that are no index, `most` of each site (the source's own limit)."""
    found = sitemaps.where(~is_sitemap_index(F.col("xml"))).select("site", F.posexplode(sitemap_locations(F.col("xml"))).alias("i", "url"))
    once = found.groupBy("site", "url").agg(F.min("i").alias("i"))
    return once.withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy("i", "url"))).where(F.col("rn") <= most).select("site", "url")


#: Where a site's sitemap may lie, in the order of trial, and names of child maps that list no pages of interest.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")
OTHER_MAPS = "(?i)image|video|author|tag|category|attachment"
MOST_CHILD_MAPS, MOST_SITEMAP_URLS = 5, 2_000


def site_urls(files: DataFrame) -> DataFrame:
    """Fetched files (site, url, status, xml) -> (site, place, url): what each site's sitemap lists, in its order, repeats included.

    site is an origin such as https://a.example. The first of SITEMAP_PATHS that leads to any page is used; an index leads to the pages of its first five
    child maps that are none of OTHER_MAPS. Files of a bad status, or that are no sitemap, list nothing. The first 2 000 addresses count (the source's
    own limit). Of files fetched twice under one address the least text counts. A child meets its file by address; only what may be a map is parsed.
    """
    is_map = F.coalesce(F.col("status").between(200, 299) & F.col("xml").rlike(r"(?i)<(?:urlset|sitemapindex)[\s>]"), F.lit(False))
    maps = files.where(is_map & F.col("url").isNotNull()).groupBy("site", "url").agg(F.min("xml").alias("xml"))
    found = maps.select("site", F.col("url").alias("_map"), is_sitemap_index(F.col("xml")).alias("_index"), sitemap_locations(F.col("xml")).alias("_urls"))
    rank = F.array_position(F.transform(F.array(*map(F.lit, SITEMAP_PATHS)), lambda p: F.concat("site", p)), F.col("_map"))
    tops = found.withColumn("_try", rank).where("_try > 0")
    wanted = F.slice(F.filter("_urls", lambda u: ~u.rlike(OTHER_MAPS)), 1, MOST_CHILD_MAPS)
    children = tops.where("_index").select("site", "_try", F.posexplode(wanted).alias("_child", "_map"))
    below = children.join(found.where("not _index").select("site", "_map", "_urls"), ["site", "_map"]).select("site", "_try", "_child", "_urls")
    lists = tops.where("not _index").select("site", "_try", F.lit(-1).alias("_child"), "_urls").unionByName(below)
    pages = lists.select("site", "_try", "_child", F.posexplode(F.slice("_urls", 1, MOST_SITEMAP_URLS)).alias("_i", "url"))
    first = lists.where(F.size("_urls") > 0).groupBy("site").agg(F.min("_try").alias("_try"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("_child", "_i"))
    return pages.join(first, ["site", "_try"], "left_semi").select("site", place.alias("place"), "url").where(F.col("place") <= MOST_SITEMAP_URLS)


_OWN_FOLDER: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, spark.checkpoint.dir; it goes when the driver's JVM ends. A local session without one gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="quarry-"))
        shared = _OWN_FOLDER[0]
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    return path


def write_supplier_csv(rows: DataFrame, path: str) -> None:
    """Rows of SUPPLIER_ROW as a file that read_supplier_csv reads back as they were; empty fields come back as nulls."""
    rows.select(*[c.split(" ")[0] for c in SUPPLIER_ROW.split(", ")]).write.csv(path, header=True, escape='"')


def log_events(events: DataFrame, path: str) -> None:
    """Appends events to a log; their metadata (JSON) is written with telling values hidden, and what is no JSON object as null."""
    append(events.withColumn("metadata", redacted(F.col("metadata"))), path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the table now, by the last committed pointer; null before the first."""
    fs, place = _file_system(spark, f"{path}/_pointers")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    committed = [n for n in names if not n.startswith((".", "_"))]
    return f"{path}/{committed[-1]}" if committed else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last committed version. A reader keeps that version, whatever is committed later."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of {path} is committed")
    return spark.read.parquet(version)


def replace_all(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a whole table anew as a version of its own and commits it by a pointer made last; df may read the table's own current version.

    A job that is lost before the commit leaves the old version in place and its own files unread. The pointer is a new empty file, whose making is one
    step on every file system, and of two writers of one version the second fails. The `keep` newest committed versions stay for their readers.
    """
    spark = df.sparkSession
    fs, pointers = _file_system(spark, f"{path}/_pointers")
    before = current_version(spark, path)
    name = f"v{int(before.rsplit('/v', 1)[1]) + 1 if before else 0:012d}"
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    commit(spark, path, name)
    old = sorted(s.getPath().getName() for s in fs.listStatus(pointers))[:-keep]
    for version in (v for v in old if v.startswith("v")):
        fs.delete(_file_system(spark, f"{path}/_pointers/{version}")[1], False)
        fs.delete(_file_system(spark, f"{path}/{version}")[1], True)
    return f"{path}/{name}"


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Makes a written version the current one."""
    fs, place = _file_system(spark, f"{path}/_pointers/{name}")
    fs.create(place, False).close()


def write_report(df: DataFrame, path: str) -> None:
    """A JSON report, a row on each line."""
    df.write.mode("overwrite").json(path)
