import pytest
from pyspark.sql import functions as F

from quarry.sources import readers
from quarry.streaming import jobs


def test_jobs_run_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    run = lambda: jobs.process_jobs(jobs.job_stream(spark, source, "id long"), lambda d: d.withColumn("done", F.lit(True)), out, check).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_delivery_fold(spark, tmp_path):
    """Three runs over files that come one after another: late and repeated events change nothing, a run writes only what changed, and a restart goes on from the state."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    runs = [
        [("a", "r1", "c1", "SENT", 1), ("a", "r1", "c1", "DELIVERED", 5), ("b", "r2", "c2", "BOUNCED", 2), ("c", None, None, "SENT", 1)],
        [("a", "r1", "c1", "SENT", 3), ("b", "r2", "c2", "BOUNCED", 2), ("d", "r1", "c1", "OPENED", 9)],
        [("c", None, None, "COMPLAINED", 4), ("a", "r1", "c1", "FAILED", 6)],
    ]
    written = []
    for rows in runs:
        spark.createDataFrame(rows, jobs.DELIVERY).coalesce(1).write.mode("append").parquet(source)
        query = jobs.fold_delivery_events(jobs.job_stream(spark, source, jobs.DELIVERY), out, check)
        query.awaitTermination()
        assert query.exception() is None
        written.append(spark.read.parquet(f"{out}/deliveries").count())
    assert written == [3, 4, 6]
    now = lambda name, *columns: sorted(tuple(r[c] for c in columns) for r in jobs.read_fold(spark, out, name).collect())
    assert now("deliveries", "message_id", "status", "arrival") == [("a", "FAILED", 6), ("b", "BOUNCED", 2), ("c", "COMPLAINED", 4), ("d", "OPENED", 9)]
    assert now("recipients", "recipient_id", "status") == [("r1", "OPENED"), ("r2", "BOUNCED")] and now("bounces", "contact_id", "arrival") == [("c2", 2)]


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", "r1", "c1", "SENT", 1)], jobs.DELIVERY).write.parquet(source)
    for _ in range(2):  # without its checkpoint the first batch runs again
        jobs.fold_delivery_events(jobs.job_stream(spark, source, jobs.DELIVERY), out, f"{check}{_}").awaitTermination()
    assert spark.read.parquet(f"{out}/deliveries").count() == 1


def test_snapshots(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        readers.read_snapshot(spark, path)
    readers.replace_all(spark.range(3), path)
    old = readers.read_snapshot(spark, path)
    # The table is made anew from itself.
    readers.replace_all(old.select((F.col("id") + 10).alias("id")), path)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(readers.read_snapshot(spark, path)) == [10, 11, 12] and ids(old) == [0, 1, 2]

    # A writer that is lost between writing and committing leaves the table as it was, and the next one goes on.
    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(readers, "commit", lost)
        with pytest.raises(OSError, match="lost"):
            readers.replace_all(spark.range(1), path)
    assert ids(readers.read_snapshot(spark, path)) == [10, 11, 12]
    readers.replace_all(readers.read_snapshot(spark, path).where("id > 10"), path)
    assert ids(readers.read_snapshot(spark, path)) == [11, 12] and not (tmp_path / "table" / "v000000000000").exists()


def test_sources(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('company_name,website_url,city,province,phone,email,category\n"Acme, ""Steel""",acme.example,Here,AA,,,\n')
    assert readers.read_supplier_csv(spark, str(path)).first()["company_name"] == 'Acme, "Steel"'
    maps = spark.createDataFrame([("s", "<urlset><url><loc>https://a/1</loc></url><url><loc>https://a/1</loc></url></urlset>"), ("s", "<sitemapindex><loc>https://a/x.xml</loc></sitemapindex>")], "site string, xml string")
    assert [r["url"] for r in readers.sitemap_pages(maps).collect()] == ["https://a/1"]
    readers.write_report(maps, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_site_urls(spark):
    """The first place that leads to pages, children that are skipped, missing, refused or too many, the limit, and files that are no sitemap."""
    loc = lambda *urls: "".join(f"<loc>{u}</loc>" for u in urls)
    pages = lambda *urls: f"<urlset>{loc(*urls)}</urlset>"
    rows = [
        ("https://a", "https://a/sitemap.xml", 200, "<sitemapindex >" + loc("https://a/image.xml", *[f"https://a/{i}.xml" for i in range(7)]) + "</sitemapindex>"),
        *[("https://a", f"https://a/{i}.xml", 404 if i == 1 else 200, pages(f"https://a/p{i}", "https://a/same")) for i in range(7) if i != 2],
        ("https://a", "https://a/image.xml", 200, pages("https://a/no")), ("https://a", "https://a/wp-sitemap.xml", 200, pages("https://a/later")),
        ("https://b", "https://b/sitemap.xml", 200, pages()), ("https://b", "https://b/sitemap_index.xml", 200, "<html></html>"), ("https://b", "https://b/wp-sitemap.xml", 200, pages("https://b/1")),
        ("https://c", "https://c/sitemap.xml", 200, pages(*[f"https://c/{i}" for i in range(2500)])), ("https://c", "https://c/sitemap.xml", 200, pages(*[f"https://c/{i}" for i in range(2500)])),
        ("https://d", "https://d/sitemap.xml", 500, pages("https://d/1")), ("https://d", None, 200, pages("https://d/1")), ("https://d", "https://d/wp-sitemap.xml", None, None),
    ]
    files = spark.createDataFrame(rows, "site string, url string, status int, xml string")
    got = {}
    for r in sorted(readers.site_urls(files).collect()):
        got.setdefault(r["site"], []).append(r["url"])
    assert got["https://a"] == [u for i in (0, 3, 4) for u in (f"https://a/p{i}", "https://a/same")]
    assert got["https://b"] == ["https://b/1"] and got["https://c"] == [f"https://c/{i}" for i in range(2000)] and "https://d" not in got
    assert readers.site_urls(files.limit(0)).count() == 0
