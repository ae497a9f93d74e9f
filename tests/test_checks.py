import pytest
from pyspark.sql import functions as F

from quarry.functions import checks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,mime,content,verdict",
    [
        ("a.pdf", "application/pdf", b"%PDF-1", "OK"),
        ("a.jpeg", "image/jpeg", b"\xff\xd8\xff\xe0", "OK"),
        ("a.png", "image/png", b"%PDF-1", "MISMATCH"),
        ("a.pdf", "text/plain", b"%PDF", "MIME"),
        ("a", "application/pdf", b"%PDF", "EXTENSION"),
        ("a.pdf", "application/pdf", b"PK00", "SIGNATURE"),
        ("a.pdf", "application/pdf", b"", "EMPTY"),
        (None, None, None, "EMPTY"),
        ("a.pdf", "application/pdf", b"%PDF" + b"x" * 20, "TOO_LARGE"),
    ],
)
def test_attachment(spark, name, mime, content, verdict):
    df = spark.createDataFrame([(name, mime, content)], "n string, m string, c binary")
    assert df.select(checks.attachment_verdict(F.col("n"), F.col("m"), F.col("c"), 20).alias("x")).first()["x"] == verdict


@pytest.mark.parametrize("email,domain,ok", [("a@firm.ca", "firm.ca", True), ("a@firm.ca", "shop.firm.ca", True), ("a@shop.firm.ca", "firm.ca", False), ("a@gmail.com", "gmail.com", False), (None, "firm.ca", False)])
def test_may_claim(spark, email, domain, ok):
    assert one(spark, checks.may_claim(F.lit(email).cast("string"), F.lit(domain))) is ok


def test_robots(spark):
    text = "User-agent: other\nDisallow: /x\n# note\nUser-agent: *\nDisallow: /private\nDisallow:\nCrawl-delay: 2.5\nUser-agent: MyBot\nDisallow: /bot"
    r = checks.robots_rules(spark.createDataFrame([("s", text), ("t", "")], "site string, content string"), "mybot").orderBy("site").collect()
    assert r[0]["disallowed"] == ["/private", "/bot"] and r[0]["crawl_delay"] == 2.5 and r[1]["disallowed"] == []
    assert one(spark, checks.path_disallowed(F.lit("/private/a"), F.array(F.lit("/private")))) is True
    assert one(spark, checks.line_of_area_code(F.lit("5065550100"), {"North": ["506"]}, ["800"])) == "North line"
