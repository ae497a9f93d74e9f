import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as u


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,slug",
    [
        ("Certified to CSA W47.1 Div 2", "cwb-w47-1"),
        ("CWB certified shop", "cwb-certified"),
        ("Canadian Welding Bureau", "cwb-organization"),
        ("CWB member", "cwb-ambiguous"),
        ("ISO9001:2015", "iso-9001"),
        ("COR certified", "cor-safety"),
        ("ASME Section IX", "asme-pressure-vessel"),
        ("Gold Seal!", "gold-seal"),
    ],
)
def test_certification_form(spark, value, slug):
    assert one(spark, tx.certification_form(F.lit(value))["slug"]) == slug


@pytest.mark.parametrize(
    "raw,form",
    [("mailto:Sales@Firm.ca", "sales@firm.ca"), ("Email: a@b.comPhone", "a@b.com"), ("(555) 010-2030", "5550102030"), ("1-555-010-2030", "5550102030"), ("ext 5", "ext 5"), ("a%40b.ca", "a@b.ca"), ("%zz", "%zz")],
)
def test_contact_form(spark, raw, form):
    assert one(spark, tx.contact_form(F.lit(raw), F.lit(None).cast("string"))) == form


def test_fact_key(spark):
    assert one(spark, tx.fact_key(F.lit("LOCATION"), F.lit("12 Main St."), F.lit("E1C 2K8"))) == "e1c2k8-12-main-st"
    assert one(spark, tx.fact_key(F.lit("LOCATION"), F.lit(""), F.lit(None).cast("string"))) == "unknown-location"
    assert one(spark, tx.fact_key(F.lit("CAPABILITY"), F.lit(" Pipe & Welding "), F.lit(None).cast("string"))) == "pipe-welding"


@pytest.mark.parametrize("value,domain", [("https://www.Firm.ca/x", "firm.ca"), ("firm.ca", "firm.ca"), ("not a site", "not a site"), ("", None)])
def test_domain(spark, value, domain):
    assert one(spark, tx.domain_of(F.lit(value))) == domain


def test_phone_and_slug(spark):
    assert one(spark, tx.phone_of(F.lit("(555) 010-2030"))) == "555-010-2030"
    assert one(spark, tx.name_slug(F.lit("A & B  Works, Inc."))) == "a-b-works-inc"


@pytest.mark.parametrize("text,phrase,found", [("Pipe-welding done", "pipe welding", True), ("subpipe welding", "pipe welding", False), ("nuts and bolts", "nuts & bolts", True), ("ÉCOLE", "école", True)])
def test_phrase(spark, text, phrase, found):
    assert one(spark, tx.has_phrase(F.lit(text), phrase)) is found


@pytest.mark.parametrize(
    "url,key", [("https://www.Firm.ca/About/", "firm.ca/about"), ("http://firm.ca/index.html", "firm.ca/"), ("https://firm.ca/a?b=1#c", "firm.ca/a?b=1"), ("nonsense", "nonsense")]
)
def test_page_key(spark, url, key):
    assert one(spark, u.page_key(F.lit(url))) == key


def test_normalize_url(spark):
    assert one(spark, u.normalize_url(F.lit("https://A.example/x?utm_source=f&k=1&ref=z#top"))) == "https://a.example/x?k=1"
    assert one(spark, u.normalize_url(F.lit("https://a.example"))) == "https://a.example/"
    assert one(spark, u.normalize_url(F.lit("nope"))) is None


@pytest.mark.parametrize(
    "url,anchor,kind",
    [
        ("https://f.ca/", "", "HOME"),
        ("https://f.ca/our-services", "", "SERVICES"),
        ("https://f.ca/Winter-Service-Gate-Latch", "", "OTHER"),
        ("https://f.ca/contactors", "", "OTHER"),
        ("https://f.ca/contact", "", "CONTACT"),
        ("https://f.ca/x", "Our Services", "SERVICES"),
        ("https://f.ca/fleet", "", "EQUIPMENT"),
    ],
)
def test_classify(spark, url, anchor, kind):
    assert one(spark, u.classify(F.lit(url), F.lit(anchor))) == kind


@pytest.mark.parametrize("url,ok", [("https://shop.f.ca/a", True), ("https://g.ca/a", False), ("https://f.ca/login", False), ("https://f.ca/a.pdf", False), ("https://f.ca/l?sort=x", False), ("https://f.ca/fr/a", False)])
def test_crawlable(spark, url, ok):
    assert one(spark, u.crawlable(F.lit(url), F.lit("https://www.f.ca"))) is ok


@pytest.mark.parametrize("ip,bad", [("10.0.0.1", True), ("172.31.9.9", True), ("172.32.0.1", False), ("8.8.8.8", False), ("100.64.0.1", True), ("300.1.1.1", True), ("x", True)])
def test_private(spark, ip, bad):
    assert one(spark, u.private_ipv4(F.lit(ip))) is bad


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://f.ca/a?x=1&amp;y=2 </loc></url><url><loc><![CDATA[https://f.ca/b]]></loc></url></urlset>"
    assert one(spark, u.sitemap_locations(F.lit(xml))) == ["https://f.ca/a?x=1&y=2", "https://f.ca/b"]
