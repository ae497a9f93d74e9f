import pytest
from pyspark.sql import functions as F

from quarry.operators import extract_terms as et

PAGE = "page_id int, url string, page struct<content_text:string,headings:array<struct<level:string,text:string>>,image_alts:array<string>>"


def pages(spark, text, url="https://a.example/x", headings=(), alts=()):
    return spark.createDataFrame([(1, url, (text, [("h2", h) for h in headings], list(alts)))], PAGE)


def values(df):
    return {r["normalized_value"]: r["confidence"] for r in df.collect()}


@pytest.mark.parametrize(
    "text,slug,confidence",
    [
        ("We are certified to W47.1.", "cwb-w47-1", 0.85),
        ("CWB certified shop", "cwb-certified", 0.75),
        ("We work with the Canadian Welding Bureau", "cwb-organization", 0.6),
        ("working towards ISO 9001", "iso-9001", 0.48),
        ("COR holder", "cor-safety", 0.8),
        ("ASME parts", "asme-pressure-vessel", 0.56),
        ("incorporated in ISO 45001 corrosion", None, None),
    ],
)
def test_certifications(spark, text, slug, confidence):
    assert values(et.certification_claims(pages(spark, text), ["page_id"])) == ({slug: confidence} if slug else {})


def test_image_text(spark):
    assert values(et.certification_claims(pages(spark, "", alts=["ISO 9001 logo"]), ["page_id"])) == {"iso-9001": 0.68}


def test_equipment_and_industry(spark):
    terms = [("lathe", "Industrial Lathe", ["CNC lathe"]), ("press", "Press Brake", [])]
    got = values(et.equipment_claims(pages(spark, "We operate a CNC lathe.\nWe sell press brakes."), ["page_id"], terms))
    assert got == {"lathe": 0.85, "press": 0.5}
    assert values(et.equipment_claims(pages(spark, "Press brake", "https://a.example/equipment"), ["page_id"], terms)) == {"press": 0.9}
    industries = [("mining", "Mining & Metals", ["mining"]), ("marine", "Shipbuilding", [])]
    assert values(et.industry_claims(pages(spark, "We serve mining customers.\nShipbuilding long ago"), ["page_id"], industries)) == {"mining": 0.82, "marine": 0.75}


def test_regions(spark):
    regions = [("north", "North Shore", r"(?i)\bNorth\s+Shore\b"), ("bay", "Bay Town", r"(?i)\bBay\s+Town\b(?!['’]s)")]
    got = values(et.region_claims(pages(spark, "Proudly serving the North Shore. Our services: Bay Town's best."), ["page_id"], regions))
    assert got == {"north": 0.9}


def test_listed(spark):
    text = "UL 10C\n• NFPA 80\nDoor and Hardware Institute (DHI)\nCall 506-555-0101\nWe are proud of UL 10C.\nUL 10C"
    got = et.listed_certification_claims(pages(spark, text, "https://a.example/certifications"), ["page_id"]).orderBy("seq").collect()
    assert [r["raw_value"] for r in got] == ["UL 10C", "NFPA 80", "Door and Hardware Institute (DHI)"]
    assert et.listed_certification_claims(pages(spark, text), ["page_id"]).count() == 0


def test_addresses(spark):
    towns = {"Bay": "BB", "Bay Town": "AA", "Hill": "CC"}
    f = lambda t: spark.range(1).select(et.parse_address(F.lit(t), towns, {"E": "EE"}).alias("a")).first()["a"].asDict()
    assert f("12 Hill Road, Bay Town e1c2k8") == {"city": "Bay Town", "province": "EE", "postal": "E1C 2K8"}
    assert f("1 Main, Bay") == {"city": "Bay", "province": "BB", "postal": None}
    assert f("nowhere") == {"city": None, "province": None, "postal": None}


def test_publish_locations(spark):
    have = spark.createDataFrame([("s", "Bay", None, "seeded", True), ("s", "Hill", "E1C 2K8", "9 Low Rd", False)], "supplier_id string, city string, postal string, address string, placeholder boolean")
    rows = [("s", 1, "Bay", "E2A 1A1", "1 Main", None), ("s", 2, "Bay", "e2a1a1", "One Main", None), ("s", 3, "Hill", "E1C2K8", "other", None), ("s", 4, "Bay", None, "2 Main", None), ("s", 5, None, None, "x", None), ("s", 6, "Hill", None, "y", "PROJECT_OR_CLIENT_LOCATION")]
    claims = spark.createDataFrame(rows, "supplier_id string, seq int, city string, postal string, address string, role string")
    got = {r["seq"]: r["outcome"] for r in et.publish_locations(have, claims).collect()}
    assert got == {1: "FILLED_PLACEHOLDER", 2: "UPDATED_EXISTING", 3: "UPDATED_EXISTING", 4: "ADDED", 5: "SKIPPED", 6: "SKIPPED"}
