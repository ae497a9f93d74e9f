"""Places in text: known towns in reading order, addresses with their roles, and placeholders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import or_empty, strip

#: Towns that addresses name; one of them is written in two ways.
KNOWN_PLACES = (
    "Grand Bay-Westfield, Grand Falls, St. John's, Saint John's, Saint John, Fredericton, Moncton, Dieppe, Riverview, Shediac, Memramcook, Sackville, Sussex, Quispamsis, Rothesay, Hampton, Oromocto, Woodstock, Miramichi, Edmundston, "
    "Bathurst, Campbellton, Caraquet, Shippagan, Tracadie, Richibucto, Bouctouche, St. Stephen, St. Andrews, Balmoral, Halifax, Dartmouth, Bedford, Burnside, Lower Sackville, Truro, Amherst, New Glasgow, Stellarton, Antigonish, Sydney, "
    "Port Hawkesbury, Kentville, Windsor, Bridgewater, Yarmouth, Elmsdale, Charlottetown, Summerside, Mount Pearl, Paradise, Conception Bay South, Corner Brook, Gander, Grand Falls-Windsor, Labrador City, Happy Valley-Goose Bay"
).split(", ")
SAME_PLACE = {"Saint John's": "St. John's"}
#: How provinces are written behind a town.
PROVINCES = "NB|NS|PE|PEI|NL|N\\.B\\.|N\\.S\\.|P\\.E\\.I\\.|New Brunswick|Nova Scotia|Prince Edward Island|Newfoundland"
#: Roles that evidence can name; wording that tells a role, in the order it is tried; parts of addresses of pages that speak of the company's own place.
ROLES = ("HEADQUARTERS", "BRANCH", "FACILITY", "PROJECT_OR_CLIENT_LOCATION", "SERVICE_REGION", "OUT_OF_REGION")
ELSEWHERE = ("PROJECT_OR_CLIENT_LOCATION", "SERVICE_REGION", "OUT_OF_REGION")
ROLE_WORDING = [
    ("PROJECT_OR_CLIENT_LOCATION", r"project\s+(?:location|site)|job\s*site|client\s+site|completed\s+work|recent\s+project|case\s+study"),
    ("HEADQUARTERS", "head office|headquarters|corporate hq|main office|home office|main shop|corporate office"),
    ("BRANCH", "branch|office location|regional office|satellite office|locations:|our locations"),
    ("FACILITY", "fabrication shop|manufacturing plant|plant|warehouse|yard|facility"),
    ("SERVICE_REGION", "serving|service area"),
]
OWN_PAGES = ("/contact", "/about", "/location")
#: Shapes of postal codes, numbers, street numbers, street words and boxes.
POSTAL = r"(?i)(?<![A-Za-z0-9])[A-Z]\d[A-Z][ -]?\d[A-Z]\d(?![0-9])"
REGIONAL = "^[ABCEabce]"
PHONE = r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
NUMBER = r"\b\d{1,6}[A-Za-z]?(?:[-–]\d{1,6})?,?\s+(?=[A-Za-zÀ-ÿ])"
STREET = r"\b(?:st|street|ave|avenue|rd|road|dr|drive|blvd|boul|boulevard|bl|way|cres|crescent|court|ct|lane|ln|row|place|pl|highway|hwy|route|rte|rue|chemin|ch|parkway|pkwy|terrace|circle|close|trail|square|sq|park|path|quay|wharf)\b"
BOX = r"\b(?:P\.?\s?O\.?\s+Box|Box)\s+\d+"
UNIT = r"\b(?:P\.?\s?O\.?\s+Box|Box|Unit|Suite)\s+\d"
PLACEHOLDER = r"(?i)\(Seeded\)|^Primary (?:Location|Address)$|\(listed city\)"


def is_placeholder(address: Column) -> Column:
    """Whether an address line was made when the company was first put in, before any address was found."""
    return strip(or_empty(address)).rlike(PLACEHOLDER)


def role_in_evidence(evidence: Column) -> Column:
    """The role that evidence names after 'Role:'; UNKNOWN for none and for others."""
    named = F.regexp_extract(or_empty(evidence), r"Role:\s*([A-Z_]+)", 1)
    return F.when(named.isin(*ROLES), named).otherwise("UNKNOWN")


def known_places(text: Column, with_province: bool = False) -> Column:
    """The known towns in reading order, one for each spot, where the longest name counts; with_province: only those with a province written behind them."""
    names = sorted(KNOWN_PLACES, key=len, reverse=True)
    tail = rf"(?=,?\s*(?:{PROVINCES})(?![A-Za-z]))" if with_province else ""
    found = F.regexp_extract_all(or_empty(text), F.lit(rf"(?iu)(?<![\p{{L}}'])(?=({'|'.join(map(re.escape, names))})(?![\p{{L}}']){tail})"), F.lit(1))
    written = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), SAME_PLACE.get(n, n))])
    return F.transform(found, lambda n: written[F.lower(n)])


def role_of(around: Column, url: Column, page_text: Column, addresses: Column) -> Column:
    """The role of an address from the words around it; else a page with three addresses or more lists branches, one that speaks of the company, or that has no other address, gives the head office."""
    low = F.lower(around)
    own = F.lower(or_empty(url)).rlike("|".join(OWN_PAGES)) | low.rlike(r"\boffice\b") | ((addresses == 1) & ~F.lower(page_text).rlike(r"\b(?:head office|headquarters)\b"))
    out = F.when(F.lit(False), F.lit(""))
    for role, wording in ROLE_WORDING:
        out = out.when(low.rlike(rf"\b(?:{wording})\b"), role)
    return out.when(addresses >= 3, "BRANCH").when(own, "HEADQUARTERS").otherwise("UNKNOWN")


def street_part(before: Column) -> Column:
    """The address in front of a postal code: from the last street number with a street word near it, else from a box, else from the first number, else from a unit; null without any of them."""
    text = F.right(F.regexp_replace(F.regexp_replace(before, PHONE, " "), r"\s+", " "), F.lit(160))
    starts = [rf"(?is)^.*((?=\b\d)(?=.{{0,58}}{STREET}){NUMBER}.*)$", rf"(?is)^.*?({BOX}.*)$", rf"(?s)^.*?({NUMBER}.*)$", rf"(?is)^.*?({UNIT}.*)$"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, s, 1), F.lit("")) for s in starts])
    return F.regexp_replace(F.trim(found), r"[,\s•|-]+$", "")


def address_claims(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, url, text) -> (keys, raw_value, normalized_value, role, confidence, seq): addresses with postal codes of the region, each code once.

    The text between two codes belongs to the second: of it the last three lines and 160 characters are read. A town may stand behind the code.
    """
    text = or_empty(F.col("text"))
    codes, pieces = F.regexp_extract_all(text, F.lit(POSTAL), F.lit(0)), F.split(text, POSTAL)
    bare = F.transform(codes, lambda c: F.upper(F.regexp_replace(c, r"[\s-]+", "")))
    regional = F.size(F.array_distinct(F.filter(bare, lambda c: c.rlike(REGIONAL))))
    rows = pages.select(*keys, "url", text.alias("_text"), pieces.alias("_pieces"), regional.alias("_n"), F.posexplode(bare).alias("seq", "_code")).where(F.col("_code").rlike(REGIONAL))
    lines = F.split(F.right(F.get("_pieces", F.col("seq")), F.lit(160)), "\n")
    before = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), ", ")
    behind = F.substring(F.get(F.split(F.get("_pieces", F.col("seq") + 1), "\n"), F.lit(0)), 1, 40)
    town = F.trim(F.regexp_extract(behind, r"^\s*,\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ .'’-]{2,28}?)(?:,?\s+(?:CA|Canada))?\s*$", 1))
    code = F.concat_ws(" ", F.substring("_code", 1, 3), F.substring("_code", 4, 3))
    rows = rows.withColumns({"_before": before, "_town": town, "normalized_value": code}).withColumn("_street", street_part(F.col("_before")))
    address = F.regexp_replace(F.concat_ws(" ", "_street", "normalized_value"), r"\s+", " ")
    more = (F.col("_town") != "") & ~F.contains(F.lower(address), F.lower("_town"))
    rows = rows.where(F.col("_street").isNotNull() & (F.length(address) >= 12)).withColumn("raw_value", F.concat(address, F.when(more, F.concat(F.lit(", "), "_town")).otherwise("")))
    rows = rows.withColumn("role", role_of(F.concat_ws(" ", "_before", "_code"), F.col("url"), F.col("_text"), F.col("_n")))
    first = rows.groupBy(*keys, "normalized_value").agg(F.min_by(F.struct("raw_value", "role"), "seq").alias("f"), F.min("seq").alias("seq"))
    return first.select(*keys, F.col("f.raw_value").alias("raw_value"), "normalized_value", F.col("f.role").alias("role"), F.when(F.col("f.role") == "UNKNOWN", 0.7).otherwise(0.9).alias("confidence"), "seq")
