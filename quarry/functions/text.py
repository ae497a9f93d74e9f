"""String and normal-form expressions. All are built-in functions over Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers and JavaScript see it, including the no-break space and other Unicode spaces (fixed values).
SPACE = r"[\s   -     　﻿]"


#: The same characters one by one.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def strip(c: Column) -> Column:
    """Trims all Unicode white space, not only spaces."""
    return F.btrim(c, F.lit(SPACES))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row however often use names it: a named expression is copied to each place otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def if_blank(c: Column, other: Column) -> Column:
    """c, or other where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the lower-cased column contains any of the words, by one alternation of quoted literals."""
    return F.lower(or_empty(c)).rlike("|".join(rf"\Q{w}\E" for w in words))


def domain_of(c: Column) -> Column:
    """Host of an address without www., lower-cased; null for null or empty; what cannot be read as an address is trimmed and lower-cased."""
    host = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:\s]+)(?::\d+)?(?:[/?#].*)?$", 1)
    clean = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(F.length(or_empty(c)) > 0, F.when(host != "", clean).otherwise(F.lower(strip(c))))


def phone_of(c: Column) -> Column:
    """ddd-ddd-dddd for ten digits, else the trimmed input; null for null or empty."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    ten = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4))
    return F.when(F.length(or_empty(c)) > 0, F.when(F.length(digits) == 10, ten).otherwise(strip(c)))


def name_slug(c: Column) -> Column:
    """Slug of a company name: other characters vanish, spaces become single hyphens."""
    kept = F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")


def fact_slug(c: Column) -> Column:
    """Slug of a fact: every run of other characters becomes one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def certification_form(c: Column) -> Column:
    """struct(slug, name): the normal form of a certification; the first rule that fits wins."""
    low = strip(F.lower(c))
    has = lambda *words: low.rlike("|".join(re.escape(w) for w in words))
    form = lambda slug, name: F.struct(F.lit(slug).alias("slug"), F.lit(name).alias("name"))
    certified = has("certified", "certification")
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")
    return (
        F.when(has("w47.1", "w47-1", "w47 1"), form("cwb-w47-1", "CWB W47.1 Certification"))
        .when((has("cwb") & certified) | has("certified by cwb"), form("cwb-certified", "CWB Certified (Standard Unspecified)"))
        .when(has("canadian welding bureau") & ~certified, form("cwb-organization", "Canadian Welding Bureau (Organization Mention)"))
        .when((low == "cwb") | low.startswith("cwb ") | has("cwb member", "cwb registered"), form("cwb-ambiguous", "CWB (Ambiguous Mention)"))
        .when(has("iso 9001", "iso9001"), form("iso-9001", "ISO 9001 Quality Management"))
        .when(has("cor safety", "cor certified", "cor-safety", "certificate of recognition"), form("cor-safety", "COR Safety Certification"))
        .when(has("asme"), form("asme-pressure-vessel", "ASME Pressure Piping / Vessel"))
        .otherwise(F.struct(if_blank(slug, low).alias("slug"), c.alias("name")))
    )


def contact_form(raw: Column, normalized: Column) -> Column:
    """Normal form of an e-mail address or phone number; decoding failures leave the text as it is."""
    chosen = strip(if_blank(normalized, raw))
    # A plus sign stays a plus sign when percent escapes are decoded.
    decoded = once(chosen, lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))
    return once(decoded, lambda d: _contact_form(d, raw))


def _contact_form(decoded: Column, raw: Column) -> Column:
    mail = F.lower(strip(F.regexp_replace(F.regexp_replace(decoded, "(?i)^mailto:", ""), "(?i)^%20", "")))
    # A label is parted from its address by a colon or space; one run together with it shows only where a word has run into the end too. Else toby@firm.ca would lose its beginning.
    label, ending = "(?i)^(?:email|e-mail|contact|mail|address|to)", r"(?i)\.(com|ca|org|net|co|io|biz|info|us)(phone|tel|address|fax|call|mobile|contact).*$"
    bare = once(mail, lambda m: F.when(m.rlike(ending), F.regexp_replace(m, label, "")).otherwise(F.regexp_replace(m, label + r"(?=[:\s])", "")))
    mail = F.regexp_replace(bare, r"^[:\s-]+", "")
    mail = F.regexp_replace(mail, ending, ".$1")
    number = lambda digits: F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    other = F.coalesce(once(F.regexp_replace(decoded, r"\D", ""), number), F.lower(strip(decoded)))
    return F.when(F.contains(decoded, F.lit("@")) | F.contains(raw, F.lit("@")), mail).otherwise(other)


def fact_key(claim_type: Column, raw: Column, normalized: Column) -> Column:
    """The canonical slug of a claim, by its type."""
    postal = F.lower(F.regexp_replace(or_empty(normalized), "(?i)[^a-z0-9]", ""))
    street = F.regexp_replace(F.regexp_replace(F.lower(or_empty(raw)), "[^a-z0-9]+", "-"), "^-|-$", "")
    place = F.when((postal != "") & (street != ""), F.concat_ws("-", postal, street)).otherwise(if_blank(postal, if_blank(street, F.lit("unknown-location"))))
    return (
        F.when(claim_type == "CERTIFICATION", certification_form(if_blank(raw, or_empty(normalized)))["slug"])
        .when(claim_type == "CONTACT", contact_form(raw, normalized))
        .when(claim_type == "LOCATION", place)
        .otherwise(if_blank(fact_slug(if_blank(normalized, raw)), F.lit("unknown")))
    )


#: Wording that takes an offer back (fixed values).
NEGATION = r"(?i)do\s+not\s+(offer|provide|perform|manufacture|do)|don'?t\s+(offer|provide|perform|manufacture|do)|no\s+longer\s+(offer|provide|perform|manufacture|do)|not\s+available|we\s+do\s+not\s+do|excluded\s+from\s+scope"


def negated(text: Column) -> Column:
    return or_empty(text).rlike(NEGATION)


def phrase_pattern(phrase: str) -> str:
    """A pattern for the whole phrase: spaces or hyphens between its words, & the same as and, no letter or digit at either side."""
    words = [r"(?:&|and)" if w in ("&", "and") else re.escape(w) for w in re.split(r"[\s-]+", phrase.strip().lower()) if w]
    return r"(?iu)(?<![\p{L}\p{N}])" + r"(?:\s+|\s*-\s*)".join(words) + r"(?![\p{L}\p{N}])"


def has_phrase(text: Column, phrase: str) -> Column:
    return or_empty(text).rlike(phrase_pattern(phrase))


def text_units(text: Column, longest: int = 400) -> Column:
    """Units of text: lines, then sentences, then list pieces of those still too long, cut hard at `longest` characters."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / longest)), lambda i: strip(F.substr(s, i * longest + 1, F.lit(longest))))
    sentences = F.flatten(F.transform(F.split(text, r"\n+"), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9])")))
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > longest, F.split(s, r"\s*[;•|·]\s*|\s*,\s+")).otherwise(F.array(s))))
    return F.filter(F.flatten(F.transform(pieces, cut)), lambda u: u != "")


def snippet(text: Column, at: Column, length: Column, radius: int = 100) -> Column:
    """The text around position `at` (from 1), trimmed to whole words at both ends."""
    begin = F.greatest(at - radius, F.lit(1))
    piece = F.substr(text, begin, at + length + radius - begin)
    left = F.when(begin > 1, F.regexp_replace(piece, r"^\S*\s", "")).otherwise(piece)
    return strip(F.when(at + length + radius - 1 < F.length(text), F.regexp_replace(left, r"\s\S*$", "")).otherwise(left))


SECRET_KEYS = ["token", "secret", "password", "key", "auth", "credential", "cookie", "session"]


def redacted(metadata: Column) -> Column:
    """A JSON object's text with values of telling keys hidden; null for what is no object."""
    parsed = F.from_json(metadata, "map<string,string>")
    hide = lambda k, v: F.when(k.rlike("(?i)" + "|".join(SECRET_KEYS)), F.lit("[REDACTED]")).otherwise(v)
    return F.to_json(F.transform_values(parsed, hide))
