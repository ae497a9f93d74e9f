"""Addresses of pages: keys, same-site tests, classes, crawl order and budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import or_empty

#: Query parameters that only track visitors (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]
#: Paths that never are a company page, and query strings that only sort or filter a listing (fixed values).
NOT_A_PAGE = [
    r"/(?:login|signin|sign-in|signup|register|my-account|account|logout|search|cart|checkout|basket|wishlist|compare)(?:/|$|\?)",
    r"/(?:tag|tags|category|categories|author|archives?)/",
    r"/page/\d+",
    r"\.(?:pdf|zip|rar|png|jpe?g|gif|webp|svg|ico|mp[34]|mov|avi|wmv|docx?|xlsx?|pptx?|ics|xml|json|rss|css|js|dwg|dxf|stp|step|exe|dmg)$",
    r"/(?:wp-login|wp-admin|wp-json|wp-content|wp-includes|feed|xmlrpc|cdn-cgi)(?:/|$|\.)",
    r"/(?:privacy|terms|cookie|legal|disclaimer|accessibility)(?:[-_/]|$)",
    r"/(?:fr|fr-ca|fr_ca|es)(?:/|$)",
    r"/(?:print|share|email-protection)(?:/|$)",
]
NOISE_QUERY = r"(?i)[?&](?:sort|order|orderby|filter|view|lang|replytocom|share|print|add-to-cart|s|q|p|page_id|attachment_id|sector|subsector|category|type|tag)="
CRAWL_ORDER = ["CONTACT", "LOCATION", "SERVICES", "CAPABILITIES", "ABOUT", "EQUIPMENT", "CERTIFICATIONS", "INDUSTRIES", "HOME", "OTHER", "PROJECTS", "PRODUCTS"]
BUDGETS = {"NEWS": 5, "CAREERS": 2, "PRODUCTS": 15, "PROJECTS": 8, "DEEP_OTHER": 30}

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def query_string(url: Column) -> Column:
    q = F.regexp_extract(url, _URL, 3)
    return F.when(q == "?", F.lit("")).otherwise(q)


def normalize_url(url: Column) -> Column:
    """An absolute address without fragment and tracking parameters, host lower-cased, root path present; null for what is no address."""
    clean = F.regexp_replace(query_string(url), rf"(?<=[?&])(?:{'|'.join(TRACKING)})(?:=[^&]*)?(?=&|$)", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "&{2,}", "&"), r"\?&", "?"), "[?&]+$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(:\d+)?", 1)
    root = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url), port, root, clean))


def page_key(url: Column) -> Column:
    """One key for a page with and without www., trailing slash and index file; the address itself where it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), r"(?i)/index\.(?:html?|php|aspx?)$", "")
    return F.when(host(url) != "", F.concat(bare_host(url), F.when(bare == "", "/").otherwise(F.lower(bare)), query_string(url))).otherwise(url)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other, www. aside."""
    x, y = bare_host(a), bare_host(b)
    return F.coalesce((x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))), F.lit(False))


def crawlable(url: Column, site: Column) -> Column:
    keys = F.size(F.filter(F.split(F.regexp_replace(query_string(url), r"^\?", ""), "&"), lambda x: x != ""))
    return F.coalesce(url.rlike("(?i)^https?:") & same_site(url, site) & ~query_string(url).rlike(NOISE_QUERY) & (keys < 2) & ~path(url).rlike("(?i)" + "|".join(NOT_A_PAGE)), F.lit(False))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")


def classify(url: Column, anchor: Column) -> Column:
    """The page's class, by whole words of the path and by the link's text; the first rule that fits wins."""
    low_path, text = F.lower(path(url)), F.lower(or_empty(anchor))
    words = lambda *stems: low_path.rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(stems)})")
    exact = lambda *terms: low_path.rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(terms)})(?:[^a-z0-9]|$)")
    folder = F.exists(segments(url), lambda s: s.rlike(r"^(?:our-)?(?:[a-z]+-)?services?(?:-|$)") & (F.size(F.split(s, "-")) <= 3))
    return (
        F.when(low_path.isin("/", ""), "HOME")
        .when(words("about", "company", "who", "history") | text.rlike(r"\babout\b"), "ABOUT")
        .when(folder | text.rlike(r"^(?:our\s+)?services?$"), "SERVICES")
        .when(words("capabilit", "expertise", "specialt", "what") | text.rlike(r"\bcapabilit"), "CAPABILITIES")
        .when(words("product") | text.rlike(r"\bproducts?\b"), "PRODUCTS")
        .when(words("industr", "markets", "sectors") | text.rlike(r"\bindustr"), "INDUSTRIES")
        .when(words("equip", "machin", "facilit", "fleet") | text.rlike(r"\bequipment\b"), "EQUIPMENT")
        .when(words("certif", "quality", "accreditation") | text.rlike(r"\bcertif"), "CERTIFICATIONS")
        .when(words("project", "portfolio", "gallery", "work") | text.rlike(r"\bprojects?\b"), "PROJECTS")
        .when(exact("contact", "contacts", "contactus") | text.rlike(r"\bcontact\b"), "CONTACT")
        .when(words("location", "branch", "office") | exact("plant", "plants") | text.rlike(r"\blocations?\b"), "LOCATION")
        .otherwise("OTHER")
    )


def crawl_priority(url: Column, page_class: Column) -> Column:
    """Place of the class times 100, plus the path's depth (9 where the address can't be read)."""
    place = F.array_position(F.array(*map(F.lit, CRAWL_ORDER)), page_class) - 1
    return place * 100 + F.when(host(url) != "", F.size(segments(url))).otherwise(9)


def low_value_bucket(url: Column, page_class: Column) -> Column:
    """The bucket of pages of which only a budget is read; null for all others."""
    any_segment = lambda p: F.exists(segments(url), lambda s: s.rlike(f"^(?:{p})$"))
    n = F.size(segments(url))
    return (
        F.when(host(url) == "", F.lit(None).cast("string"))
        .when(any_segment("blogs?|news|press|press-releases|media|events?|articles?|posts?|stories|insights|updates|newsroom") & (n >= 2), "NEWS")
        .when(any_segment("careers?|jobs?|employment|join-our-team|work-with-us|opportunities"), "CAREERS")
        .when((page_class == "PRODUCTS") & (n >= 2), "PRODUCTS")
        .when((page_class == "PROJECTS") & (n >= 2), "PROJECTS")
        .when((page_class == "OTHER") & (n >= 3), "DEEP_OTHER")
    )


def sitemap_locations(xml: Column) -> Column:
    """Addresses in a sitemap, without CDATA marks."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def private_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is loopback, private, link-local, shared, documentation, multicast or reserved; true for what is no address."""
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    bad = (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224)
    )
    return ~ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") | F.coalesce(bad, F.lit(True))


#: Names of hosts inside a network, and the beginnings of IPv6 addresses that lead there: unspecified and loopback, mapped and translated IPv4, unique local, link-local, multicast, documentation (fixed values).
INNER_HOSTS = r"(?i)^(?:localhost|.*\.(?:localhost|local|internal|intranet|lan|home|corp))$"
INNER_IPV6 = r"(?i)^\[?(?:::1?\]?$|::ffff:|64:ff9b:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:)"


def forbidden_host(host: Column) -> Column:
    """Whether a host must not be fetched from: private, reserved or malformed IPv4, such IPv6, or a name inside a network. Empty is forbidden."""
    numeric = host.rlike(r"^[\d.]+$")
    return F.coalesce((host == "") | host.rlike(INNER_HOSTS) | (F.contains(host, F.lit(":")) & host.rlike(INNER_IPV6)) | (numeric & private_ipv4(host)), F.lit(True))
