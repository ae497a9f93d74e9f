"""Links of pages: resolving, discovery for a full crawl, and the few links that are worth most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls as u
from quarry.functions.text import collapse, once, or_empty
from quarry.model import rank_in

#: Classes from the one whose pages are wanted most on.
WANTED_ORDER = ["CONTACT", "LOCATION", "SERVICES", "CAPABILITIES", "ABOUT", "EQUIPMENT", "CERTIFICATIONS", "INDUSTRIES", "PRODUCTS", "PROJECTS", "HOME", "OTHER"]
#: Schemes of links that lead to no page.
NO_PAGE = r"(?i)^(?:mailto|tel|javascript|data):"
_NOISE = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>"
_TAG = r"""(?is)<(a|area|link)\b((?:[^>"']|"[^"]*"|'[^']*')*)>(?:((?:(?!<a\b).)*?)</a>)?"""


def _attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute in a tag's text, in double, single or no quotes; empty where it is missing."""
    at = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(attributes, at, i) for i in (1, 2, 3)])
    for mark, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        value = F.replace(value, F.lit(mark), F.lit(char))
    return value


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments worked off."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    ends = path.rlike(r"(?:^|/)\.\.?$")
    return F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))


def resolve(href: Column, base: Column) -> Column:
    """href as an absolute address, read against the page it stands on: absolute, without scheme, from the root, a query alone, or relative to the page's folder. Null where base is no address."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.when(u.path(base) == "", "/").otherwise(u.path(base))
    bare, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(bare), rest))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when((href == "") | href.startswith("#"), F.concat(origin, path, u.query_string(base)))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, bare)), rest))
    )
    return F.when(origin != "", out)


def found_links(pages: DataFrame, keys: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """(keys, url, seq, link, anchor): anchors, image-map areas and English alternates of each page, as normal addresses, with the text inside. Scripts and comments hold no links."""
    clean = F.regexp_replace(or_empty(F.col(html)), _NOISE, " ")
    tag = lambda i: F.regexp_extract_all(clean, F.lit(_TAG), F.lit(i))
    rows = pages.select(*keys, url, F.posexplode(F.arrays_zip(tag(1).alias("t"), tag(2).alias("a"), tag(3).alias("b"))).alias("seq", "x"))
    attributes = F.col("x.a")
    english = (F.lower(_attribute(attributes, "rel")) == "alternate") & (F.lower(_attribute(attributes, "hreflang")) == "en")
    # What inline makes is made once; a named expression would be copied to each of the many places that use it.
    rows = rows.select(*keys, url, "seq", F.inline(F.array(F.struct(F.lower("x.t").alias("_kind"), F.btrim(_attribute(attributes, "href")).alias("_href"), english.alias("_english"), F.col("x.b").alias("_text")))))
    rows = rows.where((F.col("_href") != "") & ~F.col("_href").rlike(NO_PAGE) & ((F.col("_kind") != "link") | F.col("_english")))
    text = collapse(F.regexp_replace(or_empty(F.col("_text")), r"<[^>]*>", " "))
    link = once(resolve(F.col("_href"), F.col(url)), u.normalize_url)
    return rows.select(*keys, url, "seq", F.inline(F.array(F.struct(link.alias("link"), F.when(F.col("_kind") == "a", text).otherwise("").alias("anchor"))))).where("link is not null")


def _once(links: DataFrame, keys: list[str]) -> DataFrame:
    first = links.groupBy(*keys, u.page_key(F.col("link")).alias("key")).agg(F.min_by(F.struct("link", "anchor"), "seq").alias("f"), F.min("seq").alias("seq"))
    return first.select(*keys, "key", F.col("f.link").alias("link"), F.col("f.anchor").alias("anchor"), "seq", u.classify(F.col("f.link"), F.col("f.anchor")).alias("page_class"))


def site_links(pages: DataFrame, keys: list[str], html: str = "html", url: str = "url", site: str | None = None) -> DataFrame:
    """(keys, key, link, anchor, seq, page_class): every crawlable page of the same site that a page links to, once by page key, as first linked."""
    rows = found_links(pages, keys, html, url)
    return _once(rows.where(u.crawlable(F.col("link"), F.col(site or url))), keys)


def wanted_links(pages: DataFrame, keys: list[str], html: str = "html", url: str = "url", most: int = 20) -> DataFrame:
    """The `most` links of each page that are worth most: by class, then from shallow to deep, then as first linked. Links to the page itself, to French copies and to what never is a company page are left out."""
    rows = found_links(pages, keys, html, url).where(F.col("link").rlike("(?i)^https?:") & ~F.col("link").rlike(r"(?i)[?&]lang=fr\b") & u.same_site(F.col("link"), F.col(url)))
    rows = rows.where(~u.path(F.col("link")).rlike("(?i)" + "|".join(u.NOT_A_PAGE)) & (u.page_key(F.col("link")) != u.page_key(F.col(url))))
    order = [rank_in(F.col("page_class"), WANTED_ORDER), F.size(u.segments(F.col("link"))), F.col("seq")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return _once(rows, keys).withColumn("place", place).where(F.col("place") <= most)
