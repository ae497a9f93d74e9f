"""Services and products as companies name them on their own pages: five places of a page are read, and the surest mention of each name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as u
from quarry.operators.relational import rank_within

# Folders of service and product pages, names that are no services, and wording that tells the kinds of names and menus apart.
SERVICE_FOLDER = r"/(?:[a-z0-9]+-){0,3}(?:services?|capabilities|what-we-do|solutions|expertise|specialties|specialities)"
PRODUCT_FOLDER = r"/(?:our-)?(?:products?|product-lines?|product-range)"
SECTION_TITLES = [
    "services", "service", "our services", "all services", "view all services", "other services", "service department",
    "expertise", "our expertise", "capabilities", "our capabilities", "solutions", "our solutions", "what we do",
    "industries", "industries served", "markets", "sectors", "projects", "featured projects", "our projects", "portfolio",
    "about", "about us", "who we are", "our story", "history", "our history", "mission", "our mission", "values", "our values",
    "contact", "contact us", "get in touch", "quick links", "request a quote", "get a quote", "free quote", "learn more",
    "read more", "view more", "see more", "view all", "more", "home", "overview", "careers", "join our team", "news", "blog",
    "events", "testimonials", "reviews", "faq", "faqs", "locations", "our locations", "gallery", "photos", "videos",
    "why choose us", "our team", "team", "leadership", "partners", "our partners", "clients", "safety", "quality",
    "sustainability", "community", "innovation", "design", "manufacture", "support", "resources", "downloads",
    "privacy policy", "terms", "sitemap", "search", "menu", "login", "sign in", "english", "français", "francais",
    "service areas", "areas we serve", "proud members of", "certifications", "equipment", "our equipment", "fleet",
    "details", "view details", "products", "our products", "all products", "view products", "shop now", "buy now", "brands", "new",
]
CALL_TO_ACTION = "request|find|explore|go|learn|discover|get|contact|call|view|see|read|click|book|schedule|download|subscribe|why|how|what|where|when|who|frequently|meet|join|watch|browse|shop"
INDUSTRY_NAME = "agriculture|aquaculture|fisheries|food(?: processing)?|forestry|pulp(?: and| &)? paper|mining|oil(?: and| &)? gas|energy|utilities|renewables?|power generation|wind|solar|marine|military|defen[cs]e|aerospace|automotive|transportation|healthcare|government|municipal|institutional|commercial|residential|industrial|manufacturing|construction|infrastructure|technology|retail|education|mining trucks"
KIND_OF_WORK = "services?|repairs?|machining|fabrication|installation|maintenance|testing|inspection|design|engineering|welding|rentals?|transport(?:ation)?|towing|rigging|lifting|cutting|bending|plating|grinding|coating|painting|blasting|construction|demolition|paving|drilling|consulting|management|automation|programming|electrical|mechanical|plumbing|hvac|piping|assessment|analysis|monitoring|commissioning|support|removal|supply|manufacturing|assembly|training|calibration|cleaning|salvage|rescue|driving|excavation|surveying|planning|architecture|remediation|lighting|integration|contracting|upgrades?|retrofits?|panels?|systems?|shutdowns?|turnarounds?"
PRAISE_OR_PAPER = "great|premier|world[- ]class|proven|success|excellent|best|leading|trusted|award|brochure|flyer|fact sheet|line card|portal|a-z|news|fran[cç]ais|french|english|español|preventing|facility in|website|configurator|advantage|benefits of|roi"
FRENCH_LETTERS = "[àâçéèêëîïôûùüÿœ]"
MONTH_OR_YEAR = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+)?(?:19|20)\d{2}"
REGION = "atlantic|atlantic canada|canada|maritimes|ontario|quebec|national|international|global"
PRONOUN = "we|our|ours|you|your|us|i|my|me"
PLACE_OR_OFFICE = "new brunswick|nova scotia|prince edward island|newfoundland|labrador|head office|office|location|branch"
FUNCTION_WORD = "the|of|to|for|with|on|in|at|every|from|by|is|are|be|has|have|will|can|that|this"
HOUSEKEEPING = r"about|company|who we are|our story|history|team|leadership|management team|contact|careers?|jobs?|employment|join|news|blog|media|press|events?|resources|downloads?|investors?|log ?in|sign ?in|account|locations?|branches|offices?|faq|legal|privacy|polic(?:y|ies)|our work|projects?|case stud(?:y|ies)|portfolio|gallery|testimonials?|certif\w*|quality|affiliations?|accreditations?|industr(?:y|ies)|markets?|sectors?|clients?|customers?|partners?|community|sustainab\w*|safety|environment\w*|language|fleet|equipment|videos?|home|insights|supplier resources|customer resources|articles?|tips|learn|knowledge|library|guides?|hiring|postings?|opportunities|openings|positions|vacancies|français|francais|english"
PRODUCT_MENU = "products?|product lines?|catalog(?:ue)?|shop|store|brands?"
SMALL_WORDS = ["And", "Of", "For", "The", "To", "In", "On", "With"]

#: Letters, digits and the underscore of ASCII only: what bounds a word.
_WORD = "A-Za-z0-9_"


def _words(pattern: str) -> str:
    """The alternatives as whole words, in any case."""
    return f"(?i)(?<![{_WORD}])(?:{pattern})(?![{_WORD}])"


def _opening(pattern: str) -> str:
    """The alternatives as the first whole words, in any case."""
    return f"(?i)^(?:{pattern})(?![{_WORD}])"


def title_case(c: Column) -> Column:
    """Text written in capitals with a capital for each word, small words aside; other text as it is."""
    marked = F.split(F.regexp_replace(F.lower(c), f"(?<![{_WORD}])(?=[a-z])", "\u0001"), "\u0001")
    out = F.array_join(F.transform(marked, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")
    for word in SMALL_WORDS:
        out = F.regexp_replace(out, f"(?<![{_WORD}]){word}(?![{_WORD}])", word.lower())
    return F.when(c == F.upper(c), F.concat(F.upper(F.left(out, F.lit(1))), F.substr(out, F.lit(2)))).otherwise(c)


def service_name(raw: Column, filed: bool = False) -> Column:
    """raw without marks around it, if it reads like the name of a service; else null. filed: it stands in the company's own folder of services, where the name of an industry is a service too."""
    text = F.regexp_replace(tx.collapse(F.replace(raw, F.lit("​"), F.lit(" "))), r"^[\s\-–—•·>»›|]+|[\s\-–—•·>»›|+]+$", "")
    text = tx.strip(F.regexp_replace(text, rf"\s+(?:[Aa]t|[Ii]n|[Aa]cross)\s+[A-Z][{_WORD}&'’ -]*$", ""))

    def judged(t: Column) -> Column:
        key = F.lower(t)
        refused = [
            ~F.length(t).between(3, 60), F.size(F.split(t, " ")) > 7,
            t.rlike(r"[?!.:;,]$"), t.rlike(r"^\d"), ~t.rlike("[A-Za-z]"), t.rlike(r"%%|[{}<>]"), t.rlike("^[a-z]"), t.rlike(r"^['\"‘’“”]"),
            t.rlike(_opening(CALL_TO_ACTION)), t.rlike(_words(PRAISE_OR_PAPER)), t.rlike(f"(?iu)@|_|{FRENCH_LETTERS}"), t.rlike(f"(?i)^(?:{REGION})$"), t.rlike(f"(?i)^{MONTH_OR_YEAR}$"),
            t.rlike(_words(PRONOUN)), t.rlike(_words(PLACE_OR_OFFICE)), F.size(F.regexp_extract_all(t, F.lit(_words(FUNCTION_WORD)), F.lit(0))) >= 2,
            key.isin(*SECTION_TITLES), F.regexp_replace(key, r"^our\s+", "").isin(*SECTION_TITLES),
        ]
        if not filed:
            refused.append(t.rlike(_opening(INDUSTRY_NAME)) & ~t.rlike(_words(KIND_OF_WORK)))
        bad = refused[0]
        for r in refused[1:]:
            bad = bad | r
        return F.when(~bad, title_case(t))

    return F.get(F.transform(F.array(text), judged), F.lit(0))


def service_key(name: Column) -> Column:
    """What two spellings of one service have in common."""
    plain = F.btrim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, f"s(?![{_WORD}])", "")


def _is_housekeeping(text: Column) -> Column:
    return text.rlike(_words(HOUSEKEEPING)) & ~text.rlike(_words(KIND_OF_WORK))


def _numbered(name: Column) -> Column:
    """Whether a name holds a digit, as the names of single articles do."""
    return name.rlike(r"\d")


_FOUND = "array<struct<name:string,type:string,evidence:string,locator:string,confidence:double>>"


def _found(name: Column, product: Column, evidence: Column, locator: Column | str, confidence: Column | float) -> Column:
    kind = F.when(product, "PRODUCT_LISTED").otherwise("SERVICE_LISTED")
    locator, confidence = (x if isinstance(x, Column) else F.lit(x) for x in (locator, confidence))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), kind.alias("type"), evidence.alias("evidence"), locator.alias("locator"), confidence.cast("double").alias("confidence")))


def _from_links(url: Column) -> Column:
    """Links to pages one level below a folder of services or products."""

    def read(link: Column) -> Column:
        path = u.path(link["href"])
        service, product = path.rlike(f"(?i){SERVICE_FOLDER}/[^/?#]+/?$"), path.rlike(f"(?i){PRODUCT_FOLDER}/[^/?#]+/?$")
        name = F.when(u.same_site(link["href"], url) & (service | product), service_name(link["text"], filed=True))
        name = F.when(service | ~_numbered(name), name)
        locator = F.when(service, "SERVICE_PAGE_LINK").otherwise("PRODUCT_PAGE_LINK")
        return _found(name, ~service, F.concat(F.lit('Linked as "'), name, F.lit('" to '), link["href"]), locator, 0.9)

    return F.transform("page.links", read)


def _from_menus(url: Column) -> Column:
    """Groups of a menu under a label that is no housekeeping: most links lead to the site, few are housekeeping, and most of the rest read like names."""

    def read(group: Column) -> Column:
        own = F.filter(group["links"], lambda link: u.same_site(link["href"], url))
        texts = F.transform(own, lambda link: F.coalesce(link["text"], F.lit("")))
        kept = F.filter(texts, lambda t: ~_is_housekeeping(t))
        names = F.array_compact(F.transform(kept, lambda t: service_name(t)))
        n = F.size(own)
        offers = (F.size(group["trail"]) > 0) & ~F.exists(group["trail"], lambda label: label.rlike(_words(HOUSEKEEPING)))
        offers = offers & (n >= 2) & (n >= 0.6 * F.size(group["links"])) & ((n - F.size(kept)) / n <= 0.4) & (F.size(names) >= 2) & (F.size(names) / n >= 0.6)
        product = F.exists(group["trail"], lambda label: label.rlike(_words(PRODUCT_MENU)))
        evidence = F.concat(F.lit('In the menu under "'), F.array_join(group["trail"], " › "), F.lit('" of '), url)
        return F.when(offers, F.transform(F.filter(names, lambda x: ~(product & _numbered(x))), lambda x: _found(x, product, evidence, "MENU_GROUP", 0.85))).otherwise(F.array().cast(_FOUND))

    return F.flatten(F.transform("page.menu_groups", read))


def _first_heading() -> Column:
    return F.get(F.filter("page.headings", lambda h: h["level"] == "h1"), F.lit(0))["text"]


def _from_collection(url: Column, kind: Column) -> Column:
    """The page's own heading, or title, where it is one of several alike."""
    title = F.get(F.split("page.title", r"\s+(?:[|–—-]|::)\s+"), F.lit(0))
    heading = F.get(F.split(tx.if_blank(_first_heading(), title), r"\s+(?:[|–—]|::)\s+"), F.lit(0))
    name = F.when(kind.isin("SERVICE", "PRODUCT") & ~_is_housekeeping(heading), service_name(heading))
    return F.array(_found(name, kind == "PRODUCT", F.concat(F.lit("One of several pages of a kind: "), url), "PAGE_COLLECTION", 0.85))


def _from_headings(url: Column, page_class: Column) -> tuple[Column, Column]:
    """The heading of a page of one service, or the headings of a page of services; and whether the page is such a page of services."""
    one = u.path(url).rlike(f"(?i){SERVICE_FOLDER}/[^/?#]+/?$")
    hub = F.coalesce(~one & (page_class.isin("SERVICES", "CAPABILITIES") | u.path(url).rlike(f"(?i){SERVICE_FOLDER}/?$")), F.lit(False))
    no = F.lit(False)

    def read(h: Column) -> Column:
        name = service_name(h["text"])
        sure = F.when(name.rlike(_words(KIND_OF_WORK)), 0.85).otherwise(0.6)
        return _found(name, no, F.concat(F.lit("Heading of "), url, F.lit(': "'), tx.strip(h["text"]), F.lit('"')), F.concat(F.lit("services_page_"), h["level"]), sure)

    main = F.array(_found(service_name(_first_heading(), filed=True), no, F.concat(F.lit("Main heading of "), url), "SERVICE_PAGE_TITLE", 0.9))
    below = F.transform(F.filter("page.headings", lambda h: h["level"].isin("h2", "h3")), read)
    return F.when(one, main).when(hub, below).otherwise(F.array().cast(_FOUND)), hub


def _from_lines(url: Column) -> Column:
    """Runs of four short lines or more of which most read like names, the first 25 of each run. Other lines become breaks, at which the text falls into its runs."""
    lines = F.transform(F.split(F.coalesce("page.content_text", F.lit("")), "\n"), lambda line: tx.strip(line))
    short = lambda x: (x != "") & (F.size(F.split(x, " ")) <= 6) & (F.length(x) <= 60) & ~x.rlike("[.!?]$")
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(short(x), x).otherwise("\u0001")), "\n"), "\u0001")

    def read(run: Column) -> Column:
        items = F.filter(F.split(run, "\n"), lambda x: x != "")
        names = F.array_compact(F.transform(items, lambda x: service_name(x)))
        listed = F.transform(F.slice(names, 1, 25), lambda x: _found(x, F.lit(False), F.concat(F.lit('In a list on "'), url, F.lit('"')), "services_page_list", 0.8))
        return F.when((F.size(items) >= 4) & (F.size(names) >= 0.7 * F.size(items)), listed).otherwise(F.array().cast(_FOUND))

    return F.flatten(F.transform(runs, read))


def listed_claims(parsed: DataFrame, keys: list[str], kind: Column | None = None, most: int = 40) -> DataFrame:
    """(keys, claim_type, raw_value, normalized_value, evidence_text, evidence_locator, extraction_method, confidence, seq): services and products that each page lists.

    parsed holds url and page (see parse_pages); kind is the collection the page belongs to (SERVICE, PRODUCT or null). Of the mentions of a name
    the surest counts, the first among equals; the first `most` names of each type are kept, in the order in which they were met. Lists of lines
    are read only where a page of services gave fewer than three names. All candidates of a page are found within its row.
    """
    url, kind = F.col("url"), F.lit(None).cast("string") if kind is None else kind
    page_class = u.classify(url, F.lit(""))
    headings, hub = _from_headings(url, page_class)
    sure = F.array_compact(F.concat(F.coalesce(_from_links(url), F.array().cast(_FOUND)), F.coalesce(_from_menus(url), F.array().cast(_FOUND)), _from_collection(url, kind), F.coalesce(headings, F.array().cast(_FOUND))))
    rows = parsed.select(*keys, "url", "page", sure.alias("sure"), hub.alias("hub"))
    names = F.array_distinct(F.transform("sure", lambda x: F.concat_ws(":", x["type"], service_key(x["name"]))))
    found = F.when(F.col("hub") & (F.size(names) < 3), F.concat("sure", _from_lines(url))).otherwise(F.col("sure"))
    each = rows.select(*keys, F.posexplode(found).alias("seq", "x")).select(*keys, "seq", "x.*").withColumn("key", service_key(F.col("name")))
    best = each.groupBy(*keys, "type", "key").agg(
        F.max_by(F.struct("name", "evidence", "locator", "confidence"), F.struct("confidence", (-F.col("seq")).alias("first"))).alias("b"), F.min("seq").alias("seq")
    )
    kept = rank_within(best, [*keys, "type"], [F.asc("seq")], most).drop("rn")
    return kept.select(
        *keys, F.col("type").alias("claim_type"), F.col("b.name").alias("raw_value"), F.replace("key", F.lit(" "), F.lit("-")).alias("normalized_value"), F.col("b.evidence").alias("evidence_text"),
        F.col("b.locator").alias("evidence_locator"), F.lit("PAGE_STRUCTURE").alias("extraction_method"), F.col("b.confidence").alias("confidence"), "seq",
    )
