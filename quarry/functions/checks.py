"""Small tests: attachments, ownership claims, robots rules, area codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import or_empty, strip

FREE_HOSTS = ["gmail.com", "yahoo.com", "yahoo.ca", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com", "protonmail.com"]


def attachment_verdict(name: Column, mime: Column, content: Column, most_bytes: int = 10 * 1024 * 1024) -> Column:
    """OK, or why a file is refused: EMPTY, TOO_LARGE, EXTENSION, MIME, SIGNATURE (its first bytes are those of no allowed kind) or MISMATCH (of another kind than its extension says)."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    start = F.hex(F.substring(content, 1, 4))
    kind = F.when(start == "25504446", "pdf").when(start == "89504E47", "png").when(start.startswith("FFD8FF"), "jpg")
    ext = F.regexp_replace(F.lower(F.regexp_extract(or_empty(name), r"\.([^.]*)$", 1)), "^jpeg$", "jpg")
    return (
        F.when(size == 0, "EMPTY").when(size > most_bytes, "TOO_LARGE").when(~ext.isin("pdf", "png", "jpg"), "EXTENSION")
        .when(~F.lower(or_empty(mime)).isin("application/pdf", "image/png", "image/jpeg", "image/jpg"), "MIME").when(kind.isNull(), "SIGNATURE").when(kind != ext, "MISMATCH").otherwise("OK")
    )


def may_claim(email: Column, supplier_domain: Column) -> Column:
    """Whether an address proves a claim on a company: no free host, and the company's domain or one above it."""
    host = F.lower(F.regexp_extract(or_empty(email), "@([^@]+)$", 1))
    own = F.lower(or_empty(supplier_domain))
    return (host != "") & (own != "") & ~host.isin(*FREE_HOSTS) & ((host == own) | own.endswith(F.concat(F.lit("."), host)))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """files (site, content) -> (site, disallowed array, crawl_delay): the rules for every agent and for `agent`.

    Lines are numbered; a rule belongs to the last agent line before it, so the fold is a running maximum inside each file.
    """
    from pyspark.sql import Window

    lines = files.select("site", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line")).select("site", "n", strip(F.col("line")).alias("line")).where(~F.col("line").startswith("#") & F.contains("line", F.lit(":")))
    key, value = F.lower(strip(F.substring_index("line", ":", 1))), strip(F.expr("substr(line, instr(line, ':') + 1)"))
    rows = lines.withColumns({"key": key, "value": value})
    mine = (F.lower("value") == "*") | F.contains(F.lower("value"), F.lit(agent.lower()))
    order = Window.partitionBy("site").orderBy("n")
    rows = rows.withColumn("mine", F.last(F.when(F.col("key") == "user-agent", mine), ignorenulls=True).over(order)).where("mine")
    paths = F.transform(F.array_sort(F.collect_list(F.when((F.col("key") == "disallow") & (F.col("value") != ""), F.struct("n", "value")))), lambda x: x["value"])
    found = rows.groupBy("site").agg(paths.alias("disallowed"), F.max_by(F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double")), F.when(F.col("key") == "crawl-delay", F.col("n"))).alias("crawl_delay"))
    return files.select("site").join(found, "site", "left").select("site", F.coalesce("disallowed", F.array().cast("array<string>")).alias("disallowed"), "crawl_delay")


def path_disallowed(path: Column, disallowed: Column) -> Column:
    return F.exists(disallowed, lambda d: (d == "/") | path.startswith(d))


def line_of_area_code(digits10: Column, regions: dict[str, list[str]], toll_free: list[str]) -> Column:
    """A last label for a number: its region's line, a toll-free line, or one from elsewhere. regions: name -> area codes."""
    code = F.substring(digits10, 1, 3)
    out = F.when(code.isin(*toll_free), "Toll-free line")
    for name, codes in regions.items():
        out = out.when(code.isin(*codes), f"{name} line")
    return out.otherwise("Out-of-province line")
